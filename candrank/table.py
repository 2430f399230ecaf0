"""A table of measured candidates: rows of groups, identities, features and one cost."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions.columns import Noise, best_of, finite, floor, median, tolerance


@dataclass(frozen=True)
class Measurements:
    """rows hold a row for each candidate of each group; ids tell a group's candidates apart and break ties, never the cost."""

    rows: DataFrame
    groups: tuple[str, ...]
    ids: tuple[str, ...]
    cost: str = "t"
    noise: Noise = Noise()
    size_boundary: float = 3.0

    def of(self, rows: DataFrame) -> Measurements:
        return replace(self, rows=rows)

    def where(self, condition: Column | str) -> Measurements:
        return self.of(self.rows.where(condition))

    def per_group(self, *order: str | Column) -> Window:
        w = Window.partitionBy(*self.groups)
        return w.orderBy(*order) if order else w

    def ranked(self, by: str | Column, name: str = "rn") -> DataFrame:
        """rows with each candidate's place by a value, ties by identity."""
        return self.rows.withColumn(name, F.row_number().over(self.per_group(by, *self.ids)))

    def bests(self) -> DataFrame:
        return self.rows.groupBy(*self.groups).agg(best_of(F.col(self.cost)).alias("best"))

    def with_best(self) -> DataFrame:
        """rows with their group's best: a partial aggregate joined, so that a large group is many tasks."""
        return self.rows.join(self.bests(), list(self.groups), "left")


def group_stats(mt: Measurements) -> DataFrame:
    """One row for each group: counts, best, median, difficulty, floor, tolerance, answers, ties, distinct costs, small flag.

    All rows count as candidates, usable or not; best is the least finite cost above zero.
    """
    t = F.col(mt.cost)
    base = mt.rows.groupBy(*mt.groups).agg(F.count("*").alias("n"), best_of(t).alias("best"), median(t).alias("median"), F.count_distinct(F.when(finite(t), t)).alias("n_distinct"))
    base = base.withColumns({"difficulty": F.col("median") / F.col("best"), "floor": floor(F.col("best"), mt.noise), "tol": tolerance(F.col("best"), mt.noise)})
    near = mt.rows.join(base.select(*mt.groups, "best", "tol"), list(mt.groups)).groupBy(*mt.groups).agg(
        F.count_if(t <= F.col("best") * (1 + F.col("tol"))).alias("n_answers"), F.count_if(t == F.col("best")).alias("n_ties")
    )
    out = base.join(near, list(mt.groups))
    return out.withColumns({"distinct_fraction": F.col("n_distinct") / F.col("n"), "small": F.col("best") < mt.size_boundary})


def evaluate(mt: Measurements, score: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """groups, k, regret, hit, tol: how far the k candidates of the lowest score are from the group's best.

    Places are given before the cost is looked at. Only the first max(ks) candidates pass the shuffle's
    window limit; the costs of the others count in the best alone.
    """
    t = F.col(mt.cost)
    top = mt.ranked(score).where(F.col("rn") <= max(ks))
    picks = top.groupBy(*mt.groups).agg(*[F.min(F.when(F.col("rn") <= k, t)).alias(f"t{k}") for k in ks])
    out = picks.join(mt.bests(), list(mt.groups)).withColumn("tol", tolerance(F.col("best"), mt.noise))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"t{k}").alias("t")) for k in ks])).alias("x")
    out = out.select(*mt.groups, "best", "tol", each)
    return out.select(*mt.groups, F.col("x.k").alias("k"), (F.col("x.t") / F.col("best")).alias("regret"), (F.col("x.t") <= F.col("best") * (1 + F.col("tol"))).alias("hit"), "tol")


def first_picks(mt: Measurements, scores: tuple[str, ...], name: str) -> DataFrame:
    """groups, name (the score's number), regret: evaluate at k = 1 for several scores, in one aggregation that sorts no group."""
    t = F.col(mt.cost)
    known = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in mt.groups])
    picks = mt.rows.where(known).groupBy(*mt.groups).agg(best_of(t).alias("best"), *[F.min_by(t, F.struct(s, *mt.ids)).alias(f"t{i}") for i, s in enumerate(scores)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(f"t{i}") / F.col("best")).alias("regret")) for i in range(len(scores))])).alias("x")
    return picks.select(*mt.groups, each).select(*mt.groups, F.col("x.i").alias(name), F.col("x.regret").alias("regret"))
