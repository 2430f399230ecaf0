"""Search-budget curves: the best relative cost after k draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.table import Measurements


def _first(rows: DataFrame, groups: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each draw, limited before the shuffle."""
    w = Window.partitionBy(*groups, "draw").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def _best_at(top: DataFrame, groups: list[str], ks: tuple[int, ...]) -> DataFrame:
    """Mean over draws of the least relative cost among the first k of each draw."""
    best = top.groupBy(*groups, "draw").agg(*[F.min(F.when(F.col("rn") <= k, F.col("rel"))).alias(str(k)) for k in ks])
    long = best.unpivot([*groups, "draw"], [str(k) for k in ks], "k", "rel")
    return long.groupBy(*groups, F.col("k").cast("long").alias("k")).agg(F.avg("rel").alias("value"))


def random_curve(mt: Measurements, ks: tuple[int, ...], repeats: int, keep: Column | None = None) -> DataFrame:
    """groups, k, value: draws without replacement, by MD5 of identity and draw, over repeats.

    Without a condition the best is joined to what the draws have picked, so that no other row is shuffled for it.
    """
    groups, rel = list(mt.groups), F.col(mt.cost) / F.col("best")
    rows = mt.with_best().withColumn("rel", rel).where(keep) if keep is not None else mt.rows
    rows = rows.select(*groups, *mt.ids, mt.cost if keep is None else "rel", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("draw"))
    top = _first(rows, groups, [F.md5(F.concat_ws("|", *mt.ids, "draw")), *mt.ids], max(ks))
    return _best_at(top if keep is not None else top.join(mt.bests(), groups, "left").withColumn("rel", rel), groups, ks)


def conditional_curve(mt: Measurements, axes: tuple[str, ...], ks: tuple[int, ...], repeats: int) -> DataFrame:
    """The same for a walk along the axes, uniform over the values still alive at each; repeats do not count.

    A candidate's probability is the product of one over the values alive at each axis. Drawing without
    replacement by probability is sorting by -ln(u) / p.
    """
    groups = list(mt.groups)
    least = mt.rows.groupBy(*groups, *axes).agg(F.min(mt.cost).alias("least"))
    rows = least.join(mt.bests(), groups).select(*groups, *axes, (F.col("least") / F.col("best")).alias("rel"))
    inverse = []
    for i, a in enumerate(axes):
        alive = rows.groupBy(*groups, *axes[:i]).agg(F.count_distinct(a).alias(f"alive{i}"))
        rows = rows.join(alive, [*groups, *axes[:i]])
        inverse.append(F.col(f"alive{i}"))
    weight = reduce(lambda p, c: p * c, inverse, F.lit(1.0))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *groups, *axes, "draw")), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("clock", F.round(-F.log((h + 1) / 4294967297.0) * weight, 6))
    return _best_at(_first(rows, groups, ["clock", *axes], max(ks)), groups, ks)


def summary(curve: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """Geometric mean over groups where every group has the k."""
    n = curve.select(*groups).distinct().agg(F.count("*").alias("every"))
    out = curve.groupBy(*by).agg(C.geomean(F.col("value")).alias("value"), F.count("value").alias("n"))
    return out.crossJoin(F.broadcast(n)).where("n = every").drop("every")
