"""Ranking candidates and reading what the ranks give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions.columns import best_of, floor, geomean, tolerance
from candrank.operators.order import exact_quantiles
from candrank.sources.shared import written
from candrank.table import Measurements


def answers(mt: Measurements) -> DataFrame:
    """Candidates that the noise cannot tell from the group's best."""
    best = mt.bests().withColumn("limit", F.col("best") * (1 + tolerance(F.col("best"), mt.noise)))
    return mt.rows.join(best, list(mt.groups)).where(F.col(mt.cost) <= F.col("limit")).drop("limit")


def prune_share(mt: Measurements, keep: Column) -> DataFrame:
    return mt.rows.agg(F.count_if(keep).alias("kept"), F.count("*").alias("n")).withColumn("share", F.col("kept") / F.col("n"))


def population(mt: Measurements, family: str, least: int = 2) -> DataFrame:
    return mt.rows.groupBy(*mt.groups).agg(F.count_distinct(family).alias("n_families")).where(F.col("n_families") >= least)


def population_all(mt: Measurements, condition: Column) -> DataFrame:
    return mt.rows.groupBy(*mt.groups).agg(F.count("*").alias("n"), F.every(condition).alias("every")).where("every").drop("every")


def regimes(groups: DataFrame, value: Column, knee: float) -> DataFrame:
    return groups.withColumn("ratio", value / knee).withColumn("regime", F.when(F.col("ratio") < 1, "mem").otherwise("comp"))


def classify(mt: Measurements, rules: list[tuple[str, Column]], other: str) -> DataFrame:
    """Class of each group by its best candidate; the first rule that holds wins."""
    cols = [c for c in mt.rows.columns if c not in mt.groups]
    best = mt.rows.groupBy(*mt.groups).agg(F.min_by(F.struct(*cols), F.struct(mt.cost, *mt.ids)).alias("b")).select(*mt.groups, "b.*")
    label = F.lit(other)
    for name, condition in reversed(rules):
        label = F.when(condition, name).otherwise(label)
    return best.withColumn("class", label)


def tertile_band(df: DataFrame, col: str) -> DataFrame:
    df = written(df, "bands")  # the selection reads it several times
    edges = exact_quantiles(df, [col], (1 / 3, 2 / 3))[col]
    return df.withColumn("band", sum((F.when(F.col(col) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)))


def validity(mt: Measurements, score: str, place: str) -> DataFrame:
    """n, n_bad (scores that are not finite), permutation (are the places 0..n-1) of each group."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    out = mt.rows.groupBy(*mt.groups).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.count_distinct(place).alias("d"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    return out.withColumn("permutation", (F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))


def check_scores(mt: Measurements, score: str) -> None:
    """Raise if any score is not finite: such a rule is refused, never sorted."""
    bad = mt.rows.where(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
    if not bad.isEmpty():
        raise ValueError(f"{score} is not finite everywhere")


def tiebreak(mt: Measurements) -> DataFrame:
    return mt.rows.withColumn("tb", F.row_number().over(mt.per_group(*mt.ids)) - 1)


def top_k(mt: Measurements, score: str, k: int) -> DataFrame:
    return mt.ranked(score).where(F.col("rn") <= k)


def regret_mean_at_k(mt: Measurements, score: str, ks: tuple[int, ...]) -> DataFrame:
    """Mean cost of the first k by score over that of the k cheapest."""
    both = mt.ranked(score, "a").withColumn("b", F.row_number().over(mt.per_group(mt.cost, *mt.ids))).where((F.col("a") <= max(ks)) | (F.col("b") <= max(ks)))
    t = F.col(mt.cost)
    means = both.groupBy(*mt.groups).agg(*[(F.avg(F.when(F.col("a") <= k, t)) / F.avg(F.when(F.col("b") <= k, t))).alias(str(k)) for k in ks])
    return means.unpivot(list(mt.groups), [str(k) for k in ks], "k", "regret").withColumn("k", F.col("k").cast("long"))


def hit_at_pct(mt: Measurements, score: str, pcts: tuple[int, ...]) -> DataFrame:
    """Share of groups whose first pct % by score (one at least) hold a best candidate, and an answer.

    A group's first best candidate and first answer by score are aggregates, and their places the counts of the
    candidates before them, so that no group is sorted. The rows and the groups' values are written once: Spark then
    knows how small the latter are before it joins, and moves no rows for a few groups.
    """
    t = F.col(mt.cost)
    mt = mt.of(written(mt.rows.select(*mt.groups, *mt.ids, mt.cost, score), "candidates"))
    sizes = written(mt.rows.groupBy(*mt.groups).agg(best_of(t).alias("best"), F.count("*").alias("n")), "sizes")
    rows = mt.rows.join(sizes, list(mt.groups)).withColumn("__at", F.struct(score, *mt.ids))
    good = F.col("best") * (1 + tolerance(F.col("best"), mt.noise))
    first = rows.groupBy(*mt.groups).agg(F.min(F.when(t == F.col("best"), F.col("__at"))).alias("__b"), F.min(F.when(t <= good, F.col("__at"))).alias("__a"))
    first = written(first, "firsts")
    before = rows.join(first, list(mt.groups)).groupBy(*mt.groups).agg(F.max("n").alias("n"), *[F.when(F.max(F.col(f"__{x}").isNotNull()), F.count_if(F.col("__at") < F.col(f"__{x}"))).alias(x) for x in "ab"])
    top = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100))
    inside = lambda p, x: F.avg(F.coalesce(F.col(x) < top(p), F.lit(False)).cast("int")).alias(f"{x}{p}")
    shares = before.agg(*[inside(p, x) for p in pcts for x in "ab"])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"b{p}").alias("hit_best"), F.col(f"a{p}").alias("hit_answer")) for p in pcts])).alias("x")).select("x.*")


def cheapest(mt: Measurements, n: int) -> DataFrame:
    return mt.ranked(mt.cost).where(F.col("rn") <= n)


def tau_pairs(top: DataFrame, groups: tuple[str, ...], score: str, cost: str) -> DataFrame:
    """Kendall's tau-b of score and cost over the pairs of a bounded top; null where either is constant."""
    a = top.select(*groups, F.col("rn").alias("ra"), F.col(score).alias("sa"), F.col(cost).alias("ta"))
    b = top.select(*groups, F.col("rn").alias("rb"), F.col(score).alias("sb"), F.col(cost).alias("tb"))
    ds, dt = F.signum(F.col("sa") - F.col("sb")), F.signum(F.col("ta") - F.col("tb"))
    pairs = a.join(b, list(groups)).where("ra < rb").groupBy(*groups).agg(F.count("*").alias("n"), F.sum(ds * dt).alias("c"), F.count_if(ds == 0).alias("ts"), F.count_if(dt == 0).alias("tt"))
    free = (F.col("n") - F.col("ts")).cast("double") * (F.col("n") - F.col("tt"))
    return pairs.select(*groups, F.when(free > 0, F.col("c") / F.sqrt(free)).alias("tau"))


def tau_top(mt: Measurements, score: str, n: int = 100) -> DataFrame:
    """tau over the n cheapest candidates, and their distinct costs: n(n-1)/2 pairs a group at most."""
    top = cheapest(mt, n)
    distinct = top.groupBy(*mt.groups).agg(F.count_distinct(mt.cost).alias("n_distinct"))
    return tau_pairs(top, mt.groups, score, mt.cost).join(distinct, list(mt.groups))


def noise_ranks(mt: Measurements, n: int = 100) -> DataFrame:
    """The n cheapest with a rank that rises only where the noise can tell a cost from the rank's first.

    A sweep over each group's ascending costs: an array of n values at most.
    """
    noise = mt.noise
    top = cheapest(mt, n).groupBy(*mt.groups).agg(F.sort_array(F.collect_list(F.struct("rn", mt.cost, *mt.ids))).alias("c"))

    def fl(t: Column) -> Column:
        return floor(t, noise)

    def step(a: Column, x: Column) -> Column:
        t, first = x[mt.cost], a["first"]
        apart = F.abs(t - first) > 2 * F.sqrt(F.pow(fl(t) * t, F.lit(2)) + F.pow(fl(first) * first, F.lit(2)))
        new = first.isNull() | apart
        level = F.when(first.isNull(), 0).when(apart, a["level"] + 1).otherwise(a["level"])
        return F.struct(F.when(new, t).otherwise(first).alias("first"), level.alias("level"), F.concat(a["levels"], F.array(level)).alias("levels"))

    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("levels"))
    swept = top.withColumn("levels", F.aggregate("c", start, step, lambda a: a["levels"]))
    return swept.select(*mt.groups, F.explode(F.arrays_zip("c", "levels")).alias("z")).select(*mt.groups, "z.c.*", F.col("z.levels").alias("noise_rank"))


def tau_noise(mt: Measurements, score: str, n: int = 100) -> DataFrame:
    """tau with the costs replaced by their noise ranks."""
    key = [*mt.groups, *mt.ids]
    ranks = noise_ranks(mt, n).select(*key, "rn", "noise_rank")
    return tau_pairs(ranks.join(mt.rows.select(*key, score), key), mt.groups, score, "noise_rank")


def top_span(mt: Measurements, n: int) -> DataFrame:
    t = F.col(mt.cost)
    return cheapest(mt, n).groupBy(*mt.groups).agg(F.count("*").alias("n"), (F.max(t) / F.min(t) - 1).alias("width"), F.count_distinct(t).alias("n_distinct"))


def axis_distance(mt: Measurements, axes: tuple[str, ...], places: int) -> DataFrame:
    """In how many axes the places 2..n by cost differ from the first."""
    top = cheapest(mt, places)
    first = top.where("rn = 1").select(*mt.groups, *[F.col(a).alias(f"{a}_1") for a in axes])
    apart = sum(((~F.col(a).eqNullSafe(F.col(f"{a}_1"))).cast("int") for a in axes), F.lit(0))
    return top.where("rn > 1").join(first, list(mt.groups)).select(*mt.groups, "rn", apart.alias("distance"))


def neighbours(mt: Measurements, summary: Column, n: int = 5) -> DataFrame:
    """The n cheapest candidates of different summary, with their distance from the best in noise floors."""
    rows = mt.with_best().withColumn("summary", summary)
    w = Window.partitionBy(*mt.groups, "summary").orderBy(mt.cost, *mt.ids)
    first = mt.of(rows.withColumn("dup", F.row_number().over(w)).where("dup = 1").drop("dup"))
    t, best = F.col(mt.cost), F.col("best")
    return cheapest(first, n).withColumn("sigma", (t - best) / best / floor(best, mt.noise))


def rank_ensemble(mt: Measurements, scores: tuple[str, ...]) -> DataFrame:
    """Lowest sum of dense ranks over several scores, and how many candidates tie at it."""
    total = sum((F.dense_rank().over(mt.per_group(s)) - 1 for s in scores), F.lit(0))
    sums = mt.rows.withColumn("total", total).groupBy(*mt.groups, "total").agg(F.count("*").alias("n"))
    return sums.groupBy(*mt.groups).agg(F.min("total").alias("total_rank"), F.min_by("n", "total").alias("n_tied")).withColumn("n_rules", F.lit(len(scores)))


def cascade(mt: Measurements, first: str, second: str, ks: tuple[int, ...]) -> DataFrame:
    """Take k by one score and the best of these by another: its regret, the k's best and mean, and the share of the gap that it closes."""
    rows = mt.of(mt.with_best()).ranked(first).where(F.col("rn") <= max(ks))
    t = F.col(mt.cost)
    each = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rn <= k")
    picks = each.groupBy(*mt.groups, "k").agg(F.min_by(t, F.struct(second, *mt.ids)).alias("t"), F.min(t).alias("lo"), F.avg(t).alias("mid"), F.first("best").alias("best"))
    best = F.col("best")
    out = picks.groupBy("k").agg(geomean(F.col("t") / best).alias("cascade"), geomean(F.col("lo") / best).alias("ceiling"), F.avg((F.col("lo") == best).cast("int")).alias("hit"), geomean(F.col("mid") / best).alias("floor"))
    return out.withColumn("closed", 1 - (F.col("cascade") - F.col("ceiling")) / (F.col("floor") - F.col("ceiling")))


def random_picks(mt: Measurements, draws: int) -> DataFrame:
    """For each draw the candidate whose MD5 with the draw's number is the least: no sort, one aggregation."""
    n = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    rows = mt.rows.select(*mt.groups, *mt.ids, mt.cost, n)
    order = F.struct(F.md5(F.concat_ws("|", *mt.ids, "draw")), *mt.ids)
    return rows.groupBy(*mt.groups, "draw").agg(F.min_by(mt.cost, order).alias("t"))


def random_floor(mt: Measurements, draws: int = 20) -> DataFrame:
    return random_picks(mt, draws).join(mt.bests(), list(mt.groups)).groupBy("draw").agg(geomean(F.col("t") / F.col("best")).alias("regret"))


def axis_sets(a: Measurements, b: Measurements, axes: tuple[str, ...]) -> DataFrame:
    """How many (group, axes) both tables have, and each alone."""
    key = [*a.groups, *axes]
    x, y = (m.rows.select(*key).distinct() for m in (a, b))
    parts = [("both", x.intersect(y)), ("a_only", x.subtract(y)), ("b_only", y.subtract(x))]
    out = None
    for name, df in parts:
        n = df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("class"), "n")
        out = n if out is None else out.unionByName(n)
    return out
