"""Summaries and comparisons of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators.order import exact_median
from candrank.sources.shared import written

STRATA = ("all", "large", "small", "hard", "easy")


def with_strata(stats: DataFrame) -> DataFrame:
    """stats with hard: a difficulty above the median of the groups. stats is written once, as the median is found by selection."""
    stats = written(stats, "stats")
    return stats.withColumn("hard", F.col("difficulty") > F.lit(exact_median(stats, "difficulty")))


def stratified(ev: DataFrame, stats: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """For each k the geometric mean of regret over all groups and each stratum, counts, hit rate and gaps."""
    joined = ev.join(with_strata(stats).select(*groups, "small", "hard"), list(groups))
    conditions = {"all": F.lit(True), "large": ~F.col("small"), "small": F.col("small"), "hard": F.col("hard"), "easy": ~F.col("hard")}
    out = joined.groupBy("k").agg(
        *[C.geomean(F.when(conditions[s], F.col("regret"))).alias(f"regret_{s}") for s in STRATA], F.count_if("small").alias("n_small"), F.count("*").alias("n_groups"), F.avg(F.col("hit").cast("int")).alias("hit_rate")
    )
    return out.withColumns({"size_gap": F.col("regret_small") - F.col("regret_large"), "difficulty_gap": F.col("regret_hard") - F.col("regret_easy")})


def paired(a: DataFrame, b: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The same groups of two evaluations side by side (ra, rb); a group that only one has is an error when it is read."""
    both = a.select(*on, F.col("regret").alias("ra"), F.col("tol")).join(b.select(*on, F.col("regret").alias("rb")), list(on), "full")
    one_sided = F.col("ra").isNull() | F.col("rb").isNull()
    return both.withColumn("rb", F.when(one_sided, F.raise_error(F.lit("the evaluations have different groups")).cast("double")).otherwise(F.col("rb")))


def compare(a: DataFrame, b: DataFrame, stats: DataFrame, groups: tuple[str, ...], k: int = 1, k_sigma: float = 2.0) -> DataFrame:
    """Wins, losses and ties of a against b in noise floors, geometric means, largest gain and loss."""
    d = paired(a.where(F.col("k") == k), b.where(F.col("k") == k), groups).join(stats.select(*groups, "floor"), list(groups))
    d = d.withColumn("delta", F.col("ra") - F.col("rb")).withColumn("sigma", F.when(F.col("floor") > 0, F.col("delta") / F.col("floor")).otherwise(0.0))
    key = F.struct(*groups)
    lowest, highest = F.struct(F.col("delta"), key), F.struct(-F.col("delta"), key)
    return d.agg(
        C.geomean(F.col("ra")).alias("geo_a"), C.geomean(F.col("rb")).alias("geo_b"), F.count_if(F.col("sigma") < -k_sigma).alias("wins"), F.count_if(F.col("sigma") > k_sigma).alias("losses"),
        F.count_if(F.abs("sigma") <= k_sigma).alias("ties"), F.min("delta").alias("best_gain"), F.max("delta").alias("worst_loss"), F.count_if(F.col("delta") > 0.05).alias("n_large_loss"),
        F.min_by(groups[0], lowest).alias("gain_group"), F.min_by(groups[0], highest).alias("loss_group"),
    )


def significant(a: DataFrame, b: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """delta of the geometric means, the threshold that the tolerances give, and whether it is passed; unknown is not significant."""
    out = paired(a, b, groups).agg((C.geomean(F.col("ra")) - C.geomean(F.col("rb"))).alias("delta"), C.geomean(F.col("tol")).alias("threshold"), F.every(C.finite(F.col("tol"))).alias("known"))
    return out.withColumn("significant", F.coalesce(F.col("known") & (F.abs("delta") > F.col("threshold")), F.lit(False)))


def outcome_counts(a: Column, b: Column, tie: float) -> list[Column]:
    return [F.count_if(a < b - tie).alias("wins"), F.count_if(a > b + tie).alias("losses"), F.count_if(F.abs(a - b) <= tie).alias("ties")]


def sign_test(a: DataFrame, b: DataFrame, on: tuple[str, ...], tie: float = 1e-9) -> DataFrame:
    counts = paired(a, b, on).agg(*outcome_counts(F.col("ra"), F.col("rb"), tie))
    return counts.withColumn("p", C.sign_test(F.col("wins"), F.col("losses")))
