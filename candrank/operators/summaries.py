"""Further summaries of measurements and evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators import order
from candrank.operators.rank import cheapest
from candrank.sources.shared import written
from candrank.table import Measurements


def regime_split(ev: DataFrame, regimes: DataFrame, key: list[str]) -> DataFrame:
    """k, mem, comp, n_mem: the geometric means of regret on both sides of the knee; null where all groups are on one side."""
    mem = F.col("regime") == "mem"
    both = (F.count_if(mem) > 0) & (F.count_if(~mem) > 0)
    geo = lambda c: F.when(both, C.geomean(F.when(c, F.col("regret"))))
    return ev.join(regimes, key).groupBy("k").agg(geo(mem).alias("mem"), geo(~mem).alias("comp"), F.when(both, F.count_if(mem)).alias("n_mem"))


def by_regime(ev: DataFrame, roles: DataFrame, regimes: DataFrame, key: list[str]) -> DataFrame:
    """Geometric mean of regret by role and regime, and by role (regime null)."""
    rows = ev.join(roles, key).join(regimes, key)
    return rows.rollup("role", "regime").agg(C.geomean(F.col("regret")).alias("geo"), F.count("*").alias("n")).where(F.col("role").isNotNull())


def degeneracy(picks: DataFrame, static: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct picks over groups, count of the commonest, and picks that equal the static one."""
    counts = picks.groupBy(*ids).agg(F.count("*").alias("c"))
    same = picks.join(static.select(*ids), ids, "left_semi").agg(F.count("*").alias("n_static"))
    return counts.agg(F.count("*").alias("n_distinct"), F.max("c").alias("n_mode"), F.sum("c").alias("n")).crossJoin(same)


def table_axes(mt: Measurements, k: int) -> DataFrame:
    """Quartiles of the number of candidates that the noise cannot tell from the best, and median of the k-th cost over the best."""
    t = F.col(mt.cost)
    near = mt.with_best().groupBy(*mt.groups).agg(F.count_if(~C.resolvable(t, F.col("best"), mt.noise)).alias("near"))
    kth = mt.ranked(mt.cost).where(F.col("rn") == k).join(mt.bests(), list(mt.groups)).select(*mt.groups, (t / F.col("best")).alias("kth"))
    rows = written(near.join(kth, list(mt.groups), "left"), "axes")  # a row for each group, of which several jobs find the quantiles
    found = order.exact_quantiles(rows, ["near", "kth"], (0.25, 0.5, 0.75))
    return mt.rows.sparkSession.createDataFrame([(*found["near"], found["kth"][1])], "q1 double, q2 double, q3 double, kth double")


def search_space(mt: Measurements, axes: tuple[str, ...], keep: Column, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Values of each axis, the size of their product, the shares of it that exist and are kept, and the groups in which one of the fixed axes is free (has two values)."""
    n = mt.rows.agg(*[F.count_distinct(a).alias(f"n_{a}") for a in axes], F.count_distinct(*axes).alias("valid"), F.avg(keep.cast("int")).alias("kept"))
    size = reduce(lambda p, a: p * F.col(f"n_{a}"), axes, F.lit(1).cast("double"))
    varies = reduce(lambda p, a: p | (F.min(a) < F.max(a)), fixed, F.lit(False))
    free = mt.rows.groupBy(*mt.groups).agg(varies.alias("free")).agg(F.count_if("free").alias("free_groups"))
    return n.crossJoin(free).withColumn("product", size).withColumn("valid_share", F.col("valid") / F.col("product"))


def measure_cost(mt: Measurements, kernel: str, reps: int, least_warmup: int, warmup: float, build_seconds: float) -> DataFrame:
    """Seconds to measure all candidates, and to build each distinct kernel once."""
    times = reps + max(least_warmup, warmup * reps)
    measured = mt.rows.agg(F.sum(F.col(mt.cost) * times / 1000).alias("measure_s"), F.count("*").alias("n"), F.count_distinct(kernel).alias("kernels"))
    return measured.withColumn("build_s", F.col("kernels") * build_seconds)


def cost_by_sample(mt: Measurements, kernel: str, counts: tuple[int, ...], draws: int, seconds: float, build_seconds: float) -> DataFrame:
    """n, median, lo, hi: seconds for n sampled groups, over draws; kernels of the sample are built once."""
    group = mt.groups[0]
    groups = mt.rows.select(group).distinct().crossJoin(F.broadcast(mt.rows.sparkSession.range(draws).toDF("draw")))
    top = max(counts)
    w = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.col(group).cast("string"), "draw")), group)
    ranked = groups.withColumn("at", F.row_number().over(w) - 1).where(F.col("at") < top)  # only these pass the shuffle
    each = ranked.withColumn("n", F.explode(F.array(*[F.lit(c) for c in counts]))).where("at < n")
    rows = mt.rows.select(group, kernel, mt.cost).join(each, group)
    cost = rows.groupBy("n", "draw").agg((F.sum(mt.cost) * seconds + F.count_distinct(kernel) * build_seconds).alias("s"))
    return cost.groupBy("n").agg(C.median(F.col("s")).alias("median"), F.min("s").alias("lo"), F.max("s").alias("hi"))


def throughput_metrics(ev: DataFrame) -> DataFrame:
    return ev.agg(F.avg(1 - 1 / F.col("regret")).alias("loss"), F.avg((F.col("regret") <= 1.05).cast("int")).alias("within5"))


def pick_ledger(mt: Measurements, score: str) -> DataFrame:
    """The pick of each group, its regret, and how many candidates tie at the lowest score."""
    t = mt.cost
    low = mt.rows.groupBy(*mt.groups).agg(F.min(score).alias("low"), F.min_by(F.struct(*mt.ids, t), F.struct(score, *mt.ids)).alias("pick"), C.best_of(F.col(t)).alias("best"))
    tied = mt.rows.join(low.select(*mt.groups, "low"), list(mt.groups)).where(F.col(score) == F.col("low")).groupBy(*mt.groups).agg(F.count("*").alias("n_tied"))
    return low.join(tied, list(mt.groups)).select(*mt.groups, "pick.*", "best", (F.col(f"pick.{t}") / F.col("best")).alias("regret"), "n_tied")


def diagnostic_cases(mt: Measurements, score: str, axes: tuple[str, ...], n_worst: int, n_best: int) -> DataFrame:
    """Groups of the largest and least regret, with different pairs of pick and optimum, and the gap in noise floors.

    The optimum of tied bests is the first by identity.
    """
    t = mt.cost
    both = mt.rows.groupBy(*mt.groups).agg(
        F.min_by(F.struct(*axes, t), F.struct(score, *mt.ids)).alias("pick"), F.min_by(F.struct(*axes, t), F.struct(F.when(C.usable(F.col(t)), F.col(t)), *mt.ids)).alias("opt"), C.best_of(F.col(t)).alias("best")
    )
    rows = both.withColumns({"regret": F.col(f"pick.{t}") / F.col("best"), "sigma": (F.col(f"pick.{t}") - F.col("best")) / F.col("best") / C.floor(F.col("best"), mt.noise)})
    kinds = []
    for name, n, sign in (("worst", n_worst, -1), ("best", n_best, 1)):
        order = F.struct((F.round("regret", 9) * sign).alias("r"), *mt.groups)
        first = rows.groupBy(F.struct(*[f"pick.{a}" for a in axes]).alias("p"), F.struct(*[f"opt.{a}" for a in axes]).alias("o")).agg(F.min_by(F.struct(*rows.columns), order).alias("x")).select("x.*")
        kinds.append(first.orderBy(F.round("regret", 9) * sign, *mt.groups).limit(n).withColumn("kind", F.lit(name)))
    return kinds[0].unionByName(kinds[1])


def axis_bias(cases: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """For each axis over cases with regret: picks below, above and different from the optimum, and the median difference."""
    lost = cases.where("regret > 1")
    frames = []
    for a in axes:
        p, o = F.col(f"pick.{a}"), F.col(f"opt.{a}")
        frames.append(lost.agg(F.lit(a).alias("axis"), F.count_if(p < o).alias("below"), F.count_if(p > o).alias("above"), F.count_if(p != o).alias("differs"), C.median((p - o).cast("double")).alias("median_gap")))
    return reduce(lambda x, y: x.unionByName(y), frames)


def feature_gaps(cases: DataFrame, groups: list[str], features: list[str], used: list[str], n: int = 8) -> DataFrame:
    """For each case the features that differ most between pick and optimum, relative to the optimum's."""
    gaps = F.array(*[F.struct((-F.round(F.abs(F.col(f"pick.{f}") - F.col(f"opt.{f}")) / (F.abs(F.col(f"opt.{f}")) + 1e-9), 9)).alias("minus"), F.lit(f).alias("feature"), F.lit(f in used).alias("used")) for f in features])
    return cases.select(*groups, F.explode(F.slice(F.array_sort(gaps), 1, n)).alias("x")).select(*groups, "x.feature", (-F.col("x.minus")).alias("gap"), "x.used")


def table_facts(stats: DataFrame, static_regrets: DataFrame, ks: tuple[int, ...] = (1, 3, 8), least: int = 15) -> DataFrame:
    """Statements about a table, from the statistics of its training groups and the static choices made on them, with how many groups they rest on.

    Groups with several candidates that the noise cannot tell from the best, the median (rounded down) and the
    largest number of these, and the regret of the first ks static choices. Those of too few groups are withheld,
    but counted.
    """
    stats = written(stats.select("n_answers"), "answers")
    mid = order.exact_median(stats, "n_answers")
    n = F.count("*")
    facts = stats.agg(n.alias("support"), F.count_if(F.col("n_answers") > 1).cast("double").alias("no_single"), F.lit(None if mid is None else float(int(mid))).alias("tie_median"), F.max("n_answers").cast("double").alias("tie_max"))
    long = facts.unpivot(["support"], ["no_single", "tie_median", "tie_max"], "fact", "value")
    static = static_regrets.where(F.col("k").isin(*ks)).crossJoin(F.broadcast(facts.select("support"))).select("support", F.concat(F.lit("static_top"), "k").alias("fact"), F.col("geo").alias("value"))
    every = long.unionByName(static).withColumn("withheld", F.col("support") < least)
    return every.withColumn("value", F.when(~F.col("withheld"), F.col("value")))


def top_places(mt: Measurements, n: int) -> DataFrame:
    return cheapest(mt, n)
