"""Analytics over run logs and evaluations of many runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators.order import exact_median, values_at
from candrank.sources.shared import written


def cumulative_best(runs: DataFrame, last_round: Column | None = None) -> DataFrame:
    """run, round, best: the least regret so far at every round up to the table's last; a run that ended early keeps its last value."""
    top = runs.agg(F.max("round").alias("top"))
    starts = runs.groupBy("run").agg(F.min("round").alias("lo")).crossJoin(F.broadcast(top))
    grid = starts.select("run", F.explode(F.sequence("lo", last_round if last_round is not None else F.col("top"))).alias("round"))
    per_round = runs.groupBy("run", "round").agg(F.min("regret").alias("regret"))
    w = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(per_round, ["run", "round"], "left").select("run", "round", F.min("regret").over(w).alias("best"))


def plateau(curve: DataFrame, sigma: float) -> DataFrame:
    """First round from which the median curve stays within sigma of its final value."""
    mid = curve.groupBy("round").agg(C.median(F.col("best")).alias("value"))
    final = mid.agg(F.max_by("value", "round").alias("final"))
    off = mid.crossJoin(F.broadcast(final)).withColumn("off", F.round(F.abs(F.col("value") - F.col("final")), 9) > sigma)
    last = off.agg(F.max(F.when(F.col("off"), F.col("round"))).alias("last"), F.min("round").alias("lo"), F.first("final").alias("final"))
    return last.select(F.coalesce(F.col("last") + 1, F.col("lo")).alias("round"), "final")


def simulate_stop(curve: DataFrame, patiences: tuple[int, ...], threshold: float) -> DataFrame:
    """run, patience, stop, missed: where a run would have stopped, and the improvement after that.

    curve has run, place (0, 1, ...), best, cells. A run stops at the end of the first round in whose last n
    rounds neither the best moved by more than the threshold nor a new cell appeared.
    """
    w = Window.partitionBy("run").orderBy("place")
    new = curve.withColumn("new", F.coalesce((F.col("cells") > F.lag("cells").over(w)).cast("int"), F.lit(0)))
    rows = new
    for n in patiences:
        quiet = F.max("new").over(w.rowsBetween(-(n - 1), 0)) == 0
        moved = F.round(F.abs(F.lag("best", n).over(w) - F.col("best")), 9)
        rows = rows.withColumn(f"stop{n}", F.when((F.col("place") >= n) & quiet & (moved <= threshold), F.col("place")))
    final = rows.groupBy("run").agg(*[F.min(f"stop{n}").alias(f"stop{n}") for n in patiences], F.min_by("best", -F.col("place")).alias("final"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("patience"), F.col(f"stop{n}").alias("stop")) for n in patiences])).alias("x")
    stops = final.select("run", "final", each).select("run", "final", "x.patience", "x.stop")
    there = curve.select(F.col("run").alias("of"), F.col("place").alias("at"), F.col("best").alias("then"))
    return stops.join(there, (F.col("run") == F.col("of")) & (F.col("stop") == F.col("at")), "left").select("run", "patience", "stop", (F.col("then") - F.col("final")).alias("missed"))


def improvements(curve: DataFrame, threshold: float) -> DataFrame:
    """Last round with any improvement, with one above the threshold, and with a new cell."""
    w = Window.partitionBy("run").orderBy("place")
    gain = F.round(F.lag("best").over(w) - F.col("best"), 9)
    rows = curve.withColumns({"gain": gain, "grew": F.col("cells") > F.lag("cells").over(w)})
    last = lambda c: F.max(F.when(c, F.col("place")))
    return rows.groupBy("run").agg(last(F.col("gain") > 0).alias("last_any"), last(F.col("gain") > threshold).alias("last_significant"), last(F.col("grew")).alias("last_cell"))


def median_of_runs(ev: DataFrame, key: list[str]) -> DataFrame:
    """Geometric mean of the groups' medians over runs, and median of the runs' geometric means."""
    ev = written(ev, "picks")  # read twice
    per_group = ev.groupBy(*key).agg(C.median(F.col("regret")).alias("m")).agg(C.geomean(F.col("m")).alias("geo_of_medians"))
    per_run = written(ev.groupBy("run").agg(C.geomean(F.col("regret")).alias("m")), "runs")
    return per_group.crossJoin(per_run.agg(F.lit(exact_median(per_run, "m")).alias("median_of_geos"), F.count("*").alias("n_runs")))


def pooled(runs: DataFrame, weight: str) -> DataFrame:
    """For each seed the geometric mean over folds weighted by their size, the median fold, and how many folds there are and are at the best, one, or below."""
    n = F.col(weight)
    return runs.groupBy("seed").agg(F.exp(F.sum(n * F.log("regret")) / F.sum(n)).alias("pooled"), F.count("*").alias("folds"), F.count_if(F.col("regret") <= 1).alias("at_best"), C.median(F.col("regret")).alias("median"))


def spread(runs: DataFrame) -> DataFrame:
    """For each table: the median range over seeds in a fold, the spread of the folds' medians, their ratio, and the correlation of size and regret."""
    folds = runs.groupBy("table", "fold").agg((F.max("regret") - F.min("regret")).alias("range"), C.median(F.col("regret")).alias("mid"), F.avg("size").alias("size"))
    out = folds.groupBy("table").agg(C.median(F.col("range")).alias("seed_range"), (F.max("mid") - F.min("mid")).alias("fold_spread"), F.corr("size", "mid").alias("size_corr"))
    return out.withColumn("ratio", F.col("fold_spread") / F.col("seed_range"))


def variance_split(runs: DataFrame, value: str = "regret") -> DataFrame:
    """Pooled variance within campaigns, the component between them (not below 0), and the smallest gap that n runs can show."""
    per = runs.groupBy("campaign").agg(F.count("*").alias("n"), F.var_samp(value).alias("v"), F.avg(value).alias("m")).where("n > 1")
    out = per.agg((F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("within"), F.var_samp("m").alias("means"), F.avg("n").alias("n"))
    out = out.withColumn("between", F.greatest(F.lit(0.0), F.col("means") - F.col("within") / F.col("n")))
    return out.withColumn("line", 2.8016 * F.sqrt("within") * F.sqrt(2 / F.col("n")))


def condition_report(runs: DataFrame, keys: tuple[str, ...], defaults: dict[str, str]) -> DataFrame:
    """key, values (distinct, joined), mixed; null settings of old runs take the defaults."""
    filled = runs.select(*[F.coalesce(F.col(k).cast("string"), F.lit(defaults.get(k))).alias(k) for k in keys])
    long = filled.unpivot([], list(keys), "key", "value").distinct()
    out = long.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("values"), F.count("value").alias("n"))
    return out.withColumn("mixed", F.col("n") > 1)


def assert_same_condition(runs: DataFrame, keys: tuple[str, ...], defaults: dict[str, str]) -> None:
    mixed = [r.key for r in condition_report(runs, keys, defaults).where("mixed").collect()]  # one row for each key
    if mixed:
        raise ValueError(f"the runs mix conditions: {mixed}")


def elite_grid(rules: DataFrame, axes: tuple[str, ...], key: str, ident: str, top: float = 0.30, bands: int = 3) -> DataFrame:
    """Best rule of each cell of a grid of quantile bands, among the rules up to the key's cut; best marks the best of all.

    The cut is the key at place max(1, floor(top n)) in ascending order; an axis' edges are its values at
    places min(n-1, floor(n q / bands)) from 0. All rules are taken at once.
    """
    at = max(1, math.floor(rules.where(F.col(key).isNotNull()).count() * top)) - 1
    cut = values_at(rules, {key: [at]})[key].get(at)
    cells = rules.where(F.col(key) <= F.lit(cut))
    n = cells.count()
    places = {q: min(n - 1, math.floor(n * q / bands)) for q in range(1, bands)}
    found = values_at(cells, {a: list(places.values()) for a in axes})
    for a in axes:
        cells = cells.withColumn(f"band_{a}", C.band(F.col(a), [F.lit(found[a].get(p)) for p in places.values()]))
    own = [f"band_{a}" for a in axes]
    best = cells.groupBy(*own).agg(F.min(F.struct(key, ident)).alias("b"), F.count("*").alias("n"))
    lowest = best.agg(F.min("b").alias("lowest"))
    return best.crossJoin(F.broadcast(lowest)).select(*own, F.col(f"b.{ident}").alias(ident), F.col(f"b.{key}").alias(key), "n", (F.col("b") == F.col("lowest")).alias("best"))


def duplicate_rate(log: DataFrame, run: str, kind: str, text: str) -> DataFrame:
    """Proposals, distinct ones, the duplicates' share, and the most repeated text with its count (ties: the least), by run and kind, and by run (kind null)."""
    counts = log.where(F.col(run).isNotNull()).groupBy(run, kind, text).agg(F.count("*").alias("c"))
    whole = counts.groupBy(run, text).agg(F.sum("c").alias("c")).withColumn(kind, F.lit(None).cast(dict(log.dtypes)[kind]))
    most = F.struct(-F.col("c"), F.col(text))
    frames = [x.groupBy(run, kind).agg(F.sum("c").alias("n"), F.count(text).alias("distinct"), F.min_by(text, most).alias("top_text"), F.max("c").alias("top_n")) for x in (counts, whole)]
    return frames[0].unionByName(frames[1]).withColumn("rate", 1 - F.col("distinct") / F.col("n"))


def rejections(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"))


def verdicts(children: DataFrame, parents: DataFrame, on: str, tol: float, before: str | None = None) -> DataFrame:
    """children with parent (the best of their own), and the verdict better_not_kept, tie (within tol) or made_worse against it.

    before is a column of the children: the best of all at the time. A child without parents is judged against
    that, or is no_parent where there is none; by_best has what the older rule says, which compares with it
    alone, without a tolerance: made_worse or no_effect.
    """
    best = parents.groupBy(on).agg(F.min("regret").alias("parent"))
    rows = children.join(best, on, "left")
    ref = F.coalesce(F.col("parent"), F.col(before)) if before else F.col("parent")
    gap = F.round(F.col("regret") - ref, 9)
    rows = rows.withColumn("verdict", F.when(ref.isNull(), "no_parent").when(F.abs(gap) < tol, "tie").when(gap > 0, "made_worse").otherwise("better_not_kept"))
    return rows.withColumn("by_best", F.when(F.col("regret") > F.col(before), "made_worse").otherwise("no_effect")) if before else rows


def round_profile(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    per = events.groupBy(stage).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))
    return per.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))


def run_summary(runs: DataFrame, arm: str, size: str | None = None, tied: str | None = None) -> DataFrame:
    """For each arm: runs, geometric mean and median of the runs' best, runs at or below 1.05, minutes.

    size is how many groups a round's regret is over: pooled is the geometric mean of all rounds weighted by it.
    tied is how many of these tie at the lowest score: tied_share is the mean over runs of their share.
    """
    cols = [F.min("regret").alias("best"), F.sum("seconds").alias("seconds")]
    if size:
        cols += [F.sum(size).alias("size"), F.sum(F.col(size) * F.log("regret")).alias("logs")]
    if tied:
        cols.append((F.sum(tied) / F.sum(size)).alias("tied"))
    per_run = runs.groupBy(arm, "run").agg(*cols)
    out = [F.count("*").alias("n"), C.geomean(F.col("best")).alias("geo"), C.median(F.col("best")).alias("median"), F.count_if(F.round("best", 9) <= 1.05).alias("hits"), (F.sum("seconds") / 60).alias("minutes")]
    if size:
        out.append(F.exp(F.sum("logs") / F.sum("size")).alias("pooled"))
    if tied:
        out.append(F.avg("tied").alias("tied_share"))
    return per_run.groupBy(arm).agg(*out)


def crossing(curve: DataFrame, target: float, by: list[str]) -> DataFrame:
    """First k whose value is at or below the target, and k interpolated on a log scale from the point before."""
    w = Window.partitionBy(*by).orderBy("k")
    rows = curve.withColumns({"k0": F.lag("k").over(w), "v0": F.lag("value").over(w)})
    at = rows.where(F.col("value") <= target).groupBy(*by).agg(F.min(F.struct("k", "value", "k0", "v0")).alias("x")).select(*by, "x.*")
    share = F.when(F.col("v0") == F.col("value"), 1.0).otherwise((F.col("v0") - target) / (F.col("v0") - F.col("value")))
    interp = F.when(F.col("k0").isNull(), F.col("k").cast("double")).otherwise(F.exp(F.log("k0") + share * (F.log("k") - F.log("k0"))))
    all_ = curve.select(*by).distinct()
    return all_.join(at.withColumn("k_interp", interp).select(*by, "k", "k_interp"), by, "left").withColumn("reached", F.col("k").isNotNull())


def porting_curve(runs: DataFrame, natives: DataFrame, arm: str) -> DataFrame:
    """For each arm and round the best so far beside the native value, the first round at or below it, and the share of the first gap recovered."""
    w = Window.partitionBy(arm).orderBy("round")
    best = runs.groupBy(arm, "round").agg(F.min("regret").alias("regret")).withColumn("best", F.min("regret").over(w)).join(natives, arm)
    start = F.first("best").over(w)
    reached = F.min(F.when(F.col("best") <= F.col("native"), F.col("round"))).over(Window.partitionBy(arm))
    return best.withColumns({"reached": reached, "recovered": F.when(start > F.col("native"), (start - F.col("best")) / (start - F.col("native")))})
