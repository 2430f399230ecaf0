"""Profiles of feature columns: ranges, quantiles, correlation, separation, drift."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.functions.features import Feature, expanded, with_features
from candrank.operators import order
from candrank.sources.shared import ROWS_A_TASK, dealt, written
from candrank.table import Measurements


def _long(row: DataFrame, names: list[str], parts: dict[str, str]) -> DataFrame:
    """One wide row of aggregates as a row for each name."""
    fields = lambda n: [F.col(f"{p}__{n}").alias(out) for out, p in parts.items()]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), *fields(n)) for n in names])).alias("x")).select("x.*")


def range_check(fm: DataFrame, features: list[Feature]) -> DataFrame:
    """feature, n_out, lo, hi: values outside the declared range, and the range seen; one pass for all."""
    cols = []
    for f in features:
        x = F.col(f.name)
        cols += [F.count_if((x < f.low - 1e-9) | (x > f.high + 1e-9)).alias(f"out__{f.name}"), F.min(x).alias(f"lo__{f.name}"), F.max(x).alias(f"hi__{f.name}")]
    return _long(fm.agg(*cols), [f.name for f in features], {"n_out": "out", "lo": "lo", "hi": "hi"})


def constant_check(fm: DataFrame, names: list[str]) -> DataFrame:
    out = _long(fm.agg(*[F.stddev_pop(n).alias(f"s__{n}") for n in names]), names, {"std": "s"})
    return out.withColumn("constant", F.col("std") < 1e-9)


def quantiles(fm: DataFrame, names: list[str], at: tuple[float, ...] = (0.0, 0.01, 0.5, 0.99, 1.0)) -> DataFrame:
    """feature, q, value: exact quantiles, linear between values."""
    found = order.exact_quantiles(written(fm.select(*names), "quantiles"), names, at)  # the selection reads it several times
    return fm.sparkSession.createDataFrame([(n, q, v) for n in names for q, v in zip(at, found[n])], "feature string, q double, value double")


def pair_correlations(fm: DataFrame, names: list[str], prefix: str = "") -> DataFrame:
    """a, b, rho of every pair, all in one aggregation."""
    pairs = list(combinations(names, 2))
    row = fm.agg(*[F.corr(prefix + a, prefix + b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def spearman(fm: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """Correlation of ordinal places, ties by key."""
    return pair_correlations(order.place_table(fm, names, key), names, "p_")


def duplicates(fm: DataFrame, names: list[str], key: list[str], rho: float = 0.95) -> DataFrame:
    """Pairs whose values and places correlate above rho (duplicate), or their places alone (monotone)."""
    both = pair_correlations(fm, names).join(spearman(fm, names, key).withColumnRenamed("rho", "rank_rho"), ["a", "b"])
    p, s = F.abs("rho") > rho, F.abs("rank_rho") > rho
    return both.where(s).withColumn("kind", F.when(p & s, "duplicate").otherwise("monotone"))


def rank_auc(mt: Measurements, answer: Column, names: list[str], edges: dict[str, list[float]] | None = None) -> DataFrame:
    """feature, auc, n: mean over groups of the area under the curve of a feature against the answers (large is bad), ties at mean places.

    Places are those of a group's different values, with their counts of answers and others; a large group is cut
    (by edges, approximate quantiles of the features, where they are known).
    """
    rows, groups, frames = mt.rows.withColumn("good", answer), list(mt.groups), []
    edges = edges or order.edges_of(rows, names)
    for n in names:
        counted = rows.groupBy(*groups, n).agg(F.count("*").alias("c"), F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
        placed = order.mid_ranks(counted, groups, n, "c", edges[n])
        per = placed.groupBy(*groups).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.sum(F.col("bad") * F.col("mid")).alias("sum_bad")).where("n_good > 0 AND n_bad > 0")
        frames.append(per.agg(F.avg((F.col("sum_bad") - F.col("n_bad") * (F.col("n_bad") + 1) / 2) / (F.col("n_good") * F.col("n_bad"))).alias("auc"), F.count("*").alias("n")).withColumn("feature", F.lit(n)))
    return reduce(lambda a, b: a.unionByName(b), frames).withColumn("against", F.col("auc") < 0.45)


def group_level(mt: Measurements, names: list[str]) -> DataFrame:
    """feature, level: group if it is constant inside every group."""
    per = mt.rows.groupBy(*mt.groups).agg(*[((F.max(n) - F.min(n)) <= 1e-12 * F.greatest(F.max(F.abs(n)), F.lit(1e-300))).alias(f"c__{n}") for n in names])
    out = _long(per.agg(*[F.every(f"c__{n}").alias(f"e__{n}") for n in names]), names, {"every": "e"})
    return out.select("feature", F.when(F.col("every"), "group").otherwise("candidate").alias("level"))


def scale_check(df: DataFrame, features: list[Feature], alternative: dict[str, float]) -> DataFrame:
    """feature, change, uses: the largest change under other parameters, and whether the expression names one; one pass."""
    both = with_features(df, features, strict=False)
    both = with_features(both.withColumns({k: F.lit(v) for k, v in alternative.items()}), features, strict=False, prefix="alt_")
    row = both.agg(*[F.max(F.abs(F.col(f.name) - F.col(f"alt_{f.name}"))).alias(f"d__{f.name}") for f in features])
    out = _long(row, [f.name for f in features], {"change": "d"})
    used = F.create_map(*[x for f in features for x in (F.lit(f.name), F.lit(any(k in expanded(f.sql) for k in alternative)))])
    return out.withColumn("uses", used[F.col("feature")])


def drift(fm: DataFrame, inside: Column, names: list[str]) -> DataFrame:
    """Spread of each feature inside and outside a population."""
    long = fm.withColumn("inside", inside).unpivot(["inside"], names, "feature", "value")
    return long.groupBy("feature", "inside").agg(F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("value").alias("n_distinct"), F.count("*").alias("n"))


def varying(groups: DataFrame, names: list[str]) -> DataFrame:
    """Group-level features with more than one value (12 digits), their distinct values and the smallest class."""
    classes = groups.select(*[F.round(n, 12).alias(n) for n in names]).unpivot([], names, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("c"))
    return classes.groupBy("feature").agg(F.count("*").alias("n_distinct"), F.min("c").alias("smallest")).where("n_distinct > 1")


def rank_libraries(libraries: DataFrame, ident: str) -> DataFrame:
    """Place by varying and covered (more is better), largest correlation (less is better), then identity."""
    rows = libraries.withColumns({"__varying": -F.col("varying"), "__covered": -F.col("covered")})
    return order.places(rows, ["__varying"], ["__covered", "rho", ident], "__p").withColumnRenamed("__p__varying", "place").select(*libraries.columns, "place")


def separability(mt: Measurements, names: list[str], n: int = 100) -> DataFrame:
    """Inside the n cheapest of each group: median of a feature's distinct values and variation, and groups where it is constant."""
    top = mt.ranked(mt.cost).where(F.col("rn") <= n)
    long = top.unpivot(list(mt.groups), names, "feature", "value")
    per = long.groupBy(*mt.groups, "feature").agg(F.count_distinct("value").alias("d"), (F.stddev_pop("value") / F.when(F.avg(F.abs("value")) > 0, F.avg(F.abs("value")))).alias("cv"))
    return per.groupBy("feature").agg(C.median(F.col("d").cast("double")).alias("n_distinct"), C.median(F.col("cv")).alias("cv"), F.count_if(F.col("d") == 1).alias("constant_groups"))


# The least mean rank correlation of a time-like axis, and the shares of slices from which a field is judged and fails.
RANK_LEAST, INTERIOR_LEAST, INTERIOR_SHARE, END_SHARE = 0.3, 3, 0.25, 0.5


def _cells(mt: Measurements, axis: str, fields: tuple[str, ...], *more: Column) -> DataFrame:
    """A row for each combination of the fields' values in each group, with what the gate asks of the candidates that have it."""
    t, a, ids = F.col(mt.cost), F.col(axis), mt.ids
    return mt.rows.groupBy(*mt.groups, *fields).agg(
        F.every(C.finite(a)).alias("__sound"), F.min(t).alias("__t"), F.min(a).alias("__a"), F.min(F.struct(t, *ids)).alias("__first"), F.min(F.struct(a, *ids, t.alias("__t"))).alias("__pick"), *more
    )


def _gates(cells: DataFrame, groups: list[str], fields: tuple[str, ...], *more: Column) -> DataFrame:
    """A row for each group: its pick's regret and each field's slice, from cells with __best, the fields of the group's cheapest candidate."""
    parts = [F.every("__sound").alias("sound"), (F.min("__pick").getField("__t") / F.min("__t")).alias("pick"), *more]
    for i, f in enumerate(fields):
        held = reduce(lambda p, q: p & q, [F.col(x) == F.col(f"__best.{x}") for x in fields if x != f], F.lit(True))
        x, a = F.when(held, F.col(f)), F.when(held, F.col("__a"))
        lowest = lambda by: F.min_by(f, F.when(held, F.struct(by, f)))  # noqa: B023, E731
        along = {"v": F.count_if(held), "lo": F.min(x), "hi": F.max(x), "moves": F.min(a) < F.max(a), "at": lowest("__t"), "axis_at": lowest("__a")}
        parts.append(F.struct(*[c.alias(n) for n, c in along.items()]).alias(f"__s{i}"))
    return cells.groupBy(*groups).agg(*parts)


def slice_gate(mt: Measurements, axis: str, fields: tuple[str, ...]) -> DataFrame:
    """Does an axis behave like the cost: a row for each field, and what holds for all beside it.

    Slices go through the groups' cheapest candidates along the field, the others held: n slices of three values
    or more along which the axis moves; interior: the cost is lowest inside the range; end_miss: there the axis
    is lowest at an end; one_way: enough slices are interior, and the axis misses more than half of these.
    n_groups, rank (mean over groups of the rank correlation of axis and cost, ties at mean places) and pick_gm
    (geometric mean regret of the candidate with the lowest axis) are of the groups whose axis is finite
    everywhere. verdict names what fails, rank and fields, and is null where nothing does.

    The rows are dealt by group once, and all is found where they are then. Groups of over ROWS_A_TASK rows stay
    out of that: they move as cells of the fields' values, and their places are taken from buckets.
    """
    t, groups, sums = mt.cost, list(mt.groups), ("n", "xy", "xx", "yy")
    named = reduce(lambda p, q: p & q, [F.col(g).isNotNull() for g in groups])
    rows = mt.rows.select(*dict.fromkeys([*groups, *mt.ids, t, axis, *fields])).where(named)
    large, n = order.large_parts(rows, groups, ROWS_A_TASK)
    few = dealt(rows if large is None else rows.join(F.broadcast(large), groups, "left_anti"), groups, n)
    few = few.withColumn("__both", F.col(axis).isNotNull() & F.col(t).isNotNull())
    x, y = [F.when(F.col("__both"), F.col(p)) for p in ("__x", "__y")]
    placed = few.withColumn("__x", order.mean_place([*groups, "__both"], axis)).withColumn("__y", order.mean_place([*groups, "__both"], t))
    cells = _cells(mt.of(placed), axis, fields, F.count_if("__both").alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    cells = cells.withColumn("__best", F.min_by(F.struct(*fields), "__first").over(Window.partitionBy(*groups)))
    gates = _gates(cells, groups, fields, order.rho(*[F.sum(s) for s in sums]).alias("rho"))
    if large is not None:  # rows / ROWS_A_TASK groups at most
        many = mt.of(rows.join(F.broadcast(large), groups, "left_semi"))
        cells = _cells(many, axis, fields)
        best = cells.groupBy(*groups).agg(F.min_by(F.struct(*fields), "__first").alias("__best"))
        found = _gates(cells.join(F.broadcast(best), groups), groups, fields)
        gates = gates.unionByName(found.join(order.rank_correlation(many.rows, groups, axis, t).drop("n"), groups, "left"))
    parts = [F.avg("rho").alias("rank"), C.geomean(F.col("pick")).alias("pick_gm"), F.count("*").alias("n_groups")]
    for i, f in enumerate(fields):
        at, axis_at, lo, hi = [F.col(f"__s{i}.{c}") for c in ("at", "axis_at", "lo", "hi")]
        judged = (F.col(f"__s{i}.v") >= 3) & F.col(f"__s{i}.moves")
        inner, end = judged & (at != lo) & (at != hi), (axis_at == lo) | (axis_at == hi)
        per = {"n": judged, "interior": inner, "end_miss": inner & end, "hit": judged & (at == axis_at)}
        parts.append(F.struct(*[F.count_if(c).alias(name) for name, c in per.items()], F.lit(f).alias("field")).alias(f"__s{i}"))
    every = gates.where("sound").agg(*parts)  # one row
    enough = lambda s: s["interior"] >= F.greatest(F.lit(INTERIOR_LEAST), INTERIOR_SHARE * s["n"])
    slices = F.array(*[F.col(f"__s{i}") for i in range(len(fields))])
    every = every.withColumn("x", F.transform(slices, lambda s: s.withField("one_way", enough(s) & (s["end_miss"] > END_SHARE * s["interior"]))))
    ways = F.array_sort(F.transform(F.filter("x", lambda s: s["one_way"]), lambda s: s["field"]))
    low = F.when(F.coalesce(F.col("rank") < RANK_LEAST, F.lit(True)), F.array(F.lit("rank"))).otherwise(F.array().cast("array<string>"))
    every = every.withColumn("verdict", F.nullif(F.array_join(F.concat(low, ways), ","), F.lit("")))
    return every.select(F.explode("x").alias("x"), "rank", "pick_gm", "n_groups", "verdict").select("x.*", "rank", "pick_gm", "n_groups", "verdict")
