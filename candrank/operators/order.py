"""Places and order statistics without a task that sorts everything.

Rows fall into buckets between approximate quantiles; a place is one inside the bucket and the bucket's
offset, and an order statistic needs the rows of its bucket only. The quantiles decide how even the buckets
are, never the result.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.sources.shared import ROWS_A_TASK, written

PARTS = 64  # buckets at least
BUCKET_ROWS = 500_000  # more rows give more buckets, up to MOST_PARTS
MOST_PARTS = 4096
KEY_PARTS = 16  # a bucket of one value is cut by the key into so many
HEX = 3  # digits of an MD5 that make a bucket of a seeded order
HASHES = 1 << 16  # hashes by which rows are counted before parts are


def draw(key: list[str], *seed: object) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], *[s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in seed]))


def seeded_places(rows: DataFrame, part: list[str], key: list[str], *seed: object) -> DataFrame:
    """rows with place (from 0, in the seeded order of key inside each part) and part_rows (the part's rows).

    A part is cut by the first digits of the MD5s, so that a large one is many tasks.
    """
    drawn = rows.withColumn("__draw", draw(key, *seed)).withColumn("__cut", F.substring("__draw", 1, HEX))
    counts = drawn.groupBy(*part, "__cut").agg(F.count("*").alias("__rows"))
    before = _offsets(counts, part, "__cut", "__rows")  # 16^HEX rows for each part at most
    inside = drawn.withColumn("__in", F.row_number().over(Window.partitionBy(*part, "__cut").orderBy("__draw", *key)))
    out = inside.join(before, _same_bucket(part, "__cut")).withColumn("place", F.col("__before") + F.col("__in") - 1)
    return out.select(*rows.columns, "place", "part_rows")


def _edges(df: DataFrame, names: list[str]) -> tuple[dict[str, list[float]], int]:
    """Different approximate quantiles of each column, and the rows; one pass each."""
    n = df.count()
    parts = min(MOST_PARTS, max(PARTS, n // BUCKET_ROWS))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, max(10_000, 8 * parts)).alias(f"e{i}") for i, c in enumerate(names)]).first()  # one row
    return {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(names)}, n


def _below(edges: list[float], x: Column) -> Column:
    """How many edges are below x: two short steps where the edges are many."""
    lits = lambda v: F.array(*[F.lit(e) for e in v])
    count = lambda a: F.size(F.filter(a, lambda e: e < x))
    if len(edges) <= 2 * PARTS:
        return count(lits(edges)) if edges else F.lit(0)
    step = math.isqrt(len(edges))
    coarse = count(lits(edges[step - 1 :: step]))
    fine = F.element_at(F.array(*[lits(edges[i : i + step]) for i in range(0, len(edges) + 1, step)]), coarse + 1)
    return coarse * step + count(fine)


def bucket_of(edges: list[float], x: Column) -> Column:
    """2 i for values between edges i-1 and i, 2 i + 1 for those equal to edge i."""
    i = _below(edges, x)
    return i * 2 + F.coalesce((F.get(F.array(*[F.lit(e) for e in edges]), i) == x).cast("int"), F.lit(0)) if edges else F.lit(0)


def _counted(rows: DataFrame, names: list[str]) -> dict[str, dict[int, int]]:
    """Rows of each bucket, from columns of buckets; as many results as there are buckets."""
    out: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in rows.select(names).unpivot([], names, "of", "bucket").groupBy("of", "bucket").agg(F.count("*").alias("c")).collect():
        out[r.of][r.bucket] = r.c
    return out


def places(df: DataFrame, names: list[str], key: list[str], prefix: str = "p_") -> DataFrame:
    """df with the ordinal place (from 1) of each row by each of the columns, ties by key, nulls first.

    Buckets of one value are cut by the first key where that is a number. The windows carry the columns of df
    and the bucket numbers only; offsets come last.
    """
    kinds = dict(df.dtypes)
    cut = [key[0]] if key and kinds[key[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double") else []
    edges, _ = _edges(df, [*dict.fromkeys([*names, *cut])])
    few = edges[cut[0]][:: max(1, len(edges[cut[0]]) // KEY_PARTS)] if cut else []
    buckets = {}
    for n in names:
        b = bucket_of(edges[n], F.col(n).cast("double"))
        buckets[n] = F.when(F.col(n).isNull(), -1).otherwise(b * (len(few) + 1) + F.when(b % 2 == 1, _below(few, F.col(cut[0]).cast("double")) if cut else F.lit(0)).otherwise(0))
    own = {n: f"__b{i}" for i, n in enumerate(names)}
    rows = df.select(*df.columns, *[buckets[n].cast("int").alias(own[n]) for n in names])
    counts = _counted(rows, list(own.values()))
    offsets = []
    for n in names:
        c = counts[own[n]]
        before, running = [0] * (max(c, default=0) + 2), 0
        for b in sorted(c):
            before[b + 1] = running
            running += c[b]
        offsets.append(before)
    for n in names:
        rows = rows.withColumn(f"__i{own[n]}", F.row_number().over(Window.partitionBy(own[n]).orderBy(n, *key)))
    table = df.sparkSession.createDataFrame([tuple(offsets)], ", ".join(f"__o{own[n]} array<long>" for n in names))
    rows = rows.crossJoin(F.broadcast(table))  # one row, as long as there are buckets
    return rows.select(*df.columns, *[(F.col(f"__i{own[n]}") + F.get(f"__o{own[n]}", F.col(own[n]) + 1)).alias(prefix + n) for n in names])


def _offsets(counts: DataFrame, part: list[str], bucket: str, n: str) -> DataFrame:
    """counts(part, bucket, n) with __before and part_rows: the rows of the part in lower buckets, and all of it. A part has as many rows here as buckets."""
    w = Window.partitionBy(*part)
    return counts.select(*[F.col(p).alias(f"__of_{p}") for p in part], F.col(bucket).alias("__at"), (F.sum(n).over(w.orderBy(bucket)) - F.col(n)).alias("__before"), F.sum(n).over(w).alias("part_rows"))


def _same_bucket(part: list[str], bucket: str) -> Column:
    on = F.col(bucket) == F.col("__at")
    for p in part:
        on &= F.col(p).eqNullSafe(F.col(f"__of_{p}"))
    return on


def group_places(rows: DataFrame, part: list[str], by: str, key: list[str], edges: list[float] | None = None) -> DataFrame:
    """rows with place (from 0, by a number, ties by key, nulls first, inside each part) and part_rows.

    Parts are cut by approximate quantiles of the number over all rows (edges, where they are known), so that a
    large part is many tasks; a window sees one bucket of one part.
    """
    edges = _edges(rows, [by])[0][by] if edges is None else edges
    cut = rows.withColumn("__cut", F.when(F.col(by).isNull(), -1).otherwise(bucket_of(edges, F.col(by).cast("double"))).cast("int"))
    before = _offsets(cut.groupBy(*part, "__cut").agg(F.count("*").alias("__rows")), part, "__cut", "__rows")
    inside = cut.withColumn("__in", F.row_number().over(Window.partitionBy(*part, "__cut").orderBy(by, *key)))
    return inside.join(before, _same_bucket(part, "__cut")).withColumn("place", F.col("__before") + F.col("__in") - 1).select(*rows.columns, "place", "part_rows")


def large_parts(rows: DataFrame, part: list[str], most: int) -> tuple[DataFrame | None, int]:
    """The parts of over so many rows, None without any, and the number of all rows.

    Rows are counted by a hash of the part. Only where a hash has too many are parts counted, so that no row for
    each part is moved; the parts that are brought to the driver are rows / most at most.
    """
    h = F.pmod(F.hash(*part), F.lit(HASHES))
    seen = rows.groupBy(h.alias("h")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > most, F.col("h"))).alias("full")).first()  # one row
    if not seen.full:
        return None, seen.n or 0
    found = rows.where(h.isin(seen.full)).groupBy(*part).agg(F.count("*").alias("__rows")).where(F.col("__rows") > most).select(*part)
    keys = found.collect()
    return rows.sparkSession.createDataFrame(keys, found.schema) if keys else None, seen.n


def mean_place(part: list[str], by: str) -> Column:
    """The mean place (from 1) of a number inside its part, which is sorted in one task: for parts that are not large."""
    w = Window.partitionBy(*part).orderBy(by)
    return (F.rank().over(w) + F.count("*").over(w)) / 2  # the first and the last place of its value


def mid_ranks(counted: DataFrame, part: list[str], by: str, n: str, edges: list[float]) -> DataFrame:
    """counted(part, by, n, ...), a row for each different number of a part, with mid: the mean place (from 1) of its n rows inside the part.

    Cut as in group_places.
    """
    cut = counted.withColumn("__cut", bucket_of(edges, F.col(by).cast("double")).cast("int"))
    before = _offsets(cut.groupBy(*part, "__cut").agg(F.sum(n).alias("__rows")), part, "__cut", "__rows")
    upto = F.sum(n).over(Window.partitionBy(*part, "__cut").orderBy(by))
    inside = cut.withColumn("__upto", upto)
    mid = F.col("__before") + F.col("__upto") - F.col(n) + (F.col(n) + 1) / 2
    return inside.join(before, _same_bucket(part, "__cut")).select(*counted.columns, mid.alias("mid"))


def edges_of(df: DataFrame, names: list[str]) -> dict[str, list[float]]:
    return _edges(df, names)[0]


def rho(n: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Correlation of the mean places from 1 to n, of the sums of their products; null under three rows and where one is constant."""
    square = n * F.pow((n + 1) / 2, F.lit(2))
    return F.when((n >= 3) & (xx > square) & (yy > square), (xy - square) / F.sqrt((xx - square) * (yy - square)))


def rank_correlation(rows: DataFrame, part: list[str], a: str, b: str) -> DataFrame:
    """part, n, rho: correlation of the mean places of two numbers inside each part; null under three rows and where one is constant."""
    rows = rows.select(*part, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = _edges(rows, [a, b])[0]
    both = rows.groupBy(*part, a, b).agg(F.count("*").alias("c"))
    for name in (a, b):
        ranks = mid_ranks(rows.groupBy(*part, name).agg(F.count("*").alias("m")), part, name, "m", edges[name]).select(*part, name, F.col("mid").alias(f"mid_{name}"))
        both = both.join(ranks, [*part, name])
    x, y, c = F.col(f"mid_{a}"), F.col(f"mid_{b}"), F.col("c")
    sums = both.groupBy(*part).agg(F.sum("c").alias("n"), F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"))
    return sums.select(*part, "n", rho(F.col("n"), F.col("xy"), F.col("xx"), F.col("yy")).alias("rho"))


def place_table(df: DataFrame, names: list[str], key: list[str], prefix: str = "p_") -> DataFrame:
    """A row for each row of df with its ordinal place (from 1) by each of the columns, ties by key, nulls first; nothing else of df.

    The rows are sorted by the key and written once, with a number that rises with the key and stands for it from
    then on. Then the columns are cut into buckets by binary search and put one below the other, each value with
    that number: one shuffle and one window give the places of all of them, and a second shuffle puts a row's places
    side by side. Buckets of one value are cut by the number.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_A_TASK))
    kept = df.select(*[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)], *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    own = [f"k{i}" for i in range(len(key))]
    kept = kept.repartitionByRange(tasks, *own).sortWithinPartitions(*own).withColumn("row", F.monotonically_increasing_id())
    kept = written(kept.drop(*own), "places").withColumn("k", F.col("row").cast("double"))
    inputs = [f"v{i}" for i in range(len(names))]
    edges = {c: [x for x in e if math.isfinite(x)] for c, e in _edges(kept, [*inputs, "k"])[0].items()}
    few = edges["k"][:: max(1, len(edges["k"]) // KEY_PARTS)]
    splits = [[-math.inf, *(e or [0.0]), math.inf] for e in [*(edges[c] for c in inputs), few]]
    outputs = [f"b{i}" for i in range(len(names))]
    wide = Bucketizer(splitsArray=splits, inputCols=[*inputs, "k"], outputCols=[*outputs, "kb"], handleInvalid="keep").transform(kept)

    def bucket(i: int) -> Column:
        b = F.col(outputs[i]).cast("int")  # edges at or below the value
        alone = F.coalesce(F.get(F.array(*[F.lit(e) for e in splits[i][1:-1]]), b - 1) == F.col(inputs[i]), F.lit(False))
        inside = F.when(alone, F.coalesce(F.col("kb").cast("int"), F.lit(0))).otherwise(0)
        b = F.when(F.col(inputs[i]).isNull(), 0).otherwise(1 + (2 * b - alone.cast("int")) * (len(few) + 2) + inside)
        return b + sum(2 * (len(x) + 1) * (len(few) + 2) + 1 for x in splits[:i])  # a column's buckets follow the last column's

    first = [bucket(i) for i in range(len(names))]
    rows = wide.select("row", F.explode(F.array(*[F.struct(F.lit(i).alias("of"), b.alias("b"), F.col(v).alias("v")) for i, (b, v) in enumerate(zip(first, inputs))])).alias("x"))
    rows = rows.select("row", "x.*")
    before = _offsets(rows.groupBy("of", "b").agg(F.count("*").alias("n")), ["of"], "b", "n").drop("part_rows")  # as many rows as buckets
    inside = rows.drop("of").withColumn("__in", F.row_number().over(Window.partitionBy("b").orderBy("v", "row")))
    placed = inside.join(F.broadcast(before), F.col("b") == F.col("__at")).select("row", ((F.col("__before") + F.col("__in")) * len(names) + F.col("__of_of")).alias("at"))  # place and column in one number
    place = lambda i: F.max(F.when(F.col("at") % len(names) == i, F.floor(F.col("at") / len(names))))
    return placed.groupBy("row").agg(*[place(i).alias(prefix + n) for i, n in enumerate(names)]).drop("row")


def values_at(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at the given ranks (from 0, in ascending order of the non-null values) of each column, exactly.

    Only the buckets that hold a rank are sorted, and of those none that holds one value.
    """
    edges, _ = _edges(df, list(ranks))
    own = {n: f"b{i}" for i, n in enumerate(ranks)}
    rows = df.select(*[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(ranks)])
    rows = rows.select("*", *[F.when(F.col(f"v{i}").isNotNull(), bucket_of(edges[n], F.col(f"v{i}"))).cast("int").alias(own[n]) for i, n in enumerate(ranks)])
    counts = _counted(rows, list(own.values()))
    out: dict[str, dict[int, float]] = {n: {} for n in ranks}
    wanted = []  # column, bucket, place inside, rank
    for i, (n, at) in enumerate(ranks.items()):
        before, where = 0, {}
        for b in sorted(k for k in counts[own[n]] if k is not None):
            where[b] = before
            before += counts[own[n]][b]
        for r in at:
            b = max((b for b, x in where.items() if x <= r), default=None)
            if b is None or r >= before:
                continue
            if b % 2:
                out[n][r] = edges[n][b // 2]
            else:
                wanted.append((i, b, r - where[b] + 1, r))
    if wanted:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(own[n]).alias("b"), F.col(f"v{i}").alias("v")) for i, n in enumerate(ranks)])).alias("x")).select("x.*")
        some = F.broadcast(df.sparkSession.createDataFrame(sorted({w[:2] for w in wanted}), "i int, b int"))  # as many rows as ranks
        placed = long.join(some, ["i", "b"]).withColumn("place", F.row_number().over(Window.partitionBy("i", "b").orderBy("v")))
        at = F.broadcast(df.sparkSession.createDataFrame(wanted, "i int, b int, place int, r long"))
        for x in placed.join(at, ["i", "b", "place"]).collect():  # as many rows as ranks
            out[list(ranks)[x.i]][x.r] = x.v
    return out


def exact_quantiles(df: DataFrame, names: list[str], at: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Quantiles of the non-null values, linear between neighbours."""
    row = df.agg(*[F.count(n).alias(f"n{i}") for i, n in enumerate(names)]).first()  # one row
    last = {n: row[f"n{i}"] - 1 for i, n in enumerate(names)}
    ranks = {n: sorted({int(r) for q in at for r in (math.floor(q * last[n]), math.ceil(q * last[n]))}) for n in names if last[n] >= 0}
    found = values_at(df, ranks) if ranks else {}

    def one(n: str, q: float) -> float | None:
        if last[n] < 0:
            return None
        x = q * last[n]
        lo, hi = found[n][math.floor(x)], found[n][math.ceil(x)]
        share = x - math.floor(x)
        return lo if share == 0 else (1 - share) * lo + share * hi

    return {n: [one(n, q) for q in at] for n in names}


def exact_median(df: DataFrame, name: str) -> float | None:
    """The median of the finite values of a column, by selection; null without any."""
    x = F.col(name).cast("double")
    return exact_quantiles(df.select(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(name)), [name], (0.5,))[name][0]
