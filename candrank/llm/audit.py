"""Which filter removes what: all orders of a few filters, from the removals of all their coalitions.

Rows are counted by the set of filters that they fail. A coalition's removals follow from these counts, and the
difference of two coalitions is what one filter removes when it runs after others, so that every order of the
filters is answered without running one. Shapley values are the weights of the least squares fit of the
coalitions' removals that gives all filters together just their removals (Charnes et al. 1988); its normal
equations are solved once, in rationals, for every coalition as the right side.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common
from candrank.llm.quality import host_of, words

MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_UPPER_PCT = 5
SYMBOLS = "[#$%&*|]"


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of matrix x = right, by elimination in rationals; right has a column for each system."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n filters the whole numbers that, times the coalitions' removals, give n! times its Shapley value.

    Minimises the sum over coalitions s of k(s) (removed(s) - sum of the values of s)^2, k(s) =
    (n-1) / (C(n,|s|) |s| (n-|s|)), where the values of all n add up to what all remove. The normal equations
    have one multiplier for that; as they are linear in the removals, one solution with a column for each
    coalition serves every table of removals. Coalition s is the number whose bits are its filters.
    """
    whole = (1 << n) - 1
    inner = range(1, whole)
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in inner}
    has = lambda s, i: s >> i & 1
    matrix = [[sum((k for s, k in kernel.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel[s] if s in kernel and has(s, i) else Fraction(0) for s in range(whole + 1)] for i in range(n)]
    right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
    values = [[factorial(n) * x for x in row] for row in solved(matrix, right)[:n]]
    assert all(x.denominator == 1 for row in values for x in row)
    return [[int(x) for x in row] for row in values]


def failures() -> dict[str, Column]:
    """Conditions A to D of the columns text and words; E, a repeated text, comes after them."""
    return {
        "A": F.size("words") < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PCT * F.size("words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_UPPER_PCT * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }


def failed_sets(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None) -> DataFrame:
    """part, failed (bits of the conditions in order, then of repeated texts), good, toxic, n: how many rows of docs there are of each kind.

    A text is repeated in a row if it equals one of a smaller doc_id. Rows are counted by
    text, id and kind before they are dealt out, and dealt by text and id together, so that neither copies of
    one text nor repeats of one row meet in one task. What a row with a null id fails besides, it fails; it has
    no smaller id, is none, and has no labels.
    """
    scratch = common.Scratch(docs.sparkSession, "audit")
    conditions = failures() if conditions is None else conditions
    bits = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    read = docs.select(F.col("doc_id").alias("id"), host_of(docs).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    read = read.select("id", "part", "text", words(F.col("text")).alias("words"))
    kinds = read.select("id", "part", F.when(F.col("id").isNotNull(), F.unhex(F.md5("text"))).alias("content"), bits.alias("failed"))
    kinds = scratch.keep(kinds.groupBy("content", "id", "part", "failed").agg(F.count("*").alias("n")), "kinds")
    first = kinds.where(F.col("id").isNotNull()).groupBy("content").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = kinds.where(F.col("id").isNotNull()).join(first, ["content", "id"], "left").join(marked, "id", "left")
    repeat = F.when(F.col("first").isNull(), 1 << len(conditions)).otherwise(0)
    known = known.select("part", (F.col("failed") + repeat).alias("failed"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n")
    other = kinds.where(F.col("id").isNull()).select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(other).groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def coalitions(sets: DataFrame, n: int) -> DataFrame:
    """part, total, failing (rows that fail just each set of filters), and what each coalition removes: removed, good, toxic, all arrays by the coalition's bits."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    counted = sets.groupBy("part", "failed").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    hit = counted.select("part", "failed", "n", "good", "toxic", F.explode(every).alias("s"))
    there = F.col("failed").bitwiseAND(F.col("s")) != 0
    own = F.col("failed") == F.col("s")
    summed = hit.groupBy("part", "s").agg(
        F.sum("n").alias("total"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("failing"), *[F.sum(F.when(there, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    )
    rows = summed.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", "failing", "n", "good", "toxic"))).alias("x"))  # 2^n entries
    return rows.select("part", "total", F.col("x.failing").alias("failing"), F.col("x.n").alias("removed"), F.col("x.good").alias("good"), F.col("x.toxic").alias("toxic"))


def interactions(sets: DataFrame, filters: str) -> DataFrame:
    """For every part, order of the filters (a letter each, bits in that order) and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n = len(filters)
    orders = F.split(F.lit(",".join(map("".join, permutations(filters)))), ",")
    steps = coalitions(sets, n).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bits = lambda run: sum((F.when(F.contains(run, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    letter, prior = F.substr("filter_order", F.col("step"), F.lit(1)), F.substr("filter_order", F.lit(1), F.col("step") - 1)
    at = steps.withColumns({"own": bits(letter), "before": bits(prior)}).withColumn("upto", F.col("own") + F.col("before"))
    of = lambda values, s: F.get(F.col(values), F.col(s))
    gain = lambda values: of(values, "upto") - of(values, "before")
    value = F.lit(None).cast("long")
    for i, weights in enumerate(shapley_weights(n)):
        value = F.when(F.col("own") == 1 << i, sum((F.lit(w) * F.get(F.col("removed"), F.lit(s)) for s, w in enumerate(weights) if w), F.lit(0).cast("long"))).otherwise(value)
    return at.select(
        "part", "filter_order", "step", (F.col("total") - of("removed", "upto")).alias("kept"), gain("removed").alias("removed"),
        (of("removed", "own") - gain("removed")).alias("redundant"), of("failing", "own").alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), value.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the seven counts of the filters A to E on docs(doc_id, text, source, ...) with labels(doc_id, quality, toxic, ...).

    A row for each part, order and step, zeros included; a part is a source, null and missing sources are ''.
    Null text is empty. Repeated rows count each; equal ids with equal texts are no repeats of each other, and
    a null id is neither smaller nor larger than any (it never fails E) and has no labels. Where labels has
    several rows of an id, it is good or toxic if one of them says so; null labels say nothing. Further columns
    are passed over. Empty docs give no rows.
    """
    return interactions(failed_sets(docs, labels), "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
        (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS m
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, m),
b AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS p FROM b p, b q, b r, b s, b u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
st AS (SELECT array_to_string(list_transform(p, lambda x: chr((65 + x)::INT)), '') AS filter_order, k::INT AS step, p[k] AS i, (1 << p[k])::INT AS own,
        coalesce(list_sum(list_transform(p[1:k - 1], lambda x: 1 << x)), 0)::INT AS before FROM (SELECT p, unnest(range(1, 6)) AS k FROM o)),
x AS (SELECT part, filter_order, step, i,
        sum(n) FILTER (WHERE m & (before | own) = 0) AS kept, sum(n) FILTER (WHERE m & before = 0 AND m & own <> 0) AS removed, sum(n) FILTER (WHERE m & before <> 0 AND m & own <> 0) AS redundant,
        sum(n) FILTER (WHERE m = own) AS unique_fails, sum(good) FILTER (WHERE m & before = 0 AND m & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE m & before = 0 AND m & own <> 0) AS toxic_lost
      FROM c, st GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM x
"""
