"""The given tables as measurements, and the same as SQL.

part: a group for each part, candidates by supplier, line and flag; cost is the least price in thousands to
one decimal, so that ties occur. brand: few large groups. run: a run log from the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.functions.columns import Noise
from candrank.sources.shared import dealt
from candrank.table import Measurements

NOISE = Noise(0.05, 0.002, 0.1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines dealt by part: all that is asked of a part's candidates is then inside one task."""
    lines = read(spark, sf_dir, "lineitem")
    return dealt(lines, ["l_partkey"], lines.count())


def part_rows(lines: DataFrame) -> DataFrame:
    """One candidate for each key, with two scores."""
    out = lines.groupBy(F.col("l_partkey").alias("g"), F.col("l_suppkey").alias("i1"), F.col("l_linenumber").cast("long").alias("i2"), F.col("l_returnflag").alias("i3")).agg(
        F.round(F.min("l_extendedprice") / 1000, 1).alias("t"), (F.avg("l_quantity") / 50).alias("f0"), F.avg("l_discount").alias("f1"), F.count("*").alias("n_rows")
    )
    return out.withColumns({"s": F.round(0.28 * F.col("f0") + 0.72 * F.col("f1"), 9), "s2": F.round(0.6 * F.col("f1") - 0.1 * F.col("f0"), 9)})


def part(spark: SparkSession, sf_dir: str) -> Measurements:
    return Measurements(part_rows(lines_by_part(spark, sf_dir)), ("g",), ("i1", "i2", "i3"), noise=NOISE)


def part_by_status(spark: SparkSession, sf_dir: str, status: str) -> Measurements:
    return Measurements(part_rows(lines_by_part(spark, sf_dir).where(F.col("l_linestatus") == status)), ("g",), ("i1", "i2", "i3"), noise=NOISE)


def brand(spark: SparkSession, sf_dir: str) -> Measurements:
    lines, parts = lines_by_part(spark, sf_dir), read(spark, sf_dir, "part")  # dealt, as the join's tasks would grow where rows compress well
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("g"), F.col("l_orderkey").alias("i1"), F.col("l_linenumber").cast("long").alias("i2"), F.col("l_partkey").alias("i3"), F.col("l_suppkey").alias("i4"),
        F.round(F.col("l_extendedprice") / 1000, 1).alias("t"), (F.col("l_quantity") / 50).alias("f0"), F.col("l_discount").alias("f1"), F.round(0.28 * F.col("l_quantity") / 50 + 0.72 * F.col("l_discount"), 9).alias("s"),
    )
    return Measurements(rows, ("g",), ("i1", "i2", "i3", "i4"), noise=NOISE, size_boundary=0.95)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, round (days from 0), kind, regret, seconds of each (run, day)."""
    events = read(spark, sf_dir, "events")
    rounds = events.groupBy(F.col("user_id").alias("run"), F.to_date("ts").alias("day")).agg((1 + F.round(F.min("value"), 2) / 100).alias("regret"), F.round(F.sum("value"), 2).alias("seconds"), F.count("*").alias("n"), F.count_distinct("event_type").alias("cells"))
    first = events.agg(F.to_date(F.min("ts")).alias("first"))
    return rounds.crossJoin(F.broadcast(first)).select("run", F.datediff("day", "first").cast("long").alias("round"), "regret", "seconds", "n", "cells")


def part_sql(name: str = "m", where: str = "") -> str:
    return f"""{name} AS (SELECT *, round(0.28 * f0 + 0.72 * f1, 9) AS s, round(0.6 * f1 - 0.1 * f0, 9) AS s2 FROM (
      SELECT l_partkey AS g, l_suppkey AS i1, l_linenumber::BIGINT AS i2, l_returnflag AS i3, round(min(l_extendedprice) / 1000, 1) AS t,
        avg(l_quantity) / 50 AS f0, avg(l_discount) AS f1, count(*) AS n_rows FROM lineitem {where} GROUP BY l_partkey, l_suppkey, l_linenumber, l_returnflag))"""


BRAND_SQL = """m AS (SELECT p_brand AS g, l_orderkey AS i1, l_linenumber::BIGINT AS i2, l_partkey AS i3, l_suppkey AS i4, round(l_extendedprice / 1000, 1) AS t,
  l_quantity / 50 AS f0, l_discount AS f1, round(0.28 * l_quantity / 50 + 0.72 * l_discount, 9) AS s FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PART_SQL = part_sql()
FLOOR = "(CASE WHEN {0} > 0 AND isfinite({0}) THEN greatest(0.05 / {0} + 0.002, 0.1 / {0}) ELSE 1.0 END)"


def stats_sql(boundary: float = 3.0, source: str = "m", name: str = "st") -> str:
    """Group statistics of a source, as a CTE."""
    return f"""{name}0 AS (SELECT g, count(*) AS n, min(t) FILTER (WHERE isfinite(t) AND t > 0) AS best, quantile_cont(t, 0.5) FILTER (WHERE isfinite(t)) AS median, count(DISTINCT t) FILTER (WHERE isfinite(t)) AS n_distinct FROM {source} GROUP BY g),
    {name} AS (SELECT *, median / best AS difficulty, {FLOOR.format('best')} AS floor, 2 * {FLOOR.format('best')} AS tol, best < {boundary} AS small FROM {name}0)"""


RUNS_SQL = """runs AS (SELECT user_id AS run, (ts::DATE - (SELECT min(ts)::DATE FROM events))::BIGINT AS round, 1 + round(min(value), 2) / 100 AS regret, round(sum(value), 2) AS seconds, count(*) AS n, count(DISTINCT event_type) AS cells
  FROM events GROUP BY user_id, ts::DATE)"""
KS_SQL = "ks AS (SELECT unnest([1, 3, 5, 10]) AS k)"


def evaluate_sql(score: str = "s", ids: str = "i1, i2, i3", name: str = "ev", source: str = "m", stats: str = "st") -> str:
    """The evaluation of a score, as CTEs; needs the source and its statistics."""
    return f"""{name}r AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY {score}, {ids}) AS rn FROM {source}),
    {name} AS (SELECT r.g, k.k, min(r.t) / any_value(b.best) AS regret, min(r.t) <= any_value(b.best * (1 + b.tol)) AS hit, any_value(b.tol) AS tol
      FROM {name}r r JOIN (SELECT unnest([1, 3, 5, 10]) AS k) k ON r.rn <= k.k JOIN {stats} b ON r.g = b.g GROUP BY r.g, k.k)"""
