"""Hand-worked numbers on a toy table, and rows that break naive code."""

import math

import pytest
from pyspark.sql import functions as F

from candrank.functions import columns as C
from candrank.operators import compare, rank
from candrank.sources import bundle
from candrank.table import Measurements, evaluate, group_stats

NAN, INF = float("nan"), float("inf")
ROWS = [
    ("a", "k0", 1.0, 0.3), ("a", "k1", 1.0, 0.2), ("a", "k2", 2.0, 0.1), ("a", "k3", NAN, 0.9),
    ("b", "k0", 4.0, 0.5), ("b", "k1", 5.0, 0.5), ("b", "k2", INF, 0.6), ("b", "k3", -1.0, 0.7), ("b", "k4", 0.0, 0.8),
    ("c", "k0", 7.0, 0.0),
]
ZERO = C.Noise(0.0, 0.0, 0.0)


@pytest.fixture
def toy(spark):
    return Measurements(spark.createDataFrame(ROWS, "g string, k string, t double, s double"), ("g",), ("k",), noise=ZERO, size_boundary=3.0)


def by_group(df):
    return {r.g: r for r in df.collect()}


def test_stats(toy):
    got = by_group(group_stats(toy))
    assert [(got[g].n, got[g].best, got[g].n_ties, got[g].small) for g in "abc"] == [(4, 1.0, 2, True), (5, 4.0, 1, False), (1, 7.0, 1, False)]
    assert got["a"]["median"] == 1.0 and got["b"]["median"] == 2.0 and got["c"].difficulty == 1.0


def test_evaluate_and_ties(toy):
    got = {(r.g, r.k): (r.regret, r.hit) for r in evaluate(toy, "s", (1, 2, 3)).collect()}
    assert got["a", 1] == (2.0, False) and got["a", 2] == (1.0, True)
    assert got["b", 1] == (1.0, True)  # equal scores: the first by identity
    assert got["c", 3] == (1.0, True)


def test_row_order_does_not_matter(toy):
    again = toy.of(toy.rows.orderBy(F.rand(3)).repartition(7))
    assert sorted(evaluate(toy, "s").collect()) == sorted(evaluate(again, "s").collect())


def test_noise(spark):
    n = C.Noise(0.05, 0.002, 0.1)
    t = spark.createDataFrame([(x,) for x in (2.0, 0.0, -1.0, NAN, INF, None)], "t double")
    got = t.select(C.sigma(F.col("t"), n), C.tick_share(F.col("t"), n), C.floor(F.col("t"), n)).collect()
    assert [round(x, 9) for x in got[0]] == [0.027, 0.05, 0.05]
    assert [r[2] for r in got[1:]] == [1.0] * 5 and got[1][0] == 0.002 and got[1][1] == INF


def test_approx_equal(spark):
    rows = [(INF, INF, True), (INF, -INF, False), (NAN, NAN, False), (1.0, 1.0 + 1e-12, True), (1.0, 1.1, False), (None, 1.0, False)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", C.approx_equal(F.col("a"), F.col("b"))).collect())


def test_geomean_and_empty(spark):
    df = spark.createDataFrame([(2.0,), (8.0,), (NAN,), (0.0,), (INF,), (None,)], "x double")
    assert math.isclose(df.agg(C.geomean(F.col("x"))).first()[0], 4.0)
    assert df.limit(0).agg(C.geomean(F.col("x"))).first()[0] is None


def test_sign_test(spark):
    df = spark.createDataFrame([(8, 11), (0, 0), (0, 5), (3, 3)], "w long, l long").select(C.sign_test(F.col("w"), F.col("l")))
    got = [r[0] for r in df.collect()]
    assert [round(x, 3) for x in got] == [0.648, 1.0, 0.062, 1.0]


def test_scores_are_refused_not_sorted(toy):
    with pytest.raises(ValueError):
        rank.check_scores(toy.of(toy.rows.withColumn("s", F.when(F.col("g") == "c", NAN).otherwise(F.col("s")))), "s")


def test_comparison_needs_the_same_groups(toy):
    ev = evaluate(toy, "s", (1,))
    with pytest.raises(Exception, match="different groups"):
        compare.compare(ev, ev.where("g <> 'a'"), group_stats(toy), ("g",)).collect()


def test_bundle(spark, toy):
    rows = toy.rows.withColumn("status", F.lit("ok"))
    meta = spark.createDataFrame([("abc",)], "env_hash string")
    assert bundle.load_measurements(rows, meta, "ab").count() == len(ROWS)
    with pytest.raises(ValueError):
        bundle.load_measurements(rows, meta, "x")
    with pytest.raises(ValueError):
        bundle.normalize(rows, {}, {}, {}, ("absent",))
    features, costs = bundle.split_answers(toy)
    assert "t" not in features.columns and bundle.check_keys(features, costs, ["g", "k"]).first().one_sided == 0
    assert bundle.check_keys(features, costs.where("g <> 'c'"), ["g", "k"]).first().one_sided == 1
    kept, values = bundle.lift_constants(rows, ("status", "g"))
    assert "status" not in kept.columns and [tuple(r) for r in values.collect()] == [("status", "ok")]


def test_noise_ranks(spark):
    rows = [("a", f"k{i}", t) for i, t in enumerate([1.0, 1.05, 1.1, 2.0, 2.02, 5.0])]
    mt = Measurements(spark.createDataFrame(rows, "g string, k string, t double"), ("g",), ("k",), noise=C.Noise(0.0, 0.02, 0.0))
    got = [r.noise_rank for r in rank.noise_ranks(mt).orderBy("rn").collect()]
    assert got == [0, 0, 1, 2, 2, 3]
