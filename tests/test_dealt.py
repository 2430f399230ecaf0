"""Rows dealt by group: as many tasks as rows ask for, and the same results."""

import os

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from candrank.functions.columns import Noise
from candrank.operators import baselines, curves
from candrank.plans import QUERIES
from candrank.plans.fixtures import brand
from candrank.sources import bundle, shared
from candrank.table import Measurements
from tests.test_queries import oracle, test_equals_sql  # noqa: F401

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


@given
@pytest.mark.parametrize("name", ["validity_check", "recommend_order", "recommend_strict"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    """Adaptive execution merges the parts of a shuffle into a few tasks, which grow with the table."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    rows = QUERIES[name](spark, DIR).withColumn("task", F.spark_partition_id()).groupBy("g").agg(F.min("task").alias("lo"), F.max("task").alias("hi")).collect()
    assert all(r.lo == r.hi for r in rows) and len({r.lo for r in rows}) >= 9  # of 12


@given
def test_split_answers_deals_each_side_once(spark):
    plan = QUERIES["split_answers"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the two readings of the lines, and none for the keys


def test_null_keys_are_on_both_sides(spark):
    mt = Measurements(spark.createDataFrame([(1, None, 2.0), (1, "a", 3.0), (None, "a", 4.0)], "g long, k string, t double"), ("g",), ("k",))
    features, costs = bundle.split_answers(mt)
    assert [tuple(r) for r in bundle.check_keys(features, costs, ["g", "k"]).collect()] == [(3, 3, 0)]
    assert [tuple(r) for r in bundle.check_keys(features, costs.where("t < 4"), ["g", "k"]).collect()] == [(3, 2, 1)]


@pytest.fixture(scope="module")
def levels(spark):
    r = np.random.default_rng(4)
    rows = [(g, k, float(np.exp(0.3 * a - 0.2 * b + 0.1 * r.random())), float(a), float(b), "xy"[k % 2]) for g in range(30) for k, (a, b) in enumerate(r.integers(0, 5, (20, 2)))]
    return Measurements(spark.createDataFrame(rows, "g long, k long, t double, f0 double, f1 double, c string"), ("g",), ("k",), noise=Noise(0, 0, 0))


def test_trees_on_weighted_rows_are_those_on_rows(spark, levels, monkeypatch):
    fitted = []
    real = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *a: (fitted.append(df.count()), real(self, df, *a))[1])
    held, _ = baselines.gbdt(levels, ["f0", "f1"], F.col("g") % 3 != 0, 5, 3, {"c": ("x", "y")})
    assert fitted[0] <= 50  # 5 values by 5 values by 2 levels, of 400 rows
    monkeypatch.setattr(baselines, "_cells", lambda rows, by: rows.withColumn("__n", F.lit(1.0)))
    each, _ = baselines.gbdt(levels, ["f0", "f1"], F.col("g") % 3 != 0, 5, 3, {"c": ("x", "y")})
    key = lambda df: {(r.g, r.k): r.prediction for r in df.collect()}
    assert key(held) == pytest.approx(key(each), abs=1e-9)


def test_folds_together_are_the_folds_alone(spark, levels):
    fold = (F.col("g") % 3).cast("int")
    both = baselines.gbdt_folds(levels, ["f0", "f1"], fold, 3, 4, 3, {"c": ("x", "y")})
    got = {(r.g, r.k): r.prediction for r in both.collect()}
    want = {(r.g, r.k): r.prediction for i in range(3) for r in baselines.gbdt(levels, ["f0", "f1"], fold != i, 4, 3, {"c": ("x", "y")})[0].collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 600


@given
@pytest.mark.parametrize("name", ["curve_summary", "curve_crossing", "conditional_search_curve", "m_bands", "validity_check", "split_answers"])
def test_changed_queries_equal_their_sql(spark, oracle, name):
    test_equals_sql(spark, oracle, name)


@given
def test_draws_join_the_best_to_what_they_picked(spark):
    plan = curves.random_curve(brand(spark, DIR), (1, 4), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("WindowGroupLimit")  # parents come first


@given
@pytest.mark.parametrize(("name", "module"), [("observed_quantiles", "quality"), ("m_bands", "rank")])
def test_selection_reads_a_written_table(spark, monkeypatch, name, module):
    seen, of = [], __import__(f"candrank.operators.{module}", fromlist=["written"])
    monkeypatch.setattr(of, "written", lambda df, what: (seen.append(what), shared.written(df, what))[1], raising=False)
    QUERIES[name](spark, DIR).collect()
    assert len(seen) == 1


def test_run_logs_are_read_once(spark, tmp_path):
    """A schema that is given is not looked for in the files."""
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "a.json").write_text('{"value": 1}\n{"value": 2.5, "more": "x"}\n')
    got = bundle.read_runs(spark, str(tmp_path), "*.json", "value double")
    assert sorted((r.run, r.value) for r in got.collect()) == [("r1", 1.0), ("r1", 2.5)]


def test_random_draws_are_those_with_replacement(spark, levels):
    """Medians of the drawn places, one by one."""
    import hashlib

    got = {r.g: r.m for r in baselines.random_groups(levels, 8).collect()}
    rows = {}
    for r in levels.rows.orderBy("k").collect():
        rows.setdefault(r.g, []).append(r.t)
    draw = lambda g, i: rows[g][int(int(hashlib.md5(f"{g}|{i}".encode()).hexdigest()[:8], 16) / 4294967296.0 * len(rows[g]))] / min(rows[g])
    assert got == pytest.approx({g: float(np.median([draw(g, i) for i in range(8)])) for g in rows})
