"""Rows that are read several times: moved or written once, with the same results."""

import os

import pytest
from pyspark.sql import functions as F

from candrank.functions.columns import Noise
from candrank.operators import baselines, order, quality
from candrank.plans import QUERIES
from candrank.plans.fixtures import part
from candrank.table import Measurements, evaluate, first_picks

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, scores and costs that are null or no numbers, and a group without usable costs or a name."""
    nan = float("nan")
    rows = [(1, 1, 2.0, 0.5, 1.0), (1, 2, 3.0, 0.5, None), (1, 3, None, 0.9, 0.1), (2, 1, nan, 0.1, nan), (2, 2, 4.0, 0.2, 5.0), (3, 1, -1.0, 0.1, 1.0), (3, 2, None, 0.2, 0.0), (None, 1, 1.0, 1.0, 1.0), (4, 1, 5.0, None, 2.0), (4, 2, 6.0, 1.0, 2.0)]
    return Measurements(spark.createDataFrame(rows, "g long, k long, t double, a double, b double"), ("g",), ("k",), noise=Noise())


def test_first_picks_are_those_of_evaluate(odd):
    got = sorted((r.g, r.run, str(r.regret)) for r in first_picks(odd, ("a", "b"), "run").collect())
    want = sorted((r.g, i, str(r.regret)) for i, s in enumerate("ab") for r in evaluate(odd, s, (1,)).collect())
    assert got == want and len(got) == 8


@given
def test_first_picks_move_the_lines_once(spark):
    assert plan(first_picks(part(spark, DIR), ("s", "s2", "f0"), "run")).count("Exchange") == 1


@given
def test_hit_at_pct_moves_no_rows_for_few_groups(spark):
    """The groups' values are known to be small before they are joined; an aggregate of a large table is not."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        made = plan(QUERIES["hit_at_pct"](spark, DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in made and "BroadcastHashJoin" in made


def test_ridge_reads_its_rows_from_one_written_table(spark):
    rows = [(g, k, 1.0 + (g * 7 + k * 3) % 5, float(k), float(g % 3)) for g in range(6) for k in range(5)]
    mt = Measurements(spark.createDataFrame(rows, "g long, k long, t double, f0 double, f1 double"), ("g",), ("k",), noise=Noise())
    out, _ = baselines.ridge(mt, ["f0", "f1"], F.col("g") < 4)
    made = plan(out)
    assert out.count() == 30 and "Join" not in made and "Exchange" not in made


def test_places_move_a_number_in_place_of_the_key(spark):
    df = spark.range(50).selectExpr("id % 7 AS a", "id % 5 AS b", "id AS u", "concat('x', id) AS w")
    made = order.place_table(df, ["a", "b"], ["u", "w"])
    windows = [line for line in plan(made).splitlines() if "Exchange hashpartitioning" in line]
    assert len(windows) >= 2 and "k0#" not in plan(made) and "k1#" not in plan(made)
    want, rows = {}, [(i % 7, i % 5, i, f"x{i}") for i in range(50)]
    for i, n in enumerate("ab"):
        want[n] = {r[2]: p + 1 for p, r in enumerate(sorted(rows, key=lambda r: (r[i], r[2], r[3])))}  # noqa: B023
    assert sorted((x.p_a, x.p_b) for x in made.collect()) == sorted((want["a"][i], want["b"][i]) for i in range(50))


@given
def test_rank_auc_deals_answers_not_lines(spark):
    """Each feature's places are of rows that are written once; the lines and their bests are not dealt again for each."""
    made = plan(QUERIES["rank_auc"](spark, DIR))
    assert made.count("REPARTITION_BY_NUM") == 4 and "l_extendedprice" not in made  # two features, two sides of a join of the same rows


@pytest.mark.parametrize("nameless", [False, True])
def test_rank_auc_with_and_without_nameless_groups(spark, nameless):
    rows = [(None if nameless and g == 2 else g, k, 1.0, float((k * 5 + g) % 4), k % 3 == 0) for g in range(3) for k in range(12)]
    mt = Measurements(spark.createDataFrame(rows, "g long, k long, t double, f double, ok boolean"), ("g",), ("k",), noise=Noise())
    (got,) = quality.rank_auc(mt, F.col("ok"), ["f"]).collect()
    each = []
    for g in {r[0] for r in rows}:
        pairs = [(b[3] > a[3]) + (b[3] == a[3]) / 2 for a in rows for b in rows if a[0] == b[0] == g and a[4] and not b[4]]
        each.append(sum(pairs) / len(pairs))
    assert got.n == 3 and got.auc == pytest.approx(sum(each) / 3)
