"""Registered queries beside their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from candrank.plans import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ("group_stats", "evaluate", "stratified", "compare", "top_k", "pair_join", "recommend_exact", "stratified_kfold", "cumulative_best", "elite_grid", "static_topk", "feature_matrix", "pearson_pairs", "grouped_folds", "sample_spread", "jaccard_floor", "ridge_holdout", "spearman_pairs", "hwaware_features", "raster_order", "observed_quantiles", "recommend_order", "recommend_strict", "external_baseline", "static_procedures", "slice_gate", "hit_at_pct", "rank_auc", "contrast_pairs", "fold_report", "pinned_folds", "first_place_loss", "sample_proportional", "sample_mixed", "jaccard_overlap", "table_axes", "median_of_runs", "read_run_logs")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, oracle, name):
    query = QUERIES[name]
    got = sorted(map(tuple, query(spark, DIR).collect()), key=repr)
    cursor = oracle.execute(query.oracle())
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(c for c, _ in query.columns)
    want = sorted((tuple(r[names.index(c)] for c, _ in query.columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want) and all(close(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
def test_every_fold_is_held_out_once(spark):
    got = QUERIES["gbdt_kfold"](spark, DIR).collect()
    assert sorted(r.fold for r in got) == [0, 1, 2, 3, 4] and sum(r.n for r in got) == QUERIES["group_stats"](spark, DIR).count()
    assert all(r.regret >= 1 for r in got)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHEAP)))
def test_every_plan_is_built(spark, name):
    query = QUERIES[name]
    assert tuple(query(spark, DIR).dtypes) == query.columns


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 100


def test_curve_that_stays_above_the_target_has_no_row(spark, tmp_path):
    """One cheap candidate among 3000 is in none of the draws of up to 256."""
    day = "TIMESTAMP '1998-01-01 00:00:00'"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS l_orderkey, 0::BIGINT AS l_partkey, i % 10 AS l_suppkey, 1::INTEGER AS l_linenumber, 10.0::DOUBLE AS l_quantity, CASE WHEN i = 17 THEN 1000.0 ELSE 100000.0 END::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, {day} AS l_shipdate FROM range(3000) r(i)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT 0::BIGINT AS p_partkey, 'x' AS p_name, 'b' AS p_brand, 't' AS p_type, 1::INTEGER AS p_size, 900.0::DOUBLE AS p_retailprice) TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    query = QUERIES["curve_crossing"]
    assert con.execute(query.oracle()).fetchall() == [tuple(r) for r in query(spark, str(tmp_path)).collect()] == []
