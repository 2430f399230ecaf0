"""Places, order statistics and seeded orders against plain sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candrank.functions.features import _PART as PART
from candrank.functions.features import HARDWARE_AWARE, PHYSICAL, expanded, level_code, parts_of, raster_of
from candrank.operators import order
from candrank.sources.shared import shared_folder

KINDS = ("normal", "few", "constant", "nulls", "empty")


def made(kind):
    r = random.Random(kind)
    value = {"normal": lambda: r.gauss(0, 1), "few": lambda: float(r.choice([1, 1, 1, 2, 5])), "constant": lambda: 3.0, "nulls": lambda: r.choice([None, r.random()]), "empty": lambda: 0.0}[kind]
    return [(i * 7 % 1000, value(), r.random()) for i in range(0 if kind == "empty" else 1000)]


@pytest.mark.parametrize("parts", [4, 300])
@pytest.mark.parametrize("kind", KINDS)
def test_places_and_values(spark, monkeypatch, kind, parts):
    monkeypatch.setattr(order, "PARTS", parts)
    rows = made(kind)
    df = spark.createDataFrame(rows, "k long, x double, y double")
    got = {r.k: r.p_x for r in order.places(df, ["x", "y"], ["k"]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    values = sorted(r[1] for r in rows if r[1] is not None)
    ranks = [0, 1, len(values) // 3, len(values) - 1, len(values) + 5]
    found = order.values_at(df, {"x": ranks, "y": [0]})
    assert found["x"] == {r: values[r] for r in ranks if 0 <= r < len(values)}
    q = order.exact_quantiles(df, ["x"], (0.0, 0.1, 0.5, 0.99, 1.0))["x"]
    assert q == (pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist()) if values else [None] * 5)


def test_seeded_places(spark):
    rows = [(i, None if i % 5 == 0 else f"p{i % 3}") for i in range(500)]
    got = order.seeded_places(spark.createDataFrame(rows, "k long, p string"), ["p"], ["k"], 9).collect()
    for part in {p for _, p in rows}:
        ks = sorted((k for k, p in rows if p == part), key=lambda k: hashlib.md5(f"{k}|9".encode()).hexdigest())
        assert {r.k: (r.place, r.part_rows) for r in got if r.p == part} == {k: (i, len(ks)) for i, k in enumerate(ks)}


def test_levels_and_rasters(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), (None, 4)], "c string, n int")
    assert [r[0] for r in df.where("c IS NOT NULL").select(level_code("c", ("b", "a"))).collect()] == [1, 0]
    for bad in (("a",), ("a", "x")):
        with pytest.raises(Exception, match="not one of its levels"):
            df.select(level_code("c", bad)).collect()
    kinds = spark.createDataFrame([("identity", 3), ("horizontal", None), (None, 4)], "c string, n int")
    assert [tuple(r[0]) for r in kinds.select(raster_of(F.col("c"), F.col("n"))).collect()] == [("along_m", 3), ("along_n", 0), ("", 0)]
    with pytest.raises(Exception, match="unknown swizzle kind a"):
        df.where("c = 'a'").select(raster_of(F.col("c"), F.col("n"))).collect()


def test_parts_of_features_come_in_order():
    for features in (PHYSICAL, HARDWARE_AWARE):
        seen = set()
        for level in parts_of(features):
            assert level and not seen & set(level)
            seen |= set(level)
    assert not PART.search(expanded("p_slots + p_tail")) and expanded("log2(M)") == "log2(M)"


def test_a_cluster_needs_a_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_folder(Elsewhere)


def test_places_and_ranks_inside_groups(spark):
    """Places, mean places and rank correlations of groups of all sizes, one of which holds most rows and one value most of that."""
    r = random.Random(12)
    rows = [(g, i, r.choice([0.5, 0.5, 0.5, r.random(), float(r.randrange(9))]), float(r.randrange(5)) + (i % 2) * r.random()) for g, n in (("a", 900), ("b", 40), (None, 30), ("c", 2), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", 9999, None, 1.0)], "g string, i long, x double, y double")
    placed = order.group_places(df, ["g"], "x", ["i"]).collect()
    for g in {x[0] for x in rows}:
        own = sorted([x[:3] for x in rows if x[0] == g] + ([("a", 9999, -1.0)] if g == "a" else []), key=lambda x: (x[2], x[1]))
        assert [(x.i, x.part_rows) for x in sorted((x for x in placed if x.g == g), key=lambda x: x.place)] == [(x[1], len(own)) for x in own]
        assert sorted(x.place for x in placed if x.g == g) == list(range(len(own)))
    known = [x for x in rows if x[0] is not None]
    got = {x.g: x.rho for x in order.rank_correlation(spark.createDataFrame(known, df.schema), ["g"], "x", "y").collect()}
    for g in {x[0] for x in known}:
        own = [x for x in known if x[0] == g]
        mid = lambda k: [sum(v[k] < x[k] for v in own) + (sum(v[k] == x[k] for v in own) + 1) / 2 for x in own]  # noqa: E731,B023
        if len(own) < 3:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(float(np.corrcoef(mid(2), mid(3))[0, 1]))
    assert order.exact_median(df, "x") == pytest.approx(float(np.median([x[2] for x in rows])))


def test_places_of_several_columns(spark):
    """place_table gives the places of sorting: nulls, infinities, many ties, repeated rows, one value, no values, and a key that is no number."""
    r = random.Random(3)
    rows = [(i % 290, r.choice([None, 1.0, 1.0, 2.5, r.random()]), float("inf") if i % 50 == 0 else r.gauss(0, 1), 7.0, None, f"s{i % 290}") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, s string")
    for key in ("k", "s"):
        got = order.place_table(df, ["a", "b", "c", "d"], [key]).collect()
        at = 0 if key == "k" else 5
        for i, n in enumerate("abcd", 1):
            assert sorted(x[f"p_{n}"] for x in got) == list(range(1, 301))
        want = []
        for i in (1, 2, 3):
            order_ = sorted(range(300), key=lambda j: ((rows[j][i] is not None, rows[j][i] or 0.0), rows[j][at]))  # noqa: B023
            want.append({j: p + 1 for p, j in enumerate(order_)})
        unique = {j for j in range(300) if sum(rows[j][at] == x[at] for x in rows) == 1}
        triples = {(x.p_a, x.p_b, x.p_c) for x in got}
        assert all((want[0][j], want[1][j], want[2][j]) in triples for j in unique)
    assert order.place_table(df.limit(0), ["a"], ["k"]).count() == 0
