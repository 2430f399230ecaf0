"""The gate against brute force, with groups dealt or cut, and how often its rows are moved."""

import math
import os
import random

import numpy as np
import pytest

from candrank.functions.columns import Noise
from candrank.operators import order, quality
from candrank.plans import QUERIES
from candrank.table import Measurements

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FIELDS = ("p", "q")


def low(x):
    """Nulls first, what is no number last."""
    return (x is not None, x is not None and math.isnan(x), x or 0.0)


def least(values):
    return min((v for v in values if v is not None), key=low, default=None)


def mids(own, k):
    return [sum(low(v[k]) < low(x[k]) for v in own) + (sum(low(v[k]) == low(x[k]) for v in own) + 1) / 2 for x in own]


def gate(rows):
    """n, interior, end_miss, hit by field; rank, pick_gm, n_groups."""
    per, ranks, picks = {f: [0, 0, 0, 0] for f in FIELDS}, [], []
    for g in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == g]
        if not all(r[3] is not None and math.isfinite(r[3]) for r in own):
            continue
        best = min(own, key=lambda r: (low(r[2]), r[1]))
        picks.append((min(own, key=lambda r: (r[3], r[1]))[2], least(r[2] for r in own)))
        both = [r for r in own if r[2] is not None]
        x, y = mids(both, 3), mids(both, 2)
        if len(both) >= 3 and len(set(x)) > 1 and len(set(y)) > 1:
            ranks.append(float(np.corrcoef(x, y)[0, 1]))
        for f, (own_at, held_at) in zip(FIELDS, ((4, 5), (5, 4))):
            along = [r for r in own if r[held_at] == best[held_at] and r[held_at] is not None]
            cells = [(v, least(r[2] for r in along if r[own_at] == v), least(r[3] for r in along if r[own_at] == v)) for v in {r[own_at] for r in along}]
            if len(cells) < 3 or len({c[2] for c in cells}) < 2:
                continue
            known = [c[0] for c in cells if c[0] is not None]
            at, axis_at = (min(cells, key=lambda c: (low(c[k]), low(c[0])))[0] for k in (1, 2))  # noqa: B023
            inner = at is not None and at not in (min(known), max(known))
            per[f] = [a + b for a, b in zip(per[f], (1, inner, inner and axis_at in (min(known), max(known)), at == axis_at and at is not None))]
    gains = [math.log(a / b) for a, b in picks if a and b and math.isfinite(a / b) and a / b > 0]
    return per, (np.mean(ranks) if ranks else None), (math.exp(np.mean(gains)) if gains else None), len(picks)


def odd_rows(seed):
    """Groups of all sizes with ties, costs and fields that are null or no numbers, axes that are not finite in some, and no name."""
    r, nan, rows = random.Random(seed), float("nan"), []
    for g, n in [(None, 20), (0, 150), (1, 60), (2, 2), (3, 1), (4, 40), (5, 40), *[(i, 12) for i in range(6, 40)]]:
        for k in range(n):
            p, q = float(r.randrange(4)), float(r.randrange(3))
            t = r.choice([1.0 + abs(p - 1.5) + r.randrange(3), round(1 + r.random(), 2)])
            a = round(r.choice([p, 3 - p, p * q, r.random()]), 2)
            if g == 4 and k == 7:
                a = r.choice([None, nan, float("inf")])
            if g in (5, 0) and k % 9 == 2:
                t = r.choice([None, nan]) if g == 5 else nan
            rows.append((g, k, t, a, None if g == 1 and k % 11 == 0 else p, q))
    return rows


def measured(spark, rows):
    return Measurements(spark.createDataFrame(rows, "g long, k long, t double, a double, p double, q double").repartition(3), ("g",), ("k",), noise=Noise())


@pytest.mark.parametrize("most", [250_000, 50, 10])
def test_slice_gate_is_brute_force(spark, monkeypatch, most):
    """Whatever groups are dealt, or cut because they are large; those of over most rows are not dealt."""
    dealt, seen = quality.dealt, []
    monkeypatch.setattr(quality, "ROWS_A_TASK", most)
    monkeypatch.setattr(quality, "dealt", lambda df, keys, n: (seen.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0]), dealt(df, keys, n))[1])
    rows = odd_rows(most)
    per, rank, pick, n = gate(rows)
    got = {x.field: x for x in quality.slice_gate(measured(spark, rows), "a", FIELDS).collect()}
    assert set(got) == set(FIELDS) and seen[0] <= most
    for f, x in got.items():
        assert [x.n, x.interior, x.end_miss, x.hit] == per[f] and x.n_groups == n
        assert x["rank"] == pytest.approx(rank) and x.pick_gm == pytest.approx(pick)
        assert x.one_way == (x.interior >= max(3, 0.25 * x.n) and x.end_miss > 0.5 * x.interior)
        assert x.verdict == (",".join([*(["rank"] if rank < 0.3 else []), *[f for f in FIELDS if got[f].one_way]]) or None)


def test_slice_gate_without_rows(spark):
    """A row for each field, though no group can be judged."""
    got = quality.slice_gate(measured(spark, [(None, 1, 1.0, 1.0, 1.0, 1.0), (1, 1, 1.0, None, 1.0, 1.0)]), "a", FIELDS).collect()
    assert sorted((x.field, x.n, x.interior, x.one_way, x["rank"], x.pick_gm, x.n_groups, x.verdict) for x in got) == [(f, 0, 0, False, None, None, 0, "rank") for f in FIELDS]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
def test_slice_gate_moves_its_lines_once(spark):
    """The lines were moved for each field, each rank and each join before; what is left is one row of each task."""
    made = QUERIES["slice_gate"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange hashpartitioning") == 1 and made.count("Exchange") == 2 and "Join" not in made


def test_large_parts_are_those_over_the_limit(spark):
    rows = spark.createDataFrame([(g, w) for g, w, n in (("a", 1, 7), ("a", 2, 6), ("b", 1, 5), (None, 1, 9)) for _ in range(n)], "g string, w long")
    large, n = order.large_parts(rows, ["g", "w"], 6)
    assert n == 27 and {tuple(x) for x in large.collect()} == {("a", 1), (None, 1)}
    assert order.large_parts(rows, ["g", "w"], 9) == (None, 27) and order.large_parts(rows.limit(0), ["g", "w"], 9) == (None, 0)
