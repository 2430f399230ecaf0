import itertools
import os
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from candrank.llm.audit import OP13_SQL, filter_audit, shapley_weights, solved
from tests.llm.conftest import DOCS, rows

LABELS = "doc_id long, quality int, toxic int"
FILTERS = "ABCDE"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def fails(doc, text, first):
    w = words(text)
    out = "A" if len(w) < 50 else ""
    out += "B" if 100 * len(set(w)) < 65 * len(w) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return set(out + ("E" if doc is not None and first[text] < doc else ""))


def brute(docs, labels):
    """Every order applied to every part, one filter after the other."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = {}
    for d, text, _, source, _ in docs:
        parts.setdefault(source or "", []).append((d, fails(d, text or "", first)))
    out = []
    for part, members in parts.items():
        runs, value = [], dict.fromkeys(FILTERS, 0)
        for order in map("".join, itertools.permutations(FILTERS)):
            left = members
            for k, f in enumerate(order):
                gone, left = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                value[f] += len(gone)
                redundant = sum(f in m[1] for m in members) - len(gone)
                runs.append((part, order, k + 1, len(left), len(gone), redundant, sum(m[1] == {f} for m in members), sum(m[0] in good for m in gone if m[0] is not None), sum(m[0] in toxic for m in gone if m[0] is not None)))
        out += [(*r, value[r[1][r[2] - 1]]) for r in runs]
    return sorted(out)


def sample():
    long = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    docs = rows(30) + [(200 + i, long(i), "en", f"s{i % 2}", 0) for i in range(12)]
    docs += [(300, long(3), "en", "s1", 0), (300, long(3), "en", "s2", 0), (203, long(3), "en", "s0", 0), (301, long(4) + " #", "en", "s1", 0), (302, long(4).upper(), "en", "s9", 0), (303, "a " * 60, "en", "s1", 0), (None, long(5), "en", "s1", 0)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 400, 2)] + [(300, 0, 1), (300, 1, None), (301, None, None), (None, 1, 1)]
    return docs, [(d, q, None if t is None else int(t)) for d, q, t in labels]


def test_equals_every_order(spark):
    docs, labels = sample()
    got = filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [k for _, k in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_sql(spark):
    docs, labels = sample()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("labels", la.toArrow())
    assert sorted(con.execute(OP13_SQL).fetchall()) == brute(docs, labels)


def test_further_columns_and_empty_tables(spark, small, none, clashing):
    labels = spark.createDataFrame([], LABELS)
    want = sorted(map(tuple, filter_audit(small, labels).collect()))
    clash = clashing.withColumns({c: F.lit(1) for c in ("part", "failed", "id", "content", "words", "good", "toxic", "quality")})
    assert sorted(map(tuple, filter_audit(clash, labels.withColumn("text", F.lit("x")).withColumn("n", F.lit(1))).collect())) == want == brute(rows(), [])
    assert filter_audit(none, labels).count() == 0
    assert {r.part for r in filter_audit(small.drop("source"), labels).collect()} == {""}


def test_rational_fit():
    """The weights give the average over all orders for any table of removals, and for two filters by hand."""
    assert solved([[Fraction(0), Fraction(2)], [Fraction(1), Fraction(1)]], [[Fraction(2)], [Fraction(3)]]) == [[2], [1]]
    assert shapley_weights(2) == [[0, 1, -1, 1], [0, -1, 1, 1]]
    for n in (3, 4, 5):
        removed = [0, *((s * 7919) % 1009 for s in range(1, 1 << n))]
        want = [0] * n
        for order in itertools.permutations(range(n)):
            s = 0
            for i in order:
                want[i] += removed[s | 1 << i] - removed[s]
                s |= 1 << i
        assert [sum(w * r for w, r in zip(row, removed)) for row in shapley_weights(n)] == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_given_tables(spark):
    from candrank.llm.audit import op13_filter_audit

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert sorted(map(tuple, op13_filter_audit(spark, "/root/testdata/sf0.001").collect())) == sorted(con.execute(OP13_SQL).fetchall())
