import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candrank.llm import minhash
from candrank.llm.minhash import candidates, intersections, least_matches, minhash_groups, prefix_lists, shingle_set
from tests.llm.conftest import DOCS, rows


def shingles(text, k=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t, *_ in docs]
    distinct = sorted({s for s in sets if s}, key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations(distinct, 2):
        if 4 * len(b) <= 5 * len(a) or 4 * len(a) <= 5 * len(b):
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (d, *_), s in zip(docs, sets):
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    component = [least.get(find(s)) if s else d for (d, *_), s in zip(docs, sets)]
    return sorted(((d, len(s), c, d == c) for (d, *_), s, c in zip(docs, sets, component)), key=str)


def similar(seed=4):
    """Groups of near copies: around one text, in chains, loosely alike and not linked, and some at just 0.8."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    out = []
    around = [word() for _ in range(100)]
    for i in range(60):  # each alike with the first, many not with each other
        w = list(around)
        for _ in range(r.choice([0, 3, 5, 6])):
            w[r.randrange(100)] = f"x{i}{r.randrange(99)}"
        out.append(" ".join(w))
    chain = [word() for _ in range(80)]
    for i in range(40):
        chain[(7 * i) % 80] = f"c{i}"
        out.append(" ".join(chain))
    half = [word() for _ in range(60)]
    out += [" ".join(half + [f"h{i}x{j}" for j in range(28)]) for i in range(50)]  # over half in common, not linked
    base = [f"b{j}" for j in range(91)]
    out += [" ".join(base), " ".join(base[:73]), " ".join(base[:72]), " ".join(base[9:])]  # 72 and 71 of 90 shingles
    out += ["one", "One", "two", "one two", "one two three", "two three"]
    out += [" ".join(f"e{j}" for j in range(6)), " ".join(f"e{j}" for j in range(5)), " ".join(f"E{j}" for j in range(6))]
    r.shuffle(out)
    return [(1000 + i, t, "en", "s", 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("paired", [16, 2])
def test_equals_brute_force(spark, paired):
    docs = rows() + similar()
    got = minhash_groups(spark.createDataFrame(docs, DOCS), paired=paired)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want = brute(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert max(sum(c == w[2] for *_, c, _ in want) for w in want) >= 40


def test_just_at_the_least_similarity(spark):
    """Every pair of 80 and 100 shingles in 1000 groups is found."""
    docs = []
    for i in range(1000):
        w = [f"g{i}x{j}" for j in range(101)]
        docs += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(w[:81]), "en", "s", 0)]
    got = minhash_groups(spark.createDataFrame(docs, DOCS)).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 and r.n_shingles == (100, 80)[r.doc_id % 2] for r in got) and len(got) == 2000


def test_prefix_holds_all_pairs_with_enough_matches(spark, tmp_path):
    """Merging the prefixes finds every pair with least matches or more, counted by brute force over all lists."""
    from candrank.llm.common import Scratch

    r = random.Random(2)
    sigs = [[r.randrange(3 if c < 6 else 40) for c in range(10)] for _ in range(120)]
    for i in range(0, 120, 3):
        sigs[i + 1] = [v if r.random() < 0.7 else r.randrange(40) for v in sigs[i]]
    nodes = spark.createDataFrame([(i, 10, s) for i, s in enumerate(sigs)], "row long, n long, sig array<int>")
    scratch = Scratch(spark, "test")
    prefix = scratch.keep(prefix_lists(nodes, 6, scratch), "prefix")
    got = {tuple(p) for p in candidates(prefix, 80, 1000, scratch)[0].collect()}
    want = {(i, j) for i, j in itertools.combinations(range(120), 2) if sum(x == y for x, y in zip(sigs[i], sigs[j])) >= 6}
    assert want and want <= got and len(got) < 120 * 119 / 4


def test_intersections(monkeypatch):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 90, k).astype(np.uint64)) for k in (0, 1, 5, 40, 200, 60)]
    for columns in (4096, 7):
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        assert intersections(sets, sets[1:]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]
    assert intersections([], sets).shape == (0, 6) and intersections(sets[:1], sets[:1]).tolist() == [[0]]


def test_least_matches():
    assert least_matches(64, 80) == 34 and least_matches(64, 100) == 64 and least_matches(4, 10) == 1


def test_sets():
    assert len(shingle_set(b"a b a b a".split(), 2)) == 2 and len(shingle_set([], 2)) == 0
    assert shingle_set([b"a"], 2).tolist() == shingle_set([b"a"], 3).tolist() != shingle_set([b"a", b"a"], 2).tolist()
    assert shingle_set([b"a", b"b"], 2).tolist() != shingle_set([b"b", b"a"], 2).tolist()


def test_further_columns_and_empty_tables(spark, small, none, clashing):
    clash = clashing.withColumns({c: F.lit(1) for c in ("sig", "content", "root", "m", "grams", "component_id", "kept")})
    assert sorted(map(tuple, minhash_groups(clash).collect()), key=str) == sorted(map(tuple, minhash_groups(small).collect()), key=str) == brute(rows())
    assert minhash_groups(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_given_documents(spark):
    from candrank.llm.minhash import op11_minhash

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_minhash(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(docs)
