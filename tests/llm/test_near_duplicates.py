import itertools
import math
import os
import random
from collections import Counter

import pytest
import xxhash

from candrank.llm import near_duplicates as nd
from candrank.llm.graph import components
from candrank.llm.near_duplicates import masks, shingles, simhash_groups, similar_groups, words_of
from candrank.llm.common import Scratch
from tests.llm.conftest import DOCS, rows


def fingerprint(text, k=3):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def reach(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute(table):
    fps = [fingerprint(t) for _, t, *_ in table]
    root = reach(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, *_), f in zip(table, fps):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for (d, *_), f in zip(table, fps)), key=str)


def test_masks_cover():
    for radius in (1, 2, 3):
        for bits in itertools.combinations(range(0, 64, 5), radius):
            flip = sum(1 << b for b in bits)
            assert any(not (m & ((1 << 64) - 1)) & flip for m in masks(radius))


def test_groups(spark, small, none, clashing):
    assert sorted(map(tuple, simhash_groups(small).collect()), key=str) == brute(rows())
    assert sorted(map(tuple, simhash_groups(clashing).collect()), key=str) == brute(rows())
    assert simhash_groups(none).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(3)
    base = [r.choice("abcdefgh") * 2 + str(r.randrange(30)) for _ in range(400)]
    table = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(400)] = f"x{r.randrange(9)}"
        table.append((i, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(table, DOCS)
    for limit in (64, 3):
        assert sorted(map(tuple, simhash_groups(docs, in_bucket=limit).collect()), key=str) == brute(table)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7)]
    r = random.Random(1)
    r.shuffle(links)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000} | {1000 + i: 1000 for i in range(50)}


def test_similar_groups(spark, none):
    r = random.Random(9)
    table = []
    for g in range(25):
        base = [f"w{r.randrange(500)}" for _ in range(120)]
        for _ in range(r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(120)] = f"n{r.randrange(500)}"
            table.append((len(table), " ".join(w), "en", "s", 0))
    table += [(900, None, None, None, None), (901, "", None, None, None), (None, table[0][1], "en", "s", 0), (902, "one two", "en", "s", 0)]
    sets = [frozenset(shingles(words_of(t or ""), 5)) for _, t, *_ in table]
    near = lambda a, b: (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) if sets[a] or sets[b] else True
    root = reach(range(len(table)), near)
    first = {}
    for i, (d, *_) in enumerate(table):
        key = (d is None, d or 0, i)
        first[root[i]] = min(key, first.get(root[i], key))
    want = sorted((d for _, d, _ in first.values()))
    docs = spark.createDataFrame(table, DOCS)
    for paired in (100, 2):
        assert sorted(x.doc_id for x in similar_groups(docs, paired=paired).where("first").collect()) == want
    assert similar_groups(none).count() == 0
    assert similar_groups(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "group_doc", "first"]


def test_crowded_loose_groups_lose_no_link(spark, monkeypatch):
    from candrank.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 8)
    r = random.Random(21)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    table = []
    for _ in range(80):  # chains of texts, few of them near the first
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(200)] = f"n{r.randrange(500)}"
        table.append((len(table), " ".join(w), "en", "s", 0))
        if r.random() < 0.3:
            base = w
    sets = [frozenset(shingles(words_of(t), 5)) for _, t, *_ in table]
    root = reach(range(len(table)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = {}
    for i, x in root.items():
        groups.setdefault(x, set()).add(i)
    docs = spark.createDataFrame(table, DOCS)
    for paired in (100, 3):
        got = {}
        for x in similar_groups(docs, paired=paired).collect():
            got.setdefault(x.group_doc, set()).add(x.doc_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_estimate_loses_less_than_the_masks():
    """Of pairs at the threshold the estimate drops under a twentieth of those that no mask finds."""
    from candrank.llm import near_duplicates as nd

    n, p = nd.BANDS * nd.BAND, nd.SIMILARITY
    dropped = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n) if i / n < p - nd.ESTIMATE_SLACK)
    assert dropped < 0.05 * (1 - p**nd.BAND) ** nd.BANDS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_recall_on_the_given_documents(spark):
    """Every pair of the given documents at the similarity or above, found by comparing all that share a shingle, is in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: nd.words_of(r.text or "") for r in docs.select("doc_id", "text").collect()}
    grams = {d: set(nd.shingles(w, nd.SIMILAR_SHINGLE)) for d, w in rows.items()}
    holders = {}
    for d, g in grams.items():
        for x in g:
            holders.setdefault(x, []).append(d)
    shared = Counter((a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= nd.SIMILARITY * (len(grams[a]) + len(grams[b]) - n)]
    group = {r.doc_id: r.group_doc for r in nd.similar_groups(docs).select("doc_id", "group_doc").collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    print(f"pairs {len(pairs)}, in one group {found}")
    assert pairs and found == len(pairs)
    # and no group without links: what the pairs reach is the groups
    root = {d: d for d in group}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    empty = [d for d, g in grams.items() if not g]
    for a, b in zip(empty, empty[1:]):
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert len({top(d) for d in group}) == len(set(group.values()))


def test_fingerprints_link_similar_texts_first(spark, monkeypatch):
    """Without any signature bucket, texts within the masks' radius are joined where their shingle sets are alike, and only there."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    near = next(x for x in (words[:i] + ["other"] + words[i + 1 :] for i in range(400)) if nd.simhash(shingles([w.encode() for w in x], 3)) != nd.simhash(shingles([w.encode() for w in words], 3)) and (nd.simhash(shingles([w.encode() for w in x], 3)) ^ nd.simhash(shingles([w.encode() for w in words], 3))).bit_count() <= 2)
    same = [" ".join(["a", "b", "c"] * 60 + [f"{s}{i}" for i in range(40)]) for s in "xy"]  # one fingerprint, few common shingles
    assert len({nd.simhash(shingles(words_of(t), 3)) for t in same}) == 1
    docs = spark.createDataFrame(list(enumerate([" ".join(words), " ".join(near), *same])), "doc_id long, text string")
    nothing = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "row long, band int, bucket long")
    monkeypatch.setattr(nd, "_candidates", lambda *a: nothing)
    assert sorted(x.doc_id for x in similar_groups(docs).where("first").collect()) == [0, 2, 3]
