import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candrank.llm.spelling import near_pairs, observed, single_edits, spelling_variants
from tests.llm.conftest import DOCS, rows


def near(a, b):
    """One inserted, deleted or replaced code point, by trying all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, min_length=6, min_count=5, times=5):
    n = Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    around, form = {w: [v for v in n if near(w, v)] for w in n}, {}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def typed(seed=3):
    """Documents of words and of their misspellings, chains of them included."""
    r = random.Random(seed)
    base = ["retrieval", "separate", "Straßen", "naïveté", "aaaaaa", "aaaaaaa", "abcabcabc", "necessary", "þorsteinn", "occurred"]
    chain = ["mmmmmm", "mmmmmn", "mmmmnn", "mmmnnn", "mmnnnn"]
    texts = []
    for i in range(120):
        words = r.choices(base, k=40)
        for _ in range(4):
            w = r.choice(base)
            at = r.randrange(len(w))
            words.append(r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("xyé") + w[at:], w[:at] + r.choice("xy") + w[at + 1 :]]))
        texts.append((i, " ".join(r.sample(words, len(words))), "en", "s", 0))
    texts += [(1000 + i, " ".join([w] * 5 ** (i + 1)), "en", "s", 0) for i, w in enumerate(chain)]
    return rows() + texts + [(None, "separate Separate SEPARATE " * 3, "en", "s", 0), (5, "seperate " * 7, "en", "s", 0), (5, "seperate " * 7, "en", "s", 0)]


@pytest.mark.parametrize("block", [256, 3])
def test_equals_brute_force(spark, block):
    docs = typed()
    got = spelling_variants(spark.createDataFrame(docs, DOCS), block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [k for _, k in got.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    want = brute(docs)
    assert sorted(map(tuple, got.collect())) == want
    assert {w[2] for w in want if w[0] == "mmmmmm"} == {"mmnnnn"} and any(w[1] is None and w[4] for w in want)


def test_pairs_of_many_like_words(spark):
    """One group that holds nearly all words, cut into many blocks."""
    r = random.Random(5)
    words = sorted({"common" + "".join(r.choices("ab", k=r.choice([5, 6]))) + "ending" for _ in range(400)} | {"zq" + "".join(r.choices("abc", k=6)) for _ in range(200)})
    got = sorted(tuple(sorted(map(str, p))) for p in near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), block=7).collect())
    assert got == sorted((a, b) for a, b in itertools.combinations(words, 2) if near(a, b))


def test_single_edits():
    r = random.Random(1)
    words = sorted({"".join(r.choices("ab", k=r.choice([1, 2, 3, 4, 5]))) for _ in range(200)})
    i, j = single_edits(words, words)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, a in enumerate(words) for y, b in enumerate(words) if near(a, b)}
    assert [len(x) for x in single_edits([], [])] == [0, 0]


def test_dropped_code_points():
    some = [(d, f"word{w}") for d in range(60) for w in range(30)]
    dropped = [(d, w) for d, w in some if observed(d, w) != w]
    assert 0 < len(dropped) < 40 and all(len(observed(d, w)) == len(w) - 1 for d, w in dropped)


def test_further_columns_and_empty_tables(spark, small, none, clashing):
    assert sorted(map(tuple, spelling_variants(clashing).collect())) == sorted(map(tuple, spelling_variants(small).collect())) == brute(rows())
    assert spelling_variants(none).count() == 0
