import functools
import random

import pytest

from candrank.llm import decontamination as de
from tests.llm.conftest import DOCS, rows


def best(window, text):
    """Least edits of the window against any part of the text."""
    d = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        e = [i + 1]
        for j, t in enumerate(text):
            e.append(min(d[j] + (c != t), d[j + 1] + 1, e[j] + 1))
        d = e
    return min(d)


def edited(r, data, n):
    data = list(data)
    for _ in range(n):
        i = r.randrange(len(data))
        kind = r.randrange(3)
        if kind == 0:
            data[i] = r.choice("xyz")
        elif kind == 1:
            del data[i]
        else:
            data.insert(i, r.choice("xyz"))
    return "".join(data)


def made(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    bench = [(i, " ".join(word() for _ in range(r.choice([6, 25, 60])))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (None, "no id " * 20), (93, "The  Same\nitem twice over and over again until long"), (94, "the same item twice OVER and over again until long")]
    docs = []
    for i in range(24):
        t = " ".join(word() for _ in range(r.choice([3, 40, 120])))
        if i % 2:
            item = bench[r.randrange(12)][1]
            t = f"{t} {edited(r, item, r.choice([0, 0, 1, 3, 9, 15]))} {t[:50]}"
        docs.append((i, t, "en", "s", 0))
    docs += [(71, "Too  SHORT\n", "en", "s", 0), (72, "too short for that", "en", "s", 0)]
    docs += [(70, "x the same ITEM twice over\tand over again until long y", "en", "s", 0), *((d and d + 500, *x) for d, *x in rows(5))]
    return docs, bench


@functools.cache
def wanted():
    """doc_id and item_id of every window that a text has within its edits."""
    docs, bench = made()
    want = set()
    for i, t in bench:
        for w in de.windows_of(de.normalised(t)) if t and i is not None else []:
            k = min(int(de.EDITS * len(w)), (len(w) - de.Q) // de.Q)
            want |= {(d, i) for d, x, *_ in docs if (d, i) not in want and x and len(x) < 5000 and best(w, de.normalised(x)) <= k}
    return want | {(d, 92) for d, x, *_ in docs if x and de.normalised(x) == b"too short"}


@pytest.mark.parametrize("at_once", [4_000_000, 2000])
def test_against_brute_force(spark, none, monkeypatch, at_once):
    monkeypatch.setattr(de, "AT_ONCE", at_once)
    docs, bench = made()
    want = wanted()
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = de.find_leaks(spark.createDataFrame(docs, DOCS), table)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and {93, 94} <= {i for _, i in want}
    kept = de.decontaminate(spark.createDataFrame(docs, DOCS), table)
    clean = spark.createDataFrame([x for x in docs if x[0] not in {d for d, _ in want}], DOCS)
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean.collect()))
    assert de.find_leaks(none, table).count() == 0 and de.find_leaks(kept, table.limit(0)).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    docs, bench = made(8)
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    whole = sorted(map(tuple, de.find_leaks(*args).collect()))
    monkeypatch.setattr(de, "BLOCK_BYTES", 300)
    assert whole and sorted(map(tuple, de.find_leaks(*args).collect())) == whole


def test_partial_quotes(spark):
    """Any 79 bytes of a text are found wherever they are cut, of short texts too; passages with 5 % edits in two places still are."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n)).replace("  ", "q ").strip().ljust(n, "z")
    items = [(0, text(239)), (1, text(700)), (2, text(130)), (3, text(79))]
    docs, want = [], set()
    for i, t in items:
        for s in range(0, len(t) - 78, 7):
            want.add((len(docs), i))
            docs.append((len(docs), f"{text(150)}#{t[s : s + 79]}#{text(150)}", "en", "s", 0))
    t = items[1][1]
    want.add((len(docs), 1))
    docs.append((len(docs), "#" * 99 + t[:50] + "####" + t[54:110] + "####" + t[114:160] + "#" * 99, "en", "s", 0))
    docs += [(len(docs) + i, text(300), "en", "s", 0) for i in range(20)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = de.find_leaks(spark.createDataFrame(docs, DOCS), table).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want
    kept = de.decontaminate(spark.createDataFrame(docs, DOCS), table).select("doc_id").collect()
    assert {x.doc_id for x in kept} == {d for d, *_ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("batch", ["1", "1000"])
def test_no_match_across_documents(spark, batch):
    """Halves of an item at the end of one document and the start of the next are no match, in one batch or two; spans are exact."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((70, 90, 110, 239, 30))]
    docs = [(1000, "", "en", "s", 0)]
    for _, t in items[:3]:
        h = len(t) // 2  # under 64 bytes, so no window of its own
        docs += [(len(docs), text(40) + t[:h], "en", "s", 0), (len(docs) + 1, t[h:] + text(40), "en", "s", 0), (len(docs) + 2, "", "en", "s", 0)]
    spans = {}
    for i, t in items:
        for before, after in ((0, 0), (50, 0), (0, 50), (33, 21)):
            spans[len(docs), i] = (before, before + len(t))
            docs.append((len(docs), text(before) + t + text(after), "en", "s", 0))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = spark.createDataFrame(items, "item_id long, text string")
        found = de.find_leaks(spark.createDataFrame(docs, DOCS).coalesce(1), table).collect()
        assert {(x.doc_id, x.item_id): (x.norm_start, x.norm_end) for x in found} == spans and all(x.edits == 0 for x in found)
        assert de.decontaminate(spark.createDataFrame(docs, DOCS).coalesce(1), table).count() == len(docs) - len(spans)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_text_over_and_over(monkeypatch):
    """A document and an item that repeat the same q-gram: what is counted at once stays bounded, and nothing is lost."""
    own = de.index_of([(1, b"ab" * 2000), (2, b"abcdefgh" * 40)])
    texts = [b"ab" * 600, b"abcdefgh" * 100, b"x" * 500]
    want = {x[:2] for x in de.hits(own, texts)}
    assert want == {(0, 1), (1, 2)}
    monkeypatch.setattr(de, "AT_ONCE", 20_000)
    assert {x[:2] for x in de.hits(own, texts)} == want


def test_clashing_columns_and_long_texts(spark, clashing):
    docs, bench = made()
    table = spark.createDataFrame([*bench, (95, "long " * 300)], "item_id long, text string")
    long = {r.doc_id for r in de.find_leaks(clashing, table).collect()}
    assert long == {63} and de.decontaminate(clashing, table).columns == clashing.columns
