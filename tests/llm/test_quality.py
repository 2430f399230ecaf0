import hashlib
import random
import re
from collections import Counter, defaultdict

from candrank.llm.quality import filter_documents, quality_rules
from tests.llm.conftest import DOCS, rows

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if W.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def table():
    out = rows(40, 3)
    loop = "a b c d e f g h i "
    out += [(500, loop * 4 + " ".join(map(str, range(200))), "en", "s0", 0), (501, loop * 30, "en", "s0", 0), (502, "x # * y\nx # * y\n" * 9, None, None, None)]
    page = "Navigation 12 home about terms privacy contact help\n"
    for i in range(30):
        out.append((600 + i, page + " ".join(f"w{i}x{j}" for j in range(60)), "en", "hub", 0))
        out.append((700 + i, page + page + page + " ".join(f"v{i}x{j}" for j in range(14)), "en", "hub", 0))
    return out


def verdicts(table, max_docs=5, max_long_docs=2):
    """Which rows the rules keep, and their texts, from the definition."""
    normal = lambda x: " ".join(W.findall(x.lower()))
    holders = defaultdict(set)
    for _, t, _, host, _ in table:
        for x in filter(W.search, (t or "").split("\n")):
            holders[host or "", normal(x)].add(t)
    keeper = {k: min(v, key=lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)) for k, v in holders.items() if len(v) > (max_long_docs if len(k[1].split()) >= 50 else max_docs)}
    out = []
    for d, t, _, host, _ in table:
        text = t or ""
        gone = lambda x: keeper.get((host or "", normal(x)), text) != text  # noqa: E731,B023
        left = "\n".join(x for x in text.split("\n") if not W.search(x) or not gone(x))
        n, kept = len(W.findall(text)), len(W.findall(left))
        out.append((d, not brute(t)[-1] and kept >= 20 and 2 * kept >= n, left))
    return out


def test_rules_against_brute_force(spark, none, clashing):
    docs = spark.createDataFrame(table(), DOCS)
    got = sorted((tuple(r) for r in quality_rules(docs).collect()), key=str)
    assert got == sorted(((d, *brute(t), kept) for (d, t, *_), (_, kept, _) in zip(table(), verdicts(table()))), key=str)
    assert quality_rules(none).count() == 0 and filter_documents(none).count() == 0
    assert quality_rules(docs.drop("source").withColumn("row", docs.lang)).count() == len(table())
    assert sorted(map(str, quality_rules(clashing).collect())) == sorted(map(str, quality_rules(clashing.select(*docs.columns)).collect()))
    assert set(filter_documents(clashing).columns) == set(clashing.columns)


def test_the_registered_limits(spark):
    """Lines in just as many documents as allowed stay, in one more they go from all but one; long lines sooner; other hosts do not count."""
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    own = lambda k: " ".join(word() for _ in range(k))
    out, long, longer = [], own(50), own(60)
    for i in range(6):
        lines = [f"All{' ' * (1 + i % 3)}RIGHTS reserved{chr(9) * (i % 2)}", own(30)] + ["in five documents"] * (i < 5) + [long] * (i < 2) + [longer.upper() if i else longer] * (i < 3)
        out.append((i, "\n".join(lines), "en", "h", 0))
        out.append((10 + i, f"{'long words ' * 25 if i % 2 else 'short'}\nmenu and footer text\n{own(9) if i else ''}", "en", f"o{i % 2}", 0))
        out.append((20 + i, own(21) + "\nthe same banner everywhere on this page as ever before and after that one\n", "en", "b", 0))
        out.append((30 + i, own(12) + "\nthe same banner everywhere on this page as ever before and after that one\n", "en", "b", 0))
    out += [(40, out[0][1], "en", "h", 0), (41, None, "en", "h", 0), (42, "", None, None, None)]
    docs = spark.createDataFrame(out, DOCS)
    want = verdicts(out)
    got = {x.doc_id: x for x in quality_rules(docs).collect()}
    assert {d: k for d, k, _ in want} == {d: x.kept for d, x in got.items()}
    assert any(not k and not got[d].base_failed for d, k, _ in want)
    texts = {x.doc_id: x.text for x in filter_documents(docs).collect()}
    assert texts == {d: left for d, k, left in want if k}
    source = {d: t for d, t, *_ in out}
    assert all((line in t) == (line in source[d]) for d, t in texts.items() for line in ("in five documents", long)) and sum("in five documents" in t for t in texts.values()) >= 5
    held = [sum(x in (source[d].lower(), t.lower())[k] for d, t in texts.items() if d < 10) for x in ("rights reserved", longer.lower()) for k in (0, 1)]
    assert held[0] >= 5 and held[1] <= 1 and held[2] >= 2 and held[3] <= 1


def test_shared_lines(spark):
    docs = spark.createDataFrame(table(), DOCS)
    limits = {"max_docs": 20, "max_long_docs": 100}
    kept = {r.doc_id: r.kept for r in quality_rules(docs, **limits).collect()}
    share = defaultdict(int)
    for i in range(30):
        share[kept[600 + i], kept[700 + i]] += 1
    assert share[True, True] <= 1 and share[True, False] >= 29  # one document keeps the line
    out = {r.doc_id: r for r in filter_documents(docs, **limits).collect()}
    assert set(out) == {d for d, k in kept.items() if k}
    cut = [out[600 + i] for i in range(30) if not out[600 + i].text.startswith("Navigation")]
    assert len(cut) >= 29 and all(len(r.text) == r.n_chars for r in cut)
    assert all(out[d].text == t for d, t, *_ in table() if d in out and d is not None and d < 500 and d != 3)
    assert filter_documents(docs).columns == docs.columns


def test_tables_of_numbers_stay(spark):
    """Documents of table rows that differ in their numbers only are no copies of each other."""
    docs = [(i, "\n".join(f"row {14 + j} total {(7919 * (i * 12 + j)) % 100000:05d} units sold in {1990 + i % 30}" for j in range(12)), "en", "h", 0) for i in range(40)]
    table = spark.createDataFrame(docs, DOCS)
    assert [r.kept for r in quality_rules(table).collect()] == [True] * 40 == [k for _, k, _ in verdicts(docs)]
    assert sorted((r.doc_id, r.text) for r in filter_documents(table).collect()) == sorted((d, t) for d, t, *_ in docs)
