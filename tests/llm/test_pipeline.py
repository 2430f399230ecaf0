import random

import corpus_pipeline
from candrank.llm.common import Scratch
from candrank.llm.near_duplicates import shingles, words_of
from candrank.llm.secrets import base_spans
from tests.llm.conftest import DOCS


def made():
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, text(40)) for i in range(4)]
    docs = [text(100) for _ in range(12)]
    leaks = [text(30) + " " + bench[i % 4][1] + " " + text(30) for i in range(4)]
    near = docs[0].split()
    near[50] = "changed"
    secret = text(40) + " password=b7db7aa4a5fcc783 " + text(20)
    rows = [*docs, *leaks, docs[1], " ".join(near), secret, "short", "", None, "same words over and over again here now " * 20]
    return [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(rows)], bench


def test_stages(spark, tmp_path):
    rows, bench = made()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    clean = set(range(12))
    assert ids[0] == clean | {12, 13, 14, 15, 16, 17, 18}
    sets = {i: frozenset(shingles(words_of(t or ""), 5)) for i, t, *_ in rows}
    assert ids[1] == {i for i in ids[0] if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in ids[0])} == clean | {12, 13, 14, 15, 18}
    assert ids[2] == ids[3] == ids[4] == clean | {18}
    texts = {r.doc_id: r.text for r in seen[3].collect()}
    assert all(texts[i] == rows[i][1] for i in clean) and "[SECRET]" in texts[18] and not base_spans(texts[18])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[4].collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
