"""Results do not depend on how Spark cuts the files, which changes when executors come or go."""

import pytest

from candrank.llm.near_duplicates import deduplicate
from candrank.llm.quality import filter_documents
from candrank.llm.secrets import redact_secrets
from tests.llm.conftest import DOCS

LINE = "a line that many documents of the host have"


@pytest.fixture
def files(spark, tmp_path):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, f"{LINE}\n{text(i)} password=abc{i:09d}", "en", "s", 0) for i in range(40)]
    rows += [rows[3], rows[3], (41, rows[5][1], "en", "s", 0), (None, rows[6][1], "en", "s", 0), (None, text(99), "en", "s", 0), (7, text(98), "en", "s", 0)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    return f"{tmp_path}/d", rows


@pytest.mark.parametrize("stage", [lambda d: filter_documents(d, max_docs=5), redact_secrets, deduplicate])
def test_same_rows_with_other_splits(spark, files, stage):
    path, _ = files
    want = sorted(map(str, stage(spark.read.parquet(path)).collect()))
    lazy = stage(spark.read.parquet(path))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert sorted(map(str, lazy.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repeated_rows(spark, files):
    path, rows = files
    assert filter_documents(spark.read.parquet(path)).count() == redact_secrets(spark.read.parquet(path)).count() == len(rows)
    kept = sorted((r.doc_id for r in deduplicate(spark.read.parquet(path)).collect()), key=str)
    assert kept == sorted([*range(40), 7, None], key=str)
