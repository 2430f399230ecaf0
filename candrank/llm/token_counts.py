"""Token counts: pieces are counted once for each distinct pre-token and joined to the documents' pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common
from candrank.llm.tokens import default_path, encoder

HEAD_PIECES = 1 << 18  # pre-tokens that are broadcast with their counts, the most frequent ones
HEAD_BYTES = 32  # of longer pre-tokens only the common.LONG_HEAD most frequent are broadcast
FLUSH = 300_000  # distinct pre-tokens that a task holds before it sends them on


def _distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(own.pieces(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _measured(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            k = [len(own.piece_ids(p)) for p in batch.column("piece").to_pylist()]
            yield batch.append_column("k", pa.array(k, pa.int32()))

    return run


def _per_document(path: str, head):
    """A first row for each document, with what its frequent pre-tokens sum to, and a row for each other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = encoder(path), head.value
        for batch in batches:
            rows, pieces, tf, doc, size, sums = [], [], [], [], [], []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                found = own.pieces(text)
                ks = list(map(known.get, found))
                rows.append(row)
                pieces.append(f"\0{row}")
                tf.append(0)
                doc.append(doc_id)
                size.append(len(text.encode()))
                sums.append(sum(k for k in ks if k))
                if None in ks:
                    rare = Counter(p for p, k in zip(found, ks) if k is None)
                    rows += [row] * len(rare)
                    pieces += rare
                    tf += rare.values()
                    for x in (doc, size, sums):
                        x += [None] * len(rare)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(pieces, pa.string()), pa.array(tf, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64())],
                ["row", "piece", "tf", "doc_id", "n_bytes", "head"],
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, head_pieces: int = HEAD_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text, ...).

    Null text counts as empty: 0 bytes and 0 tokens. Repeated rows and null ids keep a row each; further
    columns are left out. An empty table gives no rows. The head_pieces most frequent pre-tokens of at most
    HEAD_BYTES bytes, and a bounded number of longer ones, are broadcast; all others are joined, so no pre-token is left uncounted.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = path or default_path()
    scratch = common.Scratch(spark, "token-counts")
    read = common.numbered(docs)
    found = read.select("text").mapInArrow(_distinct(path), "piece string, n long")
    distinct = scratch.keep(found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(_measured(path), "piece string, n long, k int"), "pieces")
    head = common.frequent(distinct, "piece", head_pieces, HEAD_BYTES).select("piece", "k")
    known = spark.sparkContext.broadcast({r.piece: r.k for r in head.toLocalIterator()})
    parts = read.mapInArrow(_per_document(path, known), "row long, piece string, tf long, doc_id long, n_bytes long, head long")
    joined = parts.join(distinct.select("piece", "k"), "piece", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.max("head") + F.sum(F.col("tf") * F.coalesce(F.col("k"), F.lit(0)))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))
