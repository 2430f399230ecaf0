"""Packing along a space-filling curve: neighbouring documents share sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common
from candrank.llm.tokens import default_path, encoded, encoder

LENGTH = 2048
END = 1
BUCKETS = 1024  # of the hashed document vector
DIMS = 3  # of the projection
BITS = 10  # of each dimension on the curve


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates, by the transpose form of Skilling (2004)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations from the top bit down
        p = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            t = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(flip, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


def projection() -> np.ndarray:
    """Fixed random directions; seeded, so that each task makes the same."""
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def document_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    if not ids:
        return np.zeros(0, np.int64)
    counts = np.stack([np.bincount(x % BUCKETS, minlength=BUCKETS) for x in ids]).astype(np.float32)
    counts = np.log1p(counts)
    unit = counts / np.maximum(1e-9, np.sqrt((counts**2).sum(1, keepdims=True)))
    where = 1 / (1 + np.exp(-1.7 * (unit @ projection())))  # close to uniform in each dimension
    return hilbert_keys(np.minimum((where * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).dtype
        for batch, ids in encoded(batches, path, end):
            keys = document_keys([np.frombuffer(x, kind) for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "key", "ids"])

    return run


def _pack(kind: str, length: int):
    """Cut the partition's documents, in the curve's order, where a sequence is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        at = 0  # tokens of this partition so far
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                wide = np.frombuffer(ids, kind).astype("<u4")
                start = 0
                while start < len(wide):
                    n = min(length - at % length, len(wide) - start)
                    out.append((doc_id, start, n, zlib.crc32(wide[start : start + n].tobytes()), len(wide), first + at // length, at % length))
                    start += n
                    at += n
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids and the end id are laid one after the other along the curve and cut at every
    length-th token; only the last sequence of each partition can be shorter. Null and empty texts are the
    end id alone. Repeated rows and equal keys are ordered by id and row, so a large group of copies spreads
    over partitions. Further columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = path or default_path()
    scratch = common.Scratch(spark, "packing")
    kept = scratch.keep(common.numbered(docs).mapInArrow(_encode(path, end), "row long, doc_id long, key long, ids binary"), "ids")
    return kept.orderBy("key", "doc_id", "row").mapInArrow(_pack(encoder(path).dtype, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
