"""Token files: frequency-ranked ids in a byte-aligned code with control bytes apart, decoded by table lookup.

A shard is one partition of the documents in ascending doc_id order; it holds blocks of whole documents.
A block has the documents' ids and lengths, the control bytes (two bits for each token: its bytes less one)
and the data bytes (each token's rank, little-endian, without leading zeros). vocab.parquet beside the
shards has the id of each rank.
"""

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

END = 0
BLOCK_TOKENS = 1 << 18  # a block is closed when it has so many
BLOCKS = "shard int, before long, doc_ids array<long>, lengths array<int>, control binary, data binary"
#: For each control byte the bytes of its four tokens.
SIZES = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    bytes4 = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), bytes4[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _encode(path: str, end: int, size: int):
    """A row for each document, and a last one for each task with the frequency of every id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, n = encoder(path).dtype, np.zeros(size, np.int64)
        rows = lambda row, doc_id, ids, counts: pa.RecordBatch.from_arrays([row, doc_id, pa.array(ids, pa.binary()), pa.array(counts, pa.list_(pa.int64()))], ["row", "doc_id", "ids", "counts"])
        for batch, ids in encoded(batches, path, end):
            n += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=size)
            yield rows(batch.column("row"), batch.column("doc_id"), ids, [None] * len(ids))
        yield rows(pa.array([None], pa.int64()), pa.array([None], pa.int64()), [None], [n])

    return run


def _write(kind: str, ranks, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rank, before = TaskContext.get().partitionId(), ranks.value, 0
        each = np.dtype(kind).itemsize
        docs: list[int | None] = []
        held: list[bytes] = []
        n = 0  # tokens held

        def block() -> pa.RecordBatch:
            control, data = pack_ranks(rank[np.frombuffer(b"".join(held), kind)])
            lengths = [len(x) // each for x in held]
            cols = [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "before", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc_id)
                held.append(ids)
                n += len(ids) // each
                if n >= block_tokens:
                    yield block()
                    before, docs, held, n = before + n, [], [], 0
        if docs:
            yield block()

    return run


def _read(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocab.value
        for batch in batches:
            for x in batch.to_pylist():
                ids = of[unpack_ranks(x["control"], x["data"], sum(x["lengths"]))]
                ends = np.cumsum(x["lengths"])
                starts = ends - x["lengths"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(starts + x["base"] + x["before"], pa.int64()), pa.array(x["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return run


def write_token_files(docs: DataFrame, to: str, path: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write docs(doc_id, text, ...) to the folder to, in ascending doc_id order (null ids first).

    Null and empty texts are the end id alone; repeated rows are written each; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = path or default_path()
    own = encoder(path)
    scratch = common.Scratch(spark, "token-files")
    size = own.tokenizer.get_vocab_size()
    kept = scratch.keep(common.numbered(docs).mapInArrow(_encode(path, end, size), "row long, doc_id long, ids binary, counts array<long>"), "ids")
    # at most one row for each id of the vocabulary
    found = kept.where(F.col("row").isNull()).select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
    counts = {r.id: r.n for r in found.collect()}
    vocab = np.array(sorted(range(size), key=lambda i: (-counts.get(i, 0), i)), "<u4")
    rank = np.empty(size, "<u4")
    rank[vocab] = np.arange(size)
    spark.createDataFrame(list(enumerate(vocab.tolist())), "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{to}/vocab.parquet")
    blocks = kept.where(F.col("row").isNotNull()).select("row", "doc_id", "ids").orderBy(F.asc_nulls_first("doc_id"), "row").mapInArrow(_write(own.dtype, spark.sparkContext.broadcast(rank), block_tokens), BLOCKS)
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/blocks.parquet")
    scratch.drop("ids")


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document in the files."""
    rows = spark.read.parquet(f"{at}/vocab.parquet").collect()  # one for each id of the vocabulary
    vocab = np.zeros(len(rows), "<u4")
    for r in rows:
        vocab[r.rank] = r.id
    blocks = spark.read.schema(BLOCKS).parquet(f"{at}/blocks.parquet")
    sizes = blocks.select("shard", (F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).groupBy("shard").agg(F.max("n").alias("n")).collect()  # one for each shard
    base, total = [], 0
    for r in sorted(sizes):
        base.append((r.shard, total))
        total += r.n
    bases = spark.createDataFrame(base, "shard int, base long")
    spread = blocks.join(F.broadcast(bases), "shard")
    return spread.mapInArrow(_read(spark.sparkContext.broadcast(vocab)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = common.Scratch(spark, "token-files").path("files")
    write_token_files(common.documents(spark, sf_dir), to)
    return read_token_files(spark, to)
