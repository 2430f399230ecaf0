"""Spelling variants: words one edit apart, found by dense tiles of code-point matrices.

Two words differ by one inserted, deleted or replaced code point just when the lengths of their common prefix
and suffix add up to the longer length less one. One of the two is then half of that at least, so words meet in
the groups of their first and of their last half; each group is cut into blocks, and for every two blocks of it
padded matrices of code points are compared at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT = 6, 5
FORM_TIMES = 5  # a form occurs so many times as often as its variant
DROP_MODULUS = 199
FLUSH = 300_000  # distinct words that a task holds before it sends them on
BLOCK = 256  # words of a block
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def observed(doc_id: int | None, run: str, modulus: int = DROP_MODULUS) -> str:
    """The word for a lower-cased run of a document: without one code point where modulus divides the crc32 of "<doc_id>:<run>"."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(min_length: int, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                runs = Counter()
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) >= min_length:
                        runs[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                for word, n in runs.items():
                    if len(word := observed(doc_id, word, modulus)) >= min_length:
                        seen[word] += n
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, modulus: int = DROP_MODULUS) -> DataFrame:
    """word, n: the distinct words of docs(doc_id, text, ...) with min_length code points and min_count occurrences at least."""
    common.small_batches(docs.sparkSession)
    found = common.numbered(docs).select("doc_id", "text").mapInArrow(_counts(min_length, modulus), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def matrix(words: list[str], width: int, right: bool = False) -> np.ndarray:
    """The words' code points, padded with zeros to width on the right, or on the left where right is set."""
    pad = str.rjust if right else str.ljust
    return np.frombuffer("".join([pad(w, width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def runs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and each of b in how many columns from the first on they are equal."""
    alike = np.ones((len(a), len(b)), bool)
    n = np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T, b.T):
        alike &= x[:, None] == y[None, :]
        if not alike.any():
            break
        n += alike
    return n


def single_edits(ours: list[str], theirs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of ours and theirs are one edit apart: places in both lists."""
    width = max(map(len, [*ours, *theirs]), default=0)
    la, lb = (np.fromiter(map(len, w), np.int32, len(w)) for w in (ours, theirs))
    longer = np.maximum(la[:, None], lb[None, :])
    apart = np.abs(la[:, None] - lb[None, :])
    # Padding can lengthen no common run beyond the shorter word: lengths that differ end it, and for equal lengths only equal words reach it.
    prefix = np.minimum(runs_of(matrix(ours, width), matrix(theirs, width)), np.minimum(la[:, None], lb[None, :]))
    suffix = np.minimum(runs_of(matrix(ours, width, True)[:, ::-1], matrix(theirs, width, True)[:, ::-1]), np.minimum(la[:, None], lb[None, :]))
    same = (apart == 0) & (prefix == longer)
    return np.nonzero((apart <= 1) & ~same & (prefix + suffix >= longer - 1))


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each tile, two blocks of a group; a pair that also shares its first half is left to that group."""
    for batch in batches:
        a, b = [], []
        for size, side, within, ours, theirs in zip(*(batch.column(c).to_pylist() for c in ("longest", "side", "within", "ours", "theirs"))):
            half, theirs = size // 2, ours if within else theirs
            for x, y in zip(*(p.tolist() for p in single_edits(ours, theirs))):
                u, v = ours[x], theirs[y]
                if max(len(u), len(v)) == size and not (within and x > y) and (side == 0 or u[:half] != v[:half]):
                    a.append(u)
                    b.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: each pair of words(word, ...), distinct words of two code points or more, that are one edit apart, once.

    A pair whose longer word has m code points shares its first or its last m // 2; groups are by m and these.
    A group is cut by the words' hashes into blocks of about block words; a tile is two blocks, so a group of
    any size spreads over tasks.
    """
    size = F.length("word")
    halves = [F.struct(m.alias("longest"), F.lit(side).alias("side"), (F.left if side == 0 else F.right)(F.col("word"), F.floor(m / 2).cast("int")).alias("half")) for m in (size, size + 1) for side in (0, 1)]
    keyed = words.select("word", F.explode(F.array(*halves)).alias("x")).select("word", "x.*")
    keys = ["longest", "side", "half"]
    # A group without a word of the longest length has no pairs of its own.
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.length("word")).alias("top")).where((F.col("n") > 1) & (F.col("top") == F.col("longest")))
    placed = keyed.join(sizes.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks")), keys).withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select(*keys, "word", "own", every)
    tiles = dealt.select(*keys, "word", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("mine"))
    blocks = tiles.groupBy(*keys, "p", "q").agg(F.collect_list(F.when(F.col("mine"), F.col("word"))).alias("ours"), F.collect_list(F.when(~F.col("mine"), F.col("word"))).alias("theirs"))
    return blocks.select("longest", "side", (F.col("p") == F.col("q")).alias("within"), "ours", "theirs").mapInArrow(_tiled, "a string, b string")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = FORM_TIMES, modulus: int = DROP_MODULUS, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs(doc_id, text, ...).

    Words are the runs of letters with A-Z lower-cased (one code point dropped where the rule of observed
    says so; a null id reads as the empty string) that have min_length code points and min_count occurrences.
    n_near counts the words one edit away. form is the most frequent of these (ties: the smallest by code
    points) if it occurs times as often as the word at least, form_n its count, both null otherwise; root is
    what the forms lead to, the word itself without one. Null texts count as empty; repeated rows count each;
    further columns are passed over. An empty table gives no rows.
    """
    scratch = common.Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs, min_length, min_count, modulus), "words")
    pairs = scratch.keep(near_pairs(words.select("word"), block), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    beside = both.join(of, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("most"))
    enough = -F.col("most.less") >= times * F.col("n")
    formed = words.join(beside, "word", "left").select(
        "word", F.when(enough, F.col("most.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("most.less")).alias("form_n")
    )
    formed = scratch.keep(formed, "formed")
    scratch.drop("pairs")
    # A form is more frequent than its word, so the chain ends; every turn follows twice as many links as the one before.
    links = scratch.keep(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("on"))
        further = links.join(on, "root", "left")
        if further.where(F.col("on").isNotNull()).isEmpty():
            break
        turn += 1
        links = scratch.keep(further.select("word", F.coalesce("on", "root").alias("root")), f"roots-{turn}")
        scratch.drop(f"roots-{turn - 1}")
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.documents(spark, sf_dir))
