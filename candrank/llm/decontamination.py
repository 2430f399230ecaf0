"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Both sides are lower-cased (A-Z) with single spaces. A benchmark text is cut into overlapping windows; a window
of m bytes found with at most k edits shares at least m-q+1-kq q-grams with the region, on at most k+1
neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals; bands that meet the
bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

Q = 12
WINDOW, STRIDE = 160, 80
SHORT, SHORT_STRIDE = 64, 16  # further windows: a passage copied as it is is found from SHORT + SHORT_STRIDE - 1 bytes on, wherever it is cut
EDITS = 0.05  # of a window's bytes
SHORTEST = 24  # bytes; a shorter benchmark text is matched by documents that say nothing else only
BLOCK_BYTES = 2 << 20  # of normalised benchmark text that is broadcast at once; more is searched in further blocks
FILTER_BITS = 24
AT_ONCE = 4_000_000  # shared q-grams that are counted at once
PAD = 1024
CODE = 8  # bits of an alignment's value that hold where it starts in its band


def normalised(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def _cut(data: bytes, window: int, stride: int) -> list[bytes]:
    """Overlapping windows, the last at the end."""
    starts = [*range(0, len(data) - window, stride), len(data) - window]
    return [data[s : s + window] for s in starts]


def windows_of(data: bytes, window: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    """The whole text or long windows of it, for passages with edits far apart, and short ones for partial copies."""
    if len(data) < SHORTEST:
        return []
    whole = [data] if len(data) < window + stride else _cut(data, window, stride)
    return whole + (_cut(data, SHORT, SHORT_STRIDE) if len(data) > SHORT else [])


def gram_keys(data: np.ndarray) -> np.ndarray:
    """64-bit keys of all q-grams of a byte array."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    a = np.ndarray((n,), "<u8", data, 0, (1,)).copy()
    a *= np.uint64(0x9E3779B97F4A7C15)
    a ^= np.ndarray((n,), "<u4", data, 8, (1,)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= a >> np.uint64(31)
    a *= np.uint64(0xD6E8FEB86659FD93)
    return a


@dataclass
class Index:
    """Windows of a block of benchmark texts and the places of their q-grams; the items of texts under SHORTEST bytes by text."""

    items: list[list[int]]  # of each window; equal windows are one
    texts: np.ndarray  # windows x longest, padded
    sizes: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray  # least shared q-grams
    keys: np.ndarray  # distinct, ascending
    first: np.ndarray  # into the places, one more than keys
    window: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    whole: dict[bytes, list[int]]


def index_of(block: list[tuple[int, bytes]]) -> Index | None:
    """block: item_id and normalised text."""
    whole: dict[bytes, list[int]] = {}
    for i, data in block:
        if 0 < len(data) < SHORTEST:
            whole.setdefault(data, []).append(i)
    items: dict[bytes, set[int]] = {}
    for i, data in block:
        for w in windows_of(data):
            items.setdefault(w, set()).add(i)
    # by size, as windows are aligned many at once, each as long as the longest of them
    parts = sorted(items, key=len)
    if not parts and not whole:
        return None
    sizes = np.array([len(w) for w in parts], np.int64)
    texts = np.zeros((len(parts), sizes.max(initial=1)), np.uint8)
    for n, w in enumerate(parts):
        texts[n, : len(w)] = np.frombuffer(w, np.uint8)
    edits = np.minimum((EDITS * sizes).astype(int), (sizes - Q) // Q)
    keys = [gram_keys(texts[n, : sizes[n]]) for n in range(len(parts))]
    window = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k in keys])
    place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(k), dtype=np.int32) for k in keys)])
    every = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[distinct >> np.uint64(64 - FILTER_BITS)] = True
    return Index([sorted(items[w]) for w in parts], texts, sizes, edits, sizes - Q + 1 - edits * Q, distinct, np.append(first, len(every)), window[order], place[order], bitmap, whole)


def aligned(own: Index, buffer: np.ndarray, window: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each window against the buffer within its band of diagonals, and where that starts and ends.

    lowest: the band's first diagonal; the band has 2(k+1) and k more on each side. The start and end in the
    buffer are free. A value is the edits so far and, in its last bits, where in the band it started.
    """
    k, sizes = own.edits[window], own.sizes[window]
    base = lowest - k
    width = int((2 * (k + 1) + 2 * k).max())
    if width > 1 << CODE:
        raise ValueError("windows are too long for their edits")
    steps = np.arange(width)
    inside = steps < (2 * (k + 1) + 2 * k)[:, None]
    far, edit = np.int32(1 << 30), np.int32(1 << CODE)
    d = np.where(inside, steps, far).astype(np.int32)
    cost = (steps << CODE).astype(np.int32)
    final = d.copy()
    for i in range(int(sizes.max())):
        at = np.clip(base[:, None] + i + steps, 0, len(buffer) - 1)
        other = (buffer[at] != own.texts[window, i][:, None]) * edit
        skip = np.concatenate([d[:, 1:], np.full((len(d), 1), far, np.int32)], 1) + edit
        e = np.minimum(d + other, skip) - cost
        d = np.where(inside, np.minimum.accumulate(e, 1) + cost, far)
        ended = sizes == i + 1
        final[ended] = d[ended]
    best = final.argmin(1)
    value = final[np.arange(len(final)), best]
    return value >> CODE, base + (value & (1 << CODE) - 1), base + sizes + best


def cells_of(own: Index, maybe: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows with cells of diagonals (window << 40 | cell), ascending, and the q-grams in each, for places of the buffer and their keys.

    What is counted at once has a bound: windows are taken in parts, by number, and the places of a part in turns.
    """
    keys, of = np.unique(at, return_inverse=True)
    sizes = own.first[keys + 1] - own.first[keys]
    parts = int(-(-sizes[of].sum() // AT_ONCE))
    postings = np.repeat(own.first[keys] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    key = np.repeat(np.arange(len(keys)), sizes)
    for part in range(parts):
        mine = own.window[postings] % parts == part
        held, size = postings[mine], np.bincount(key[mine], minlength=len(keys))
        begin, n = (np.cumsum(size) - size)[of], size[of]
        turns = np.cumsum(n) // AT_ONCE
        counted = []
        for turn in np.unique(turns):
            s = turns == turn
            total = np.repeat(np.arange(s.sum()), n[s])
            posting = held[begin[s][total] + np.arange(len(total)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])]
            window = own.window[posting].astype(np.int64)
            counted.append(np.unique((window << 40) + (maybe[s][total] - own.place[posting]) // (own.edits[window] + 1), return_counts=True))
        if len(counted) == 1:
            yield counted[0]
        else:
            cells, where = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
            yield cells, np.bincount(where, np.concatenate([n for _, n in counted])).astype(np.int64)


def hits(own: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Place of the text, item, window, edits, start and end (in the normalised text) of each window found in a text.

    The texts lie in one buffer with line ends between them, which no window has: more than any window may
    have edits, so none is found across two texts.
    """
    for t, text in enumerate(texts):
        for i in own.whole.get(text, ()):
            yield t, i, -1, 0, 0, len(text)
    if not len(own.keys):
        return
    gap = int(own.edits.max()) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = PAD + np.cumsum(sizes + gap) - sizes - gap
    buffer = np.frombuffer(b"\n" * PAD + (b"\n" * gap).join(texts) + b"\n" * PAD, np.uint8)
    keys = gram_keys(buffer)
    maybe = np.flatnonzero(own.bitmap[keys >> np.uint64(64 - FILTER_BITS)])
    at = np.searchsorted(own.keys, keys[maybe])
    at[at == len(own.keys)] = 0
    real = own.keys[at] == keys[maybe]
    maybe, at = maybe[real], at[real]
    if not len(maybe):
        return
    n = own.first[at + 1] - own.first[at]
    doc = np.searchsorted(starts, maybe, "right") - 1
    group = np.cumsum(n) // AT_ONCE  # documents are not split between groups
    group = np.maximum.reduceat(group, np.flatnonzero(np.diff(doc, prepend=-1)))[np.unique(doc, return_inverse=True)[1]]
    for g in np.unique(group):
        for cells, count in cells_of(own, maybe[group == g], at[group == g]):
            following = np.minimum(np.searchsorted(cells, cells + 1), len(cells) - 1)
            after = np.where(cells[following] == cells + 1, count[following], 0)
            # a band that begins one cell earlier holds the same q-grams as this one if that cell has none
            chosen = cells[count + after >= own.bounds[cells >> 40]]
            for part in range(0, len(chosen), 2048):
                c = chosen[part : part + 2048]
                w, low = c >> 40, (c & ((1 << 40) - 1)) * (own.edits[c >> 40] + 1)
                edits, start, end = aligned(own, buffer, w, low)
                good = edits <= own.edits[w]
                w, start, end = w[good], start[good], end[good]
                of = np.searchsorted(starts, (start + end) // 2, "right") - 1
                start, end = np.maximum(start - starts[of], 0), np.minimum(end - starts[of], sizes[of])
                for found in zip(of.tolist(), w.tolist(), edits[good].tolist(), start.tolist(), end.tolist()):
                    for item in own.items[found[1]]:
                        yield found[0], item, *found[1:]


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            best: dict[tuple[int, int], list] = {}
            for doc, item, w, edits, start, end in hits(own, [normalised(t) for t in batch.column("text").to_pylist()]):
                got = best.setdefault((doc, item), [set(), edits, start, end])
                got[0].add(w)
                got[1:] = [min(got[1], edits), min(got[2], start), max(got[3], end)]
            ids = batch.column("doc_id")
            rows = [(ids[d].as_py(), i, len(x[0]), *x[1:]) for (d, i), x in best.items()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_windows", "edits", "norm_start", "norm_end"])

    return run


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dirty = {x[0] for x in hits(index.value, [normalised(t or "") for t in batch.column("text").to_pylist()])}
            yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the benchmark, a block at a time."""
    spark = benchmark.sparkSession
    block, size = [], 0
    for r in benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((r.item_id, normalised(r.text)))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            if index := index_of(block):
                yield spark.sparkContext.broadcast(index)
            block, size = [], 0
    if index := index_of(block):
        yield spark.sparkContext.broadcast(index)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, edits, norm_start, norm_end for each text of docs that has a window of a benchmark text.

    n_windows counts different windows, edits is the least of theirs, norm_start and norm_end the bytes of the normalised text from the first
    to the last. Null and empty texts have no match; benchmark texts under SHORTEST bytes are matched by texts
    that equal them; those without text or id are never matched. Repeated rows give their matches each. Further columns are left out; empty
    tables give no rows. The benchmark is searched in blocks of BLOCK_BYTES, each against all documents.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    out = "doc_id long, item_id long, n_windows long, edits long, norm_start long, norm_end long"
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = spark.createDataFrame([], out)
    for index in _blocks(benchmark):
        found = found.unionByName(read.mapInArrow(_search(index), out))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which find_leaks finds nothing, with all their columns."""
    common.small_batches(docs.sparkSession)
    for index in _blocks(benchmark):
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
