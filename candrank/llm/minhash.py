"""Near duplicates by a join of MinHash signatures on their coordinates.

A distinct shingle set has 64 coordinates, each the least of its hashes under one permutation, and is posted
under every pair of coordinate and value. Two sets agree in a coordinate with a probability of their Jaccard
similarity, so pairs of the least similarity share MATCHES postings or more but for one in a million. Lists are
merged by prefix and skip: of a set's shared lists, rarest first, all but the last MATCHES - 1 are merged, as two
sets with so many lists in common meet in one of these; sets with fewer shared lists are passed over, and the
long lists that are skipped are counted from the signatures of the pairs that were found. Pairs with enough
matches are confirmed on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common
from candrank.llm.graph import components
from candrank.llm.near_duplicates import words_of

SEED = 42
SHINGLE = 2
PERCENT = 80
COORDINATES = 64
MISS = 1e-6  # the chance that a pair just at the least similarity has fewer matches than are asked for
PAIRED = 16  # sets of a list that are compared pair by pair; longer lists against one of their sets, then what is left in blocks
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20  # of a block
COLUMNS = 4096  # shingles that are multiplied at a time
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def least_matches(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The most matches that a pair of the similarity has with a chance of 1 - miss."""
    s, below, t = percent / 100, 0.0, 0
    while (below := below + comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)) <= miss:
        t += 1
    return max(t, 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """The distinct runs of k words as ascending 64-bit hashes; fewer words are one run of their own kind."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64, len(words))
    runs = len(words) - k + 1
    x = np.full(max(runs, 1), min(len(words), k), np.uint64)
    for j in range(min(len(words), k)):
        x = _mixed(x * _MIX[0] + h[j : j + len(x)])
    return np.unique(x)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each permutation the upper half of the least of the hashes."""
    out = np.full(len(a), ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[at : at + 1024, None] * a + b).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(shingle: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.random.default_rng(11)
        a, b = r.integers(0, 1 << 64, coordinates, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 64, coordinates, dtype=np.uint64)
        for batch in batches:
            content, n, sig, grams = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(words_of(text), shingle)
                grams.append(own.tobytes())
                content.append(xxhash.xxh3_128_digest(grams[-1]))
                n.append(len(own))
                sig.append(signature(own, a, b).view(np.int32) if len(own) else np.zeros(0, np.int32))
            ends = np.cumsum([0, *map(len, sig)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *sig]))), pa.array(grams, pa.binary())],
                ["row", "doc_id", "content", "n", "sig", "grams"],
            )

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _enough(least: int):
    """The pairs whose signatures agree in least coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                match = (_signatures(batch.column("sig_a")) == _signatures(batch.column("sig_b"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(match >= least))

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("grams_a", "grams_b")))
            yield batch.select(["a", "b"]).filter(pa.array([_alike(x, y, percent) for x, y in sets], pa.bool_()))

    return run


def intersections(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ours shares with each of theirs: products of 0/1 matrices, some shingles of both sides at a time."""
    out = np.zeros((len(ours), len(theirs)), np.float32)
    sides = [(np.repeat(np.arange(len(x)), [len(y) for y in x]), np.concatenate([np.zeros(0, np.uint64), *x])) for x in (ours, theirs)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    found = []
    for row, gram in sides:
        at = np.searchsorted(both, gram)
        there = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == gram) if len(both) else np.zeros(len(gram), bool)
        order = np.argsort(at[there], kind="stable")
        found.append((row[there][order], at[there][order]))
    for start in range(0, len(both), COLUMNS):
        dense = []
        for (row, at), n in zip(found, out.shape):
            lo, hi = np.searchsorted(at, (start, start + COLUMNS))
            x = np.zeros((n, min(COLUMNS, len(both) - start)), np.float32)
            x[row[lo:hi], at[lo:hi] - start] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def _between(percent: int):
    """Links between the two sides of a tile that join what is not joined yet, fewer than it has sets."""

    def run(tile: pa.Table) -> pa.Table:
        rest, row, root, n = (tile.column(c).to_numpy() for c in ("rest", "row", "root", "n"))
        grams = [np.frombuffer(x, np.uint64) for x in tile.column("grams").to_pylist()]
        ours, theirs, root = np.flatnonzero(rest), np.flatnonzero(~rest), root.copy()
        both = intersections([grams[i] for i in ours], [grams[j] for j in theirs])
        near = 100 * both >= percent * (n[ours][:, None] + n[theirs][None, :] - both)
        a, b = [], []
        for i, x in enumerate(ours.tolist()):
            for y in theirs[near[i]].tolist():
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    a.append(int(row[x]))
                    b.append(int(row[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def prefix_lists(nodes: DataFrame, least: int, scratch: common.Scratch) -> DataFrame:
    """row, n, weight, key: the lists under which each set of nodes(row, n, sig) is merged; weight sums the lengths of all its shared lists."""
    value = F.col("v").cast("long").bitwiseAND((1 << 32) - 1)
    posts = nodes.select("row", "n", F.posexplode("sig").alias("i", "v")).select("row", "n", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(value).alias("key"))
    lengths = scratch.keep(posts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "lengths")
    shared = common.joined_apart(posts, lengths.withColumn("length", F.col("m")), "key")
    own = shared.groupBy("row").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("length", "key"))).alias("lists"))  # one for each coordinate at most
    merged = own.where(F.size("lists") >= least).select("row", "n", F.aggregate("lists", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("weight"), F.explode(F.slice("lists", 1, F.size("lists") - (least - 1))).alias("x"))
    return merged.select("row", "n", "weight", "x.key")


def candidates(prefix: DataFrame, percent: int, paired: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of sets that a short list holds, with those of a long list and its set of the most matches; and row, key of the long lists.

    Of long lists with the same members one is kept.
    """
    lists = prefix.groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct("weight", (-F.col("row")).alias("less"), "n")).alias("lead"), F.bit_xor(F.xxhash64("row")).alias("members")).where("m > 1")
    lists = scratch.keep(lists, "lists")
    once = lists.where(F.col("m") > paired).groupBy("m", "members").agg(F.min("key").alias("key"))
    short = prefix.join(lists.where(F.col("m") <= paired).select("key"), "key")
    inside = short.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("row", "n"))).alias("s"))
    pairs = inside.select(F.expr("explode(flatten(transform(sequence(0, size(s) - 2), i -> transform(slice(s, i + 2, size(s)), y -> struct(s[i] AS a, y AS b)))))").alias("p")).select("p.a", "p.b")
    long = common.joined_apart(prefix.select("row", "n", "key"), lists.join(once.select("key"), "key", "left_semi").select("key", "m", "lead"), "key")
    long = scratch.keep(long, "long")
    stars = long.select(F.struct((-F.col("lead.less")).alias("row"), "lead.n").alias("a"), F.struct("row", "n").alias("b")).where("a.row <> b.row")
    sized = pairs.unionByName(stars).where(100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    return sized.select(F.least("a.row", "b.row").alias("a"), F.greatest("a.row", "b.row").alias("b")).distinct(), long.select("row", "n", "key")


def left_links(signed: DataFrame, long: DataFrame, found: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame | None:
    """The links that long lists have beside those found; None where each such list is one component already.

    A list's rest, all sets outside its largest component, is compared with all its sets, in tiles of two
    blocks, so that no link between different components is passed over.
    """
    at = long.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    parts = at.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("m")).where("parts > 1").drop("parts")
    members = scratch.keep(common.joined_apart(at, mixed, "key").withColumn("rest", F.col("root") != F.col("main")).drop("main"), "members")
    if members.isEmpty():
        return None
    rows = scratch.keep(members.select("row").distinct(), "rows")
    data = scratch.keep(signed.select("row", "grams").join(common.sized(rows), "row", "left_semi"), "data")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(8 * size / BLOCK_BYTES)).cast("int")
    other = F.when(F.col("rest"), F.col("n"))
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), blocks(F.count("*"), F.sum("n")).alias("n_all"), blocks(F.count(other), F.sum(other)).alias("n_rest"))
    cut = common.joined_apart(members, sizes, "key")
    mine = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    theirs = cut.select("key", "row", "root", "n", F.lit(False).alias("rest"), mine(F.col("n_all")).alias("x"), every(F.col("n_rest")).alias("y"))
    ours = cut.where("rest").select("key", "row", "root", "n", "rest", every(F.col("n_all")).alias("x"), mine(F.col("n_rest")).alias("y"))
    return theirs.unionByName(ours).join(data, "row").groupBy("key", "x", "y").applyInArrow(_between(percent), "a long, b long")


def set_links(signed: DataFrame, nodes: DataFrame, percent: int, coordinates: int, paired: int, scratch: common.Scratch) -> DataFrame:
    """node, root of the sets that are linked with others."""
    spark, least = signed.sparkSession, least_matches(coordinates, percent)
    prefix = scratch.keep(prefix_lists(nodes, least, scratch), "prefix")
    pairs, long = candidates(prefix, percent, paired, scratch)
    pairs = scratch.keep(pairs, "pairs")
    ends = lambda pairs, name: scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), name)
    sig = scratch.keep(nodes.select("row", "sig").join(common.sized(ends(pairs, "ends")), "row", "left_semi"), "sig")
    near = scratch.keep(pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(_enough(least), "a long, b long"), "near")
    grams = scratch.keep(signed.select("row", "grams").join(common.sized(ends(near, "needed")), "row", "left_semi"), "grams", "lz4")
    links = scratch.keep(near.join(grams.toDF("a", "grams_a"), "a").join(grams.toDF("b", "grams_b"), "b").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    for name in ("lengths", "sig", "grams", "pairs"):
        scratch.drop(name)
    found = scratch.keep(components(links, common.Scratch(spark, "minhash-links")), "found")
    left = left_links(signed, long, found, percent, scratch)
    if left is not None:
        found = scratch.keep(components(links.unionByName(scratch.keep(left, "left")), common.Scratch(spark, "minhash-links")), "found-left")
    return found


def minhash_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, paired: int = PAIRED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    Words are lower-cased (A-Z); a document's set is its distinct runs of shingle words, or all its words as
    one run if they are fewer. Sets are linked if 100 times what both have is percent times what either has, at
    least; component_id is the smallest doc_id reachable, itself included, and kept says that it is the row's
    own. Null, empty and blank texts have no shingles and are linked with nothing, not even each other. Null ids
    are passed over in components and are the result only where there is no other; such a row is kept. Repeated
    rows keep a row each; further columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "minhash")
    signed = scratch.keep(common.numbered(docs).mapInArrow(_signed(shingle, coordinates), "row long, doc_id long, content binary, n long, sig array<int>, grams binary"), "signed", "lz4")
    same = scratch.keep(signed.where("n > 0").groupBy("content").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("m")), "same")
    nodes = scratch.keep(signed.select("row", "n", "sig").join(common.sized(same.select(F.col("node").alias("row"))), "row", "left_semi"), "nodes")
    found = set_links(signed, nodes, percent, coordinates, paired, scratch)
    placed = scratch.keep(same.join(found, "node", "left").select("content", "m", "first", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    of = common.joined_apart(placed.select("content", "root", F.col("m").alias("copies")), least, "root").select("content", F.col("copies").alias("m"), "component_id")
    of = scratch.keep(of, "components")
    rows = scratch.keep(signed.select("doc_id", "n", "content"), "rows")
    scratch.drop("signed")
    scratch.drop("nodes")
    filled = common.joined_apart(rows.where("n > 0"), of, "content").select("doc_id", "n", "component_id")
    out = filled.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(common.documents(spark, sf_dir))
