"""Near duplicates by covering locality-sensitive hashing.

Fingerprints within a radius: 64-bit SimHash and 2^(radius+1)-1 structured masks (Pagh 2016). Bit i has a
vector of radius+1 bits; mask v keeps the bits whose vector has odd parity with v. For any radius differing
bits some v is orthogonal to all of their vectors, so that the pair agrees under mask v.

Texts of a least similarity: those whose fingerprints the masks link are checked on their whole shingle sets
and joined first. At a Jaccard similarity of 0.8 on five-word shingles 64-bit SimHash differs in about 10
bits and often in 16, for which masks of this kind would be 2^17; pairs beyond the radius are therefore found
by a MinHash signature whose masks are a partition of its components, by the same pigeonhole guarantee, with
the same check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candrank.llm import common
from candrank.llm.graph import components

SEED = 42
RADIUS = 2
SHINGLE = 3
IN_BUCKET = 64  # distinct fingerprints of a bucket that are compared pair by pair
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND = 16, 4  # masks of the signature, and components in each: any pair that differs in under 16 of 64 collides
ROUNDS = 2  # the masks are taken in so many rounds; a later one checks only pairs that earlier links do not join
PAIRED = 16  # distinct texts of a bucket that are compared pair by pair; larger ones against their first texts, then what is left in blocks
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20  # of a block
ESTIMATE_SLACK = 0.25  # a pair's estimate from 64 components has a deviation of 0.05; pairs this far below are not checked, at 0.8 a few of a million


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words, joined by spaces; fewer words are one run."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return [line[a:b] for a, b in zip(starts, ends[k - 1 :].tolist())]


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; bytes.lower and bytes.split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def simhash(parts: list[bytes], seed: int = SEED) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half of the hashes."""
    if not parts:
        return 0
    digests = b"".join([xxhash.xxh64_digest(p, seed) for p in parts])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(parts)).tobytes(), "big", signed=True)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks, as signed integers."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(bits) if (v & (i % n + 1)).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(shingles(words_of(t), k)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return run


def _linked_in_bucket(radius: int):
    """Links that join what is within the radius in each bucket, each member with the smallest that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                x = np.array(sorted(members), np.int64)
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                root = np.arange(len(x))
                while True:
                    new = np.where(near, root[None, :], len(x)).min(1)
                    if (new == root).all():
                        break
                    root = new
                moved = np.flatnonzero(root != np.arange(len(x)))
                a += x[moved].tolist()
                b += x[root[moved]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, in_bucket: int = IN_BUCKET) -> DataFrame:
    """Links a, b that connect all values of distinct(fp long) within the radius; no link between different values is lost.

    Buckets of up to in_bucket values are compared whole. The values of larger ones are linked exactly through
    the words between them: two values within 2 bits have a word at one bit or less from both, and the values
    around a word are 65 at most.
    """
    if radius > 2 and in_bucket < 1 << 20:
        raise ValueError("buckets can be split exactly up to radius 2 only")
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for t, m in enumerate(masks(radius))]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.bucket")
    sizes = keyed.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "bucket"])
    inside = shared.where(F.col("n") <= in_bucket).groupBy("t", "bucket").agg(F.collect_list("fp").alias("members"))
    links = inside.select("members").mapInArrow(_linked_in_bucket(radius), "a long, b long")
    if radius > 2:
        return links
    crowded = shared.where(F.col("n") > in_bucket).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m)) for m in [*(1 << i for i in range(63)), -(1 << 63)]])).alias("word"))
    balls = around.groupBy("word").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    star = balls.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a <> b").select("a", "b")
    return links.unionByName(star if radius == 2 else star.where(F.bit_count(F.col("a").bitwiseXOR("b")) <= radius))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, in_bucket: int = IN_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row of docs(doc_id, text, ...).

    Fingerprints are linked at radius or fewer differing bits; component_id is the smallest doc_id reachable,
    itself included; null ids are passed over, and are the result only where there is no other. Null texts
    count as empty: fingerprint zero, linked like any other. Repeated rows keep a row each; further columns
    are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "simhash")
    prints = scratch.keep(common.numbered(docs).select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(fingerprint_links(distinct.select("fp"), radius, in_bucket), scratch)
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = scratch.keep(placed.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(common.documents(spark, sf_dir))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(5)
    return r.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 32, n, dtype=np.uint64)


def _signatures(k: int):
    """Each text's content hash, its fingerprint, its shingle hashes (distinct, ascending, 32 bits), signature and bucket of each mask."""
    n = BANDS * BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(n)
        for batch in batches:
            content, prints, grams, sigs, bands = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                parts = shingles(words, k)
                content.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(simhash(shingles(words, SHINGLE)))
                h = np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(p, SEED) for p in parts]), ">u8").astype(np.uint64) >> np.uint64(32)) if parts else np.zeros(0, np.uint64)
                grams.append(h.astype("<u4").tobytes())
                sig = np.full(n, (1 << 32) - 1, np.uint64)
                for at in range(0, len(h), 2048):
                    sig = np.minimum(sig, ((h[at : at + 2048, None] * a + b) >> np.uint64(16) & np.uint64((1 << 32) - 1)).min(0))
                s = sig.astype("<u4")
                sigs.append(s.tobytes())
                bands.append([xxhash.xxh64_intdigest(s[i * BAND : (i + 1) * BAND].tobytes(), i) - (1 << 63) for i in range(BANDS)] if parts else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "__key")), pa.array(content, pa.binary()), pa.array(prints, pa.int64()), pa.array(grams, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "doc_id", "__key", "content", "fp", "grams", "sig", "bands"],
            )

    return run


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, BANDS * BAND) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least)) if batch.num_rows else batch.select(["a", "b"])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _print_pairs(nodes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Pairs a < b that join all texts whose fingerprints the covering masks link: a fingerprint's texts with its first, and the first of linked ones."""
    own = nodes.where(F.size("bands") > 0).select("row", "fp")
    leads = scratch.keep(own.groupBy("fp").agg(F.min("row").alias("lead")), "leads")
    of = lambda c: leads.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}"))
    apart = fingerprint_links(leads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("lead_a").alias("x"), F.col("lead_b").alias("y"))
    pairs = own.join(leads, "fp").select(F.col("lead").alias("x"), F.col("row").alias("y")).unionByName(apart)
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _candidates(nodes: DataFrame, bands: range, paired: int, scratch: common.Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b that share a bucket of the given masks, and the rows of buckets of over paired nodes.

    Such a bucket, and each of its parts by the next mask, pairs its nodes with the first only; what that does
    not join is left to _left_links.
    """
    own = F.array(*[F.struct(F.lit(i).alias("band"), F.element_at("bands", i + 1).alias("bucket"), F.element_at("bands", (i + 1) % BANDS + 1).alias("next")) for i in bands])
    keyed = nodes.where(F.size("bands") > 0).select("row", F.explode(own).alias("x")).select("row", "x.*")
    sizes = keyed.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("row").alias("lead")).where("n > 1")
    shared = keyed.join(sizes, ["band", "bucket"])
    inside = shared.where(F.col("n") <= paired).groupBy("band", "bucket").agg(F.sort_array(F.collect_list("row")).alias("m"))
    pairs = inside.select(F.expr("explode(flatten(transform(sequence(0, size(m) - 2), i -> transform(slice(m, i + 2, size(m)), y -> struct(m[i] AS a, y AS b)))))").alias("p")).select("p.a", "p.b")
    crowded = scratch.keep(shared.where(F.col("n") > paired).drop("n"), name)
    parts = crowded.groupBy("band", "bucket", "next").agg(F.min("row").alias("first"))
    stars = crowded.select(F.col("lead").alias("a"), F.col("row").alias("b")).unionByName(crowded.join(parts, ["band", "bucket", "next"]).select(F.col("first").alias("a"), F.col("row").alias("b")))
    return pairs.unionByName(stars.where("a <> b")).distinct(), crowded.select("row", "band", "bucket")


def _between(similarity: float):
    """Links between the rest and all members of one block of each, where they are not joined yet; one for each two components."""

    def run(block: pa.Table) -> pa.Table:
        rest = np.array(block.column("rest").to_pylist(), bool)
        band = block.column("band")[0].as_py()
        row, root = (block.column(c).to_numpy() for c in ("row", "root"))
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), "<u4").reshape(-1, BANDS * BAND)
        bands = np.array(block.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)[:, :band]
        grams = [np.frombuffer(x, "<u4") for x in block.column("grams").to_pylist()]
        ours, theirs, done, a, b = np.flatnonzero(rest), np.flatnonzero(~rest), set(), [], []
        for i in ours.tolist():
            fresh = theirs[(root[theirs] != root[i]) & ~(bands[theirs] == bands[i]).any(1)]  # an earlier mask has the pair too
            for j in fresh[(sig[fresh] == sig[i]).mean(1) >= similarity - ESTIMATE_SLACK].tolist():
                two = (min(root[i], root[j]), max(root[i], root[j]))
                if two in done:
                    continue
                both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                if both >= similarity * (len(grams[i]) + len(grams[j]) - both):
                    done.add(two)
                    a.append(int(row[i]))
                    b.append(int(row[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _left_links(signed: DataFrame, crowded: DataFrame, found: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame | None:
    """The links that crowded buckets have beside those found; None where each such bucket is one component already.

    A bucket's rest, all members outside its largest component, is searched against all its members, in
    blocks of BLOCK_ROWS and about BLOCK_BYTES, so that no pair of different components is passed over.
    """
    at = crowded.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    parts = at.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band", "bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    members = scratch.keep(at.join(mixed, ["band", "bucket"]).withColumn("rest", F.col("root") != F.col("main")).drop("main"), "left-members")
    if members.isEmpty():
        return None
    rows = scratch.keep(members.select("row").distinct(), "left-rows")
    data = scratch.keep(signed.select("row", "sig", "bands", "grams").join(common.sized(rows), "row", "left_semi"), "left-data")
    weighed = members.join(data.select("row", F.octet_length("grams").alias("bytes")), "row").withColumn("other", F.when(F.col("rest"), F.col("bytes")))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    sizes = weighed.groupBy("band", "bucket").agg(blocks(F.count("*"), F.sum("bytes")).alias("n_all"), blocks(F.count("other"), F.sum("other")).alias("n_rest"))
    sized = members.join(sizes, ["band", "bucket"])
    mine = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    theirs = sized.select("band", "bucket", "row", "root", F.lit(False).alias("rest"), mine(F.col("n_all")).alias("x"), every(F.col("n_rest")).alias("y"))
    ours = sized.where("rest").select("band", "bucket", "row", "root", "rest", every(F.col("n_all")).alias("x"), mine(F.col("n_rest")).alias("y"))
    return theirs.unionByName(ours).join(data, "row").groupBy("band", "bucket", "x", "y").applyInArrow(_between(similarity), "a long, b long")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that earlier links do not join already."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("text"))


def _groups(docs: DataFrame, shingle: int, similarity: float, paired: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, __key, content of each row; and content, group_doc, lead (the doc_id and key of its first document) of each text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "similar")
    read = _keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "__key", F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.keep(read.mapInArrow(_signatures(shingle), "row long, doc_id long, __key long, content binary, fp long, grams binary, sig binary, bands array<long>"), "signed")
    same = scratch.keep(signed.groupBy("content").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("lead")), "same")
    nodes = scratch.keep(signed.select("row", "fp", "bands").join(same.select(F.col("node").alias("row")), "row", "left_semi"), "nodes")

    def confirmed(near: DataFrame, name: str) -> DataFrame:
        needed = scratch.keep(near.select(F.explode(F.array("a", "b")).alias("row")).distinct(), f"needed-{name}")
        grams = scratch.keep(signed.select("row", "grams").join(common.sized(needed), "row", "left_semi"), f"grams-{name}")
        new = near.join(grams.toDF("a", "grams_a"), "a").join(grams.toDF("b", "grams_b"), "b").mapInArrow(_verified(similarity), "a long, b long")
        new = scratch.keep(new, f"links-{name}")
        scratch.drop(f"grams-{name}")
        return new

    links, crowded = confirmed(scratch.keep(_print_pairs(nodes, scratch), "near-prints"), "prints"), None
    found = scratch.keep(components(links, common.Scratch(spark, "similar-links")), "found-prints")
    for turn in range(ROUNDS):
        pairs, many = _candidates(nodes, range(turn, BANDS, ROUNDS), paired, scratch, f"crowded-{turn}")
        pairs, crowded = scratch.keep(_apart(pairs, found), f"pairs-{turn}"), many if crowded is None else crowded.unionByName(many)
        ends = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), f"ends-{turn}")
        sig = scratch.keep(signed.select("row", "sig").join(common.sized(ends), "row", "left_semi"), f"sig-{turn}")
        near = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(_estimated(similarity - ESTIMATE_SLACK), "a long, b long")
        links = links.unionByName(confirmed(scratch.keep(near, f"near-{turn}"), str(turn)))
        scratch.drop(f"sig-{turn}")
        found = scratch.keep(components(links, common.Scratch(spark, "similar-links")), f"found-{turn}")
    left = _left_links(signed, crowded, found, similarity, scratch)
    if left is not None:
        links = links.unionByName(scratch.keep(left, "left-links"))
        found = scratch.keep(components(links, common.Scratch(spark, "similar-links")), "found-left")
    placed = same.join(found.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("content", F.coalesce("root", "node").alias("group_doc"), "lead")
    rows, placed = scratch.keep(signed.select("doc_id", "__key", "content"), "rows"), scratch.keep(placed, "placed")
    for name in ("signed", "same", "nodes"):
        scratch.drop(name)
    return rows, placed


def _first(placed: DataFrame) -> DataFrame:
    """doc_id and key of each group's first document."""
    return placed.groupBy("group_doc").agg(F.min("lead").alias("lead")).select("lead.doc_id", "lead.__key", F.lit(True).alias("__first"))


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, paired: int = PAIRED) -> DataFrame:
    """The columns of docs(doc_id, text, ...), with group_doc (row number of the group's first text) and first (does the document stay).

    Texts of the same words, and those of a Jaccard similarity of at least similarity on their shingles, are
    linked; a group is what links reach, and the document with the smallest doc_id stays (null ids come last).
    Null and empty texts form one group; of repeated rows one can stay. Columns of docs named group_doc or
    first are replaced; names that begin with two underscores are used inside. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("group_doc", "first")]
    rows, placed = _groups(docs, shingle, similarity, paired)
    marks = rows.distinct().join(placed.select("content", "group_doc"), "content").drop("content")
    marks = common.by_key(marks, _first(placed), "left")
    out = common.by_key(_keyed(docs.select(*own)), marks, "inner")
    once = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.lit(0))) == 1
    return out.select(*own, "group_doc", (F.coalesce("__first", F.lit(False)) & once).alias("first"))


def deduplicate(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, paired: int = PAIRED) -> DataFrame:
    """The rows of docs that similar_groups marks as first, with all their columns."""
    rows, placed = _groups(docs, shingle, similarity, paired)
    scratch = common.Scratch(docs.sparkSession, "similar-first")
    counted = common.by_key(rows.groupBy("doc_id", "__key").agg(F.count("*").alias("n")), _first(placed), "left")
    gone = scratch.keep(counted.where(F.col("__first").isNull()).select("doc_id", "__key"), "gone")
    repeated = scratch.keep(counted.where(F.col("__first") & (F.col("n") > 1)).select("doc_id", "__key"), "repeated")
    read = _keyed(docs)
    out = common.by_key(read, common.sized(gone), "left_anti")
    if not repeated.isEmpty():  # rows of one id and text: one of them stays
        once = common.by_key(read, common.sized(repeated), "left_semi").dropDuplicates(["doc_id", "__key"])
        out = common.by_key(out, common.sized(repeated), "left_anti").unionByName(once)
    return out.select(*docs.columns)
