"""Secret scans: fixed patterns, and strings near sensitive words that a primed zstandard cannot compress.

A candidate's novelty is its marginal compressed size: the bytes that it adds to its surrounding text, with a
dictionary of code words and of the words that stand in such surroundings and in several candidates over the
whole corpus, for each of its characters. It is taken twice: with its letters as they are, which tells what of it the
dictionary and the surroundings repeat, and with letters coded by their frequency beside a sample of plain text, which
tells words that are new from drawn letters. Names and paths are low in one or the other; keys are not. Other strings
that look drawn are no part of surroundings or dictionary, so a secret is as novel in its copies.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of any length, those under 24 dropped
ASSIGN_WORDS = ("passw", "secret", "token", "key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{8,}")
SHORT = 16  # shorter strings are candidates with both letters and digits only
_PART = "(?:[A-Z]?[a-z]{1,15}(?:[A-Z][a-z]{1,15})*|[A-Z]{1,8}|)[0-9]{0,4}"
NAME = re.compile(f"{_PART}(?:[+/_-]{_PART})*")  # words, each with a number at its end at most, are no candidate of any length
EDGE = re.compile(r"[A-Za-z0-9+/_-]+")
GAP = re.compile(r"""(?:[\s"'+,;=|>#*]|\\[nr]){1,32}""")  # between the lines of one string
TAIL = re.compile(r"[^\S\n]{0,32}(?:\n|\\[nr])\s{0,32}([A-Za-z0-9+/_-]{1,15}=*)(?=\s|\\[nr]|[\"']|$)")  # the last line of one, shorter than a candidate
DRAWN = re.compile(r"(?=[A-Za-z]*[0-9])[A-Za-z0-9]{8,}|[A-Za-z]{16,}")  # in a candidate: not put together from words
NUMBER = re.compile(r"(?<=[A-Za-z_/-]{4})[0-9]{1,4}$")  # at the end of a name: no part of what is judged
PLAIN_WORD = "^[A-Za-z_]+[0-9]{0,3}$"  # what the dictionary takes from surroundings
NAME_PARTS = ("[A-Z]?[a-z]{3,15}", "[A-Za-z/_-]{6,48}")  # ... and from candidates
AROUND = 48  # characters on each side that are its surroundings
NEAR = 96  # characters on each side in which a sensitive word counts
SENSITIVE = re.compile(r"pass|pwd|secret|token|api|key|auth|credential|bearer|private|access|signature|session|cookie")
NOVEL = 0.75  # coded bytes for each character
NOVEL_DRAWN = 0.58  # ... of strings in which the kind of character changes often, or of lower-case letters alone
CHANGES = 0.2  # such changes for each character
UNSEEN = 0.9  # bytes for each character, letters as they are
UNREPEATED, FRAME = 0.8, 4  # ... beside the surroundings, where a block's form can take so many bytes more or less
LONG = 24  # longer strings are coded by letters of their own: they count as novel, too, if these are even
EVEN = 0.95  # a string's entropy, as a share of what evenly drawn letters of its alphabet have
# Fixed value: plain text with all letters, beside which a string is coded.
SAMPLE = (
    "it was the best of times and so they went along a quiet river where some old houses stood between tall trees and people there would often talk about rain or what might come after harvest while children ran down "
    "to see boats pass by slowly under an arched bridge made from grey stone which had been brought up many years before from quarries far beyond those hills nobody knew quite how long ago that must have been but "
    "everyone agreed on one thing namely how well built it looked even now; Her Garden, His Book. Most Days 1 2 3 4 5 6 7 8 9 0\nABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 +/_- the quick letter "
    "jar zebra box of every vowel wind and key flew up to her in a hazy jungle view; Quartz Inks Jot Vex Zero Yes Ohm Kelp Lamp Under Near\n"
)
ALPHABETS = tuple(map(re.compile, ("[0-9a-fA-F]+", "[0-9a-z_-]+", "[0-9A-Z_-]+", ".+")))
LETTERS = (16, 36, 36, 64)
DICTIONARY_WORDS = 4096  # corpus words in the dictionary, the most frequent ones of at most 32 bytes
# Fixed value: words of code and configuration.
CODE_WORDS = (
    "abstract await boolean break case catch class const continue default define delete double else enum except export extends false final finally float for from function global if implements import include int "
    "interface lambda let long module namespace new none null object package private protected public raise return self short static string struct super switch this throw true try typedef union using var virtual void "
    "while with yield access account address admin api application authorization bearer bucket certificate client config connection content cookie credential database default description directory endpoint environment "
    "example file header host http https identifier index key local login message method name number option parameter password path port project property request resource response role root schema secret server service "
    "session signature source status system table test timestamp token type url user username value version www com org net html json yaml xml sha256 md5 base64 utf8 uuid"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of each match of the fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands before and after a string, without the other strings there that look drawn: a secret is no surrounding of its copy."""
    strip = lambda x: CANDIDATE.sub(lambda m: "" if DRAWN.search(m[0]) else m[0], x)
    lo, hi = max(0, a - AROUND), b + AROUND
    before, after = text[lo:a], text[b:hi]
    if lo and (m := EDGE.match(before)) and EDGE.match(text, lo - 1):  # cut strings could be shorter than candidates
        before = before[m.end() :]
    if (m := EDGE.search(after[::-1])) and m.start() == 0 and EDGE.match(text, hi):
        after = after[: len(after) - m.end()]
    return strip(before), strip(after)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Strings of letters and digits, of SHORT characters or more, or of eight with both, that are no names, near a sensitive word, outside the spans that are known already.

    Strings with little but line ends between them, as the lines of a key, are near a sensitive word if one of
    them is; the short end of such lines goes with the last.
    """
    out: list[dict] = []
    found = list(CANDIDATE.finditer(text))
    at = 0
    while at < len(found):
        block = [found[at]]
        while at + len(block) < len(found) and GAP.fullmatch(text, block[-1].end(), found[at + len(block)].start()):
            block.append(found[at + len(block)])
        at += len(block)
        if len(block) > 1 and len(block[-1][0]) < SHORT and len(block[-2][0]) == len(block[0][0]) and TAIL.match(text, block[-2].end()):
            block.pop()
        known = [any(s < m.end() and m.start() < e for s, _, e in spans) for m in block]
        near = any(known) and len(block) > 1 or any(SENSITIVE.search(text[max(0, m.start() - NEAR) : m.start()].lower()) or SENSITIVE.search(text[m.end() : m.end() + NEAR].lower()) for m in block)
        if not near:
            continue
        for m, skip in zip(block, known):
            if skip or NAME.fullmatch(m[0]) or len(m[0]) < SHORT and not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            a, b = m.span()
            if len(block) > 1 and m is block[-1] and len(m[0]) == len(block[0][0]) and (tail := TAIL.match(text, b)):
                b = tail.end(1)
            before, after = surroundings(text, a, b)
            out.append({"start": a, "end": b, "before": before, "string": text[a:b], "after": after})
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "row long, doc_id long, base array<struct<start:long,kind:int,end:long>>, near array<struct<start:long,end:long,before:string,string:string,after:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_NEAR = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("before", pa.string()), ("string", pa.string()), ("after", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        base = [base_spans(t) for t in texts]
        near = [candidates(t, s) for t, s in zip(texts, base)]
        spans = [[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(spans, _SPAN), pa.array(near, _NEAR)], ["row", "doc_id", "base", "near"])


def compressor(words: list[str], plain: bool = False) -> zstandard.ZstdCompressor:
    """Primed with the words, the first of them nearest to what is compressed. plain leaves letters as they are: the fast strategy does not code them."""
    code = CODE_WORDS.split()
    raw = "\n".join([*reversed(words), *(w.capitalize() for w in code), *code, ""]).encode()
    level = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(raw), write_content_size=False, write_checksum=False)
    fast = {"strategy": zstandard.STRATEGY_FAST, "target_length": 1, "min_match": 4, "search_log": 1}
    params = zstandard.ZstdCompressionParameters(window_log=level.window_log, chain_log=level.chain_log, hash_log=level.hash_log, write_content_size=False, write_checksum=False, **fast) if plain else level
    primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=params)


def added(own: zstandard.ZstdCompressor, around: str, string: str) -> int:
    """Marginal compressed bytes of the string."""
    return len(own.compress((around + string).encode())) - len(own.compress(around.encode()))


def even_entropy(string: str) -> float:
    """Bytes of entropy for each character, or infinite if the letters are less even than drawn ones of their alphabet."""
    string = re.sub("[^A-Za-z0-9+/_-]", "", string)
    n, counts = len(string), Counter(string)
    bits = math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n
    size = next(k for k, p in zip(LETTERS, ALPHABETS) if p.fullmatch(string))
    if size == 16 and not re.search("[0-9]", string):
        size = 64
    drawn = math.log2(min(size, n)) if n < size else math.log2(size) - (size - 1) / (2 * n * math.log(2))
    return bits / 8 if bits >= EVEN * drawn else math.inf


_KIND = str.maketrans({c: k for k, group in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"), (None, "+/_-")) for c in group})


def is_novel(plain: zstandard.ZstdCompressor, coded: zstandard.ZstdCompressor, before: str, string: str, after: str, least: float) -> bool:
    """Little of the string is in the dictionary or its surroundings, and its letters are rarer than a word's, or even as drawn ones; a number at its end does not count.

    least is the coded bytes a character that a string of few changes between capitals, other letters and digits adds.
    """
    bare = NUMBER.sub("", string)
    n = len(bare)
    if added(plain, "", bare) < UNSEEN * n or added(plain, f"{before}\n{after}\n", bare) < UNREPEATED * n - FRAME:
        return False
    kinds = bare.translate(_KIND)
    often = sum(x != y for x, y in zip(kinds, kinds[1:])) >= CHANGES * n or not re.search("[A-Z0-9]", bare[1:])
    if added(coded, SAMPLE, bare) >= (least * NOVEL_DRAWN / NOVEL if often else least) * n:
        return True
    return n > LONG and even_entropy(bare) < math.inf


def _judge(words: list[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, coded = compressor(words, True), compressor(words)
        for batch in batches:
            rows: list[tuple] = []
            for base, near in zip(batch.column("base").to_pylist(), batch.column("near").to_pylist()):
                spans = [(x["start"], x["kind"], x["end"]) for x in base]
                new = [(x["start"], 3, x["end"]) for x in near if is_novel(plain, coded, x["before"], x["string"], x["after"], least)]
                n = [sum(k == i for _, k, _ in spans) for i in range(3)]
                every = sorted(spans + new)
                rows.append((*n, len(new), hashlib.sha256(written(spans).encode()).hexdigest(), written(every), [{"start": a, "kind": k, "end": b} for a, k, b in every]))
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (_SPAN,)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["row", "doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "found"])

    return run


def _scanned(docs: DataFrame, least: float) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "secrets")
    found = scratch.keep(docs.mapInArrow(_scan, FOUND), "found")
    near = found.select(F.explode("near").alias("x")).select("x.before", "x.string", "x.after")
    around = near.select("before", "after").distinct()  # copies of a text count once
    around = around.select(F.explode(F.split(F.concat_ws(" ", "before", "after"), r"[^A-Za-z0-9_]+")).alias("word"))
    around = around.where((F.length("word") > 2) & (F.octet_length("word") <= 32) & F.col("word").rlike(PLAIN_WORD))
    # parts of identifiers: a drawn string's letters are found in its copies alone, which count once
    named = near.select("string").distinct().select(F.explode(F.array_distinct(F.concat(*[F.regexp_extract_all("string", F.lit(p), F.lit(0)) for p in NAME_PARTS]))).alias("word"))
    common_words = around.unionByName(named).groupBy("word").count().where("count > 2").orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS)
    words = [r.word for r in common_words.collect()]  # at most DICTIONARY_WORDS
    spans = "array<struct<start:long,kind:int,end:long>>"
    return found.mapInArrow(_judge(words, least), f"row long, doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, found {spans}")


def find_secrets(docs: DataFrame, least: float = NOVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans for each row of docs(doc_id, text, ...).

    spans has kind:start:end of every finding in code points, end exclusive, by start and then kind, and
    base_sha256 the SHA-256 of those of the fixed patterns. A string with no sensitive word within NEAR characters, in or
    beside the lines that adjoin it, is not judged, nor is one under eight characters, one under SHORT without
    both letters and digits, or one that reads as words with numbers; other punctuation than +/_- parts strings. Null text is empty and has none. Repeated rows keep a row each; further columns are left out; an empty table gives no rows.
    """
    return _scanned(common.numbered(docs), least).drop("row", "found")


def _cut(text: str | None, spans: list[dict], mark: str) -> str | None:
    """The text with the mark for each run of overlapping spans."""
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], mark]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def _redact(mark: str, text_at: int, size_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.select([n for n in batch.schema.names if n != "__found"])
            found = batch.column("__found").to_pylist()
            texts = [_cut(t, s or [], mark) for t, s in zip(batch.column("text").to_pylist(), found)]
            table = table.set_column(text_at, "text", pa.array(texts, pa.string()))
            if size_at is not None:
                sizes = [len(t) if s and t is not None else n for t, s, n in zip(texts, found, batch.column("n_chars").to_pylist())]
                table = table.set_column(size_at, "n_chars", pa.array(sizes, pa.int64()))
            yield table

    return run


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", least: float = NOVEL) -> DataFrame:
    """docs with the mark in place of each finding; n_chars follows the text. All rows and columns stay; null text stays null.

    Names that begin with two underscores are used inside.
    """
    own = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    read = keyed.select(F.col("__key").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = _scanned(read, least).where(F.size("found") > 0).groupBy("doc_id", F.col("row").alias("__key")).agg(F.first("found").alias("__found"))
    spans = common.Scratch(docs.sparkSession, "secrets").keep(spans, "spans")
    joined = common.by_key(keyed, spans, "left").select(*own, "__found")
    return joined.mapInArrow(_redact(mark, own.index("text"), own.index("n_chars") if "n_chars" in own else None), docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.documents(spark, sf_dir))
