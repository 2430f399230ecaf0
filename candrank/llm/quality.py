"""Quality rules: lines that many documents of a host share are removed, and documents that lose too much are rejected.

DataFrame functions only. Lines are normalised, hashed and counted over the host's documents of different text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_SHARE = 0.3
MAX_LINE_DOCS = 5  # a host's line is above the limit in more documents than this, whatever the host's size
LONG_LINE = 50  # words; a line of so many is hardly written twice
MAX_LONG_LINE_DOCS = 2  # the limit for long lines
MIN_KEPT_SHARE = 0.5  # a document that keeps less of its words is depleted


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised(line: Column) -> Column:
    """Lower case, white space as single spaces. Digits stay: rows of a table that differ in their numbers only are different lines."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def repeated_words(hashes: Column, windows: Column) -> Column:
    """Words that lie in windows found more than once: places of equal neighbours among the sorted windows, merged."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # an array of (hash, place), each beside its neighbours
    beside = F.arrays_zip(
        ranked.alias("x"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(ranked, 1, F.size(ranked) - 1)).alias("a"),
        F.concat(F.slice(ranked, 2, F.size(ranked)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("b"),
    )
    equal = F.filter(beside, lambda z: F.coalesce(z["x"]["h"] == z["a"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["b"]["h"], F.lit(False)))
    places = F.array_sort(F.transform(equal, lambda z: z["x"]["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def host_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")


def content_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """row, doc_id, host, content and the base measures, with the lines' hashes and words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", host_of(docs).alias("host"), text.alias("text"))
    split = read.select(
        "row", "doc_id", "host", content_of(F.col("text")).alias("content"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "row", "doc_id", "host", "content", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("n"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    last = F.size("hashes") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    seen = hashed.withColumn("windows", windows)
    repeat = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(repeated_words(F.col("hashes"), F.col("windows")))
    out = seen.withColumn("n_repeat_words", repeat).drop("hashes", "windows")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words")))


def frequent_lines(measured: DataFrame, max_docs: int, max_long_docs: int) -> DataFrame:
    """host, line, keeper: the lines above the limits, and the content hash of the document that keeps them."""
    lines = measured.select("host", "content", F.explode("lines").alias("x")).select("host", "content", "x.line", "x.n")
    per_line = lines.groupBy("host", "line", "content").agg(F.max("n").alias("words")).groupBy("host", "line").agg(F.count("*").alias("n"), F.min("content").alias("keeper"), F.max("words").alias("words"))
    return per_line.where(F.col("n") > F.when(F.col("words") >= LONG_LINE, max_long_docs).otherwise(max_docs)).select("host", "line", "keeper")


def judged(docs: DataFrame, max_docs: int = MAX_LINE_DOCS, max_long_docs: int = MAX_LONG_LINE_DOCS, min_kept: float = MIN_KEPT_SHARE) -> tuple[DataFrame, DataFrame]:
    """The measures with kept, and for each row the hashes of its lines that are removed (rows with such lines only)."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    measured = scratch.keep(measures(docs), "measured")
    frequent = frequent_lines(measured, max_docs, max_long_docs)
    lines = measured.select("row", "host", "content", F.explode("lines").alias("x")).select("row", "host", "content", "x.line", "x.n")
    lost = lines.join(frequent, ["host", "line"]).where(F.col("content") != F.col("keeper")).groupBy("row").agg(F.sum("n").alias("lost"), F.collect_set("line").alias("removed"))
    lost = scratch.keep(lost, "lost")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    kept = ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_kept * F.col("n_words"))
    out = measured.drop("lines").join(lost.select("row", "lost"), "row", "left").withColumn("kept", kept)
    return out, lost.select("row", "removed")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs(doc_id, text, source, ...).

    A line (normalised: case and white space, not digits) is above the limits if it is in more than max_docs of
    its host's documents, or has LONG_LINE words and is in more than max_long_docs of them; a line in just so
    many stays. Documents of the same text count once, and the one with the smallest content hash keeps the line. A document is kept if it passes the base rules and
    what it keeps is at least 20 words and min_kept of its words. Null text is empty, null source the host '';
    repeated rows keep a row each; further columns are left out; an empty table gives no rows.
    """
    return judged(docs, **limits)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame, **limits) -> DataFrame:
    """The columns of docs, for kept documents, without the removed lines; n_chars follows the text.

    Repeated rows stay each. Names that begin with two underscores are used inside.
    """
    own = docs.columns
    verdict, removed = judged(docs, **limits)
    marks = verdict.where("kept").select("row", "doc_id", F.xxhash64("host", "content").alias("__key")).join(removed, "row", "left")
    marks = marks.groupBy("doc_id", "__key").agg(F.first("removed").alias("__removed"))
    read = docs.withColumn("__key", F.xxhash64(host_of(docs), content_of(F.coalesce("text", F.lit("")))))
    out = common.by_key(read, marks, "inner")
    gone = F.col("__removed")
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normalised(x)))), "\n"))
    out = out.withColumn("text", text)
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*own)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS content, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, i - before)) AS n FROM (SELECT r, i, lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) AS before FROM rep) GROUP BY r),
l AS (SELECT r, host, content, unnest(lines) AS line FROM w),
nl AS (SELECT r, host, content, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
        len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
above AS (SELECT host, line, min(content) AS keeper FROM nl GROUP BY host, line HAVING count(DISTINCT content) > CASE WHEN max(n) >= 50 THEN 2 ELSE 5 END),
lost AS (SELECT nl.r, sum(nl.n) AS lost FROM nl JOIN above a ON nl.host = a.host AND nl.line = a.line WHERE nl.content <> a.keeper GROUP BY nl.r),
m AS (SELECT w.r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.lost, 0) AS lost FROM w LEFT JOIN cov ON w.r = cov.r LEFT JOIN lost ON w.r = lost.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND n_words - lost >= 20 AND n_words - lost >= 0.5 * n_words) AS kept FROM m
"""
