"""URL filters: rules decide where one fits, and gradient-boosted trees on lexical features decide the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRAIN_ROWS = 50_000  # distinct labelled urls that the trees are fitted on at most, those of each label with the smallest hashes
TREES, DEPTH = 12, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "entropy", "hyphens", "params", "equals", "fragment", "suffix_pages", "suffix_hosts")


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def ruling(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits host and path, as a struct(size, rule, verdict), or null. The rules are few: each is an expression."""
    fits = []
    for verdict, rule in rules:
        at, _, rest = rule.partition("/")
        own = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + rest)
        fits.append(F.when(own, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits for each character of a text."""
    letters = F.split(text, "")
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def features(pages: DataFrame) -> DataFrame:
    """pages (with host and path) and the lexical features. The suffix is the host's last two labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda p: F.regexp_count(url, F.lit(p)).cast("double")
    pages = pages.withColumns({
        "suffix": F.substring_index("host", ".", -2), "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"), "depth": F.size(F.split("path", "/")).cast("double"), "digits": count("[0-9]") / F.greatest(F.length(url), F.lit(1)), "entropy": entropy(url),
        "hyphens": count("-"), "params": count("[?&][^=&#]+"), "equals": count("="), "fragment": count("#"),
    })
    known = pages.groupBy("suffix", "host").agg(F.count("*").alias("n")).groupBy("suffix").agg(F.log1p(F.sum("n")).alias("suffix_pages"), F.log1p(F.count("*")).alias("suffix_hosts"))
    return pages.join(known, "suffix")


def sampled(labelled: DataFrame, train_rows: int, scratch: common.Scratch) -> tuple[DataFrame, list[float]]:
    """At most train_rows distinct urls of labelled with label, weight and features, and the labels that there are.

    A url counts as often as it is found, whatever their number, and takes one row. Each label may have half of
    the rows and what the other leaves; a label's weights add up to its rows, about, however few are drawn.
    """
    urls = scratch.keep(labelled.groupBy("url", "label", *FEATURES).agg(F.count("*").alias("n")), "urls")
    found = {r.label: r.n for r in urls.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two at most
    parts = []
    for label, n in sorted(found.items()):
        k = min(n, max(train_rows // 2, train_rows - sum(found.values()) + n, 1))
        drawn = urls.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(k)
        parts.append(drawn.select("label", (F.col("n") * (n / k)).alias("weight"), *FEATURES))
    return reduce(DataFrame.unionByName, parts, urls.select("label", F.lit(1.0).alias("weight"), *FEATURES).limit(0)), sorted(found)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A model for labelled(url, label, features...), or the only label there is, or None."""
    scratch = common.Scratch(labelled.sparkSession, "url-filter")
    sample, labels = sampled(labelled, train_rows, scratch)
    if len(labels) < 2:
        return labels[0] if labels else None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(scratch.keep(sample, "sample"))
    return GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(vectors)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for each row of pages(page_id, url, ...).

    The urls that a rule fits are the labelled ones: their verdict is the rule's, and the trees learn from
    them. All others are blocked where the trees find that likelier. Null urls and those without :// have an
    empty host and path, fit no rule and are judged like any other. With labels of one kind only, that is the
    verdict; with none all are allowed. block_score is null where no model was fitted. Repeated rows keep a
    row each; further columns are left out; an empty table gives no rows.
    """
    known = parts(pages.select("page_id", "url")).withColumn("fit", ruling(rules))
    known = common.Scratch(pages.sparkSession, "url-filter").keep(features(known), "features")
    labelled = known.where(F.col("fit").isNotNull()).withColumn("label", (F.col("fit.verdict") == "block").cast("double"))
    model = fit(labelled, train_rows)
    if model is None or isinstance(model, float):
        known = known.withColumn("block_score", F.lit(None).cast("double"))
        other = F.lit("block" if model == 1.0 else "allow")
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(known)
        known = model.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
        other = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return known.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), other).alias("verdict"), "block_score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"))
