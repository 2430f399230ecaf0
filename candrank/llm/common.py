"""What the text operators share: tables, scratch tables in the shared folder, Arrow maps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.sources.shared import shared_folder

# Fixed value: rows in one Arrow batch handed to Python; long texts make larger batches costly.
BATCH_ROWS = "1000"
LONG_HEAD, LONG_BYTES = 4096, 1024
HOT = 10_000  # rows of a key that are too many for one task of a join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def numbered(docs: DataFrame, *cols: str) -> DataFrame:
    """doc_id, text (null: empty) and the other cols, with a row number that tells repeated rows apart."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *cols,
    )


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of bounded size."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def frequent(counts: DataFrame, word: str, head: int, head_bytes: int) -> DataFrame:
    """The head most frequent words of counts(word, n, ...) that have head_bytes bytes at most, and the LONG_HEAD most frequent of up to LONG_BYTES.

    What they weigh is bounded by head * head_bytes + LONG_HEAD * LONG_BYTES bytes; a long word in very many texts is among them.
    """
    size = F.octet_length(word)
    most = lambda df, n: df.orderBy(F.desc("n"), word).limit(n)
    return most(counts.where(size <= head_bytes), head).unionByName(most(counts.where((size > head_bytes) & (size <= LONG_BYTES)), min(head, LONG_HEAD)))


def sized(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """keys (a written table of one or two longs a row) as a broadcast side of a join up to most rows, 16 MB; beyond that Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= most else keys


def joined_apart(rows: DataFrame, of: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """rows joined with of(key, m, ...), where m is how many rows have the key; m is left out.

    Keys of over hot rows, of which there is one in hot rows at most, are broadcast, so that their rows stay
    where they are; all others are joined by a shuffle. Both tables are read twice.
    """
    many = of.where(F.col("m") > hot).drop("m")
    few = of.where(F.col("m") <= hot).drop("m")
    return rows.join(sized(many), key).unionByName(rows.join(sized(many.select(key)), key, "left_anti").join(few, key))


def by_key(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """docs joined with marks on doc_id (null equals null) and __key, a hash of the text.

    Marks are joined back by value: row numbers of a table that is read twice need not be the same when
    executors come or go between the two reads, as Spark then cuts the files elsewhere.
    """
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["__key"] == F.col("__of"))
    return docs.join(marks.withColumnRenamed("doc_id", "__id").withColumnRenamed("__key", "__of"), same, how).drop("__id", "__of")


class Scratch:
    """Tables written to the shared folder to cut lineage; the folder is spark.checkpoint.dir where that is set."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Write df once, a folder for each value of by, and read it back."""
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name), partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
