"""Reading, normalising and splitting measurement tables; writing features and long tables."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.sources.shared import shared_folder
from candrank.table import Measurements


def load_measurements(rows: DataFrame, meta: DataFrame, env_prefix: str, ok_only: bool = False, ok: str = "ok") -> DataFrame:
    """rows measured under the one condition that meta names; ok_only keeps those whose status is ok."""
    found = [r.env_hash for r in meta.select("env_hash").distinct().limit(3).collect()]
    if len(found) != 1 or not str(found[0]).startswith(env_prefix):
        raise ValueError(f"conditions {found}, asked for {env_prefix}")
    return rows.where(F.col("status") == ok) if ok_only else rows


def read_bundle(spark: SparkSession, path: str, env_prefix: str, ok_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """table.parquet and the one-row env.json of a folder."""
    meta = spark.read.option("multiLine", True).json(f"{path}/env.json")
    return load_measurements(spark.read.parquet(f"{path}/table.parquet"), meta, env_prefix, ok_only), meta


def normalize(df: DataFrame, aliases: dict[str, tuple[str, ...]], sums: dict[str, tuple[str, str]], defaults: dict[str, object], required: tuple[str, ...]) -> DataFrame:
    """Rename the first alias that is there, add sums (null as 0) and defaults; a missing required column is an error."""
    for name, others in aliases.items():
        if name not in df.columns and (found := [o for o in others if o in df.columns]):
            df = df.withColumnRenamed(found[0], name)
    for name, (a, b) in sums.items():
        df = df.withColumn(name, F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0)))
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def check_schema(df: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """A row for each column that is required, optional or new, with whether it is there."""
    names = [(c, "required", c in df.columns) for c in required] + [(c, "optional", c in df.columns) for c in optional]
    names += [(c, "new", True) for c in df.columns if c not in required and c not in optional]
    return df.sparkSession.createDataFrame(names, "name string, kind string, present boolean")


def split_answers(mt: Measurements) -> tuple[DataFrame, DataFrame]:
    """Features without the cost, and the cost by key."""
    key = [*mt.groups, *mt.ids]
    return mt.rows.drop(mt.cost), mt.rows.select(*key, mt.cost)


def check_keys(features: DataFrame, costs: DataFrame, key: list[str]) -> DataFrame:
    """n_features, n_costs, one_sided: rows of either side, and keys that only one side has (a null is a value like any other)."""
    side = lambda df, a, b: df.select(*key, F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side(features, 1, 0).unionByName(side(costs, 0, 1)).groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.agg(F.sum("a").alias("n_features"), F.sum("b").alias("n_costs"), F.count_if((F.col("a") == 0) | (F.col("b") == 0)).alias("one_sided"))


def lift_constants(df: DataFrame, cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """df without those of cols that have one value, and their names and values."""
    seen = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
    lifted = [c for c in cols if seen[c] == 1]
    values = df.select(*[F.col(c).cast("string").alias(c) for c in lifted]).limit(1)
    return df.drop(*lifted), to_long(values, [], lifted) if lifted else df.sparkSession.createDataFrame([], "name string, value string")


def to_long(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """ids, name, value."""
    return df.unpivot(ids, values, "name", "value")


def _state_of(df: DataFrame) -> str:
    """Names, sizes and times of the files that a plan reads, as a hash."""
    spark, found = df.sparkSession, []
    for file in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(file)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        found.append(f"{file}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.md5("\n".join(found).encode()).hexdigest()


def materialize(mt: Measurements, features: dict[str, Column], path: str | None = None) -> DataFrame:
    """Features by key, each written under the hash of its expression and source; what is there already is read, not computed again.

    The source is the plan and the names, sizes and times of its files, so that changed files are read again.
    """
    spark = mt.rows.sparkSession
    base = path or f"{shared_folder(spark)}/features"
    key = [*mt.groups, *mt.ids]
    source = f"{mt.rows.semanticHash()}|{_state_of(mt.rows)}"
    frames = []
    for name, column in features.items():
        at = f"{base}/{hashlib.md5(f'{source}|{name}|{column}'.encode()).hexdigest()}"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            mt.rows.select(*key, column.alias(name)).write.mode("overwrite").parquet(at)
        frames.append(spark.read.parquet(at))
    return reduce(lambda a, b: a.join(b, key), frames)


def read_runs(spark: SparkSession, glob: str, file: str, schema: str | None = None) -> DataFrame:
    """JSON lines of many runs' folders, with the folder's name as run. Without a schema all files are read once more to find it."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("recursiveFileLookup", True).option("pathGlobFilter", file).json(glob)
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
