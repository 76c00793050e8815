"""Sources and sinks: CSV, JSON and Parquet with given schemas, optional inputs, upserts into stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, a byte order mark, quotes doubled and line breaks within quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "csv") -> DataFrame:
    """The table at path, or an empty one where there is none."""
    try:
        if form == "csv":
            return read_csv(spark, path, schema)
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one JSON array or document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in their order; what df lacks is written empty, what it has besides is left out."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, key: str, form: str = "parquet") -> None:
    """One directory for each value of key; the rebalance splits a hot key over several tasks and files."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).format(form).save(path)


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of both, the last by `order` of changes before those of existing for each key."""
    both = existing.withColumn("__gen", F.lit(0)).withColumn("__ord", F.lit(0).cast("bigint")).unionByName(changes.withColumn("__gen", F.lit(1)).withColumnRenamed(order, "__ord"), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.desc("__gen"), F.desc("__ord"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__gen", "__ord", "__rn")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are not unique, with their counts: a constraint check."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
