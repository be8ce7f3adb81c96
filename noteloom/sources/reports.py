"""Evaluation reports as files, and the comparison of two copies of a file tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "level string, grp string, metric string, value double"
HEADER = "field string, value string"


def write_report(header: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Header fields and metric rows as JSON lines."""
    header.select("field", F.col("value").cast("string").alias("value")).write.mode("errorifexists").json(f"{folder}/header")
    metrics.select("level", "grp", "metric", "value").write.mode("errorifexists").json(f"{folder}/metrics")


def read_report(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    read = lambda part, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{part}")
    return read("header", HEADER), read("metrics", METRICS)


def tree_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Files that are missing, extra or different in a copy: (path, problem).

    Both sides: ``path, length, sha256``.
    """
    a = source.select("path", F.struct("length", "sha256").alias("a"))
    b = copy.select("path", F.struct("length", "sha256").alias("b"))
    problem = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "different")
    )
    return a.join(b, "path", "full_outer").withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")
