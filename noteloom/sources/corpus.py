"""Read notes, question manifests and package manifests from files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.texts import casefold
from noteloom.schemas import PACKAGE_MANIFEST, QUESTION_MANIFEST
from noteloom.sources.intake import base_name


def read_files(
    spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = True, since: datetime | None = None
) -> DataFrame:
    """Files as (path, mtime_ns, size, content). Only the columns in use are read.

    ``path`` is relative to ``folder``. Content is bytes, so line ends survive. With
    ``since`` the source skips older files before it opens them, which is how a sync reads
    the content of its suspects and of nothing else.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = folder.rstrip("/") + "/"
    files = reader.load(folder)
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(since))
    return files.select(
        F.substring_index("path", root, -1).alias("path"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content",
    )


def read_notes(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """Notes as (path, title, text, content_hash, char_count), in order of the folded title."""
    files = read_files(spark, folder, glob)
    text = F.decode("content", "UTF-8")
    return files.select(
        "path", base_name(F.col("path")).alias("title"), text.alias("text"),
        F.sha2("content", 256).alias("content_hash"), F.length(text).cast("bigint").alias("char_count"),
    ).orderBy(casefold(F.col("title")), "path")


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder."""
    return read_files(spark, folder).select("path", F.col("size").alias("length"), F.sha2("content", 256).alias("sha256"))


def read_question_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Libraries and items of a labelled question set; malformed files fail at once."""
    raw = spark.read.schema(QUESTION_MANIFEST).option("mode", "FAILFAST").json(path, multiLine=True)
    checked = raw.withColumn(
        "version", F.when(F.col("version") == 2, F.col("version")).otherwise(F.raise_error(F.lit("only manifest version 2 is supported")))
    )
    libraries = checked.filter("version = 2").select(F.inline("libraries"))
    items = checked.filter("version = 2").select(F.posexplode("items").alias("_i", "item")).select(
        F.col("_i").cast("bigint").alias("question_id"), "item.*"
    )
    return libraries, items


def read_package_manifests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PACKAGE_MANIFEST).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "manifest.json"
    ).json(folder, multiLine=True)
