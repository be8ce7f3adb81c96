"""Table snapshots: written aside, checked, then published by replacing one pointer.

There is no table format here, so a table is a folder of snapshots and a pointer file
that names the current one. Readers follow the pointer; a failed write leaves it alone.
One writer per table is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteloom.operators.quality import table_digest

_POINTER = "CURRENT"


class SnapshotRejected(RuntimeError):
    """The staged data did not pass its check; the table is unchanged."""


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def current_path(spark: SparkSession, table: str) -> str | None:
    """Folder of the published snapshot, or None."""
    fs, hadoop = _filesystem(spark, table)
    pointer = hadoop.Path(f"{table}/{_POINTER}")
    if not fs.exists(pointer):
        return None
    name = spark.read.text(str(pointer.toString())).first()[0]
    return f"{table}/{name}"


def read_current(spark: SparkSession, table: str) -> DataFrame:
    path = current_path(spark, table)
    if path is None:
        raise FileNotFoundError(f"{table} has no published snapshot")
    return spark.read.parquet(path)


def stage(df: DataFrame, table: str, partition_by: str | None = None) -> str:
    """Write a snapshot without publishing it; returns its folder."""
    path = f"{table}/snapshot-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def publish(spark: SparkSession, table: str, snapshot: str) -> None:
    """Make a staged snapshot the current one by replacing the pointer file."""
    fs, hadoop = _filesystem(spark, table)
    fresh = hadoop.Path(f"{table}/.{_POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(snapshot.rsplit("/", 1)[-1].encode()))
    out.close()
    target = hadoop.Path(f"{table}/{_POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def replace_table(
    df: DataFrame, table: str, check: Callable[[DataFrame], DataFrame] | None = None, partition_by: str | None = None
) -> str:
    """Stage, check and publish. ``check`` returns the offending rows of the staged data."""
    spark = df.sparkSession
    snapshot = stage(df, table, partition_by)
    if check is not None:
        problem = check(spark.read.parquet(snapshot)).first()
        if problem is not None:
            raise SnapshotRejected(f"{table}: {problem.asDict()}")
    publish(spark, table, snapshot)
    return snapshot


def copy_verified(source: DataFrame, table: str, key: str, name: str) -> str:
    """Copy a table and publish the copy only if its digest equals the source's.

    ``source`` may be any DataFrame, for instance a JDBC table read in partitions.
    """
    spark = source.sparkSession
    snapshot = stage(source, table)
    before = table_digest(source, key, name).first()
    after = table_digest(spark.read.parquet(snapshot), key, name).first()
    if before != after:
        raise SnapshotRejected(f"{name}: digest of the copy differs: {before} != {after}")
    publish(spark, table, snapshot)
    return snapshot
