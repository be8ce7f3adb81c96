"""Several tables of one index, stored by document bucket and published together.

A bucket of a table is a folder of its own, written once and never changed. A manifest names the
folder of every table and bucket, and one pointer file names the manifest. A change writes new
folders for the buckets it touches, is checked, and becomes visible with all its tables when the
pointer moves; the folders of all other buckets are taken over by name and not read. If a check
fails or a job dies, the pointer still names the old manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from noteloom.session import hinted
from noteloom.sources.snapshots import SnapshotRejected, current_path, publish, stage

_MANIFEST = "table_name string, bucket int, folder string, n_rows bigint, schema string"
#: Rows that must not be there, from the staged tables of a change.
Check = Callable[[dict[str, DataFrame]], DataFrame]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def content_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest) of a table, whatever the order of its rows: equal tables have equal ones.

    128 bits of hashes are summed, so no rows are gathered anywhere.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", wide("a"), wide("b")), 256).alias("digest"))


@dataclass(frozen=True)
class TableSet:
    """One published version. ``key`` is the column that decides the bucket of a row in every table."""

    spark: SparkSession
    root: str
    manifest: str
    buckets: int
    key: str
    folders: dict[str, dict[int, str]]
    schemas: dict[str, StructType]

    def table(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A table, or just some of its buckets: no other folder is opened."""
        wanted = self.folders[name] if only is None else {b: f for b, f in self.folders[name].items() if b in set(only)}
        paths = [f"{self.root}/{f}" for f in sorted(wanted.values())]
        schema = self.schemas[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys; at most all there are."""
        return sorted(r[0] for r in keys.select(bucket_of(F.col(self.key), self.buckets)).distinct().collect())

    def replace(self, keys: DataFrame, fresh: dict[str, DataFrame], check: Check | None = None) -> TableSet:
        """The version in which all rows of ``keys`` are replaced by those of ``fresh``, in the tables given there.

        ``check`` sees the rows of the touched buckets as they are staged.
        """
        keys = keys.select(self.key).distinct()
        buckets = self.touched(keys)
        if not buckets:
            return self
        staged = {}
        for name, rows in fresh.items():
            kept = self.table(name, buckets).join(hinted(keys), self.key, "left_anti")
            staged[name] = _write(self, name, kept.unionByName(rows.select(*kept.columns)))
        folders = {
            name: {b: f for b, f in have.items() if name not in staged or b not in buckets} | staged.get(name, {})
            for name, have in self.folders.items()}
        return _published(self, folders, self.schemas, check, buckets)


def _write(place: TableSet, name: str, rows: DataFrame) -> dict[int, str]:
    """Write rows by bucket into fresh folders; returns the folder of each bucket that has rows."""
    base = f"data/{name}-{uuid.uuid4().hex}"
    schema = place.schemas[name]
    dealt = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], bucket_of(F.col(place.key), place.buckets).alias("bucket"))
    dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{place.root}/{base}")
    have = place.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{place.root}/{base}")
    return {r.bucket: f"{base}/bucket={r.bucket}" for r in have.select("bucket").distinct().collect()}


def _published(place: TableSet, folders: dict[str, dict[int, str]], schemas: dict[str, StructType], check: Check | None, buckets: list[int]) -> TableSet:
    spark = place.spark
    version = TableSet(spark, place.root, "", place.buckets, place.key, folders, schemas)
    if check is not None:
        problem = check({name: version.table(name, buckets) for name in folders}).first()
        if problem is not None:
            raise SnapshotRejected(f"{place.root}: {problem.asDict()}")
    rows = [(name, b, f, None, None) for name, have in folders.items() for b, f in have.items()]
    rows += [(name, None, None, None, json.dumps({"schema": s.jsonValue(), "buckets": place.buckets, "key": place.key})) for name, s in schemas.items()]
    manifest = stage(spark.createDataFrame(rows, _MANIFEST).coalesce(1), place.root)
    publish(spark, place.root, manifest)
    return TableSet(spark, place.root, manifest, place.buckets, place.key, folders, schemas)


def create_set(root: str, tables: dict[str, DataFrame], key: str = "doc_id", buckets: int = 64, check: Check | None = None) -> TableSet:
    """Write all tables and publish them at once; also over an older version, which is then replaced as a whole."""
    spark = next(iter(tables.values())).sparkSession
    # As files give it back: nothing is declared to be never null.
    schemas = {name: StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)) for name, df in tables.items()}
    place = TableSet(spark, root, "", buckets, key, {}, schemas)
    return _published(place, {name: _write(place, name, df) for name, df in tables.items()}, schemas, check, list(range(buckets)))


def open_set(spark: SparkSession, root: str) -> TableSet:
    """The version that the pointer names."""
    manifest = current_path(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"{root} has no published version")
    folders: dict[str, dict[int, str]] = {}
    schemas, layout = {}, {}
    for r in spark.read.schema(_MANIFEST).parquet(manifest).collect():  # a row for each table and bucket
        if r.schema:
            layout = json.loads(r.schema)
            schemas[r.table_name] = StructType.fromJson(layout["schema"])
            folders.setdefault(r.table_name, {})
        else:
            folders.setdefault(r.table_name, {})[r.bucket] = r.folder
    return TableSet(spark, root, manifest, layout["buckets"], layout["key"], folders, schemas)


def digests(tables: dict[str, DataFrame]) -> dict[str, tuple[int, str]]:
    return {name: tuple(content_digest(df).first()) for name, df in tables.items()}


def copy_tables(source: dict[str, DataFrame], root: str, key: str = "doc_id", buckets: int = 64) -> TableSet:
    """Copy tables and publish the copies together, only if each has the digest of its source."""
    before = digests(source)

    def differing(staged: dict[str, DataFrame]) -> DataFrame:
        after = digests(staged)
        rows = [(n, str(before[n]), str(after[n])) for n in before if before[n] != after[n]]
        return next(iter(staged.values())).sparkSession.createDataFrame(rows, "table_name string, source string, copy string")

    return create_set(root, source, key, buckets, differing)
