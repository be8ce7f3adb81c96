"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application.

    Arrow functions refer to their modules by name, and a worker does not share the import
    path of the driver program.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as target:
            for source in sorted(package.rglob("*.py")):
                target.write(source, source.relative_to(package.parent).as_posix())
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


def get_spark(app_name: str = "noteloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer.

    On a cluster the master, the memory and the number of shuffle partitions come
    from spark-submit; only ``master`` and ``conf`` given here override them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    A cluster names it in ``spark.checkpoint.dir``. A machine-local folder is made
    only for a local session that names none.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def hinted(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it is shown to have few rows, and as it is otherwise.

    For narrow key tables whose size the optimizer cannot estimate. Counting stops after
    ``max_rows``; without the hint the join shuffles and still gives the same rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
