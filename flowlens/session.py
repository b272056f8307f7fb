"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_WRITTEN: list[str] = []


def build_session(
    app: str = "flowlens", master: str | None = None, shared: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators count on; ``conf`` keys use ``__`` for dots.

    ``shared`` is the folder that all executors see, for tables that cut lineage.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join side even where that costs one more exchange above it.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.checkpoint.dir": shared} if shared else {}),
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is used in local mode only: on a cluster a
    machine-local folder would be lost with its executor. ``drop_materialized`` removes the path.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _LOCAL_FOLDERS[app]
    path = f"{base.rstrip('/')}/flowlens-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: lineage ends, executors may die."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that a later one has replaced."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def drop_materialized(spark: SparkSession) -> None:
    """Remove everything this process has put into the shared folder: tables, logs, checkpoints."""
    for path in list(_WRITTEN):
        drop_path(spark, path)
