"""Session helpers: building a local session for tests/bench and reading cluster settings.

Library functions never create sessions; they take the caller's ``spark`` (or the
session of the DataFrame they are given).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "keelson",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench: UI off, UTC, AQE on, ANSI left at its default."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is ``local`` is a folder of our own set; on a
    cluster the setting points at shared storage and is used as is, and its absence is an error.
    """
    def context_dir():
        try:
            return spark.sparkContext.getCheckpointDir()
        except Exception:  # no SparkContext access (Spark Connect)
            return None

    def set_context_dir(path: str) -> None:
        try:
            spark.sparkContext.setCheckpointDir(path)
        except Exception:
            pass

    current = spark.conf.get(CHECKPOINT_CONF, None) or context_dir()
    if current:
        if not context_dir():
            set_context_dir(current)
        return current
    master = spark.conf.get("spark.master", "") or ""
    if not fallback and not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master is {master!r})")
    path = fallback or tempfile.mkdtemp(prefix="keelson-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(CHECKPOINT_CONF, path)
    set_context_dir(path)
    return path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_side(df: DataFrame, rows_bound: int) -> DataFrame:
    """Materialize a side table whose row count is bounded (one row per bucket, say).

    It is written once as Parquet into the shared checkpoint folder and read back: lineage is
    cut (nothing is recomputed by the main job or after an executor loss) and the planner sees
    its real size, so it is broadcast only if that size is under the session's broadcast
    threshold, and joined by shuffle otherwise. Files: about one per 50,000 bounded rows; the
    ``repartition`` shuffles only the small result, where ``coalesce`` would also squeeze the
    stage that computes it (a final aggregation over every task's partial rows) into few tasks.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/keelson-side-{uuid.uuid4().hex}"
    parts = max(1, -(-int(rows_bound) // 50_000))
    if _has_void(df.schema):  # an untyped all-null column, which Parquet cannot store
        return cut_lineage(df.repartition(parts), eager=True)
    remove_at_exit(df.sparkSession, path)
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _has_void(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_void(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_void(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_void(dtype.keyType) or _has_void(dtype.valueType)
    return isinstance(dtype, T.NullType)


def side_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared checkpoint folder, removed when the driver's interpreter ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder when the driver's interpreter ends, if the session still lives."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended, or gives no access to its JVM
        pass
