"""Sinks. Writers stay distributed (one file per task) unless a single file is asked for."""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.project import db_compatible


# Result file names are <name>_<metric>_<date>, the metric printed in single
# precision as "%9.5f" and trimmed, the date in the pattern "y-MMMd-hmma" (e.g. 2024-Jan5-307PM).


def metric_text(value: float) -> str:
    """The metric as the reference printed it into file names: single precision, ``%9.5f``, trimmed."""
    return f"{np.float32(value):9.5f}".strip()


def stamp_text(now: _dt.datetime) -> str:
    """Date in the reference's ``y-MMMd-hmma`` pattern, e.g. ``2024-Jan5-307PM``."""
    hour12 = now.hour % 12 or 12
    return f"{now.year}-{now.strftime('%b')}{now.day}-{hour12}{now.minute:02d}{'AM' if now.hour < 12 else 'PM'}"


def result_name(recipe_name: str, metric: float, now: _dt.datetime | None = None) -> str:
    return f"{recipe_name}_{metric_text(metric)}_{stamp_text(now or _dt.datetime.now())}"


def write_csv(df: DataFrame, path: str, select_exprs: Sequence[str] | None = None, header: bool = True,
              single_file: bool = False, mode: str = "errorifexists") -> str:
    """CSV with a header, after optional SQL select expressions (``None`` = all columns).

    ``single_file=True`` makes the folder hold one file: all tasks write headerless parts in their
    order, and after the commit the parts are joined on the file system, behind one header line.
    Vector columns are written as arrays turned to text.
    """
    out = db_compatible(df.selectExpr(*select_exprs) if select_exprs else df)
    out = out.select(*[F.to_json(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
                       for f in out.schema.fields])
    if not single_file:
        out.write.mode(mode).option("header", header).csv(path)
        return path
    spark = df.sparkSession
    target = _hadoop_path(spark, path)
    exists = target[1].exists(target[0])
    if exists and mode in ("error", "errorifexists"):
        raise FileExistsError(f"path {path} already exists")
    if exists and mode == "ignore":
        return path
    if mode not in ("error", "errorifexists", "ignore", "overwrite"):
        raise ValueError(f"a single file cannot be written with mode {mode!r}")
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    try:
        out.write.option("header", False).csv(parts)
        if exists:
            target[1].delete(target[0], True)
        _join_parts(spark, parts, path, out if header else None)
    finally:
        folder, fs = _hadoop_path(spark, parts)
        fs.delete(folder, True)
    return path


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, in the session's JVM."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _join_parts(spark: SparkSession, parts: str, path: str, headed: DataFrame | None) -> None:
    """One file ``part-00000.csv`` in ``path`` from the header of ``headed`` and the parts by name.

    Bytes are copied by the JVM in small buffers; the folder gets its ``_SUCCESS`` file last.
    """
    folder, fs = _hadoop_path(spark, parts)
    target, _ = _hadoop_path(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held = jvm.org.apache.hadoop.fs.Path(target, "_joining")
    out = fs.create(held, True)
    try:
        if headed is not None:
            out.write(bytearray(_csv_line(headed.columns).encode()))
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.rename(held, jvm.org.apache.hadoop.fs.Path(target, "part-00000.csv"))
    fs.create(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"), True).close()


def _csv_line(names: Sequence[str]) -> str:
    """A header line as Spark writes it: quoted where a name holds a separator, a quote or a line end."""
    quoted = ['"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(c in n for c in ',"\n\r') else n for n in names]
    return ",".join(quoted) + "\n"


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               properties: Mapping[str, str] | None = None) -> None:
    """Append or overwrite a database table after making vector columns arrays.
    Each task writes its own rows over its own connection."""
    db_compatible(df).write.mode(mode).jdbc(url, table, properties=dict(properties or {}))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """The same projection written to a file format (the tested stand-in for S4)."""
    db_compatible(df).write.mode(mode).format(fmt).save(path)
    return path
