"""Helpers shared by the corpus operators: staged tables, row keys and Arrow plumbing."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import ensure_checkpoint_dir

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables as Parquet in the shared folder of ``spark.checkpoint.dir``.

    A staged table cuts lineage (a lost executor rereads files instead of recomputing) and gives
    the planner real sizes. ``drop`` removes one as soon as a later one replaces it; the rest go
    when the driver's interpreter exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def stage(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._keelson_path = path
        self.release()
        return out

    def release(self) -> None:
        """Let the driver's cleaner remove shuffle files that only led to staged tables."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        self._delete(df._keelson_path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is gone, and with it the means to reach the store
            pass

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Equal for rows with the same id and text (whose results are the same), else different.

    Two 64-bit hashes of id and text, so that repeated ids with other texts stay apart.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(F.col(doc_id), t).alias("a"),
                    F.xxhash64(t, F.col(doc_id), F.lit(1)).alias("b"))


def whole_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, a, b)``: each row as one struct, so that no column clashes with a helper's, and its key."""
    key = row_key(doc_id, text)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key["a"].alias("a"), key["b"].alias("b"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
