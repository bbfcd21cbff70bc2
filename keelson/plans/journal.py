"""A journal of cross-validation: the metric of every finished (fold, parameter set) in a shared folder.

A run that lost its driver reads it and fits only what lacks. Entries belong to a run's fingerprint:
the stages with their parameters, the grid, the evaluator, the folds and the data (schema, rows and a
sum of row hashes). Each is one small file, written aside and renamed, so that none is ever half there.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.scalar import hashable_columns
from keelson.plans.grid import flat_stages


def _params(stage) -> dict:
    """Parameters by name, without the identities that differ from run to run."""
    if not hasattr(stage, "extractParamMap"):
        return {}
    return {p.name: repr(v) for p, v in stage.extractParamMap().items() if stage.uid not in repr(v)}


def fingerprint(estimator: Estimator, param_maps, evaluator: Evaluator, folded: DataFrame) -> str:
    stages = flat_stages(estimator)
    at = {s.uid: i for i, s in enumerate(stages)}
    data = folded.agg(F.count("*"), F.sum(F.xxhash64(*hashable_columns(folded), F.lit(0)).cast("decimal(38,0)"))).first()
    parts = [[[type(s).__name__, _params(s)] for s in stages],
             [sorted([at.get(p.parent, -1), p.name, repr(v)] for p, v in m.items()) for m in param_maps],
             [type(evaluator).__name__, _params(evaluator)], folded.schema.simpleString(), data[0], str(data[1])]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


class Journal:
    """``(fold, set) -> metric`` under ``folder/fingerprint``."""

    def __init__(self, spark: SparkSession, folder: str, mark: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = f"{folder.rstrip('/')}/{mark}"

    def _path(self, name: str = ""):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self._conf)

    def read(self) -> dict[tuple[int, int], float]:
        root, fs = self._path()
        found = {}
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if name.endswith(".json"):
                    stream = fs.open(status.getPath())
                    try:
                        entry = json.loads(bytes(stream.readAllBytes()).decode())
                    finally:
                        stream.close()
                    found[entry["fold"], entry["set"]] = float(entry["metric"])
        return found

    def write(self, fold: int, number: int, metric: float) -> None:
        held, fs = self._path(f"_{uuid.uuid4().hex}")
        out = fs.create(held, True)
        try:
            out.write(bytearray(json.dumps({"fold": fold, "set": number, "metric": repr(metric)}).encode()))
        finally:
            out.close()
        final, _ = self._path(f"{fold}-{number}.json")
        if not fs.rename(held, final):  # another driver wrote the same entry first
            fs.delete(held, False)
