"""Splits, concurrent fits and k-fold cross-validation.

Folds are a pure column (``pmod(xxhash64(keys, seed), k)``), so they do not depend on how the
data is partitioned and a retried task lands every row in the same fold. The table with its fold
column is cached once and filtered per fold (the reference cached a training and a validation
copy for every fold at once). Fits run concurrently from a bounded pool of driver threads, each
one an ordinary distributed Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.tuning import (CrossValidator, CrossValidatorModel, CrossValidatorReader,  # noqa: F401  (L3)
                               CrossValidatorWriter, ParamGridBuilder, _ValidatorSharedReadWrite)
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.scalar import hashable_columns
from keelson.plans.grid import columns_used, fit_tries, flat_stages, leading_transformers, models_of, rebuilt
from keelson.plans.journal import Journal, fingerprint
from keelson.plans.scoring import score_trie

# The seeds used by the reference's recipe and scripts.
RECIPE_SEED = 4
SCRIPT_SEED = 12345
_FOLD = "_kl_fold"


def _key_cols(df: DataFrame, keys) -> list[Column]:
    if keys is None:
        return hashable_columns(df)
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def fold_of(df: DataFrame, k: int, keys=None, seed: int = RECIPE_SEED) -> Column:
    """Fold number in ``[0, k)`` from a hash of the key columns (all columns by default)."""
    return F.pmod(F.xxhash64(*_key_cols(df, keys), F.lit(seed)), F.lit(k)).cast("int")


def with_folds(df: DataFrame, k: int, keys=None, seed: int = RECIPE_SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, fold_of(df, k, keys, seed))


def hash_split(df: DataFrame, weights: Sequence[float], keys=None, seed: int = SCRIPT_SEED,
               resolution: int = 10_000) -> list[DataFrame]:
    """Split by a hash of the keys into parts of the given relative weights. Stable under
    repartitioning and retries, unlike a per-partition random sample."""
    total = float(sum(weights))
    cuts, acc = [], 0.0
    for w in weights:
        acc += w / total
        cuts.append(int(round(acc * resolution)))
    h = F.pmod(F.xxhash64(*_key_cols(df, keys), F.lit(seed)), F.lit(resolution))
    parts, lo = [], 0
    for hi in cuts:
        parts.append(df.where((h >= lo) & (h < hi)))
        lo = hi
    return parts


def modulus_split(df: DataFrame, key: str, weights: Sequence[int], multiplier: int = 37,
                  offset: int = 11) -> list[DataFrame]:
    """L7 on an integer key: ``pmod(key * multiplier + offset, sum(weights))`` picks the part.
    Reproducible in any SQL engine, hence checkable."""
    total = int(sum(weights))
    b = F.pmod(F.col(key).cast("bigint") * F.lit(multiplier) + F.lit(offset), F.lit(total))
    parts, lo = [], 0
    for w in weights:
        parts.append(df.where((b >= lo) & (b < lo + w)))
        lo += w
    return parts


def _pool(parallelism: int) -> ThreadPoolExecutor:
    return ThreadPoolExecutor(max_workers=max(1, int(parallelism)))


def fit_many(estimator: Estimator, df: DataFrame, param_maps: Sequence[dict],
             parallelism: int = 4) -> list:
    """L2: fit one estimator for many parameter sets at once (bounded driver threads); stages that sets
    share with their parameters, from the first stage on, are fitted once (see :mod:`keelson.plans.grid`)."""
    param_maps = list(param_maps)
    with _pool(parallelism) as pool:
        trie = fit_tries(estimator, [df], [param_maps], pool)[0]
    return models_of(estimator, trie, len(param_maps))


def choose_best(metrics: Sequence[float], larger_is_better: bool) -> int:
    """First best index; NaN ranks worst; all NaN raises."""
    best, best_v = None, None
    for i, v in enumerate(metrics):
        if v is None or math.isnan(v):
            continue
        if best is None or (v > best_v if larger_is_better else v < best_v):
            best, best_v = i, v
    if best is None:
        raise ValueError("every parameter set scored NaN")
    return best


class _Reader(CrossValidatorReader):
    """Reads a validator written in Python form back as its own class."""

    def load(self, path: str) -> CrossValidator:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        spark_form = {**metadata, "class": "pyspark.ml.tuning.CrossValidator"}
        _, estimator, evaluator, maps = _ValidatorSharedReadWrite.load(path, self.sparkSession, spark_form)
        out = self.cls(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator)._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata, skipParams=["estimatorParamMaps"])
        return out


class ParallelCrossValidator(CrossValidator):
    """L4: k-fold cross-validation with folds and parameter sets fitted concurrently.

    An estimator like Spark's ``CrossValidator``: same params, copies, schema checks and persistence,
    usable as a pipeline stage. Folds are hashes of ``foldKeys`` (all columns by default) unless
    ``foldCol`` names them. Metric = mean over folds; best = min or max by the evaluator's direction,
    first on ties; refit on all rows. Stages that parameter sets share are fitted once per fold, and
    all models of a fold are scored in one scan of its validation rows. At most ``parallelism`` fits run at
    once, over all folds and parameter sets; ``parallelism=1`` gives the serial validator (L5).

    With ``journal``, a folder all drivers share, the metrics of each finished fold are kept there, and a
    run on the same data, stages and grid takes them from it instead of fitting again.
    """

    journal = Param(Params._dummy(), "journal", "shared folder for finished metrics (empty: none)", typeConverter=TypeConverters.toString)

    foldKeys = Param(Params._dummy(), "foldKeys", "columns whose hash gives the fold (empty: all columns)",
                     typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, estimator: Estimator | None = None, estimatorParamMaps: Sequence[dict] | None = None,
                 evaluator: Evaluator | None = None, numFolds: int = 3, seed: int | None = RECIPE_SEED, parallelism: int = 4,
                 collectSubModels: bool = False, foldCol: str = "", foldKeys: Sequence[str] | None = None,
                 journal: str = ""):
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        super().__init__()
        self._setDefault(parallelism=4, seed=RECIPE_SEED, foldKeys=[], journal="")
        if "estimatorParamMaps" in kwargs:
            kwargs["estimatorParamMaps"] = list(kwargs["estimatorParamMaps"]) or [{}]
        self._set(**kwargs)
        if self.getNumFolds() < 2:
            raise ValueError("numFolds must be >= 2")

    def write(self):
        return CrossValidatorWriter(self)  # the Python form, which keeps foldKeys

    @classmethod
    def read(cls):
        return _Reader(cls)

    def getFoldKeys(self) -> list[str]:
        return self.getOrDefault(self.foldKeys)

    def getJournal(self) -> str:
        return self.getOrDefault(self.journal)

    def _folded(self, df: DataFrame) -> DataFrame:
        """The rows with their fold."""
        k = self.getNumFolds()
        if self.getFoldCol():
            out = df.withColumn(_FOLD, F.col(self.getFoldCol()).cast("int"))
        else:
            out = with_folds(df, k, self.getFoldKeys() or None, self.getOrDefault(self.seed), _FOLD)
        return out

    def _prepared(self, folded: DataFrame) -> tuple[list, Estimator, DataFrame]:
        """The leading stages that learn nothing and vary in nothing, the estimator of the others, and their
        input: the leading stages run once for all folds and the refit, and only columns that are still
        asked for are cached."""
        est = self.getEstimator()
        first = leading_transformers(est, self.getEstimatorParamMaps())
        rest = Pipeline(stages=flat_stages(est)[len(first):]) if first else est
        out = folded
        for stage in first:
            out = stage.transform(out)
        used = columns_used([*flat_stages(rest), self.getEvaluator()], self.getEstimatorParamMaps())
        if used is not None:
            out = out.select(*[F.col(f"`{c}`") for c in out.columns if c.lower() in used or c == _FOLD])
        return first, rest, out.persist(StorageLevel.MEMORY_AND_DISK)

    def fold_metrics(self, df: DataFrame) -> list[list[float]]:
        """metrics[fold][param_set]"""
        folded = self._folded(df)
        _, rest, prepared = self._prepared(folded)
        try:
            return self._fold_metrics(folded, rest, prepared)
        finally:
            prepared.unpersist()

    def _fold_metrics(self, rows: DataFrame, est: Estimator, folded: DataFrame) -> list[list[float]]:
        k, maps, evaluator = self.getNumFolds(), self.getEstimatorParamMaps(), self.getEvaluator()
        sizes = {r[0]: r[1] for r in folded.groupBy(_FOLD).count().collect()}
        empty = [i for i in range(k) if not sizes.get(i)]
        if empty:
            raise ValueError(f"folds {empty} are empty; use fewer folds or more rows")
        journal = Journal(folded.sparkSession, self.getJournal(), fingerprint(self.getEstimator(), maps, evaluator, rows)) if self.getJournal() else None
        found = journal.read() if journal else {}
        lacking = {i: [j for j in range(len(maps)) if (i, j) not in found] for i in range(k)}
        todo = [i for i in range(k) if lacking[i]]
        # a journal is as fine as what ends together: fold after fold with one, all at once without
        for folds in ([[i] for i in todo] if journal else [todo] if todo else []):
            parts = [[folded.where(c).drop(_FOLD) for c in (F.col(_FOLD) != i, F.col(_FOLD) == i)] for i in folds]
            sets = [[maps[j] for j in lacking[i]] for i in folds]
            with _pool(self.getParallelism()) as pool:  # the one pool that bounds all fits
                tries = fit_tries(est, [train for train, _ in parts], sets, pool)

                def score(x):
                    trie, (_, valid), own = x
                    return score_trie(trie, valid, evaluator, len(own), models_of(est, trie, len(own)))

                wrap = inheritable_thread_target(folded.sparkSession)
                scores = list(pool.map(wrap(score), zip(tries, parts, sets)))
            for i, row in zip(folds, scores):
                for j, metric in zip(lacking[i], row):
                    found[i, j] = metric
                    if journal:
                        journal.write(i, j, metric)
        return [[found[i, j] for j in range(len(maps))] for i in range(k)]

    def _fit(self, df: DataFrame) -> CrossValidatorModel:
        # one cached copy serves every fold and the final refit on all rows
        folded = self._folded(df)
        first, rest, prepared = self._prepared(folded)
        try:
            per_fold = self._fold_metrics(folded, rest, prepared)
            k, maps = self.getNumFolds(), self.getEstimatorParamMaps()
            avg = [sum(row[j] for row in per_fold) / k for j in range(len(maps))]
            best = choose_best(avg, self.getEvaluator().isLargerBetter())
            best_model = rest.fit(prepared.drop(_FOLD), maps[best])
            if first:
                best_model = rebuilt(self.getEstimator(), iter([*first, *best_model.stages]))
        finally:
            prepared.unpersist()
        model = self._copyValues(CrossValidatorModel(best_model, avgMetrics=avg))
        model.bestIndex = best
        return model


def serial_cross_validator(estimator: Estimator, evaluator: Evaluator, param_maps: Sequence[dict],
                           num_folds: int = 3, fold_col: str = "fold") -> CrossValidator:
    """Spark's own ``CrossValidator`` over a precomputed fold column (``with_folds``)."""
    return CrossValidator(estimator=estimator, evaluator=evaluator, estimatorParamMaps=list(param_maps),
                          numFolds=num_folds, foldCol=fold_col, parallelism=1)
