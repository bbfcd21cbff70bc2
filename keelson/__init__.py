"""keelson: event and tabular data preparation and model training on Spark, at scale."""

from keelson.functions.scalar import (abs_error, age_group, bin_case, epoch_ms, epoch_ms_to_timestamp, indicator,
                                      ms_bucket, parse_int, safe_double, vector_element)
from keelson.operators.asof import asof_join
from keelson.operators.cogroup import cogroup
from keelson.operators.featurize import (Featurizer, FeaturizerEstimator, SparseFeaturizer, SparseFeaturizerEstimator,
                                         pivot_features, sparse_features)
from keelson.operators.metrics import (LogLossEvaluator, ShareCorrectEvaluator, best_or_worst, log_loss_frame,
                                       share_correct_frame)
from keelson.operators.ordering import GapFiller, gap_fill, sliding, with_next, with_row_index
from keelson.operators.project import (ConstantColumn, conform, db_compatible, fill_nulls_by_type,
                                       flatten_optional, project_named)
from keelson.sources.dumpformat import register_event_dump
from keelson.sources.eventdump import EVENT_DUMP_SCHEMA, EVENT_DUMP_VARIANT_SCHEMA, read_event_dump

__all__ = [
    "abs_error", "age_group", "bin_case", "epoch_ms", "epoch_ms_to_timestamp", "indicator", "ms_bucket",
    "parse_int", "safe_double", "vector_element", "asof_join", "cogroup", "Featurizer", "FeaturizerEstimator",
    "SparseFeaturizer", "SparseFeaturizerEstimator", "sparse_features",
    "pivot_features", "LogLossEvaluator", "ShareCorrectEvaluator", "best_or_worst", "log_loss_frame",
    "share_correct_frame", "GapFiller", "gap_fill", "sliding", "with_next", "with_row_index", "ConstantColumn",
    "conform", "db_compatible", "fill_nulls_by_type", "flatten_optional", "project_named", "EVENT_DUMP_SCHEMA",
    "EVENT_DUMP_VARIANT_SCHEMA", "read_event_dump", "register_event_dump",
]
