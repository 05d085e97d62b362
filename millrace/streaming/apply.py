"""Fitted steps on a stream.

A fitted step that is a projection or a filter works on a streaming DataFrame
as it does on a table. Steps that need the whole table cannot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.base import Fitted

# Steps whose fitted form runs no job and keeps no state.
STREAMABLE = {
    "standardization", "min_max", "robust_scaling", "quantile_transformation", "log_power", "skew_log",
    "winsorization", "iqr_outliers", "mean_fill", "infinity_to_null", "one_hot", "ordinal", "frequency_encoding",
    "binning", "fix_column_types", "narrow_types", "simple_imputation", "correlation_filter", "variance_threshold",
    "pca", "svd", "tfidf", "ngram_counts", "sentiment", "text_normalization", "isolation_forest",
}


def transform_stream(stream: DataFrame, fitted: list[Fitted]) -> DataFrame:
    for model in fitted:
        if model.name not in STREAMABLE:
            raise ValueError(f"{model.name} needs the whole table and cannot run on a stream")
        stream = model.transform(stream)
    return stream
