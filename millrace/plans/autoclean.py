"""One-call cleaning: eight guarded steps, with the health before and after."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.operators import profile as P
from millrace.operators.clean import FixTypes, SimpleImpute, dedupe
from millrace.operators.encode import Frequency, OneHot
from millrace.operators.forest import IsolationForest
from millrace.operators.knn import KnnImpute
from millrace.operators.linalg import Pca
from millrace.operators.scale import SkewLog, Standardize
from millrace.plans.health import Health, analyze, quality, suggest
from millrace.runtime import settle
from millrace.schema import col

# The guards of the steps.
MIN_KNN_ROWS, FOREST_COLUMNS, FOREST_ROWS = 3, 3, 100
FOREST_SHARE, FOREST_MIN_REMOVED = 0.05, 0.02
ONE_HOT_VALUES = 20
MAX_ADDED, MAX_GROWTH = 200, 3
PCA_NUMERIC, PCA_COLUMNS, PCA_MAX = 100, 150, 30


@dataclass
class Cleaned:
    table: DataFrame
    steps: list[str]
    before: Health
    after: Health
    suggested: dict

    def scores(self) -> tuple[float, float]:
        return quality(self.before)["score"], quality(self.after)["score"]


def auto_clean(df: DataFrame, report_after: bool = True) -> Cleaned:
    """Cleans a table; the target column, if one is found, is only deduplicated and type-repaired."""
    before = analyze(df)
    target = before.balance["label_column"]
    steps: list[str] = []
    table, rows = df, before.rows

    def numerics(t: DataFrame) -> list[str]:
        return S.numeric(t, (target,))

    if before.duplicates:
        table, rows = settle(dedupe(table), "deduped"), rows - before.duplicates
        steps.append("remove_duplicates")

    types = FixTypes().fit(table)
    if types.params["kinds"]:
        table = types.transform(table)
        steps.append("fix_column_types")

    changed = bool(steps)
    nulls = P.null_tally(table)[1] if changed else before.nulls
    if sum(nulls.values()):
        table = _impute(table, rows, nulls, numerics(table), target, steps)

    columns = numerics(table)
    if len(columns) >= FOREST_COLUMNS and rows >= FOREST_ROWS:
        inliers = IsolationForest(columns=columns, contamination=FOREST_SHARE).fit_transform(table)
        removed = rows - inliers.count()
        if removed and removed / rows >= FOREST_MIN_REMOVED:
            table, rows = inliers, rows - removed
            steps.append("isolation_forest_outlier_removal")

    columns = numerics(table)
    if columns:
        logs = SkewLog(columns=columns).fit(table)
        if logs.params["columns"]:
            table = logs.transform(table)
            steps.append("log_transform")

    labels = [c for c in S.cat_profile(table) if c != target]
    if labels:
        table = _encode(table, labels, len(df.columns), steps)

    columns = numerics(table)
    if columns:
        table = Standardize(columns=columns).fit(table).transform(table)
        steps.append("standardization")

    if len(columns) >= PCA_NUMERIC or len(table.columns) >= PCA_COLUMNS:
        k = min(PCA_MAX, max(2, int(math.sqrt(len(columns)))))
        kept = [target] if target in table.columns and target not in columns else []
        scores = Pca(n_components=k, columns=columns, prefix="pca_").fit(table).transform(table)
        table = scores.select(*[c for c in scores.columns if c.startswith("pca_")], *[col(c) for c in kept])
        steps.append("pca")

    after = before
    if report_after:
        table = settle(table, "cleaned")
        after = analyze(table)
    return Cleaned(table, list(dict.fromkeys(steps)), before, after, suggest(before))


def _impute(table, rows, nulls, columns, target, steps):
    others = [c for c in table.columns if c not in columns and c != target]
    lacking = [c for c in columns if nulls[c]]
    if len(columns) >= 2 and rows >= MIN_KNN_ROWS:
        if lacking:
            model = KnnImpute(columns=columns, n_neighbors=min(5, max(1, rows - 1))).fit(table)
            table = settle(model.transform(table), "imputed")
        steps.append("knn_imputation")
    elif columns:
        table = SimpleImpute(strategy="median", numeric=lacking, categorical=[]).fit(table).transform(table)
        steps.append("simple_numeric_imputation")
    if others:
        gaps = [c for c in others if nulls[c] and c in S.cat_impute(table)]
        table = SimpleImpute(numeric=[], categorical=gaps, empty_text="unknown").fit(table).transform(table)
        # Reported whenever there are such columns, filled or not.
        steps.append("categorical_mode_imputation")
    return table


def _encode(table, labels, original_columns, steps):
    """One-hot for few values while the table stays narrow enough, shares of rows for the rest."""
    distinct = P.distinct_tally(table, labels)
    # What the table may still grow by; a column spends its values less the column that they replace.
    budget = min(original_columns + MAX_ADDED, MAX_GROWTH * original_columns) - len(table.columns)
    cost = {c: distinct.get(c, 0) - 1 for c in labels}
    spent, as_flags = 0, set()
    for c in filter(lambda c: cost[c] < ONE_HOT_VALUES, labels):
        if spent + cost[c] <= budget:
            spent += cost[c]
            as_flags.add(c)
    one_hot, shares = ([c for c in labels if (c in as_flags) == chosen] for chosen in (True, False))
    if shares:
        table = Frequency(columns=shares).fit(table).transform(table)
        steps.append("frequency_encoding")
    if one_hot:
        table = OneHot(columns=one_hot, dummies=True).fit(table).transform(table)
        steps.append("one_hot_encoding")
    return table
