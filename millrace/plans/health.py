"""Health report, quality score and suggested steps."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.functions.casts import to_number
from millrace.operators import profile as P
from millrace.operators.moments import pair_moments
from millrace.operators.quantiles import percentiles
from millrace.runtime import agg_rows
from millrace.schema import col, dbl

CORRELATED = 0.9
SKEWED = 1.0
INCONSISTENT = 0.85
LOW_CARDINALITY = 20


@dataclass
class Health:
    """What the report knows; everything in it is bounded by the number of columns."""

    rows: int
    columns: list[str]
    types: dict[str, str]
    nulls: dict[str, int]
    numeric: dict[str, dict]
    categorical: dict[str, int]          # distinct values per column
    duplicates: int
    outliers: dict[str, int]
    outlier_rows: int
    correlated: list[tuple[str, str, float]]
    skewed: list[str]
    inconsistent: list[str]
    balance: dict
    issues: list[str] = field(default_factory=list)
    fixes: list[tuple[str, str, str]] = field(default_factory=list)   # fix, reason, confidence

    @property
    def missing(self) -> int:
        return sum(self.nulls.values())

    def missing_in(self, names) -> int:
        return sum(self.nulls[c] for c in names)


def analyze(df: DataFrame) -> Health:
    """Two scans for columns, one for pairs, and grouped counts for copies, values and classes."""
    numeric, categorical, strings = S.numeric(df), S.cat_profile(df), S.cat_encode(df)
    base = [F.count(F.lit(1))] + [F.count_if(S.is_missing(df, c)) for c in df.columns]
    looks = [F.avg(F.when(col(c).isNotNull(), to_number(col(c)).isNotNull().cast("double"))) for c in strings]
    got = agg_rows(df, base + looks)
    rows, nulls, shares = got[0], dict(zip(df.columns, got[1:len(base)])), got[len(base):]
    facts = P.base_facts(df, numeric)
    quartiles = percentiles(df, numeric, [0.25, 0.5, 0.75], {c: f["count"] for c, f in facts.items()})
    for c, f in facts.items():
        f["q25"], f["median"], f["q75"] = quartiles[c]
    outliers, outlier_rows = P.outlier_counts(df, 1.5, True, facts)
    correlated = []
    if len(numeric) >= 2:
        moments = pair_moments(df, numeric)
        for i, a in enumerate(numeric):
            for b in numeric[i + 1:]:
                r = moments.correlation(a, b)
                if abs(r or 0.0) >= CORRELATED:
                    correlated.append((a, b, r))
    distinct = P.distinct_tally(df, categorical)
    health = Health(
        rows=rows, columns=df.columns, types={f.name: f.dataType.simpleString() for f in df.schema.fields},
        nulls=nulls, numeric=facts, categorical={c: distinct.get(c, 0) for c in categorical},
        duplicates=P.duplicate_count(df), outliers=outliers, outlier_rows=outlier_rows, correlated=correlated,
        skewed=[c for c, f in facts.items() if abs(f["skew"] or 0.0) >= SKEWED],
        inconsistent=[c for c, s in zip(strings, shares) if s is not None and s >= INCONSISTENT],
        balance=P.class_balance(df, P.find_target(df, distinct)))
    _advise(health)
    return health


# The wording of issues and fixes and the limits in them. Each issue is (holds, text); each fix is
# (holds, name, reason, confidence). All take the report `h` and the facts `x` of `_weighed`.
ISSUES = [
    (lambda h, x: h.duplicates, lambda h, x: f"Duplicate rows found: {h.duplicates}"),
    (lambda h, x: h.missing, lambda h, x: "Missing values detected"),
    (lambda h, x: h.outlier_rows, lambda h, x: "Potential outliers detected"),
    (lambda h, x: h.skewed, lambda h, x: f"Skewed numeric features detected: {len(h.skewed)}"),
    (lambda h, x: h.categorical, lambda h, x: f"Categorical columns detected: {len(h.categorical)}"),
    (lambda h, x: h.inconsistent, lambda h, x: f"Possible type inconsistencies: {len(h.inconsistent)}"),
    (lambda h, x: h.balance["imbalanced"], lambda h, x: "Class imbalance detected"),
]
FIXES = [
    (lambda h, x: h.duplicates, "remove_duplicates", lambda h, x: f"{h.duplicates} duplicate rows detected",
     lambda h, x: "high" if h.duplicates / x["rows"] >= 0.01 else "medium"),
    (lambda h, x: x["gaps"] and x["near"], "knn_imputation", lambda h, x: f"{x['gaps']} missing numeric values detected", "high"),
    (lambda h, x: x["gaps"] and not x["near"], "simple_numeric_imputation",
     lambda h, x: f"{x['gaps']} missing numeric values detected", "medium"),
    (lambda h, x: x["label_gaps"], "categorical_mode_imputation",
     lambda h, x: f"{x['label_gaps']} missing categorical values detected", "high"),
    (lambda h, x: h.outlier_rows and x["forest"], "isolation_forest_outlier_removal",
     lambda h, x: f"{h.outlier_rows} outlier rows ({x['far']:.1%}) detected in numeric features", "medium"),
    (lambda h, x: h.outlier_rows and not x["forest"], "iqr_outlier_treatment",
     lambda h, x: f"{h.outlier_rows} potential outlier rows detected; conservative capping is safer", "medium"),
    (lambda h, x: x["positive"], "log_transform", lambda h, x: f"{x['positive']} skewed positive numeric columns found", "medium"),
    (lambda h, x: h.skewed and not x["positive"], "power_transform",
     lambda h, x: "Skewed numeric columns include non-positive values", "low"),
    (lambda h, x: x["few"], "one_hot_encoding", lambda h, x: f"{x['few']} low-cardinality categorical columns", "high"),
    (lambda h, x: x["many"], "frequency_encoding", lambda h, x: f"{x['many']} high-cardinality categorical columns", "high"),
    (lambda h, x: h.inconsistent, "fix_column_types",
     lambda h, x: f"{len(h.inconsistent)} columns look numeric/datetime but are stored as text", "medium"),
    (lambda h, x: h.balance["imbalanced"], "class_weight_or_resampling",
     lambda h, x: f"Imbalance ratio is {h.balance['ratio']}", "medium"),
    (lambda h, x: (x["spread"] or 0.0) >= 10.0, "normalize_numeric_features",
     lambda h, x: f"Numeric feature scale spread ratio is {x['spread']:.2f}", "medium"),
]


def _weighed(h: Health) -> dict:
    """What the rules weigh besides the report's own numbers."""
    rows = max(h.rows, 1)
    few = sum(n <= LOW_CARDINALITY for n in h.categorical.values())
    far = h.outlier_rows / rows
    return {"rows": rows, "near": len(h.numeric) >= 2 and rows >= 30, "far": far,
            "gaps": h.missing_in(h.numeric), "label_gaps": h.missing_in(h.categorical),
            "forest": len(h.numeric) >= 3 and rows >= 100 and far >= 0.02,
            "positive": sum((h.numeric[c]["min"] or 0.0) > 0 for c in h.skewed),
            "few": few, "many": len(h.categorical) - few, "spread": P.scale_spread(h.numeric)}


def _advise(h: Health) -> None:
    x = _weighed(h)
    h.issues.extend(text(h, x) for holds, text in ISSUES if holds(h, x))
    h.fixes.extend((name, reason(h, x), sure if isinstance(sure, str) else sure(h, x))
                   for holds, name, reason, sure in FIXES if holds(h, x))


def health_table(df: DataFrame, health: Health | None = None) -> DataFrame:
    """The report as rows (column, metric, value); facts of the table have column '*'."""
    h = health or analyze(df)
    rows: list[tuple] = [("*", m, float(v)) for m, v in {
        "rows": h.rows, "columns": len(h.columns), "missing_values": h.missing, "duplicates": h.duplicates,
        "outlier_rows": h.outlier_rows, "numeric_columns": len(h.numeric), "categorical_columns": len(h.categorical),
        "correlated_pairs": len(h.correlated), "skewed_columns": len(h.skewed),
        "inconsistent_columns": len(h.inconsistent), "imbalance_ratio": h.balance["ratio"] or 0.0}.items()]
    for c in h.columns:
        rows.append((c, "missing", float(h.nulls[c])))
        if c in h.numeric:
            rows.append((c, "outliers", float(h.outliers[c])))
            rows.append((c, "skew", h.numeric[c]["skew"]))
        if c in h.categorical:
            rows.append((c, "distinct", float(h.categorical[c])))
    return P.table_of(df, rows, "column string, metric string, value double")


def column_types(df: DataFrame) -> DataFrame:
    """Columns per type; from the schema, without a job."""
    return P.table_of(df, [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                      "column string, type string")


def fixes_table(df: DataFrame, health: Health | None = None) -> DataFrame:
    h = health or analyze(df)
    return P.table_of(df, [(i + 1, *f) for i, f in enumerate(h.fixes)],
                      "position int, fix string, reason string, confidence string")


# ---------------------------------------------------------------- score

# The most each part may take off the score.
PENALTY_CAPS = {"missing_values": 25.0, "duplicate_rows": 15.0, "outliers": 20.0, "skewness": 10.0,
                "type_inconsistency": 15.0, "imbalance": 15.0}


def quality(h: Health) -> dict[str, float]:
    """Score from 0 to 100 and what each part takes off."""
    rows, cols = max(h.rows, 1), max(len(h.columns), 1)
    share = {"missing_values": h.missing / (rows * cols), "duplicate_rows": h.duplicates / rows,
             "outliers": h.outlier_rows / rows, "skewness": len(h.skewed) / cols,
             "type_inconsistency": len(h.inconsistent) / cols}
    loss = {k: min(PENALTY_CAPS[k], 100.0 * v) for k, v in share.items()}
    ratio = h.balance["ratio"] if h.balance["imbalanced"] else 1.0
    loss["imbalance"] = min(PENALTY_CAPS["imbalance"], 3.0 * (ratio - 1.0))
    score = min(100.0, max(0.0, 100.0 - sum(loss.values())))
    return {"score": round(score, 2), **{f"{k}_penalty": round(v, 2) for k, v in loss.items()}}


def quality_table(df: DataFrame, health: Health | None = None) -> DataFrame:
    q = quality(health or analyze(df))
    return P.table_of(df, [tuple(q.values())], ", ".join(f"{k} double" for k in q))


def quality_snapshot(df: DataFrame, health: Health | None = None) -> DataFrame:
    h = health or analyze(df)
    return P.table_of(df, [(quality(h)["score"], len(h.issues), h.duplicates, h.missing, h.outlier_rows)],
                      "score double, issues_count bigint, duplicates bigint, missing_total bigint, outlier_rows bigint")


# ---------------------------------------------------------------- suggested steps

# Reasons given with the steps.
REASONS = {
    "remove_duplicates": "duplicate rows detected",
    "knn_imputation": "missing values present in multi-feature data",
    "simple_imputation": "missing values present",
    "fix_column_types": "data type inconsistencies found",
    "frequency_encoding": "high-cardinality categorical variables found",
    "one_hot_encoding": "low-cardinality categorical variables found",
    "log_transform": "skewed numeric distributions detected",
    "isolation_forest_outlier_removal": "potential outliers detected",
    "standardization": "numeric features benefit from scaling",
    "pca": "high-dimensional feature space detected",
}


def suggest(h: Health) -> dict:
    """Ordered steps for a table with this health, and a confidence."""
    high = [c for c, n in h.categorical.items() if n > LOW_CARDINALITY]
    wanted = {
        "remove_duplicates": h.duplicates > 0,
        "knn_imputation": h.missing > 0 and len(h.numeric) >= 2,
        "simple_imputation": h.missing > 0 and len(h.numeric) < 2,
        "fix_column_types": bool(h.inconsistent),
        "frequency_encoding": bool(high),
        "one_hot_encoding": len(high) < len(h.categorical),
        "log_transform": bool(h.skewed),
        "isolation_forest_outlier_removal": h.outlier_rows > 0,
        "standardization": bool(h.numeric),
        "pca": len(h.columns) >= 50 or len(h.numeric) >= 20,
    }
    steps = [(s, REASONS[s]) for s, use in wanted.items() if use]
    confidence = min(0.98, 0.60 + 0.05 * len(steps) + (0.05 if h.rows > 1000 else 0.0))
    return {"steps": steps, "confidence": round(confidence, 2)}


def suggested_steps(df: DataFrame, health: Health | None = None) -> DataFrame:
    found = suggest(health or analyze(df))
    return P.table_of(df, [(i + 1, s, r, found["confidence"]) for i, (s, r) in enumerate(found["steps"])],
                      "step_no int, step string, reason string, confidence double")
