"""Profiles: statistics, missing cells, duplicates, distinct values, shape of distributions.

Numeric profiles are global aggregates, so only a few numbers per column reach
the driver. Value counts stay distributed.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.operators.lookup import lookup_join
from millrace.operators.moments import pair_moments
from millrace.operators.quantiles import percentiles
from millrace.runtime import BROADCAST_BYTES, agg_rows, release, settle
from millrace.schema import col, dbl

# Names that mark a target column, in the order they are tried.
TARGET_NAMES = ["target", "label", "class", "y", "outcome"]
MAX_TARGET_VALUES = 20
# Columns whose moments are taken in one job: the code for more is too long for the JVM to compile. Each job reads only its own.
FACT_COLUMNS = 4


def table_of(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small result (bounded by the number of columns) as a DataFrame."""
    return df.sparkSession.createDataFrame(rows, schema)


def _finite(x) -> float | None:
    return float(x) if x is not None and math.isfinite(x) else None


# ---------------------------------------------------------------- numeric

def base_facts(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """count, mean, std (sample and population), min, max and G1 skew per column; one job per FACT_COLUMNS of them."""
    columns = S.numeric(df) if columns is None else columns
    exprs: list[Column] = []
    for c in columns:
        x = col(c)
        exprs += [F.count(x), F.avg(x), F.stddev_samp(x), F.stddev_pop(x), F.min(x), F.max(x), F.skewness(x)]
    got = agg_rows(S.doubles(df, columns), exprs, 7 * FACT_COLUMNS) if exprs else []
    out = {}
    for i, c in enumerate(columns):
        n, mean, std, std_pop, low, high, g1 = got[7 * i:7 * i + 7]
        if n and low == high:  # sums of a constant keep rounding noise where partial sums meet
            mean, std, std_pop, g1 = low, 0.0 if n > 1 else std, 0.0, None
        skew = None
        if n and n > 2:
            skew = 0.0 if g1 is None or math.isnan(g1) else g1 * math.sqrt(n * (n - 1)) / (n - 2)
        out[c] = {"count": n, "mean": mean, "std": std, "std_pop": std_pop,
                  "min": low, "max": high, "skew": skew}
    return out


def numeric_facts(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """`base_facts` with quartiles; a second job."""
    facts = base_facts(df, columns)
    quartiles = percentiles(df, list(facts), [0.25, 0.5, 0.75], {c: f["count"] for c, f in facts.items()})
    for c, f in facts.items():
        f["q25"], f["median"], f["q75"] = quartiles[c]
    return facts


def numeric_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = ["mean", "median", "std", "min", "max", "q25", "q75"]
    rows = [(c, *[_finite(f[k]) for k in names]) for c, f in numeric_facts(df, columns).items()]
    return table_of(df, rows, "column string, " + ", ".join(f"{k} double" for k in names))


def percentile_list(df: DataFrame, columns: list[str] | None = None,
                    points: list[float] | None = None) -> DataFrame:
    """Rows (column, p, value) with p named p0, p25, ..."""
    columns = columns or S.numeric(df)
    points = [0, 25, 50, 75, 100] if points is None else points
    found = percentiles(df, columns, [p / 100 for p in points])
    rows = [(c, f"p{int(p)}", found[c][i]) for c in columns for i, p in enumerate(points)]
    return table_of(df, rows, "column string, percentile string, value double")


def bounds(facts: dict, factor: float) -> tuple[float, float] | None:
    if facts["q25"] is None:
        return None
    spread = facts["q75"] - facts["q25"]
    return facts["q25"] - factor * spread, facts["q75"] + factor * spread


def outside(name: str, limits: tuple[float, float] | None) -> Column:
    """True where a present value lies outside; never null, and false for NaN."""
    if limits is None:
        return F.lit(False)
    x = dbl(name)
    return F.coalesce((x < limits[0]) | (x > limits[1]), F.lit(False))


def outlier_counts(df: DataFrame, factor: float = 1.5, skip_constant_spread: bool = True,
                   facts: dict | None = None) -> tuple[dict[str, int], int]:
    """Flagged values per column and rows flagged in any column.

    With `skip_constant_spread` a column whose quartiles coincide counts 0.
    """
    facts = numeric_facts(df) if facts is None else facts
    flags = {}
    for c, f in facts.items():
        flat = f["q25"] is None or f["q75"] == f["q25"]
        flags[c] = F.lit(False) if skip_constant_spread and flat else outside(c, bounds(f, factor))
    if not flags:
        return {}, 0
    any_flag = F.lit(False)
    for flag in flags.values():
        any_flag = any_flag | flag
    got = agg_rows(S.doubles(df, list(flags)), [F.count_if(f) for f in flags.values()] + [F.count_if(any_flag)])
    return dict(zip(flags, got)), got[-1]


def outlier_report(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Rows (column, outliers), and one row `(any)` with the flagged rows."""
    counts, flagged = outlier_counts(df, factor)
    return table_of(df, [*counts.items(), ("(any)", flagged)], "column string, outliers bigint")


def outlier_counts_plain(df: DataFrame, factor: float = 1.5) -> DataFrame:
    counts, _ = outlier_counts(df, factor, skip_constant_spread=False)
    return table_of(df, list(counts.items()), "column string, outliers bigint")


def skewed_columns(df: DataFrame, threshold: float = 1.0, facts: dict | None = None) -> DataFrame:
    facts = base_facts(df) if facts is None else facts
    rows = [(c, f["skew"]) for c, f in facts.items() if abs(f["skew"] or 0.0) >= threshold]
    return table_of(df, rows, "column string, skew double")


def scale_spread(facts: dict[str, dict]) -> float | None:
    """Largest std over smallest non-zero std."""
    stds = [f["std"] for f in facts.values() if f["std"]]
    return max(stds) / max(min(stds), 1e-12) if stds else None


def box_summary(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    facts = numeric_facts(df, columns)
    counts, _ = outlier_counts(df, factor, False, facts)
    rows = []
    for c, f in facts.items():
        low, high = bounds(f, factor) or (None, None)
        rows.append((c, f["min"], f["q25"], f["median"], f["q75"], f["max"], low, high, counts[c]))
    return table_of(df, rows, "column string, min double, q25 double, median double, q75 double, "
                              "max double, lower_fence double, upper_fence double, outliers bigint")


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 30, first: int = 5) -> DataFrame:
    """Rows (column, bin, low, high, count) of equal-width bins; empty bins are left out."""
    columns = S.numeric(df)[:first] if columns is None else columns
    facts = base_facts(df, columns)
    cells = []
    for c in columns:
        f = facts[c]
        if not f["count"]:
            continue
        width = (f["max"] - f["min"]) / bins
        at = F.least(F.floor((dbl(c) - f["min"]) / width), F.lit(bins - 1)) if width else F.lit(0)
        cells.append(F.when(dbl(c).isNotNull(), F.struct(
            F.lit(c).alias("column"), at.cast("int").alias("bin"),
            F.lit(f["min"]).alias("start"), F.lit(width).alias("width"))))
    if not cells:
        return table_of(df, [], "column string, bin int, low double, high double, count bigint")
    counts = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*")
              .groupBy("column", "bin", "start", "width").agg(F.count(F.lit(1)).alias("count")))
    return counts.select(
        "column", "bin", (F.col("start") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"), "count")


def reciprocal_of(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """1/x of numeric columns; zero has none."""
    columns = S.numeric(df) if columns is None else columns
    return df.withColumns({c: F.lit(1.0) / F.nullif(dbl(c), F.lit(0.0)) for c in columns})


def squared_of(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = S.numeric(df) if columns is None else columns
    return df.withColumns({c: dbl(c) * dbl(c) for c in columns})


# ---------------------------------------------------------------- pairs

def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson over the rows where both values are present, as (row_col, col_col, value)."""
    columns = S.numeric(df) if columns is None else columns
    moments = pair_moments(df, columns)
    rows = [(a, b, moments.correlation(a, b)) for a in columns for b in columns]
    return table_of(df, rows, "row_col string, col_col string, value double")


def correlated_pairs(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    columns = S.numeric(df)
    rows = []
    if len(columns) >= 2:
        moments = pair_moments(df, columns)
        for a, b in combinations(columns, 2):
            r = moments.correlation(a, b)
            if abs(r or 0.0) >= threshold:
                rows.append((a, b, r))
    return table_of(df, rows, "first string, second string, correlation double")


# ---------------------------------------------------------------- missing, duplicates

def null_tally(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and missing cells per column; one job."""
    got = agg_rows(df, [F.count(F.lit(1))] + [F.count_if(S.is_missing(df, c)) for c in df.columns])
    return got[0], dict(zip(df.columns, got[1:]))


def null_counts(df: DataFrame) -> DataFrame:
    rows, nulls = null_tally(df)
    share = {c: round(n / rows * 100, 2) if rows else 0.0 for c, n in nulls.items()}
    ordered = sorted(nulls, key=lambda c: (-share[c], c))
    return table_of(df, [(c, nulls[c], share[c]) for c in ordered],
                    "column string, null_count bigint, null_pct double")


def groupable(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Columns fit for grouping: maps are compared by their sorted entries."""
    columns = df.columns if columns is None else columns
    return [F.array_sort(F.map_entries(col(c))).alias(c) if df.schema[c].dataType.typeName() == "map"
            else col(c) for c in columns]


def copy_tally(df: DataFrame, subset: list[str] | None = None) -> tuple[int, int]:
    """Rows, and rows beyond the first copy; null equals null.

    Rows are grouped by two 64-bit hashes, so only hashes are shuffled; whole rows are compared only where a pair of hashes
    occurs more than once, and are combined per task before they meet.
    """
    cells = df.select(*groupable(df, subset))
    names = [col(c) for c in cells.columns]
    keyed = cells.withColumns({"__a": F.xxhash64(*names), "__b": F.xxhash64(F.lit(1), *names)})
    tally = keyed.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    rows, beyond = tally.agg(F.sum("__n"), F.sum(F.col("__n") - 1)).first()
    if not beyond:
        return rows or 0, 0
    shared = settle(tally.filter("__n > 1"), "copies")
    if shared.count() * 64 <= BROADCAST_BYTES:  # three numbers a row
        again = keyed.join(F.broadcast(shared), ["__a", "__b"], "left_semi")
    else:
        both = F.struct("__a", "__b")
        table = shared.select(both.alias("__h"), "__n", F.lit(True).alias("__shared"))
        again = lookup_join(keyed.withColumn("__h", both), table, "__h", "__n", rows, small=False).filter("__shared")
    again = again.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    found = again.agg(F.sum(F.col("__n") - 1)).first()[0] or 0
    release(shared)
    return rows, found


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> int:
    return copy_tally(df, subset)[1]


def duplicate_rows(df: DataFrame) -> DataFrame:
    rows, duplicates = copy_tally(df)
    return table_of(df, [(rows, duplicates, duplicates / rows * 100 if rows else 0.0)],
                    "rows bigint, duplicates bigint, duplicate_pct double")


# ---------------------------------------------------------------- values

def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value) of every cell, values in printed form."""
    cells = [F.struct(F.lit(c).alias("column"), _printed(df, c).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.column", "cell.value")


def _printed(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return (dbl(name) + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    return col(name).cast("string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value, count), null included; combined before the shuffle."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_tally(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct present values per column; one job."""
    if not columns:
        return {}
    return {r["column"]: r["distinct"] for r in distinct_counts(df, columns).collect()}


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = df.columns if columns is None else columns
    return (value_counts(df, columns).groupBy("column")
            .agg(F.count("value").alias("distinct")))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column; ties by value.

    The rank filter is applied per task before the rows of a column meet, so a
    column with many values does not pile up in one task.
    """
    columns = S.cat_encode(df) if columns is None else columns
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    return (counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("column", "rank", "value", "count"))


def modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Most frequent value per column; ties go to the smallest."""
    columns = S.cat_encode(df) if columns is None else columns
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("best")
    return counts.groupBy("column").agg(best).select(
        "column", F.col("best.value").alias("mode"), (-F.col("best.n")).alias("count"))


# ---------------------------------------------------------------- target

def find_target(df: DataFrame, distinct: dict[str, int] | None = None) -> str | None:
    """The target column by name, else the last string or boolean column with 2 to 20 values."""
    lowered = {c.lower(): c for c in df.columns}
    for name in TARGET_NAMES:
        if name in lowered:
            return lowered[name]
    candidates = S.cat_profile(df)
    distinct = distinct_tally(df, candidates) if distinct is None else distinct
    fitting = [c for c in candidates if 2 <= distinct.get(c, 0) <= MAX_TARGET_VALUES]
    return fitting[-1] if fitting else None


def class_balance(df: DataFrame, target: str | None) -> dict:
    """Largest over smallest class of the target, null being a class of its own."""
    if not target:
        return {"detected": False, "label_column": None, "classes": 0, "ratio": None, "imbalanced": False}
    sizes = df.select(*groupable(df, [target])).groupBy(col(target)).count().agg(
        F.count(F.lit(1)).alias("classes"), F.max("count").alias("top"), F.min("count").alias("low")).first()
    if sizes["classes"] <= 1:
        return {"detected": False, "label_column": target, "classes": sizes["classes"],
                "ratio": None, "imbalanced": False}
    ratio = sizes["top"] / max(sizes["low"], 1)
    return {"detected": True, "label_column": target, "classes": sizes["classes"],
            "ratio": round(ratio, 3), "imbalanced": ratio >= 3.0}


def class_imbalance(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows (label, count) of the target with the table-wide ratio and verdict."""
    target = target or find_target(df)
    balance = class_balance(df, target)
    if not balance["detected"]:
        return table_of(df, [], "label_column string, label string, count bigint, ratio double, imbalanced boolean")
    counts = df.groupBy(col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.lit(target).alias("label_column"), "label", "count",
                         F.lit(balance["ratio"]).alias("ratio"), F.lit(balance["imbalanced"]).alias("imbalanced"))


def numeric_looking(df: DataFrame) -> dict[str, float]:
    """Share of present values that parse as a number, per string column; one job."""
    from millrace.functions.casts import to_number

    strings = S.cat_encode(df)
    if not strings:
        return {}
    got = agg_rows(df, [F.avg(F.when(col(c).isNotNull(), to_number(col(c)).isNotNull().cast("double")))
                        for c in strings])
    return {c: v for c, v in zip(strings, got) if v is not None}


def type_inconsistencies(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    rows = [(c, share) for c, share in numeric_looking(df).items() if share >= threshold]
    return table_of(df, rows, "column string, numeric_share double")
