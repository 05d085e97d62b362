"""Column and row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.base import Step, step
from millrace.operators.moments import pair_moments
from millrace.operators.scale import _filled_spread, filled
from millrace.runtime import agg_rows
from millrace.schema import col

CLASSES = {"numeric": S.numeric, "cat_profile": S.cat_profile, "cat_encode": S.cat_encode,
           "cat_impute": S.cat_impute, "text": S.text_columns}


def by_class(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[col(c) for c in CLASSES[kind](df)])


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def search_rows(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Rows in which some column's printed form contains the query, case ignored."""
    def hit(c):
        text = F.coalesce(col(c).cast("string"), F.lit(""))
        return F.rlike(text, F.lit(f"(?i){query}")) if regex else F.contains(F.lower(text), F.lit(query.lower()))

    return df.filter(_any([hit(c) for c in df.columns]))


def incomplete_rows(df: DataFrame) -> DataFrame:
    """Rows with a null or an empty string."""
    return df.filter(_any([S.is_missing(df, c) | F.coalesce(col(c).cast("string") == "", F.lit(False))
                           for c in df.columns]))


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop()


def structure_warnings(df: DataFrame, many_rows: int = 1_000_000, null_share: float = 0.5) -> DataFrame:
    """One row (valid, rows, null_cells, warnings); an empty table is not valid."""
    nulls = F.lit(0).cast("long")
    for c in df.columns:
        nulls = nulls + S.is_missing(df, c).cast("long")
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"))
    rows = F.col("rows")
    # The wording of the warnings.
    warnings = F.array_compact(F.array(
        F.when(rows == 0, F.lit("DataFrame is empty")),
        F.when(rows > many_rows, F.concat(F.lit("Large dataset ("), F.format_number(rows, 0),
                                          F.lit(" rows) may be slow"))),
        F.when((rows > 0) & (F.col("null_cells") > rows * null_share), F.lit("More than 50% missing values"))))
    return facts.select((rows > 0).alias("valid"), "rows", "null_cells", F.array_join(warnings, "; ").alias("warnings"))


@step("correlation_filter")
class CorrelationFilter(Step):
    """Drops a numeric column when an earlier one correlates with it above the threshold."""

    @classmethod
    def defaults(cls):
        return {"threshold": 0.95, "columns": None}

    def learn(self, df):
        columns = self.options["columns"] or S.numeric(df)
        if len(columns) < 2:
            raise ValueError("a correlation filter compares two or more numeric columns")
        moments = pair_moments(df, columns)
        drop = [c for j, c in enumerate(columns)
                if any(abs(moments.correlation(b, c) or 0.0) > self.options["threshold"] for b in columns[:j])]
        return {"drop": drop}

    @staticmethod
    def apply(df, params):
        return df.drop(*params["drop"])

    def describe(self, params):
        return {"removed_features": params["drop"], "n_removed": len(params["drop"])}


@step("variance_threshold")
class VarianceThreshold(Step):
    """Keeps mean-filled numerics whose population variance passes the threshold, then the other columns."""

    @classmethod
    def defaults(cls):
        return {"threshold": 0.0}

    def learn(self, df):
        columns = S.numeric(df)
        if not columns:
            raise ValueError("a variance threshold needs a numeric column")
        spread = _filled_spread(df, columns)
        keep = {c: f["mean"] for c, f in spread.items()
                if f["std_pop"] is not None and f["std_pop"] ** 2 > self.options["threshold"]}
        if not keep:
            raise ValueError("no column varies by more than the threshold")
        return {"keep": keep, "numeric": columns}

    @staticmethod
    def apply(df, params):
        others = [col(c) for c in df.columns if c not in params["numeric"]]
        return df.select(*[filled(c, m).alias(c) for c, m in params["keep"].items()], *others)

    def describe(self, params):
        return {"selected_features": list(params["keep"]),
                "removed_features": [c for c in params["numeric"] if c not in params["keep"]]}


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sorted by one column, nulls last either way."""
    return df.orderBy(col(column).asc_nulls_last() if ascending else col(column).desc_nulls_last())


def head(df: DataFrame, order_by: list[str], n: int = 5, as_text: bool = False) -> DataFrame:
    """First n rows by the given order; optionally in printed form."""
    rows = df.orderBy(*[col(c) for c in order_by]).limit(n)
    return rows.select(*[col(c).cast("string").alias(c) for c in df.columns]) if as_text else rows


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
