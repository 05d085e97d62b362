"""Type repair, narrowing, simple imputation and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.base import Step, step
from millrace.functions.casts import to_moment, to_number
from millrace.operators.profile import base_facts, groupable, value_counts
from millrace.operators.quantiles import percentiles
from millrace.runtime import agg_rows
from millrace.schema import col, dbl


@step("fix_column_types")
class FixTypes(Step):
    """Strings of which at least 90 % parse become numbers, else moments; the rest is left."""

    @classmethod
    def defaults(cls):
        return {"threshold": 0.9, "columns": None}

    def learn(self, df):
        strings = self.options["columns"] or S.cat_encode(df)
        exprs = []
        for c in strings:
            present = col(c).isNotNull()
            exprs += [F.avg(F.when(present, parse(col(c)).isNotNull().cast("double")))
                      for parse in (to_number, to_moment)]
        got = agg_rows(df, exprs)
        kinds = {}
        for i, c in enumerate(strings):
            number, moment = got[2 * i], got[2 * i + 1]
            if number is not None and number >= self.options["threshold"]:
                kinds[c] = "number"
            elif moment is not None and moment >= self.options["threshold"]:
                kinds[c] = "moment"
        return {"kinds": kinds}

    @staticmethod
    def apply(df, params):
        parse = {"number": to_number, "moment": to_moment}
        return df.withColumns({c: parse[k](col(c)) for c, k in params["kinds"].items()})


# The largest value that still fits, per narrow type.
INT_LIMIT = 2147483647
FLOAT_LIMIT = 3.4e38


@step("narrow_types")
class NarrowTypes(Step):
    """bigint to int and double to float where all values fit, on both sides."""

    def learn(self, df):
        from pyspark.sql import types as T

        narrow = {}
        wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType))]
        got = agg_rows(df, [e for f in wide for e in (F.min(col(f.name)), F.max(col(f.name)))])
        for i, f in enumerate(wide):
            low, high = got[2 * i], got[2 * i + 1]
            if low is None:
                continue
            limit, kind = (INT_LIMIT, "int") if isinstance(f.dataType, T.LongType) else (FLOAT_LIMIT, "float")
            if -limit < low and high < limit:
                narrow[f.name] = kind
        return {"narrow": narrow}

    @staticmethod
    def apply(df, params):
        return df.withColumns({c: col(c).cast(k) for c, k in params["narrow"].items()})


@step("simple_imputation")
class SimpleImpute(Step):
    """Numerics by mean or median, all other columns by their most frequent value.

    Ties go to the smallest value; a column without any value stays empty, unless
    `empty_text` gives a text for such string columns.
    """

    @classmethod
    def defaults(cls):
        return {"strategy": "median", "numeric": None, "categorical": None, "empty_text": None}

    def learn(self, df):
        numeric = S.numeric(df) if self.options["numeric"] is None else self.options["numeric"]
        others = S.cat_impute(df) if self.options["categorical"] is None else self.options["categorical"]
        if self.options["strategy"] == "mean":
            numbers = {c: f["mean"] for c, f in base_facts(df, numeric).items()}
        else:
            numbers = {c: q[0] for c, q in percentiles(df, numeric, [0.5]).items()}
        texts = most_frequent(df, others)
        if self.options["empty_text"] is not None:
            strings = set(S.cat_encode(df))
            texts.update({c: self.options["empty_text"] for c in others if c in strings and c not in texts})
        return {"numbers": numbers, "texts": texts}

    @staticmethod
    def apply(df, params):
        fills = {c: F.coalesce(dbl(c), F.lit(float(v))) for c, v in params["numbers"].items() if v is not None}
        for c, v in params["texts"].items():
            fills[c] = F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType))
        return df.withColumns(fills)


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent present value per column, printed; ties by the value's own order."""
    out = {}
    grouped = [c for c in columns if c in S.cat_encode(df)]
    if grouped:
        from millrace.operators.profile import modes

        out.update({r["column"]: r["mode"] for r in modes(df, grouped).collect()})
    for c in [c for c in columns if c not in grouped]:
        best = (df.filter(col(c).isNotNull()).groupBy(col(c).alias("v")).count()
                .agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("v"))).alias("b"))
                .select(F.col("b.v").cast("string")).first()[0])
        if best is not None:
            out[c] = best
    return out


def dedupe(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
           order_by: list[str] | None = None) -> DataFrame:
    """One row per value of `subset` (default: whole rows), or only the rows without a copy.

    `first` and `last` are by `order_by`, which a subset needs, as rows have no
    order of their own. The rank filter is applied per task before the shuffle,
    and groupings combine per task, so many copies of one value stay cheap.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    S.require(df, subset or [])
    if subset is None:
        if keep is not False and not any(f.dataType.typeName() == "map" for f in df.schema.fields):
            return df.dropDuplicates()
        if keep is not False:  # maps have no equality of their own; `groupable` gives them one
            rows = df.groupBy(*groupable(df)).agg(F.any_value(F.struct(*[col(c) for c in df.columns])).alias("__row"))
            return rows.select(*[F.col("__row")[c].alias(c) for c in df.columns])
        return df.groupBy(*groupable(df)).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")
    if keep is False:
        rest = [c for c in df.columns if c not in subset]
        row = F.any_value(F.struct(*[col(c) for c in rest])) if rest else F.lit(None)
        alone = (df.groupBy(*[col(c) for c in subset])
                 .agg(F.count(F.lit(1)).alias("__n"), row.alias("__row")).filter("__n = 1"))
        return alone.select(*[F.col("__row")[c].alias(c) if c in rest else col(c) for c in df.columns])
    if not order_by:
        raise ValueError("keep='first' or 'last' on a subset needs order_by")
    order = [col(c).asc() if keep == "first" else col(c).desc() for c in order_by]
    ranked = df.withColumn("__rank", F.row_number().over(
        Window.partitionBy(*[col(c) for c in subset]).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


@step("deduplication")
class Deduplicate(Step):
    @classmethod
    def defaults(cls):
        return {"subset": None, "keep": "first", "order_by": None}

    def learn(self, df):
        return dict(self.options)

    @staticmethod
    def apply(df, params):
        return dedupe(df, params["subset"], params["keep"], params["order_by"])
