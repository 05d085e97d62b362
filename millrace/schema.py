"""Column selectors by type class.

Four different ideas of "categorical" are in use, one per family of operators,
so each has its own selector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def _pick(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """Numeric columns; booleans are not numeric."""
    return [c for c in _pick(df, lambda t: isinstance(t, NUMERIC_TYPES)) if c not in exclude]


def cat_profile(df: DataFrame) -> list[str]:
    """Categorical for profiles: strings and booleans."""
    return _pick(df, lambda t: isinstance(t, (T.StringType, T.BooleanType)))


def cat_encode(df: DataFrame) -> list[str]:
    """Categorical for encoders and reports: strings."""
    return _pick(df, lambda t: isinstance(t, T.StringType))


def cat_impute(df: DataFrame) -> list[str]:
    """Categorical for imputers: every atomic column that is not numeric."""
    return _pick(df, lambda t: not isinstance(t, NUMERIC_TYPES + NESTED_TYPES))


def text_columns(df: DataFrame, min_length: float = 10) -> list[str]:
    """String columns whose mean length is at least `min_length`.

    A missing value counts as the three characters of its printed form.
    """
    strings = cat_encode(df)
    if not strings:
        return []
    means = df.agg(*[
        F.avg(F.coalesce(F.length(col(c)), F.lit(3))).alias(f"c{i}") for i, c in enumerate(strings)
    ]).first()
    return [c for i, c in enumerate(strings) if means[i] is not None and means[i] >= min_length]


def col(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def dbl(name: str) -> Column:
    """Column as double, NaN read as missing."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the given columns, as doubles without NaN; one cast per column however often it is used."""
    floats = (T.FloatType, T.DoubleType)
    return df.select(*[(dbl(c) if isinstance(df.schema[c].dataType, floats) else col(c).cast("double")).alias(c)
                       for c in columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats become null, so that aggregates skip them."""
    floats = _pick(df, lambda t: isinstance(t, (T.FloatType, T.DoubleType)))
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a float column."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def require(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table has no {missing}")
