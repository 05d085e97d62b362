"""Encoders and binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.base import Step, step
from millrace.operators.lookup import lookup_join
from millrace.operators.profile import base_facts, distinct_tally, value_counts
from millrace.operators.quantiles import percentiles
from millrace.operators.scale import NumericStep, filled, numeric_step, _mean_filled
from millrace.runtime import BROADCAST_BYTES, release, scratch_path, settle
from millrace.schema import col, dbl

# Widest table an encoder may build; beyond it the long form is the way.
MAX_WIDTH = 5_000


def _encoded(df: DataFrame, columns, purpose="encoding") -> list[str]:
    columns = columns or S.cat_encode(df)
    S.require(df, columns)
    if not columns:
        raise ValueError(f"{purpose} needs at least one column of text")
    return columns


def categories(df: DataFrame, columns: list[str], limit: int, with_null: bool) -> dict[str, list]:
    """Sorted categories per column; an error when together they pass `limit`.

    The sizes are counted before anything is collected.
    """
    sizes = distinct_tally(df, columns)
    if sum(sizes.values()) > limit:
        raise ValueError(f"{sum(sizes.values())} categories pass the limit of {limit}; `one_hot_long` has none")
    values = value_counts(df, columns).select("column", "value")
    if not with_null:
        values = values.filter(F.col("value").isNotNull())
    found: dict[str, list] = {c: [] for c in columns}
    for row in values.collect():
        found[row["column"]].append(row["value"])
    return {c: sorted(v, key=lambda x: (x is None, x or "")) for c, v in found.items()}


@step("one_hot")
class OneHot(Step):
    """0/1 columns `column_value` in sorted order; null is a category of its own.

    `dummies=True` gives boolean columns and none for null.
    """

    @classmethod
    def defaults(cls):
        return {"columns": None, "max_width": MAX_WIDTH, "dummies": False}

    def learn(self, df):
        columns = _encoded(df, self.options["columns"])
        found = categories(df, columns, self.options["max_width"], not self.options["dummies"])
        return {"categories": found, "dummies": self.options["dummies"]}

    @staticmethod
    def apply(df, params):
        keep = [col(c) for c in df.columns if c not in params["categories"]]
        new = []
        for c, values in params["categories"].items():
            for v in values:
                # Through the printed form, so that booleans match their names.
                hit = col(c).cast("string").eqNullSafe(F.lit(v).cast("string"))
                cell = hit if params["dummies"] else hit.cast("double")
                new.append(cell.alias(f"{c}_{v}"))
        return df.select(*keep, *new)

    def describe(self, params):
        new = [f"{c}_{v}" for c, values in params["categories"].items() for v in values]
        return {"encoded_columns": list(params["categories"]), "new_columns": new, "n_new_features": len(new)}


def one_hot_long(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The ones of a one-hot table as rows (key, feature), for any number of categories."""
    columns = _encoded(df, columns)
    cells = [F.concat_ws("_", F.lit(c), F.coalesce(col(c).cast("string"), F.lit("None"))) for c in columns]
    return df.select(*[col(k) for k in key], F.explode(F.array(*cells)).alias("feature"))


class ValueCodes(Step):
    """Steps that put a number in the place of each value, by a table of (column, value, count, code).

    The table is settled in the shared folder, whatever its size, and a saved step holds its path. `code` is the value's
    place in the sorted values of its column: values are range-partitioned, and each partition's places begin where the
    one before ended. Rows find their value by `lookup_join`.
    """

    def learn(self, df):
        columns = _encoded(df, self.options["columns"])
        counts = settle(value_counts(df, columns), "counts")
        ordered = settle(counts.filter("value is not null").repartitionByRange("column", "value")
                         .sortWithinPartitions("column", "value").withColumn("at", F.monotonically_increasing_id()), "ordered")
        part = F.shiftright("at", 33)
        starts = (ordered.groupBy("column", part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
                  .withColumn("before", F.sum("n").over(Window.partitionBy("column").orderBy("part")) - F.col("n")).drop("n"))
        path = scratch_path(df.sparkSession, "codes")
        (ordered.withColumn("part", part).join(starts, ["column", "part"])
         .select("column", "value", "count", (F.col("at") - F.col("low") + F.col("before")).alias("code")).write.parquet(path))
        size = F.sum(F.octet_length("value") + 64)
        sizes = {r["column"]: (r["n"], r["bytes"]) for r in
                 ordered.groupBy("column").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).collect()}
        nulls = {r["column"]: r["count"] for r in counts.filter("value is null").collect()}  # one row for each column
        release(ordered)
        release(counts)
        return {"table": path, "columns": columns, "rows": df.count(), "nulls": nulls,
                "values": {c: sizes.get(c, (0, 0))[0] for c in columns},
                "small": {c: sizes.get(c, (0, 0))[1] <= BROADCAST_BYTES for c in columns}}

    @staticmethod
    def number(params: dict, name: str) -> Column:
        """The result for a row, from the looked-up `__code` and `__count`."""
        raise NotImplementedError

    @classmethod
    def replace(cls, df: DataFrame, params: dict) -> DataFrame:
        table = df.sparkSession.read.schema("column string, value string, count bigint, code bigint").parquet(params["table"])
        for c in params["columns"]:
            facts = table.filter(F.col("column") == c).select(
                F.col("value").alias("__key"), F.col("count").alias("__weight"), F.col("count").alias("__count"), F.col("code").alias("__code"))
            joined = lookup_join(df.withColumn("__key", col(c).cast("string")), facts, "__key", "__weight", max(params["rows"], 1),
                                 params["small"][c])
            df = joined.withColumn(c, cls.number(params, c)).select(*[col(k) for k in df.columns])
        return df


@step("ordinal")
class Ordinal(ValueCodes):
    """Position in the sorted categories as double; null stays null, unseen is -1."""

    @classmethod
    def defaults(cls):
        return {"columns": None}

    @staticmethod
    def number(params, name):
        return F.when(col(name).isNotNull(), F.coalesce(F.col("__code").cast("double"), F.lit(-1.0)))

    @staticmethod
    def apply(df, params):
        return Ordinal.replace(df, params)

    def describe(self, params):
        return {"encoded_columns": params["columns"], "n_categories": params["values"]}


@step("frequency_encoding")
class Frequency(ValueCodes):
    """Each value becomes its share of all rows, nulls counted; unseen is 0."""

    @classmethod
    def defaults(cls):
        return {"columns": None}

    @staticmethod
    def number(params, name):
        rows = float(max(params["rows"], 1))
        share = F.coalesce(F.col("__count") / F.lit(rows), F.lit(0.0))
        return F.when(col(name).isNull(), F.lit(params["nulls"].get(name, 0) / rows)).otherwise(share)

    @staticmethod
    def apply(df, params):
        return Frequency.replace(df, params)


MIN_BIN = 1e-8


@numeric_step("binning")
class Binning(NumericStep):
    """Bin numbers 0.. as double; bins are [a, b), the last one closed."""

    purpose = "binning"

    @classmethod
    def extra(cls):
        return {"n_bins": 5, "strategy": "quantile", "max_rounds": 300}

    def learn_columns(self, df, columns):
        n, strategy = self.options["n_bins"], self.options["strategy"]
        if strategy not in ("quantile", "uniform", "kmeans"):
            raise ValueError(f"Unknown strategy: {strategy}")
        means, full, counts = _mean_filled(df, columns)
        if strategy == "quantile":
            found = percentiles(full, columns, [i / n for i in range(n + 1)], counts)
            edges = {c: _merged(e) for c, e in found.items()}
        else:
            limits = base_facts(full, columns)
            edges = {c: _even(f["min"], f["max"], n) for c, f in limits.items()}
            if strategy == "kmeans":
                edges = _lloyd(full, edges, {c: f["std_pop"] or 0.0 for c, f in limits.items()}, self.options["max_rounds"])
        return {c: {"mean": means[c], "edges": edges[c]} for c in columns}

    @classmethod
    def value(cls, name, p):
        x = filled(name, p["mean"])
        code = F.lit(0.0)
        for edge in p["edges"][1:-1]:
            code = code + F.when(x >= edge, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(x.isNotNull(), code)


def _even(low, high, n):
    if low is None:
        return []
    return [low, high] if low == high else [low + (high - low) * i / n for i in range(n)] + [high]


def _merged(edges):
    """Edges without those that end a bin narrower than the smallest width."""
    if not edges or edges[0] is None:
        return []
    return edges[:1] + [b for a, b in zip(edges, edges[1:]) if b - a > MIN_BIN]


def _lloyd(df, edges, spread, rounds):
    """One-dimensional k-means from even bins, all columns in one job per round.

    Only the means per bin reach the driver. A column is done when its centres move
    by less than a ten-thousandth of its variance (sum of squared moves).
    """
    centres = {c: [(a + b) / 2 for a, b in zip(e, e[1:])] for c, e in edges.items() if len(e) > 2}
    df = df.select(*centres).persist() if centres else df
    active = set(centres)
    for _ in range(rounds):
        if not active:
            break
        cells = []
        for c in sorted(active):
            at = F.lit(0)
            for left, right in zip(centres[c], centres[c][1:]):
                at = at + F.when(dbl(c) > (left + right) / 2, 1).otherwise(0)
            cells.append(F.struct(F.lit(c).alias("column"), at.alias("at"), dbl(c).alias("x")))
        rows = (df.select(F.explode(F.array(*cells)).alias("s")).filter("s.x is not null")
                .groupBy("s.column", "s.at").agg(F.avg("s.x").alias("m")).collect())
        moved = {c: list(centres[c]) for c in active}
        for r in rows:
            moved[r["column"]][r["at"]] = r["m"]
        active = {c for c in active
                  if sum((a - b) ** 2 for a, b in zip(moved[c], centres[c])) > 1e-4 * spread[c] ** 2}
        centres.update(moved)
    if centres:
        df.unpersist()
    out = dict(edges)
    for c, m in centres.items():
        m = sorted(m)
        out[c] = [edges[c][0], *[(a + b) / 2 for a, b in zip(m, m[1:])], edges[c][-1]]
    return out
