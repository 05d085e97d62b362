"""Approximate nearest neighbours by shifted space-filling curves.

The vectors are rotated at random; each group of `AXES` rotated coordinates gives one curve: the coordinates become
ranks by quantiles of a bounded sample, are shifted by an offset of the curve's own, and turn into a Hilbert key. Spark
range-partitions all keys of all curves, and the sorted order is cut into windows of `WINDOW` vectors. A query looks at
its window and at `reach` windows on either side, on every curve: candidates are scored by exact inner products in the
task that holds their window, the best of each window travel on, and the lists of a query are merged.

The reach is set by measurement: a bounded sample of `PROBES` queries is answered by an exact scan, and the reach is the
least at which the windows hold `RECALL` of those neighbours. On vectors of low intrinsic dimension it is 0 or 1 at
any size; on vectors without structure it has to grow with the table, and so does the work.

Equal vectors are one entry, which keeps its smallest ids (as many as can be asked for), so that no window is filled by
copies and ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do null
ids, nor vectors of another length than most; repeated rows count once; fewer candidates than asked for are all
returned; an empty table gives an empty one; only the id and the vector column are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.lookup import lookup_join
from millrace.runtime import settle
from millrace.schema import col

CURVES = 16
AXES = 4
BITS = 12          # of each coordinate in a key
WINDOW = 512       # vectors
SAMPLE = 4096      # vectors that the quantiles are taken from
PROBES = 128       # queries that the reach is measured with
RECALL = 0.97
SEED = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (int64) of each row of non-negative cells, for rows of `d` coordinates with bits * d < 64.

    The usual transposition: undo excess work from the top bit down, Gray-encode, interleave.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Rotation, quantile edges and shifts, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray):
        dim = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.axes = min(AXES, dim)
        parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-CURVES * self.axes // dim))]
        self.rotation = np.concatenate(parts, axis=1)[:, :CURVES * self.axes]
        self.edges = np.quantile(sample @ self.rotation, np.linspace(0, 1, 257), axis=0)
        self.shifts = rng.uniform(0, 0.25, CURVES * self.axes)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One row of CURVES keys for each vector."""
        spun = vectors @ self.rotation
        cells = np.empty(spun.shape, np.int64)
        steps = np.linspace(0, 1, 257)
        for j in range(spun.shape[1]):
            share = np.interp(spun[:, j], np.maximum.accumulate(self.edges[:, j]), steps)
            cells[:, j] = np.minimum((share + self.shifts[j]) / 1.25 * (1 << BITS), (1 << BITS) - 1)
        return np.stack([hilbert_keys(cells[:, c * self.axes:(c + 1) * self.axes], BITS) for c in range(CURVES)], axis=1)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, in no order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def entries_of(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """vid (smallest id of equal vectors), vec (array of double), ids (the `keep` smallest), n (their rows)."""
    vec = col(vector_col).cast("array<double>")
    rows = vectors.select(col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists("vec", lambda x: x != 0))
    # -0.0 and 0.0 are equal components.
    rows = rows.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    nth = Window.partitionBy("vec").orderBy("id")
    # Ids of one vector are ranked with a limit that Spark applies before the shuffle.
    few = (rows.distinct().withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= keep)
           .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    return few.select(F.element_at("ids", 1).alias("vid"), "vec", "ids")


def _main_length(entries: DataFrame) -> int:
    top = entries.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return top["d"] if top else 0


def _ranked(entries: DataFrame, curves: Curves) -> DataFrame:
    """vid, curve, window for every entry and curve: its place in the curve's order, in windows."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    @F.pandas_udf("array<bigint>")
    def keys(vecs: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.keys(np.stack(vecs.to_numpy()))), dtype=object)

    made = entries.select("vid", F.posexplode(keys("vec")).alias("curve", "key"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = made.repartitionByRange(parts, "curve", "key", "vid").sortWithinPartitions("curve", "key", "vid")
    ordered = settle(ordered.select("vid", "curve").withColumn("at", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("at", 33)
    counts = settle(ordered.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low")), "counts")
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")
    offsets = F.broadcast(counts.select("curve", "part", "low", before.alias("before")))  # a row for each task and curve
    place = F.col("at") - F.col("low") + F.col("before")
    return ordered.withColumn("part", part).join(offsets, ["curve", "part"]).select(
        "vid", "curve", F.floor(place / WINDOW).cast("int").alias("window"))


def exact_neighbours(entries: DataFrame, probes: list, k: int) -> dict[int, list[int]]:
    """The k best entries of each probe (vid, vec), by a scan of all entries; each batch sends on its best only."""
    shared = entries.sparkSession.sparkContext.broadcast(
        (np.array([p["vid"] for p in probes]), np.array([p["vec"] for p in probes])))

    def best(batches):
        ids, vecs = shared.value
        for batch in batches:
            own = batch["vid"].to_numpy()
            scores = vecs @ np.stack(batch["vec"].to_numpy()).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            at = _top(scores, k)
            yield pd.DataFrame({"q": np.repeat(ids, at.shape[1]), "vid": own[at].ravel(),
                                "score": np.take_along_axis(scores, at, axis=1).ravel()})

    found = entries.select("vid", "vec").mapInPandas(best, "q long, vid long, score double")
    nth = Window.partitionBy("q").orderBy(F.desc("score"), "vid")
    rows = (found.filter("score > double('-infinity')").withColumn("nth", F.row_number().over(nth))
            .filter(F.col("nth") <= k).collect())  # PROBES * k rows
    out: dict[int, list[int]] = {p["vid"]: [] for p in probes}
    for r in rows:
        out[r["q"]].append(r["vid"])
    return out


def measured_reach(entries: DataFrame, ranked: DataFrame, queries: DataFrame, k: int) -> tuple[int, float]:
    """The least reach that finds RECALL of the probes' true neighbours, and the recall there."""
    probes = queries.orderBy(F.xxhash64("vid", F.lit(SEED)), "vid").limit(PROBES).collect()
    truth = exact_neighbours(entries, probes, k)
    wanted = sorted({v for q, near in truth.items() for v in [q, *near]})  # at most PROBES * (k + 1)
    ids = F.broadcast(entries.sparkSession.createDataFrame([(v,) for v in wanted], "vid long"))
    at: dict[int, dict[int, int]] = {}
    for r in ranked.join(ids, "vid").collect():
        at.setdefault(r["vid"], {})[r["curve"]] = r["window"]
    gaps = np.array([min(abs(at[q][c] - at[v][c]) for c in at[q]) for q, near in truth.items() for v in near])
    if not len(gaps):
        return 0, 1.0
    reach = int(np.sort(gaps)[max(0, int(np.ceil(RECALL * len(gaps))) - 1)])
    return reach, float((gaps <= reach).mean())


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score for every row where `is_query` holds.

    `is_query` is a condition on the id column, by its name.
    """
    spark = vectors.sparkSession
    out = f"query_id long, rank int, {id_col} long, score double"
    entries = settle(entries_of(vectors, id_col, vector_col, k + 1), "vectors")
    dim = _main_length(entries)
    if not dim:
        return spark.createDataFrame([], out)
    entries = entries.filter(F.size("vec") == dim)
    sample = entries.select("vec").orderBy(F.xxhash64("vid", F.lit(SEED + 1))).limit(SAMPLE).collect()
    curves = Curves(np.array([r["vec"] for r in sample]))
    ranked = settle(_ranked(entries, curves), "ranked")

    # Every row that asks, with the entry that holds its vector.
    asking = vectors.filter(is_query).select(col(id_col).cast("long").alias("query_id"), col(vector_col).cast("array<double>").alias("vec"))
    asking = asking.select("query_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct()
    few = asking.groupBy("vec").agg(F.count("*").alias("n")).join(entries.select("vid", "vec"), "vec")
    queries = settle(few.select("vid", "vec", "n"), "queries")
    total = queries.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], out)
    reach, _ = measured_reach(entries, ranked, queries, k)

    held = ranked.join(entries.select("vid", "vec"), "vid")
    # The query side goes to all windows in its reach; the vectors stay once on each curve.
    around = F.explode(F.sequence(F.greatest(F.col("window") - reach, F.lit(0)), F.col("window") + reach)).alias("near_window")
    asked = (ranked.join(queries.select("vid", "vec"), "vid")
             .select(F.col("vid").alias("q"), F.col("vec").alias("q_vec"), F.col("curve").alias("near_curve"), around))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "near": [], "scores": []}, dtype=object)
        own = right["vid"].to_numpy()
        order = np.argsort(own)
        own, matrix = own[order], np.stack(right["vec"].to_numpy()[order])
        scores = np.stack(left["q_vec"].to_numpy()) @ matrix.T
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k + 1]  # equal scores: the smaller id first
        return pd.DataFrame({"q": left["q"].to_numpy(), "near": list(own[at]),
                             "scores": list(np.take_along_axis(scores, at, axis=1))})

    lists = (asked.groupBy("near_curve", "near_window").cogroup(held.groupBy("curve", "window"))
             .applyInPandas(merge, "q long, near array<bigint>, scores array<double>"))

    @F.pandas_udf("array<struct<vid:bigint,score:double>>")
    def best_of(near: pd.Series, scores: pd.Series) -> pd.Series:
        rows = []
        for a, b in zip(near, scores):
            ids, first = np.unique(np.concatenate(list(a)), return_index=True)
            points = np.concatenate(list(b))[first]
            order = np.lexsort((ids, -points))[:k + 1]
            rows.append([{"vid": i, "score": s} for i, s in zip(ids[order].tolist(), points[order].tolist())])
        return pd.Series(rows, dtype=object)

    # A query has one list from each window it looks at.
    merged = lists.groupBy("q").agg(F.collect_list("near").alias("near"), F.collect_list("scores").alias("scores"))
    merged = settle(merged.select("q", F.explode(best_of("near", "scores")).alias("b")).select("q", "b.vid"), "merged")
    # The score of record: products summed in the order of the components, the same for equal vectors everywhere.
    product = F.aggregate(F.zip_with("q_vec", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    paired = (merged.join(queries.select(F.col("vid").alias("q"), F.col("vec").alias("q_vec")), "q")
              .join(entries.select("vid", "vec", "ids"), "vid"))
    # Entries become ids; the nearest k + 1 ids of each query vector, its own among them.
    ids = paired.select("q", product.alias("score"), F.explode("ids").alias("id"))
    nth = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = (ids.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k + 1)
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("near")))
    lists_of = queries.select("vid", "vec", "n").join(best, queries["vid"] == best["q"]).select("vec", "n", "near")
    each = lookup_join(asking, lists_of, "vec", "n", max(total, 1), small=False).filter("near is not null")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (each.select("query_id", F.posexplode(others).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), "x.score"))
