"""Exact nearest neighbours by metric cells.

Donors are dealt to k-means cells (centres from a bounded sample, which shapes the cost only) and packed into blocks of
bounded bytes. A block is known by its box, its centre and its radius. A query first visits the blocks of least lower
bound until they hold k donors; the k-th distance found there is its reach, and the second visit goes only to blocks
whose box and ball (by the triangle inequality) come within it. For that the blocks stream past groups of near queries, the
nearest ones first, and a group keeps only the k least of each query. A matrix product rules out most pairs; what comes
within its rounding of the k-th distance is measured term by term. The result is exact whatever the data; the reach decides
the cost. Missing features are left out of the distance. Donors that lack the same features share blocks, and bounds use
the features that all of a block's donors have; one block serves every feature that is to be filled in.

Copies are collapsed first: a vector is searched for once, and counts as a donor at most as often as its copies can
matter. Queries travel in packed chunks of near ones; in the first visit the chunks of a busy block are spread over tasks. The
list of blocks is broadcast; blocks grow where it would pass `LIST_BYTES`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.base import Fitted, Step, step
from millrace.llm.batches import bounded_batches
from millrace.operators.lookup import lookup_join
from millrace.operators.profile import base_facts
from millrace.operators.scale import _filled_spread, chosen, filled
from millrace.runtime import BROADCAST_BYTES, settle
from millrace.schema import col, dbl

CELL = 2048            # donors per block; grows with the table to bound the block list
LIST_BYTES = 48 << 20  # bounds of all blocks
CENTRES = 1024         # k-means cells, at most
SAMPLE = 8             # rows for each centre from which the centres are learnt
ROUNDS = 4
CHUNK = 256            # queries that meet a block together
GROUP = 16_384         # queries that blocks stream past
KEPT = 1 << 16         # candidates that a group gathers at least before it keeps the k least
PART = 100_000         # donors sorted by one task
SPREAD = 4             # chunks of one block per salt
PATTERNS = 1000        # sets of missing features that have blocks of their own
NAN = float("nan")


def _vector(columns: list[Column]) -> Column:
    return F.array(*[F.coalesce(c, F.lit(NAN)) for c in columns])


# ---------------------------------------------------------------- cells and blocks

def _centres(donors: DataFrame, rows: int) -> np.ndarray:
    """Centres of the cells by k-means over a bounded sample, drawn by hash; missing features count as the sample's mean."""
    cells = max(1, min(CENTRES, math.ceil(rows / CELL)))
    order = F.xxhash64("vec", F.lit(5))
    sample = donors.select("vec").orderBy(order, "vec").limit(SAMPLE * cells).collect()
    x = np.array([r["vec"] for r in sample], float).reshape(len(sample), -1)
    held = ~np.isnan(x)
    mean = np.where(held, x, 0).sum(axis=0) / np.maximum(held.sum(axis=0), 1)
    x = np.where(held, x, mean)
    centres = x[:cells].copy()
    for _ in range(ROUNDS):
        own = _cell_of(x, centres)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def _cell_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row over the features that it has."""
    held = ~np.isnan(x)
    filled = np.where(held, x, 0.0)
    return np.argmin(held.astype(float) @ (centres ** 2).T - 2 * filled @ centres.T, axis=1)


def _celled(table: DataFrame, centres) -> DataFrame:
    """Adds `cell` and `at`, the place along the cells' widest feature, to rows with `vec`."""
    axis = int(np.argmax(centres.value.var(axis=0))) if centres.value.size else 0

    @F.pandas_udf("cell int, at double")
    def assign(vecs: pd.Series) -> pd.DataFrame:
        x = np.stack(vecs.to_numpy()).astype(float) if len(vecs) else np.zeros((0, centres.value.shape[1]))
        return pd.DataFrame({"cell": _cell_of(x, centres.value).astype("int32"), "at": np.nan_to_num(x[:, axis], nan=-np.inf)})

    return table.withColumn("c", assign("vec")).select(*table.columns, "c.cell", "c.at")


BOUNDS = ("low", "high", "mean", "full", "any", "held")


class Blocks:
    """Bounds of all blocks as arrays, a row each."""

    def __init__(self, listed: pd.DataFrame, width: int):
        listed = listed.sort_values("block")
        self.width, self.block = width, listed["block"].to_numpy()
        arrays = {c: np.array([np.frombuffer(b, np.float64) for b in listed[c]]).reshape(-1, width) for c in BOUNDS}
        self.low, self.high, self.mean, self.held = (arrays[c] for c in ("low", "high", "mean", "held"))
        self.full, self.any = arrays["full"] > 0, arrays["any"] > 0
        self.radius, self.size = listed["radius"].to_numpy(), listed["size"].to_numpy()

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance that a donor of each block can have to each of the queries, which lack the same features."""
        have = ~np.isnan(q[0])
        shared = (self.any & have).sum(axis=1)
        use = self.full & have
        box, ball = np.zeros((len(q), len(self.block))), np.zeros((len(q), len(self.block)))
        for f in np.flatnonzero(have):
            x = q[:, f, None]
            gap = np.maximum(np.maximum(self.low[:, f] - x, x - self.high[:, f]), 0)
            box += np.where(use[:, f], gap, 0) ** 2
            ball += np.where(use[:, f], x - self.mean[:, f], 0) ** 2
        alike = (self.full == self.any).all(axis=1)
        return self._bound(box, ball, shared, alike, self.radius)

    def bound(self, q: np.ndarray, at: int) -> np.ndarray:
        """As `bounds` for one block."""
        have = ~np.isnan(q[0])
        use = np.flatnonzero(self.full[at] & have)
        x = q[:, use]
        box = (np.maximum(np.maximum(self.low[at, use] - x, x - self.high[at, use]), 0) ** 2).sum(axis=1)
        ball = ((x - self.mean[at, use]) ** 2).sum(axis=1)
        return self._bound(box, ball, (self.any[at] & have).sum(), (self.full[at] == self.any[at]).all(), self.radius[at])

    def _bound(self, box, ball, shared, alike, radius) -> np.ndarray:
        ball = np.where(alike, np.maximum(np.sqrt(ball) * (1 - 1e-12) - radius, 0) ** 2, 0)
        with np.errstate(divide="ignore"):
            return np.where(shared > 0, np.maximum(box, ball) * (self.width / np.maximum(shared, 1)) * (1 - 1e-9), np.inf)

    def first(self, bounds: np.ndarray, targets: np.ndarray, k: int) -> np.ndarray:
        """Which blocks each query visits first: the nearest ones, until they hold k donors for each target."""
        held = self.held[:, targets] if len(targets) else self.size[:, None].astype(float)
        out = np.zeros(bounds.shape, bool)
        order = np.argsort(bounds, axis=1, kind="stable")
        for i, row in enumerate(order):
            enough = (np.cumsum(held[row], axis=0) >= k).all(axis=1)
            out[i, row[:int(np.argmax(enough)) + 1 if enough.any() else len(row)]] = True
        return out & np.isfinite(bounds)


def _pack(donors: DataFrame, width: int, k: int) -> tuple[DataFrame, object, object]:
    """Blocks of donors (vec, tag, n), and, broadcast, their bounds and the centres of the cells."""
    spark = donors.sparkSession
    pattern = F.xxhash64(F.transform("vec", lambda x: F.isnan(x)))
    donors = settle(donors.withColumn("pattern", pattern), "donors")
    rows = donors.count()
    cell = max(CELL, math.ceil(rows * width * 8 * len(BOUNDS) / LIST_BYTES))
    often = [r["pattern"] for r in donors.groupBy("pattern").count().filter(F.col("count") * 4 >= cell).orderBy(F.desc("count"), "pattern").limit(PATTERNS).collect()]
    donors = donors.withColumn("pattern", F.when(F.col("pattern").isin(often), F.col("pattern")).otherwise(F.lit(0)) if often else F.lit(0).cast("long"))
    centres = spark.sparkContext.broadcast(_centres(donors, rows))
    placed = _celled(donors, centres)

    def blocks(batches):
        from pyspark import TaskContext

        first, seq = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            runs = (pdf["pattern"].ne(pdf["pattern"].shift()) | pdf["cell"].ne(pdf["cell"].shift())).cumsum()
            for _, run in pdf.groupby(runs, sort=False):
                for start in range(0, len(run), cell):
                    piece = run.iloc[start:start + cell]
                    x, n = np.stack(piece["vec"].to_numpy()).astype(float), np.minimum(piece["n"].to_numpy(), k)
                    here = ~np.isnan(x)
                    mean = np.where(here, x, 0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
                    facts = {"low": np.where(here, x, np.inf).min(axis=0), "high": np.where(here, x, -np.inf).max(axis=0), "mean": mean,
                             "full": here.all(axis=0), "any": here.any(axis=0), "held": (here * n[:, None]).sum(axis=0)}
                    yield pd.DataFrame([{"block": first + seq, "size": int(n.sum()), "vecs": x.tobytes(), "tags": piece["tag"].to_numpy("int64").tobytes(),
                                         "ns": n.astype("int32").tobytes(), "radius": float(np.sqrt((np.where(here, x - mean, 0) ** 2).sum(axis=1).max()) * (1 + 1e-12)),
                                         **{c: v.astype("float64").tobytes() for c, v in facts.items()}}])
                    seq += 1

    ordered = (placed.repartitionByRange(max(1, math.ceil(rows / PART)), "pattern", "cell", "at", "vec", "tag")
               .sortWithinPartitions("pattern", "cell", "at", "vec", "tag"))
    packed = settle(ordered.mapInPandas(blocks, "block long, size long, vecs binary, tags binary, ns binary, radius double, "
                                        + ", ".join(f"{c} binary" for c in BOUNDS)), "blocks")
    listed = packed.select("block", "size", "radius", *BOUNDS).toPandas()  # at most LIST_BYTES
    return packed.select("block", "vecs", "tags", "ns"), spark.sparkContext.broadcast(Blocks(listed, width)), centres


# ---------------------------------------------------------------- queries

def _chunks(queries: DataFrame, centres) -> DataFrame:
    """grp, chunk, vecs: queries of one cell or neighbouring ones, packed; the i-th of a chunk has the number chunk * CHUNK + i."""
    rows = queries.count()
    groups = max(1, math.ceil(rows / GROUP), min(2 * queries.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / CHUNK)))
    ordered = (_celled(queries.select("vec"), centres).withColumn("lacks", F.xxhash64(F.transform("vec", lambda x: F.isnan(x))))
               .repartitionByRange(groups, "lacks", "cell", "at", "vec").sortWithinPartitions("lacks", "cell", "at", "vec"))

    def pack(batches):
        from pyspark import TaskContext

        group, seq = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for _, run in pdf.groupby(pdf["lacks"].ne(pdf["lacks"].shift()).cumsum(), sort=False):
                vecs = run["vec"].to_numpy()
                for start in range(0, len(run), CHUNK):
                    yield pd.DataFrame({"grp": [group], "chunk": [(group << 32) + seq],
                                        "vecs": [np.stack(vecs[start:start + CHUNK]).astype(float).tobytes()]})
                    seq += 1

    return settle(ordered.mapInPandas(pack, "grp int, chunk long, vecs binary"), "queries")


def _targets(q: np.ndarray, impute: list[int] | None) -> np.ndarray:
    """What is sought for a query: the features it lacks, of those to be filled in."""
    return np.array([f for f in impute if np.isnan(q[f])], int) if impute is not None else np.zeros(0, int)


def _first_visits(chunks: DataFrame, blocks, k: int, impute: list[int] | None) -> DataFrame:
    """The queries of each chunk that visit a block as one of their nearest."""
    def route(batches):
        index: Blocks = blocks.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q = np.frombuffer(row.vecs, np.float64).reshape(-1, index.width)
                visit = index.first(index.bounds(q), _targets(q[0], impute), k)
                at = np.flatnonzero(visit.any(axis=0))
                rows = [np.flatnonzero(visit[:, b]).astype("int32") for b in at]
                if len(at):
                    yield pd.DataFrame({"block": index.block[at], "chunk": row.chunk, "rows": [r.tobytes() for r in rows], "vecs": [q[r].tobytes() for r in rows]})

    return chunks.mapInPandas(route, "block long, chunk long, rows binary, vecs binary")


def _reach_of(row, n: int) -> np.ndarray:
    reach = np.full(n, np.inf)
    for e in row.reach if row.reach is not None else []:
        reach[e["i"]] = e["kth"]
    return reach


def _in_reach(chunks: DataFrame, blocks) -> DataFrame:
    """grp, chunk, block, ord: the blocks within reach of a chunk, and how near they may come."""
    def route(batches):
        index: Blocks = blocks.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q = np.frombuffer(row.vecs, np.float64).reshape(-1, index.width)
                bounds = index.bounds(q)
                at = np.flatnonzero(((bounds <= _reach_of(row, len(q))[:, None]) & np.isfinite(bounds)).any(axis=0))
                if len(at):
                    yield pd.DataFrame({"grp": row.grp, "chunk": row.chunk, "block": index.block[at], "ord": bounds[:, at].min(axis=0)})

    return chunks.mapInPandas(route, "grp int, chunk long, block long, ord double")


# ---------------------------------------------------------------- distances

def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances over the features both have, scaled up to all; infinite without a common one."""
    width = q.shape[1]
    total = np.zeros((len(q), len(x)))
    if not (np.isnan(q).any() or np.isnan(x).any()):
        for f in range(width):
            total += (q[:, f, None] - x[None, :, f]) ** 2
        return total
    shared = np.zeros((len(q), len(x)))
    for f in range(width):
        gap = q[:, f, None] - x[None, :, f]
        here = ~np.isnan(gap)
        total += np.where(here, gap, 0.0) ** 2
        shared += here
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * (width / shared), np.inf)


class _Donors:
    """A block's vectors, prepared for products with queries: single precision where nothing is missing."""

    def __init__(self, x: np.ndarray):
        self.x, self.there = x, ~np.isnan(x)
        self.middle = np.where(self.there, x, 0).sum(axis=0) / np.maximum(self.there.sum(axis=0), 1)
        xc = np.where(self.there, x - self.middle, 0)
        xx = (xc ** 2).sum(axis=1)
        self.most, self.whole = xx.max(initial=0), bool(self.there.all())
        if self.whole:
            with np.errstate(over="ignore", invalid="ignore"):
                self.right = np.column_stack([xc, np.ones(len(x)), xx]).astype(np.float32).T.copy()
        else:
            self.left, self.squares, self.there_t = xc.T, (xc ** 2).T, self.there.T.astype(float)

    def rough(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances as _distances gives them but by matrix products, and for each query by how much they may be off;
        that is infinite where products don't do."""
        width, here = q.shape[1], ~np.isnan(q)
        qc = np.where(here, q - self.middle, 0)
        qq = (qc ** 2).sum(axis=1)
        if not (self.whole and here.all()):
            if self.whole:
                left, squares, there = (self.x - self.middle).T, ((self.x - self.middle) ** 2).T, np.ones((width, len(self.x)))
            else:
                left, squares, there = self.left, self.squares, self.there_t
            shared = here.astype(float) @ there
            with np.errstate(divide="ignore", invalid="ignore"):
                total = np.where(shared > 0, (qc ** 2 @ there + here @ squares - 2 * (qc @ left)) * (width / shared), np.inf)
            return total, 16 * width * (width + 8) * np.finfo(float).eps * (qq + self.most) + np.finfo(float).tiny
        off = 4 * (width + 8) * np.finfo(np.float32).eps * (qq + self.most) + 1e-36
        off = np.where(qq + self.most < 1e36, off, np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            return np.column_stack([-2 * qc, qq, np.ones(len(q))]).astype(np.float32) @ self.right, off


def _passing(q: np.ndarray, donors: _Donors, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, donor) no farther than the query's limit, and their distances, term by term."""
    (rough, off), x = donors.rough(q), donors.x
    if not np.isfinite(off).all():
        dist = _distances(q, x)
        i, j = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
        return i, j, dist[i, j]
    most = limit + off
    i, j = np.nonzero(rough <= np.nextafter(most.astype(rough.dtype), rough.dtype.type(np.inf))[:, None])
    width, total, shared = q.shape[1], np.zeros(len(i)), np.zeros(len(i))
    for f in range(width):
        gap = q[i, f] - x[j, f]
        here = ~np.isnan(gap)
        total += np.where(here, gap, 0.0) ** 2
        shared += here
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.where(shared > 0, total * (width / shared), np.inf)
    own = (dist <= limit[i]) & np.isfinite(dist)
    return i[own], j[own], dist[own]


def _kth(visits: DataFrame, blocks: DataFrame, k: int, width: int, impute: list[int] | None) -> DataFrame:
    """qid, target, kth: a distance within which the visited blocks hold k donors."""
    salts = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("salts"))
    spread = F.broadcast(salts)  # a row of two numbers for each block
    left = visits.join(spread, "block").withColumn("salt", F.pmod(F.xxhash64("chunk"), "salts").cast("int")).drop("salts")
    right = (blocks.select("block", "vecs", "ns").join(spread, "block")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(held):
            x = np.frombuffer(held.iloc[0]["vecs"], np.float64).reshape(-1, width)
            n = np.frombuffer(held.iloc[0]["ns"], np.int32)
            donors = _Donors(x)
            for chunk, rows, vecs in zip(asked["chunk"], asked["rows"], asked["vecs"]):
                q, rows = np.frombuffer(vecs, np.float64).reshape(-1, width), np.frombuffer(rows, np.int32)
                rough, off = donors.rough(q)
                far = rough + off[:, None] if np.isfinite(off).all() else _distances(q, x)
                for i, row in enumerate(far):
                    qid = chunk * CHUNK + int(rows[i])
                    for t in [-1] if impute is None else _targets(q[i], impute):
                        have = np.isfinite(row) if t < 0 else np.isfinite(row) & ~np.isnan(x[:, t])
                        dist, copies = row[have], n[have]
                        if len(dist) > k:
                            least = np.argpartition(dist, k - 1)[:k]
                            dist, copies = dist[least], copies[least]
                        dist = np.repeat(dist, copies)
                        dist = np.sort(dist)[:k]
                        # A block with k donors gives the distance, others give what they have.
                        out.append((qid, t, dist[-1:], True) if len(dist) == k else (qid, t, dist, False))
        counts = [len(o[2]) for o in out]
        return pd.DataFrame({"qid": np.repeat([o[0] for o in out], counts).astype("int64"), "target": np.repeat([o[1] for o in out], counts).astype("int32"),
                             "dist": np.concatenate([np.zeros(0), *[o[2] for o in out]]), "full": np.repeat([o[3] for o in out], counts).astype(bool)})

    found = (left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt"))
             .applyInPandas(nearest, "qid long, target int, dist double, full boolean"))
    # The few of blocks with under k donors count together.
    nth = F.row_number().over(Window.partitionBy("qid", "target", "full").orderBy("dist"))
    return (found.withColumn("nth", nth).filter(F.col("nth") == F.when(F.col("full"), 1).otherwise(k))
            .groupBy("qid", "target").agg(F.min("dist").alias("kth")))


# ---------------------------------------------------------------- blocks stream past groups of queries

class _Group:
    """The queries of a group and the k least candidates of each item: a query, or a query and a feature that it lacks."""

    def __init__(self, k: int, width: int, impute: list[int] | None):
        self.k, self.width, self.impute = k, width, impute
        self.chunks: list[tuple] = []  # number of the first query, vectors, targets, first item
        self.limit = np.zeros(0)
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64 if impute is None else float))
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, row, number: int) -> None:
        q = np.frombuffer(row.vecs, np.float64).reshape(-1, self.width)
        targets = _targets(q[0], self.impute) if self.impute is not None else np.array([-1])
        self.chunks.append((number, q, targets, len(self.limit)))
        self.limit = np.concatenate([self.limit, np.repeat(_reach_of(row, len(q)), len(targets))])

    def meet(self, index: Blocks, row) -> None:
        at = int(np.searchsorted(index.block, int(row.block)))
        x = np.frombuffer(row.vecs, np.float64).reshape(-1, self.width)
        tags, n = np.frombuffer(row.tags, np.int64), np.frombuffer(row.ns, np.int32)
        donors = _Donors(x)
        for _, q, targets, first in self.chunks:
            limits = self.limit[first:first + len(q) * len(targets)].reshape(len(q), len(targets))
            if not limits.size:
                continue
            most = limits.max(axis=1)
            bound = index.bound(q, at)
            rows = np.flatnonzero((bound <= most) & np.isfinite(bound))
            if not len(rows):
                continue
            i, j, dist = _passing(q[rows], donors, most[rows])
            for place, t in enumerate(targets):
                own = dist <= limits[rows[i], place]
                if t >= 0:
                    own &= ~np.isnan(x[j, t])
                item, donor = first + rows[i[own]] * len(targets) + place, j[own]
                copies = n[donor]
                self.new.append((np.repeat(item, copies), np.repeat(dist[own], copies), np.repeat(tags[donor] if t < 0 else x[donor, t], copies)))
                self.waiting += len(self.new[-1][0])
            if self.waiting > max(KEPT, self.k * len(self.limit)):
                self.settle()

    def settle(self) -> None:
        item, dist, tag = (np.concatenate([kept, *[n[c] for n in self.new]]) for c, kept in enumerate(self.kept))
        self.new, self.waiting = [], 0
        order = np.lexsort((tag, dist, item))
        item, dist, tag = item[order], dist[order], tag[order]
        self.rank = np.arange(len(item)) - np.searchsorted(item, item) + 1
        least = self.rank <= self.k
        last = self.rank == self.k
        self.limit[item[last]] = np.minimum(self.limit[item[last]], dist[last])
        self.kept, self.rank = (item[least], dist[least], tag[least]), self.rank[least]

    def result(self):
        self.settle()
        item, dist, tag = self.kept
        qids = np.concatenate([np.zeros(0, int), *[np.repeat(c + np.arange(len(q)), len(t)) for c, q, t, _ in self.chunks]])
        targets = np.concatenate([np.zeros(0, int), *[np.tile(t, len(q)) for _, q, t, _ in self.chunks]])
        for a in range(0, len(item), KEPT):
            b = slice(a, a + KEPT)
            yield pd.DataFrame({"qid": qids[item[b]].astype("int64"), "target": targets[item[b]].astype("int32"), "dist": dist[b], "tag": tag[b],
                                "rank": self.rank[b].astype("int32")})


def _streamed(chunks: DataFrame, visits: DataFrame, blocks: DataFrame, index, k: int, width: int, impute: list[int] | None) -> DataFrame:
    """The k least candidates of each query: each group's queries, then the blocks within its reach, the nearest first."""
    routes = F.broadcast(visits.groupBy("grp", "block").agg(F.min("ord").alias("ord")))  # three numbers for a group and block
    nothing = F.lit(None)
    asked = chunks.select("grp", F.lit(-1.0).alias("ord"), nothing.cast("long").alias("block"), "chunk", "vecs", "reach",
                          nothing.cast("binary").alias("tags"), nothing.cast("binary").alias("ns"))
    held = blocks.join(routes, "block").select("grp", "ord", "block", nothing.cast("long").alias("chunk"), "vecs",
                                               nothing.cast(chunks.schema["reach"].dataType).alias("reach"), "tags", "ns")
    groups = (chunks.agg(F.max("grp")).first()[0] or 0) + 1

    def run(batches):
        group, number = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.grp != number:
                    if group:
                        yield from group.result()
                    group, number = _Group(k, width, impute), row.grp
                if row.ord < 0:
                    group.add(row, int(row.chunk) * CHUNK)
                else:
                    group.meet(index.value, row)
        if group:
            yield from group.result()

    bounded_batches(chunks)
    return (asked.unionByName(held).repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "ord", "block", "chunk")
            .mapInPandas(run, f"qid long, target int, dist double, tag {'long' if impute is None else 'double'}, rank int"))


def search(donors: DataFrame, queries: DataFrame, k: int, width: int, impute: list[int] | None = None,
           tally: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest donors (vec, tag, n) by (squared distance, tag) as (qid, target, dist, tag, rank), and the queries (qid, vec).

    With `impute`, a list of features, every query is searched for each of these that it lacks, among the donors that have
    it; `tag` is then the donor's value. `tally` gets the number of blocks met by chunks, and of all such meetings.
    """
    blocks, index, centres = _pack(donors, width, k)
    chunks = _chunks(queries, centres)
    visits = settle(_first_visits(chunks, index, k, impute), "visits")
    # A query's reach is its farthest k-th distance; targets with fewer than k donors so far leave it open.
    full = settle(_kth(visits, blocks, k, width, impute), "kth")
    wanted = F.lit(1) if impute is None else F.col("wanted")
    vec = F.col("vec")
    # NaN comes back from Arrow as null.
    numbered = (chunks.select("chunk", "vecs").mapInPandas(_unpacked(width), "qid long, vec array<double>")
                .select("qid", F.transform("vec", lambda x: F.coalesce(x, F.lit(NAN))).alias("vec")))
    if impute is not None:
        lacks = F.size(F.filter(F.array(*[F.lit(f) for f in impute]), lambda f: F.isnan(F.get(vec, f))))
        full = full.join(numbered.select("qid", lacks.alias("wanted")), "qid")
    reach = (full.withColumn("wanted", wanted).groupBy("qid").agg(F.max("kth").alias("kth"), F.count("kth").alias("n"), F.max("wanted").alias("wanted"))
             .filter("n = wanted").groupBy(F.floor(F.col("qid") / CHUNK).alias("chunk"))
             .agg(F.collect_list(F.struct(F.pmod("qid", F.lit(CHUNK)).cast("int").alias("i"), "kth")).alias("reach")))
    reaching = settle(chunks.join(reach, "chunk", "left"), "reaching")
    more = settle(_in_reach(reaching, index), "visits")
    if tally is not None:
        tally.update(met=more.count(), all=chunks.count() * len(index.value.block))
    return _streamed(reaching, more, blocks, index, k, width, impute), numbered


def _unpacked(width: int):
    def unpack(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q = np.frombuffer(row.vecs, np.float64).reshape(-1, width)
                yield pd.DataFrame({"qid": row.chunk * CHUNK + np.arange(len(q)), "vec": list(q)})

    return unpack


# ---------------------------------------------------------------- imputation

class KnnModel(Fitted):
    """Donors stay a table, and filling new rows runs the search."""

    def __init__(self, df, columns, k, name):
        facts = base_facts(df, columns)
        used = [c for c in columns if facts[c]["count"]]
        super().__init__(name, {"columns": columns, "n_neighbors": k,
                                "means": {c: facts[c]["mean"] for c in used}}, None)
        self.columns, self.used, self.k = columns, used, k
        self.points = settle(df.select(self._vec().alias("vec")).groupBy("vec")
                             .agg(F.count(F.lit(1)).alias("n")), "points")

    def _vec(self) -> Column:
        return _vector([dbl(c) for c in self.used])

    def transform(self, df):
        if not self.used:
            return df
        width, k = len(self.used), self.k
        vec = F.col("vec")
        lacking = F.exists(vec, lambda x: F.isnan(x))
        rows = df.withColumn("vec", self._vec())
        wanted = settle(rows.filter(lacking).groupBy("vec").agg(F.count(F.lit(1)).alias("n")), "wanted")
        total = wanted.agg(F.sum("n")).first()[0]
        whole = rows.filter(~lacking).drop("vec")
        whole = whole.withColumns({c: dbl(c) for c in self.columns})
        if not total:
            return whole.select(*df.columns)
        missing = F.array_compact(F.array(*[F.when(F.isnan(F.get(vec, F.lit(i))), F.lit(i)) for i in range(width)]))
        empty = sorted(r["target"] for r in wanted.select(F.explode(missing).alias("target")).distinct().collect())
        target = F.col("target")
        # More than k copies of a donor never count; one without any feature is no donor, and no query finds one without a feature.
        some = F.exists(vec, lambda x: ~F.isnan(x))
        donors = self.points.filter(some).select("vec", F.lit(0).cast("long").alias("tag"), F.least(F.col("n"), F.lit(k)).cast("int").alias("n"))
        found, queries = search(donors, wanted.filter(some), k, width, empty)
        fills = (found.groupBy("qid").agg(*[F.avg(F.when(target == i, F.col("tag"))).alias(f"fill{i}") for i in empty])
                 .join(queries, "qid").groupBy("vec")
                 .agg(*[F.max(f"fill{i}").alias(f"fill{i}") for i in empty]))
        facts = settle(wanted.join(fills, "vec", "left"), "fills")
        filled_rows = lookup_join(rows.filter(lacking), facts, "vec", "n", total)
        values = {c: F.coalesce(dbl(c), *([F.col(f"fill{i}")] if i in empty else []),
                                F.lit(self.params["means"][c])) for i, c in enumerate(self.used)}
        values.update({c: dbl(c) for c in self.columns if c not in self.used})
        return whole.select(*df.columns).unionByName(filled_rows.withColumns(values).select(*df.columns))

    def to_dict(self):
        return {"type": self.name, "params": self.params, "refit": True}


@step("knn_imputation")
class KnnImpute(Step):
    """Missing numerics by the mean of the k nearest rows that have the value.

    Distance is over the features both rows have, scaled up to all features;
    ties go to the smaller donor value. Without a donor the column mean is used.
    """

    @classmethod
    def defaults(cls):
        return {"n_neighbors": 5, "columns": None, "exclude": None}

    def fit(self, df):
        columns = chosen(df, self.options, "imputation")
        return KnnModel(df, columns, self.options["n_neighbors"], self.name)


# ---------------------------------------------------------------- neighbour graphs

def _neighbours(df: DataFrame, key: str, k: int, columns: list[str] | None) -> DataFrame:
    """src, near: the k nearest other rows (dist squared, tag) by (distance, key); means fill missing values."""
    columns = columns or chosen(df, {"columns": None, "exclude": [key]}, "neighbours")
    spread = _filled_spread(df, columns)
    used = [c for c in columns if spread[c]["count"]]
    total = spread[columns[0]]["rows"]
    rows = settle(df.select(col(key).cast("long").alias("src"),
                            _vector([filled(c, spread[c]["mean"]) for c in used]).alias("vec")), "rows")
    # Of the copies of a vector only the k + 1 smallest keys can be anyone's neighbours.
    ranked = Window.partitionBy("vec").orderBy("src")
    donors = rows.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k + 1)
    donors = donors.select("vec", F.col("src").alias("tag"), F.lit(1).alias("n"))
    vectors = settle(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n")), "vectors")
    found, queries = search(donors, vectors, k + 1, len(used))
    lists = (found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "tag"))).alias("near"))
             .join(queries, "qid").drop("qid"))
    facts_table = settle(vectors.join(lists, "vec"), "lists")
    small = total * (20 * (k + 1) + 8 * len(used)) <= BROADCAST_BYTES
    joined = lookup_join(rows, facts_table, "vec", "n", total, small)
    return joined.select("src", F.slice(F.filter("near", lambda e: e["tag"] != F.col("src")), 1, k).alias("near"))


def knn_edges(df: DataFrame, key: str, k: int, columns: list[str] | None = None) -> DataFrame:
    """Rows (src, dst, rank, dist): the k nearest other rows by (distance, key); means fill missing values.

    `key` is a unique whole number.
    """
    return (_neighbours(df, key, k, columns).select("src", F.posexplode("near").alias("at", "e"))
            .select("src", F.col("e.tag").alias("dst"), (F.col("at") + 1).alias("rank"),
                    F.sqrt("e.dist").alias("dist")))


def _weighed(lists: DataFrame, weigh, out: str) -> DataFrame:
    """A column `out` of weights beside src, dst and dist: `weigh` of the distances of each row's neighbours."""
    def run(batches):
        for pdf in batches:
            dists = [np.sqrt(np.asarray(d, float)) for d in pdf["dist"]]
            counts = [len(d) for d in dists]
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            yield pd.DataFrame({"src": np.repeat(pdf["src"].to_numpy("int64"), counts), "dst": join(pdf["dst"], "int64").astype("int64"),
                                "dist": join(dists, float), out: join([weigh(d) for d in dists], float)})

    lists = bounded_batches(lists).filter(F.size("near") > 0)
    return (lists.select("src", F.col("near.tag").alias("dst"), F.col("near.dist").alias("dist"))
            .mapInPandas(run, f"src long, dst long, dist double, {out} double"))


def affinity_graph(df: DataFrame, key: str, perplexity: float = 30, columns: list[str] | None = None) -> DataFrame:
    """Rows (src, dst, dist, p): Gaussian weights over 3 x perplexity neighbours, summing to 1 per row,

    with a width per row that makes the entropy of the weights log(perplexity).
    """
    rows = df.count()
    perplexity = min(perplexity, (rows - 1) // 3)
    if perplexity < 1:
        raise ValueError("too few rows for a neighbour graph")
    k = min(rows - 1, int(3 * perplexity))
    goal = math.log(perplexity)
    return _weighed(_neighbours(df, key, k, columns), lambda dist: _calibrated(dist ** 2, goal), "p")


def _calibrated(sq: np.ndarray, goal: float) -> np.ndarray:
    sq = sq - sq.min()
    low, high, beta = 0.0, math.inf, 1.0 / (sq.mean() or 1.0)
    p = np.full(len(sq), 1.0 / len(sq))
    for _ in range(200):
        w = np.exp(-sq * beta)
        p = w / w.sum()
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum()
        if abs(entropy - goal) < 1e-6:
            break
        if entropy > goal:
            low, beta = beta, beta * 2 if math.isinf(high) else (beta + high) / 2
        else:
            high, beta = beta, (beta + low) / 2
    return p


def fuzzy_graph(df: DataFrame, key: str, n_neighbors: int = 15, columns: list[str] | None = None) -> DataFrame:
    """Rows (src, dst, weight): exp(-(d - nearest) / width) per row, made symmetric by a + b - ab.

    The width of a row makes its weights add up to log2(n_neighbors).
    """
    goal = math.log2(n_neighbors)
    one_way = _weighed(_neighbours(df, key, n_neighbors, columns), lambda dist: _fuzzy(dist, goal), "weight").drop("dist")
    # Each edge counts from both ends: a + b - ab is 1 - (1 - a)(1 - b).
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(
        (F.max("weight") + F.min("weight") - F.max("weight") * F.min("weight")).alias("pair"),
        F.max("weight").alias("one"), F.count(F.lit(1)).alias("n")).select(
        "src", "dst", F.when(F.col("n") == 2, F.col("pair")).otherwise(F.col("one")).alias("weight"))


def _fuzzy(dist: np.ndarray, goal: float) -> np.ndarray:
    above = dist[dist > 0]
    nearest = above.min() if len(above) else 0.0
    gap = np.maximum(dist - nearest, 0.0)
    low, high, width = 0.0, math.inf, 1.0
    for _ in range(200):
        total = np.exp(-gap / width).sum()
        if abs(total - goal) < 1e-5:
            break
        if total > goal:
            high, width = width, (low + width) / 2
        else:
            low, width = width, width * 2 if math.isinf(high) else (width + high) / 2
    # A floor on the width keeps rows with many equal distances finite.
    width = max(width, 1e-3 * (dist.mean() if len(dist) else 0.0), 1e-12)
    return np.exp(-gap / width)
