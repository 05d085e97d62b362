"""Latent Dirichlet allocation by online variational Bayes, the method of MLlib's LDA, over packed bags of words.

Texts become bags once, a row for each: terms and counts as bytes, so that the rows of a batch are one numpy array, and neither a
reader of rows nor a worker ever holds more than some thousand texts. The bags of a slice of PAIRS go through numpy together.
Each round reads every bag (MLlib draws as many with repeats), and tasks hand on sums by term, so the driver holds the model
only: a number for each topic and term. A bag begins with ones in the first round, and then with what the last round left it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.runtime import release, settle

# Fixed values, those of MLlib: mean change of a text's parameters at which it has settled, and the weight of a round.
SETTLED = 1e-3
OFFSET, DECAY = 1024.0, 0.51
SHAPE = 100.0
PAIRS = 1 << 17  # terms of bags that settle together


def _series(x: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of 1 / (x + i) ** power over i < 6, and x + 6."""
    return sum(1.0 / (x + i) ** power for i in range(6)), x + 6.0


def digamma(x: np.ndarray) -> np.ndarray:
    low, y = _series(x, 1)
    f = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - low


def trigamma(x: np.ndarray) -> np.ndarray:
    low, y = _series(x, 2)
    f = 1.0 / (y * y)
    return low + 1.0 / y + f / 2 + f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def expected_log(x: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions, whose parameters are the columns."""
    return digamma(x) - digamma(x.sum(axis=0))


def bags(words: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term and count of the known words of each row, sorted by row and term."""
    terms = pc.index_in(words.flatten(), vocabulary)
    rows = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    found = terms.is_valid().to_numpy(zero_copy_only=False)
    key = rows[found] * len(vocabulary) + terms.drop_null().to_numpy(zero_copy_only=False)
    key, n = np.unique(key, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def starts_of(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)


def settle_bags(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray,
                gamma: np.ndarray | None = None) -> np.ndarray:
    """Parameters (topics x bags) of each bag's shares, from `gamma` on. beta: exp of the expected logarithms, topics x terms.

    Two plain steps show where a bag is heading, and the next begins further on that way (SQUAREM; Varadhan and Roland 2008). A bag
    has settled when a plain step hardly moves it, so the points where this ends are those where plain steps end.
    """
    gamma = np.ones((len(alpha), len(starts))) if gamma is None else gamma.copy()
    lens = np.diff(np.append(starts, len(terms)))
    live, open_, weight = np.arange(len(starts)), np.ones(len(starts), bool), beta[:, terms]

    def step(g: np.ndarray) -> np.ndarray:
        theta = np.exp(expected_log(g))
        phi = np.einsum("kn,kn->n", weight, np.repeat(theta, lens, axis=1)) + 1e-100
        return alpha[:, None] + theta * np.add.reduceat(weight * (counts / phi), starts, axis=1)

    while open_.any():
        if open_.mean() < 0.8:  # settled ones stay as they are, and leave when they are many
            keep = np.repeat(open_, lens)
            weight, counts, live, lens = weight[:, keep], counts[keep], live[open_], lens[open_]
            starts, open_ = np.cumsum(lens) - lens, open_[open_]
        old = gamma[:, live]
        new = step(old)
        done = np.abs(new - old).mean(axis=0) <= SETTLED
        if not done.all():
            second = step(new)
            first_move, turn = new - old, second - 2 * new + old
            length = np.maximum(1.0, np.sqrt((first_move ** 2).sum(axis=0) / np.maximum((turn ** 2).sum(axis=0), 1e-300)))
            far = old + 2 * length * first_move + length ** 2 * turn
            fits = (far > alpha[:, None] / 2).all(axis=0) & (np.abs(second - new).mean(axis=0) > SETTLED)
            new = np.where(done, new, np.where(fits, far, second))
        gamma[:, live[open_]] = new[:, open_]
        open_ = open_ & ~done
    return gamma


def in_slices(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray,
              gamma: np.ndarray | None = None) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """settle_bags for bags of at most PAIRS pairs together (or one): the bags, their pairs, where each begins there, and gamma."""
    edges = np.append(starts, len(terms))
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(edges, edges[a] + PAIRS, side="right")) - 1, a + 1)
        own, pairs = slice(a, b), slice(int(edges[a]), int(edges[b]))
        begin = starts[own] - edges[a]
        yield own, pairs, begin, settle_bags(begin, terms[pairs], counts[pairs], beta, alpha, None if gamma is None else gamma[:, own])
        a = b


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Bytes of the values between each two edges."""
    edges = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What _binary was made of: the values and the edges, from 0."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0]:edges[-1]]
    return data.view(kind), (edges - edges[0]) // np.dtype(kind).itemsize


def _kind(size: int) -> np.dtype:
    """Of the terms of a vocabulary of this size."""
    return np.dtype(np.uint16 if size <= 1 << 16 else np.int32)


def _packed(df: DataFrame, words: Column, vocabulary: list[str]) -> DataFrame:
    """A bag for each text that has a known word: terms and counts as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            rows, terms, n = bags(batch.column(0), known)
            if len(rows):
                edges = np.append(starts_of(rows), len(rows))
                yield pa.RecordBatch.from_arrays([_binary(terms.astype(_kind(len(vocabulary))), edges), _binary(n.astype(np.int32), edges)],
                                                 ["terms", "counts"])

    return bounded_batches(df).select(words.alias("words")).mapInArrow(pack, "terms binary, counts binary")


def _round(table: DataFrame, beta: np.ndarray, alpha: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """The bags with their new parameters, and sums over all: by topic and term, of the expected logarithms of shares, and of bags."""
    k, size = beta.shape
    names = [f"s{i}" for i in range(k)]
    schema = pa.schema([("terms", pa.binary()), ("counts", pa.binary()), ("gamma", pa.binary()), ("term", pa.int64()),
                        *[(c, pa.float64()) for c in names], ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, logs, n = np.zeros((k, size)), np.zeros(k), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, edges = _values(batch.column("terms"), _kind(size))
            counts = _values(batch.column("counts"), np.int32)[0]
            before = _values(batch.column("gamma"), np.float64)[0].reshape(-1, k).T if "gamma" in batch.schema.names else None
            after = np.empty((batch.num_rows, k))
            for own, pairs, begin, gamma in in_slices(edges[:-1], terms, counts, beta, alpha, before):
                at = terms[pairs]
                log_theta = expected_log(gamma)
                theta = np.repeat(np.exp(log_theta), np.diff(np.append(begin, len(at))), axis=1)
                share = counts[pairs] / (np.einsum("kn,kn->n", beta[:, at], theta) + 1e-100)
                for t in range(k):
                    stats[t] += np.bincount(at, theta[t] * share, size)
                logs, n = logs + log_theta.sum(axis=1), n + len(begin)
                after[own] = gamma.T
            yield _batch(schema, batch.num_rows, terms=batch.column("terms"), counts=batch.column("counts"),
                         gamma=_binary(after.ravel(), k * np.arange(batch.num_rows + 1)))
        if n:
            hit = np.flatnonzero(stats.any(axis=0))
            # Term -1 has the sums over bags.
            yield _batch(schema, len(hit) + 1, term=pa.array(np.append(hit, -1)), n=pa.array(np.append(np.zeros(len(hit), np.int64), n)),
                         **{c: pa.array(np.append(stats[t, hit], logs[t])) for t, c in enumerate(names)})

    types = "terms binary, counts binary, gamma binary, term long, "
    made = settle(bounded_batches(table).mapInArrow(run, types + ", ".join([*[f"{c} double" for c in names], "n long"])), "topics")
    sums = made.filter("term is not null").groupBy("term").agg(*[F.sum(c).alias(c) for c in names], F.sum("n").alias("n"))
    stats, logs, n = np.zeros((k, size)), np.zeros(k), 0
    for r in sums.collect():  # at most the vocabulary
        if r["term"] < 0:
            logs, n = np.array([r[c] for c in names]), r["n"]
        else:
            stats[:, r["term"]] = [r[c] for c in names]
    return made.filter("term is null").select("terms", "counts", "gamma"), stats, logs, n


def _batch(schema: pa.Schema, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """Columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def fit(df: DataFrame, words: Column, vocabulary: list[str], k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of the topics (topics x terms), and of the shares."""
    # Every round reads all bags from the shared folder, and begins with the parameters that the round before left them.
    table = settle(_packed(df, words, vocabulary), "topics")
    topics = np.random.default_rng(seed).gamma(SHAPE, 1 / SHAPE, (k, len(vocabulary)))
    alpha, eta = np.full(k, 1 / k), 1 / k
    for at in range(1, rounds + 1):
        beta = np.exp(expected_log(topics.T)).T
        last = table
        table, stats, logs, n = _round(last, beta, alpha)
        release(last)
        weight = (OFFSET + at) ** -DECAY
        topics = (1 - weight) * topics + weight * (stats * beta + eta)
        if n:  # a Newton step for the parameters of the shares
            gradient = n * (logs / n - expected_log(alpha))
            c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
            step = -(gradient - (gradient / q).sum() / (1 / c + (1 / q).sum())) / q
            if (alpha + weight * step > 0).all():
                alpha = alpha + weight * step
    release(table)
    return topics, alpha


def shares(words: Column, vocabulary: list[str], topics: np.ndarray, alpha: np.ndarray) -> Column:
    """The share of each topic in a row of words; equal shares if none of them is known."""
    beta = np.exp(expected_log(topics.T)).T

    @F.arrow_udf("array<double>")
    def run(words: pa.Array) -> pa.Array:
        rows, terms, n = bags(words, pa.array(vocabulary, pa.string()))
        out = np.full((len(words), len(alpha)), 1 / len(alpha))
        if len(rows):
            starts = starts_of(rows)
            for own, _, _, gamma in in_slices(starts, terms, n, beta, alpha):
                out[rows[starts[own]]] = (gamma / gamma.sum(axis=0)).T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * len(alpha)), pa.array(out.ravel()))

    return run(words)
