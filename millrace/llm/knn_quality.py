"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of terms of two kinds. Those of its form are triples of character classes (letters of either case, digits,
marks each for itself, spaces, line ends), and how often words repeat. The others are its words in lower case, hashed to
`WORDS` numbers. Term counts are damped and weighted by inverse document frequency, and each kind is brought to length
one, so that both weigh the same; a truncated singular value decomposition of a bounded sample of labelled texts gives the
latent directions. These and the sample's vectors are broadcast: at most `(TERMS + 2 * PER_LABEL) * RANK` numbers. Every document is
projected, its cosines with all labelled vectors are computed exactly, in blocks of documents, and the labels of the
`NEIGHBOURS` nearest vote with their similarity to the power `SHARPNESS` as weight.

The fit takes up to `PER_LABEL` labelled documents of each label, in the order of a hash of their ids, and draws on no
held-out row; scores use the text alone.

Defined cases: a null or empty text has no terms and scores the share of label 1 among the labelled vectors; texts of
any length are read whole, in slices; rows are independent, so repeated rows repeat their score; ids with two
different labels teach nothing, and neither do null labels; without any labelled row every score is 0.5; an empty
table gives an empty one; only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.batches import bounded_batches
from millrace.llm.names import free_names
from millrace.schema import col

PER_LABEL = 1500   # bound of the sample, for each label
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
BLOCK = 512        # documents whose cosines are held at once
SLICE = 1 << 20    # bytes of a text that are held as arrays at once
FOLDS, HELD_OUT = 3, 1

_CLASSES = np.zeros(256, np.int32)
_CLASSES[ord("A"):ord("Z") + 1] = 1
_CLASSES[ord("a"):ord("z") + 1] = 2
_CLASSES[ord("0"):ord("9") + 1] = 3
_CLASSES[128:] = 2
for _i, _c in enumerate("\n .,!?#*$%&|<>-'\"/:;@_()"):
    _CLASSES[ord(_c)] = 4 + _i
KINDS = int(_CLASSES.max()) + 1
SHAPES = KINDS ** 3
REPEATS = 24       # terms for adjacent repeats and for the share of new words, by tenths
FORM = SHAPES + REPEATS
WORDS = 1 << 15
TERMS = FORM + WORDS
MARKS = ".,;:!?()[]\"'"  # stripped from words
COLUMNS = 1024     # terms whose columns the fit holds at once
KRYLOV, RESTARTS, RESIDUAL = 6, 30, 1e-7  # blocks of a search space, searches, and what is left of an eigenvector, of the largest value


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and damped counts of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(FORM, np.int64)
    for a in range(0, max(len(data) - 2, 0), SLICE):
        kinds = _CLASSES[data[a:a + SLICE + 2]]
        counts[:SHAPES] += np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=SHAPES)
    words = text.split()
    if words:
        again = sum(map(str.__eq__, words, words[1:]))
        counts[SHAPES + (10 * again) // len(words)] = len(words)
        counts[SHAPES + 12 + (10 * len(set(words))) // len(words)] = len(words)
    at = np.flatnonzero(counts)
    times = Counter(w.strip(MARKS) for w in text.lower().split())
    hashes = np.fromiter((zlib.crc32(w.encode()) % WORDS for w in times), np.int64, len(times))
    hashed, which = np.unique(hashes, return_inverse=True)
    repeats = np.bincount(which, weights=np.fromiter(times.values(), float, len(times)), minlength=len(hashed))
    return np.concatenate([at, FORM + hashed]), np.log1p(np.concatenate([counts[at], repeats]))


@dataclass
class Model:
    """idf (TERMS), row of each term in the directions (-1: none), directions (terms of the sample x rank), labelled vectors of
    length one, their labels."""

    idf: np.ndarray
    place: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weights of a text's terms; those of form and those of words have length one each."""
        w = weights * self.idf[at]
        split = np.searchsorted(at, FORM)
        for part in (w[:split], w[split:]):
            part /= np.linalg.norm(part) or 1
        return w

    def project(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(bags), self.directions.shape[1]))
        for i, (at, weights) in enumerate(bags):
            place = self.place[at]
            known = place >= 0
            out[i] = self.weighted(at, weights)[known] @ self.directions[place[known]]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        prior = self.labels.mean() if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            rows = self.project([terms(t) for t in texts[a:a + BLOCK]])
            cosines = rows @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weights = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1) ** SHARPNESS
            total = weights.sum(axis=1)
            votes = (weights * self.labels[near]).sum(axis=1)
            known = (np.abs(rows).sum(axis=1) > 0) & (total > 0)
            out[a:a + BLOCK][known] = (votes[known] / total[known]).clip(0, 1)
        return out


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Learn from at most PER_LABEL labelled, not held-out documents of each label."""
    known = (labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).dropna()
             .filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
             .filter("label = most and label in (0, 1)").drop("most"))
    order = F.xxhash64("id", F.lit(11))
    # Ids without a document fall out, so a margin of them is taken: ids first, then documents, both bounded.
    some = [known.filter(F.col("label") == y).orderBy(order, "id").limit(4 * PER_LABEL) for y in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))

    @F.pandas_udf("at binary, weight binary")
    def bag(texts: pd.Series) -> pd.DataFrame:
        made = [terms(t) for t in texts]
        return pd.DataFrame({"at": [m[0].astype("<i4").tobytes() for m in made], "weight": [m[1].astype("<f4").tobytes() for m in made]})

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(col(id_col).alias("id"), text.alias("text")).join(picked, "id")
    rows = rows.select("label", "id", F.xxhash64("text").alias("h"), bag("text").alias("b"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(order, "id", "h"))
    sample = rows.withColumn("nth", nth).filter(F.col("nth") <= PER_LABEL).select("label", "nth", "b.*")

    def learn(parts):
        parts = list(parts)
        if not sum(map(len, parts)):
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["label", "nth"])
        bags = [(np.frombuffer(a, "<i4"), np.frombuffer(w, "<f4").astype(float)) for a, w in zip(rows["at"], rows["weight"])]
        yield pd.DataFrame({"model": [pickle.dumps(train(bags, rows["label"].to_numpy(float)))]})

    # The bounded sample is learnt in one task, since its matrices would stay in the driver's memory; the model itself is small.
    found = sample.repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    present = np.zeros(TERMS)
    for at, _ in bags:
        present[at] += 1
    idf = np.log((1 + len(bags)) / (1 + present)) + 1
    used = np.flatnonzero(present)
    place = np.full(TERMS, -1, np.int32)
    place[used] = np.arange(len(used))
    rank = max(min(RANK, len(bags), len(used)), 1)
    model = Model(idf, place, np.zeros((len(used), rank), np.float32), np.zeros((0, rank)), labels)
    if len(used):
        rows = [(place[at], model.weighted(at, weight).astype(np.float32)) for at, weight in bags]
        model.directions = _directions(rows, len(used), rank)
    model.vectors = model.project(bags)
    return model


def _directions(rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int) -> np.ndarray:
    """The right singular vectors of the largest singular values of sparse rows, by the Gram matrix of the rows."""
    n = len(rows)
    at, weight = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r[0]) for r in rows])
    order = np.argsort(at, kind="stable")
    at, weight, row = at[order], weight[order], row[order]

    def columns(begin: int) -> np.ndarray:
        lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
        out = np.zeros((n, min(COLUMNS, width - begin)), np.float32)
        out[row[lo:hi], at[lo:hi] - begin] = weight[lo:hi]
        return out

    gram = np.zeros((n, n))
    for begin in range(0, width, COLUMNS):
        part = columns(begin)
        gram += part @ part.T
    values, left = _leading(gram, rank)
    scale = np.sqrt(np.clip(values, 1e-12, None))
    return np.concatenate([columns(begin).T @ left / scale for begin in range(0, width, COLUMNS)]).astype(np.float32)


def _leading(gram: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their vectors, by block Krylov spaces: a full decomposition holds several matrices of this size."""
    n, wide = len(gram), rank + 16
    if n <= KRYLOV * wide:
        values, vectors = np.linalg.eigh(gram)
        return values[::-1][:rank], vectors[:, ::-1][:, :rank]
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(n, wide)))[0]
    for _ in range(RESTARTS):
        space = [block]
        for _ in range(KRYLOV - 1):
            new, basis = gram @ space[-1], np.concatenate(space, axis=1)
            for _ in range(2):  # once more against what rounding leaves
                new -= basis @ (basis.T @ new)
            space.append(np.linalg.qr(new)[0])
        basis = np.linalg.qr(np.concatenate(space, axis=1))[0]
        image = gram @ basis
        values, turn = np.linalg.eigh(basis.T @ image)
        values, turn = values[::-1][:wide], turn[:, ::-1][:, :wide]
        block = basis @ turn
        left_over = np.linalg.norm(image @ turn[:, :rank] - block[:, :rank] * values[:rank], axis=0)
        if left_over.max() <= RESIDUAL * max(values[0], 1e-300):
            break
    return values[:rank], block[:, :rank]


def _score_column(docs: DataFrame, model: Model, text_col: str) -> Column:
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)))

    return run(F.coalesce(col(text_col).cast("string"), F.lit("")))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted of every row."""
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(col(id_col).alias(id_col), held_out(col(id_col)).alias("held_out"),
                       _score_column(docs, model, text_col).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that score 0.5 or more, all columns; the model is learnt from the `labelled` documents."""
    model = fit(labelled, labels, id_col, text_col, label_col)
    name, = free_names(docs, "score")
    return (docs.withColumn(name, _score_column(docs, model, text_col)).filter(F.col(name) >= 0.5)
            .select(*[col(c) for c in docs.columns]))
