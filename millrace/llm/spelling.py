"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters.

The vocabulary is counted over all texts, pre-aggregated for each batch of texts. Its words go into blocked Bloom
filters, one shard for each length: a word sets `PROBES` bits in one block of 512. Blocks are combined in Spark by
bit_or, and their number is bounded by `MAX_BLOCKS` (64 MB) whatever the vocabulary: beyond, the filter gets fuller and
passes more, which costs time, not results. Every word then generates the edits that lead to its partners: a deletion
at each place, and a replacement by each later letter of the alphabet (insertions and earlier letters are found from the
partner's side). Hashes are linear in the code points, so an edit's hash is a correction of the word's own, and whole
matrices of words of one length are probed at once. Only what the filters pass is spelt out and shuffled to an exact
join with the vocabulary, which removes false positives.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least `DOMINANCE`
times its own; root follows forms to the last, by pointer doubling, so chains need a few rounds only.

Defined cases: null and empty texts have no words; texts of any length are taken whole; repeated rows count again; a
null id enters the hash as the empty string; a table without words that are frequent enough gives an empty result; only
the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.runtime import release, settle
from millrace.schema import col

MIN_CHARS = 6
MIN_COUNT = 5
DOMINANCE = 5
SLIP = 199            # one occurrence in so many loses a code point
BITS_PER_WORD = 16
PROBES = 6
BLOCK_WORDS = 8       # 64-bit words of a block
MAX_BLOCKS = 1 << 20  # of all shards together: 64 MB
LONGEST = 64          # longer words share the last shard
CELLS = 1 << 20       # edits that are held at once
STORE = 1 << 17       # words that are counted before they are handed on
MAX_ROUNDS = 40

# Runs of A-Z in lower case, a-z and U+00C0 to U+00FF, as UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BASE = np.uint64(0xD1342543DE82EF95)
_VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def word_counts(ids: list[str], texts: list[str]) -> Iterator[pd.DataFrame]:
    """word, n of batches of texts, in several parts if there are many words."""
    total: Counter = Counter()

    def part() -> pd.DataFrame:
        words = [w.decode() for w in total]
        long_ = [i for i, w in enumerate(words) if len(w) >= MIN_CHARS]
        counts = list(total.values())
        return pd.DataFrame({"word": [words[i] for i in long_], "n": np.array([counts[i] for i in long_], np.int64)})

    for i, text in zip(ids, texts):
        begun = zlib.crc32(f"{i}:".encode())
        for run, n in Counter(_RUN.findall(text.encode().lower())).items():
            h = zlib.crc32(run, begun)
            if h % SLIP == 0:
                word = run.decode()
                at = h % len(word)
                run = (word[:at] + word[at + 1:]).encode()
            total[run] += n
        if len(total) > STORE:
            yield part()
            total.clear()
    yield part()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words that are long and frequent enough."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from word_counts(batch["id"].tolist(), batch["text"].tolist())

    rows = bounded_batches(docs).select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).cast("string").alias("text"))
    counted = rows.filter("text is not null").mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE)]))[:n]


def linear(codes: np.ndarray) -> np.ndarray:
    """The linear hash of each row of a matrix of code points."""
    return (_VALUES[codes] * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def shard_of(length: int) -> int:
    return min(length, LONGEST)


def places(hashes: np.ndarray, length: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each linear hash within its shard, and the number that its bits are taken from."""
    keys = mixed(hashes + np.array([length], np.uint64) * _BASE)
    return ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mixed(keys)


class Filters:
    """Blocked Bloom filters by word length: `offsets` and `blocks` of each shard in one array of 64-bit words."""

    def __init__(self, sizes: dict[int, int], rows: list[tuple]):
        """`sizes`: blocks of each shard; `rows`: shard, block and the words of the blocks that hold any bit."""
        self.sizes, self.offsets, at = sizes, {}, 0
        for shard, n in sorted(sizes.items()):
            self.offsets[shard] = at
            at += n
        self.words = np.zeros((at, BLOCK_WORDS), np.uint64)
        for shard, block, *words in rows:
            self.words[self.offsets[shard] + block] = np.array(words, np.int64).view(np.uint64)
        self.words = self.words.reshape(-1)

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Indices of the linear hashes that the filter of this length passes."""
        shard = shard_of(length)
        if shard not in self.sizes:
            return np.zeros(0, np.int64)
        block, bits = places(hashes, length, self.sizes[shard])
        left = np.arange(len(hashes))
        base = (self.offsets[shard] + block) * BLOCK_WORDS
        for k in range(PROBES):
            bit = bits >> np.uint64(9 * k) & np.uint64(511)
            hit = self.words[base + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
            left, base, bits = left[hit], base[hit], bits[hit]
        return left


def shard_sizes(counts: dict[int, int]) -> dict[int, int]:
    """Blocks of each shard; all shards shrink alike where they would pass MAX_BLOCKS."""
    wanted = {s: n * BITS_PER_WORD / (64 * BLOCK_WORDS) for s, n in counts.items()}
    scale = min(1.0, (MAX_BLOCKS - len(counts)) / max(sum(wanted.values()), 1))
    return {s: int(w * scale) + 1 for s, w in wanted.items()}


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of its words and their matrix of code points, in blocks of bounded size."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        step = max(1, CELLS // (n * 64))
        for a in range(0, len(at), step):
            part = at[a:a + step]
            yield part, np.frombuffer("".join(words[i] for i in part).encode("latin-1"), np.uint8).reshape(-1, n)


def build_filters(vocab: DataFrame, counts: dict[int, int]) -> Filters:
    sizes = shard_sizes(counts)
    fields = [f"w{i}" for i in range(BLOCK_WORDS)]

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, codes in by_length(batch["word"].tolist()):
                n = codes.shape[1]
                block, numbers = places(linear(codes), n, sizes[shard_of(n)])
                words = np.zeros((len(codes), BLOCK_WORDS), np.uint64)
                for k in range(PROBES):
                    bit = numbers >> np.uint64(9 * k) & np.uint64(511)
                    words[np.arange(len(codes)), (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
                yield pd.DataFrame({"shard": shard_of(n), "block": block} | dict(zip(fields, words.view(np.int64).T)))

    rows = (vocab.select("word").mapInPandas(bits, "shard int, block long, " + ", ".join(f"{f} long" for f in fields))
            .groupBy("shard", "block").agg(*[F.expr(f"bit_or({f})").alias(f) for f in fields]))
    return Filters(sizes, [tuple(r) for r in rows.collect()])  # at most MAX_BLOCKS rows of one block each


def neighbours(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places of words and the edits of them that the filters pass: deletions, and replacements by later letters."""
    for part, codes in by_length(words):
        m, n = codes.shape
        power, values = powers(n), _VALUES[codes]
        whole = (values * power).sum(axis=1, dtype=np.uint64)
        if n > MIN_CHARS:
            before = np.cumsum(values * power, axis=1, dtype=np.uint64) - values * power
            shifted = values[:, 1:] * power[:n - 1]
            behind = np.zeros((m, n), np.uint64)
            behind[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            last = np.ones((m, n), bool)  # of a run of equal letters only the last is deleted
            last[:, :-1] = codes[:, 1:] != codes[:, :-1]
            row, at = np.nonzero(last)
            found = filters.find((before + behind)[row, at], n - 1)
            row, at = row[found], at[found]
            if len(row):
                kept = np.ones((len(row), n), bool)
                kept[np.arange(len(row)), at] = False
                made = codes[row][kept].reshape(len(row), n - 1)
                yield part[row], [x.tobytes().decode("latin-1") for x in made]
        for at in range(n):
            row, letter = np.nonzero(codes[:, at, None] < alphabet)
            hashes = whole[row] + (_VALUES[alphabet][letter] - values[row, at]) * power[at]
            found = filters.find(hashes, n)
            row, letter = row[found], letter[found]
            if len(row):
                made = codes[row].copy()
                made[:, at] = alphabet[letter]
                yield part[row], [x.tobytes().decode("latin-1") for x in made]


def near_pairs(vocab: DataFrame) -> DataFrame:
    """a, na, b, nb for each two words of `vocab` (word, n) that are one edit apart, either way round."""
    spark = vocab.sparkSession
    counts = {r["s"]: r["n"] for r in vocab.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("s")).agg(F.count("*").alias("n")).collect()}
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c != ''").distinct().collect()  # at most 90
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    filters = spark.sparkContext.broadcast(build_filters(vocab, counts))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, n = batch["word"].tolist(), batch["n"].to_numpy()
            for at, made in neighbours(words, alphabet, filters.value):
                yield pd.DataFrame({"a": [words[i] for i in at.tolist()], "na": n[at], "b": made})

    tasks = sum(counts.values()) // 2000 + 1
    passed = vocab.repartition(tasks, "word").mapInPandas(probe, "a string, na long, b string")
    exact = passed.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b").select("a", "na", "b", "nb")
    # both ways round from one probing
    ways = F.array(F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    return exact.select(F.explode(ways).alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: `forms` (word, form) followed to the last; words without a form are their own root."""
    state = settle(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(state.join(onward, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        release(state)
        state = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return state
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    vocab = settle(vocabulary(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")))
    near = near_pairs(vocab).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocab.join(near, "word", "left").withColumn("strong", F.coalesce(-F.col("best.less") >= DOMINANCE * F.col("n"), F.lit(False)))
    facts = settle(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(strong, best.form, null)").alias("form"),
                                 F.expr("if(strong, -best.less, null)").alias("form_n")), "forms")
    return facts.join(roots(facts), "word")
