"""Token counts and ids under a word-end BPE file, by rank-synchronous merging of ragged numpy arrays.

Texts are cut at spaces and line breaks into chunks, which the tokenizer's rules never join. A batch of texts is
held as one byte array with chunk bounds; chunks get a 64-bit key, and a table holds the ids of the chunks met
before. New chunks are cut into pre-tokens, and all new pre-tokens of a batch are merged at once: they lie behind
each other in one array, and each round applies to every sequence the pair of its lowest rank, wherever it stands.

Defined cases: a null text counts as empty; an empty text has no bytes and no tokens; texts of any length go
through in slices; rows are independent, so repeated rows repeat their result; an empty table gives an empty one;
only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.llm.hashing import HashTable
from millrace.llm.ragged import ChunkStore, ragged
from millrace.schema import col

NONE = np.int64(1 << 40)  # rank of a pair that has no merge

def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, ranks: HashTable,
                 merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences to the end; returns the surviving symbols, sequence by sequence, and their counts.

    `ranks` maps left << 32 | right to a rank and `merged` a rank to the new symbol. Within a sequence all places
    of its lowest pair merge in one round; in a run like aaa the places are taken from the left.
    """
    counts = np.zeros(len(lengths), np.int64)
    done_syms, done_seqs = [], []
    seqs = np.flatnonzero(lengths > 0)
    lens, syms = lengths[seqs].astype(np.int64), symbols.astype(np.int64)
    while len(seqs):
        ends = np.cumsum(lens)
        starts = ends - lens
        keys = (syms.astype(np.uint64) << np.uint64(32))
        keys[:-1] |= syms[1:].astype(np.uint64)
        rank = ranks.get(keys)
        rank[rank < 0] = NONE
        rank[ends - 1] = NONE
        low = np.minimum.reduceat(rank, starts)
        over = low == NONE
        if over.any():
            gone = np.repeat(over, lens)
            done_syms.append(syms[gone])
            done_seqs.append(np.repeat(seqs[over], lens[over]))
            counts[seqs[over]] = lens[over]
            syms, rank = syms[~gone], rank[~gone]
            seqs, lens, low = seqs[~over], lens[~over], low[~over]
            if not len(seqs):
                break
            starts = np.cumsum(lens) - lens
        hit = rank == np.repeat(low, lens)
        twin = hit[1:] & hit[:-1]
        if twin.any():  # overlapping places of a pair of equal symbols: every second one of a run
            at = np.flatnonzero(hit)
            new_run = np.ones(len(at), bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            first = at[new_run][np.cumsum(new_run) - 1]
            hit[at[(at - first) % 2 == 1]] = False
        syms[hit] = merged[rank[hit]]
        keep = np.ones(len(syms), bool)
        keep[1:] = ~hit[:-1]
        lens = np.add.reduceat(keep, starts).astype(np.int64)
        syms = syms[keep]
    if not done_syms:
        return np.zeros(0, np.int64), counts
    order = np.argsort(np.concatenate(done_seqs), kind="stable")
    return np.concatenate(done_syms)[order], counts


class WordBpe(ChunkStore):
    """A tokenizer file with NFC, lower case, white space dropped, byte symbols and word ends."""

    separator = b"\n"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = byte_symbols()
        self.inner = np.array([vocab[s] for s in names], np.int64)
        self.last = np.array([vocab[s + end] for s in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = HashTable(18)
        self.ranks.put(keys, np.arange(len(pairs)))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("|".join(sorted(map(re.escape, special), key=len, reverse=True)) or r"(?!)")
        # Below U+0250 texts are in normal form and lower() is per character, but for U+0130.
        latin = [chr(c) for c in range(0x80, 0x250)]
        letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        self.simple = re.compile("[\x00-\x84\x86-\x9f\xa1-įı-ɏ]*")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9{numbers}]|[^\t-\r a-z0-9{letters}{numbers}]+")
        self.path, self._library = path, None
        super().__init__(kinds=(np.int32,))

    def library(self):
        """The tokenizers library, for the normal form of texts outside the Latin letters."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def pre_tokens(self, chunk: str) -> list[bytes]:
        if self.simple.fullmatch(chunk):
            return [p.encode() for p in self.pieces.findall(chunk.lower())]
        lib = self.library()
        back = {c: b for b, c in enumerate(byte_symbols())}
        return [bytes(map(back.__getitem__, p)) for p, _ in
                lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk)) if p]

    def bounds(self, data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks are what stands between spaces and line breaks."""
        stops = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], stops[:-1] + 1])
        return starts[stops > starts], stops[stops > starts]

    def encode_chunks(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all chunks behind each other, and their number for each chunk."""
        order: dict[bytes, int] = {}
        places: list[int] = []
        per_chunk = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(map(bytes.decode, chunks)):
            if "<" in chunk and (found := self.special_pattern.search(chunk)):
                parts: list[bytes | int] = []
                while found:
                    parts += self.pre_tokens(chunk[:found.start()])
                    parts.append(self.special[found[0]])
                    chunk = chunk[found.end():]
                    found = self.special_pattern.search(chunk)
                parts += self.pre_tokens(chunk)
            else:
                parts = self.pre_tokens(chunk)
            per_chunk[i] = len(parts)
            # special ids stand as negative numbers among the places of pre-tokens
            places += [order.setdefault(p, len(order)) if isinstance(p, bytes) else -1 - p for p in parts]
        words = list(order)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        ids, counts = merge_ragged(symbols, lengths, self.ranks, self.merged)
        at = np.array(places, np.int64)
        extra = np.unique(-1 - at[at < 0])
        offsets = np.concatenate([np.cumsum(counts) - counts, len(ids) + np.arange(len(extra))])
        ids, counts = np.concatenate([ids, extra]), np.concatenate([counts, np.ones(len(extra), np.int64)])
        at = np.where(at < 0, len(words) + np.searchsorted(extra, -1 - at), at)
        out = ids[ragged(offsets[at], counts[at])]
        bounds = np.concatenate([[0], np.cumsum(counts[at])])
        upto = np.cumsum(per_chunk)
        return [(out, bounds[upto] - bounds[upto - per_chunk])]

    def count(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for owner, rows in self.slices(texts):
            out += np.bincount(owner, self.counts[0][rows], len(texts)).astype(np.int64)
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.joined(texts)[0]


@functools.lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer for each worker process and file."""
    return WordBpe(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) for each row of `docs`.

    `tokenizer` is the path of the file on every machine. One pass, no shuffle.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(word_bpe(tokenizer).count([t.encode() for t in texts]))

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return (bounded_batches(docs).select(col(id_col).alias(id_col), text.alias("__text"))
            .select(col(id_col), F.octet_length("__text").cast("long").alias("n_bytes"), tokens("__text").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
