"""Byte-level BPE encoding and decoding in length-bucketed, padded numpy matrices.

A text is cut before each run of spaces and line breaks, where no pre-token can go on, into chunks; a store keeps
what was computed for a chunk. The pre-tokens of the new chunks that are no tokens themselves become rows of
padded matrices, one for each power of two of length. In every round each row finds the ranks of its adjacent
pairs in a hash table, merges its leftmost pair of lowest rank, and the matrix is compacted by one column; rows
without a pair leave it. Pre-tokens of over `WIDE` bytes are merged one by one with a heap, in the same order.

Defined cases: a null text counts as empty; an empty text has no ids; texts of any length go through in slices;
rows are independent, so repeated rows repeat their result; an empty table gives an empty one; only the id and
the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.llm.hashing import HashTable
from millrace.llm.ragged import ChunkStore, ragged
from millrace.schema import col

WIDE = 512
BLOCK_CELLS = 1 << 20  # cells of a matrix
NONE = np.int64(1 << 40)
# White space outside ASCII, after which a space does not begin a run.
OTHER_SPACE = regex.compile(r"[^\S\x00-\x7f]")


class ByteBpe(ChunkStore):
    """Ranks of a .tiktoken file. Values of a chunk: ids; their decimals, each after a space; the decoded bytes."""

    def __init__(self, path: str, pattern: str):
        self.tokens: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for line in file:
                if parts := line.split():
                    self.tokens[base64.b64decode(parts[0])] = int(parts[1])
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.tokens[t[:i]] << 32 | self.tokens[t[i:]], rank) for t, rank in self.tokens.items()
                 for i in range(1, len(t)) if t[:i] in self.tokens and t[i:] in self.tokens]
        self.pairs = HashTable(max(10, (4 * len(pairs)).bit_length()))
        if pairs:
            keys, ranks = (np.array(x) for x in zip(*pairs))
            self.pairs.put(keys.astype(np.uint64), ranks.astype(np.int64))
        # Bytes and decimals of each id, as ragged arrays.
        size = max(self.tokens.values()) + 1
        names = [b""] * size
        for token, rank in self.tokens.items():
            names[rank] = token
        digits = [b" %d" % i for i in range(size)]
        self.spelled = [(np.frombuffer(b"".join(x), np.uint8), np.cumsum(lens) - lens, lens)
                        for x in (names, digits) for lens in [np.fromiter(map(len, x), np.int64, size)]]
        self.cut_after = np.zeros(256, bool)
        self.cut_after[33:127] = True
        self.cut_after[128:] = True
        super().__init__(kinds=(np.int32, np.uint8, np.uint8))

    def bounds(self, data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A chunk begins with a text, or at a space or line break after a character that is no white space."""
        begin = np.zeros(len(data), bool)
        begin[1:] = ((data[1:] == 32) | (data[1:] == 10)) & self.cut_after[data[:-1]]
        begin[heads] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data))

    def encode_chunks(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        pieces: dict[bytes, int] = {}
        places: list[int] = []
        per_chunk = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            found = self.pattern.findall(chunk.decode())
            per_chunk[i] = len(found)
            places += [pieces.setdefault(p.encode(), len(pieces)) for p in found]
        ids, counts = self.encode_pieces(list(pieces))
        at = np.array(places, np.int64)
        out = ids[ragged((np.cumsum(counts) - counts)[at], counts[at])]
        totals = self._sums(counts[at], per_chunk)
        decoded, digits = ((flat[ragged(offsets[out], lens[out])], self._sums(lens[out], totals))
                           for flat, offsets, lens in self.spelled)
        return [(out, totals), digits, decoded]

    @staticmethod
    def _sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(groups)
        return upto[ends] - upto[ends - groups]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens behind each other, and their number for each."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            token = self.tokens.get(piece)
            if token is not None:
                out[i] = np.array([token], np.int64)
            elif len(piece) > WIDE:
                out[i] = np.array(self.merge_long(piece), np.int64)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            width = 1 << bits
            rows = max(1, BLOCK_CELLS // width)
            for a in range(0, len(members), rows):
                block = members[a:a + rows]
                for i, ids in zip(block, self.merge_block([pieces[i] for i in block], width)):
                    out[i] = ids
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate([np.zeros(0, np.int64), *out]), counts

    def merge_block(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Padded matrix of the pieces; padding is -1 and stays on the right."""
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cells = np.where(np.arange(width) < lens[:, None], self.byte_id[flat], -1)
        out: list[np.ndarray] = [cells[0]] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            left, right = cells[:, :-1], cells[:, 1:]
            ranks = np.full(left.shape, NONE)
            real = right >= 0
            got = self.pairs.get(left[real].astype(np.uint64) << np.uint64(32) | right[real].astype(np.uint64))
            got[got < 0] = NONE
            ranks[real] = got
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            over = low == NONE
            if over.any():
                for i, row, n in zip(rows[over].tolist(), cells[over], (cells[over] >= 0).sum(axis=1).tolist()):
                    out[i] = row[:n]
                rows, cells, best, low = rows[~over], cells[~over], best[~over], low[~over]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            cells[at, best] = low  # a merged pair's rank is its id
            keep = np.ones(cells.shape, bool)
            keep[at, best + 1] = False
            cells = cells[keep].reshape(len(rows), -1)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        lookup = self._pair_dict()
        heap = [(r, i) for i in range(len(ids) - 1) if (r := lookup.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or lookup.get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := lookup.get((rank, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := lookup.get((ids[before[i]], rank))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    @functools.cached_property
    def _pairs_by_ids(self) -> dict[tuple[int, int], int]:
        at = np.flatnonzero(self.pairs.values >= 0)
        keys = self.pairs.keys[at]
        return dict(zip(zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()),
                        self.pairs.values[at].tolist()))

    def _pair_dict(self) -> dict[tuple[int, int], int]:
        return self._pairs_by_ids

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes, bytes]]:
        """Ids, their decimals joined by a space, and the decoded bytes of each text."""
        out: list = [None] * len(texts)
        # Where other white space occurs, a byte over 127 may be its last, so runs are cut after ASCII only.
        odd = [OTHER_SPACE.search(t) is not None for t in texts]
        for strange in (False, True):
            self.cut_after[128:] = not strange
            members = [i for i, x in enumerate(odd) if x == strange]
            for i, ids, digits, decoded in zip(members, *self.joined([texts[i].encode() for i in members])):
                out[i] = ids, digits[1:].tobytes(), decoded.tobytes()
        return out


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row. `ranks` is the file's path on every machine. No shuffle."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([x[0] for x in byte_bpe(ranks, pattern).encode(list(texts))], dtype=object)

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return bounded_batches(docs).select(col(id_col).alias(id_col), ids(text).alias("ids"))


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id and data (binary): the bytes that the ids of each row stand for. Null ids decode to no bytes."""

    @F.pandas_udf("binary")
    def data(ids: pd.Series) -> pd.Series:
        flat, offsets, lens = byte_bpe(ranks, pattern).spelled[0]
        rows = [np.asarray(x if x is not None else [], np.int64) for x in ids]
        return pd.Series([flat[ragged(offsets[r], lens[r])].tobytes() for r in rows], dtype=object)

    return encoded.select(col(id_col).alias(id_col), data(F.col("ids")).alias("data"))


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (see `encode`); encodes and decodes in one pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        rows = byte_bpe(ranks, pattern).encode(list(texts))
        return pd.DataFrame({"n_tokens": [len(x[0]) for x in rows],
                             "ids_sha256": [hashlib.sha256(x[1]).hexdigest() for x in rows],
                             "decoded_sha256": [hashlib.sha256(x[2]).hexdigest() for x in rows]})

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return bounded_batches(docs).select(col(id_col).alias(id_col), both(text).alias("__r")).select(col(id_col), "__r.*")
