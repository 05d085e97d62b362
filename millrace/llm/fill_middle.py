"""Fill-in-the-middle: a text is cut in three at unit boundaries and laid out anew around three sentinels.

Units are words with the white space before them, and white space at the end of a text. The cuts are found by a wavelet
matrix over character classes: every code point has a class (blank, line break, letter or digit, other) and a bit that
tells whether it opens a run of white or of other characters. A matrix of three levels answers how often a symbol stands
before a place. Opened blank and opened line-break runs together are the unit ends up to a place, so the number of
units is a difference of ranks, and the place where a given unit ends is found by bisection on these counts. The texts
of a slice share one matrix, and the bisections of all its texts run side by side.

What is cut and how it is laid out is drawn from the SHA-256 of seed and id, so it is the same on any layout. `restore`
gives back the text.

Defined cases: a null text counts as empty; empty texts, texts that hold a sentinel and those not drawn stay as they are
(form plain); texts of any length are taken whole, one text being in one slice; rows are independent, so repeated rows
repeat their result, and rows of one id are cut at the same unit numbers; a null id draws as the empty string; an empty
table gives an empty one; only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.schema import col

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SEED = 42
RATE = 50       # per cent of texts that are laid out anew
SPM_SHARE = 80  # per cent of those that begin with the suffix
SLICE = 1 << 18  # code points that are held as arrays at once; a longer text has a slice for itself

BLANK, BREAK, LETTER, OTHER = range(4)
OPENS = 4  # added to the class of a code point that opens a run
LEVELS = 3
_CLASSES = np.full(128, OTHER, np.uint8)
_CLASSES[[9, 11, 12, 13, 32]] = BLANK
_CLASSES[10] = BREAK
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = LETTER


class WaveletMatrix:
    """Ranks of small symbols: a bit vector for each level, highest bit first, zeros before ones on the next."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for level in reversed(range(levels)):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.zeros(len(bits) // 64 + 1, np.uint64)
            raw = np.packbits(bits, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = len(bits) - int(bits.sum())
            self.levels.append((level, packed, ones, zeros))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each place."""
        begin, end = np.zeros(1, np.int64), places
        for level, packed, ones, zeros in self.levels:
            both = []
            for at in (begin, end):
                word = at >> 6
                below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
                one = ones[word] + np.bitwise_count(packed[word] & below)
                both.append(zeros + one if symbol >> level & 1 else at - one)
            begin, end = both
        return end - begin


def symbols_of(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Class and opening bit of every code point; `heads` are the places where texts begin."""
    kinds = np.where(codes < 128, _CLASSES[np.minimum(codes, 127)], LETTER).astype(np.uint8)
    white = kinds <= BREAK
    opens = np.ones(len(codes), bool)
    opens[1:] = white[1:] != white[:-1]
    opens[heads] = True
    return kinds + OPENS * opens


class Cuts:
    """Unit ends of several texts that stand behind each other."""

    def __init__(self, texts: list[str]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.matrix = WaveletMatrix(symbols_of(codes, self.starts[lens > 0]), LEVELS)
        self.base = self._opened(np.minimum(self.starts + 1, self.ends))
        self.units = np.where(lens > 0, self._opened(self.ends) - self.base + 1, 0)

    def _opened(self, places: np.ndarray) -> np.ndarray:
        """White runs that open before each place."""
        return self.matrix.rank(BLANK + OPENS, places) + self.matrix.rank(BREAK + OPENS, places)

    def after(self, units: np.ndarray) -> np.ndarray:
        """For each text the code points of its first so many units: the least place up to which they have ended."""
        low, high = self.starts.copy(), self.ends.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self._opened(np.minimum(middle + 1, self.ends)) - self.base >= units
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        # no units end at the very beginning, where a white run may open
        return np.where(units > 0, low - self.starts, 0)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def spans(texts: list[str], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Units, prefix and middle code points of each text; first and second are numbers that draw the two cuts."""
    out = np.zeros((len(texts), 3), np.int64)
    for a, b in _slices(texts):
        cuts = Cuts(texts[a:b])
        one, two = first[a:b] % (cuts.units + 1), second[a:b] % (cuts.units + 1)
        prefix, upto = cuts.after(np.minimum(one, two)), cuts.after(np.maximum(one, two))
        out[a:b] = np.stack([cuts.units, prefix, upto - prefix], axis=1)
    return out


def _drawn(id_col: Column, seed: int, k: int) -> Column:
    """The k-th 32 bits, from 0, of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
                spm_share: int = SPM_SHARE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output of every row."""

    @F.pandas_udf("n long, prefix long, middle long")
    def cut(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(spans(list(texts), first.to_numpy(), second.to_numpy()), columns=["n", "prefix", "middle"])

    row = col(id_col)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(row.alias("id"), text.alias("text"), *[_drawn(row, seed, k).alias(f"h{k}") for k in range(4)])
    rows = rows.withColumn("c", cut("text", "h0", "h1"))
    held = F.lit(False)
    for mark in sentinels:
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (F.col("h2") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h3") % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    prefix = F.substr("text", F.lit(1), F.col("c.prefix").cast("int"))
    middle = F.substr("text", (F.col("c.prefix") + 1).cast("int"), F.col("c.middle").cast("int"))
    suffix = F.substr("text", (F.col("c.prefix") + F.col("c.middle") + 1).cast("int"))
    p, s, m = map(F.lit, sentinels)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    cut_only = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return rows.select(F.col("id").alias(id_col), F.col("c.n").alias("n"), "form", cut_only("c.prefix").alias("prefix_chars"),
                       cut_only("c.middle").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `output` was made of."""
    mark_p, mark_s, mark_m = sentinels
    begin = {mark: F.instr(output, mark) for mark in sentinels}
    end = F.length(output) + 1

    def between(mark: str, stop: Column) -> Column:
        return F.substr(output, begin[mark] + len(mark), stop - begin[mark] - len(mark))

    middle = between(mark_m, end)
    psm = F.concat(between(mark_p, begin[mark_s]), middle, between(mark_s, begin[mark_m]))
    spm = F.concat(between(mark_p, begin[mark_m]), middle, between(mark_s, begin[mark_p]))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
