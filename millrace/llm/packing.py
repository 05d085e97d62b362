"""Best-fit packing of token sequences by bin completion over the counts of lengths.

Documents become ids, end with `end_id` and are cut only where they are longer than a sequence. Pieces of one
length are interchangeable, so the search runs over the number of pieces of each length, which is a table of at most
`capacity` rows however many documents there are.

Incumbents come first: the largest piece left gets its best-fit filling if that wastes no more than a slack, else an exact
filling of least waste; the slack runs over `SLACKS`, from plain best fit to least waste throughout, and the plan with the
fewest sequences stands. Then bin completion branches from the largest piece down: each node fills the sequence of the
largest piece left, by the undominated fillings in order of waste, and a branch ends where the sequences so far and the
tokens left can't beat the incumbent, which is a bound on the waste still allowed. A filling is dominated if a piece left
fits beside it or in place of one or two smaller pieces. Which sums the lengths can fill is kept as bits up to `capacity`,
so fillings are followed only where they come out. A filling is tried as often as the counts allow, then once. The
search ends when the incumbent meets the lower bound, when all branches are done (then the plan has the fewest sequences),
or after `NODES` nodes; beyond that budget the best plan so far stands. The budget bounds the search, never the pieces:
every piece is in every plan.

Spark then numbers the pieces of each length and every piece finds its place in the plan by that number.

Defined cases: a null text counts as empty and has the end id alone; texts of any length are cut into pieces; equal
rows are packed each for itself; an empty table gives an empty one; only the id and the text column are read, so
other columns cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.batches import bounded_batches
from millrace.llm.token_counts import word_bpe
from millrace.runtime import settle
from millrace.schema import col

SLOT = ["length", "first", "times", "sequence", "offset"]
SLACKS = (4096, 64, 16, 4, 0)  # waste up to which best fit stands, for each incumbent
NODES = 4_000  # nodes of the search
Pattern = tuple[dict[int, int], int]  # pieces of each length in a sequence, and the number of such sequences


def best_fit(room: int, counts: list[int], present: list[int]) -> list[int]:
    """Lengths that best fit takes for `room`: the largest that fits, again and again."""
    best: list[int] = []
    at = bisect_right(present, room) - 1
    while at >= 0 and room >= present[0]:
        size = present[at]
        take = min(counts[size], room // size)
        best += [size] * take
        room -= take * size
        at = min(at, bisect_right(present, room)) - 1
    return best


def fillable(room: int, counts: list[int], present: list[int]) -> list[int]:
    """Bit x of entry i: some copies of the i smallest lengths fill x exactly."""
    sums, mask = [1], (2 << room) - 1
    for size in present[:bisect_right(present, room)]:
        bits, copies, step = sums[-1], min(counts[size], room // size), 1
        while copies:
            take = min(step, copies)
            bits |= bits << take * size & mask
            copies -= take
            step *= 2
        sums.append(bits)
    return sums


def best_filling(room: int, counts: list[int], present: list[int], slack: int = 0) -> list[int]:
    """Lengths, largest first: best fit if it wastes up to `slack`, else a filling of `room` with the least waste.

    `present`: lengths with counts, ascending.
    """
    best = best_fit(room, counts, present)
    if room - sum(best) <= slack or not best:
        return best
    sums = fillable(room, counts, present)
    # From the largest length down, as many copies of each as leave a sum that the smaller ones fill.
    rest = sums[-1].bit_length() - 1
    best = []
    for i in range(len(sums) - 2, -1, -1):
        size = present[i]
        take = min(counts[size], rest // size)
        while not sums[i] >> rest - take * size & 1:
            take -= 1
        best += [size] * take
        rest -= take * size
    return best


def dominated(filling: list[int], waste: int, counts: list[int], present: list[int]) -> bool:
    """Whether a piece that is left fits beside the filling, or in place of one or two of its smaller pieces."""
    used = Counter(filling)
    spare = [x for x in present if counts[x] > used[x]]
    held = lambda low, high: bisect_left(spare, low) < bisect_right(spare, high)
    return (held(1, waste) or any(held(y + 1, y + waste) for y in used)
            or any(held(y + z, y + z + waste) for y in used for z in used if y < z or y == z and used[y] > 1))


def fillings(room: int, counts: list[int], present: list[int], slack: int) -> Iterator[list[int]]:
    """The undominated fillings of `room` in order of waste; best fit comes first if it wastes up to `slack`."""
    first = best_fit(room, counts, present)
    if room - sum(first) <= slack or not first:
        yield first
    else:
        first = None
    if first == []:
        return
    sums = fillable(room, counts, present)
    for rest in range(sums[-1].bit_length() - 1, 0, -1):
        stack = [(len(sums) - 2, rest, [])] if sums[-1] >> rest & 1 else []
        while stack:
            i, open_, chosen = stack.pop()
            if i < 0:
                if chosen != first and not dominated(chosen, room - rest, counts, present):
                    yield chosen
                continue
            size = present[i]
            stack += [(i - 1, open_ - take * size, chosen + [size] * take) for take in range(min(counts[size], open_ // size) + 1)
                      if sums[i] >> open_ - take * size & 1]


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the sequences: pieces that can't stand with any of at least `a`, those over half, and what
    the rest needs beyond the room beside these; the largest over all `a`."""
    sizes = np.array(sorted(s for s in counts if counts[s]), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    upto, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    best = 0
    for k, a in enumerate([0, *sizes[:half].tolist()]):
        alone = int(np.searchsorted(sizes, capacity - a, side="right"))
        pairs = int(upto[alone] - upto[half])
        room = pairs * capacity - int(tokens[alone] - tokens[half])
        small = int(tokens[half] - tokens[max(k - 1, 0)])
        best = max(best, int(upto[-1] - upto[alone]) + pairs + max(-(-(small - room) // capacity), 0))
    return best


class _Left:
    """The pieces left of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = [0] * (capacity + 1)
        for size, n in counts.items():
            self.counts[size] = n
        self.present = sorted(s for s in counts if counts[s])
        self.tokens = sum(s * n for s, n in counts.items())

    def take(self, need: dict[int, int], times: int) -> None:
        """Takes the pieces of that many sequences; a negative number gives them back."""
        for size, n in need.items():
            had = self.counts[size]
            self.counts[size] -= n * times
            if not self.counts[size]:
                del self.present[bisect_left(self.present, size)]
            elif not had:
                insort(self.present, size)
            self.tokens -= size * n * times

    def most(self, need: dict[int, int]) -> int:
        return min(self.counts[s] // n for s, n in need.items())


def completed(counts: dict[int, int], capacity: int, slack: int) -> list[Pattern]:
    """A plan by one filling after the other."""
    left, out = _Left(counts, capacity), []
    while left.present:
        largest = left.present[-1]
        left.take({largest: 1}, 1)
        need = Counter([largest, *best_filling(capacity - largest, left.counts, left.present, slack)])
        left.take({largest: 1}, -1)
        out.append((need, left.most(need)))
        left.take(*out[-1])
    return out


def size_of(patterns: list[Pattern]) -> int:
    return sum(times for _, times in patterns)


def improved(counts: dict[int, int], capacity: int, best: list[Pattern], slack: int, bound: int) -> list[Pattern]:
    """The best plan that bin completion by branch and bound finds within `NODES` nodes, from `best` as incumbent."""
    left, top = _Left(counts, capacity), size_of(best)
    path: list[tuple[int, dict[int, int], int]] = []  # option taken, filling, times
    made = option = nodes = 0
    while top > bound and nodes < NODES:
        nodes += 1
        chosen = None
        if made + -(-left.tokens // capacity) < top:
            if not left.present:
                best, top = [(need, times) for _, need, times in path], made
            else:
                # Options come in pairs: a filling as often as it goes, then once.
                largest = left.present[-1]
                left.take({largest: 1}, 1)
                # Fillings are made again after a return, so that no level holds its sums.
                filling = next(islice(fillings(capacity - largest, left.counts, left.present, slack), option // 2, None), None)
                left.take({largest: 1}, -1)
                allowed = (top - 1 - made) * capacity - left.tokens
                if filling is not None and (option < 2 or capacity - largest - sum(filling) <= allowed):
                    chosen = Counter([largest, *filling])
        if chosen is not None:
            most = left.most(chosen)
            if option % 2 and most == 1:
                option += 1
                continue
            times = 1 if option % 2 else most
            path.append((option, chosen, times))
            left.take(chosen, times)
            made += times
            option = 0
        elif path:
            option, need, times = path.pop()
            left.take(need, -times)
            made -= times
            option += 1
        else:
            break
    return best


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows of SLOT: of the pieces of `length`, those numbered from `first` on stand in `times` sequences from number
    `sequence` on, at `offset`; after `times` pieces the next copies follow, `length` further on."""
    bound, best, chosen = fewest(counts, capacity), None, 0
    for slack in SLACKS:
        if best is None or size_of(best) > bound:
            made = completed(counts, capacity, slack)
            if best is None or size_of(made) < size_of(best):
                best, chosen = made, slack
    best = improved(counts, capacity, best, chosen, bound)
    used, rows, sequence = Counter(), [], 0
    for need, times in best:
        offset = 0
        for size, n in need.items():
            rows.append((size, used[size], times, sequence, offset))
            used[size] += n * times
            offset += n * size
        sequence += times
    return np.array(rows, np.int64).reshape(-1, len(SLOT))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str,
              with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and the ids) of every piece of every row."""
    kind = "array<struct<length:long,ids_crc32:long" + (",ids:array<int>" if with_ids else "") + ">>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for ids in word_bpe(tokenizer).encode([t.encode() for t in texts]):
            ids = np.append(ids, end_id).astype("<u4")
            parts = [ids[a:a + capacity] for a in range(0, len(ids), capacity)]
            out.append([{"length": len(p), "ids_crc32": zlib.crc32(p.tobytes())} | ({"ids": p.astype("i4")} if with_ids else {})
                        for p in parts])
        return pd.Series(out, dtype=object)

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return (bounded_batches(docs).select(col(id_col).alias("id"), F.posexplode(cut(text)).alias("piece", "p"))
            .select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "p.*"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; `with_ids` adds the token ids themselves."""
    spark = docs.sparkSession
    made = pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    pieces = settle(made.withColumn("at", F.monotonically_increasing_id()), "pieces")
    # Number the pieces of a length: within the written partition, after those of the partitions before.
    part = F.shiftright("at", 33)
    tally = settle(pieces.groupBy("length", part.alias("part")).agg(F.count("*").alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    slots = plan(counts, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = spark.sparkContext.broadcast(slots)  # at most some rows for each length
    base = max(counts.values(), default=0) + 1  # above every number of a length

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, first, times, sequence, offset = shared.value.T
        n, k = length.to_numpy(), number.to_numpy()
        # (length, first) as one number, for a single binary search
        at = np.searchsorted(size * base + first, n * base + k, side="right") - 1
        within = k - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + within % times[at], "offset": offset[at] + within // times[at] * n})

    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("at")) - 1
    # `before` grows with the partitions, so it is not broadcast; the join and the window share one shuffle.
    numbered = (pieces.withColumn("part", part).join(before.hint("merge"), ["part", "length"])
                .withColumn("number", F.col("before") + nth))
    placed = numbered.withColumn("__p", place("length", "number"))
    extra = ["ids"] if with_ids else []
    return placed.select(col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length",
                         "ids_crc32", "__p.sequence_id", "__p.offset", *extra)
