"""Exact percentiles (linear interpolation) at any size.

`percentile` keeps a map of all distinct values in one task, so it is used only
where a count shows the input to be small. Beyond that, ranks are found by
narrowing: a bounded sketch proposes splitters around each wanted rank, one
counting scan says exactly how many rows lie below, on and between them, and
the search goes on inside the one open interval that holds the rank. Each round
shrinks an interval by about the sketch's accuracy, and a value that fills a
large share of the rows becomes a splitter itself, so heavy ties end a search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import AGG_CHUNK, agg_rows
from millrace.schema import col, doubles

SMALL_CELLS = 1_000_000   # rows x columns for the one-aggregate path
COLLECT_VALUES = 20_000   # distinct values of one interval that may reach the driver
FEW_POINTS = 20           # points of a span whose sides are counted one by one
ACCURACY = 10_000         # sketch accuracy: rank error at most rows / ACCURACY


def percentiles(df: DataFrame, columns: list[str], probs: list[float], counts: dict[str, int] | None = None,
                small_cells: int | None = None) -> dict[str, list[float | None]]:
    """Percentiles of each column over its non-missing values, in the order of `probs`.

    `counts` (non-missing values per column) saves the counting job. Up to `small_cells` values (default SMALL_CELLS) take
    the one-aggregate path; both ways are exact.
    """
    if not columns:
        return {}
    df = doubles(df, columns)
    if counts is None:
        counts = dict(zip(columns, agg_rows(df, [F.count(col(c)) for c in columns])))
    if sum(counts[c] for c in columns) <= (SMALL_CELLS if small_cells is None else small_cells):
        probes = F.array(*[F.lit(float(p)) for p in probs])
        found = agg_rows(df, [F.percentile(col(c), probes) for c in columns])
        return {c: list(v) if v is not None else [None] * len(probs) for c, v in zip(columns, found)}
    wanted = {c: sorted({r for p in probs for r in _ranks(p, counts[c])}) for c in columns if counts[c]}
    values = select_ranks(df, wanted, counts)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if not counts[c]:
            out[c] = [None] * len(probs)
            continue
        row = []
        for p in probs:
            low, high = _ranks(p, counts[c])
            share = p * (counts[c] - 1) - low
            a, b = values[c, low], values[c, high]
            row.append(a if share == 0 or a == b else a * (1 - share) + b * share)
        out[c] = row
    return out


def _ranks(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at)


@dataclass
class _Span:
    """Open interval of one column: `base` rows lie at or below `low`."""

    column: str
    low: float | None
    high: float | None
    base: int
    size: int
    ranks: list[int] = field(default_factory=list)

    def holds(self) -> Column:
        x = col(self.column)
        inside = x.isNotNull()
        if self.low is not None:
            inside = inside & (x > self.low)
        if self.high is not None:
            inside = inside & (x < self.high)
        return inside


def select_ranks(df: DataFrame, wanted: dict[str, list[int]],
                 counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of the sorted non-missing values."""
    found: dict[tuple[str, int], float] = {}
    spans = [_Span(c, None, None, 0, counts[c], ranks) for c, ranks in wanted.items()]
    while spans:
        small = [s for s in spans if s.size <= COLLECT_VALUES]
        large = [s for s in spans if s.size > COLLECT_VALUES]
        if small:
            _read_small(df, small, found)
        spans = _narrow(df, large, found) if large else []
    return found


def _tagged(df: DataFrame, spans: list[_Span], value) -> DataFrame:
    """One row (span, value) per span that holds a row's value."""
    cells = [F.when(s.holds(), F.struct(F.lit(i).alias("span"), value(i, s).alias("v")))
             for i, s in enumerate(spans)]
    return (df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell"))
            .select("cell.span", "cell.v"))


def _read_small(df, spans, found) -> None:
    for start in range(0, len(spans), 50):
        part = spans[start:start + 50]
        rows = (_tagged(df, part, lambda i, s: col(s.column))
                .groupBy("span", "v").count().orderBy("span", "v").collect())
        seen = {i: s.base for i, s in enumerate(part)}
        waiting = {i: list(s.ranks) for i, s in enumerate(part)}
        for row in rows:
            upto = seen[row["span"]] + row["count"]
            ranks = waiting[row["span"]]
            while ranks and ranks[0] < upto:
                found[part[row["span"]].column, ranks.pop(0)] = row["v"]
            seen[row["span"]] = upto


def _narrow(df, spans, found) -> list[_Span]:
    probes = []
    for s in spans:
        shares = set()
        for r in s.ranks:
            at = (r - s.base + 1) / s.size
            for shift in (-2.0 / ACCURACY, 0.0, 2.0 / ACCURACY):
                shares.add(min(1.0, max(0.0, at + shift)))
        probes.append(F.array(*[F.lit(x) for x in sorted(shares)]))
    sketches = agg_rows(df, [
        F.percentile_approx(F.when(s.holds(), col(s.column)), p, ACCURACY)
        for s, p in zip(spans, probes)
    ])
    splitters = [sorted(set(sk)) for sk in sketches]
    few = max(map(len, splitters)) <= FEW_POINTS
    tallies = _counted(df, spans, splitters) if few else _grouped(df, spans, splitters)
    narrower = []
    for i, s in enumerate(spans):
        points = splitters[i]
        below = s.base
        waiting = list(s.ranks)
        for slot in range(2 * len(points) + 1):
            here = tallies.get((i, slot), 0)
            mine = []
            while waiting and waiting[0] < below + here:
                mine.append(waiting.pop(0))
            if mine and slot % 2:
                for r in mine:
                    found[s.column, r] = points[slot // 2]
            elif mine:
                at = slot // 2
                low = points[at - 1] if at else s.low
                high = points[at] if at < len(points) else s.high
                narrower.append(_Span(s.column, low, high, below, here, mine))
            below += here
    return narrower


def _counted(df, spans, splitters) -> dict[tuple[int, int], int]:
    """Rows per (span, slot), by the rows below and up to each point; a job reads about one column and no row is multiplied."""
    tests = [test for s, points in zip(spans, splitters) for p in points for test in (col(s.column) < p, col(s.column) <= p)]
    got = iter(agg_rows(df, [F.count_if(t) for t in tests], 2 * FEW_POINTS))
    tallies = {}
    for i, (s, points) in enumerate(zip(spans, splitters)):
        done = s.base
        for slot in range(2 * len(points)):
            upto = next(got)
            tallies[i, slot], done = upto - done, upto
        tallies[i, 2 * len(points)] = s.base + s.size - done
    return tallies


def _grouped(df, spans, splitters) -> dict[tuple[int, int], int]:
    """Rows per (span, slot) in one scan for spans of many points."""
    tallies: dict[tuple[int, int], int] = {}
    for start in range(0, len(spans), AGG_CHUNK):
        part = spans[start:start + AGG_CHUNK]
        rows = (_tagged(df, part, lambda i, s: _slot(col(s.column), splitters[start + i], 0))
                .groupBy("span", "v").count().collect())
        tallies.update({(start + r["span"], r["v"]): r["count"] for r in rows})
    return tallies


def _slot(x: Column, points: list[float], first: int) -> Column:
    """Binary search as an expression: odd slots are the points, even ones the gaps."""
    if not points:
        return F.lit(2 * first)
    mid = len(points) // 2
    return (F.when(x < points[mid], _slot(x, points[:mid], first))
            .when(x == points[mid], F.lit(2 * (first + mid) + 1))
            .otherwise(_slot(x, points[mid + 1:], first + mid + 1)))
