"""Sharding by histogram sort, in DataFrame operations only.

Rows are put in order of ``key`` and cut into shards of nearly equal bytes. Nothing is sorted to find the cuts: a
histogram gives the exact bytes below the edges of equal steps; the step in which a cut falls is probed again in finer
steps, until the bytes below the cut are within tolerance. A row's position is a list of four digits, the halves of its
key and of its row id, so that neither the width of 64-bit keys nor rows of one key stand in the way: where a step is
one digit wide, the next digit is probed. The same rounds, counting rows instead of bytes, cut the order into ranges of
at most about ``rows_per_range`` rows, and of about ``BYTES_PER_RANGE`` on average, wherever keys crowd. Then the rows are exchanged once, by range; a row's slot is
its place in its range plus the rows of the ranges of its shard before it.

Nulls and edge cases: a null size is 0; null keys come last. Any 64-bit key is allowed. Repeated rows stay; equal
keys are told apart by the row id alone, so any of them may stand on either side of a cut. Fewer rows than shards leave
shards empty. An empty table gives an empty result. Other columns travel in one struct, so their names cannot clash;
columns ``shard`` and ``slot`` are replaced. Row ids are places in the table, so the input has to be a written table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.columns import packed, unpacked
from tessera.llm.ranking import lookup
from tessera.plans.staging import stage

#: Histogram cells that a round may send to the driver, over all cuts.
CELLS = 1 << 16
MOST_PROBES = 2048
#: Of a shard's bytes.
TOLERANCE = 1e-4
#: Of a range's rows.
RANGE_TOLERANCE = 0.25
ROWS_PER_RANGE = 250_000
BYTES_PER_RANGE = 32 << 20
#: More ranges than this would make the search of a row's range slow; beyond it ranges grow.
MAX_RANGES = 4096
HALF = 1 << 32
#: One past the largest value of each digit; the first begins at -2**31 and has 2**31 for null.
TOP = ((1 << 31) + 1, HALF, 1 << 31, HALF)


def digits(key: Column, row: Column) -> Column:
    """The position of a row in the order of key (null last) and row id."""
    low = lambda c: c.bitwiseAND(F.lit(HALF - 1))
    return F.array(F.coalesce(F.shiftright(key, 32), F.lit(1 << 31)), F.coalesce(low(key), F.lit(0)), F.shiftright(row, 32), low(row))


@dataclass
class _Cut:
    """A cut somewhere in [low, high) of the digit after prefix; below: measure of the rows before that."""

    by: str
    goal: float
    near: float
    prefix: tuple[int, ...]
    low: int
    high: int
    below: int = 0
    at: tuple[int, ...] | None = None

    @property
    def bounds(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        return (*self.prefix, self.low), (*self.prefix, self.high)


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def count_upto(bounds: list[tuple[int, ...]], position: Column) -> Column:
    """How many of the sorted bounds are not above a position, by binary search."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    known = _literal([list(b) for b in bounds], "array<bigint>")
    nearer = lambda n, s: F.when(F.get(known, n + s - 1) <= position, n + s).otherwise(n)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), nearer)


def _histogram(rows: DataFrame, spans: list[tuple[tuple, tuple]], probes: int) -> list[list[tuple[int, int, int]]]:
    """For each span, sorted: (step, bytes, rows) of its steps that hold rows."""
    width = [_width(lo[-1], hi[-1], probes) for lo, hi in spans]
    i = count_upto([lo for lo, _ in spans], F.col("at")) - 1
    found = rows.select(i.alias("i"), "at", "size").filter("i >= 0")
    digit = F.get("at", F.get(_literal([len(lo) - 1 for lo, _ in spans], "int"), F.col("i")))
    inside = F.col("at") < F.get(_literal([list(hi) for _, hi in spans], "array<bigint>"), F.col("i"))
    low, wide = F.get(_literal([lo[-1] for lo, _ in spans], "bigint"), F.col("i")), F.get(_literal(width, "bigint"), F.col("i"))
    cells = found.filter(inside).select("i", F.floor((digit - low) / wide).alias("step"), "size").groupBy("i", "step").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    out: list[list[tuple[int, int, int]]] = [[] for _ in spans]
    for r in cells.collect():  # at most CELLS
        out[r["i"]].append((r["step"], r["bytes"], r["rows"]))
    return [sorted(x) for x in out]


def _width(low: int, high: int, probes: int) -> int:
    return max(1, -(-(high - low) // probes))


def _narrow(cut: _Cut, cells: list[tuple[int, int, int]], probes: int) -> None:
    """Moves a cut into the cell that holds it, or fixes it."""
    width, below = _width(cut.low, cut.high, probes), cut.below
    for step, size, count in cells:
        more = size if cut.by == "bytes" else count
        if below + more > cut.goal:
            break
        below += more
    else:
        cut.at = (*cut.prefix, cut.high)
        return
    begin, end = cut.low + step * width, min(cut.low + (step + 1) * width, cut.high)
    last = width == 1 and len(cut.prefix) == len(TOP) - 1
    if last or min(cut.goal - below, below + more - cut.goal) <= cut.near:
        cut.at = (*cut.prefix, end if below + more - cut.goal < cut.goal - below else begin)
    elif width == 1:
        cut.prefix, cut.low, cut.high, cut.below = (*cut.prefix, begin), 0, TOP[len(cut.prefix) + 1], below
    else:
        cut.low, cut.high, cut.below = begin, end, below


def cuts(rows: DataFrame, goals: list[tuple[str, int]], tolerance: float = TOLERANCE) -> dict[str, list[tuple[int, ...]]]:
    """Positions that cut the rows (``at`` and ``size``) into so many parts by each measure: [("bytes", 8), ("rows", 100)]."""
    seen = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not seen["rows"]:
        return {by: [] for by, _ in goals}
    lo, hi = seen["lo"], seen["hi"]
    d = next((i for i in range(len(TOP)) if lo[i] != hi[i]), len(TOP) - 1)
    slack = {"bytes": tolerance, "rows": RANGE_TOLERANCE}
    made = [_Cut(by, seen[by] * s / n, slack[by] * seen[by] / n, tuple(lo[:d]), lo[d], hi[d] + 1) for by, n in goals for s in range(1, n)]
    while open_ := [c for c in made if c.at is None]:
        spans = sorted({c.bounds for c in open_})
        probes = max(4, min(MOST_PROBES, CELLS // len(spans)))
        cells = dict(zip(spans, _histogram(rows, spans, probes), strict=True))
        for c in open_:
            _narrow(c, cells[c.bounds], probes)
    return {by: sorted(c.at for c in made if c.by == by) for by, _ in goals}


def shard(docs: DataFrame, shards: int, size: Column, key: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE, tolerance: float = TOLERANCE) -> DataFrame:
    """docs, a written table, with shard and slot. key is a column of whole numbers, size the bytes of a row."""
    row = F.monotonically_increasing_id()
    named = docs.select(row.alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    rows = stage(named.select(digits(F.col("key"), F.col("row")).alias("at"), "size"), "positions")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(MAX_RANGES, max(-(-n // rows_per_range), total // BYTES_PER_RANGE)))
    found = cuts(rows, [("bytes", shards), ("rows", ranges)], tolerance)
    bounds = sorted({*found["bytes"], *found["rows"]})
    shard_of = [0] + [sum(c <= b for c in found["bytes"]) for b in bounds]
    counts = {r["range"]: r["count"] for r in rows.select(count_upto(bounds, F.col("at")).alias("range")).groupBy("range").count().collect()}
    before, upto = [], {}
    for r, s in enumerate(shard_of):
        before.append(upto.get(s, 0))
        upto[s] = upto.get(s, 0) + counts.get(r, 0)
    whole = packed(docs).withColumns({"row": row, "key": F.col(f"doc.`{key}`").cast("long")})
    placed = whole.withColumn("range", count_upto(bounds, digits(F.col("key"), F.col("row"))))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("key").asc_nulls_last(), "row")).cast("long")
    return unpacked(placed.withColumn("place", place), docs, shard=lookup(shard_of, F.col("range")).cast("int"), slot=F.col("place") - 1 + lookup(before, F.col("range")))
