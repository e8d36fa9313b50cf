"""Sharding (operator 4): histogram sort into shards of near-equal bytes.

Rows are ordered by (hash of the text, id), so equal texts lie side by side.
Exact bytes and counts below evenly spaced key boundaries are counted in every
partition and summed; a splitter whose nearest boundary is further from its
target than the tolerance gets new probes inside its cell, round after round,
first along the hash, then, where one hash is heavier than the tolerance (many
copies of a text), along its ids.  Only then do the rows move, once.  A shard
is cut into ranges of about ``range_bytes``, so no task holds a whole shard; a
row's slot is its range's offset, known from the counts, plus its place there.

What reaches the driver is bounded by the number of splitters (total bytes over
``range_bytes``) times ``PROBES`` per round.

Law: ``bytes``.  A group of equal texts is parted only by a splitter that can't
reach its tolerance at the group's edge.

Defined cases: a null text counts 16 bytes and hashes like any other value; a
null id is the smallest id.  Repeated rows each get their own slot; a splitter
can't part rows with equal hash and id.  An empty table gives no rows.  Columns
called like a result column are replaced.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankcast.llm.common import free_names, without, written

SHARDS = 40
ROW_BYTES = 16
#: Allowed distance of a shard's edge from its target, in mean shard sizes.
TOLERANCE = 0.002
RANGE_BYTES = 256 << 20
PROBES = 4096
LOWEST = -(1 << 63)


class Cut:
    """A splitter on its way: target bytes below it, and the cell it lies in."""

    def __init__(self, target: float, slack: float):
        self.target, self.slack = target, slack
        self.key: tuple[int, int] | None = None  # rows below this (hash, id) are below the splitter
        self.rows = self.bytes = 0

    def settle(self, edges: list[tuple[tuple[int, int], int, int]], force: bool) -> int | None:
        """edges: (key, bytes below, rows below) in order.  Takes the nearest one
        if it is near enough or the last resort; else the number of the cell."""
        k = bisect.bisect_right(edges, self.target, key=lambda e: e[1])
        near = min(edges[max(0, k - 1):k + 1], key=lambda e: abs(e[1] - self.target))
        if force or abs(near[1] - self.target) <= self.slack:
            self.key, self.bytes, self.rows = near
            return None
        return k - 1


def _edges(cells: list, start: tuple[int, int], end: tuple[tuple[int, int], int, int], key_of) -> list:
    """Lower edges of the cells with what lies below, then the end."""
    size, rows, out = *start, []
    for cell, b, n in sorted(cells):
        out.append((key_of(cell), size, rows))
        size, rows = size + b, rows + n
    return out + [end if end else (None, size, rows)]


def splitters(keyed: DataFrame, shards: int, tolerance: float, range_bytes: int) -> tuple[list[Cut], int]:
    """Cuts between consecutive ranges, and the number of ranges of a shard."""
    sums = (F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    total, rows = keyed.agg(*sums).first()
    total = total or 0
    parts = max(1, math.ceil(total / shards / range_bytes))
    count = shards * parts
    cuts = [Cut(total * k / count, total / shards * (tolerance if k % parts == 0 else 0.25 / parts))
            for k in range(1, count)]
    end = ((1 << 63, 0), total, rows)
    if not total:
        for c in cuts:
            c.key = end[0]
        return cuts, parts
    bits = min(20, max((PROBES - 1).bit_length(), (4 * count - 1).bit_length()))
    cells = [(r.c, r.b, r.n) for r in
             keyed.groupBy(F.shiftright("h", 64 - bits).alias("c")).agg(*sums).collect()]
    edges = _edges(cells, (0, 0), end, lambda c: (c << (64 - bits), LOWEST))
    todo: dict[tuple, list[Cut]] = {}

    def file(some: list[Cut], edges: list, cells: list, force: bool = False) -> None:
        names = sorted(c[0] for c in cells)
        for cut in some:
            k = cut.settle(edges, force)
            if k is not None:
                todo.setdefault((names[k], edges[k][1:], edges[k + 1]), []).append(cut)

    file(cuts, edges, cells)
    while todo and bits < 64:  # along the hash
        fine = min(64, bits + 12)
        open_cells, todo = todo, {}
        wanted = sorted({k[0] for k in open_cells})
        found: dict[int, list] = {}
        for r in (keyed.filter(F.shiftright("h", 64 - bits).isin(wanted))
                  .groupBy(F.shiftright("h", 64 - fine).alias("c")).agg(*sums).collect()):
            found.setdefault(r.c >> (fine - bits), []).append((r.c, r.b, r.n))
        for (cell, start, after), some in open_cells.items():
            cells = found[cell]
            file(some, _edges(cells, start, after, lambda c, f=fine: (c << (64 - f), LOWEST)), cells)
        bits = fine
    # one hash heavier than the tolerance: along its ids, between their ends
    spans: dict[int, tuple[int, int]] = {}
    if todo:
        wanted = sorted({k[0] for k in todo})
        spans = {r.h: (r.lo, r.hi) for r in keyed.filter(F.col("h").isin(wanted)).groupBy("h").agg(
            F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
        todo = {((h, *spans[h]), start, after): cuts for (h, start, after), cuts in todo.items()}
    while todo:
        open_cells, todo = todo, {}
        for ((h, lo, hi), start, after), some in open_cells.items():  # as many as hot texts at edges
            step = max(1, -(-(hi - lo + 1) // PROBES))
            place = F.floor((F.col("id").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)"))
                            / F.lit(step).cast("decimal(20,0)")).cast("bigint") if step > 1 else F.col("id") - F.lit(lo)
            got = (keyed.filter((F.col("h") == h) & F.col("id").between(lo, hi))
                   .groupBy(place.alias("c")).agg(*sums).collect())
            cells = [((h, lo + r.c * step, min(hi, lo + (r.c + 1) * step - 1)), r.b, r.n) for r in got]
            file(some, _edges(cells, start, after, lambda c: (c[0], c[1])), cells, force=step == 1)
    return cuts, parts


def range_of(cuts: list[Cut]):
    """Pandas UDF: number of the range of (hash, id)."""
    keys = sorted(c.key for c in cuts)
    at_end = sum(k[0] >= 1 << 63 for k in keys)
    keys = keys[:len(keys) - at_end]
    hashes = np.array([k[0] for k in keys], np.int64)
    ids = np.array([k[1] for k in keys], np.int64)

    @F.pandas_udf("int")
    def number(h: pd.Series, i: pd.Series) -> pd.Series:
        h, i = h.to_numpy(np.int64), i.to_numpy(np.int64)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for first in np.unique(low[low < high]):  # hashes that a splitter lies on
            rows = np.flatnonzero((low == first) & (high > first))
            last = high[rows[0]]
            low[rows] = first + np.searchsorted(ids[first:last], i[rows], "right")
        return pd.Series(low.astype(np.int32))

    return number


def histogram_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                     tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES,
                     size: Column | None = None) -> DataFrame:
    """``docs``, all columns, with ``size``, ``shard`` and ``slot`` (gapless from
    0 in each shard, in key order), moved so that a range lies in one partition."""
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES if size is None else size
    docs = without(docs, ["size", "shard", "slot"])
    names = docs.columns
    h, i, number, start = free_names(docs, "__h", "__i", "__range", "__offset")
    docs = docs.withColumns({"size": size.cast("bigint"), h: F.xxhash64(text),
                             i: F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOWEST))})
    keyed = written(docs.select(F.col(h).alias("h"), F.col(i).alias("id"), "size"), "shard-keys")
    cuts, parts = splitters(keyed, shards, tolerance, range_bytes)
    cuts.sort(key=lambda c: c.key)
    below = [0] + [c.rows for c in cuts]
    offsets = [below[k] - below[k - k % parts] for k in range(len(below))]
    # one offset a range, so as many as 256 MB blocks of the data; parts == 1: all zero
    offset = F.lit(0) if not any(offsets) else F.element_at(F.array(*map(F.lit, offsets)), F.col(number) + 1) \
        if len(offsets) <= 512 else None
    # by number, not by its hash: each range is a partition of its own
    moved = docs.withColumn(number, range_of(cuts)(h, i)).repartitionById(shards * parts, F.col(number))
    if offset is None:
        table = docs.sparkSession.createDataFrame(list(enumerate(offsets)), f"{number} int, {start} bigint")
        moved, offset = moved.join(F.broadcast(table), number), F.col(start)
    place = F.row_number().over(Window.partitionBy(number).orderBy(h, i))
    out = moved.withColumns({"shard": F.expr(f"cast({number} div {parts} as int)"),
                             "slot": (place - 1 + offset).cast("bigint")})
    return out.select(*[F.col(f"`{c}`") for c in names], "size", "shard", "slot")


def op4_histogram_shards(docs: DataFrame) -> DataFrame:
    out = histogram_shards(docs)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
