"""Minimum-interval sampling -- keep a reading only if more than
``interval`` has passed since the last kept one (greedy, first row kept).

The rule is sequential per device, yet a device may hold a third of all rows.
The series is cut into time segments at least one interval long, and:

1. per (device, segment) -- one group per segment -- every row gets a pointer
   to the first row more than ``interval`` later; following pointers from a
   start row gives the last row kept in the segment.  Only rows in the first
   ``interval`` of a segment can be the first kept row, so the segment is
   summarised by those "head" times and the exit time reached from each;
2. a summary is a map from the entry time to the exit time.  ``fan`` segments
   in a row are composed into one such map per (device, block), which has no
   more pieces than the block's first segment has head rows: after a second
   segment every state is known.  A fold over a device's blocks gives each
   block's entry, and a fold over a block's segments, from there, each
   segment's.  So a device's segments are dealt over tasks by block, and the
   fold per device sees one map a block;
3. per (device, segment) again, the rows are walked from that entry and the
   kept rows are emitted.

A state older than one segment can never block a row, which is why a segment
only depends on its predecessor's exit time.  All folds stream sorted maps and
hold one at a time.  The rows are clustered by (device, segment) once; steps 1
and 3 both read that layout, so the data is shuffled a single time (AQE reuses
the exchange).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankcast.operators.grouped import cluster, scan_sorted
from tankcast.operators.windows import _seconds
from tankcast.session import ship_package

SEG = "__seg"
BLOCK = "__block"
#: Segments that are composed into one block.
FAN = 256


def _micros(s: pd.Series) -> np.ndarray:
    return s.values.astype("datetime64[us]").astype("int64")


def _next_pointers(t: np.ndarray, iv: int) -> np.ndarray:
    """nxt[i] = first index j with t[j] > t[i] + iv (len(t) when none)."""
    return np.searchsorted(t, t + iv, side="right")


def _last_reached(nxt: np.ndarray) -> np.ndarray:
    """last[i] = final index reached by following nxt from i inside the segment."""
    n = len(nxt)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    return last


def greedy_reference(t: Sequence[int], iv: int, entry: int | None = None) -> list[int]:
    """Plain sequential rule, used by tests as the brute-force check."""
    out, last = [], entry
    for i, x in enumerate(t):
        if last is None or x - last > iv:
            out.append(i)
            last = x
    return out


def _group_layout(pdf: pd.DataFrame, group_cols: list[str]):
    """Group codes, start/end row of each row's group, for a frame sorted by
    the group columns."""
    n = len(pdf)
    if n == 0:
        z = np.zeros(0, dtype="int64")
        return z, z, z
    key = pdf[group_cols]
    change = np.ones(n, dtype=bool)
    change[1:] = (key.iloc[1:].values != key.iloc[:-1].values).any(axis=1)
    gid = np.cumsum(change) - 1
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    return gid, starts[gid], ends[gid]


def _batch_next(t_rel: np.ndarray, gid: np.ndarray, end: np.ndarray, iv: int, span: int):
    """Next pointers for many groups at once: times are offset per group so a
    single searchsorted never crosses a group boundary."""
    key = gid.astype("int64") * (span + iv + 1) + t_rel
    nxt = np.searchsorted(key, key + iv, side="right")
    return np.where(nxt < end, nxt, -1)


def _terminal(nxt: np.ndarray) -> np.ndarray:
    """Row reached at the end of the pointer chain from each row (doubling)."""
    idx = np.arange(len(nxt))
    ptr = np.where(nxt >= 0, nxt, idx)
    while True:
        new = ptr[ptr]
        if np.array_equal(new, ptr):
            return ptr
        ptr = new


def _whole_groups(batches: Iterable[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """The sorted batches as frames that cut no group of ``cols``."""
    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if pdf.empty:
            continue
        gid, _, _ = _group_layout(pdf, cols)
        last = gid == gid[-1]
        carry, done = pdf[last].reset_index(drop=True), pdf[~last].reset_index(drop=True)
        if len(done):
            yield done
    if carry is not None and len(carry):
        yield carry


def _maps(pdf: pd.DataFrame, cols: list[str], within: list[str]):
    """Each map of a frame of whole maps (groups of ``cols``): its first row, the
    ``within`` columns, head times, and per number of heads that the entry blocks
    the exit time and whether there is one (else the entry goes through)."""
    gid, _, end = _group_layout(pdf, cols)
    firsts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    names = pdf.iloc[firsts][within].itertuples(index=False, name=None)
    known = pdf["exit_ts"].notna().to_numpy()
    head = pdf["head_ts"].astype("Int64").to_numpy(dtype="int64", na_value=0)
    exit_ = pdf["exit_ts"].astype("Int64").to_numpy(dtype="int64", na_value=0)
    for a, name in zip(firsts, names, strict=True):
        b = end[a]
        yield a, name, head[a:b - 1], exit_[a:b], known[a:b]


def _compose(batches: Iterable[pd.DataFrame], cols: list[str], within: list[str], iv: int) -> Iterator[pd.DataFrame]:
    """One map per ``within`` from its maps (groups of ``cols``) in order."""
    def frame(done):
        sizes = [len(exits) for _, _, exits, _ in done]
        out = pd.DataFrame([name for name, *_ in done], columns=within)
        out = out.loc[np.repeat(np.arange(len(done)), sizes)].reset_index(drop=True)
        pos = np.concatenate([np.arange(n) for n in sizes])
        # the last piece stands for "after every head row"
        head = np.concatenate([np.append(heads, 0) for _, heads, _, _ in done])
        out["head_ts"] = pd.arrays.IntegerArray(head, pos == np.repeat(sizes, sizes) - 1)
        out["exit_ts"] = pd.arrays.IntegerArray(np.concatenate([exits for _, _, exits, _ in done]),
                                                ~np.concatenate([known for *_, known in done]))
        out["pos"] = pos
        return out

    block = None
    for pdf in _whole_groups(batches, cols):
        done = []
        for _, name, h, x, k in _maps(pdf, cols, within):
            if block is None or name != block[0]:
                if block is not None:
                    done.append(block)
                block = name, h, x, k
                continue
            _, heads, exits, known = block
            at = h.searchsorted(exits + iv, side="right")
            if not known[-1]:  # such an entry went through the maps before: it ended over an interval ago
                at[-1] = 0
            block = name, heads, x[at] if k[-1] else np.where(k[at], x[at], exits), known | k[at]
        if done:
            yield frame(done)
    if block is not None:
        yield frame([block])


def _entries(batches: Iterable[pd.DataFrame], cols: list[str], within: list[str], iv: int,
             start: str | None = None) -> Iterator[pd.DataFrame]:
    """``entry_us`` of every map (group of ``cols``), folded in order; each
    ``within`` starts at its ``start`` column, or with nothing kept yet."""
    name = entry = None
    for pdf in _whole_groups(batches, cols):
        rows, found = [], []
        for a, key, h, x, k in _maps(pdf, cols, within):
            if key != name:
                name = key
                begin = None if start is None else pdf[start].iloc[a]
                entry = None if pd.isna(begin) else int(begin)
            rows.append(a)
            found.append(entry)
            at = 0 if entry is None else h.searchsorted(entry + iv, side="right")
            if k[at]:
                entry = int(x[at])
        out = pdf.iloc[rows][cols].reset_index(drop=True)
        out["entry_us"] = pd.array(found, dtype="Int64")
        yield out


def min_interval_sample(df: DataFrame, keys: Sequence[str], ts: str, id_col: str,
                        interval: str = "5 seconds", segment: str = "1 hour", fan: int = FAN) -> DataFrame:
    """Rows at least ``interval`` after the row kept before, per key.  A row
    without a time follows none, so it stays.  ``fan`` segments are one block."""
    keys = list(keys)
    iv = _seconds(interval) * 1_000_000
    span = _seconds(segment) * 1_000_000
    if span < iv:
        raise ValueError("segment must be at least one interval long")
    cols = df.columns
    gcols = [*keys, SEG]
    d = df.withColumn(SEG, F.window(F.col(ts), segment).start)
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in gcols)

    def rel_times(pdf):
        return _micros(pdf[ts]) - _micros(pdf[SEG])

    # 1. per segment: head times and the exit time reached from each head
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        gid, start, end = _group_layout(pdf, gcols)
        t_rel = rel_times(pdf)
        term = _terminal(_batch_next(t_rel, gid, end, iv, span))
        t_abs = _micros(pdf[ts])
        pos = np.arange(len(pdf)) - start
        is_head = t_rel <= iv
        # rows: one per head row (head_ts, exit from it) ...
        heads = pdf.loc[is_head, gcols].copy()
        heads["head_ts"] = t_abs[is_head]
        heads["exit_ts"] = t_abs[term[is_head]]
        heads["pos"] = pos[is_head]
        # ... plus one per segment for "start after every head row"
        first = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
        n_heads = np.bincount(gid, weights=is_head.astype(float)).astype("int64")
        after = start[first] + n_heads
        has = after < end[first]
        tail = pdf.iloc[first][gcols].copy()
        tail["head_ts"] = pd.array([None] * len(first), dtype="Int64")
        tail["exit_ts"] = pd.array(np.where(has, t_abs[term[np.minimum(after, len(pdf) - 1)]], 0),
                                   dtype="Int64")
        tail.loc[~has, "exit_ts"] = pd.NA
        tail["pos"] = n_heads
        return pd.concat([heads, tail], ignore_index=True)

    # the rows are clustered once; the summary pass and the walk both read
    # this layout, so the data is shuffled a single time
    dp = cluster(d, gcols, [ts, id_col])
    summaries = scan_sorted(dp, gcols, summarise,
                            f"{key_ddl}, head_ts bigint, exit_ts bigint, pos bigint",
                            whole_batches=True)

    # 2. the entry state of every segment: segments are composed into blocks,
    # blocks folded per device, segments per block from the block's entry
    bcols = [*keys, BLOCK]
    block_ddl = ", ".join(f"{k} {types[k]}" for k in keys) + f", {BLOCK} {types[SEG]}"
    ship_package(summaries.sparkSession)
    # clustered once; both passes over the summaries read this layout
    blocked = summaries.withColumn(BLOCK, F.window(F.col(SEG), f"{span // 1_000_000 * fan} seconds").start)
    sp = cluster(blocked, bcols, [SEG, "pos"])
    blocks = sp.mapInPandas(lambda batches: _compose(batches, gcols, bcols, iv),
                            f"{block_ddl}, head_ts bigint, exit_ts bigint, pos bigint")
    begins = cluster(blocks, keys, [BLOCK, "pos"]).mapInPandas(
        lambda batches: _entries(batches, bcols, keys, iv), f"{block_ddl}, entry_us bigint")
    entry = (sp.join(begins, bcols, "left").sortWithinPartitions(*bcols, SEG, "pos")
             .mapInPandas(lambda batches: _entries(batches, gcols, bcols, iv, "entry_us"),
                          f"{key_ddl}, entry_us bigint"))

    # 3. walk every segment from its entry and keep the sampled rows
    out_schema = d.select(*cols).schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gid, start, end = _group_layout(pdf, gcols)
        t_rel = rel_times(pdf)
        nxt = _batch_next(t_rel, gid, end, iv, span)
        first = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
        ent = pdf["entry_us"].values[first]
        key = gid.astype("int64") * (span + iv + 1) + t_rel
        seg_us = _micros(pdf[SEG])[first]
        cur = start[first].copy()
        has_e = ~pd.isna(ent)
        if has_e.any():
            e_rel = ent[has_e].astype("int64") - seg_us[has_e]
            # an entry more than one interval before the segment blocks nothing
            probe = gid[first][has_e].astype("int64") * (span + iv + 1) + np.maximum(e_rel + iv, -1)
            cur[has_e] = np.searchsorted(key, probe, side="right")
        cur = np.where(cur < end[first], cur, -1)
        take = np.zeros(len(pdf), dtype=bool)
        while (cur >= 0).any():
            live = cur[cur >= 0]
            take[live] = True
            cur = np.where(cur >= 0, nxt[np.maximum(cur, 0)], -1)
        return pdf.loc[take, cols]

    # dp is hash-partitioned on gcols and sorted: a broadcast join keeps that
    # layout, and a sort-merge join only shuffles the small entry side
    # layout; the optimizer drops sorts under a join, so sort again (locally)
    walked_in = dp.join(entry, gcols, "left").sortWithinPartitions(*gcols, ts, id_col)
    kept = scan_sorted(walked_in, gcols, walk, out_schema, whole_batches=True)
    return kept.unionByName(df.filter(F.col(ts).isNull()))
