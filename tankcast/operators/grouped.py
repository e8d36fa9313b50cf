"""Sorted grouped scan: run a pandas function once per group, many groups per
Arrow batch.

``groupBy(...).applyInPandas`` pays a round trip per group, which dominates
when groups are small and numerous (one per device and time segment).  Here
the rows are hash-partitioned on the group key, sorted within each partition,
and streamed through ``mapInPandas``; the function sees each group whole (a
group cut by a batch boundary is carried into the next batch), so memory is
bounded by the largest group, not by the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from tankcast.session import ship_package


def grouped_scan(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 fn: Callable[[pd.DataFrame], pd.DataFrame], schema,
                 num_partitions: int | None = None, whole_batches: bool = False) -> DataFrame:
    """``fn`` gets one group at a time, or -- with ``whole_batches`` -- a frame
    of several complete groups (still sorted) to process vectorised."""
    return scan_sorted(cluster(df, group_cols, order_cols, num_partitions), group_cols, fn,
                       schema, whole_batches)


def cluster(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
            num_partitions: int | None = None) -> DataFrame:
    """Hash-partition on the group columns and sort each partition by group
    then order: the layout ``scan_sorted`` expects."""
    # without an explicit count AQE sizes the partitions from the data
    part = (df.repartition(num_partitions, *group_cols) if num_partitions
            else df.repartition(*group_cols))
    return part.sortWithinPartitions(*group_cols, *order_cols)


def scan_sorted(df: DataFrame, group_cols: Sequence[str],
                fn: Callable[[pd.DataFrame], pd.DataFrame], schema,
                whole_batches: bool = False) -> DataFrame:
    """Run ``fn`` over the groups of a frame already laid out by ``cluster``
    (or by a join that keeps that layout)."""
    group_cols = list(group_cols)
    ship_package(df.sparkSession)

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None and not carry.empty:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            key = pdf[group_cols]
            last = key.iloc[-1]
            tail = ((key == last) | (key.isna() & last.isna().values)).all(axis=1)
            carry, done = pdf[tail], pdf[~tail]
            if done.empty:
                continue
            if whole_batches:
                out = [fn(done.reset_index(drop=True))]
            else:
                out = [fn(g) for _, g in done.groupby(group_cols, sort=False, dropna=False)]
            out = [o for o in out if o is not None and len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if carry is not None and not carry.empty:
            res = fn(carry.reset_index(drop=True))
            if res is not None and len(res):
                yield res

    return df.mapInPandas(run, schema)
