"""Left as-of join: each left row gets the newest right row at or before it.

Spark's public DataFrame API has no as-of join.  It is expressed as a union of
both sides ordered by (time, side, id) and a segmented "last non-null" scan
(``segmented.asof_fill``): linear in the input, one shuffle of the data, no
row explosion, no range join, and no whole key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.operators.segmented import DEFAULT_SEGMENT, asof_fill

_SIDE = "__side"
_RID = "__rid"
_RVAL = "__right"


def asof_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], ts: str,
                   right_cols: Sequence[str], left_id: str, right_id: str,
                   found_col: str | None = None, defaults: dict | None = None,
                   right_ts_name: str | None = None,
                   segment: str = DEFAULT_SEGMENT,
                   left_cover: DataFrame | None = None) -> DataFrame:
    """``left`` rows with ``right_cols`` of the newest ``right`` row having the
    same ``on`` keys and ``right.ts <= left.ts``.  A right row with the same
    time counts as current.  Ties on time are broken by the right id.  Every
    left row comes out once: one without a time matches nothing, nor does a
    right row without a time; a null key matches a null key.

    ``defaults`` maps right columns to values used when no right row exists;
    ``found_col`` names a boolean telling whether one did.

    ``left_cover`` (with the ``on`` keys and ``ts``) may name cheaper rows
    whose (key, time segment) set covers every left row's -- e.g. the raw
    readings under a window aggregate that produced ``left``.  The segment
    summary then reads it instead of recomputing ``left``.
    """
    on = list(on)
    right_cols = list(right_cols)
    lcols = left.columns
    # one unioned row shape: left columns, side, a right-row struct
    payload = F.struct(*[F.col(c) for c in right_cols],
                       *([F.col(ts).alias("__rts")] if right_ts_name else []))
    r = right.filter(F.col(ts).isNotNull()).select(
        *[F.col(c) for c in on], F.col(ts),
        *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols if c not in on and c != ts],
        F.lit(0).alias(_SIDE), F.col(right_id).cast("bigint").alias(_RID), payload.alias(_RVAL))
    l = left.select(
        *[F.col(c) for c in on], F.col(ts),
        *[F.col(c) for c in lcols if c not in on and c != ts],
        F.lit(1).alias(_SIDE), F.col(left_id).cast("bigint").alias(_RID),
        F.lit(None).cast(_payload_type(right, right_cols, ts, right_ts_name)).alias(_RVAL))
    both = l.unionByName(r)
    cover = None
    if left_cover is not None:
        marks = left_cover.select(
            *[F.col(c) for c in on], F.col(ts),
            *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols if c not in on and c != ts],
            F.lit(1).alias(_SIDE), F.lit(None).cast("bigint").alias(_RID),
            F.lit(None).cast(_payload_type(right, right_cols, ts, right_ts_name)).alias(_RVAL))
        cover = marks.unionByName(r)
    filled = asof_fill(both, keys=on, order=[ts, _SIDE, _RID], fills={"__m": _RVAL},
                       segment=segment, cover=cover)
    out = filled.filter(F.col(_SIDE) == 1)
    defaults = defaults or {}
    sel = [F.col(c) for c in lcols]
    for c in right_cols:
        v = F.col(f"__m.{c}")
        sel.append((F.coalesce(v, F.lit(defaults[c])) if c in defaults else v).alias(c))
    if right_ts_name:
        sel.append(F.col("__m.__rts").alias(right_ts_name))
    if found_col:
        sel.append(F.col("__m").isNotNull().alias(found_col))
    return out.select(*sel)


def _payload_type(right: DataFrame, right_cols: Sequence[str], ts: str,
                  right_ts_name: str | None) -> T.StructType:
    """Type of the struct that carries a right row through the union."""
    fields = [T.StructField(c, right.schema[c].dataType, True) for c in right_cols]
    if right_ts_name:
        fields.append(T.StructField("__rts", right.schema[ts].dataType, True))
    return T.StructType(fields)
