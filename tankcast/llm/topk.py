"""Exact top-k search (operator 1): block-at-a-time pruning.

Vectors are rows of integer term weights.  Blocks are ranges of vector ids with
a forward index (their rows) and each term's largest and smallest weight.  For a
query a block's bound is the sum over the terms of its best possible product;
blocks are visited in order of falling bounds, scored through their forward
index, and the rest is skipped once a bound is below the query's k-th score so
far (a bound equal to it is still visited, for ties).

Blocks are gathered in parts of ``PART`` vectors.  Every block of queries
meets every part (a stated query set against all rows, in blocks): a task holds
one part and streams the query blocks through it.  A part sends at most k rows
per query on, and the k best of those are the result.  The parts are searched in
two goes: about the square root of their number first, evenly spread over the
ids.  The k-th best score found there is a bound that each query takes to all
other parts, which skip blocks below it and send on only rows that reach it.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part.  Shorter vectors count as zero in the missing terms.  A
row isn't its own candidate, nor is any other row with the same id.  Rows with
equal ids otherwise count one by one.  A null id takes no part.  Scores are
exact while sums of products stay below 2^63.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankcast.llm.common import ship_package, written

K = 20
LEAST = int(np.iinfo(np.int64).min)
BLOCK, PART, QUERIES = 256, 8192, 256


def top_k_block_order(bounds: np.ndarray) -> np.ndarray:
    return np.argsort(-bounds, axis=1, kind="stable")


class Part:
    """Blocks of candidate vectors held by one task."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        cuts = range(0, len(ids), BLOCK)
        self.ids = [ids[c:c + BLOCK] for c in cuts]
        self.rows = [rows[c:c + BLOCK] for c in cuts]
        self.high = np.stack([r.max(axis=0) for r in self.rows])
        self.low = np.stack([r.min(axis=0) for r in self.rows])
        self.largest = int(np.abs(rows).max(initial=0))

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vector id, score) of the k best candidates of each query
        that score its ``floor`` or more."""
        width = max(queries.shape[1], self.high.shape[1])
        fit = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        # products and sums of doubles are exact below 2^53
        exact = self.largest * int(np.abs(queries).max(initial=0)) * width < 1 << 53
        kind = np.float64 if exact else np.int64
        q = fit(queries).astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = up @ fit(self.high).astype(kind).T + down @ fit(self.low).astype(kind).T
        order, n = top_k_block_order(bounds), len(ids)
        least = LEAST
        best = np.full((n, k), least, np.int64)
        best_id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        for turn in range(bounds.shape[1]):
            block = order[:, turn]
            kth = np.maximum(best[:, -1], floor)
            go = np.flatnonzero((bounds[np.arange(n), block] >= kth) | (kth == least))
            if not len(go):
                break
            for b in np.unique(block[go]):
                who = go[block[go] == b]
                scores = (q[who] @ fit(self.rows[b]).astype(kind).T).astype(np.int64)
                own = ids[who][:, None] == self.ids[b][None, :]
                scores[own] = least
                all_ids = np.concatenate([best_id[who], np.where(own, np.iinfo(np.int64).max, self.ids[b])], axis=1)
                both = np.concatenate([best[who], scores], axis=1)
                pick = np.lexsort((all_ids, -both.astype(np.float64) if exact else ~both), axis=1)[:, :k]
                best[who] = np.take_along_axis(both, pick, 1)
                best_id[who] = np.take_along_axis(all_ids, pick, 1)
        row, col = np.nonzero((best > least) & (best >= floor[:, None]))
        return row, best_id[row, col], best[row, col]


def top_k(vectors: DataFrame, id_col: str, weights_col: str, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row where ``is_query`` holds.

    ``weights_col``: array of bigint weights without nulls."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{weights_col}`").alias("w"),
                          is_query.alias("q")).filter(F.col("id").isNotNull() & (F.size("w") > 0))
    count = rows.count()
    parts = max(1, -(-count // PART))

    def gather(size: int):
        def run(batches):
            ids, held, floors = [], [], []
            # unique in the written blocks, also where parts hold the same ids
            names = itertools.count(TaskContext.get().partitionId() << 32)

            def row():
                width = max(map(len, held))
                m = np.array([w + [0] * (width - len(w)) for w in held], np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array([next(names)], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                     pa.array([m.tobytes()], pa.binary()), pa.array([width], pa.int32()),
                     pa.array([np.array(floors, "<i8").tobytes()], pa.binary())],
                    names=["part", "ids", "m", "width", "floors"])

            for batch in batches:
                for i, w, least in zip(*(c.to_pylist() for c in batch.columns)):
                    ids.append(i)
                    held.append(w)
                    floors.append(least)
                    if len(ids) == size:
                        yield row()
                        ids, held, floors = [], [], []
            if ids:
                yield row()
        return run

    schema = "part long, ids binary, m binary, width int, floors binary"
    none = F.lit(LEAST).alias("floor")
    # ranges of ids: a partition of the range exchange becomes blocks of whole parts
    blocks = (rows.select("id", "w", none).repartitionByRange(parts, "id").sortWithinPartitions("id")
              .mapInArrow(gather(PART), schema))
    blocks = written(blocks.withColumn("kind", F.lit(0)), "blocks")
    # one number for each 8192 vectors comes to the driver
    names = sorted(r.part for r in blocks.select("part").distinct().collect())
    spread = math.isqrt(len(names))
    first = [names[i * len(names) // spread] for i in range(spread)]
    rest = sorted(set(names) - set(first))

    def search(batches):
        at, held = None, None
        for batch in batches:
            out = [[], [], []]
            for p, ids, m, width, floors, kind in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, "<i8")
                m = np.frombuffer(m, np.int64).reshape(-1, width)
                if kind == 0:
                    at, held = p, Part(ids, m)
                elif p == at:
                    row, vec, score = held.search(ids, m, np.frombuffer(floors, "<i8"), k)
                    out[0].append(ids[row])
                    out[1].append(vec)
                    out[2].append(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out],
                names=["query_id", "vec_id", "score"])

    def near(queries: DataFrame, held: DataFrame, chosen: list[int]) -> DataFrame:
        asked = queries.mapInArrow(gather(QUERIES), schema).withColumn("kind", F.lit(1)).withColumn(
            "part", F.explode(F.lit(chosen).cast("array<bigint>")))
        met = held.unionByName(asked).repartition(max(len(chosen), 1), "part").sortWithinPartitions("part", "kind")
        return met.mapInArrow(search, "query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    queries = rows.filter("q").select("id", "w")
    found = near(queries.withColumn("floor", none), blocks.filter(F.col("part").isin(first)), first)
    if rest:
        found = written(found, "first_parts")
        kth = ranked(found).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        bounded = queries.join(kth, "id", "left").select("id", "w", F.coalesce("floor", F.lit(LEAST)).alias("floor"))
        found = found.unionByName(near(bounded, blocks.filter(~F.col("part").isin(first)), rest))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def op1_top_k(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    weights = F.transform(x, lambda v: F.floor(v.cast("double") * 64))
    rows = embeddings.filter(fine).select("vec_id", weights.alias("w"))
    return top_k(rows, "vec_id", "w", F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) FOR x IN embedding] AS w
           FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
WHERE rank <= 20
"""
