"""Conversation prefix trie (operator 11) by whole-sequence collapse.

A turn is known by the SHA-256 of its text, its role and its place; a prefix by
its length and the XOR of two 64-bit hashes of each of its turns (two prefixes
of one length agree by chance with probability 2^-128).  XOR needs no order, so a
conversation's prefixes come from running XORs over stretches of it and a sum a
stretch: a very long conversation is no task of its own.

1. Conversations with one whole key collapse into a sequence: its smallest id,
   its weight, and its end list, kept as chunks of ids.
2. Only one member of each sequence is laid out into prefixes, weighted, and
   aggregated per prefix: the nodes.
3. Sequences that a longer one passes through are dropped by an anti-join with
   the inner nodes; the rest are the leaves.
4. A node belongs to the sequence with the smallest id through it.  A sequence
   owns its path from some depth on, so children and each node's own bytes are
   counted once, by depth, in a second aggregate over the same rows.

Work grows with the turns, never with depth squared or pairs.  Rows of a
frequent prefix are combined before they are shuffled, and dealt by a salt where
they must meet their node.

Defined cases: a null role or text is empty.  Turns with the same number (and
repeated rows) all count, in order of role, then SHA-256 of the text; turns of
one conversation with one number, or none, share a stretch.  Rows without
conv_id take no part.  An empty table has no nodes, not even the root.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankcast.llm.common import spread_back, written
from tankcast.session import ship_package

#: Turn numbers of a stretch, and parts that the rows of one prefix are dealt to.
STRETCH, SALTS = 1024, 32
#: Ids of one chunk of an end list.
CHUNK = 1 << 14
HEAD = 8
KEY = ["len", "x1", "x2"]
NODE = ["depth", "x1", "x2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(c, part, turn, role, digest, bytes) of every turn; no texts go further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.expr(f"turn div {STRETCH}"), F.lit(-(1 << 60))).cast("bigint")
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), part.alias("part"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"))


def placed(t: DataFrame) -> DataFrame:
    """``t`` with ``pos``, from 1 within its conversation."""
    sizes = t.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("c", "part", (F.sum("n").over(Window.partitionBy("c").orderBy("part")) - F.col("n")).alias("off"))
    inside = F.row_number().over(Window.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    return t.withColumn("pos", inside).join(before, ["c", "part"]).withColumn("pos", F.col("pos") + F.col("off")).drop("off", "turn")


def rebuilt(conversations: DataFrame, every: int = 5, heads: int = HEAD + 1) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a base: the first ``h`` turns of conversation
    ``c - c % every``, then ``c``'s own after its first ``h``, ``h`` being
    crc32(decimal c) % ``heads``.  Gives the turns, and the ids (``c``)."""
    t = written(placed(turns(conversations)), "turns")
    base = F.col("c") - F.col("c") % every
    own_h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    ids = t.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    head = ids.select("c", base.alias("base"), F.when(base == F.col("c"), F.lit(0)).otherwise(own_h).cast("bigint").alias("h"))
    plan = (head.join(ids.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
            .withColumn("taken", F.least(F.coalesce("n_base", F.lit(0)), "h")).select("c", "base", "h", "taken"))
    kept = (t.join(plan, "c").filter(F.col("pos") > F.col("h"))
            .withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")))
    first = t.filter(F.col("pos") < heads).drop("part").withColumnRenamed("c", "base")
    lent = (first.join(plan.filter("taken > 0"), "base").filter(F.col("pos") <= F.col("h"))
            .withColumn("part", F.lit(-(1 << 61))))
    columns = ["c", "part", "pos", "role", "digest", "bytes"]
    return kept.select(columns).unionByName(lent.select(columns)), ids.select("c")


@dataclass
class Trie:
    """``sequences``: smallest id (``c``), ``len``, key, ``weight``, ``bytes``.
    ``leaves``: those of them that no longer one starts with.  ``ends``: id
    chunks of each sequence's members, ascending by ``lowest``.  ``nodes``: as
    described at ``prefix_trie``."""

    sequences: DataFrame
    leaves: DataFrame
    ends: DataFrame
    nodes: DataFrame


def end_lists(members: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, lowest, ids): each key's ids ``c`` in order, in chunks."""
    rows = members.select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key, "c")
    ship_package(members.sparkSession)
    width = len(key)

    def run(batches):
        now, ids, size = None, [], 0
        out: list[tuple[list[int], list[int]]] = []

        def given():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k[at] for k, _ in out], pa.int64()) for at in range(width)),
                 pa.array([x[0] for _, x in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))],
                names=[*key, "lowest", "ids"])

        for batch in batches:
            for *k, c in zip(*(column.to_pylist() for column in batch.columns[:width + 1])):
                if ids and (k != now or len(ids) == CHUNK):
                    out.append((now, ids))
                    ids, size = [], size + len(ids)
                    if size >= CHUNK:
                        yield given()
                        out, size = [], 0
                now = k
                ids.append(c)
        if ids:
            out.append((now, ids))
        if out:
            yield given()

    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", lowest long, ids array<long>")


def ends_digest(ends: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, ends_sha256): of the decimal ids, comma-joined, a chunk at a time."""
    ship_package(ends.sparkSession)

    def run(batches):
        now, sha = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if k != now:
                    if sha is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids)).encode())
            yield given(out)
        if sha is not None:
            yield given([(*now, sha.hexdigest())])

    def given(out):
        columns = list(zip(*out)) or [()] * (len(key) + 1)
        kinds = [*[pa.int64()] * len(key), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*key, "ends_sha256"])

    rows = ends.repartition(*key).sortWithinPartitions(*key, "lowest").select(*key, "ids")
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def salted(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS))


def prefix_trie(rows: DataFrame, ids: DataFrame) -> Trie:
    """The trie of the conversations ``ids`` (``c``) with turns ``rows`` (c,
    part, pos, role, digest, bytes; ``part`` grows with ``pos``).

    Nodes: ``depth``, ``x1``, ``x2`` (key), ``conv_id`` (smallest member),
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``."""
    marks = [F.xxhash64(F.lit(k), "pos", "role", "digest").alias(f"x{k}") for k in (1, 2)]
    rows = rows.select("c", "part", "pos", "bytes", *marks)
    parts = written(rows.groupBy("c", "part").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("len")), "stretches")
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in (*KEY, "bytes")]
    # 1. collapse
    whole = parts.groupBy("c").agg(F.sum("len").alias("len"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"),
                                   F.sum("bytes").alias("bytes"))
    members = written(ids.join(whole, "c", "left").select("c", *zero), "members")
    sequences = written(members.groupBy(*KEY).agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("weight"), F.max("bytes").alias("bytes")), "sequences")
    # 2. prefixes of one member each
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("c", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("bigint")
    offsets = (parts.join(sequences.select("c", F.col("len").alias("whole"), "weight", F.col("bytes").alias("total")), "c")
               .select("c", "part", "whole", "weight", "total",
                       *[F.coalesce(F.bit_xor(x).over(before), none).alias(f"{x}_before") for x in ("x1", "x2")],
                       F.coalesce(F.sum("bytes").over(before), none).alias("upto")))
    laid = (rows.withColumn("x1", F.bit_xor("x1").over(inside)).withColumn("x2", F.bit_xor("x2").over(inside))
            .withColumn("run", F.sum("bytes").over(inside)).join(offsets, ["c", "part"]))
    path = laid.select(
        "c", "part", F.col("pos").alias("depth"), F.col("x1").bitwiseXOR(F.col("x1_before")).alias("x1"),
        F.col("x2").bitwiseXOR(F.col("x2_before")).alias("x2"), "whole", "weight", "total",
        (F.col("upto") + F.col("run") - F.col("bytes")).alias("above"))  # bytes of the turns before this one
    root = sequences.select("c", F.lit(None).cast("bigint").alias("part"), none.alias("depth"), none.alias("x1"),
                            none.alias("x2"), F.col("len").alias("whole"), "weight", F.col("bytes").alias("total"),
                            none.alias("above"))
    path = written(path.unionByName(root), "prefixes").withColumn("salt", salted(F.col("c")))
    # whose node, and is it passed through
    through = spread_back(path, NODE, "salt", {
        "conv_id": (F.min, F.col("c")), "inner": (F.max, F.col("depth") < F.col("whole"))})
    owned = path.join(through.drop("inner"), [*NODE, "salt"])
    mine = F.col("conv_id") == F.col("c")
    own = owned.groupBy("c").agg(
        F.min(F.when(mine, F.col("depth"))).alias("from"), F.min(F.when(mine, F.col("above"))).alias("from_above"),
        F.max_by(F.when(~mine, F.col("conv_id")), F.when(~mine, F.col("depth"))).alias("up"))
    # 3. leaves
    inner = through.filter("inner").select(F.col("depth").alias("len"), "x1", "x2").distinct()
    leaves = sequences.join(inner, KEY, "left_anti")
    # 4. nodes
    about = written(own.join(leaves.select("c", F.lit(1).alias("leaf")), "c", "left"), "owners")
    stretch = parts.select("c", "part").unionByName(sequences.select("c", F.lit(None).cast("bigint").alias("part")))
    # joined by stretch, so that a long conversation's rows don't meet in one task
    told = (path.withColumn("part", F.coalesce("part", F.lit(-(1 << 62))))
            .join(stretch.withColumn("part", F.coalesce("part", F.lit(-(1 << 62)))).join(about, "c"), ["c", "part"]))
    depth, start = F.col("depth"), F.col("from")
    shared = F.col("weight") * (F.col("total") - F.col("above"))
    once = F.when(start.isNotNull(), F.col("total") - F.greatest("above", "from_above")).otherwise(0)
    child = (depth < F.col("whole")) & (start <= depth + 1)
    parent = F.when(depth > start, F.col("c")).when(depth == start, F.col("up"))
    nodes = told.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
        F.count_if(child).alias("n_children"), F.count("leaf").alias("n_leaves"), F.sum(shared - once).alias("saved_tokens"))
    ends = end_lists(members)
    digest = ends_digest(ends).withColumnRenamed("len", "depth")
    nodes = nodes.join(digest, NODE, "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return Trie(sequences, leaves, ends, nodes)


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*rebuilt(conversations)).nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- crc32 of the decimal id, bit by bit
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
             lambda p, i: xor(p >> 1, (p & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h FROM ids),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS digest,
             strlen(coalesce(text, '')) AS bytes,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT c.c, 0 AS side, t.pos, role, digest, bytes FROM crc c JOIN t ON t.c = c.base AND t.pos <= c.h
      UNION ALL SELECT c.c, 1, t.pos, role, digest, bytes FROM crc c JOIN t ON t.c = c.c AND t.pos > c.h),
n AS (SELECT *, row_number() OVER w AS depth,
             sha256(string_agg(length(role) || ':' || role || digest, ',') OVER w) AS prefix
      FROM r WINDOW w AS (PARTITION BY c ORDER BY side, pos ROWS UNBOUNDED PRECEDING)),
paths AS (SELECT c, depth, prefix, bytes FROM n UNION ALL SELECT c, 0, '', 0 FROM ids),
lens AS (SELECT c, max(depth) AS len FROM paths GROUP BY c),
nodes AS (SELECT p.depth, p.prefix, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
                 bool_and(depth = len) AS leaf,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = len), '')) AS ends_sha256
          FROM paths p JOIN lens USING (c) GROUP BY 1, 2),
up AS (SELECT n.depth, n.prefix, a.depth AS adepth, a.prefix AS aprefix, n.saved, n.leaf
       FROM nodes n JOIN paths a ON a.c = n.conv_id AND a.depth <= n.depth),
sub AS (SELECT adepth AS depth, aprefix AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves,
               count(*) FILTER (WHERE up.depth = adepth + 1) AS n_children FROM up GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, pn.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sub s USING (depth, prefix)
LEFT JOIN paths a ON a.c = n.conv_id AND a.depth = n.depth - 1
LEFT JOIN nodes pn ON pn.depth = a.depth AND pn.prefix = a.prefix
"""
