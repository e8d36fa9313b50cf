"""MinHash near-dedup (operator 3): BagMinHash over bags of word shingles.

A document's bag holds its runs of five words (fewer words: one run) with their
counts.  Its weighted-Jaccard signature comes from Poisson processes over the
discretised weights: the axis of counts is cut into [0,1), [1,2), [2,4), [4,8)
...; every (shingle, interval) has its own process of points (time, register,
place on the axis), seeded by the shingle, so that two bags share the points
below both counts.  Points are drawn in order of time, block of documents by
block, until they come later than every register's minimum; a register keeps
its earliest point with a place below the count.  P(equal registers) is the
weighted Jaccard similarity.

Links: bags in the same band bucket are candidates.  Equal texts are folded
first (one bag stands for all).  Each bucket's member with most bucket mates
is its centre, and every member is held against it.  Candidates whose
signatures agree on too few registers (five standard errors below the
threshold) are dropped; the others' whole bags are compared.  Then components
are formed, and signatures of members of a bucket that are still in different
components are compared inside tasks, tile by tile; pairs that agree are
compared whole there and only links leave the task, so a bucket loses no link
and no group's pairs are written out.  All that remains lossy is the
banding: a pair at 0.8 is missed with probability (1 - 0.8^5)^28, about 1.5e-5.

Defined cases: a text without words (null, empty) is alone in its class.
Repeated ids are one document for linking (any of its texts may link it); each
row is returned.  A null id is ignored for linking and is its own class (null).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.llm.common import add_columns, free_names, ship_package, without, words, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Members of a candidate group that one task compares with a copy of the centre.
GROUP_ROWS = 256
#: Signatures of a bucket that a task holds, twice.
TILE = 2048
#: Share of equal registers below which a pair is dropped unseen.
LEAST = SIMILARITY - 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / REGISTERS)

_U = np.uint64
_G, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def turn(k: int) -> np.uint64:
    return _U(k * int(_G) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def bag(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts."""
    w = words(text)
    if not w:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], _U)
    n = max(1, len(w) - size + 1)
    out = np.full(n, min(len(w), size), _U)
    for k in range(min(len(w), size)):
        out = mix(out * _G + h[k:k + n])
    return np.unique(out, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags."""
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (total - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of each bag: one 64-bit value per register (0 for empty bags)."""
    n = len(bags)
    best = np.full(n * registers, np.inf)
    which = np.zeros(n * registers, _U)
    doc, seed, low, width, count = [], [], [], [], []
    for d, (h, c) in enumerate(bags):
        left, lo, wide = np.arange(len(h)), 0, 1
        while len(left):
            doc.append(np.full(len(left), d))
            seed.append(mix(h[left] + turn(lo + 1)))
            low.append(np.full(len(left), float(lo)))
            width.append(np.full(len(left), float(wide)))
            count.append(c[left].astype(float))
            lo, wide = lo + wide, max(1, lo + wide)
            left = left[c[left] > lo]
    if not doc:
        return np.zeros((n, registers), _U)
    doc, seed, low, width, count = map(np.concatenate, (doc, seed, low, width, count))
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        r1 = mix(seed + turn(3 * step))
        r2 = mix(seed + turn(3 * step + 1))
        time = time - np.log(((r1 >> _U(11)).astype(float) + 1) * 2.0 ** -53) / width
        place = low + width * ((r2 >> _U(32)).astype(float) * 2.0 ** -32)
        at = doc * registers + (r2 & _U(0xFFFFFFFF)).astype(np.int64) % registers
        ok = np.flatnonzero((place < count) & (time < best[at]))
        # in time order, latest first: the earliest is written last and stays
        ok = ok[np.argsort(-time[ok], kind="stable")]
        best[at[ok]] = time[ok]
        which[at[ok]] = mix(r1[ok] ^ seed[ok])
        last = best.reshape(n, registers).max(axis=1)
        go = time < last[doc]
        doc, seed, low, width, count, time = (x[go] for x in (doc, seed, low, width, count, time))
    return which.reshape(n, registers)


def _describe(texts: list) -> list[list]:
    bags = [bag(t) for t in texts]
    sig = signatures(bags)
    bands = np.full((len(texts), BANDS), 1, _U) * np.arange(1, BANDS + 1, dtype=_U)
    for k in range(ROWS):
        bands = mix(bands * _G + sig[:, k::ROWS][:, :BANDS])
    return [[b" ".join(words(t)) and xxhash.xxh3_128_digest(b" ".join(words(t))) for t in texts],
            bands.view(np.int64).tolist(), [row.astype(np.uint16).tobytes() for row in sig]]


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, same, bands, sig) of every row with words: hash of its words, band
    keys, and 16 bits of every register."""
    fields = [T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
              T.StructField("sig", T.BinaryType())]
    ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return add_columns(ids, ["t"], fields, _describe).select("id", *[f.name for f in fields]).filter(
        F.col("id").isNotNull() & (F.length("same") > 0))


def agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out ``SIMILARITY``."""
    def run(batches):
        for x in batches:
            left, right = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                           for k in (2, 3))
            keep = (left == right).mean(axis=1) >= LEAST
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, pairs.select("a", "b").schema)


def linked(members: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket in different classes, from rows
    (id, band, class, n, bands, sig, t); of two classes at least one link.

    A bucket of n members is dealt out as pairs of tiles of about ``TILE`` rows.
    A task compares two tiles' signatures; pairs that agree and share no earlier
    band are compared whole, unless their classes have been linked there already.
    Only links leave the task."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = (members.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
             .select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                     "tile", "id", "class", "bands", "sig", "t")
             .repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"))

    def compare(key, tile, ids, classes, bands, sigs, texts):
        band, i, j = key
        tile, ids, classes, bands = map(np.array, (tile, ids, classes, bands))
        sigs = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(ids), REGISTERS)
        earlier = int(np.flatnonzero(bands[0] == band)[0])
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        bags: dict[int, tuple] = {}
        root: dict[int, int] = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        def whole(k):
            if k not in bags:
                bags[k] = bag(texts[k])
            return bags[k]

        for x in left:
            to = right[(classes[right] != classes[x]) & ((ids[right] > ids[x]) if i == j else True)]
            to = to[(sigs[to] == sigs[x]).mean(axis=1) >= LEAST]
            to = to[~(bands[to, :earlier] == bands[x, :earlier]).any(axis=1)]
            for y in to:
                one, two = find(classes[x]), find(classes[y])
                if one != two and similarity(whole(x), whole(y)) >= SIMILARITY:
                    root[one] = two
                    yield int(ids[x]), int(ids[y])

    def run(batches):
        at, held = None, []
        for x in batches:
            out = []
            for band, i, j, *row in zip(*(c.to_pylist() for c in x.columns)):
                if (band, i, j) != at:
                    out += compare(at, *held) if at else ()
                    at, held = (band, i, j), [[] for _ in row]
                for column, v in zip(held, row):
                    column.append(v)
            yield batch(out)
        if at:
            yield batch(list(compare(at, *held)))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole bags reach ``SIMILARITY``; texts: (id, t).

    ``b`` is the member held by many ``a``: its group is dealt out in parts of
    about ``GROUP_ROWS``, each with a copy of ``b``; a part is streamed, holding
    one bag."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    roles = (dealt.select(F.col("a").alias("id"), "b", "part", F.lit(1).alias("role"))
             .unionByName(sizes.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
                                       .alias("part"), F.lit(0).alias("role"))))
    rows = (roles.hint("merge").join(texts, "id").repartition("b", "part").sortWithinPartitions("b", "part", "role")
            .select("b", "part", "role", "id", "t"))
    ship_package(pairs.sparkSession)

    def run(batches):
        at, held = None, []
        for x in batches:
            a, b = [], []
            for key_b, part, role, i, t in zip(*(c.to_pylist() for c in x.columns)):
                if (key_b, part) != at:
                    at, held = (key_b, part), []
                mine = bag(t)
                if role == 0:
                    held.append(mine)  # more than one only where an id is repeated
                elif any(similarity(mine, h) >= SIMILARITY for h in held):
                    a.append(i)
                    b.append(key_b)
            yield pa.RecordBatch.from_arrays([pa.array(a, x.column(3).type), pa.array(b, x.column(0).type)],
                                             names=["a", "b"])

    return rows.mapInArrow(run, pairs.select("a", "b").schema).distinct()


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, class): smallest id reachable over ``edges`` (a, b), by rounds of
    neighbour minimum and pointer jumping, each written to the shared folder."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
    if labels is not None:  # earlier classes as edges to their smallest id
        both = both.unionByName(labels.select("id", F.col("class").alias("other"))).unionByName(
            labels.select(F.col("class").alias("id"), F.col("id").alias("other")))
    both = written(both.distinct(), "edges")
    now = both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("class"))
    while True:
        now = written(now, "classes")
        near = (both.join(now.select(F.col("id").alias("other"), F.col("class").alias("theirs")), "other")
                .groupBy("id").agg(F.min("theirs").alias("theirs")))
        step = now.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "theirs").alias("class"))
        jump = now.select(F.col("id").alias("class"), F.col("class").alias("further"))
        step = written(step.join(jump, "class").select("id", "was", F.least("class", "further").alias("class")), "step")
        changed = step.filter(F.col("was") != F.col("class")).limit(1).count()
        now = step.select("id", "class")
        if not changed:
            return now


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class) of every id that shares its class with another one; class:
    the smallest id in it."""
    told = written(describe(docs, id_col, text_col), "signatures")
    first = told.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = (told.select("id", "same").join(first.filter("n > 1").drop("n"), "same")
              .filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    reps = told.join(first.select("same", F.col("rep").alias("id")), ["same", "id"], "left_semi")
    reps = written(reps.dropDuplicates(["id", "same"]).select("id", "bands", "sig"), "bags")
    sigs = reps.select("id", "sig")
    rows = reps.select("id", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(full, "band")
    mates = rows.groupBy("id").agg(F.sum("n").alias("mates"))
    rows = written(rows.join(mates, "id").select("id", "band", "mates"), "buckets")
    # whole texts of documents with bucket mates; like the other joins with texts
    # a shuffle at every size, so that what is measured small holds large
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))
    texts = written(texts.join(rows.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    rank = F.struct("mates", (-F.col("id")).alias("minus"))
    centre = rows.groupBy("band").agg((-F.max(rank)["minus"]).alias("b"))
    stars = rows.join(centre, "band").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    found = verify(written(agreement(stars, sigs), "stars"), texts)
    label = components(found.unionByName(copies))
    # bucket members that are still in different classes
    known = rows.select("id", "band").join(label, "id", "left").withColumn("class", F.coalesce("class", "id"))
    spread = (known.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"),
                                        F.max("class").alias("high")).filter("low < high").select("band", "n"))
    known = known.join(spread, "band").hint("merge").join(reps, "id").hint("merge").join(texts, "id")
    more = written(linked(known.select("id", "band", "class", "n", "bands", "sig", "t")), "links")
    return components(more, label) if more.limit(1).count() else label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``class_id`` (the smallest id of the row's class), in place
    of a column of that name; other columns as they were."""
    docs = without(docs, ["class_id"])
    [mine] = free_names(docs, "__id")
    found = classes(docs, id_col, text_col).select(F.col("id").alias(mine), F.col("class").alias("class_id"))
    key = F.col(f"`{id_col}`")
    return docs.join(found, key == F.col(mine), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], F.coalesce("class_id", key).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their class; columns as they were."""
    [mine] = free_names(docs, "__id")
    gone = classes(docs, id_col, text_col).filter("id <> class").select(F.col("id").alias(mine))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(mine), "left_anti")


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id")


def brute_force(texts: dict) -> dict:
    """Classes by comparing all pairs: for tests."""
    bags = {i: bag(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if similarity(bags[i], bags[j]) >= SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}
