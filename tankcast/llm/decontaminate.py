"""Benchmark decontamination (operator 2): one Aho-Corasick automaton over the
normalised test items, run once over each normalised text, with every hit mapped
back to word numbers and to character offsets of the original.

A window is ``window`` consecutive words of an item; a shorter item with at
least ``min_words`` words is one window.  The automaton doesn't hold the windows,
which overlap, but anchors: every ``stride``-th run of half a window.  Each window
holds a whole anchor, so a window can lie only around an anchor's occurrence.
There its words are looked up among the items' windows by a 64-bit key and then
compared one by one; what is found doesn't depend on the keys.  An anchor that
many items share costs a few look-ups, however many they are.

The automaton reads two characters a word, taken from a hash of the word: about
two nodes a word of the items.  It is built in each Python worker from the items'
texts, which are broadcast.  Their words and bytes are counted first: beyond
``max_words`` or ``MAX_BYTES`` the items are split by hash into groups that each
fit, and the texts are scanned group by group, hits adding up, so nothing
unbounded is broadcast.  Only a single longer item exceeds the bound.

Defined cases: a null text or item has no words and hits nothing.  A very long
text is scanned whole; memory grows with it, not with the square.  Repeated
items with the same id and text change nothing; rows of ``docs`` are handled one
by one, so repeated ids or rows are no special case.  An empty item table gives
zero hits.  Columns of ``docs`` called like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.llm.common import add_columns, free_names, words, written

WINDOW = 10
#: Words, and bytes of text, of the items held by one automaton: see the README
#: for the memory it takes.
MAX_WORDS = 5_000_000
MAX_BYTES = 64 << 20
# the two characters that stand for a word of a given hash; the first and the
# second have alphabets of their own, so that matches begin and end at words
CODES = [chr(1 + (k >> 6)) + chr(65 + (k & 63)) for k in range(1 << 12)]

# one word of a text that is not lower-cased
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("hit_spans", SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]

_built: dict[str, "Windows | None"] = {}


def coded(tokens) -> str:
    return "".join([CODES[hash(t) & 4095] for t in tokens])


def window_keys(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of the ``size`` words from each place on."""
    key = np.full(len(at), size, np.uint64)
    for j in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j]
    return key


class Windows:
    """The items' windows by key, and the automaton of their anchors."""

    def __init__(self, items: list[tuple[str, str]], window: int, min_words: int):
        vocabulary: dict[bytes, int] = {}
        numbers, first, self.names = array("i"), [0], []
        for item_id, text in items:
            w = words(text)
            if len(w) < max(1, min_words):
                continue
            numbers.extend([vocabulary.setdefault(x, len(vocabulary)) for x in w])
            first.append(len(numbers))
            self.names.append(item_id)
        self.window, self.seq = window, np.array(numbers, np.int32)
        self.words = list(vocabulary)
        del vocabulary, numbers
        if not self.names:
            return
        first = np.array(first, np.int64)
        length = np.diff(first)
        size = np.minimum(window, length)
        self.short = sorted(set(size[size < window].tolist()))
        self._index(first, length, size)
        self._anchors(first, length)

    def _index(self, first: np.ndarray, length: np.ndarray, size: np.ndarray) -> None:
        """Distinct windows, sorted by key: a place of each, and its items."""
        counts = length - size + 1
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        for self.seed in range(64):  # another seed if two different windows get one key
            hashes = np.array([xxhash.xxh3_64_intdigest(w, self.seed) for w in self.words], np.uint64)[self.seq]
            key = np.zeros(len(at), np.uint64)
            for s in np.unique(size).tolist():
                pick = size[owner] == s
                key[pick] = window_keys(hashes, at[pick], s)
            order = np.argsort(key, kind="stable")
            key, place, n = key[order], at[order], size[owner[order]]
            same = np.flatnonzero(key[1:] == key[:-1])
            good = n[same] == n[same + 1]
            for j in range(self.window):
                held = same[good & (n[same] > j)]
                if (self.seq[place[held] + j] != self.seq[place[held + 1] + j]).any():
                    good[:] = False
                    break
            if good.all():
                break
        else:
            raise ValueError("no keys tell the windows apart")
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.key, self.place, self.size = key[head], place[head].astype(np.int32), n[head]
        self.head, self.owner = np.r_[head, len(key)], owner[order]

    def _anchors(self, first: np.ndarray, length: np.ndarray) -> None:
        half = (self.window + 1) // 2
        self.stride = self.window - half + 1
        text = "".join([CODES[hash(w) & 4095] for w in map(self.words.__getitem__, self.seq.tolist())])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for lo, n in zip(first[:-1].tolist(), length.tolist()):
            if n < self.window:
                self.automaton.add_word(text[2 * lo:2 * (lo + min(half, n))])
                continue
            for a in range(lo, lo + n - half + 1, self.stride):
                self.automaton.add_word(text[2 * a:2 * (a + half)])
        self.automaton.make_automaton()

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Closed word ranges inside occurrences, and the items that occur."""
        anchors = {(end + 1 - size) >> 1 for end, size in self.automaton.iter(coded(w))}
        if not anchors:
            return [], set()
        seen = np.array(sorted(anchors), np.int64)
        asked = [(self.window, np.unique(seen[:, None] - np.arange(self.stride)))]
        asked += [(s, seen) for s in self.short]
        hashes, ranges, found = np.zeros(len(w), np.uint64), [], set()
        known = np.zeros(len(w), bool)
        for size, at in asked:
            at = at[(at >= 0) & (at + size <= len(w))]
            new = np.zeros(len(w), bool)
            for j in range(size):
                new[at + j] = True
            for i in np.flatnonzero(new & ~known).tolist():
                hashes[i] = xxhash.xxh3_64_intdigest(w[i], self.seed)
            known |= new
            key = window_keys(hashes, at, size)
            k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = np.flatnonzero((self.key[k] == key) & (self.size[k] == size))
            for i, x in zip(at[hit].tolist(), k[hit].tolist()):
                p = int(self.place[x])
                if w[i:i + size] == [self.words[v] for v in self.seq[p:p + size].tolist()]:
                    ranges.append((i, i + size - 1))
                    found.add(x)
        return merged(ranges), {self.names[o] for x in found
                                for o in self.owner[self.head[x]:self.head[x + 1]].tolist()}


def automaton(items: list[tuple[str, str]], window: int, min_words: int) -> Windows | None:
    built = Windows(items, window, min_words) if items else None
    return built if built and built.names else None


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed word ranges, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, min_words: int = 1,
         max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (word ranges, ends included),
    ``hit_spans`` (offsets into the original text in code points, end excluded)
    and ``hit_items`` (ids as strings, sorted)."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"),
                         F.col(f"`{item_text}`").alias("t")).filter(F.col("t").isNotNull())
    # blanks and punctuation bound the number of words from above
    n_words, n_bytes = items.agg(
        F.sum(F.size(F.split("t", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))), F.sum(F.octet_length("t"))).first()
    groups = max(1, -(-(n_words or 0) // max_words), -(-(n_bytes or 0) // MAX_BYTES))
    for g in range(groups):
        part = items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(groups)) == g) if groups > 1 else items
        held = spark.sparkContext.broadcast([(r.id, r.t) for r in part.collect()])  # at most max_words and MAX_BYTES
        token = uuid.uuid4().hex

        def run(texts, *before, held=held, token=token):
            if token not in _built:
                _built.clear()
                _built[token] = automaton(held.value, window, min_words)
            out: list[list] = [[], [], [], []]
            for k, text in enumerate(texts):
                w = words(text)
                ranges, ids = _built[token].find(w) if w and _built[token] else ([], set())
                if before:
                    ranges = merged(ranges + [(r["first"], r["last"]) for r in before[0][k]])
                    ids = ids | set(before[1][k])
                spans = []
                if ranges:
                    at = [m.span() for m in ORIGINAL_WORD.finditer(text)]
                    spans = [{"start": at[i][0], "end": at[j][1]} for i, j in ranges]
                for column, v in zip(out, (len(w), [{"first": i, "last": j} for i, j in ranges], spans, sorted(ids))):
                    column.append(v)
            return out

        inputs = [text_col] + (["hit_words", "hit_items"] if g else [])
        docs = add_columns(docs, inputs, FIELDS, run)
        if g + 1 < groups:
            docs = written(docs, "decontaminate")
    return docs


def decontaminate(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """The documents without any window of an item; columns as they were,
    whatever their names."""
    own = {f.name for f in FIELDS}
    clash = [c for c in docs.columns if c.lower() in own]
    aside = dict(zip(clash, free_names(docs, *[f"__{c}" for c in clash])))
    found = scan(docs.withColumnsRenamed(aside), items, **params).filter(F.size("hit_words") == 0)
    return found.select([F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def op2_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    hits = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda a, r: a + r["last"] - r["first"] + 1)
    return scan(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """By comparing every window at every place: for tests."""
    out = {}
    for doc, text in texts.items():
        w, hit, ids = words(text), set(), set()
        for item, t in items.items():
            v = words(t)
            size = min(window, len(v))
            if not size:
                continue
            for i in range(len(v) - size + 1):
                for k in range(len(w) - size + 1):
                    if w[k:k + size] == v[i:i + size]:
                        hit |= set(range(k, k + size))
                        ids.add(str(item))
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
            FROM (SELECT *, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k
                  FROM i WHERE len(w) > 0)),
grams AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k
                FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT g.r, g.k, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.s = x.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
