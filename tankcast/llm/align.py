"""Cross-tokenizer alignment (operator 12) by galloping intersection.

Each document is encoded by a byte-level BPE vocabulary (A, of a blank and the
text) and by a SentencePiece model (B, which adds that blank itself).  A file of
the tokenizers library whose merges stand in the order of their ids is run by
tiktoken with the same ids (tested), four times as fast; others by the library.  The
running sums of the tokens' byte lengths are two rising lists of ends.  The
shorter list drives: stretch by stretch, exponential steps and a binary search
find how far the longer list must be looked into, and a binary search in there
finds the common ends.  Their ranks cut both token lists into groups over the
same bytes; the differences of neighbouring ranks are the groups' sizes.  Tokens
that end together are linked.

``align`` works in blocks of whole documents.  A block's different links and how
often each occurs are kept once, and a document's links are places among them,
so that counting links over the corpus shuffles a row a block and link, not a
row an occurrence.

Defined cases: a null or empty text, and one whose tokens do not spell a blank
and the text (``U+2581`` in it, for one), has no tokens.  A very long text is
encoded in stretches cut between a letter and a single blank, where no token of
either vocabulary reaches across (checked when the vocabulary is read).  Rows
with the same id, and repeated rows, are documents of their own.  An empty table
gives an empty table.  Extra columns are not carried.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankcast.llm.common import ship_package, written

#: Text of a block, and text encoded at a time, in characters (or one document).
BLOCK, TAKEN = 1 << 20, 1 << 18
#: Ends of the shorter list that are sought together.
STRETCH = 256
MARK = "▁"
#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
LISTS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
DIGESTS = "n_a long, n_b long, n_groups long, groups_sha256 string"
LINKS = "block long, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"


# --- two vocabularies --------------------------------------------------------------

def byte_level() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write it as."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str | None, path_b: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a or public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or public_tokenizers.path("piece_bpe_32k.model"))
        added, to_byte = self.a.get_added_tokens_decoder(), byte_level()
        spelt = [(self.a.id_to_token(i) or "", i in added) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [t.encode() if special else bytes(to_byte[c] for c in t) for t, special in spelt]
        self.ranked = self.by_rank(added)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = BYTE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode())
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # no token reaches from a letter to a blank behind it
        self.cuttable = not any(re.search("([^\\W_]|\ufffd) ", t.decode("utf-8", "replace"))
                                for table in (self.a_bytes, self.b_bytes) for t in table)
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.most, self.decimal = most, [f"{i}{mark}" for mark in ",|;" for i in range(most)]

    def by_rank(self, added):
        """The same vocabulary for tiktoken, if its ids tell the order of merges."""
        rules = json.loads(self.a.to_str())
        model, split = rules["model"], rules["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and rules["normalizer"] is None and split.get("type") == "ByteLevel"
                 and split.get("use_regex", True) and not split.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "ignore_merges", "byte_fallback")))
        if not plain:
            return None
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(set(merged)):
            return None
        import tiktoken
        return tiktoken.Encoding("ranked", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            t: i for i, t in enumerate(self.a_bytes) if i not in added})

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked:
            return [self.ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in texts]
        return [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.b.encode(texts, num_threads=1)]

    def stretches(self, text: str) -> list[str]:
        """The text, each stretch but the first without the blank before it."""
        if len(text) <= TAKEN or not self.cuttable:
            return [text]
        out, at = [], 0
        while len(text) - at > TAKEN and (cut := CUT.search(text, at + TAKEN)):
            out.append(text[at:cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text; none where they do not spell it."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            if t:
                some = self.stretches(t)
                parts += some
                owner += [k] * len(some)
        ids: list[tuple[list, list]] = [([], []) for _ in texts]
        lo = 0
        while lo < len(parts):
            hi, size = lo + 1, len(parts[lo])
            while hi < len(parts) and size + len(parts[hi]) <= TAKEN:
                size += len(parts[hi])
                hi += 1
            some = parts[lo:hi]
            for k, a, b in zip(owner[lo:hi], self.ids_a([" " + p for p in some]), self.ids_b(some)):
                ids[k][0].append(a)
                ids[k][1].append(b)
            lo = hi
        out, none = ([], []), np.empty(0, np.int32)
        for t, both in zip(texts, ids):
            both = [np.concatenate(x) if x else none for x in both]
            if t:
                whole = (" " + t).encode()
                if any(b"".join(map(table.__getitem__, x.tolist())) != whole
                       for table, x in zip((self.a_bytes, self.b_bytes), both)):
                    both = [none, none]
            for x, column in zip(both, out):
                column.append(x)
        return out


@functools.lru_cache(1)
def vocabularies(path_a: str | None, path_b: str | None) -> Vocabularies:
    return Vocabularies(path_a, path_b)


# --- intersection -------------------------------------------------------------------

def gallop(ends: np.ndarray, at: int, value: int) -> int:
    """First place from ``at`` on whose end is above ``value``."""
    step, lo = 1, at
    while lo + step < len(ends) and ends[lo + step] <= value:
        lo += step
        step *= 2
    return lo + int(np.searchsorted(ends[lo:lo + step + 1], value, "right"))


def common(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two strictly rising lists."""
    in_short, in_long, at = [], [], 0
    for lo in range(0, len(short), STRETCH):
        sought = short[lo:lo + STRETCH]
        stop = gallop(long, at, sought[-1])
        if stop > at:
            place = at + np.searchsorted(long[at:stop], sought)
            hit = np.flatnonzero(long[np.minimum(place, stop - 1)] == sought)
            in_short.append(lo + hit)
            in_long.append(place[hit])
        at = stop
    none = np.empty(0, np.int64)
    return np.concatenate(in_short or [none]), np.concatenate(in_long or [none])


def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the tokens that end together."""
    if len(a_ends) <= len(b_ends):
        return common(a_ends, b_ends)
    b, a = common(b_ends, a_ends)
    return a, b


# --- tables -------------------------------------------------------------------------

def group_digest(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, voc: Vocabularies) -> str:
    """SHA-256 of the groups written `a1,a2|b1;a3|b2,b3`; without tokens empty."""
    if not len(a):
        return ""
    # ids in the order of writing; after A's last of a group goes a bar, after B's a semicolon
    a_code, b_code = a.astype(np.int64), b.astype(np.int64)
    a_code[a_cuts] += voc.most
    b_code[b_cuts] += 2 * voc.most
    out = np.empty(len(a) + len(b), np.int64)
    a_sizes, b_sizes = np.diff(a_cuts, prepend=-1), np.diff(b_cuts, prepend=-1)
    b_done, a_done = np.cumsum(b_sizes), np.cumsum(a_sizes)
    out[np.arange(len(a)) + np.repeat(b_done - b_sizes, a_sizes)] = a_code
    out[np.arange(len(b)) + np.repeat(a_done, b_sizes)] = b_code
    text = "".join(map(voc.decimal.__getitem__, out.tolist()))
    return hashlib.sha256(text[:-1].encode()).hexdigest()


def fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return list(names), [kinds[t] for t in types]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
          path_b: str | None = None, lists: bool = True, digests: bool = False) -> DataFrame:
    """A row a document: ``doc_id``; with ``lists`` its ids by A and B and the
    ranks of the tokens that end each group (group g holds the tokens after rank
    ``cuts[g - 1]`` up to ``cuts[g]``); with ``digests`` their numbers and the
    groups' SHA-256.  ``links`` are the groups' linked ids, as little-endian
    unsigned 32-bit places in the lists ``pair_a``, ``pair_b``, ``pair_n`` (ids of
    a link, its occurrences in the block) in one row of each ``block``.

    Blocks are named by partition and running number: write the result before
    joining on them."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(["doc_id long", *([LISTS] if lists else []), *([DIGESTS] if digests else []), LINKS])
    names, kinds = fields(schema)

    def run(batches):
        voc = vocabularies(path_a, path_b)
        part, number = TaskContext.get().partitionId(), 0

        def block(ids, texts):
            a, b = voc.encode(texts)
            ends = [cuts(np.cumsum(voc.a_size[x]), np.cumsum(voc.b_size[y])) for x, y in zip(a, b)]
            pairs = [x[i].astype(np.int64) << 32 | y[j] for x, y, (i, j) in zip(a, b, ends)]
            different, place, n = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            place, stops = place.astype("<u4"), np.cumsum([len(p) for p in pairs])
            rest = [None] * (len(ids) - 1)
            out = {"doc_id": ids, "block": [part << 33 | number] * len(ids),
                   "links": [p.tobytes() for p in np.split(place, stops[:-1])],
                   "pair_a": [different >> 32, *rest], "pair_b": [different & 0xFFFFFFFF, *rest], "pair_n": [n, *rest]}
            if lists:
                out |= {"a_ids": a, "b_ids": b, "a_cuts": [i for i, _ in ends], "b_cuts": [j for _, j in ends]}
            if digests:
                out |= {"n_a": [len(x) for x in a], "n_b": [len(y) for y in b], "n_groups": [len(i) for i, _ in ends],
                        "groups_sha256": [group_digest(x, y, i, j, voc) for x, y, (i, j) in zip(a, b, ends)]}
            return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds)], names=names)

        ids, texts, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK:
                    yield block(ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block(ids, texts)

    return rows.mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best) of every pair of ids ever linked: its links in all
    documents, and whether no other partner of ``b`` has more."""
    each = aligned.filter(F.col("pair_a").isNotNull()).select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = each.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("count"))
    # an id of B has at most as many partners as A has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def op12_align(docs: DataFrame) -> DataFrame:
    aligned = written(align(docs, lists=False, digests=True), "aligned")
    # of each block, its links' counts, in the order of their places
    places = (aligned.filter(F.col("pair_a").isNotNull())
              .select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "p"))
              .select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")))
    counted = places.join(link_counts(aligned), ["a", "b"]).select("block", "place", "count", "best")
    told = aligned.select("doc_id", *fields(DIGESTS)[0], "block", "links")
    # a block's counts first, then its documents
    both = told.unionByName(counted, allowMissingColumns=True).repartition("block").sortWithinPartitions(
        "block", F.col("place").asc_nulls_last())
    have, schema = both.columns, f"doc_id long, {DIGESTS}, n_links long, n_best long, count_sum long"
    names, kinds = fields(schema)

    def sums(batches):
        block, count, best = None, [], []
        for batch in batches:
            columns = dict(zip(have, batch.columns))
            of, is_count = columns["block"].to_numpy(), columns["place"].is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((of[1:] != of[:-1]) | (is_count[1:] != is_count[:-1])) + 1
            for lo, hi in zip([0, *turns], [*turns, len(of)]):
                here = {n: c.slice(lo, hi - lo) for n, c in columns.items()}
                if of[lo] != block:
                    block, count, best = of[lo], [], []
                if is_count[lo]:
                    count.append(here["count"].to_numpy(zero_copy_only=False))
                    best.append(here["best"].to_numpy(zero_copy_only=False))
                    continue
                count = [np.concatenate([np.empty(0, np.int64), *count])]
                best = [np.concatenate([np.empty(0, bool), *best])]
                links = [np.frombuffer(x, "<u4") for x in here["links"].to_pylist()]
                here |= {"n_links": pa.array([len(x) for x in links], pa.int64()),
                         "n_best": pa.array([int(best[0][x].sum()) for x in links], pa.int64()),
                         "count_sum": pa.array([int(count[0][x].sum()) for x in links], pa.int64())}
                yield pa.RecordBatch.from_arrays([here[n] for n in names], names=names)

    return both.mapInArrow(sums, schema).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                "groups_sha256")
