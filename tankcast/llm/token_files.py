"""Token-ID / binary output (operator 8): directly addressable codes.

An id is split into chunks of eight bits.  Level 0 holds every id's lowest
chunk; a continuation bitmap says which ids go on, and level 1 holds the next
chunk of just those, and so on.  A rank directory (bits set before each block of
512) finds an id's place on the next level, so any token is read from a few
bytes of each level, without decoding its neighbours.

A file is a Parquet table written by Spark's own committer (so lost executors
leave no half files) with one row per segment of up to ``SEGMENT`` tokens:
part, segment, first token, tokens, payload, and the documents that end in it
with their end, the least and greatest of these ids, and where the first of these
documents begins.  Parts follow the document ids; there are as many as the text's
bytes ask for.  Payloads are not compressed again, so that few bytes are read.

Payload, little-endian: magic ``DAC1``, uint32 number of levels; per level
uint32 entries, the chunks (one byte each), the bitmap (bit k of byte j: entry
8j + k; padded to whole bytes), and uint32 ranks, one per started block of 512
bits.

Defined cases: a null or empty text has the end id alone.  Documents with the
same id follow each other in any order; a null id comes first.  Repeated rows
are written as often as they come.  An empty table gives a file without rows.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankcast.llm.common import ship_package
from tankcast.session import checkpoint_dir

MAGIC = b"DAC1"
SEGMENT = 1 << 16
RANK_BITS = 512
END_ID = 1
#: Text encoded at a time, in bytes (or one document).
TAKEN = 4 << 20
#: Longest stretch, in characters, that a worker remembers, and how many: it
#: keeps the newest so many, and those before until as many newer ones came.
SHORT, REMEMBERED = 48, 500_000
#: Stretches given to the library in one text, and marks to set between them.
JOINED, SEPARATORS = 256, "♥★☆✔♪●"
#: The normalizer and the splitting of the vocabulary of words,
#: and the same splitting for lowered ASCII.
RULES = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
SCHEMA = ("part int, segment int, first long, tokens long, payload binary, low long, high long, opened long, "
          "doc_ids array<long>, doc_ends array<long>")
#: Text of a part at most, in bytes, ids being even.
PART_BYTES = 32 << 20


def pack(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, np.uint32)
        padded[:len(more)] = more
        per_block = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
        ranks = np.cumsum(per_block, dtype=np.uint32) - per_block
        levels.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes()
                      + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Reader:
    """Random and whole access to one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC1 payload")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", payload, 4)[0]):
            n = struct.unpack_from("<I", payload, at)[0]
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            at += 4 + n
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-n // RANK_BITS), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token ``i``, from one chunk, one bit and one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * depth)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8:(i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(inside[:i - block * RANK_BITS].sum())
        return value

    def all(self) -> np.ndarray:
        out = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                value[more] |= out << np.uint32(8)
            out = value
        return out


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The tokenizers library's ids of whole texts, remembering words.

    A token of a vocabulary that drops white space never spans a blank, so a
    text's ids are those of its stretches between white space, and each
    different stretch is encoded once.  Where the tokenizer's rules are ``RULES``,
    printable ASCII stretches are lowered and split into the rules' words, which
    the library's model encodes.  Texts with a special
    token in them go to the library whole; ``whole`` sends all of them there, for
    vocabularies with tokens across blanks."""

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model, self.whole = Tokenizer.from_file(path), whole
        rules = json.loads(self.model.to_str())
        self.ruled = [rules["normalizer"], rules["pre_tokenizer"]] == RULES
        self.special = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        alone = [(c, self.library([c])[0]) for c in SEPARATORS]
        self.marks = [(c, ids[0]) for c, ids in alone if len(ids) == 1]

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def remembered(self, word: str) -> bytes | None:
        ids = self.recent.get(word)
        if ids is None and (ids := self.older.get(word)) is not None:
            self.remember(word, ids)
        return ids

    def remember(self, word: str, ids: bytes) -> None:
        if len(word) <= SHORT:
            if len(self.recent) >= REMEMBERED:
                self.recent, self.older = {}, self.recent
            self.recent[word] = ids

    def ruled_ids(self, stretch: str) -> bytes:
        """Of a printable ASCII stretch."""
        out = []
        for word in WORD.findall(stretch.lower()):
            ids = self.remembered(word)
            if ids is None:
                ids = np.array([t.id for t in self.model.model.tokenize(word)], np.uint32).tobytes()
                self.remember(word, ids)
            out.append(ids)
        return b"".join(out)

    def library_ids(self, stretches: list[str]) -> list[bytes]:
        """Of stretches, some hundreds in one text, between marks met in none."""
        out: list[bytes] = []
        for lo in range(0, len(stretches), JOINED):
            some = stretches[lo:lo + JOINED]
            text = " ".join(some)
            mark = next(((c, i) for c, i in self.marks if c not in text), None)
            if mark is None:
                out += [np.array(ids, np.uint32).tobytes() for ids in self.library(some)]
                continue
            ids = np.array(self.library([f" {mark[0]} ".join(some)])[0], np.uint32)
            cuts = np.flatnonzero(ids == mark[1])
            out += [ids[a:b].tobytes() for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)])]
        return out

    def stretch_ids(self, stretches: list[str]) -> list[bytes]:
        out = [self.remembered(w) for w in stretches]
        left = []
        for k, w in enumerate(stretches):
            if out[k] is not None:
                continue
            if self.ruled and w.isascii() and w.isprintable():
                out[k] = self.ruled_ids(w)
                self.remember(w, out[k])
            else:
                left.append(k)
        for k, ids in zip(left, self.library_ids([stretches[k] for k in left])):
            out[k] = ids
            self.remember(stretches[k], ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text ends."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        apart = np.full(len(texts), self.whole)
        for content in self.special:
            apart |= pc.match_substring(low, content).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "", texts))
        coded = split.flatten().dictionary_encode()
        known = self.stretch_ids(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        # ids of every stretch, gathered from the different ones
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(known), np.uint32)
        done = np.concatenate([[0], np.cumsum(size[at])])
        ids = flat[np.repeat(begin[at] - done[:-1], size[at]) + np.arange(done[-1])]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        ends = done[offsets[1:]]
        if apart.any():
            pieces = np.split(ids, ends[:-1]) if len(ends) else []
            where = np.flatnonzero(apart)
            for k, own in zip(where, self.library(texts.take(pa.array(where)).to_pylist())):
                pieces[k] = np.array(own, np.uint32)
            ids, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        return ids, ends


@functools.lru_cache(1)
def encoder(path: str, whole: bool) -> Encoder:
    """One a Python worker: what it remembers serves its later tasks too."""
    return Encoder(path, whole)


def slices(batch: pa.RecordBatch):
    """Of about ``TAKEN`` bytes of text, or one document."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TAKEN, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = END_ID, parts: int | None = None,
                 whole: bool = False) -> None:
    """Write the documents' tokens, in ascending id order, below ``path``."""
    spark = docs.sparkSession
    ship_package(spark)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))
            .repartitionByRange(parts, "id").sortWithinPartitions("id"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        model = encoder(tokenizer or default_tokenizer(), whole)
        part, segment, first, at, opened = TaskContext.get().partitionId(), 0, 0, 0, 0
        held = np.empty(0, np.uint32)
        ids: list[int | None] = []
        ends: list[int] = []

        def take(tokens):
            """A row of the next ``tokens``."""
            nonlocal segment, first, ids, ends, opened
            inside = bisect.bisect_right(ends, first + len(tokens))
            known = [i for i in ids[:inside] if i is not None] or [None]
            row = [[part], [segment], [first], [len(tokens)], [pack(tokens)], [known[0]], [known[-1]], [opened],
                   [ids[:inside]], [ends[:inside]]]
            opened = ends[inside - 1] if inside else opened
            ids, ends = ids[inside:], ends[inside:]
            segment, first = segment + 1, first + len(tokens)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(),
                 pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for some in slices(batch):
                tokens, stops = model.encode(some.column(1))
                tokens = np.insert(tokens, stops, end_id)
                ids += some.column(0).to_pylist()
                ends += (at + stops + np.arange(1, len(stops) + 1)).tolist()
                at += len(tokens)
                held = np.concatenate([held, tokens])
                whole_ones = len(held) // SEGMENT * SEGMENT
                for lo in range(0, whole_ones, SEGMENT):
                    yield take(held[lo:lo + SEGMENT])
                held = held[whole_ones:].copy()
        if len(held):
            yield take(held)

    rows.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it.  A part's segments are
    streamed in order; only a sum per part meets in one place."""
    files = spark.read.schema(SCHEMA).parquet(path)
    base = (files.groupBy("part").agg(F.sum("tokens").alias("n"))
            .withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n"))
    parts = (files.agg(F.max("part")).first()[0] or 0) + 1
    ship_package(spark)

    def run(batches):
        part, crc, start = None, 0, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for p, first, payload, ids, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, crc, start = p, 0, 0
                tokens, at = Reader(payload).all().astype("<u4"), first
                for i, end in zip(ids, ends):
                    crc = zlib.crc32(tokens[at - first:end - first].tobytes(), crc)
                    for column, v in zip(out, (p, i, start, end - start, crc)):
                        column.append(v)
                    crc, start, at = 0, end, end
                crc = zlib.crc32(tokens[at - first:].tobytes(), crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), *(pa.array(v, pa.int64()) for v in out[1:])],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = (files.select("part", "segment", "first", "payload", "doc_ids", "doc_ends")
            .repartitionById(parts, "part").sortWithinPartitions("part", "segment").drop("segment")
            .mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"))
    return docs.join(base, "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_of(spark: SparkSession, path: str, doc_id: int, place: int) -> int:
    """One token of a document (of the first, if several have the id).  The row
    where it ends is found by its least and greatest id, which Parquet keeps
    statistics of; it tells where the document begins."""
    row = (spark.read.schema(SCHEMA).parquet(path)
           .filter((F.col("low") <= doc_id) & (F.col("high") >= doc_id) & F.array_contains("doc_ids", doc_id))
           .orderBy("part", "segment").select("part", "opened", "doc_ids", "doc_ends").first())
    if row is None:
        raise KeyError(doc_id)
    at = row.doc_ids.index(doc_id)
    begin = row.doc_ends[at - 1] if at else row.opened
    if not 0 <= place < row.doc_ends[at] - begin:
        raise IndexError(place)
    return token_at(spark, path, row.part, begin + place)


def token_at(spark: SparkSession, path: str, part: int, place: int) -> int:
    """One token of a part, from its segment alone."""
    row = (spark.read.schema(SCHEMA).parquet(path)
           .filter((F.col("part") == part) & (F.col("segment") == place // SEGMENT)).select("payload").first())
    if row is None:
        raise IndexError(place)
    return Reader(row.payload)[place % SEGMENT]


def op8_token_files(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(spark, path)
