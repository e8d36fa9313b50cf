"""SentencePiece encoding and decoding (operator 7): Unigram Viterbi over a
double-array trie of pieces with log scores.

Pieces and scores come from a SentencePiece model file (its path is a
parameter).  A text gets one blank in front, blanks are the whitespace marker,
and the segmentation with the largest sum of scores is found over the trie's
matches at every place.  A character without a piece of its own costs ten less
than the lowest score and becomes its UTF-8 bytes' pieces.  Ties go to the path
found first: smaller start, then shorter piece.  Decoding joins the pieces'
bytes, turns markers into blanks and takes off the blank in front, so that every
text comes back exactly, a literal marker character too (by its bytes).

No piece may hold a marker after another character (checked on loading), so the
best path of a text is that of its runs "blanks, then no blanks", each solved
alone.  A worker remembers short runs, up to a fixed number.

Defined cases: null and empty texts have no pieces and decode to the empty
text.  Rows are handled one by one: repeated ids and rows are no special case.
Columns called like a result column are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.llm.common import add_columns

MARKER = "▁"
RUN = re.compile(r" +[^ ]*|[^ ]+")
#: Longest run, in characters, that a worker remembers, and how many.
SHORT, REMEMBERED = 48, 300_000
#: Runs solved side by side.
BLOCK = 8192
# bytes of a character by its first byte
CHAR_BYTES = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int64)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def double_array(keys: list[tuple[bytes, int]]) -> tuple[list[int], list[int], list[int]]:
    """(base, check, value) of a trie over bytes: the child of node ``s`` by byte
    ``c`` is ``base[s] + c + 1`` where ``check`` names ``s``; value: id or -1."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in keys:
        at = 0
        for c in key:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = nxt
        ends[at] = value
    size = 4 * len(children) + 1024
    base, check, value, free = [0] * size, [-1] * size, [-1] * size, bytearray(b"\1") * size
    free[0], value[0] = 0, ends[0]
    # where the search for a node with so many children goes on: never back,
    # so that the whole build stays about linear
    start = [0] * 257
    stack = [(0, 0)]
    while stack:
        node, place = stack.pop()
        codes = sorted(children[node])
        if not codes:
            continue
        first, many = codes[0] + 1, len(codes)
        at = max(start[many], 1 - codes[0])
        while True:
            to = free.find(1, at + first)
            if to < 0 or to + 258 > len(free):
                more = len(free)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
                free += bytearray(b"\1") * more
                continue
            at = to - first
            if all([free[at + c + 1] for c in codes]):
                break
            at += 1
        start[many] = at
        base[place] = at
        for c in codes:
            to, child = at + c + 1, children[node][c]
            free[to], check[to], value[to] = 0, place, ends[child]
            stack.append((child, to))
    return base, check, value


class Model:
    """Trie, scores and byte pieces; picklable, so it can be broadcast."""

    def __init__(self, path: str | None = None):
        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        n = sp.get_piece_size()
        self.byte_ids, self.surface, keys = [-1] * 256, [b""] * n, []
        self.scores = [0.0] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                if MARKER in piece.lstrip(MARKER) or " " in piece:
                    raise ValueError(f"piece {piece!r} has a marker after another character")
                self.scores[i] = sp.get_score(i)
                self.surface[i] = piece.replace(MARKER, " ").encode()
                keys.append((self.surface[i], i))
        if -1 in self.byte_ids:
            raise ValueError("the model has no byte fallback")
        self.unknown = min(self.scores[i] for _, i in keys) - 10.0
        self.base, self.check, self.value = (np.array(x, np.int32) for x in double_array(keys))
        self.scores = np.array(self.scores)
        self.runs: dict[str, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"runs": {}}

    def solve(self, runs: list[bytes]) -> list[list[int]]:
        """Piece ids of every run: Viterbi over a block of runs side by side, one
        place after another, each place's matches walked through the trie."""
        n, wide = len(runs), max(map(len, runs))
        # one row a place; the zeros behind a shorter run match no piece
        data = np.frombuffer(b"".join([r.ljust(wide, b"\0") for r in runs]), np.uint8).reshape(n, wide)
        data = np.ascontiguousarray(data.T).astype(np.int32)
        lens = np.array([len(r) for r in runs], np.int32)
        best = np.full((wide + 1, n), -np.inf)
        best[0] = 0.0
        start = np.zeros((wide + 1, n), np.int32)
        piece_at = np.full((wide + 1, n), -1, np.int32)
        char_end = np.zeros(n, np.int32)
        for i in range(wide):
            rows = np.flatnonzero((best[i] > -np.inf) & (lens > i))
            if not len(rows):
                continue
            char_end[rows] = i + CHAR_BYTES[data[i][rows]]
            lone = np.zeros(n, bool)
            lone[rows] = True
            act, node, so_far = rows, 0, best[i][rows]
            for j in range(i, wide):
                to = self.base[node] + data[j][act] + 1
                ok = np.flatnonzero(self.check[to] == node)
                if not len(ok):
                    break
                act, node, so_far = act[ok], to[ok], so_far[ok]
                piece = self.value[node]
                hit = np.flatnonzero(piece >= 0)
                a, piece = act[hit], piece[hit]
                if j < i + 4:
                    lone[a[char_end[a] == j + 1]] = False
                total = so_far[hit] + self.scores[piece]
                up = np.flatnonzero(total > best[j + 1][a])
                a = a[up]
                best[j + 1][a], start[j + 1][a], piece_at[j + 1][a] = total[up], i, piece[up]
            a = np.flatnonzero(lone)
            if len(a):
                total, end = best[i][a] + self.unknown, char_end[a]
                up = total > best[end, a]
                best[end[up], a[up]], start[end[up], a[up]], piece_at[end[up], a[up]] = total[up], i, -1
        start, piece_at = start.T, piece_at.T
        out = []
        for run, came, pieces in zip(runs, start.tolist(), piece_at.tolist()):
            ids, j = [], len(run)
            while j:
                i = came[j]
                if pieces[j] >= 0:
                    ids.append(pieces[j])
                else:
                    ids.extend(self.byte_ids[x] for x in reversed(run[i:j]))
                j = i
            out.append(ids[::-1])
        return out

    def solve_long(self, run: bytes) -> list[int]:
        """As ``solve``, for one run of any length, in time and memory linear in it."""
        n = len(run)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        best, back = np.full(n + 1, -np.inf), np.zeros((n + 1, 2), np.int64)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            node, j, lone, end = 0, i, True, i + int(CHAR_BYTES[run[i]])
            while j < n:
                to = base[node] + run[j] + 1
                if check[to] != node:
                    break
                node, j = to, j + 1
                if value[to] >= 0:
                    lone = lone and j != end
                    if (total := best[i] + scores[value[to]]) > best[j]:
                        best[j], back[j] = total, (i, value[to])
            if lone and (total := best[i] + self.unknown) > best[end]:
                best[end], back[end] = total, (i, -1)
        ids, j = [], n
        while j:
            i, piece = back[j].tolist()
            ids.extend([piece] if piece >= 0 else [self.byte_ids[x] for x in reversed(run[i:j])])
            j = i
        return ids[::-1]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        known = self.runs
        if len(known) > REMEMBERED:
            known.clear()
        split = [RUN.findall(" " + t) if t else [] for t in texts]
        new = sorted({r for runs in split for r in runs if r not in known}, key=len)
        own: dict[str, list[int]] = {}
        while new and len(new[-1]) > SHORT:
            run = new.pop()
            own[run] = self.solve_long(run.encode())
        for lo in range(0, len(new), BLOCK):
            part = new[lo:lo + BLOCK]
            known.update(zip(part, self.solve([r.encode() for r in part])))
        if own:
            return [list(chain.from_iterable([known[r] if r in known else own[r] for r in runs])) for runs in split]
        return [list(chain.from_iterable(map(known.__getitem__, runs))) for runs in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids]).decode("utf-8", "replace")[1:]


@functools.lru_cache(2)
def load(path: str | None = None) -> Model:
    return Model(path)


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids``."""
    held = docs.sparkSession.sparkContext.broadcast(load(model))
    return add_columns(docs, [text_col], [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))],
                       lambda texts: [held.value.encode_all(texts)])


def decode(docs: DataFrame, ids_col: str = "piece_ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``docs`` with the text of its pieces (null or no pieces: empty)."""
    held = docs.sparkSession.sparkContext.broadcast(load(model))
    return add_columns(docs, [ids_col], [T.StructField(out, T.StringType())],
                       lambda ids: [[held.value.decode(x or []) for x in ids]])


def encode_and_check(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids``, ``n_pieces``, ``pieces_crc32`` (ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` and ``lossless``
    (the ids decode to the text), in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(load(model))
    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
              T.StructField("pieces_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType()),
              T.StructField("lossless", T.BooleanType())]

    def run(texts):
        m, out = held.value, [[] for _ in fields]
        for t, ids in zip(texts, m.encode_all(texts)):
            back = m.decode(ids)
            for column, v in zip(out, (ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()),
                                       hashlib.sha256(back.encode()).hexdigest(), back == (t or ""))):
                column.append(v)
        return out

    return add_columns(docs, [text_col], fields, run)


def op7_sentencepiece(docs: DataFrame) -> DataFrame:
    return encode_and_check(docs.select("doc_id", "text")).select(
        "doc_id", "n_pieces", "piece_ids", "pieces_crc32", "decoded_sha256", "lossless")
