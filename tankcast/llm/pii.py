"""PII (operator 9): bootstrapped contextual extraction.

Base patterns give the seeds.  Seeds, identifier-like tokens (with a digit or
an at sign) and spaced identifiers (see ``spaced``) are instances; the two words
in front of an instance are its lexical pattern.  Over the graph of patterns and
instances, Spark scores in rounds: a pattern counts once ``SEEDS`` distinct
instances support it, seeds or instances whose score reached ``INSTANCE`` in the
round before, so each round reaches one hop further.  A pattern's confidence is
the mean score of its distinct instances, times how much evidence there is; an
instance's score is one for a seed, else that at least one of its patterns is
right.  Instances that are no seeds are reported (kind ``context``) where a
confident pattern meets a high-scored instance.

Texts are read once; the occurrence table holds no text but the two words, and
a 128-bit hash of the whole instance.  Edges are summed before they are shuffled, and occurrences of a
frequent pattern or token only meet one score each.

Defined cases: null and empty texts have no spans; work grows with a text's
length.  An empty table gives an empty table; other columns are ignored.  Rows with the same id and
text share their context spans; every row is returned.  A null id is a value
like any other.  Without seeds nothing is discovered.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.llm.common import add_columns, words, written

KINDS = ["email", "ip", "card", "phone"]
#: Least confidence of a pattern, score of an instance, and distinct supporting instances of a pattern.
PATTERN, INSTANCE, SEEDS = 0.6, 0.5, 3

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behind changes no match: a run of digits is tried from its start only
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
#: Parts of a spaced identifier without a mark, and long ones with one.
CAPITALS, PLAIN = re.compile(r"[A-Z]{1,4}"), re.compile(r"[A-Za-z0-9]+")
EDGES = ".,;:!?()[]{}<>\"'`"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from the at signs in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at) if at > done else None
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not MARK.search(text):
        return []
    out = [(0, *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def spaced(parts: list[tuple[int, int, bool, bool]]) -> list[tuple[int, int]]:
    """Spaced identifiers of a run of neighbouring parts (start, end, short, marked):
    from its first short part with a mark to its last part with one, and, if the
    run has letters-only parts around these, the whole of it, too."""
    marked = [i for i, p in enumerate(parts) if p[3]]
    inner = next((i for i in marked if parts[i][2]), None)
    if inner is None:
        return []
    outer = next(i for i, p in enumerate(parts) if p[2])
    ends = {(inner, marked[-1])} | ({(outer, len(parts) - 1)} if outer <= inner else set())
    return sorted((parts[i][0], parts[k][1]) for i, k in ends if k > i and parts[k][1] - parts[i][0] >= 5)


def words_before(text: str, end: int) -> list[bytes]:
    """The last two words before ``end``, whole however long they are."""
    size = 64
    while True:
        found = words(text[max(0, end - size):end])
        if len(found) > 2 or size >= end:  # of three the first may be cut
            return found[-2:]
        size *= 4


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, identifier-like tokens and spaced identifiers with their pattern (empty: none in front)."""
    spans = [(s, e, True) for _, s, e in base]
    if MARK.search(text):
        covered = sorted((s, e) for _, s, e in base)
        k, reach, run = 0, -1, []

        def close(parts: list) -> list:
            if len(parts) > 1:
                spans.extend((start, end, False) for start, end in spaced(parts))
            return []

        for m in TOKEN.finditer(text):
            token = m[0]
            mark = MARK.search(token) is not None
            if not mark and not (len(token) <= 6 and CAPITALS.fullmatch(token.strip(EDGES))):
                run = close(run)
                continue
            while k < len(covered) and covered[k][0] < m.end():
                reach, k = max(reach, covered[k][1]), k + 1
            left = token.lstrip(EDGES)
            start = m.end() - len(left)
            end = start + len(left.rstrip(EDGES))
            if reach > start or end <= start:
                run = close(run)
                continue
            if mark and end - start >= 5:
                spans.append((start, end, False))
            # neighbours: one blank between, no punctuation at it, one line
            if run and not (start == run[-1][1] + 1 and text[start - 1] not in "\r\n"):
                run = close(run)
            if end - start < 5 or (mark and PLAIN.fullmatch(text, start, end)):
                run.append((start, end, end - start < 5, mark))
            else:
                run = close(run)
        close(run)
    out = []
    for s, e, seed in spans:
        front = words_before(text, s)
        if front:
            out.append({"start": s, "end": e, "seed": seed, "pattern": b" ".join(front).decode("utf-8", "replace"),
                        "instance": hashlib.blake2b(text[s:e].encode(), digest_size=16).digest()})
    return out


FIELDS = [
    T.StructField("base", T.ArrayType(T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("seed", T.BooleanType()),
        T.StructField("pattern", T.StringType()), T.StructField("instance", T.BinaryType())]))),
]


def _read(texts: list) -> list[list]:
    base = [base_spans(t or "") for t in texts]
    return [[[{"kind": k, "start": s, "end": e} for k, s, e in b] for b in base],
            [occurrences(t or "", b) for t, b in zip(texts, base)]]


def bootstrap(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores (pattern, confidence) and (instance, score) of the occurrence
    graph, pre-aggregated to one edge per pattern and instance.

    Scores only rise from round to round; the rounds end when one adds no
    supported or confident pattern and no high-scored instance."""
    edges = written(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    instances = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"),
                                              F.max("seed").alias("seed"))
    found = None
    while True:
        held = edges.select("pattern", "instance").join(instances, "instance")
        patterns = held.groupBy("pattern").agg(
            F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"),
            F.sum((F.col("score") >= INSTANCE).cast("long")).alias("support"))
        evidence = F.least(F.lit(1.0), F.log2(F.lit(1) + F.col("sum")) / 2)
        patterns = written(patterns.filter(F.col("support") >= SEEDS).select(
            "pattern", (F.col("sum") / F.col("n") * evidence).alias("confidence")), "pii-patterns")
        support = (edges.select("pattern", "instance").join(patterns, "pattern")
                   .groupBy("instance").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("miss")))
        instances = written(
            instances.select("instance", "seed").join(support, "instance", "left").select(
                "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(
                    F.coalesce(1 - F.exp("miss"), F.lit(0.0))).alias("score")), "pii-instances")
        before, found = found, (*patterns.agg(F.count(F.lit(1)), F.count_if(F.col("confidence") >= PATTERN)).first(),
                                instances.filter(F.col("score") >= INSTANCE).count())
        if found == before:
            return patterns, instances.select("instance", "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, context) of every row; base: (kind, start, end) by kind and
    start; context: (start, end) of discovered identifiers, sorted.  Offsets in
    code points, end excluded."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
                       F.col(f"`{text_col}`").alias("t"))
    rows = written(add_columns(rows, ["t"], FIELDS, _read).select("id", "text_hash", "base", "found"), "pii-rows")
    seen = rows.select("id", "text_hash", F.explode("found").alias("f")).select("id", "text_hash", "f.*")
    patterns, instances = bootstrap(seen.select("pattern", "instance", "seed"))
    new = (seen.filter(~F.col("seed"))
           .join(patterns.filter(F.col("confidence") >= PATTERN), "pattern")
           .join(instances.filter(F.col("score") >= INSTANCE), "instance")
           .groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__th"))
           .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("context")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.join(new, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__th")), "left").select(
        "id", "base", F.coalesce("context", none).alias("context"))


def op9_pii(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    names = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"], p["end"]))
    context = F.transform("context", lambda p: F.concat_ws(":", F.lit("context"), p["start"], p["end"]))
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("bigint")
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.concat(base, context), ",").alias("spans"))
