"""Secret scans (operator 10): DataFrame functions only.

Base matches stand for themselves.  Weak parts - a login name, a bare mixed
token, an endpoint - mean little alone; each is reported only when the parts it
needs lie in the same scope: a login needs a secret, a bare token needs an
identifier, an endpoint needs both.  Parts of all kinds are laid out as
intervals on their text; two are in scope if the gap between them is at most
``SCOPE`` code points, whatever their lengths.  For each role running windows
keep the furthest end on the left and the nearest start on the right, so the
join is linear in the number of parts.  A weak part inside a base match is not
reported again.

Texts are read once: matches and the pieces between them give the positions,
and only the short part lists are shuffled, by row (id and hash of the text).

Defined cases: null and empty texts have no matches; time and memory grow with
a text's length and matches.  An empty table gives an empty table.  Rows with the same id and
text share their links; every row is returned.  A null id is a value like any
other.  Columns other than the id and text don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankcast.llm.common import written

SCOPE = 300
#: Matches whose positions are summed in one go.
RUN = 256
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: kind -> pattern, in order of kinds.  A run of at least n characters is the
#: run itself, kept if long enough.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}"}
WEAK = {
    "login": r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "bare": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}",
    "endpoint": r"""https?://[^\s"'<>]+""",
}
KINDS = [*BASE, *WEAK]


def good(kind: str, match: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8
    if kind == "bare":  # mixed characters, no plain word, number or hex string
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def positions(text: Column, found: Column, kind: str) -> Column:
    """array<struct<start, end, kind>> of the good matches, from the lengths of
    the matches and of the pieces between them."""
    pattern = (BASE | WEAK)[kind]
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
                       lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"),
                                               F.length(m).cast("bigint").alias("len"), good(kind, m).alias("ok")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["out"], lambda p: F.struct(
            (p["start"] + by).alias("start"), (p["end"] + by).alias("end"), p["kind"].alias("kind")))

    def after(acc: Column, run: Column) -> Column:
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved(run, acc["at"]))).alias("out"))

    def all_of(s: Column) -> Column:
        # a list grows by copying it: runs of some hundred steps first, then the runs
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), lambda k: F.aggregate(
            F.slice(s, k * RUN + 1, RUN), F.struct(zero.alias("at"), none.alias("out")), step))
        lists = F.array().cast("array<array<struct<start:bigint,end:bigint,kind:int>>>")
        return F.flatten(F.aggregate(runs, F.struct(zero.alias("at"), lists.alias("out")), after, lambda acc: acc["out"]))

    # within the transform the steps are computed once
    return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(steps), all_of), 1)).otherwise(none)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, parts) of every row: base matches and weak parts."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    patterns = BASE | WEAK
    rows = rows.withColumns({f"m_{k}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    return rows.select("id", "text_hash",
                       F.concat(*[positions(F.col("t"), F.col(f"m_{k}"), k) for k in patterns]).alias("parts"))


def links(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(id, text_hash, linked): weak parts whose complements are in scope."""
    n_base = len(BASE)
    login, bare, endpoint = (KINDS.index(k) for k in WEAK)
    flat = (rows.filter(F.exists("parts", lambda p: p["kind"] >= n_base))
            .select("id", "text_hash", F.explode("parts").alias("p")).select("id", "text_hash", "p.*"))
    before = (Window.partitionBy("id", "text_hash").orderBy("start")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.col("kind")
    inside = F.max(F.when(kind < n_base, F.col("end"))).over(before)
    flat = flat.withColumn("inside", F.coalesce(inside >= F.col("end"), F.lit(False)) & (kind >= n_base))
    own = ~F.col("inside")
    # the same from the right: a running window again, not one that looks ahead
    after = (Window.partitionBy("id", "text_hash").orderBy(F.col("start").desc())
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    roles = {"identifier": kind.isin(KINDS.index("access"), login) & own,
             "secret": kind.isin(KINDS.index("assign"), KINDS.index("hex"), bare) & own}
    flat = flat.withColumns({f"{r}_end": F.max(F.when(c, F.col("end"))).over(before) for r, c in roles.items()})
    flat = flat.withColumns({f"{r}_start": F.min(F.when(c, F.col("start"))).over(after) for r, c in roles.items()})
    flat = flat.withColumns({r: F.coalesce(F.col("start") - F.col(f"{r}_end") <= scope, F.lit(False))
                             | F.coalesce(F.col(f"{r}_start") - F.col("end") <= scope, F.lit(False)) for r in roles})
    linked = own & (((kind == login) & F.col("secret")) | ((kind == bare) & F.col("identifier"))
                    | ((kind == endpoint) & F.col("secret") & F.col("identifier")))
    return flat.filter(linked).groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("start", "end", "kind")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, linked) of every row: arrays of (start, kind, end), sorted;
    offsets in code points, end excluded; kind: number in ``KINDS``."""
    rows = written(parts(docs, id_col, text_col), "secret-parts")
    found = links(rows, scope).select(F.col("id").alias("__id"), F.col("text_hash").alias("__th"), "linked")
    in_order = lambda a: F.sort_array(F.transform(
        a, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))
    base = F.filter("parts", lambda p: p["kind"] < len(BASE))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__th")), "left").select(
        "id", in_order(base).alias("base"), F.coalesce(in_order(F.col("linked")), none).alias("linked"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(
        ":", F.element_at(names, p["kind"] + 1), p["start"], p["end"])), ",")


def op10_secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("bigint")
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.sort_array(F.concat("base", "linked"))).alias("spans"))
