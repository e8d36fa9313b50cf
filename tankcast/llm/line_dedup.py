"""Line dedup (operator 6): DataFrame functions only.

Every line's key is hashed.  Hashes are dealt out by range, a hot hash split
further by a salt of its document, and each range is streamed in order of
(hash, document descending, position): the first document met is the one that
keeps the line.  A second, small-group pass over the first three documents of
each (hash, salt) settles keys spread over several salts.  The result is a
sparse bitmap per document, not text.

Defined cases: a null or empty text is one empty line.  A null id is one
document, smaller than all others.  Rows with the same id are one document for
counting; each row gets its own bitmap by its own text.  Repeated lines inside
one document count once and stay or go together.  Lines with keys under
``min_chars`` code points always stay.  Extra columns are carried by
``drop_repeated_lines`` and ignored by ``line_bitmaps``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankcast.llm.common import free_names, without

MIN_CHARS = 20
MIN_DOCS = 3
#: Ranges of the hash axis and parts a hot hash is split into.
RANGES, SALTS = 4096, 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    blanks = F.lit(" \t\n\x0b\x0c\r")
    return F.translate(F.btrim(line, blanks), string.ascii_uppercase, string.ascii_lowercase)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row (id, text_hash, drop_bits) per document that loses lines.

    ``drop_bits`` maps ``position div 64`` to 64 bits, set where the line goes;
    a missing entry keeps all its lines."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    key = line_key(F.col("line"))
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
            .select("id", F.xxhash64("t").alias("text_hash"),
                    F.posexplode(lines_of(F.col("t"))).alias("pos", "line"))
            .withColumn("key", key).filter(F.char_length("key") >= min_chars)
            .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(1), "key").alias("h2")))
    rows = (rows.withColumn("range", F.shiftright("h1", 64 - (RANGES - 1).bit_length()))
            .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
            .repartition("range", "salt"))
    newest = [F.col("id").desc_nulls_last(), F.col("pos")]
    ranked = rows.withColumn("seen", F.dense_rank().over(
        Window.partitionBy("range", "salt", "h1", "h2").orderBy(newest[0])))
    # with min_docs larger documents in the same salt the line is sure to go
    ranked = ranked.withColumn("part", F.when(F.col("seen") > min_docs, F.col("salt") + 1).otherwise(F.lit(0)))
    group = Window.partitionBy("h1", "h2", "part")
    ranked = ranked.withColumn("at", F.dense_rank().over(group.orderBy(newest[0])))
    ranked = ranked.withColumn("docs", F.max("at").over(
        group.orderBy(newest[0]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gone = ranked.filter((F.col("part") > 0) | ((F.col("docs") >= min_docs) & (F.col("at") > 1)))
    # ``shiftleft`` takes a constant distance in every API; the SQL form takes a column
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return (gone.groupBy("id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word"))
            .agg(F.bit_or(bit).alias("bits"))
            .groupBy("id", "text_hash")
            .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_bits")))


def _joined(docs: DataFrame, id_col: str, text_col: str, **params) -> tuple[DataFrame, str]:
    """``docs``, every column as it was, with each row's bitmap, and its name."""
    key, mark, bits = free_names(docs, "__id", "__th", "__bits")
    maps = line_bitmaps(docs, id_col, text_col, **params).select(
        F.col("id").alias(key), F.col("text_hash").alias(mark), F.col("drop_bits").alias(bits))
    return docs.join(maps, F.col(f"`{id_col}`").eqNullSafe(F.col(key))
                     & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(mark)), "left").drop(key, mark), bits


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with columns ``n_lines``, ``n_dropped`` and ``drop_bits`` (null:
    nothing goes); same-named columns are replaced."""
    docs = without(docs, ["n_lines", "n_dropped", "drop_bits"])
    joined, bits = _joined(docs, id_col, text_col, **params)
    n_dropped = F.aggregate(F.map_values(bits), F.lit(0).cast("bigint"),
                            lambda a, b: a + F.bit_count(b).cast("bigint"))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines_of(F.col(f"`{text_col}`"))).cast("bigint").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0).cast("bigint")).alias("n_dropped"),
        F.col(bits).alias("drop_bits"))


def kept_text(text: Column, drop_bits: Column) -> Column:
    """The text's staying lines joined by a newline (null text: empty)."""
    def stays(line: Column, i: Column) -> Column:
        word = F.coalesce(F.try_element_at(drop_bits, F.shiftright(i, 6)), F.lit(0).cast("bigint"))
        return F.getbit(word, F.pmod(i, F.lit(64))) == 0

    return F.when(drop_bits.isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.filter(lines_of(text), stays), "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with the text reduced to its staying lines; other columns as they
    were, whatever their names."""
    joined, bits = _joined(docs, id_col, text_col, **params)
    return joined.select([
        kept_text(F.col(f"`{c}`"), F.col(bits)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    out = with_bitmaps(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(kept_text(F.col("text"), F.col("drop_bits")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT row_id, doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS row_id, doc_id,
               string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u),
g AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20
      GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE g.k IS NOT NULL AND l.doc_id <> g.keep) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
              FILTER (WHERE NOT (g.k IS NOT NULL AND l.doc_id <> g.keep)), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.k = g.k
GROUP BY l.row_id, l.doc_id
"""
