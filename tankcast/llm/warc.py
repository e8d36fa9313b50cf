"""WARC archives (operator 13): a writer, and a salvage reader.

Writing: one record a row, each a gzip member of its own.  A payload's SHA-1 is
its name: of the rows with one payload the smallest id is written as
``response``, the others as ``revisit`` records that refer to it and hold the
HTTP headers alone (whose Content-Length still tells the payload's size).  The
bytes go out through Spark's text writer, so its committer keeps files whole
when executors are lost; the empty gzip member is its line separator.

Reading: a file is walked from its start, by gzip members or by plain records.
A record counts if its member inflates and passes its CRC, its header parses,
its block is as long as told and ends in a blank line followed by the end, a
member or a version line, and its digests hold.  After a failed check the reader
searches forward for the next gzip magic or version line from which a record
passes all of them, goes on there, and logs the bytes between as a gap.  An
archive is held whole by the task that reads it (Spark's ``binaryFile``, up to
2 GB); the writer closes files after ``RECORDS`` records.

Defined cases: a null payload is empty, a null URL too; control characters and
blanks in a URL are percent-encoded.  A null id comes last among equal payloads
and is written ``null``.  Rows that agree in id and payload are told apart by
their place in the input, so one is the response; they refer to their own id.  With
``min_bytes`` shorter payloads are all responses.  An empty table gives an
archive without records.  Extra columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankcast.llm.common import spread_back
from tankcast.session import checkpoint_dir, ship_package

RECORDS = 5_000
#: Bytes inflated at a time, and bytes of records given on at a time.
FED, GIVEN = 1 << 14, 8 << 20
#: Parts that the rows of one payload are dealt to.
SALTS = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_MEMBER = gzip.compress(b"", mtime=0)
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD = ("archive string, kind string, start long, length long, type string, id string, uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary, reason string")


# --- one record ------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(i: str | None) -> str:
    return f"<urn:x-page:{'null' if i is None else i}>"


def record(i: str | None, uri: str | None, payload: bytes, digest: str, refers: tuple[str | None] | None,
           date: str = DATE) -> bytes:
    """The bytes of a record; ``refers`` holds the id that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    uri = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", uri or "")
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", urn(i)), ("WARC-Date", date),
            ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"),
            *([("WARC-Refers-To", urn(refers[0])), ("WARC-Profile", PROFILE)] if refers else []),
            ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8")
    return out


def parse(data: bytes, at: int, alone: bool) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; ``ValueError`` says which check
    failed.  ``alone``: within a member, where only a record may follow."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    head = fields(data[at:stop])
    if not {"warc-type", "warc-record-id", "content-length"} <= head.keys():
        raise ValueError("header without type, id or length")
    size = head["content-length"]
    if not (size.isascii() and size.isdigit()):
        raise ValueError("length is no number")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("block not as long as told")
    after = end + 4
    if after < len(data) and not VERSION.match(data, after) and (alone or not data.startswith(MAGIC, after)):
        raise ValueError("no record after the block")
    block = data[begin:end]
    told = head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:].upper() != base32_sha1(block):
        raise ValueError("block digest")
    http = head.get("content-type", "").startswith("application/http")
    cut = block.find(b"\r\n\r\n") + 4 if http else 0
    if http and cut == 3:
        raise ValueError("HTTP header without end")
    payload, told = block[cut:], head.get("warc-payload-digest", "")
    revisit = head["warc-type"] == "revisit"
    if not revisit and told.startswith("sha1:") and told[5:].upper() != base32_sha1(payload):
        raise ValueError("payload digest")
    if http and revisit:
        size = fields(block[:cut - 4]).get("content-length", "")
        full = int(size) if size.isascii() and size.isdigit() else None
    else:
        full = None if revisit else len(payload)
    return {"type": head["warc-type"], "id": head["warc-record-id"], "uri": head.get("warc-target-uri"),
            "refers_to": head.get("warc-refers-to"), "payload_digest": told[5:] if told.startswith("sha1:") else None,
            "payload_bytes": full, "payload": None if revisit else payload}, after


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """An inflated gzip member and where it ends."""
    inflate, out = zlib.decompressobj(31), []
    try:
        while not inflate.eof:
            taken = data[at:at + FED]
            if not taken:
                raise ValueError("member without end")
            out.append(inflate.decompress(taken))
            at += len(taken)
    except zlib.error as e:
        raise ValueError(f"member: {e}") from None
    return b"".join(out), at - len(inflate.unused_data)


def at_start(data: bytes, at: int) -> tuple[list[dict], int]:
    """Records of the member, or the plain record, that starts at ``at``."""
    if not data.startswith(MAGIC, at):
        found, end = parse(data, at, False)
        return [found], end
    text, end = member(data, at)
    out, pos = [], 0
    while pos < len(text):
        found, pos = parse(text, pos, True)
        out.append(found)
    return out, end


def salvage(data: bytes):
    """(kind, start, length, record or reason) of an archive's records and gaps."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            found, end = at_start(data, at)
        except ValueError as e:  # UnicodeDecodeError is one
            if gap is None:
                gap, reason = at, str(e)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap = None
        for one in found:
            yield "record", at, end - at, one
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, reason


# --- tables ----------------------------------------------------------------------

def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0, date: str = DATE) -> None:
    """Write ``pages`` as archives below ``path``.

    The payloads are shuffled once, dealt by (digest, salt) so that a payload
    with very many copies is spread; what meets in one place is a row per digest
    and salt."""
    ship_package(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = (pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{uri_col}`").cast("string").alias("uri"), payload.alias("payload"))
            .withColumn("digest", F.unhex(F.sha1("payload")))
            .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = spread_back(rows, ["digest"], "salt", {"first": (F.min, order)})
    rows = rows.join(first.hint("shuffle_hash"), ["digest", "salt"]).select(
        F.col("id").cast("string").alias("id"), "uri", "payload", "digest",
        ((F.col("first.row") != F.col("row")) & (F.length("payload") >= min_bytes)).alias("revisit"),
        F.col("first.id").cast("string").alias("refers"))

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for k in range(batch.num_rows):
                i, uri, payload, digest, revisit, refers = (c[k].as_py() for c in batch.columns)
                name = base64.b32encode(digest).decode()
                out.append(gzip.compress(record(i, uri, payload, name, (refers,) if revisit else None, date), 6, mtime=0))
                held += len(out[-1])
                if held > GIVEN:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    # the cast leaves the bytes as they are, and the encoding makes each separator character a byte
    (rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", NO_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", RECORDS).text(path))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and gap of the archives below ``path`` (``RECORD``): ``kind``
    is ``record`` or ``gap``, ``start`` and ``length`` are bytes of the file (of
    the member, for records in one), ``reason`` says which check failed first."""
    ship_package(spark)
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = dict(string=pa.string(), long=pa.int64(), binary=pa.binary())
    kinds = [kinds[c.split()[1]] for c in RECORD.split(", ")]
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .filter(F.col("length") > 0).select("path", "content"))

    def run(batches):
        def flush():
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)],
                                             names=names)
            rows.clear()

        rows: list[dict] = []
        held = 0
        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column(0)[k].as_py()
                for kind, start, length, what in salvage(batch.column(1)[k].as_py()):
                    row = {"archive": archive, "kind": kind, "start": start, "length": length}
                    row |= what if kind == "record" else {"reason": what}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 100
                    if held > GIVEN:
                        yield from flush()
                        held = 0
        yield from flush()

    return files.mapInArrow(run, RECORD)


def records(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'record'").drop("kind", "reason")


def gaps(read: DataFrame) -> DataFrame:
    """The quarantined byte ranges, for a log."""
    return read.filter("kind = 'gap'").select("archive", "start", "length", "reason")


def op13_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    number = lambda c: F.try_to_number(F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1), F.lit("S9999999999999999999"))
    read = records(read_warc(spark, path, payloads=False))
    return read.select(number("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("type").alias("record_type"), number("refers_to").cast("bigint").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS f
      FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN f END AS refers_to
FROM r
"""
