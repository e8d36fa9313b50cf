"""Conversation tries, token alignment and WARC archives against brute force."""

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tankcast.llm import align, prefix_trie, warc
from tankcast.llm.common import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# --- tries ---------------------------------------------------------------------------

def plain_trie(turns):
    """(conv_id, turn, role, text) rows to the query's rows, one conversation at a time."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1

    out = Counter()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        out[(min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def some_turns():
    rng = random.Random(3)
    out = [(c, rng.choice([t, t, None, 3000 * t]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", None, "", "é"]))
           for c in [*range(-12, 40), 1000, 1003] for t in range(rng.choice([1, 2, 4, 11, 30]))]
    # thousands of the same conversation, one within another, and a long one
    out += [(c, t, "user", "same") for c in range(2000, 2600) for t in range(2 + (c % 5 == 0))]
    out += [(5000, t, "user", "x" * (t % 7)) for t in range(1500)]
    return out + out[:20] + [(None, 1, "x", "y")]


def test_prefix_trie(spark, monkeypatch):
    turns = some_turns()
    schema = "conv_id long, turn long, role string, text string, depth string, len int, x1 string, part string, c string"
    df = spark.createDataFrame([(*t, "d", 1, "x", "p", "c") for t in turns], schema)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)  # end lists over many chunks
    assert rows(prefix_trie.op11_prefix_trie(df)) == plain_trie(turns)
    assert rows(prefix_trie.op11_prefix_trie(df.limit(0))) == Counter()


def test_prefix_trie_on_table(spark):
    df = table(spark, SF, "conversations")
    turns = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows(prefix_trie.op11_prefix_trie(df)) == plain_trie(turns)


def test_sequences_and_leaves(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "c long")
    turns = [(1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (3, 2, "b")]
    df = spark.createDataFrame([(c, 0, p, "u", x.encode(), 1) for c, p, x in turns],
                               "c long, part long, pos long, role string, digest binary, bytes long")
    trie = prefix_trie.prefix_trie(df, ids)
    assert rows(trie.sequences.select("c", "len", "weight")) == Counter([(1, 1, 2), (3, 2, 1), (4, 0, 1)])
    assert rows(trie.leaves.select("c")) == Counter([(3,)])
    assert {tuple(r.ids) for r in trie.ends.collect()} == {(1, 2), (3,), (4,)}


# --- alignment -----------------------------------------------------------------------

def plain_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    to_byte, count, docs = align.byte_level(), Counter(), []
    for i, text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_text = [bytes(to_byte[c] for c in a_model.id_to_token(k)) for k in a]
        b_text = [bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k)
                  else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(a_text) != (" " + text).encode() or b"".join(b_text) != (" " + text).encode():
            docs.append((i, [], [], []))
            continue
        ends, at = {}, 0
        for k, t in enumerate(b_text):
            at += len(t)
            ends[at] = k
        links, at = [], 0
        for k, t in enumerate(a_text):
            at += len(t)
            if at in ends:
                links.append((k, ends[at]))
                count[a[k], b[ends[at]]] += 1
        docs.append((i, a, b, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = Counter()
    for i, a, b, links in docs:
        groups, p, q = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[p:x + 1])) + "|" + ",".join(map(str, b[q:y + 1])))
            p, q = x + 1, y + 1
        n = [count[a[x], b[y]] for x, y in links]
        out[(i, len(a), len(b), len(links), len(links), sum(k == top[b[y]] for k, (_, y) in zip(n, links)), sum(n),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")] += 1
    return out


TEXTS = [(1, None), (2, ""), (3, "one"), (4, "a ▁ b"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
         (6, "日本 é \r\n\U0010ffff  tail \x00"), (7, "q " * 30_000), (7, "q " * 30_000), (None, "null id"),
         (8, "word, Word 12 été l'a b " * 30_000), (9, " lead  two   three    "), (10, "x" * 100_000), (11, "\n\n \t a  b")]


def test_align(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "l", "p", 3) for i, t in TEXTS], "doc_id long, text string, links string, pair_a string, block int")
    monkeypatch.setattr(align, "BLOCK", 1 << 16)
    assert rows(align.op12_align(df)) == plain_alignment(TEXTS)
    assert rows(align.op12_align(df.limit(0))) == Counter()
    vocabularies = align.vocabularies(None, None)
    assert vocabularies.cuttable and vocabularies.ranked and len(vocabularies.stretches(TEXTS[9][1])) > 2


def test_align_on_table(spark):
    df = table(spark, SF, "documents")
    assert rows(align.op12_align(df)) == plain_alignment([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_align_lists(spark):
    text = "Wörter über alles, 12 mal"
    got = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    voc = align.vocabularies(None, None)
    groups, p, q = [], 0, 0
    for x, y in zip(got.a_cuts, got.b_cuts):
        groups.append((b"".join(voc.a_bytes[i] for i in got.a_ids[p:x + 1]), b"".join(voc.b_bytes[i] for i in got.b_ids[q:y + 1])))
        p, q = x + 1, y + 1
    assert all(a == b for a, b in groups) and b"".join(a for a, _ in groups) == (" " + text).encode()
    assert (p, q) == (len(got.a_ids), len(got.b_ids))


def test_common_ends():
    import numpy as np
    rng = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 5), (1, 1), (3, 4000), (4000, 3), (5000, 5000)]:
        a, b = (np.unique(rng.integers(0, 9000, k)) for k in (n, m))
        i, j = align.cuts(a, b)
        assert (a[i] == b[j]).all() and set(a[i].tolist()) == set(a.tolist()) & set(b.tolist())


def test_library_and_ranks_agree():
    voc = align.vocabularies(None, None)
    texts = [" " + t for _, t in TEXTS if t]
    ranked = [x.tolist() for x in voc.ids_a(texts)]
    assert ranked == [e.ids for e in voc.a.encode_batch_fast(texts, add_special_tokens=False)]


# --- archives ------------------------------------------------------------------------

PAGES = [(1, "a\nb", "x"), (1, "a\nb", "x"), (2, None, "x"), (None, "u", None), (3, "u", ""), (None, "q", "x"),
         (-4, "z", "y" * 300_000), (5, "é", "WARC/1.1\r\n\r\n\x1f\x8b\x08"), *[(k, "u", "many") for k in range(100, 900)]]


def plain_pages(pages):
    import base64
    out, first = Counter(), {}
    for i, _, html in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        seen = payload in first
        out[(i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
             "revisit" if seen else "response", first.get(payload))] += 1
        first.setdefault(payload, i)
    return out


def test_warc(spark):
    df = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, salt int")
    assert rows(warc.op13_warc(df)) == plain_pages(PAGES)
    assert rows(warc.op13_warc(df.limit(0))) == Counter()
    assert rows(warc.op13_warc(table(spark, SF, "pages"))) == plain_pages(
        [tuple(r) for r in table(spark, SF, "pages").select("page_id", "url", "html").collect()])


def test_short_payloads_stay_responses(spark, scratch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(df, scratch + "/w", min_bytes=2)
    got = rows(warc.records(warc.read_warc(spark, scratch + "/w")).filter("payload_bytes < 2").groupBy("type").count())
    assert got == Counter([("response", 6)])


def member(i, payload=b"<p>", **kw):
    return gzip.compress(warc.record(i, "http://x/", payload, warc.base32_sha1(payload), None, **kw), mtime=0)


def salvaged(data):
    out = list(warc.salvage(data))
    assert sum(n for kind, _, n, _ in {(k, a, n, None) for k, a, n, _ in out}) <= len(data)
    return [w["id"] for k, _, _, w in out if k == "record"], [(a, n) for k, a, n, _ in out if k == "gap"]


def test_salvage_members():
    a, b, c = (member(str(k), b"payload %d" % k * 50) for k in range(3))
    ids = [f"<urn:x-page:{k}>" for k in range(3)]
    assert salvaged(a + b + c) == (ids, [])
    bad = bytearray(b)
    bad[len(b) // 2] ^= 0xFF
    assert salvaged(a + bytes(bad) + c) == ([ids[0], ids[2]], [(len(a), len(b))])
    assert salvaged(a + b[:-5] + c) == ([ids[0], ids[2]], [(len(a), len(b) - 5)])
    assert salvaged(b"junk" + a + b"\x00" * 9 + b + c[:-1]) == (
        ids[:2], [(0, 4), (4 + len(a), 9), (4 + len(a) + 9 + len(b), len(c) - 1)])
    assert salvaged(b"") == ([], []) and salvaged(b"nothing here") == ([], [(0, 12)])


def test_salvage_plain_records():
    def text(k):
        payload = b"WARC/1.1\r\npayload %d" % k  # a version line that starts no record
        return warc.record(str(k), "u", payload, warc.base32_sha1(payload), None)
    a, b, c = map(text, range(3))
    ids = [f"<urn:x-page:{k}>" for k in range(3)]
    assert salvaged(a + b + c) == (ids, [])
    longer = b.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9")
    assert salvaged(a + longer + c) == ([ids[0], ids[2]], [(len(a), len(longer))])
    changed = b.replace(b"payload 1", b"payload 7")
    assert salvaged(a + changed + c) == ([ids[0], ids[2]], [(len(a), len(b))])
    assert salvaged(a + member("1", b"WARC/1.1\r\npayload 1") + c) == (ids, [])


def test_damaged_archives_are_logged(spark, scratch):
    import pathlib
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                 F.repeat(F.sha1(F.col("id").cast("string")), 20).alias("html")).coalesce(1)
    warc.write_warc(df, scratch + "/w")
    [path] = pathlib.Path(scratch, "w").glob("part-*")
    data = bytearray(path.read_bytes())
    data[len(data) // 2:len(data) // 2 + 2000] = b"\x00" * 2000
    other = pathlib.Path(scratch, "damaged")
    other.mkdir()
    (other / "a.warc.gz").write_bytes(data)
    read = warc.read_warc(spark, str(other))
    lost = 300 - warc.records(read).count()
    [gap] = warc.gaps(read).collect()
    assert 0 < lost < 20 and gap.length >= 2000 and gap.start <= len(data) // 2
