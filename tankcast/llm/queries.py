"""Queries of the corpus operators over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tankcast.llm import (align, decontaminate, line_dedup, minhash, pieces, pii, prefix_trie, secrets,
                          shards, token_files, topk, toxicity, warc)
from tankcast.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": lambda s, d: topk.op1_top_k(table(s, d, "embeddings")),
    "op2_decontaminate": lambda s, d: decontaminate.op2_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
    "op3_near_duplicates": lambda s, d: minhash.op3_near_duplicates(table(s, d, "documents")),
    "op4_histogram_shards": lambda s, d: shards.op4_histogram_shards(table(s, d, "documents")),
    "op5_toxicity": lambda s, d: toxicity.op5_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op6_line_dedup": lambda s, d: line_dedup.op6_line_dedup(table(s, d, "documents")),
    "op7_sentencepiece": lambda s, d: pieces.op7_sentencepiece(table(s, d, "documents")),
    "op8_token_files": lambda s, d: token_files.op8_token_files(table(s, d, "documents")),
    "op9_pii": lambda s, d: pii.op9_pii(table(s, d, "documents")),
    "op10_secrets": lambda s, d: secrets.op10_secrets(table(s, d, "documents")),
    "op11_prefix_trie": lambda s, d: prefix_trie.op11_prefix_trie(table(s, d, "conversations")),
    "op12_align": lambda s, d: align.op12_align(table(s, d, "documents")),
    "op13_warc": lambda s, d: warc.op13_warc(table(s, d, "pages")),
}

SQL: dict[str, str] = {
    "op1_top_k": topk.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_warc": warc.SQL,
}
