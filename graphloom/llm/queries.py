"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import documented_functions, hidden_duplicates, mixing, reading_level, source_validity, tokenizer, unwritten_files
from graphloom.runtime import load


def _files(spark, d):
    return load(spark, d, "file_facts")


def _symbols(spark, d):
    return load(spark, d, "nodes").filter(F.col("kind") == "symbol")


def _mix(spark, d):
    return mixing.plan(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def _reading(operator):
    return lambda spark, d: operator(load(spark, d, "documents"), load(spark, d, "level_passages"))


QUERIES = {
    "p1_found": lambda spark, d: source_validity.invalid_files(_files(spark, d), load(spark, d, "nodes")),
    "p1_rates": lambda spark, d: source_validity.invalid_rates(_files(spark, d), load(spark, d, "nodes")),
    "p1_verdicts": lambda spark, d: source_validity.parse_files(_files(spark, d), load(spark, d, "nodes")),
    "p2_found": lambda spark, d: unwritten_files.unwritten_files(_files(spark, d)),
    "p2_layout": lambda spark, d: unwritten_files.classified_files(_files(spark, d)),
    "p2_by_layout": lambda spark, d: unwritten_files.unwritten_files(_files(spark, d), notes=False, paths=False),
    "p2_hand_written_nodes": lambda spark, d: unwritten_files.hand_written_nodes(_files(spark, d), load(spark, d, "nodes")).select("load_seq"),
    "p2_hand_written": lambda spark, d: unwritten_files.hand_written_files(_files(spark, d)),
    "p3_found": lambda spark, d: documented_functions.found_functions(_files(spark, d), load(spark, d, "raw_symbols")),
    "p3_pairs": lambda spark, d: documented_functions.documented_functions(_files(spark, d), load(spark, d, "raw_symbols")),
    "p5_found": lambda spark, d: hidden_duplicates.hidden_duplicates(_symbols(spark, d)),
    "p5_deduplicated": lambda spark, d: hidden_duplicates.deduplicated(_symbols(spark, d)),
    "p6_ids": lambda spark, d: tokenizer.encode_corpus(load(spark, d, "documents")),
    "p6_counts": lambda spark, d: load(spark, d, "documents").select("doc_id", tokenizer.token_count(F.col("text")).alias("n_tokens")),
    "p7_mix": lambda spark, d: _mix(spark, d).documents(),
    "p7_shares": lambda spark, d: _mix(spark, d).shares(),
    "p7_shards": lambda spark, d: _mix(spark, d).shards(),
    "p8_found": _reading(reading_level.reading_levels),
    "p8_profile": _reading(reading_level.level_profile),
}
SQL = {}
