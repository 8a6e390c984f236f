"""The corpus operators as queries over the tables of a directory."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(module: str, function: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that hands whole tables to one operator."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        operator = getattr(importlib.import_module(f"weftline.llm.{module}"), function)
        return operator(*(_table(spark, sf_dir, t) for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _query("repeated_lines", "repeated_lines", "university_data"),
        "p1_clean": _query("repeated_lines", "remove_repeated", "university_data"),
        "p2_found": _query("pii", "found_kinds", "messages"),
        "p2_redacted": _query("pii", "redacted", "messages"),
        "p3_found": _query("conversations", "broken_conversations", "messages", "conversations"),
        "p3_rebuilt": _query("conversations", "rebuilt", "messages", "conversations"),
        "p3_links": _query("conversations", "reply_links", "messages"),
        "p3_trees": _query("conversations", "reply_trees", "messages"),
        "p4_found": _query("history_dedup", "repeated_records", "university_data"),
        "p5_found": _query("residue", "found_pages", "university_data"),
        "p5_reasons": _query("residue", "residue_pages", "university_data"),
        "p6_found": _query("main_body", "outside_lines", "university_data"),
        "p7_found": _query("pairs", "defective_pairs", "fees_data", "messages"),
        "p8_ids": _query("encode", "encode_texts", "documents"),
        "p9_found": _query("leakage", "found_leaks", "documents", "eval_items"),
        "p10_found": _query("abuse", "found_bad", "documents", "review_labels"),
        "p10_rates": _query("abuse", "source_rates", "documents", "review_labels"),
        "p9_words": _query("leakage", "leaks", "documents", "eval_items"),
    }
