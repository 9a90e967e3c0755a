"""One query for each training-data operator, over its whole table, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quartzite.llm import class_lm, decontaminate, embedding_dedup, hard_negatives, language_id, license_scan, line_dedup, media_ts, packing, prefix_trie, quality, simhash_dedup, toxicity
from quartzite.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_ts": lambda spark, d: media_ts.digests(table(spark, d, "documents")),
    "op2_line_dedup": lambda spark, d: line_dedup.report(table(spark, d, "documents")),
    "op3_language_id": lambda spark, d: language_id.report(table(spark, d, "documents")),
    "op4_quality": lambda spark, d: quality.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_decontaminate": lambda spark, d: decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_toxicity": lambda spark, d: toxicity.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_license_scan": lambda spark, d: license_scan.report(table(spark, d, "documents")),
    "op8_simhash_dedup": lambda spark, d: simhash_dedup.report(table(spark, d, "documents")),
    "op9_class_lm": lambda spark, d: class_lm.report(table(spark, d, "documents")),
    "op10_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
    "op11_embedding_dedup": lambda spark, d: embedding_dedup.report(table(spark, d, "embeddings")),
    "op12_prefix_trie": lambda spark, d: prefix_trie.report(table(spark, d, "conversations")),
    "op13_hard_negatives": lambda spark, d: hard_negatives.report(table(spark, d, "embeddings")),
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL, "op7_license_scan": license_scan.ORACLE_SQL, "op11_embedding_dedup": embedding_dedup.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
