"""The registered queries of the training-data operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlattice.llm import bpe, hyperlang, impact_search, licences, line_dedup, mixing, order_minhash, periodic_runs, phrase_automata, spelling_variants, toxicity, warc, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_webp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(_table(spark, sf_dir, "documents"))


def op2_licence_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(_table(spark, sf_dir, "pages"))


def op4_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return impact_search.search(vectors, vectors.where("vec_id % 50 = 0"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source")


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(_table(spark, sf_dir, "documents"))


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.digests(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelled(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_webp_payloads, op2_licence_templates, op3_warc_captures, op4_impact_topk, op5_byte_bpe, op6_source_mix, op7_line_windows, op8_toxicity, op9_order_minhash, op10_language_id, op11_phrase_automata, op12_periodic_runs, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_licence_templates": licences.oracle(), "op3_warc_captures": warc.oracle(), "op4_impact_topk": impact_search.oracle(), "op6_source_mix": mixing.oracle(), "op7_line_windows": line_dedup.oracle(), "op11_phrase_automata": phrase_automata.oracle()}
