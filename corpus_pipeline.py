"""A training corpus from raw documents: language ID, line dedup, near-dedup, mixing, BPE ids.

Each stage is a function of (spark, docs, sf_dir).  All but the last return the columns of
``docs``; the last returns them without text, plus n_tokens and ids.

Nulls: a null text has no letter, so language ID rejects it; every other column may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.llm import bpe, hyperlang, line_dedup, mixing, order_minhash
from flowlattice.llm.common import written

#: A text of LETTERS letters or more is in no language if its cosine with the nearest one is less; the bound falls in proportion
#: for shorter ones.  Over the test tables, such documents have 0.199 or more, and random letters 0.141 at most.
LEAST_SCORE, LETTERS = 0.15, 110


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language; one without a value in ``lang`` gets the predicted one."""
    langs, prototypes = hyperlang.fit(docs)
    rest = [c for c in docs.columns if c != "text"]  # inside one column, so that none clashes with the prediction's
    found = hyperlang.predict(docs.select(F.struct(*rest).alias("doc"), "text"), langs, prototypes, ("found", "score"))
    least = LEAST_SCORE * F.least(F.lit(1.0), F.regexp_count("text", F.lit(r"\p{L}")) / F.lit(float(LETTERS)))
    found = found.where((F.col("found") != "und") & (F.col("score") >= least))
    own = {c: F.col("doc").getField(c) for c in rest} | {"text": F.col("text"), "lang": F.coalesce(F.col("doc").getField("lang"), F.col("found"))}
    return found.select(*(own[c].alias(c) for c in docs.columns))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of repeated three-line windows; n_chars follows the text."""
    names = docs.columns
    return line_dedup.dedup(docs, counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every class of near-duplicates."""
    return order_minhash.kept(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of text."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_windows", line_windows), ("near_dedup", near_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: A classifier, sketches and BPE aren't SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
