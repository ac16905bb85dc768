"""From ``documents`` to training rows: language ID, near-dedup, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it written and reread. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaseine.llm import byte_bpe, langid, minhash, mixing, secrets
from metaseine.llm._shared import cut, fresh_path
from metaseine.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less likely than this are rejected, as are those without a letter.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or no language that is likely."""
    model = langid.fit(docs, F.lit(True))
    if not model.languages:  # nothing to learn from: nothing to reject by
        return docs.select(*COLUMNS)
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five words, similarity 0.8."""
    return minhash.deduplicated(docs.select(*COLUMNS), words=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows the text where it changes."""
    before = F.col("n_chars")
    clean = secrets.redact_column(docs.select(*COLUMNS, F.xxhash64("text").alias("__h")), tokenizer("byte_bpe_50k.tiktoken"))
    changed = ~F.col("__h").eqNullSafe(F.xxhash64("text"))
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(before)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the sources' target rates and shuffle them globally."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row."""
    return byte_bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe", bpe),
]

#: SQL cannot express a trained classifier and byte-level BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), path=f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
