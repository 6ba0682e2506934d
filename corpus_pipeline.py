"""The training-corpus pipeline: language, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on what the stage before it kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanfold.llm.common import mark, new_path, remove, remove_since
from gleanfold.llm.langid import fit_languages, held_out, predict_column
from gleanfold.llm.packing import pack_documents
from gleanfold.llm.quality import fit_quality, verdict_column
from gleanfold.llm.simhash import keep_one
from gleanfold.llm.suffix import PASSAGE_BYTES, PASSAGE_WORDS, strip_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this coverage by the predicted language's n-grams a text counts as no language.
LEAST_COVERAGE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and empty texts, texts without a letter and texts that no learned language covers."""
    found = predict_column(fit_languages(docs.where(~held_out())), "text")
    judged = docs.withColumn("found", found)
    return judged.where((F.col("found.lang") != "und") & (F.col("found.score") >= LEAST_COVERAGE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the trees reject; null and empty texts fail the base rules."""
    forest = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(verdict_column(forest, "text")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the smallest doc_id (see keep_one)."""
    return keep_one(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of PASSAGE_WORDS words or more out of the texts; every document stays, n_chars follows its text."""
    return strip_repeats(docs, window=PASSAGE_BYTES, least_words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts that are left."""
    return pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]
#: Trained models, tokenizers and fingerprints aren't within SQL's reach; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name, before = uuid.uuid4().hex, None
    for i, (stage, apply) in enumerate(STAGES):
        path, made = new_path(spark, f"pipeline-{name}-{i}-{stage}"), mark()
        apply(spark, docs, sf_dir).write.parquet(path)
        remove_since(spark, made)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # its successor is written
        before = path
    return docs
