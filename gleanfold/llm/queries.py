"""One query per corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import minimax_shards

    shards = minimax_shards(_read(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import embedding_components

    return embedding_components(_read(spark, sf_dir, "embeddings"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number and checksum of its ids, and whether decoding them gives the text back."""
    from .pieces import encode_pieces

    return encode_pieces(_read(spark, sf_dir, "documents"), with_ids=False, verify=True)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes, what was removed, and the text that is left (a character that was cut in two shows as U+FFFD).

    Repeated passages that are shorter than the window but have PASSAGE_WORDS words or more follow in columns of their own.
    """
    from .suffix import PASSAGE_BYTES, remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents"), passage_window=PASSAGE_BYTES)
    text, left = (F.make_valid_utf8(F.col(c).cast("string")) for c in ("kept", "kept_passages"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text.alias("text"), "n_passages", "passage_bytes", left.alias("text_without_passages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_rules

    docs = _read(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))


def op8_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import token_tables

    return token_tables(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, held_out, identify

    docs = _read(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .slack import pack_fullest

    return pack_fullest(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcodes import books_sha256, compress_vectors, with_label_error

    codes, books = compress_vectors(_read(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(codes).select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .convtrie import conversation_trie, rebuilt_turns

    return conversation_trie(*rebuilt_turns(_read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_cover_tree": op3_cover_tree,
    "op4_pieces": op4_pieces,
    "op5_suffix_array": op5_suffix_array,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_tables": op8_token_tables,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_bin_slack": op11_bin_slack,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {"op3_cover_tree": oracles.COVER_TREE, "op10_license_scan": oracles.LICENSE_SCAN, "op12_vector_codes": oracles.VECTOR_CODES, "op13_conversation_trie": oracles.CONVERSATION_TRIE}
