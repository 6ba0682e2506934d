"""Catalog adapters: tables that play the part of listing sources, as raw rows and (for comparison) as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listings import normalize

#: The moment that relative dates count from: 2025-06-15T12:00:00Z.
NOW_MS = 1_749_988_800_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a raw listing."""
    return doc_columns(read(spark, sf_dir, "documents"))


def doc_columns(d: DataFrame) -> DataFrame:
    """Documents, a table or a stream, as raw listings: the source is the provider, the text's MD5 the content hash."""
    return d.select(
        F.col("source").alias("provider"), F.concat_ws(":", "source", "doc_id").alias("id"), F.col("text").alias("name"), F.md5("text").alias("info_hash"),
        F.col("n_chars").alias("size_num"), F.concat(F.pmod("doc_id", F.lit(700)).cast("string"), F.lit(" hours ago")).alias("date_raw"),
        F.when(F.col("doc_id") % 7 != 0, F.concat((F.col("n_chars") % 97).cast("string"), F.lit(" up"))).alias("seeders"), (F.col("n_chars") % 31).cast("string").alias("leechers"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://mirror.test/"), F.col("doc_id").cast("string"))).alias("detail_url"),
        F.col("lang").alias("category"), F.when(F.col("doc_id") % 5 == 0, F.lit("1,234")).alias("files"), F.col("doc_id").alias("ord"),
    )


def doc_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(doc_raw(spark, sf_dir), NOW_MS, "ord")


def size_text_sql(b: str) -> str:
    out = f"CASE WHEN {b} IS NULL THEN '—' WHEN {b} < 1024 THEN {b} || ' B'"
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        u = 1024**i
        text = f"(CASE WHEN {b} >= {100 * u} THEN (({b} + {u // 2}) // {u})::VARCHAR ELSE ((({b} * 10 + {u // 2}) // {u}) // 10) || '.' || ((({b} * 10 + {u // 2}) // {u}) % 10) END) || ' {unit}'"
        out += f" WHEN {b} < {u * 1024} THEN {text}" if unit != "PB" else f" ELSE {text}"
    return out + " END"


def encode_sql(c: str) -> str:
    out = f"url_encode({c})"
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


DOC_LISTINGS_SQL = f"""
  SELECT source || ':' || doc_id AS id, coalesce(nullif(text, ''), '(untitled)') AS name, n_chars AS size, {size_text_sql('n_chars')} AS size_text,
    CASE WHEN doc_id % 7 <> 0 THEN n_chars % 97 END AS seeders, n_chars % 31 AS leechers,
    {NOW_MS} - (doc_id % 700) * 3600000 AS date_ms, strftime(make_timestamp(({NOW_MS} - (doc_id % 700) * 3600000) * 1000), '%Y-%m-%d') AS date_text,
    'magnet:?xt=urn:btih:' || md5(text) || coalesce('&dn=' || {encode_sql("nullif(text, '')")}, '') AS magnet, md5(text) AS info_hash, source AS provider, lang AS category,
    CASE WHEN doc_id % 3 = 0 THEN 'https://mirror.test/' || doc_id END AS detail_url, CASE WHEN doc_id % 5 = 0 THEN 1234 END AS files, false AS needs_magnet, doc_id AS ord
  FROM documents
"""

MERGED_SQL = f"""
  SELECT 'hash:' || lower(info_hash) AS key, min(ord) AS ord, arg_min(name, ord) AS name, arg_min(size, ord) FILTER (size IS NOT NULL) AS size, max(seeders) AS seeders, max(leechers) AS leechers,
    arg_min(date_ms, ord) FILTER (date_ms IS NOT NULL) AS date_ms, arg_min_null(category, ord) AS category, arg_min(files, ord) FILTER (files IS NOT NULL) AS files, min(info_hash) AS info_hash,
    arg_min(magnet, ord) FILTER (magnet IS NOT NULL) AS magnet, string_agg(provider || '/' || id, ' ' ORDER BY ord) AS source_list, count(*) AS n_rows
  FROM ({DOC_LISTINGS_SQL}) GROUP BY 1
"""

# Endings that give part names the tokens that classification looks for.
ENDINGS = [".S01E02", " 1080p", " FLAC", " 1999 BluRay", " season 2", " x64 portable", " epub", " fitgirl", " 电影4k", " HDR10", " xxx", "", " éS03E04", " v2.10", " 2001 web-dl", " plain"]
CATEGORIES = ["Movies/HD", "TV shows", "Anime", "PC Games", "", "Audiobooks", "music", "XXX", "Apps", "zz", "ROMs", "Hentai", "comics", "pc", "Seriesx", "-"]


def _pick(values: list[str], key):
    return F.get(F.array(*map(F.lit, values)), key)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a listing: brand as the provider, a title with one of the endings, a source category."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("provider"), F.concat("p_name", _pick(ENDINGS, (F.col("p_partkey") % 16).cast("int"))).alias("name"),
        F.when(F.col("p_partkey") % 3 == 0, _pick(CATEGORIES, ((F.col("p_partkey") / 3).cast("long") % 16).cast("int"))).alias("category"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("long")).alias("seeders"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size").cast("long") * 104857600).alias("size"),
    )


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


PARTS_SQL = f"""
  SELECT p_partkey AS ord, p_brand AS provider, p_name || {_list_sql(ENDINGS)}[p_partkey % 16 + 1] AS name, CASE WHEN p_partkey % 3 = 0 THEN {_list_sql(CATEGORIES)}[(p_partkey // 3) % 16 + 1] END AS category,
    CASE WHEN p_partkey % 4 <> 0 THEN p_size::BIGINT END AS seeders, CASE WHEN p_partkey % 9 <> 0 THEN p_size::BIGINT * 104857600 END AS size
  FROM part
"""


def _rules_sql(c: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{rule}') THEN '{bucket}'" for bucket, rule in rules) + " END"


def raw_bucket_sql(c: str) -> str:
    from ..functions.classify import RAW_RULES

    return f"CASE WHEN {c} <> '' THEN {_rules_sql(f'lower({c})', RAW_RULES)} END"


def title_bucket_sql(c: str) -> str:
    from ..functions.classify import TITLE_RULES

    return f"CASE WHEN {c} <> '' THEN coalesce({_rules_sql(f'lower({c})', TITLE_RULES)}, 'other') END"
