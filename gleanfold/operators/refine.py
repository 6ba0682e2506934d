"""Filters, relevance, order, pages and facets over merged rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from .listings import merge_key
from .ordered import ordered_table


def at_least(column: str, least: int) -> Column:
    """Threshold that unknown values pass."""
    return F.col(column).isNull() | (F.col(column) >= least)


def name_contains(text: str) -> Column:
    return F.contains(F.lower("name"), F.lit(text.strip().lower()))


def matches(query: str, column: str = "name") -> Column:
    """Names that hold every token of the query, for tables that no source has searched yet."""
    out = F.lit(True)
    for token in query.lower().split():
        out = out & F.contains(F.lower(column), F.lit(token))
    return out


def safe(strict_compat: bool = False) -> Column:
    """Without adult content, by bucket; ``strict_compat`` compares the raw category only, letter for letter."""
    if strict_compat:
        return F.coalesce(F.col("category") != "porn", F.lit(True))
    return F.coalesce(classify.bucket(F.col("category"), F.col("name")) != "porn", F.lit(True))


def refine(merged: DataFrame, min_seeders: int = 0, min_size: int = 0, contains: str = "", quality: str = "all", bucket: str = "all", safe_mode: bool = False, strict_compat: bool = False) -> DataFrame:
    out = merged
    if min_seeders:
        out = out.where(at_least("seeders", min_seeders))
    if min_size:
        out = out.where(at_least("size", min_size))
    if contains.strip():
        out = out.where(name_contains(contains))
    if quality != "all":
        out = out.where(classify.has_quality(F.col("name"), quality))
    if bucket != "all":
        out = out.where(classify.bucket(F.col("category"), F.col("name")) == bucket)
    return out.where(safe(strict_compat)) if safe_mode else out


_TOKEN = "a-z0-9一-鿿"


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(f"[^{_TOKEN}]+", text.lower()) if t]


def relevance(name: Column, query: str) -> Column:
    """Keyword score: 5 for the phrase, 3 for a name that begins with it; per query token 2 for an equal title token, 1 for a
    prefix, 0.5 for a part; and 3 times the share of tokens found. A title isn't split into its tokens: what a token is follows from the
    characters before and after a part, and titles without the part aren't looked at further."""
    phrase = query.strip().lower()
    title = F.lower(F.coalesce(name, F.lit("")))
    wanted = _tokens(query)
    if not phrase:
        return F.lit(0.0)
    score = F.when(F.contains(title, F.lit(phrase)), 5.0).otherwise(0.0) + F.when(F.startswith(title, F.lit(phrase)), 3.0).otherwise(0.0)
    hits = F.lit(0)
    for w in wanted:
        part, begins = F.contains(title, F.lit(w)), f"(?<![{_TOKEN}]){w}"
        score = score + F.when(part, F.when(title.rlike(f"{begins}(?![{_TOKEN}])"), 2.0).when(title.rlike(begins), 1.0).otherwise(0.5)).otherwise(0.0)
        hits = hits + F.when(part, 1).otherwise(0)
    return score + hits * F.lit(3.0) / F.lit(len(wanted)) if wanted else score


def by_relevance(merged: DataFrame, query: str, order: str = "ord") -> DataFrame:
    return merged.withColumn("score", relevance(F.col("name"), query)).orderBy(F.desc("score"), F.desc(F.coalesce("seeders", F.lit(-1))), order)


def by_column(merged: DataFrame, column: str, ascending: bool = False, order: str = "ord") -> DataFrame:
    """Sort in which unknown counts as -1 and ties keep the order of arrival."""
    key = F.coalesce(F.col(column), F.lit(-1))
    return merged.orderBy(key.asc() if ascending else key.desc(), order)


def places(merged: DataFrame, column: str, ascending: bool = False, order: str = "ord") -> DataFrame:
    """Every row with its ``place`` from 1 in the order of by_column: numbered within ranges, after the sizes of the ranges before."""
    key = F.coalesce(F.col(column), F.lit(-1))
    return numbered(merged, key.asc() if ascending else key.desc(), F.col(order))


def numbered(merged: DataFrame, *by: Column) -> DataFrame:
    """Every row with its ``place`` from 1 in a total order, without bringing all rows, or those of one key, into one task."""
    return ordered_table(merged, *by).rows()


def page(ordered: DataFrame, number: int, size: int = 20) -> DataFrame:
    return ordered.offset((number - 1) * size).limit(size)


def best_merged(listings: DataFrame, score: Column, number: int = 1, size: int = 20, order: str = "ord") -> DataFrame:
    """One page of the merged rows by score: key, order, name, seeders, score.

    A score is a function of the first arrival's name, so it is known before the merge, and only numbers are shuffled and sorted;
    the names of the page's few rows are looked up afterwards.
    """
    keyed = listings.withColumn("key", merge_key())
    merged = keyed.groupBy("key").agg(F.min(order).alias(order), F.min_by(score, order).alias("score"), F.max("seeders").alias("seeders"))
    by = [F.desc("score"), F.desc(F.coalesce("seeders", F.lit(-1))), order]
    found = F.broadcast(page(merged.orderBy(*by), number, size).withColumnsRenamed({"key": "_key", order: "_order"}))  # a page
    named = keyed.select("key", order, "name").join(found, F.col("key").eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_order")))
    return named.groupBy("key", order, "score", "seeders").agg(F.min("name").alias("name")).orderBy(*by).select("key", order, "name", "seeders", "score")


def facets(merged: DataFrame) -> DataFrame:
    """Rows per bucket; none at all if only one bucket occurs."""
    counts = merged.groupBy(classify.bucket(F.col("category"), F.col("name")).alias("bucket")).agg(F.count("*").alias("n")).where("bucket IS NOT NULL")
    all_of_them = W.partitionBy(F.lit(0))  # a row per bucket, of which there are nine
    return counts.withColumn("buckets", F.count("*").over(all_of_them)).where("buckets > 1").drop("buckets")


def selected_bucket(counts: DataFrame, wanted: str) -> str:
    return wanted if wanted == "all" or counts.where(F.col("bucket") == wanted).limit(1).count() else "all"
