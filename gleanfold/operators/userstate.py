"""Small tables of a user's state joined to results: favourites, seen items, history, checked items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flag(rows: DataFrame, keys: DataFrame, name: str, key: str = "key") -> DataFrame:
    """rows with a boolean column: whether the key is among ``keys``."""
    known = keys.select(F.col(key).alias("_key")).distinct().withColumn(name, F.lit(True))
    return rows.join(known, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup(groups: DataFrame, favourites: DataFrame, key: str = "key") -> DataFrame:
    """Every known item: the current result where there is one, else the stored favourite."""
    other = favourites.join(groups.select(key), key, "left_anti")
    return groups.unionByName(other.select(*groups.columns))


def checked(pool: DataFrame, picks: DataFrame, key: str = "key", order: str = "pick_order") -> DataFrame:
    """Picked items that still exist, with their pick order."""
    return pool.join(picks.select(key, order), key)


def remove(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def recent(history: DataFrame, query: str = "query", at: str = "ts", most: int = 12, by: list[str] | None = None) -> DataFrame:
    """Latest distinct queries, case ignored, newest first; of each user, if ``by`` names columns."""
    by = by or []
    last = history.groupBy(*by, F.lower(query).alias("_q")).agg(F.max(F.struct(F.col(at), F.col(query))).alias("_last"))
    rows = last.select(*by, F.col(f"_last.{query}").alias(query), F.col(f"_last.{at}").alias(at))
    if not by:
        return rows.orderBy(F.desc(at), query).limit(most)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(at), query))
    return rows.withColumn("recency", rank).where(F.col("recency") <= most)
