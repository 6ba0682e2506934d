"""The canonical listing: raw rows of any source to one fixed schema, then duplicates and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon

RAW = "provider string, id string, name string, info_hash string, size_raw string, size_num bigint, date_raw string, date_num bigint, seeders string, leechers string, magnet string, category string, detail_url string, files string"
LISTING = ["id", "name", "size", "size_text", "seeders", "leechers", "date_ms", "date_text", "magnet", "info_hash", "provider", "category", "detail_url", "files", "needs_magnet"]


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalize(raw: DataFrame, now_ms: int, *keep: str) -> DataFrame:
    """Raw rows to listings; missing raw columns count as null, ``keep`` names columns to carry along.

    Empty strings count as missing. The identifier is the given one, else provider and hash (or name).
    """
    text = lambda n: canon.blank_to_null(_col(raw, n, "string"))
    size = canon.parse_size(_col(raw, "size_raw", "string"), _col(raw, "size_num", "bigint"))
    date = canon.parse_date(_col(raw, "date_raw", "string"), now_ms, _col(raw, "date_num", "bigint"))
    magnet = F.coalesce(text("magnet"), canon.build_magnet(text("info_hash"), text("name")))
    return raw.select(
        F.coalesce(text("id"), F.concat(F.col("provider"), F.lit(":"), F.coalesce(text("info_hash"), text("name"), F.lit("")))).alias("id"),
        F.coalesce(text("name"), F.lit("(untitled)")).alias("name"),
        size.alias("size"), canon.format_size(size).alias("size_text"),
        canon.to_int(_col(raw, "seeders", "string")).alias("seeders"), canon.to_int(_col(raw, "leechers", "string")).alias("leechers"),
        date.alias("date_ms"), canon.format_date(date).alias("date_text"),
        magnet.alias("magnet"), text("info_hash").alias("info_hash"), F.col("provider"), text("category").alias("category"), text("detail_url").alias("detail_url"),
        canon.to_int(_col(raw, "files", "string")).alias("files"),
        (magnet.isNull() & text("detail_url").isNotNull()).alias("needs_magnet"),
        *keep,
    )


def normalize_all(raws: list[DataFrame], now_ms: int, *keep: str) -> DataFrame:
    """Raw rows of many sources to listings: brought to one schema first, so that the rules are planned and compiled once."""
    columns = [c.strip().split() for c in RAW.split(",")]
    same = [raw.select(*(_col(raw, name, kind).alias(name) for name, kind in columns), *keep) for raw in raws]
    return normalize(reduce(DataFrame.unionByName, same), now_ms, *keep)


def dedupe_first(listings: DataFrame, order: str = "ord", key: str = "id") -> DataFrame:
    """The first arrival of each identifier; one aggregate, combined before its one shuffle. A null identifier counts as one; of rows with equal ``order`` one stays."""
    row = F.struct(*listings.columns)
    return listings.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def merge_key() -> Column:
    return F.when(F.col("info_hash") != "", F.concat(F.lit("hash:"), F.lower("info_hash"))).otherwise(F.col("id"))


def merge_sources(listings: DataFrame, order: str = "ord") -> DataFrame:
    """One row per content hash (or id): first arrival's name, category and hash; most seeders and leechers; first known
    size, date, files and magnet; the sources in order of arrival, and their distinct names.

    One aggregate with a partial stage; a very frequent hash is combined before the shuffle but for its list of
    sources, which is part of the result.
    """
    ord_ = F.col(order)
    first = lambda c: F.min_by(c, ord_)
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), ord_))
    sources = F.array_sort(F.collect_list(F.struct(ord_.alias("ord"), "provider", "magnet", "detail_url", "id")))
    merged = listings.groupBy(merge_key().alias("key")).agg(
        F.min(ord_).alias("ord"), first("name").alias("name"), known("size").alias("size"), F.max("seeders").alias("seeders"), F.max("leechers").alias("leechers"),
        known("date_ms").alias("date_ms"), first("category").alias("category"), known("files").alias("files"), first("info_hash").alias("info_hash"), known("magnet").alias("magnet"),
        (F.max("magnet").isNull() & (F.count("detail_url") > 0)).alias("needs_magnet"), sources.alias("sources"),
    )
    return (
        merged.withColumn("size_text", canon.format_size(F.col("size"))).withColumn("date_text", canon.format_date(F.col("date_ms")))
        .withColumn("providers", F.array_distinct("sources.provider"))
        .withColumn("sources", F.transform("sources", lambda s: F.struct(s["provider"].alias("provider"), s["magnet"].alias("magnet"), s["detail_url"].alias("detail_url"), s["id"].alias("id"))))
    )


def merge_first(listings: DataFrame, most: int = 32, order: str = "ord", fields: tuple[str, ...] = ("provider", "magnet", "detail_url", "id")) -> DataFrame:
    """merge_sources for hashes of any size: ``sources`` has the first ``most`` in order of arrival, n_sources and n_providers count all.

    Every task keeps at most ``most`` rows of a key (the window's group limit), and one of each text, before
    the shuffle. So a hash that a third of all rows have keeps tasks bounded. Texts are shuffled once, unless ``fields``, what is said of a source, has some.
    """
    keyed, ord_ = listings.withColumn("key", merge_key()), F.col(order)
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), ord_)).alias(c)
    first = F.min_by(F.struct("name", "category", "info_hash"), ord_)
    merged = keyed.groupBy("key").agg(
        F.min(ord_).alias("ord"), first.alias("first"), F.count("*").alias("n_sources"), F.max("seeders").alias("seeders"), F.max("leechers").alias("leechers"), known("size"), known("date_ms"), known("files"), known("magnet"), (F.count("detail_url") > 0).alias("_details"),
    )
    n = F.row_number().over(Window.partitionBy("key").orderBy(ord_))
    rows = keyed.select("key", *fields, n.alias("_n")).where(F.col("_n") <= most)
    heads = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("sources"))
    providers = keyed.select("key", "provider").distinct().groupBy("key").agg(F.count("provider").alias("n_providers"))
    plain = F.transform("sources", lambda s: F.struct(*(s[c].alias(c) for c in fields)))
    return merged.join(heads, "key").join(providers, "key").select(
        "key", "ord", "first.name", "size", canon.format_size(F.col("size")).alias("size_text"), "seeders", "leechers", "date_ms", canon.format_date(F.col("date_ms")).alias("date_text"), "first.category", "files", "first.info_hash", "magnet",
        (F.col("magnet").isNull() & F.col("_details")).alias("needs_magnet"), plain.alias("sources"), "n_sources", "n_providers",
    )


def sources_of(listings: DataFrame, order: str = "ord") -> DataFrame:
    """One row per source of a content hash instead of an array: key, place (from 1, by arrival), provider, id, n_rows of the hash."""
    from .refine import numbered

    rows = numbered(listings.select(merge_key().alias("key"), order, "provider", "id"), F.col("key"), F.col(order))
    firsts = rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("place").alias("_first"))
    return rows.join(firsts, "key").select("key", (F.col("place") - F.col("_first") + 1).alias("place"), "provider", "id", "n_rows")


def provider_overlap(listings: DataFrame) -> DataFrame:
    """provider, n_groups (content hashes it has), n_shared (those with more than one row): from counts, no arrays."""
    by_pair = listings.groupBy(merge_key().alias("key"), "provider").agg(F.count("*").alias("n"))  # combined before the shuffle
    by_key = by_pair.groupBy("key").agg(F.sum("n").alias("total"))
    return by_pair.join(by_key, "key").groupBy("provider").agg(F.count("*").alias("n_groups"), F.count_if(F.col("total") > 1).alias("n_shared"))


def resolve_magnets(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Second fetch as an enrichment join: rows without a magnet take that of their detail page (detail_url, resolved, resolved_hash)."""
    found = details.groupBy("detail_url").agg(F.min("resolved").alias("resolved"), F.min("resolved_hash").alias("resolved_hash"))
    joined = listings.join(found.withColumnRenamed("detail_url", "_url"), F.col("needs_magnet") & (F.col("detail_url") == F.col("_url")), "left")
    magnet = F.coalesce("magnet", "resolved", canon.build_magnet(F.col("resolved_hash"), F.col("name")))
    return joined.withColumn("magnet", magnet).withColumn("info_hash", F.coalesce(F.col("info_hash"), F.col("resolved_hash"), canon.extract_info_hash(F.col("resolved")))).withColumn("needs_magnet", F.col("magnet").isNull() & F.col("detail_url").isNotNull()).drop("_url", "resolved", "resolved_hash")


def any_magnet(merged: DataFrame) -> Column:
    """A merged row's magnet, else the first among its sources."""
    return F.coalesce(F.col("magnet"), F.get(F.filter("sources", lambda s: s["magnet"].isNotNull()), F.lit(0))["magnet"])
