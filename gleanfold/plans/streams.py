"""Queries that run as streams, and the same in DuckDB's SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import listings
from ..shared import work_dir
from ..streaming import arrivals, search, upserts
from . import catalogs as C
from .catalogs import MERGED_SQL, NOW_MS, read
from .registry import query

#: Stand-in for the network: the pages of source k complete WAITS[k] steps after the start.
WAITS, STEP_S, LEAD_S = [3, 0, 4, 1, 2], 0.8, 4.0


def stored_transport(began: float):
    """A row's own page, held back until its time."""

    def run(row: dict):
        due = began + row["wait"] * STEP_S
        time.sleep(max(0.0, due - time.time()))
        yield row["source"], 0, row["url"], 200, row["body"], None, None, int(1000 * STEP_S * row["wait"])

    return run


@query(f"""
  WITH p AS (SELECT 'site' || page_id % 5 AS source, [{", ".join(map(str, WAITS))}][page_id % 5 + 1] AS wait, url, html FROM pages)
  SELECT source, dense_rank() OVER (ORDER BY wait) AS place, url, strlen(html) AS n_bytes, md5(html) AS digest FROM p
""")
def fetch_stream(spark, sf_dir) -> DataFrame:
    """All pages, fetched by a job and read as a stream while it runs: each with the place at which its source came."""
    p = read(spark, sf_dir, "pages")
    k = F.col("page_id") % 5
    wait = F.get(F.array(*map(F.lit, WAITS)), k.cast("int"))
    asked = p.select(F.concat(F.lit("site"), k.cast("string")).alias("source"), "url", F.col("html").alias("body"), wait.alias("wait"))
    asked = asked.repartition("url").sortWithinPartitions("wait", "url")
    live = arrivals.Arrivals(asked, stored_transport(time.time() + LEAD_S), size=256)
    out = work_dir(spark, "fetched")
    rows = live.stream.select("source", "arrival", "url", "body", "error")
    live.finish(rows.writeStream.format("parquet").option("path", f"{out}/pages").option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="200 milliseconds").start())
    live.remove()
    arrived = spark.read.schema(rows.schema).parquet(f"{out}/pages")
    places = arrivals.completions(arrived).select("source", "place")
    return arrived.join(F.broadcast(places), "source").select(  # a row per source
        "source", "place", "url", F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("digest")
    )


@query("SELECT 'site' || page_id % 5 AS source, url, strlen(html) AS n_bytes FROM pages WHERE page_id % 5 IN (1, 4)")
def source_pruning(spark, sf_dir) -> DataFrame:
    """All pages landed by source; a query for two sources plans and reads only their files."""
    k = (F.col("page_id") % 5).cast("string")
    asked = read(spark, sf_dir, "pages").select(F.concat(F.lit("site"), k).alias("source"), "url", F.col("html").alias("body"), F.lit(0).alias("wait"))
    stored = arrivals.stored_pages(asked.repartition("url").sortWithinPartitions("source", "url"), stored_transport(0.0), size=256)
    return stored.where(F.col("source").isin("site1", "site4")).select("source", "url", F.octet_length("body").cast("long").alias("n_bytes"))


@query(f"SELECT key, ord, name, size, seeders, leechers, category, info_hash, magnet, n_rows, false AS needs_magnet FROM ({MERGED_SQL.replace('arg_min_null', 'arg_min')})")
def stream_upserts(spark, sf_dir) -> DataFrame:
    """Documents arrive file by file; each batch writes only the merged rows that it changes. What they come to equals the batch merge."""
    raw = search.listing_stream(spark, sf_dir)
    arrived = listings.normalize(C.doc_columns(raw), NOW_MS, "ord")
    merged, _ = upserts.run_merge(arrived)
    return merged.select("key", "ord", "name", "size", "seeders", "leechers", "category", "info_hash", "magnet", "n_rows", (F.col("magnet").isNull() & (F.col("n_details") > 0)).alias("needs_magnet"))
