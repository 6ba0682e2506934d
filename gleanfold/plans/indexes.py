"""Queries over indexes, ledgers and tables that are built first, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import pushing
from ..operators import listings, ordered, textindex
from ..operators.seen import SeenLog
from ..shared import work_dir
from . import catalogs as C
from .catalogs import DOC_LISTINGS_SQL, PARTS_SQL
from .registry import query


def stand_in_client(url: str, body: bytes | None, headers: dict) -> tuple[int, dict, bytes]:
    """Answers as a client would that refuses content hashes beginning with 0."""
    if url.endswith("/auth/login"):
        return 200, {"Set-Cookie": "SID=1; path=/"}, b"Ok."
    return 200, {}, b"Fails." if b"btih%3A0" in body else b"Ok."


@query(f"SELECT DISTINCT sha256(magnet) AS digest, info_hash[1] <> '0' AS taken FROM ({DOC_LISTINGS_SQL})")
def push_ledger(spark, sf_dir) -> DataFrame:
    """Every document's magnet is pushed to a client once; what the ledger says of each."""
    ledger = work_dir(spark, "ledger")
    config = {"url": "http://client.test", "user": "u", "password": "p"}
    pushing.push_once(C.doc_listings(spark, sf_dir), "qbittorrent", config, ledger, chunk=256, send="gleanfold.plans.indexes:stand_in_client")
    return pushing.ledger_rows(spark, ledger).select("digest", "taken")


_SEARCHES = ["The and", "lamp ember", "licensed", "é d", "zzzqqq"]


@query(" UNION ALL ".join("SELECT '{0}' AS query, doc_id FROM documents WHERE {1}".format(q, " AND ".join(f"contains(lower(text), '{t}')" for t in q.lower().split())) for q in _SEARCHES))
def keyword_index(spark, sf_dir) -> DataFrame:
    """Searches of a trigram index over all texts: what a scan of them would find."""
    index = textindex.build_index(C.read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    found = None
    for q in _SEARCHES:
        rows = index.search(q).select(F.lit(q).alias("query"), "doc_id")
        found = rows if found is None else found.unionByName(rows)
    return found


_PAGES = [1, 2, 7, 40, 100, 1000]


@query(f"SELECT (place - 1) // 20 + 1 AS page, place, ord, name, seeders FROM (SELECT *, row_number() OVER (ORDER BY coalesce(seeders, -1) DESC, ord) AS place FROM ({DOC_LISTINGS_SQL})) WHERE (place - 1) // 20 + 1 IN ({', '.join(map(str, _PAGES))})")
def deep_pages(spark, sf_dir) -> DataFrame:
    """Pages from all over the order, each read from the ranges that hold it."""
    table = ordered.ordered_table(C.doc_listings(spark, sf_dir).select("ord", "name", "seeders"), F.coalesce("seeders", F.lit(-1)).desc(), F.col("ord"))
    found = None
    for number in _PAGES:
        rows = table.page(number).select(F.lit(number).cast("long").alias("page"), "place", "ord", "name", "seeders")
        found = rows if found is None else found.unionByName(rows)
    return found


_HOT_SQL = f"SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN 'HotHash' ELSE info_hash END AS info_hash) FROM ({DOC_LISTINGS_SQL})"


@query(f"""
  SELECT 'hash:' || lower(info_hash) AS key, min(ord) AS ord, arg_min(name, ord) AS name, arg_min(size, ord) AS size, max(seeders) AS seeders, max(leechers) AS leechers, arg_min(date_ms, ord) AS date_ms, arg_min(magnet, ord) AS magnet,
    array_to_string(list(provider || '/' || id ORDER BY ord)[1:5], ' ') AS source_list, count(*) AS n_sources, count(DISTINCT provider) AS n_providers
  FROM ({_HOT_SQL}) GROUP BY 1
""")
def merge_hot_hash(spark, sf_dir) -> DataFrame:
    """A merge in which one content hash has a third of all rows: its first five sources, and how many there are."""
    d = C.doc_listings(spark, sf_dir).withColumn("info_hash", F.when(F.col("ord") % 3 == 0, "HotHash").otherwise(F.col("info_hash")))
    names = F.array_join(F.transform("sources", lambda s: F.concat(s["provider"], F.lit("/"), s["id"])), " ")
    return listings.merge_first(d, 5, fields=("provider", "id")).select("key", "ord", "name", "size", "seeders", "leechers", "date_ms", "magnet", names.alias("source_list"), "n_sources", "n_providers")


@query(f"SELECT page, ord, id FROM (SELECT ord % 5 + 1 AS page, ord, provider || ord % 97 AS id, min(ord % 5 + 1) OVER (PARTITION BY provider || ord % 97) AS first FROM ({PARTS_SQL})) WHERE page = first")
def paging_log(spark, sf_dir) -> DataFrame:
    """Five pages one after the other, each without what those before it have shown."""
    parts = C.parts(spark, sf_dir).select((F.col("ord") % 5 + 1).alias("page"), "ord", F.concat("provider", (F.col("ord") % 97).cast("string")).alias("id"))
    log, found = SeenLog(spark), None
    for number in range(1, 6):
        new = log.unseen(parts.where(F.col("page") == number))
        log.add(new)
        found = new if found is None else found.unionByName(new)
    return found
