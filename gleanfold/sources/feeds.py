"""Sources that answer in JSON or XML: text columns to raw listings by schema, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, classify

# Half-open ranges of category numbers.
CATEGORY_RANGES = [
    (1000000, 2000000, "Music"), (2000000, 3000000, "Series"), (3000000, 4000000, "Movies"), (4000000, 5000000, "Apps"), (5000000, 6000000, "Porn"),
    (6000000, 7000000, "Anime"), (7000000, 8000000, "Games"), (9000000, 10000000, "Books"), (10000000, 11000000, "Other"),
]
# Media types of an archive and their buckets.
MEDIA_TYPES = {"software": "Apps", "texts": "Books", "movies": "Movies"}
_RSS = "channel struct<item: array<struct<title: string, link: string, guid: string, comments: string, pubDate: string, size: string, enclosure: struct<_url: string, _length: string>, `torznab:attr`: array<struct<_name: string, _value: string>>>>>"


def _raw(df: DataFrame, provider: str, keep: tuple[str, ...], **columns: Column) -> DataFrame:
    place = ["place"] if "place" in df.columns and "place" not in keep else []  # where the body had the row
    return df.select(*keep, *place, F.lit(provider).alias("provider"), *(c.alias(n) for n, c in columns.items()))


def _attr(item: Column, name: str) -> Column:
    """The last attribute of that name, case ignored."""
    return F.try_element_at(F.filter(item["torznab:attr"], lambda a: F.lower(a["_name"]) == name), F.lit(-1))["_value"]


def rss_listings(feeds: DataFrame, provider: str, *keep: str, xml_col: str = "xml") -> DataFrame:
    """Items of an indexer's RSS text: magnet from the enclosure, else the link; size from the enclosure, else the size element."""
    item = F.col("item")
    parsed = feeds.select(*keep, F.posexplode(F.from_xml(xml_col, _RSS, {"rowTag": "rss"})["channel"]["item"]).alias("place", "item"))
    text = lambda n: canon.blank_to_null(canon.trim(item[n]))
    url, length = item["enclosure"]["_url"], item["enclosure"]["_length"]
    magnet = F.coalesce(F.when(url.startswith("magnet:"), url), F.when(text("link").startswith("magnet:"), text("link")))
    size = F.when(canon.to_int(length).isNotNull(), length).otherwise(text("size"))
    info_hash = F.coalesce(canon.blank_to_null(_attr(item, "infohash")), canon.blank_to_null(F.regexp_extract(magnet, "(?i)btih:([a-f0-9]+)", 1)))
    return _raw(parsed.where(text("title").isNotNull()), provider, keep, name=text("title"), size_raw=size, seeders=_attr(item, "seeders"), leechers=_attr(item, "peers"), date_raw=text("pubDate"), info_hash=info_hash, magnet=magnet, detail_url=F.coalesce(text("comments"), text("link"), text("guid")), category=_attr(item, "category"))


def indexer_url(url: str) -> str:
    """An indexer's address with its query dropped and /api at the end."""
    base = url.strip().split("?")[0].rstrip("/")
    return base if base.lower().endswith("/api") else base + "/api"


def indexer_query(url: str, api_key: str, query: str, mode: str = "search") -> str:
    from urllib.parse import urlencode

    return indexer_url(url) + "?" + urlencode({"apikey": api_key, "extended": 1, "t": mode} | ({"q": query} if mode == "search" else {}))


def tpb(bodies: DataFrame, *keep: str) -> DataFrame:
    """A flat array of string fields; a single row with an error means no results."""
    code = F.trim(F.col("r.category"))
    first = F.substring(code, 1, 1)
    bucket = (
        F.when(first == "1", F.when(code == "102", "Books").otherwise("Music")).when(first == "2", F.when(code.isin("205", "208"), "Series").otherwise("Movies")).when(first == "3", "Apps")
        .when(first == "4", "Games").when(first == "5", "Porn").when(first == "6", F.when(code.isin("601", "602"), "Books").otherwise("Other"))
    )
    rows = bodies.select(*keep, F.posexplode(F.from_json("body", "array<struct<id: string, name: string, info_hash: string, size: string, seeders: string, leechers: string, num_files: string, added: string, category: string, error: string>>")).alias("place", "r")).where("r.error IS NULL")
    page = F.concat(F.lit("https://thepiratebay.org/description.php?id="), F.col("r.id"))
    return _raw(rows, "tpb", keep, name=F.col("r.name"), info_hash=F.col("r.info_hash"), size_raw=F.col("r.size"), seeders=F.col("r.seeders"), leechers=F.col("r.leechers"), date_num=F.col("r.added").try_cast("bigint") * 1000, category=bucket, files=F.col("r.num_files"), detail_url=F.when(F.col("r.id") != "", page))


def yts(bodies: DataFrame, *keep: str) -> DataFrame:
    """Movies that hold releases: exploded twice, names put together."""
    j = "struct<data: struct<movies: array<struct<id: bigint, title: string, title_long: string, url: string, torrents: array<struct<hash: string, quality: string, type: string, video_codec: string, size_bytes: bigint, seeds: string, peers: string, date_uploaded_unix: bigint>>>>>>"
    movies = bodies.select(*keep, F.posexplode(F.from_json("body", j)["data"]["movies"]).alias("movie", "m")).select(*keep, "movie", "m", F.posexplode("m.torrents").alias("at", "t")).withColumn("place", F.col("movie") * 1000 + F.col("at"))
    title = F.coalesce(canon.blank_to_null(F.col("m.title_long")), canon.blank_to_null(F.col("m.title")))
    info_hash = canon.blank_to_null(F.lower("t.hash"))
    dash = lambda c: F.coalesce(canon.blank_to_null(F.col(c)), F.lit("-"))
    name = F.format_string("%s [%s] [%s] [%s]", title, dash("t.quality"), dash("t.type"), dash("t.video_codec"))
    page = F.concat("m.url", F.lit("?movieid="), F.col("m.id").cast("string"), F.lit("&infohash="), info_hash)
    return _raw(movies.where(title.isNotNull() & info_hash.isNotNull()), "yts", keep, name=name, info_hash=info_hash, size_num=F.col("t.size_bytes"), seeders=F.col("t.seeds"), leechers=F.col("t.peers"), date_num=F.col("t.date_uploaded_unix"), category=F.lit("Movies"), detail_url=page)


def knaben(bodies: DataFrame, *keep: str) -> DataFrame:
    """Hits with several category numbers, of which the smallest counts."""
    j = "struct<hits: array<struct<title: string, hash: string, magnetUrl: string, bytes: bigint, seeders: string, peers: string, date: string, categoryId: array<bigint>, details: string>>>"
    hits = bodies.select(*keep, F.posexplode(F.from_json("body", j)["hits"]).alias("place", "r"))
    return _raw(hits, "knaben", keep, name=F.col("r.title"), info_hash=F.coalesce(canon.blank_to_null(F.col("r.hash")), canon.extract_info_hash(F.col("r.magnetUrl"))), magnet=F.col("r.magnetUrl"), size_num=F.col("r.bytes"), seeders=F.col("r.seeders"), leechers=F.col("r.peers"), date_raw=F.col("r.date"), category=classify.bucket_by_range(F.array_min("r.categoryId"), CATEGORY_RANGES), detail_url=F.col("r.details"))


def torrentscsv(bodies: DataFrame, *keep: str) -> DataFrame:
    j = "struct<torrents: array<struct<name: string, infohash: string, size_bytes: bigint, seeders: string, leechers: string, created_unix: bigint>>>"
    rows = bodies.select(*keep, F.posexplode(F.from_json("body", j)["torrents"]).alias("place", "r"))
    return _raw(rows, "torrentscsv", keep, name=F.col("r.name"), info_hash=F.col("r.infohash"), size_num=F.col("r.size_bytes"), seeders=F.col("r.seeders"), leechers=F.col("r.leechers"), date_num=F.col("r.created_unix"), category=F.lit("Other"))


def subsplease(bodies: DataFrame, *keep: str) -> DataFrame:
    """An object keyed by show: exploded as a map, sizes out of the magnets."""
    j = "map<string, struct<release_date: string, episode: string, page: string, downloads: array<struct<res: string, magnet: string>>>>"
    shows = bodies.select(*keep, F.posexplode(F.from_json("body", j)).alias("nth", "show", "a")).select(*keep, "nth", "show", "a", F.posexplode("a.downloads").alias("at", "d")).where("d.magnet <> ''").withColumn("place", F.col("nth") * 1000 + F.col("at"))
    page = F.concat(F.lit("https://subsplease.org/"), F.col("a.page"), F.lit("?ep="), canon.encode_component(F.coalesce("a.episode", F.lit(""))), F.lit("&res="), canon.encode_component(F.col("d.res")))
    return _raw(shows, "subsplease", keep, name=F.concat("show", F.lit(" ["), "d.res", F.lit("p]")), size_num=canon.magnet_size(F.col("d.magnet")), date_raw=F.col("a.release_date"), info_hash=canon.extract_info_hash(F.col("d.magnet")), magnet=F.col("d.magnet"), category=F.lit("Anime"), detail_url=page)


def bangumimoe(bodies: DataFrame, *keep: str) -> DataFrame:
    j = "struct<torrents: array<struct<_id: string, title: string, infohash: string, magnet: string, size: string, seeders: string, leechers: string, publish_time: string>>>"
    rows = bodies.select(*keep, F.posexplode(F.from_json("body", j)["torrents"]).alias("place", "r")).where("r.title <> '' AND r.magnet <> ''")
    return _raw(rows, "bangumimoe", keep, name=F.col("r.title"), info_hash=F.coalesce(canon.blank_to_null(F.col("r.infohash")), canon.extract_info_hash(F.col("r.magnet"))), magnet=F.col("r.magnet"), size_raw=canon.trim(F.col("r.size")), seeders=F.col("r.seeders"), leechers=F.col("r.leechers"), date_raw=F.col("r.publish_time"), category=F.lit("Anime"), detail_url=F.concat(F.lit("https://bangumi.moe/torrent/"), F.col("r._id")))


def internetarchive(bodies: DataFrame, *keep: str) -> DataFrame:
    j = "struct<response: struct<docs: array<struct<identifier: string, title: string, mediatype: string, item_size: bigint, publicdate: string, btih: string>>>>"
    rows = bodies.select(*keep, F.posexplode(F.from_json("body", j)["response"]["docs"]).alias("place", "r")).where("r.btih <> '' AND r.title <> ''")
    return _raw(rows, "internetarchive", keep, name=F.col("r.title"), info_hash=canon.trim(F.lower("r.btih")), size_num=F.col("r.item_size"), date_raw=F.col("r.publicdate"), category=classify.bucket_by_table(F.col("r.mediatype"), MEDIA_TYPES, "Other"), detail_url=F.concat(F.lit("https://archive.org/details/"), F.col("r.identifier")))


_RELEASE = "array<struct<hash: string, magnet: string, size: bigint, seeders: string, leechers: string, label: string, created_at: string, release: struct<alias: string, name: struct<main: string, english: string>>>>"


def anilibria(releases: DataFrame, details: DataFrame, most: int = 15) -> DataFrame:
    """Dependent fetch as a join: the first releases of a search (id, place) with the answers for each (id, body)."""
    top = releases.where("id IS NOT NULL").orderBy("place").limit(most)
    return _torrents(top.join(details, "id").select("place", F.explode(F.from_json("body", _RELEASE)).alias("t")), ("place",), F.lit("https://anilibria.top"))


def _torrents(rows: DataFrame, keep: tuple[str, ...], base: Column) -> DataFrame:
    name = F.coalesce(*(canon.blank_to_null(F.col(c)) for c in ("t.label", "t.release.name.english", "t.release.name.main")))
    page = F.concat(base, F.lit("/anime/releases/release/"), F.col("t.release.alias"))
    return _raw(rows.where((F.col("t.hash") != "") & name.isNotNull()), "anilibria", keep, name=name, info_hash=F.col("t.hash"), magnet=F.col("t.magnet"), size_num=F.col("t.size"), seeders=F.col("t.seeders"), leechers=F.col("t.leechers"), date_raw=F.col("t.created_at"), category=F.lit("Anime"), detail_url=page)


def release_ids(pages: DataFrame, most: int = 15) -> DataFrame:
    """(mirror_rank, id, place): the first releases that each mirror's search found. pages: mirror_rank, url, body."""
    found = pages.where("body IS NOT NULL AND url LIKE '%/app/search/releases?%'")
    ids = found.select("mirror_rank", F.filter(F.from_json("body", "array<struct<id: bigint>>")["id"], lambda i: i.isNotNull()).alias("ids"))
    return ids.select("mirror_rank", F.posexplode(F.slice("ids", 1, most)).alias("place", "id"))


def anilibria_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """Listings from the pages of both steps (mirror_rank, url, body), in order of the search. Stored pages without a url count as the second step's."""
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(None).cast("string"))
    places = release_ids(pages).groupBy("mirror_rank", "id").agg(F.min("place").alias("first"))
    details = pages.where("url IS NULL OR url NOT LIKE '%/app/search/releases?%'").withColumn("id", F.expr("try_cast(regexp_extract(url, '/release/([0-9]+)$', 1) AS bigint)"))
    joined = details.join(places, ["mirror_rank", "id"], "left")
    rows = joined.select(*keep, "url", "first", F.posexplode(F.from_json("body", _RELEASE)).alias("at", "t"))
    place = F.shiftleft(F.coalesce("first", F.lit(1 << 20)).cast("long"), 20) + F.col("at")
    base = F.coalesce(canon.blank_to_null(F.regexp_extract("url", "^(https?://[^/]+)", 1)), F.lit("https://anilibria.top"))
    return _torrents(rows.withColumn("place", place).withColumn("base", base), (*keep, "place"), F.col("base"))


JSON_SOURCES: dict[str, Callable] = {"tpb": tpb, "yts": yts, "knaben": knaben, "torrentscsv": torrentscsv, "subsplease": subsplease, "bangumimoe": bangumimoe, "internetarchive": internetarchive, "anilibria": anilibria_pages}


def answer_fault(source, body):
    """What a source that doesn't send HTML says of an answer in another shape; null if the shape is right."""
    starts = lambda c: F.coalesce(F.startswith(F.ltrim(c), F.lit("[")), F.lit(False))
    return (
        F.when((source == "tpb") & ~starts(body), "unexpected response").when((source == "anilibria") & ~starts(body), "bad_response")
        .when((source == "bangumimoe") & ~starts(F.get_json_object(body, "$.torrents")), "bad_response").when((source == "internetarchive") & ~starts(F.get_json_object(body, "$.response.docs")), "no_docs")
    )
