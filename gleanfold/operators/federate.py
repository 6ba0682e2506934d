"""Sources of one query: which are asked, their union, their status, mirrors, and whether more pages may exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The static registry in order; those that take a page number; and the generated one.
REGISTRY = [
    "tpb", "1337x", "nyaa", "yts", "knaben", "torrentscsv", "anilibria", "anirena", "animetosho", "bangumimoe", "dmhy", "mikan",
    "subsplease", "sukebei", "tokyotoshokan", "nekobt", "bt4g", "btdigg", "eztv", "limetorrents", "therarbg", "rutor", "torrent9", "torrentdownload",
    "torrentdownloads", "torrentdatabase", "torrentkitty", "uindex", "zeromagnet", "bitsearch", "oxtorrent", "audiobookbay", "blueroms", "filemood", "internetarchive", "linuxtracker",
    "megapeer", "mypornclub", "xxxclub", "xxxtracker", "demo",
]
PAGINATED = {"1337x", "nyaa", "dmhy", "bt4g", "limetorrents", "rutor", "bitsearch"}
GENERATED = {"demo"}
# The sources' names; the names that errors of sources without mirrors bear; sources whose errors bear their id.
LABELS = {
    "tpb": "The Pirate Bay", "1337x": "1337x", "nyaa": "NYAA", "yts": "YTS", "knaben": "Knaben", "torrentscsv": "TorrentsCSV", "anilibria": "AniLibria", "anirena": "AniRena", "animetosho": "AnimeTosho", "bangumimoe": "Bangumi.Moe", "dmhy": "DMHY", "mikan": "Mikan",
    "subsplease": "SubsPlease", "sukebei": "Sukebei", "tokyotoshokan": "TokyoToshokan", "nekobt": "NekoBT", "bt4g": "Bt4g", "btdigg": "BTDigg", "eztv": "EZTV", "limetorrents": "LimeTorrents", "therarbg": "TheRarBg", "rutor": "Rutor", "torrent9": "Torrent9",
    "torrentdownload": "TorrentDownload", "torrentdownloads": "TorrentDownloads", "torrentdatabase": "TorrentDatabase", "torrentkitty": "TorrentKitty", "uindex": "UIndex", "zeromagnet": "ZeroMagnet", "bitsearch": "BitSearch", "oxtorrent": "OxTorrent",
    "audiobookbay": "AudioBookBay", "blueroms": "BlueRoms", "filemood": "FileMood", "internetarchive": "InternetArchive", "linuxtracker": "LinuxTracker", "megapeer": "MegaPeer", "mypornclub": "MyPornClub", "xxxclub": "XXXClub", "xxxtracker": "XXXTracker", "demo": "Demo (offline)",
}
SINGLE = {"nyaa": "NYAA", "tpb": "TPB", "yts": "YTS", "knaben": "Knaben", "torrentscsv": "TorrentsCSV", "subsplease": "SubsPlease", "internetarchive": "internetarchive"}
BY_ID = {"anilibria", "animetosho", "anirena", "audiobookbay", "bangumimoe", "blueroms", "dmhy", "filemood", "linuxtracker", "megapeer", "mikan", "mypornclub", "xxxclub", "xxxtracker"}


def registry(spark: SparkSession, indexers: list[dict] | None = None) -> DataFrame:
    """id, name, enabled, demo, paginated, rank: static sources, then the user's indexers."""
    rows = [(s, LABELS[s], True, s in GENERATED, s in PAGINATED) for s in REGISTRY]
    rows += [(i["id"], i.get("name") or i["id"], i.get("enabled", True), False, False) for i in indexers or []]
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "id string, name string, enabled boolean, demo boolean, paginated boolean, rank int")


def resolve(sources: DataFrame, wanted: DataFrame | None = None, page: int = 1, without_groups: tuple[str, ...] = ()) -> DataFrame:
    """Enabled sources; those wanted, if any list is given; from page 2 on only those that page."""
    from ..functions.classify import source_group

    out = sources.where("enabled")
    if wanted is not None:
        out = out.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi")  # a subset of the registry's ids
    if page > 1:
        out = out.where("paginated OR demo")
    return out.where(~source_group(F.col("id")).isin(*without_groups)) if without_groups else out


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL in the order given, with ``source_rank``."""
    out = None
    for rank, df in enumerate(parts):
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def status(targets: DataFrame, listings: DataFrame, errors: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """id, name, status, count, error, ms for every source asked, those without rows included; ms: the slowest of its requests in ``pages`` (source, ms)."""
    counts = listings.groupBy(F.col("provider").alias("id")).agg(F.count("*").alias("count"))
    out = targets.join(counts, "id", "left")
    out = out.join(errors.select("id", "error"), "id", "left") if errors is not None else out.withColumn("error", F.lit(None).cast("string"))
    if pages is not None and "ms" in pages.columns:
        out = out.join(pages.groupBy(F.col("source").alias("id")).agg(F.max("ms").alias("ms")), "id", "left")
    else:
        out = out.withColumn("ms", F.lit(None).cast("long"))
    return out.withColumn("count", F.when(F.col("error").isNull(), F.coalesce("count", F.lit(0))).otherwise(0)).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def more_expected() -> Column:
    """Whether any source that answered with rows says, or by paging implies, that there is more."""
    return F.coalesce(F.bool_or((F.col("status") == "ok") & (F.col("count") > 0) & F.coalesce("has_more", "paginated")), F.lit(False))


def first_mirror(results: DataFrame, source: str = "source", mirror_rank: str = "mirror_rank") -> DataFrame:
    """Rows of each source's first mirror, in declared order, that has rows."""
    first = results.groupBy(source).agg(F.min(mirror_rank).alias("_first"))
    return results.join(F.broadcast(first.withColumnRenamed(source, "_source")), (F.col(source) == F.col("_source")) & (F.col(mirror_rank) == F.col("_first"))).drop("_source", "_first")  # a row per source


def mirror_errors(attempts: DataFrame) -> DataFrame:
    """attempts: source, name, mirror_rank, n, error. The message of every source none of whose mirrors has rows."""
    failed = attempts.groupBy("source", "name").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("error") != "", F.struct("mirror_rank", "error")))).alias("errors")).where("n = 0")
    return failed.select("source", F.concat("name", F.lit(" unreachable ("), F.array_join("errors.error", "; "), F.lit(")")).alias("error"))


def _named(source: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), source)


def source_errors(attempts: DataFrame) -> DataFrame:
    """attempts: source, mirror_rank, n (listings found), failure (of the transport), reason (why an answer holds none). Per source its error text.

    A source with mirrors fails if none has listings, whatever they say; one without only if it says why; an indexer's
    words stand as they are.
    """
    single = F.col("source").isin(*SINGLE) | F.col("source").startswith("torznab:")
    name = F.when(F.col("source").isin(*BY_ID), F.col("source")).otherwise(F.coalesce(_named(F.col("source"), LABELS), F.col("source")))
    mirrored = mirror_errors(attempts.where(~single).select("source", name.alias("name"), "mirror_rank", "n", F.coalesce("failure", "reason").alias("error")))
    alone = attempts.where(single).groupBy("source").agg(F.max("n").alias("n"), F.max("failure").alias("failure"), F.max("reason").alias("reason")).where("n = 0 AND (failure IS NOT NULL OR reason IS NOT NULL)")
    own = _named(F.col("source"), SINGLE)
    text = F.when(own.isNotNull() & F.col("failure").isNotNull(), F.concat(own, F.lit(" unreachable ("), "failure", F.lit(")"))).otherwise(F.coalesce("failure", "reason"))
    return mirrored.unionByName(alone.select("source", text.alias("error")))


def group_selection(sources: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected and all sources of each group, and whether all are selected."""
    from ..functions.classify import source_group

    marked = sources.join(selected.select("id").distinct().withColumn("on", F.lit(True)), "id", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    return marked.groupBy(source_group(F.col("id")).alias("source_group")).agg(F.count_if("on").alias("n_selected"), F.count("*").alias("n_sources"), F.bool_and("on").alias("all_selected"))
