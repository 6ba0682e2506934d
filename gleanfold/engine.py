"""The engine: search over sources, batch or stream, and what is done with results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.canon import page_number
from .operators import federate, listings, refine
from .operators.seen import SeenLog
from .shared import work_dir
from .sources import demo, feeds, layouts
from .sources.http import TIMEOUT_S, fetch_pages
from .sources.indexers import Indexers
from .sources.requests import release_details, release_requests, requests_for
from .streaming import arrivals
from .streaming.search import Search


@dataclass
class Response:
    query: str
    page: int
    results: DataFrame
    statuses: DataFrame

    def has_more(self) -> bool:
        return self.statuses.agg(federate.more_expected()).first()[0]

    def responded(self) -> tuple[int, int]:
        r = self.statuses.agg(F.count_if(F.col("status") == "ok"), F.count("*")).first()
        return r[0], r[1]


class Engine:
    """Answers queries from pages: a table (source, mirror_rank, body, error) that is fetched or stored."""

    def __init__(self, spark: SparkSession, now_ms: int, indexers: Indexers | None = None):
        self.spark, self.now_ms, self.indexers = spark, now_ms, indexers

    def sources(self) -> DataFrame:
        return federate.registry(self.spark, self.indexers.load() if self.indexers else None)

    def parsed(self, pages: DataFrame) -> DataFrame:
        """Rows of all HTML sources' pages, read in one pass and kept."""
        return layouts.page_rows(pages.where("body IS NOT NULL"), "source", "body", "mirror_rank").persist()

    def stored(self, pages: DataFrame) -> DataFrame:
        """The same in a folder per source of the shared folder, so that reading one source costs nothing of the others: as many tasks as its rows need."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # parsing is slow for so few bytes, so tasks aren't joined by size
        spread = pages.where("body IS NOT NULL").repartition(tasks, F.xxhash64("body"))
        rows, folder = layouts.page_rows(spread, "source", "body", "mirror_rank"), work_dir(self.spark, "parsed")
        rows.write.partitionBy("source").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def raw(self, pages: DataFrame, source: str, parsed: DataFrame | None = None) -> DataFrame:
        """Raw listings of one source's pages, with mirror_rank."""
        if parsed is not None and source in layouts.LAYOUTS:
            return layouts.row_listings(parsed.where(F.col("source") == source), source, "mirror_rank")
        own = pages.where((F.col("source") == source) & F.col("body").isNotNull())
        if source in feeds.JSON_SOURCES:
            return feeds.JSON_SOURCES[source](own, "mirror_rank")
        if source.startswith("torznab:"):
            return feeds.rss_listings(own.withColumnRenamed("body", "xml"), source, "mirror_rank")
        return layouts.html_listings(own, source, "body", "mirror_rank")

    def attempts(self, pages: DataFrame, listed: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
        """source, mirror_rank, n, failure, reason of each source's mirrors asked; listed: provider and mirror_rank of every listing found."""
        there = F.coalesce(F.col("body") != "", F.lit(False))
        own = pages.groupBy("source", "mirror_rank").agg(F.count_if(there).alias("n_bodies"), F.max("error").alias("error"), F.max(F.when(there, feeds.answer_fault(F.col("source"), F.col("body")))).alias("fault"))
        n = listed.groupBy(F.col("provider").alias("source"), "mirror_rank").agg(F.count("*").alias("n"))
        none = own.select("source", "mirror_rank").limit(0).withColumn("none", F.lit(None).cast("string")) if parsed is None else parsed.where("place < 0").groupBy("source", "mirror_rank").agg(F.max(F.try_element_at("f", F.lit("none"))).alias("none"))
        both = own.join(n, ["source", "mirror_rank"], "left").join(none, ["source", "mirror_rank"], "left")
        said = lambda names: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("source"))
        silent = F.coalesce(said(layouts.NO_PAGE), F.when(F.col("source").startswith("torznab:"), "empty_response"))
        failure = F.when(F.col("n_bodies") == 0, F.coalesce("error", silent))
        reason = F.when(F.col("n_bodies") > 0, F.coalesce("fault", F.when(F.col("none") != "", F.col("none")), F.when(F.col("none").isNull() & F.col("n").isNull(), said(layouts.NO_LISTING))))
        return both.select("source", "mirror_rank", F.coalesce("n", F.lit(0)).alias("n"), failure.alias("failure"), reason.alias("reason"))

    def _targets(self, page: int, providers: list[str] | None) -> list[str]:
        wanted = self.spark.createDataFrame([(p,) for p in providers], "id string") if providers else None
        return [t.id for t in federate.resolve(self.sources(), wanted, page).orderBy("rank").select("id").collect()]  # the registry's size

    def requests(self, query: str, page: int = 1, providers: list[str] | None = None) -> list[dict]:
        """What a live search asks at once, for every target and mirror."""
        own = {i["id"]: i for i in self.indexers.load()} if self.indexers else {}
        return [r for t in self._targets(page, providers) for r in requests_for(t, query, page, own.get(t))]

    def fetch(self, query: str, page: int = 1, providers: list[str] | None = None, timeout: float = TIMEOUT_S) -> DataFrame:
        """Pages of a live search, kept so that they are fetched once. The source with dependent requests is asked in two steps."""
        pages = fetch_pages(self.spark, self.requests(query, page, providers), timeout)
        if "anilibria" in self._targets(page, providers):
            pages = pages.unionByName(self._release_pages(query, timeout))
        return pages.persist()

    def _release_pages(self, query: str, timeout: float) -> DataFrame:
        """Pages of both steps of the source whose search gives releases and whose releases give listings, at each mirror."""
        first = fetch_pages(self.spark, release_requests(query), timeout).persist()
        asked: dict[int, list[int]] = {}
        for r in feeds.release_ids(first).orderBy("mirror_rank", "place").collect():  # at most 15 a mirror
            asked.setdefault(r.mirror_rank, []).append(r.id)
        return first.unionByName(fetch_pages(self.spark, [d for rank, ids in asked.items() for d in release_details(ids, rank)], timeout))

    def probe(self, indexer_id: str, timeout: float = 8.0) -> dict:
        """Whether an indexer answers a request for its capabilities, and how long the answer is."""
        own = self.indexers.get(indexer_id) if self.indexers else None
        if own is None:
            raise ValueError(f"no indexer {indexer_id}")
        url = feeds.indexer_query(own["url"], own.get("apiKey", ""), "", "caps")
        r = fetch_pages(self.spark, [{"source": indexer_id, "url": url}], timeout).first()
        return {"ok": r.error is None and bool(r.body), "length": len(r.body or ""), "error": r.error}

    def releases(self, query: str, timeout: float = TIMEOUT_S) -> DataFrame:
        """Raw listings of the source whose search gives releases and whose releases give listings."""
        return federate.first_mirror(self.raw(self._release_pages(query, timeout).persist(), "anilibria"), "provider")

    def pages(self, query: str, fetch: Callable[[str, int], DataFrame], most: int | None = None) -> Iterator[Response]:
        """Page after page, until one adds no new row or no source has more. What was seen is logged, so no earlier page is computed again."""
        log = SeenLog(self.spark)
        for number in count(1) if most is None else range(1, most + 1):
            r = self.search(query, fetch(query, number), number)
            if not log.add(log.unseen(r.results.select("id"))):
                return
            yield r
            if not r.has_more():
                return

    def search(self, query: str, pages: DataFrame, page: int = 1, providers: list[str] | None = None, match: bool | None = None) -> Response:
        """All targets' listings in registry order; a source's rows are those of its first mirror that has any.

        With ``match``, only listings whose name holds every token of the query count. By default that is so for stored
        tables (without the url column of fetched pages, which the sources themselves have searched).
        """
        if not query or not query.strip():
            raise ValueError("missing query")
        query, page = query.strip(), page_number(page)
        wanted = self.spark.createDataFrame([(p,) for p in providers], "id string") if providers else None
        targets = federate.resolve(self.sources(), wanted, page)
        ranks = {r.id: r["rank"] for r in targets.select("id", "rank").collect()}  # the registry's size
        present = [r[0] for r in pages.select("source").distinct().collect() if r[0] in ranks]
        parts, asked, match = [], None, "url" not in pages.columns if match is None else match
        parsed = self.stored(pages) if any(s in layouts.LAYOUTS for s in present) else None
        if present:
            raws = [self.raw(pages, s, parsed).withColumn("place", F.col("place").cast("long")).withColumn("mirror_rank", F.col("mirror_rank").cast("int")).withColumn("source_rank", F.lit(ranks[s])) for s in sorted(present, key=ranks.get)]
            asked = listings.normalize_all(raws, self.now_ms, "mirror_rank", "place", "source_rank")
            parts.append(asked.where(refine.matches(query)) if match else asked)
        if "demo" in ranks:
            pool = refine.page(demo.pool(self.spark, query, self.now_ms).orderBy("ord"), page, demo.PAGE)
            made = listings.normalize(pool, self.now_ms, "ord").withColumn("mirror_rank", F.lit(0)).withColumn("place", F.col("ord").cast("long")).drop("ord")
            parts.append(made.withColumn("source_rank", F.lit(ranks["demo"])))
        if not parts:
            empty = listings.normalize(self.spark.createDataFrame([], listings.RAW), self.now_ms)
            parts.append(empty.withColumns({c: F.lit(None).cast(k) for c, k in (("mirror_rank", "int"), ("place", "long"), ("source_rank", "int"))}))
        found = reduce(DataFrame.unionByName, parts)
        found = federate.first_mirror(found, "provider")
        ordered = found.withColumn("ord", F.struct(F.lit(page).alias("page"), "source_rank", "place"))
        failed = None
        if asked is not None:
            failed = federate.source_errors(self.attempts(pages.where(F.col("source").isin(present)), asked.select("provider", "mirror_rank"), parsed)).withColumnRenamed("source", "id")
        statuses = federate.status(targets, found, failed, pages)
        more = F.when(F.col("demo"), F.lit(demo.has_more(page))).otherwise(F.lit(None).cast("boolean"))
        return Response(query, page, ordered, statuses.withColumn("has_more", more))

    def stream(self, arrivals: DataFrame, on_source: Callable[[str, DataFrame, dict], None], search_id: int = 0, live: bool = False) -> Search:
        """Incremental search: ``arrivals`` is a stream of pages, in order of completion. For each source in a micro-batch, the
        quickest first where pages say how long they took, on_source gets its id, its listings and its status. It ends with what
        has arrived or, if ``live``, when it is cancelled. Cancelling the returned search drops what comes later;
        rows with another search_id, if there is such a column, belong to an older search and are dropped."""

        def each(pages: DataFrame, epoch: int) -> None:
            pages = pages.persist()
            try:
                took = F.max("ms") if "ms" in pages.columns else F.lit(None).cast("long")
                seen = pages.groupBy("source").agg(took.alias("ms")).orderBy(F.col("ms").asc_nulls_last(), "source").collect()  # a row per source
                parsed = self.parsed(pages)
                found = {s: listings.normalize(self.raw(pages, s, parsed), self.now_ms, "mirror_rank") for s, _ in seen}
                errors = {}
                if found:
                    every = reduce(DataFrame.unionByName, [rows.select("provider", "mirror_rank") for rows in found.values()])
                    errors = dict(federate.source_errors(self.attempts(pages, every, parsed)).collect())  # a row per source
                for source, ms in seen:
                    rows = federate.first_mirror(found[source], "provider")
                    n, error = rows.count(), errors.get(source)
                    on_source(source, rows, {"status": "error" if error else "ok", "count": n, "error": error, "ms": ms})
                parsed.unpersist()
            finally:
                pages.unpersist()

        return Search(arrivals, search_id, each, live)

    def live(self, query: str, on_source: Callable[[str, DataFrame, dict], None], page: int = 1, providers: list[str] | None = None, transport: Callable | None = None) -> None:
        """A search whose sources are reported as they complete: one task asks a source's mirrors, and its pages arrive when it is done.

        on_source as of ``stream``. transport: instead of the network, what gives the pages of a row (source, requests).
        """
        asked: dict[str, list[dict]] = {}
        for r in self.requests(query, page, providers):
            asked.setdefault(r["source"], []).append(r)
        if not asked:
            return
        rows = arrivals.a_task_each(self.spark, [(s, json.dumps(r)) for s, r in asked.items()], "source string, requests string")
        coming = arrivals.Arrivals(rows, transport, size=1)
        coming.finish(self.stream(coming.stream, on_source, live=True).query)
        coming.remove()

    def merge(self, *responses: Response) -> DataFrame:
        """Pages of one query as merged rows: first arrivals of each identifier, then one row per content hash."""
        rows = responses[0].results
        for r in responses[1:]:
            rows = rows.unionByName(r.results)
        return listings.merge_sources(listings.dedupe_first(rows))

    def new_rows(self, seen: DataFrame, response: Response) -> DataFrame:
        """What a further page adds; none means that paging ends."""
        return response.results.join(seen.select("id"), "id", "left_anti")

    facets = staticmethod(refine.facets)
    refine = staticmethod(refine.refine)
    export = staticmethod(sinks.write_csv)
    resolve = staticmethod(listings.resolve_magnets)
