"""Fetching as a stream: sources arrive in the order in which they complete.

A Spark job makes the requests; each task lands what it has fetched, whole, in a folder that all executors share. The streaming
source "landed_pages" turns the folder into a stream whose offset is the number of completed files: before
an offset is given out, the names it adds are written to a log beside the pages, so a batch that runs again reads the same pages.
"""

from __future__ import annotations

import io
import json
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from urllib.parse import quote, unquote

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from ..shared import delete, get, names, opened, put, work_dir
from ..sources.http import SCHEMA, TIMEOUT_S, fetch, prune_sources, sources_of

ARRIVED = f"{SCHEMA}, arrival long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Rows of a batch that are Python objects at a time: a batch has up to 10,000, whatever their pages' sizes.
ROWS_AT_ONCE = 64
#: Files that one task of the stream reads.
FILES_A_TASK = 16


def over_http(timeout: float = TIMEOUT_S) -> Callable[[dict], Iterable[tuple]]:
    """Transport that makes the requests listed in a row's ``requests`` (JSON), one after the other."""

    def run(row: dict) -> Iterator[tuple]:
        for request in json.loads(row["requests"]):
            yield fetch(request, timeout)

    return run


def _units(batches, size: int) -> Iterator[list[dict]]:
    """Consecutive rows of one source, ``size`` at most. A task that runs again cuts its rows alike."""
    rows = (r for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE) for r in b.slice(i, ROWS_AT_ONCE).to_pylist())
    for _, same in groupby(rows, lambda r: r["source"]):
        unit: list[dict] = []
        for r in same:
            unit.append(r)
            if len(unit) == size:
                yield unit
                unit = []
        if unit:
            yield unit


def stored_pages(requests: DataFrame, transport: Callable[[dict], Iterable[tuple]], size: int = 64) -> DataFrame:
    """Make all requests and wait; their pages as a table that reads the files of the sources that a query filters for."""
    spark = requests.sparkSession
    prune_sources(spark, LandedPages)
    folder = work_dir(spark, "stored")
    files, path = opened(folder)
    files.create_dir(f"{path}/pages", recursive=True)
    land(requests, folder, transport, size)
    return spark.read.format("landed_pages").option("folder", folder).load()


def land(requests: DataFrame, folder: str, transport: Callable[[dict], Iterable[tuple]], size: int = 64) -> None:
    """Make all requests (column source, and what the transport wants) and land their pages, up to ``size`` rows of one source in a file.

    transport: a row to its pages, as of http.SCHEMA; it should not raise, as a source's failure is a row. Files are
    named by time, task, number and source. A task that runs again leaves out what its first run landed, so a request may be made
    twice, but its pages arrive once.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        files, path = opened(folder)
        task = TaskContext.get().partitionId()
        there = {n.split("-", 1)[1] for n in names(files, f"{path}/pages")}
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
        landed = 0
        for n, unit in enumerate(_units(batches, size)):
            name = f"{task:06d}-{n:06d}-{quote(unit[0]['source'] or '', safe='')}.parquet"
            if name in there:
                continue
            rows = [page for row in unit for page in transport(row)]
            out = io.BytesIO()
            pq.write_table(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema), out)
            put(files, f"{path}/pages", f"{time.time_ns() // 1_000_000:015d}-{name}", out.getvalue())
            landed += 1
        yield pa.RecordBatch.from_arrays([pa.array([landed], pa.int64())], names=["landed"])

    requests.mapInArrow(run, "landed long").write.format("noop").mode("overwrite").save()


class _Files(InputPartition):
    def __init__(self, first: int, found: list[str]):
        super().__init__((first, found))
        self.first, self.found = first, found


class _Landed(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder, self.known = folder, None

    def _place(self):
        files, path = opened(self.folder)
        return files, f"{path}/pages", f"{path}/log"

    def _log(self) -> list[str]:
        """Names of the completed files in order; read once, as only this reader adds to it."""
        if self.known is None:
            files, _, log = self._place()
            self.known = [x for n in names(files, log) for x in get(files, log, n).decode().splitlines()]
        return self.known

    def initialOffset(self) -> dict:  # noqa: N802
        return {"completed": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files, pages, log = self._place()
        known = self._log()
        seen = set(known)
        new = [n for n in names(files, pages) if n not in seen]
        if new:
            put(files, log, f"{len(known) + len(new):012d}", "\n".join(new).encode())
            known.extend(new)
        return {"completed": len(known)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        chosen = self._log()[start["completed"] : end["completed"]]
        return [_Files(start["completed"] + i, chosen[i : i + FILES_A_TASK]) for i in range(0, len(chosen), FILES_A_TASK)]

    def read(self, partition: _Files):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, pages, _ = self._place()
        for i, name in enumerate(partition.found):
            table = pq.read_table(io.BytesIO(get(files, pages, name)))
            for batch in table.append_column("arrival", pa.array([partition.first + i] * table.num_rows, pa.int64())).combine_chunks().to_batches():
                yield batch


class _Stored(DataSourceReader):
    """The folder as a table: its files in the order of completion, but only those of the sources that are asked for."""

    def __init__(self, folder: str):
        self.stream, self.wanted = _Landed(folder), None

    def pushFilters(self, filters):  # noqa: N802
        self.wanted, rest = sources_of(filters, self.wanted)
        return rest

    def partitions(self) -> list[_Files]:
        files, pages, _ = self.stream._place()
        found = names(files, pages)
        return [_Files(i, [n]) for i, n in enumerate(found) if self.wanted is None or unquote(n.split("-", 3)[3].removesuffix(".parquet")) in self.wanted] or [_Files(0, [])]

    def read(self, partition: _Files):
        return self.stream.read(partition)


class LandedPages(DataSource):
    """Format "landed_pages", option folder: pages with ``arrival``, the place of their file in the order of completion; as a table or a stream."""

    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return ARRIVED

    def reader(self, schema):
        return _Stored(self.options["folder"])

    def streamReader(self, schema):  # noqa: N802
        return _Landed(self.options["folder"])


class Arrivals:
    """Requests under way in a job of their own; ``stream`` has their pages as they complete."""

    def __init__(self, requests: DataFrame, transport: Callable[[dict], Iterable[tuple]] | None = None, size: int = 64):
        spark = requests.sparkSession
        prune_sources(spark, LandedPages)
        self.spark, self.folder, self.failure = spark, work_dir(spark, "arrivals"), None
        files, path = opened(self.folder)
        files.create_dir(f"{path}/pages", recursive=True)
        self.stream = spark.readStream.format("landed_pages").option("folder", self.folder).load()

        def run() -> None:
            try:
                land(requests, self.folder, transport or over_http(), size)
            except Exception as e:  # noqa: BLE001  raised where the search is awaited
                self.failure = e

        self.job = InheritableThread(run, session=spark)
        self.job.start()

    def finish(self, query: StreamingQuery) -> None:
        """Wait until every request has completed and the query has read its page, then end the query."""
        self.job.join()
        if self.failure is None:
            query.processAllAvailable()
        query.stop()
        if self.failure is not None:
            raise self.failure

    def pages(self) -> DataFrame:
        """What has landed so far, as a table."""
        return self.spark.read.format("landed_pages").option("folder", self.folder).load()

    def remove(self) -> None:
        delete(self.spark, self.folder)


def a_task_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows, each in a partition of its own, so that none waits for another."""
    df = spark.createDataFrame(rows, schema)
    return df.coalesce(1).repartition(max(1, len(rows))) if rows else df


def completions(arrived: DataFrame) -> DataFrame:
    """source, place (from 1, by the first page to arrive), n_pages, n_bytes, error: of pages as landed."""
    from pyspark.sql import Window

    by_source = arrived.groupBy("source").agg(F.min("arrival").alias("first"), F.count("*").alias("n_pages"), F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)).alias("n_bytes"), F.max("error").alias("error"))
    return by_source.select("source", F.row_number().over(Window.orderBy("first", "source")).cast("long").alias("place"), "n_pages", "n_bytes", "error")  # a row per source
