"""The merge of a stream. A search that goes on has keyed state: a batch emits the keys that it changes, and nothing else is written.
A stream that ends is merged without state: batches leave partial merges (``run_merge``).

With state, rows are first combined within their tasks, so that a very frequent content hash reaches its key as a
few partial rows; then each (search, key) keeps its merged numbers in a state of its own, which ends some time after the search last
added to it. Texts aren't in the state: a change brings them when they are new. The changes are appended; what they come to is the merged table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.listings import merge_key
from ..shared import delete, work_dir

#: Taken from the first row to arrive, null or not; and from the first that knows them.
FIRST = {"name": "string", "category": "string", "info_hash": "string"}
KNOWN = {"size": "long", "date_ms": "long", "files": "long", "magnet": "string"}
#: What is long and stays as it is: not in the state, but with the change that brought it.
TEXTS = [*FIRST, "magnet"]
_NUMBERS = "ord long, size long, date_ms long, files long, " + ", ".join(f"{c}_ord long" for c in KNOWN) + ", seeders long, leechers long, n_details long, n_rows long"
STATE = _NUMBERS
PARTIAL = f"search_id long, key string, {_NUMBERS}, " + ", ".join(f"{c} string" for c in TEXTS)
CHANGE = f"{PARTIAL}, new_first boolean, new_magnet boolean"
NAMES = [c.strip().split()[0] for c in STATE.split(",")]


def joined(a: dict, b: dict) -> dict:
    """Two partial merges as one; in any order, as first arrivals are told by ord."""
    early, late = (b, a) if b["ord"] < a["ord"] else (a, b)
    out = {"ord": early["ord"]} | {c: early[c] for c in FIRST}
    for c in KNOWN:
        at = f"{c}_ord"
        one = early if late[at] is None or (early[at] is not None and early[at] <= late[at]) else late
        out |= {c: one[c], at: one[at]}
    for c in ("seeders", "leechers"):
        out[c] = max((x for x in (a[c], b[c]) if x is not None), default=None)
    return out | {c: a[c] + b[c] for c in ("n_details", "n_rows")}


def partial_rows(listings: DataFrame, order: str = "ord") -> DataFrame:
    """Each listing as a merge of one row."""
    o = F.col(order).cast("long")
    known = [F.when(F.col(c).isNotNull(), o).alias(f"{c}_ord") for c in KNOWN]
    search = F.col("search_id").cast("long") if "search_id" in listings.columns else F.lit(0).cast("long")
    own = {c: F.col(c).cast(k).alias(c) for c, k in (FIRST | KNOWN).items()}
    counts = [F.col("seeders").cast("long").alias("seeders"), F.col("leechers").cast("long").alias("leechers"), F.col("detail_url").isNotNull().cast("long").alias("n_details"), F.lit(1).cast("long").alias("n_rows")]
    return listings.select(search.alias("search_id"), merge_key().alias("key"), o.alias("ord"), *[own[c] for c in ("size", "date_ms", "files")], *known, *counts, *[own[c] for c in TEXTS])


def combined(partials: DataFrame) -> DataFrame:
    """Rows of one key in one Arrow batch become one: what a map-side combine does for an aggregate."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found: dict[tuple, dict] = {}
            for r in batch.to_pylist():
                k = r["search_id"], r["key"]
                found[k] = joined(found[k], r) if k in found else r
            rows = [{**v, "search_id": k[0], "key": k[1]} for k, v in found.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return partials.mapInArrow(run, PARTIAL)


class MergeState(StatefulProcessor):
    """One merged row per (search, key). A key that no row has reached for ``ttl_ms`` is dropped: its search is over."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.merged = handle.getValueState("merged", STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = dict(zip(NAMES, self.merged.get())) | dict.fromkeys(TEXTS) if self.merged.exists() else None
        now = before
        for r in rows:
            r = r.asDict()
            now = joined(now, r) if now else {c: r[c] for c in [*NAMES, *TEXTS]}
        self.merged.update(tuple(now[c] for c in NAMES))
        first = before is None or now["ord"] < before["ord"]
        magnet = now["magnet_ord"] is not None and (before is None or now["magnet_ord"] != before["magnet_ord"])
        texts = {c: now[c] if (magnet if c == "magnet" else first) else None for c in TEXTS}
        yield Row(search_id=key[0], key=key[1], **{c: now[c] for c in NAMES}, **texts, new_first=first, new_magnet=magnet)

    def close(self) -> None:
        pass


def merge_changes(listings: DataFrame, ttl_ms: int | None = None, order: str = "ord") -> DataFrame:
    """A stream of listings to a stream of merged rows, in update mode: per batch the keys that the batch has changed.

    With ``ttl_ms`` the state of a search ends so long after its last rows. Such a query runs until it is stopped,
    as time alone can change its state; without, it can also run over what there is.
    """
    return combined(partial_rows(listings, order)).groupBy("search_id", "key").transformWithState(MergeState(ttl_ms), CHANGE, "Update", "ProcessingTime" if ttl_ms else "None")


class Upserts:
    """The changes of a running merge, a folder a batch; ``table`` is what they come to."""

    def __init__(self, spark: SparkSession, compact_every: int = 16):
        self.spark, self.base, self.compact_every = spark, work_dir(spark, "upserts"), compact_every
        self.compacted = -1
        self.live: list[tuple[int, str]] = []
        self.written: list[tuple[int, int]] = []

    def keep(self, changes: DataFrame, epoch: int) -> None:
        """Write one batch's changes; one that runs again replaces its own folder. Every ``compact_every`` folders become one."""
        if epoch <= self.compacted:  # it ran again, and its rows are in the whole already
            return
        path = f"{self.base}/batch={epoch}"
        changes.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("compression", "zstd").parquet(path)
        n = self.spark.read.parquet(path).count()
        self.written.append((epoch, n))
        if n and (epoch, path) not in self.live:
            self.live.append((epoch, path))
        if len(self.live) > self.compact_every:
            whole = f"{self.base}/whole-{epoch}"
            self._newest(changes.schema).write.mode("overwrite").option("compression", "zstd").parquet(whole)
            self.live, self.compacted = [(epoch, whole)], epoch

    def _newest(self, schema: StructType) -> DataFrame:
        """The newest numbers of each key, with the texts of the changes that brought its first row and its magnet."""
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(*[p for _, p in self.live])
        numbers = [c for c in NAMES if c != "magnet"]
        whole = rows.groupBy("search_id", "key").agg(
            F.max_by(F.struct(*numbers, "epoch"), "epoch").alias("now"), F.max_by(F.struct(*FIRST), F.when(F.col("new_first"), F.col("epoch"))).alias("first"), F.max_by("magnet", F.when(F.col("new_magnet"), F.col("epoch"))).alias("magnet")
        )
        there = F.col("now.magnet_ord").isNotNull()
        return whole.select("search_id", "key", *[f"now.{c}" for c in numbers], *[f"first.{c}" for c in FIRST], F.when(there, F.col("magnet")).alias("magnet"), F.lit(True).alias("new_first"), there.alias("new_magnet"), "now.epoch")

    def table(self, schema: StructType) -> DataFrame:
        """The merged rows as they stand."""
        whole = self._newest(schema) if self.live else self.spark.createDataFrame([], schema).withColumn("epoch", F.lit(None).cast("long"))
        return whole.drop("new_first", "new_magnet", "epoch")


def merged(partials: DataFrame) -> DataFrame:
    """Partial merges as one for each (search, key), in any grouping and order: ``joined`` as an aggregate."""
    first, known = F.min_by(F.struct(*FIRST), "ord").alias("_first"), [F.min_by(c, f"{c}_ord").alias(c) for c in KNOWN]
    numbers = [F.min("ord").alias("ord"), *[F.min(f"{c}_ord").alias(f"{c}_ord") for c in KNOWN], *[F.max(c).alias(c) for c in ("seeders", "leechers")], *[F.sum(c).alias(c) for c in ("n_details", "n_rows")]]
    return partials.groupBy("search_id", "key").agg(first, *known, *numbers).select("search_id", "key", *NAMES, *[f"_first.{c}" for c in FIRST], "magnet")


class Partials:
    """What each batch comes to, a folder a batch: its own rows merged by key, and nothing of the batches before. ``table`` merges the folders, once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, work_dir(spark, "partials")
        self.written: list[tuple[int, int]] = []

    def keep(self, partials: DataFrame, epoch: int) -> None:
        """Write one batch; one that runs again replaces its own folder."""
        path = f"{self.base}/batch-{epoch}"
        merged(partials).write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.written = [(e, n) for e, n in self.written if e != epoch] + [(epoch, self.spark.read.schema(PARTIAL).parquet(path).count())]

    def table(self) -> DataFrame:
        """The merged rows as they stand."""
        paths = [f"{self.base}/batch-{epoch}" for epoch, _ in self.written]
        return merged(self.spark.read.schema(PARTIAL).parquet(*paths) if paths else self.spark.createDataFrame([], PARTIAL))


def run_merge(listings: DataFrame, order: str = "ord") -> tuple[DataFrame, Partials]:
    """Run the merge over what the stream has; the merged table, and what each batch wrote.

    A run that ends needs no state: every text is written once by its batch and read once for the table, however many batches there are.
    """
    spark = listings.sparkSession
    sink, state = Partials(spark), work_dir(spark, "merge")
    partial_rows(listings, order).writeStream.option("checkpointLocation", f"{state}/checkpoint").foreachBatch(sink.keep).trigger(availableNow=True).start().awaitTermination()
    delete(spark, state)
    return sink.table(), sink


def start_merge(changes: DataFrame, sink: Upserts, state: str, **trigger) -> StreamingQuery:
    """A running merge that upserts into the sink; ``state`` is the folder of its checkpoint.

    The state is in RocksDB, of which the query keeps the last two versions: what a restart needs.
    """
    conf = changes.sparkSession.conf
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.minBatchesToRetain": "2"}
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        return changes.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").foreachBatch(sink.keep).trigger(**trigger).start()
    finally:  # the query has taken the settings with it
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
