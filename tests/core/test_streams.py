"""Fetching as a stream and the merge as keyed state."""

import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from gleanfold.engine import Engine
from gleanfold.shared import get, names, opened
from gleanfold.streaming import arrivals, upserts

NOW = 1_749_988_800_000
PAGES = "source string, url string, body string, error string"


def answered(row):
    yield row["source"], 0, row["url"], 200, row["body"], None, row["error"], 1


def test_landed_pages(spark):
    rows = [(f"s{i % 3}", f"u{i}", f"body {i}" * (i % 4), None if i % 5 else "ETIMEDOUT") for i in range(40)]
    asked = spark.createDataFrame(rows, PAGES).repartition(4).sortWithinPartitions("source")
    live = arrivals.Arrivals(asked, answered, size=3)
    seen, batches = [], []

    def keep(df, epoch):
        got = df.collect()
        batches.append(len(got))
        seen.extend(got)

    live.finish(live.stream.writeStream.foreachBatch(keep).trigger(processingTime="100 milliseconds").start())
    assert sorted((r.source, r.url, r.body, r.error) for r in seen) == sorted(rows)
    assert sorted({r.arrival for r in seen}) == list(range(len({r.arrival for r in seen})))
    files, path = opened(live.folder)
    order = [x for n in names(files, f"{path}/log") for x in get(files, f"{path}/log", n).decode().splitlines()]
    assert len(order) == len(names(files, f"{path}/pages")) == max(r.arrival for r in seen) + 1
    # another reader of the same folder, as after a restart, plans the same files for the same offsets
    again = arrivals._Landed(live.folder)
    assert again.latestOffset() == {"completed": len(order)}
    assert [x for p in again.partitions({"completed": 1}, {"completed": len(order)}) for x in p.found] == order[1:]
    # a job that runs again lands nothing twice
    arrivals.land(asked, live.folder, answered, size=3)
    assert len(names(files, f"{path}/pages")) == len(order)
    live.remove()
    assert names(files, f"{path}/pages") == []


def test_a_batch_is_taken_in_slices():
    """A large batch is never whole as Python objects; its units are as before."""
    import pyarrow as pa

    class Batch:
        def __init__(self, rows):
            self.rows, self.num_rows = rows, rows.num_rows

        def slice(self, at, n):
            return Batch(self.rows.slice(at, n))

        def to_pylist(self):
            assert self.num_rows <= arrivals.ROWS_AT_ONCE
            return self.rows.to_pylist()

    rows = pa.RecordBatch.from_pylist([{"source": f"s{i // 400}", "url": str(i)} for i in range(1000)])
    units = list(arrivals._units([Batch(rows)], 256))
    assert [len(u) for u in units] == [256, 144, 256, 144, 200] and [r["url"] for u in units for r in u] == [str(i) for i in range(1000)]


def test_completion_order(spark):
    """Sources arrive as they complete, whatever their place among the requests, and before the slowest is done."""
    began = time.time() + 3

    def slow(row):
        time.sleep(max(0.0, began + float(row["body"]) - time.time()))
        yield row["source"], 0, row["url"], 200, row["body"], None, None, 1

    rows = [(f"s{k}", "u", str(w), None) for k, w in enumerate([2.4, 0.0, 3.2, 0.8, 1.6])]
    live = arrivals.Arrivals(arrivals.a_task_each(spark, rows, PAGES), slow, size=1)
    seen = []
    live.finish(live.stream.writeStream.foreachBatch(lambda df, epoch: seen.extend((r.source, r.arrival, epoch) for r in df.collect())).trigger(processingTime="100 milliseconds").start())
    assert [s for s, _, _ in sorted(seen, key=lambda x: x[1])] == ["s1", "s3", "s4", "s0", "s2"]
    assert len({epoch for _, _, epoch in seen}) > 1


def test_filters_on_the_source_plan_its_files_only(spark):
    rows = [(f"s/{i % 4}", f"u{i}", f"body {i}", None) for i in range(40)]
    asked = spark.createDataFrame(rows, PAGES).repartition(3).sortWithinPartitions("source")
    stored = arrivals.stored_pages(asked, answered, size=100)
    assert stored.rdd.getNumPartitions() == 12  # four sources in each of three tasks
    for some in (stored.where("source = 's/2'"), stored.where(F.col("source").isin("s/2", "s/9")), stored.where("source = 's/2' AND source IN ('s/2', 's/3') AND length(url) > 0")):
        assert some.rdd.getNumPartitions() == 3 and sorted(r.url for r in some.collect()) == sorted(f"u{i}" for i in range(40) if i % 4 == 2)
    assert stored.where("source = 's/2' AND source = 's/3'").count() == 0 and stored.where("source IS NULL").count() == 0
    assert stored.where("source = 's/1' OR url = 'u2'").count() == 11


def test_filters_spare_requests(spark):
    from gleanfold.sources.http import fetch_pages

    pages = fetch_pages(spark, [{"source": f"s{i % 3}", "url": f"http://127.0.0.1:9/{i}"} for i in range(9)], timeout=1)
    assert pages.rdd.getNumPartitions() == 9 and pages.where("source = 's1'").rdd.getNumPartitions() == 3
    assert {r.url[-1] for r in pages.where("source = 's1'").collect()} == {"1", "4", "7"}


def test_failing_transport(spark):
    def broken(row):
        raise ValueError("no transport")

    live = arrivals.Arrivals(spark.createDataFrame([("s", "u", "b", None)], PAGES), broken)
    with pytest.raises(Exception, match="no transport"):
        live.finish(live.stream.writeStream.foreachBatch(lambda df, epoch: None).start())


def test_live_search(spark):
    body = json.dumps([{"id": "7", "name": "Quill lamp", "info_hash": "A" * 40, "seeders": "3", "leechers": "1", "size": "1048576", "num_files": "2", "added": "1600000000", "category": "303"}])

    def stored(row):
        for r in json.loads(row["requests"]):
            yield r["source"], r.get("mirror_rank", 0), r["url"], 200, body if r["source"] == "tpb" else None, None, None if r["source"] == "tpb" else "ETIMEDOUT", 5

    got = {}
    Engine(spark, NOW).live("quill", lambda s, df, status: got.update({s: ([r.name for r in df.collect()], status["status"])}), providers=["tpb", "torrentscsv"], transport=stored)
    assert got == {"tpb": (["Quill lamp"], "ok"), "torrentscsv": ([], "error")}


LISTED = "id string, name string, info_hash string, size long, seeders long, leechers long, date_ms long, category string, files long, magnet string, detail_url string, ord long, search_id long"


def listing(i, key, search=1, **more):
    row = {"id": f"i{i}", "name": f"n{i}", "info_hash": key, "ord": i, "search_id": search} | more
    return tuple(row.get(c.split()[0]) for c in LISTED.split(", "))


def test_joined_in_any_order():
    names = "ord name category info_hash size date_ms files magnet size_ord date_ms_ord files_ord magnet_ord seeders leechers n_details n_rows".split()
    rows = [dict(zip(names, r)) for r in [(3, "c", None, "h", 9, None, None, "m", 3, None, None, 3, 1, None, 0, 1), (1, "a", "x", "h", None, 5, None, None, None, 1, None, None, 4, 2, 1, 1), (2, "b", "y", "H", 8, 6, 7, None, 2, 2, 2, None, None, 9, 0, 1)]]
    want = None
    for order in itertools.permutations(rows):
        got = upserts.joined(upserts.joined(order[0], order[1]), order[2])
        want = want or got
        assert got == want
    assert (want["ord"], want["name"], want["category"], want["size"], want["date_ms"], want["files"], want["magnet"], want["seeders"], want["leechers"], want["n_details"], want["n_rows"]) == (1, "a", "x", 8, 5, 7, "m", 4, 9, 1, 3)


def test_batches_write_changed_keys_only(spark, tmp_path):
    rows = [[listing(i, f"h{i}") for i in range(30)], [listing(100, "h3", size=5, seeders=9), listing(101, "new")], [listing(200 + i, "h3") for i in range(50)]]
    for k, part in enumerate(rows):  # one file a batch; the last is a third of all rows under one key
        spark.createDataFrame(part, LISTED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merged, sink = upserts.run_merge(stream)
    assert [n for _, n in sorted(sink.written)] == [30, 2, 1]
    got = {r.key: r for r in merged.collect()}
    assert len(got) == 31 and (got["hash:h3"].n_rows, got["hash:h3"].name, got["hash:h3"].size, got["hash:h3"].seeders) == (52, "n3", 5, 9)


def test_compaction_keeps_the_table(spark, tmp_path):
    sink = upserts.Upserts(spark, compact_every=2)
    for epoch in range(6):
        part = upserts.combined(upserts.partial_rows(spark.createDataFrame([listing(0, "h", seeders=epoch, magnet="m")], LISTED))).withColumn("n_rows", F.lit(epoch + 1).cast("long"))
        part = part.withColumn("new_first", F.lit(epoch == 0)).withColumn("new_magnet", F.lit(epoch == 0))
        if epoch:  # texts come with the change that brought them
            part = part.withColumns({c: F.lit(None).cast("string") for c in upserts.TEXTS})
        sink.keep(part, epoch)
        sink.keep(part, epoch)  # the batch ran again
    table = sink.table(part.schema).collect()
    assert len(table) == 1 and len(sink.live) <= 3
    assert (table[0].n_rows, table[0].seeders, table[0].name, table[0].magnet) == (6, 5, "n0", "m")


def test_every_batch_is_written_once(spark, tmp_path):
    """What a batch writes doesn't grow with the batches before it, and a row that comes twice counts twice, as in the batch merge."""
    from gleanfold.plans.queries import stream_merge_final

    for k in range(4):
        rows = [(100 * k + i, f"text {k} {i} " * 50, "en", "src1", 300) for i in range(20)] + [(7000, "again", "en", "src1", 5)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r.n_rows for r in stream_merge_final(spark, str(tmp_path)).collect()}
    assert len(got) == 81 and got["again"] == 4 and set(got.values()) == {1, 4}
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(LISTED).parquet(f"{tmp_path}/none")
    _, sink = upserts.run_merge(stream)
    assert sink.written == [] and sink.table().count() == 0


def test_merged_equals_joined(spark):
    rows = [listing(3, "h", size=9, magnet="m", seeders=1), listing(1, "h", category="x", date_ms=5, seeders=4, leechers=2, detail_url="d"), listing(2, "H", category="y", size=8, date_ms=6, files=7, leechers=9)]
    part = upserts.partial_rows(spark.createDataFrame(rows, LISTED))
    for whole in (upserts.merged(part), upserts.merged(upserts.merged(part.where("ord < 3")).unionByName(upserts.merged(part.where("ord = 3"))))):
        r = whole.collect()
        assert len(r) == 1 and (r[0].ord, r[0].name, r[0].category, r[0].size, r[0].date_ms, r[0].files, r[0].magnet, r[0].seeders, r[0].leechers, r[0].n_details, r[0].n_rows) == (1, "n1", "x", 8, 5, 7, "m", 4, 9, 1, 3)


def test_state_of_a_search_ends(spark, tmp_path):
    spark.createDataFrame([listing(1, "h", 1)], LISTED).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes, sink = upserts.merge_changes(stream, ttl_ms=2_000), upserts.Upserts(spark)
    q = upserts.start_merge(changes, sink, f"file://{tmp_path}/state", processingTime="500 milliseconds")

    def until(search, order):
        """Wait for the row of that search whose first arrival has that ord."""
        for _ in range(400):
            found = [r for r in sink.table(changes.schema).collect() if r.search_id == search and r.ord == order]
            if found:
                return found[0]
            time.sleep(0.3)
        raise AssertionError("the row hasn't come")

    try:
        assert until(1, 1).n_rows == 1
        time.sleep(6)  # by now the state has ended
        spark.createDataFrame([listing(4, "h", 1), listing(5, "h", 2)], LISTED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert until(1, 4).n_rows == until(2, 5).n_rows == 1
    finally:
        q.stop()
