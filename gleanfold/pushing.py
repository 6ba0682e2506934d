"""Pushing to download clients as a Spark writer with a ledger of what was sent.

    push_once(merged, "qbittorrent", config, ledger)      # a folder that all executors share

A magnet that the ledger has is not sent again. A task sends its magnets in chunks: it notes a chunk before it sends it, and what
came of it afterwards. So a task that runs again sends only what no run has begun; a chunk that was begun but has no outcome, as its
executor was lost meanwhile, is left out by default and counted as unknown (``unsure="send"`` sends it again).
"""

from __future__ import annotations

import importlib
import io
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import sinks
from .shared import get, names, opened, put

LEDGER = "job string, digest string, taken boolean"


@dataclass
class Pushed(WriterCommitMessage):
    taken: int = 0
    refused: int = 0
    unknown: int = 0


def _callable(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.client, self.config, self.ledger, self.job = options["client"], json.loads(options["config"]), options["ledger"], options["job"]
        self.chunk, self.unsure, self.send = int(options.get("chunk", 1)), options.get("unsure", "skip"), options.get("send", "gleanfold.sinks:http_send")

    def write(self, iterator) -> Pushed:
        from pyspark import TaskContext

        add, send, message = sinks.CLIENTS[self.client], _callable(self.send), Pushed()
        files, path = opened(self.ledger)
        prefix = f"{self.job}-{TaskContext.get().partitionId():06d}-"
        begun, done = ({n for n in names(files, f"{path}/{kind}") if n.startswith(prefix)} for kind in ("begun", "done"))
        rows = (row for batch in iterator for row in zip(batch.column("digest").to_pylist(), batch.column("line").to_pylist()))
        for n, part in enumerate(_chunks(rows, self.chunk)):
            name = f"{prefix}{n:08d}.parquet"
            if name in done:
                taken = _outcomes(get(files, f"{path}/done", name))
            elif (name in begun or not put(files, f"{path}/begun", name, b"")) and self.unsure == "skip":
                message.unknown += len(part)
                continue
            else:
                taken = [_one(add, self.config, line, send) for _, line in part]
                put(files, f"{path}/done", name, _table(self.job, [d for d, _ in part], taken))
            message.taken += sum(taken)
            message.refused += len(taken) - sum(taken)
        return message

    def commit(self, messages) -> None:
        files, path = opened(self.ledger)
        total = {k: sum(getattr(m, k) for m in messages if m) for k in ("taken", "refused", "unknown")}
        put(files, f"{path}/jobs", f"{self.job}.json", json.dumps(total).encode())

    def abort(self, messages) -> None:
        """What was sent stays sent, and in the ledger; the same job can be run again."""


def _chunks(rows, size: int):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _one(add, config: dict, line: str, send) -> bool:
    try:
        return bool(add(config, line, send))
    except (OSError, ValueError):
        return False


def _table(job: str, digests: list[str], taken: list[bool]) -> bytes:
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.table({"job": [job] * len(digests), "digest": digests, "taken": taken}), out)
    return out.getvalue()


def _outcomes(content: bytes) -> list[bool]:
    import pyarrow.parquet as pq

    return pq.read_table(io.BytesIO(content), columns=["taken"]).column("taken").to_pylist()


class ListingPush(DataSource):
    """df.write.format("listing_push").options(client, config, ledger, job, ...).mode("append").save(), of columns digest and line."""

    @classmethod
    def name(cls):
        return "listing_push"

    def schema(self):
        return "digest string, line string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """job, digest and outcome of every magnet that was sent."""
    files, path = opened(ledger)
    return spark.read.schema(LEDGER).parquet(f"{ledger}/done") if names(files, f"{path}/done") else spark.createDataFrame([], LEDGER)


def push_once(merged: DataFrame, client: str, config: dict, ledger: str, job: str | None = None, chunk: int = 1, unsure: str = "skip", send: str = "gleanfold.sinks:http_send", tasks: int | None = None) -> dict:
    """Push each different magnet that the ledger doesn't have as taken; returns how many were taken, refused and left as unknown.

    ``job`` names the run: one that broke off is taken up under its name. ``chunk`` magnets share an entry of the
    ledger, so at most so many are unknown when an executor is lost. ``send`` is the transport, as module:name. ``tasks`` bounds the clients' load.
    """
    if client not in sinks.CLIENTS:
        raise ValueError(f"unknown client {client}")
    spark = merged.sparkSession
    spark.dataSource.register(ListingPush)
    job = job or uuid.uuid4().hex
    files, path = opened(ledger)
    files.create_dir(path, recursive=True)
    lines = sinks.magnet_lines(merged).select(F.sha2("line", 256).alias("digest"), "line").dropDuplicates(["digest"])
    sent = ledger_rows(spark, ledger).where((F.col("job") != job) & F.col("taken")).select("digest").distinct()
    todo = lines.join(sent, "digest", "left_anti")
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = todo.repartition(n, "digest").sortWithinPartitions("digest")  # a task that runs again has the same rows in the same order
    todo.write.format("listing_push").options(client=client, config=json.dumps(config), ledger=ledger, job=job, chunk=chunk, unsure=unsure, send=send).mode("append").save()
    return json.loads(get(files, f"{path}/jobs", f"{job}.json"))
