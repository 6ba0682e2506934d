"""Results out of the engine: CSV lines, magnet lists, server-sent events, JSON, and clients that take magnets."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exported columns and their headings.
CSV_COLUMNS = ["name", "seeders", "leechers", "size_text", "date_text", "category", "providers", "info_hash", "magnet"]
CSV_HEADINGS = ["名称", "做种", "下载", "大小", "时间", "分类", "来源", "infoHash", "磁力"]


def csv_cell(c: Column) -> Column:
    """Null is empty; a cell that a spreadsheet would take for a formula gets a quote mark before it."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(merged: DataFrame) -> DataFrame:
    cells = [csv_cell(F.array_join("providers", " | ") if c == "providers" else F.col(c)) for c in CSV_COLUMNS]
    return merged.withColumn("line", F.concat_ws(",", *cells))


def write_csv(merged: DataFrame, path: str, order: str = "ord") -> None:
    """Sorted part files of CRLF lines; the heading, with a byte-order mark, is the first line of the first."""
    spark = merged.sparkSession
    head = spark.createDataFrame([(None, "\ufeff" + ",".join(CSV_HEADINGS))], f"{order} {dict(merged.dtypes)[order]}, line string")
    lines = head.unionByName(csv_lines(merged).select(order, "line")).orderBy(F.col(order).asc_nulls_first())
    lines.select("line").write.option("lineSep", "\r\n").text(path)


def magnet_lines(merged: DataFrame) -> DataFrame:
    """Magnets to copy, one a line; rows without one are left out."""
    return merged.where("magnet IS NOT NULL").select("ord", F.col("magnet").alias("line"))


def sse_events(statuses: DataFrame, event: str = "provider") -> DataFrame:
    payload = F.to_json(F.struct(*statuses.columns))
    return statuses.select(F.concat(F.lit(f"event: {event}\ndata: "), payload, F.lit("\n\n")).alias("frame"))


def response_json(merged: DataFrame) -> DataFrame:
    return merged.select("ord", F.to_json(F.struct(*merged.columns)).alias("body"))


Send = Callable[[str, bytes | None, dict], tuple[int, dict, bytes]]


def http_send(url: str, body: bytes | None, headers: dict, timeout: float = 10.0) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def _form(**fields: str) -> bytes:
    return urllib.parse.urlencode(fields).encode()


def _at(config: dict, path: str) -> str:
    url = config["url"].rstrip("/")
    return url if url.endswith(path) else url + path


def _qbittorrent(config: dict, magnet: str | None, send: Send) -> bool:
    """Log in for a session cookie, then add; without a magnet, the login alone."""
    kind = {"Content-Type": "application/x-www-form-urlencoded", "Referer": config["url"]}
    code, headers, _ = send(_at(config, "/api/v2/auth/login"), _form(username=config.get("user", ""), password=config.get("password", "")), kind)
    cookie = next((v.split(";")[0] for k, v in headers.items() if k.lower() == "set-cookie" and "SID=" in v), None)
    if code != 200 or cookie is None:
        return False
    if magnet is None:
        return True
    code, _, text = send(_at(config, "/api/v2/torrents/add"), _form(urls=magnet), kind | {"Cookie": cookie})
    return code == 200 and not text.startswith(b"Fails")


def _transmission(config: dict, magnet: str | None, send: Send) -> bool:
    call = {"method": "session-get"} if magnet is None else {"method": "torrent-add", "arguments": {"filename": magnet}}
    url, body, headers = _at(config, "/transmission/rpc"), json.dumps(call).encode(), {"Content-Type": "application/json"}
    if config.get("user"):
        headers["Authorization"] = "Basic " + base64.b64encode(f"{config['user']}:{config.get('password', '')}".encode()).decode()
    code, given, text = send(url, body, headers)
    if code == 409:  # it wants its session's number back
        session = {k.lower(): v for k, v in given.items()}.get("x-transmission-session-id", "")
        code, _, text = send(url, body, headers | {"X-Transmission-Session-Id": session})
    return code == 200 and json.loads(text or b"{}").get("result") == "success"


def _aria2(config: dict, magnet: str | None, send: Send) -> bool:
    token = [f"token:{config['secret']}"] if config.get("secret") else []
    method, extra = ("aria2.getVersion", []) if magnet is None else ("aria2.addUri", [[magnet]])
    body = json.dumps({"jsonrpc": "2.0", "id": "1", "method": method, "params": token + extra}).encode()
    code, _, text = send(_at(config, "/jsonrpc"), body, {"Content-Type": "application/json"})
    return code == 200 and "error" not in json.loads(text or b'{"error": 1}')


def _gopeed(config: dict, magnet: str | None, send: Send) -> bool:
    headers = {"Content-Type": "application/json"} | ({"X-Api-Token": config["secret"]} if config.get("secret") else {})
    body = None if magnet is None else json.dumps({"req": {"url": magnet}}).encode()
    code, _, text = send(_at(config, "/api/v1/tasks"), body, headers)
    return code == 200 and (magnet is None or json.loads(text or b'{"code": 1}').get("code") == 0)


CLIENTS: dict[str, Callable[[dict, str | None, Send], bool]] = {"qbittorrent": _qbittorrent, "transmission": _transmission, "aria2": _aria2, "gopeed": _gopeed}
# Where clients listen by default, in order of trial.
CANDIDATES = [
    {"client": "qbittorrent", "url": "http://localhost:8080", "user": "admin", "password": "adminadmin"},
    {"client": "qbittorrent", "url": "http://localhost:8080", "user": "admin", "password": ""},
    {"client": "qbittorrent", "url": "http://127.0.0.1:8080", "user": "admin", "password": "adminadmin"},
    {"client": "qbittorrent", "url": "http://localhost:8081", "user": "admin", "password": "adminadmin"},
    {"client": "transmission", "url": "http://localhost:9091"},
    {"client": "transmission", "url": "http://127.0.0.1:9091"},
    {"client": "aria2", "url": "http://localhost:16800/jsonrpc"},
    {"client": "aria2", "url": "http://localhost:6800/jsonrpc"},
    {"client": "gopeed", "url": "http://localhost:9999"},
]


def _client(name: str):
    if name not in CLIENTS:
        raise ValueError(f"unknown client {name}")
    return CLIENTS[name]


def reachable(client: str, config: dict, send: Send = http_send) -> bool:
    """Whether the client answers to this configuration; a failure is just a no."""
    try:
        return bool(_client(client)(config, None, send))
    except (OSError, json.JSONDecodeError):
        return False


def detect(send: Send = http_send) -> dict | None:
    """The first of the candidates, in order, that answers."""
    return next((c for c in CANDIDATES if reachable(c["client"], c, send)), None)


def push(client: str, config: dict, magnets: Iterable[str], send: Send = http_send) -> int:
    """Hand magnets to a client one after the other; returns how many it took. A failure doesn't stop the rest."""
    add, taken = _client(client), 0
    for m in magnets:
        try:
            taken += bool(add(config, m, send))
        except (OSError, json.JSONDecodeError):
            continue
    return taken


def push_rows(merged: DataFrame, client: str, config: dict, send: Send = http_send) -> int:
    """Push every row's magnet, partition by partition; returns how many were taken.

    A task that is run again pushes again; clients take a known magnet only once.
    """
    _client(client)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"taken": [push(client, config, pdf.line, send)]})

    return magnet_lines(merged).mapInPandas(run, "taken long").agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
