"""Merging, ranking, filters, federation, user state and sinks on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from gleanfold import sinks
from gleanfold.operators import federate, listings, refine, userstate

NOW = 1_749_988_800_000


def rows(spark):
    cols = "id string, name string, size bigint, size_text string, seeders bigint, leechers bigint, date_ms bigint, date_text string, magnet string, info_hash string, provider string, category string, detail_url string, files bigint, ord int"
    data = [
        ("a:1", "First", None, "—", 3, None, None, "—", None, "ABC", "a", None, "/1", None, 1),
        ("b:1", "Second", 10, "10 B", 9, 2, 5, "d", "magnet:b", "abc", "b", "Movies", None, 4, 2),
        ("a:1", "First again", 11, "11 B", 1, 7, 6, "d", None, "ABC", "a", "TV", None, None, 3),
        ("c:2", "No hash", None, "—", None, None, None, "—", None, None, "c", "Porn", "/2", None, 4),
    ]
    return spark.createDataFrame(data, cols)


def test_merge(spark):
    got = {r.key: r for r in listings.merge_sources(rows(spark)).collect()}
    m = got["hash:abc"]
    assert (m.name, m.category, m.info_hash, m.size, m.size_text, m.seeders, m.leechers, m.files, m.magnet, m.needs_magnet) == ("First", None, "ABC", 10, "10 B", 9, 7, 4, "magnet:b", False)
    assert m.providers == ["a", "b"] and [s.id for s in m.sources] == ["a:1", "b:1", "a:1"]
    assert got["c:2"].needs_magnet and got["c:2"].magnet is None
    assert [r.name for r in listings.dedupe_first(rows(spark)).orderBy("ord").collect()] == ["First", "Second", "No hash"]


def test_normalize(spark):
    raw = spark.createDataFrame([("tpb", None, "X & Y", "2C6B", "3.4 GB", None, "", "5", "7 x", "", "9"), ("demo", None, "Test", None, None, None, None, None, None, None, None), ("d", None, None, None, None, "/p", None, None, None, None, None)], "provider string, id string, name string, info_hash string, size_raw string, detail_url string, date_raw string, seeders string, leechers string, magnet string, files string")
    a, b, c = listings.normalize(raw, NOW).collect()
    assert (a.id, a.size_text, a.seeders, a.leechers, a.magnet, a.needs_magnet, a.files, a.date_ms) == ("tpb:2C6B", "3.4 GB", 5, 7, "magnet:?xt=urn:btih:2C6B&dn=X%20%26%20Y", False, 9, None)
    assert (b.id, b.magnet, b.needs_magnet, b.size_text) == ("demo:Test", None, False, "—")
    assert (c.name, c.needs_magnet, c.id) == ("(untitled)", True, "d:")


@pytest.mark.parametrize(("name", "query", "score"), [("Ubuntu 22.04 LTS", "ubuntu lts", 7.0), ("The Ubuntux", "ubunt", 9.0), ("abc", "zz", 0.0), ("好电影 1080p", "电影", 8.5), (None, "x", 0.0), ("x", "  ", 0.0), ("a.b", "...", 0.0)])
def test_relevance(spark, name, query, score):
    assert spark.createDataFrame([(name,)], "name string").select(refine.relevance(F.col("name"), query)).first()[0] == score


def test_filters_and_order(spark):
    df = rows(spark).drop("ord").withColumn("ord", F.monotonically_increasing_id())
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(refine.refine(df, min_seeders=3)) == ["a:1", "b:1", "c:2"]
    assert ids(refine.refine(df, min_size=11)) == ["a:1", "a:1", "c:2"]
    assert "c:2" not in ids(refine.refine(df, safe_mode=True)) and df.where(refine.safe(strict_compat=True)).count() == 4
    assert ids(refine.by_column(df, "seeders")) == ["b:1", "a:1", "a:1", "c:2"]
    assert ids(refine.by_column(df, "size", ascending=True))[:2] == ["a:1", "c:2"]
    assert refine.facets(df.where("id = 'c:2'")).count() == 0 and refine.facets(df).count() > 1
    assert refine.selected_bucket(refine.facets(df), "games") == "all"
    assert [r.id for r in refine.page(df.orderBy("ord"), 2, 3).collect()] == ["c:2"]


def test_federation(spark):
    reg = federate.registry(spark, [{"id": "torznab:x", "name": "X"}])
    assert reg.count() == 42 and federate.resolve(reg, page=2).count() == 8
    assert federate.resolve(reg, without_groups=("adult",)).count() == 38
    s = federate.status(reg, spark.createDataFrame([("tpb",), ("tpb",)], "provider string"), spark.createDataFrame([("yts", "down")], "id string, error string"))
    got = {r.id: (r.status, r["count"], r.error) for r in s.collect()}
    assert got["tpb"] == ("ok", 2, None) and got["yts"] == ("error", 0, "down") and got["demo"] == ("ok", 0, None)
    more = lambda d: d.agg(federate.more_expected()).first()[0]
    st = spark.createDataFrame([("a", "ok", 1, None, True), ("b", "error", 2, True, True)], "id string, status string, count int, has_more boolean, paginated boolean")
    assert more(st) is True and more(st.withColumn("has_more", F.lit(False))) is False and more(st.limit(0)) is False
    tries = spark.createDataFrame([("m", "M", 1, 0, "b"), ("m", "M", 0, 0, "a"), ("n", "N", 0, 3, "x"), ("n", "N", 1, 0, "y"), ("e", "E", 0, 0, None)], "source string, name string, mirror_rank int, n int, error string")
    assert {r.source: r.error for r in federate.mirror_errors(tries).collect()} == {"m": "M unreachable (a; b)", "e": "E unreachable ()"}


def test_user_state(spark):
    h = spark.createDataFrame([("Linux", 1), ("linux", 5), ("bsd", 3), ("x", 2)], "query string, ts int")
    assert [r.query for r in userstate.recent(h, most=2).collect()] == ["linux", "bsd"]
    g = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    f = spark.createDataFrame([("b", 9), ("z", 8)], "key string, v int")
    assert sorted((r.key, r.v) for r in userstate.lookup(g, f).collect()) == [("a", 1), ("b", 2), ("z", 8)]
    picks = spark.createDataFrame([("b", 0), ("gone", 1)], "key string, pick_order int")
    assert [r.key for r in userstate.checked(g, picks).collect()] == ["b"]
    assert {r.key: r.fav for r in userstate.flag(g, f, "fav").collect()} == {"a": False, "b": True}


def test_csv(spark, tmp_path):
    merged = listings.merge_sources(rows(spark))
    out = f"{tmp_path}/csv"
    sinks.write_csv(merged, out)
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = text.split("\r\n")
    assert lines[0].startswith("﻿名称,") and lines[1].startswith("First,9,7,10 B") and lines[1].endswith("a | b,ABC,magnet:b")
    cells = spark.createDataFrame([(x,) for x in ["=1", "+1", "-1", "@x", "\tx", "a,b", 'q"q', "n\nl", None, "plain"]], "v string")
    assert [r[0] for r in cells.select(sinks.csv_cell(F.col("v"))).collect()] == ["'=1", "'+1", "'-1", "'@x", "'\tx", '"a,b"', '"q""q"', '"n\nl"', "", "plain"]


def test_clients():
    log = []

    def send(url, body, headers):
        log.append((url, body, headers))
        if url.endswith("/auth/login"):
            return 200, {"Set-Cookie": "SID=1; path=/"}, b"Ok."
        if "transmission" in url and "X-Transmission-Session-Id" not in headers:
            return 409, {"X-Transmission-Session-Id": "s"}, b""
        if "transmission" in url:
            return 200, {}, b'{"result": "success"}'
        if "jsonrpc" in url:
            return 200, {}, json.dumps({"error": 1} if b"bad" in body else {"result": "x"}).encode()
        return 200, {}, b'{"code": 0}' if "tasks" in url else b"Ok."

    c = {"url": "http://h/"}
    assert [sinks.push(k, c, ["magnet:good", "magnet:bad"], send) for k in ("qbittorrent", "transmission", "aria2", "gopeed")] == [2, 2, 1, 2]
    assert log[1][2]["Cookie"] == "SID=1"
    with pytest.raises(ValueError):
        sinks.push("nope", c, [], send)
    assert all(sinks.reachable(k, c, send) for k in sinks.CLIENTS)

    def none(url, body, headers):
        raise ConnectionRefusedError

    def only_aria2(url, body, headers):
        return send(url, body, headers) if ":6800" in url else (404, {}, b"")

    assert sinks.detect(none) is None and sinks.detect(only_aria2)["url"] == "http://localhost:6800/jsonrpc" and len(sinks.CANDIDATES) == 9


def test_places_of_all_rows(spark):
    from gleanfold.operators import refine

    rows = [(i, None if i % 3 == 0 else i * 7919 % 101) for i in range(1000)]
    df = spark.createDataFrame(rows, "ord long, size long").repartition(5)
    for ascending in (True, False):
        got = {r.ord: r.place for r in refine.places(df, "size", ascending).collect()}
        wanted = sorted(rows, key=lambda r: ((-1 if r[1] is None else r[1]) * (1 if ascending else -1), r[0]))
        assert got == {r[0]: i for i, r in enumerate(wanted, 1)}


def test_relevance_by_neighbours_of_a_part(spark):
    """Tokens as a split would give them: equal, at a token's start, inside one, none."""
    from gleanfold.operators import refine

    titles = ["red", "a-red.b", "redder", "inred", "电red", "red电 x", "RED", "été red", "éred", "", None, "blue", "inred red"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, name string")
    got = [r[0] for r in df.orderBy("i").select(refine.relevance(F.col("name"), "red x")).collect()]
    assert got == [3.5, 3.5, 2.5, 2.0, 2.0, 1.0 + 2.0 + 3.0, 3.5, 3.5, 3.5, 0.0, 0.0, 0.0, 3.5]


def test_best_merged_shuffles_no_names(spark):
    from gleanfold.operators import refine

    rows = [(f"i{i}", "red" if i in (3, 9) else f"n{i} " + "red " * (i % 2), "h" if i in (3, 9) else f"h{i}", i % 5, i) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, name string, info_hash string, seeders long, ord long")
    score = refine.relevance(F.col("name"), "red")
    for page in (1, 2):
        best = refine.best_merged(df, score, page, 15)
        full = listings.merge_sources(df.withColumns({c: F.lit(None).cast("string") for c in ("magnet", "category", "detail_url", "provider")} | {c: F.lit(None).cast("long") for c in ("leechers", "size", "date_ms", "files")}))
        want = refine.page(refine.by_relevance(full, "red"), page, 15).select("key", "ord", "name", "seeders", "score").collect()
        assert best.collect() == want and len(want) == 15
