"""Layouts, feeds, the generated source, fetching, indexers, streaming and the engine, on pages written for the purpose."""

import base64
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from gleanfold.engine import Engine, Response
from gleanfold.operators import listings
from gleanfold.sources import demo, feeds, layouts, pages
from gleanfold.sources.html import parse
from gleanfold.sources.http import fetch_pages
from gleanfold.sources.indexers import Indexers
from gleanfold.streaming import search

NOW = 1_749_988_800_000
H = "0123456789abcdef0123456789abcdef01234567"
MAG = f"magnet:?xt=urn:btih:{H}&dn=x"


def test_page_facts_of_a_cut_reference(spark, tmp_path):
    from gleanfold.plans.queries import html_title_links

    spark.createDataFrame([(1, "u", "<title>one &amp;&amp</title><h1>x &lt y &#x27;z&#x27;</h1><a href='/a&amp;b'>k</a>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    r = html_title_links(spark, str(tmp_path)).first()
    assert (r.title, r.heading, r.first_href, r.n_links) == ("one &&amp", "x &lt y 'z'", "/a&b", 1)


def test_selectors():
    d = parse("<table class='a b'><tr><td>1<td><a href=/x>n <b>m</b></a><tr id=r2><td>2</table><p>one<p>two<br>three &amp; four")
    assert [n.text() for n in d.select("table.a tr > td")] == ["1", "n m", "2"]
    assert d.first("tr:nth-child(n+2)").attrs["id"] == "r2" and d.first("td:nth-child(2) > a").own_text() == "n "
    assert [p.text() for p in d.select("p")] == ["one", "twothree & four"] and d.first("a[href^=/y]") is None
    assert len(d.select("td:last-child, tr#r2")) == 3 and d.first("tr:not(.z)") is not None
    assert parse("<h1>a&ampb &lt c &copy; &#x27;</h1>", unclosed=False).text() == "a&ampb &lt c © '" and parse("<h1>a &amp</h1>").text() == "a &"
    with pytest.raises(ValueError):
        d.select("a::b")


def table(rows: str, attrs: str = "") -> str:
    return f"<html><body><table {attrs}><tbody>{rows}</tbody></table></body></html>"


PAGES = {
    "1337x": (table("<tr><td class=name><a href=/torrent/1/x>N1</a></td><td class=size>1.5 GB</td><td class=seeds>5</td><td class=leeches>2</td><td class=date>today</td></tr><tr><td class=name><a href=/user/1>no</a></td></tr>"), {"name": "N1", "size_raw": "1.5 GB", "detail_url": "https://1337x.to/torrent/1/x", "seeders": "5"}),
    "nyaa": (table(f"<tr><td><a title='Anime - Raw' href='/?c=1_2'></a></td><td><a href=/view/9>N2</a></td><td>2 MiB</td><td>2024-01-15 10:00</td><td>3</td><td>4</td></tr><tr><td>short</td></tr>", "class=torrent-list"), {"name": "N2", "category": "Anime - Raw", "leechers": "4", "detail_url": "https://nyaa.si/view/9"}),
    "rutor": ("<div id=index>" + table(f"<tr><th>h</th></tr><tr><td>12 Мая 21</td><td><a>d</a><a href='{MAG}'>m</a><a href=/t/1>N3</a></td><td>1,5 ГБ</td><td><span>7</span><span>8</span></td></tr>") + "</div>", {"name": "N3", "size_raw": "1.5 GB", "date_raw": "12 May 21", "seeders": "7", "leechers": "8", "info_hash": H}),
    "bitsearch": (f"<div class=space-y-4><div><div><h3><a href=/d/1>N4</a></h3><div>1.2 GB</div><div>1,100</div><div>22</div><div>3 Mar 2024</div><span class=badge>Movies/HD</span><a href='{MAG}'>m</a></div></div></div>", {"name": "N4", "size_raw": "1.2 GB", "seeders": "1,100", "leechers": "22", "date_raw": "3 Mar 2024", "category": "Movies"}),
    "tokyotoshokan": (table(f"<tr><td>head</td></tr><tr><td><a href='/?cat=3'>c</a></td><td class=desc-top><a href='{MAG}'>m</a><a href=/x>N5</a></td><td class=web><a href=/w>w</a></td></tr><tr><td class=desc-bot>By: me | Size: 3MB | Date: 2024-01-15 10:00 UTC</td><td class=stats><span>1</span><span>2</span></td></tr>", "class=listing"), {"name": "N5", "category": "Books", "size_raw": "3MB", "seeders": "1", "leechers": "2"}),
    "limetorrents": (table(f"<tr><td><div class=tt-name><a href='http://itorrents.net/torrent/{H.upper()}.torrent?t'></a><a href=/N6>N6</a></div></td><td>2 days ago - in TV.</td><td>3 GB</td><td class=tdseed>4</td><td class=tdleech>5</td></tr>", "class=table2"), {"name": "N6", "info_hash": H, "date_raw": "2 days ago", "category": "Series"}),
    "torrentdownload": (f"<div class=wrapper>" + table("<tr><td>x</td></tr>", "class=table2") + table(f"<tr><td><div class=tt-name><a href='/{H.upper()}/n7'>N7</a><span>» Movies - Thriller</span></div></td><td>today</td><td>1 GB</td><td>1</td><td>2</td></tr>", "class=table2") + "</div>", {"name": "N7", "info_hash": H, "category": "Movies"}),
    "audiobookbay": ("<div class=post><div class=postTitle><h2><a href=/b/1>N8</a></h2></div><div class=postContent><p>a</p><p>b</p><p>Posted: 3 Mar 2024\n File Size: 300 MBs</p></div></div>", {"name": "N8", "size_raw": "300 MB", "date_raw": "3 Mar 2024", "category": "Books"}),
    "blueroms": ("<div class=row><div class=col-xs-12><div class=card><h4 class=card-title><a href=/g>N9</a></h4><p><strong>Platform:</strong> NES</p><p><strong>Size:</strong> 3 MB</p><div class=card-footer><a href=/dl>d</a></div></div></div></div>", {"name": "N9 - NES", "size_raw": "3 MB", "detail_url": "https://www.blueroms.ws/dl"}),
    "filemood": (table(f"<tr><td class=dn-title>N10</td><td class=dn-btn><div><a class=btn-success href='/n10-{H}.html'>g</a></div></td><td class=dn-size>4 GB</td><td class=dn-status>3 / 4</td></tr><tr><td class=dn-title>none</td></tr>"), {"name": "N10", "info_hash": H, "seeders": "3", "leechers": "4"}),
    "linuxtracker": (table(f"<tr><td class=lista>i</td><td class=lista><a href='torrent-details.php?id={H.upper()}'>N11</a></td><td>d</td><td>15/01/2024</td><td>1 GB</td><td>u</td><td>6</td><td>7</td></tr><tr><td class=lista><a href='torrent-details.php?id=1'>side</a></td></tr>"), {"name": "N11", "info_hash": H, "date_num": 1705276800000, "seeders": "6", "leechers": "7"}),
    "animetosho": (f"<div class=home_list_entry><div class=link><a href=/v/1>N12</a></div><div class=size>5 GB</div><div class=date title='Date/time submitted: 15/01/2024 10:11'></div><div class=links><span title=s>[3↑/4↓]</span><a href='{MAG}'>m</a></div></div>", {"name": "N12", "seeders": "3", "leechers": "4", "date_num": 1705276800000}),
    "therarbg": (table("<tr class=list-entry><td>1</td><td class=cellName><div><a href=/p/1>N13</a></div></td><td><a>Tv</a></td><td data-order=1705276800>d</td><td>x</td><td class=sizeCell data-order=1048576>1 MB</td><td>8</td><td>9</td></tr>"), {"name": "N13", "size_raw": "1048576", "date_num": 1705276800, "category": "Series", "seeders": "8"}),
    "torrentdatabase": (table(f"<tr><td><a href=/t/1>i</a><a href='/track/magnet/{H}?x'>N14</a></td><td><span class=category-bubble>E-Books</span></td><td class=size-cell>1 GB</td><td class=date-cell>today</td><td><div><span>1</span><span>2</span></div></td></tr>", "class=torrent-table"), {"name": "N14", "info_hash": H, "category": "Books", "magnet": f"magnet:?xt=urn:btih:{H}&tr=https%3A%2F%2Fdevelopify.ca%2Fannounce"}),
    "torrentdownloads": ("<div class=inner_container><div class=grey_bar3></div></div><div class=inner_container>" + "<div class=grey_bar3><p>h</p></div>" * 2 + "<div class=grey_bar3><p><img src=/templates/new/images/icons/menu_icon8.png><a href=/t>N15</a></p><span>a</span><span>11</span><span>12</span><span>1 GB</span></div></div>", {"name": "N15", "category": "Series", "leechers": "11", "seeders": "12", "size_raw": "1 GB"}),
}


@pytest.mark.parametrize("source", PAGES)
def test_layouts(spark, source):
    html, expected = PAGES[source]
    df = spark.createDataFrame([(html,), (None,), ("<html>moved</html>",)], "html string")
    got = layouts.html_listings(df, source).collect()
    assert len(got) == 1
    assert {k: got[0][k] for k in expected} == expected and got[0].provider == source
    assert listings.normalize(layouts.html_listings(df, source), NOW).count() == 1


def test_every_source_parses_nothing_from_nothing(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "html string")
    out = None
    for s in layouts.LAYOUTS:
        rows = layouts.html_listings(df, s)
        out = rows if out is None else out.unionByName(rows)
    assert out.count() == 0 and len(layouts.LAYOUTS) == 32


def test_details(spark):
    enc = base64.b64encode(MAG.encode()).decode()
    rows = [("1337x", "/1", f"<a href='{MAG}'>m</a>"), ("blueroms", "/2", f"<b id=magnet-button data-link={enc}>"), ("audiobookbay", "/3", f"<table><tr><td>Info Hash:</td><td>{H}</td></tr></table>"), ("bt4g", "/4", f"<a href='//downloadtorrentfile.com/hash/{H}?n=1'>d</a>"), ("zeromagnet", "/5", f"<input id=input-magnet value='{MAG}'>"), ("other", "/6", "<p>none</p>"), ("blueroms", "/7", "<b id=magnet-button data-link='%%'>")]
    got = {r.detail_url: (r.resolved, r.resolved_hash) for r in layouts.detail_magnets(spark.createDataFrame(rows, "source string, detail_url string, html string")).collect()}
    assert got == {"/1": (MAG, None), "/2": (MAG, None), "/3": (None, H), "/4": (None, H), "/5": (MAG, None), "/6": (None, None), "/7": (None, None)}


def one(spark, f, body):
    return listings.normalize(f(spark.createDataFrame([(json.dumps(body),), ("429 Too Many Requests",)], "body string")), NOW).collect()


def test_json_feeds(spark):
    assert one(spark, feeds.tpb, [{"error": "no results"}]) == []
    a, b = one(spark, feeds.tpb, [{"id": "1", "name": "N", "info_hash": H.upper(), "size": "2048", "seeders": "3", "leechers": "1", "num_files": "2", "added": "1652877231", "category": "303"}, {"id": "2", "name": "M", "info_hash": H, "category": "601"}])
    assert (a.id, a.size_text, a.date_ms, a.category, a.files) == (f"tpb:{H.upper()}", "2.0 KB", 1652877231000, "Apps", 2) and b.category == "Books"
    y = one(spark, feeds.yts, {"data": {"movies": [{"id": 5, "title_long": "T (2020)", "url": "http://y/t", "torrents": [{"hash": H.upper(), "quality": "1080p", "type": "web", "size_bytes": 10}, {"quality": "720p"}]}, {"title": "", "torrents": []}]}})
    assert [(r.name, r.info_hash, r.detail_url) for r in y] == [("T (2020) [1080p] [web] [-]", H, f"http://y/t?movieid=5&infohash={H}")]
    k = one(spark, feeds.knaben, {"hits": [{"title": "K", "magnetUrl": MAG, "bytes": 5, "categoryId": [9000001, 2000000], "date": "2024-01-15T00:00:00Z"}, {"title": "L", "hash": H, "categoryId": []}]})
    assert [(r.category, r.info_hash, r.date_ms) for r in k] == [("Series", H, 1705276800000), (None, H, None)]
    s = one(spark, feeds.subsplease, {"Show": {"release_date": "Mon, 15 Jan 2024 00:00:00 +0000", "episode": "1 v2", "page": "show", "downloads": [{"res": "720", "magnet": MAG + "&xl=99"}, {"res": "480", "magnet": ""}]}})
    assert [(r.name, r.size, r.detail_url, r.date_ms) for r in s] == [("Show [720p]", 99, "https://subsplease.org/show?ep=1%20v2&res=720", 1705276800000)]
    assert one(spark, feeds.torrentscsv, {"torrents": [{"name": "C", "infohash": H, "size_bytes": 1, "created_unix": 5}]})[0].category == "Other"
    assert one(spark, feeds.bangumimoe, {"torrents": [{"title": "B", "magnet": MAG, "size": " 1 GB "}, {"title": "no"}]})[0].info_hash == H
    assert one(spark, feeds.internetarchive, {"response": {"docs": [{"title": "A", "btih": H, "mediatype": "texts", "identifier": "i"}, {"title": "x"}]}})[0].category == "Books"
    rel = spark.createDataFrame([(i, i) for i in range(20)], "id int, place int")
    det = spark.createDataFrame([(i, json.dumps([{"hash": f"{H}", "release": {"alias": f"r{i}", "name": {"main": f"A{i}"}}}])) for i in range(20)], "id int, body string")
    assert feeds.anilibria(rel, det).count() == 15


def test_rss(spark):
    xml = f"""<?xml version="1.0"?><rss xmlns:torznab="http://t"><channel>
      <item><title> </title></item>
      <item><title>One</title><link>http://l</link><guid>g</guid><pubDate>Tue, 15 Jan 2019 04:05:06 +0000</pubDate><size>7</size><enclosure url="{MAG.replace('&', '&amp;')}" length="500"/><torznab:attr name="seeders" value="1"/><torznab:attr name="SEEDERS" value="2"/></item>
      <item><title>Two</title><link>{MAG.replace('&', '&amp;')}</link><comments>http://c</comments><size>9</size><enclosure url="u" length="x"/><torznab:attr name="infohash" value="FF"/><torznab:attr name="peers" value="4"/></item>
    </channel></rss>"""
    a, b = listings.normalize(feeds.rss_listings(spark.createDataFrame([(xml,)], "xml string"), "torznab:t"), NOW).collect()
    assert (a.name, a.magnet, a.size, a.seeders, a.info_hash, a.detail_url, a.date_ms) == ("One", MAG, 500, 2, H, "http://l", 1547525106000)
    assert (b.name, b.magnet, b.size, b.info_hash, b.leechers, b.detail_url) == ("Two", MAG, 9, "FF", 4, "http://c")
    assert feeds.indexer_url("http://x/api/?a=1") == "http://x/api" and feeds.indexer_url("http://x/") == "http://x/api"
    assert feeds.indexer_query("http://x", "k", "a b") == "http://x/api?apikey=k&extended=1&t=search&q=a+b"


def sequential_pool(query):
    """The same generator run one draw after the other."""
    state = demo.seed_of(query)

    def rng():
        nonlocal state
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ state >> 15) * (1 | state) % 2**32
        t = (t ^ (t + (t ^ t >> 7) * (61 | t))) % 2**32
        return (t ^ t >> 14) / 2**32

    return [[rng() for _ in range(47)] for _ in range(120)]


def test_demo(spark):
    draws = sequential_pool("ubuntu")
    got = demo.pool(spark, "ubuntu", NOW).orderBy("ord").collect()
    assert len(got) == 120 and [r.info_hash for r in got] == ["".join(f"{int(v * 16):x}" for v in d[7:]) for d in draws]
    assert [r.category for r in got] == [demo.CATEGORIES[int(d[0] * 6)] for d in draws] and demo.has_more(5) and not demo.has_more(6)


def test_row_helpers(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "c array<string>")
    assert [[tuple(p) for p in r[0]] for r in df.select(pages.row_pairs(F.col("c"))).collect()] == [[("a", "b")], [], []]


def test_fetch(spark, tmp_path):
    from gleanfold.sources.http import ACCEPTED, AGENTS

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.headers["Accept"], self.headers["Accept-Language"], self.headers["User-Agent"] in AGENTS))
            if self.path == "/go":
                self.send_response(302)
                self.send_header("Location", MAG)
                self.end_headers()
                return
            self.send_response(200 if self.path == "/ok" else 500)
            self.end_headers()
            self.wfile.write(b"hello" if self.path == "/ok" else b"")

        do_POST = do_GET

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    reqs = [{"source": "a", "url": f"{base}/ok"}, {"source": "b", "mirror_rank": 1, "url": f"{base}/bad"}, {"source": "c", "url": "http://127.0.0.1:1/x"}, {"source": "d", "url": f"{base}/ok", "json": {"q": 1}}, {"source": "e", "url": f"{base}/go"}]
    got = {r.source: r for r in fetch_pages(spark, reqs, 3).collect()}
    store = Indexers(f"{tmp_path}/i.json")
    store.add("Here", base + "/ok?x=")
    assert Engine(spark, NOW, store).probe("torznab:here") == {"ok": False, "length": 0, "error": "HTTP 500"}
    with pytest.raises(ValueError):
        Engine(spark, NOW, store).probe("torznab:gone")
    server.shutdown()
    assert got["a"].body == "hello" and got["d"].body == "hello" and got["b"].error == "HTTP 500" and got["b"].mirror_rank == 1
    assert "refused" in got["c"].error and got["e"].location == MAG
    assert set(seen) == {(*ACCEPTED.values(), True)}
    assert fetch_pages(spark, []).count() == 0


def test_indexers(tmp_path):
    store = Indexers(f"{tmp_path}/sub/indexers.json")
    assert store.load() == []
    a, b = store.add("My Site", "http://x", "secret99"), store.add("My Site", "http://y")
    assert (a["id"], b["id"]) == ("torznab:my-site", "torznab:my-site-2") and store.public()[0]["apiKey"] == "••••et99"
    assert store.remove(a["id"]) and not store.remove("nope") and [r["id"] for r in store.load()] == [b["id"]] and store.get(b["id"])["url"] == "http://y"
    with pytest.raises(ValueError):
        store.add("", "http://x")


def test_engine(spark, tmp_path):
    store = Indexers(f"{tmp_path}/i.json")
    store.add("Own", "http://x")
    rss = f"<rss><channel><item><title>One</title><enclosure url='{MAG.replace('&', '&amp;')}' length='5'/></item></channel></rss>"
    rows = [("1337x", 0, None, "ECONNRESET"), ("1337x", 1, PAGES["1337x"][0], None), ("rutor", 0, PAGES["rutor"][0], None), ("yts", 0, None, "ETIMEDOUT"), ("torznab:own", 0, rss, None), ("tpb", 0, json.dumps([{"name": "P", "info_hash": H.upper(), "seeders": "99"}]), None)]
    pages_ = spark.createDataFrame(rows, "source string, mirror_rank int, body string, error string")
    engine = Engine(spark, NOW, store)
    r = engine.search(" linux ", pages_, match=False)
    status = {s.id: (s.status, s["count"], s.error) for s in r.statuses.collect()}
    assert status["1337x"] == ("ok", 1, None) and status["yts"] == ("error", 0, "YTS unreachable (ETIMEDOUT)") and status["demo"][1] == 20 and r.has_more() and r.responded() == (41, 42)
    merged = {m.key: m for m in engine.merge(r).collect()}
    m = merged[f"hash:{H}"]
    assert m.providers == ["tpb", "rutor", "torznab:own"] and (m.name, m.seeders) == ("P", 99)
    again = engine.search("linux", pages_, page=2, providers=["demo", "tpb"], match=False)
    assert again.results.count() == 20 and engine.new_rows(r.results, again).count() == 20 and engine.new_rows(r.results, r).count() == 0
    stored = engine.search("ONE", pages_, providers=["torznab:own", "tpb", "rutor"])  # a stored table: names must hold the query
    assert [x.name for x in stored.results.collect()] == ["One"] and stored.statuses.where("count > 0").count() == 1
    assert engine.search("x", pages_, providers=["mikan"]).results.count() == 0
    with pytest.raises(ValueError):
        engine.search(" ", pages_)


def test_requests(spark, tmp_path):
    from gleanfold.operators.federate import REGISTRY
    from gleanfold.sources.requests import release_details, requests_for

    assert [r["url"] for r in requests_for("rutor", "a b", 2)] == [f"https://rutor.{x}/search/1/0/010/2/a%20b" for x in ("info", "is", "ru")]
    assert requests_for("knaben", "x")[0]["json"]["query"] == "x" and requests_for("demo", "x") == [] and "a-b" in requests_for("mypornclub", "a b")[0]["url"]
    assert {s for s in REGISTRY if not requests_for(s, "q")} == {"demo", "anilibria"} and len(release_details(list(range(40)))) == 15
    store = Indexers(f"{tmp_path}/i.json")
    store.add("Own", "http://x", "k")
    asked = Engine(spark, NOW, store).requests("q", 2)
    assert {r["source"] for r in asked} == {"1337x", "nyaa", "dmhy", "bt4g", "limetorrents", "rutor", "bitsearch"}
    assert Engine(spark, NOW, store).requests("q", 1, ["torznab:own"])[0]["url"].startswith("http://x/api?apikey=k")


def test_paging(spark):
    empty = spark.createDataFrame([], "source string, mirror_rank int, body string, error string")
    pages_ = list(Engine(spark, NOW).pages("linux", lambda q, n: empty))
    assert len(pages_) == 6 and not pages_[-1].has_more()


def test_streams(spark, tmp_path):
    rows = [(1, "a:1", "s1", 1), (2, "b:1", "s2", 1), (3, "a:1", "s1", 1), (4, "old", "s1", 0)]
    spark.createDataFrame(rows, "ord int, id string, provider string, search_id int").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ord int, id string, provider string, search_id int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    s = search.Search(stream, 1, lambda df, epoch: seen.extend(r.id for r in df.collect()))
    s.wait()
    assert sorted(seen) == ["a:1", "a:1", "b:1"]
    s.cancel()
    counts = search.run_to_end(search.first_arrivals(stream).groupBy("provider").count(), "t")
    assert {r.provider: r["count"] for r in counts.collect()} == {"s1": 2, "s2": 1}
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("ord")))
    assert search.first_arrivals(timed, "at").isStreaming


def test_engine_stream(spark, tmp_path):
    rows = [("1337x", 0, PAGES["1337x"][0], None, 7), ("yts", 0, None, "ETIMEDOUT", 7), ("rutor", 0, PAGES["rutor"][0], None, 6)]
    schema = "source string, mirror_rank int, body string, error string, search_id int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {}
    arrivals = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    Engine(spark, NOW).stream(arrivals, lambda s, df, status: got.update({s: ([r.name for r in df.collect()], status)}), 7).wait()
    assert got == {"1337x": (["N1"], {"status": "ok", "count": 1, "error": None, "ms": None}), "yts": ([], {"status": "error", "count": 0, "error": "YTS unreachable (ETIMEDOUT)", "ms": None})}


def test_engine_fetches_releases(spark, monkeypatch):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            torrents = [{"hash": f"{i}" * 40, "label": f"T{i}", "release": {"alias": f"r{i}"}} for i in (1, 2)]
            bodies = {"/up/api/v1/app/search/releases?query=a%20b": [{"id": 9}, {"id": None}, {"id": 4}], "/up/api/v1/anime/torrents/release/9": torrents[:1], "/up/api/v1/anime/torrents/release/4": torrents[1:]}
            self.send_response(200 if self.path in bodies else 500)
            self.end_headers()
            self.wfile.write(json.dumps(bodies.get(self.path)).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    engine = Engine(spark, NOW)
    monkeypatch.setitem(layouts.MIRRORS, "anilibria", [f"{base}/down", f"{base}/up"])
    r = engine.search("a b", engine.fetch("a b", 1, ["anilibria"], 3), providers=["anilibria"])
    assert [(x.name, x.info_hash, x.mirror_rank) for x in r.results.orderBy("place").collect()] == [("T1", "1" * 40, 1), ("T2", "2" * 40, 1)]
    assert [(s.id, s.status, s["count"], s.error) for s in r.statuses.collect()] == [("anilibria", "ok", 2, None)]
    assert [x.name for x in engine.releases("a b", 3).orderBy("place").collect()] == ["T1", "T2"]
    monkeypatch.setitem(layouts.MIRRORS, "anilibria", [f"{base}/down"])
    r = engine.search("a b", engine.fetch("a b", 1, ["anilibria"], 3), providers=["anilibria"])
    assert [(s.status, s["count"], s.error) for s in r.statuses.collect()] == [("error", 0, "anilibria unreachable (HTTP 500)")]
    server.shutdown()


def test_paging_has_no_cap(spark, monkeypatch):
    engine = Engine(spark, NOW)

    def made(query, pages, number):
        results = spark.createDataFrame([(f"a:{number}",)], "id string")
        statuses = spark.createDataFrame([("ok", 1, True, number < 12)], "status string, count int, paginated boolean, has_more boolean")
        return Response(query, number, results, statuses)

    monkeypatch.setattr(engine, "search", made)
    assert len(list(engine.pages("x", lambda q, n: None))) == 12


def test_pages_without_listings_are_errors(spark):
    """A page that holds no listing is an error where the source says so, with its own words."""
    rows = [("eztv", 0, "<p>x</p>", None), ("eztv", 1, "<table><tbody><tr></tr><tr></tr></tbody></table>", None), ("xxxclub", 0, "<p>x</p>", None), ("1337x", 0, "<html>just a moment</html>", None), ("sukebei", 0, "<p>x</p>", None), ("nyaa", 0, "<p>x</p>", None), ("nyaa", 0, None, None), ("subsplease", 0, None, None), ("torznab:a", 0, "", None)]
    pages = spark.createDataFrame(rows, "source string, mirror_rank int, body string, error string")
    from gleanfold.operators import federate

    engine = Engine(spark, NOW)
    none = spark.createDataFrame([], "provider string, mirror_rank int")
    said = {r.source: r.error for r in federate.source_errors(engine.attempts(pages, none, engine.parsed(pages))).collect()}
    assert said == {
        "eztv": "EZTV unreachable (no_results_parsed; no_results_parsed)", "xxxclub": "xxxclub unreachable (no_results_parsed)", "1337x": "1337x unreachable (no_results_parsed)", "sukebei": "Sukebei unreachable ()",
        "subsplease": "SubsPlease unreachable (no_data)", "torznab:a": "empty_response",
    }


def test_first_container_and_mirror_address(spark):
    row = "<tr><td class=sr-col-name><a class=sr-torrent-link href=/t/{0}>{0}</a></td></tr>"
    page = "<table class=top-table><tbody>" + row.format("a") + "</tbody></table><table class=sr-table><tbody>" + row.format("b") + "</tbody></table>"
    df = spark.createDataFrame([(1, page), (7, page)], "mirror_rank int, html string")
    got = layouts.html_listings(df, "uindex", "html", "mirror_rank").collect()
    assert [(r.mirror_rank, r.name, r.detail_url) for r in got] == [(1, "a", "https://uindex.to/t/a"), (7, "a", "https://uindex.org/t/a")]


def test_sources_of_a_search_cost_their_own_tasks(spark):
    """Each source's listings are read from its own rows: tasks don't multiply with the number of sources."""
    row = "<tr><td class=name><a href=/torrent/{0}/x>Lamp {0}</a></td><td class=size>1 KB</td></tr>"
    bodies = [(s, k, "<table><tbody>" + row.format(k) + "</tbody></table>", None) for s in ("1337x", "torrent9", "oxtorrent", "rutor", "eztv") for k in range(8)]
    stored = spark.createDataFrame(bodies, "source string, mirror_rank int, body string, error string").repartition(40)
    r = Engine(spark, NOW).search("lamp", stored, providers=["1337x", "torrent9", "oxtorrent", "rutor", "eztv"])
    assert r.results.rdd.getNumPartitions() <= 45  # 8 cores a source at most, not 40 tasks each
    assert {x.id: x["count"] for x in r.statuses.collect()} == {"1337x": 1, "torrent9": 1, "oxtorrent": 1, "rutor": 0, "eztv": 0}
