"""Canonicalisation and classification, case by case."""

import pytest
from pyspark.sql import functions as F

from gleanfold.functions import canon, classify

NOW = 1_749_988_800_000


def values(spark, inputs, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_sizes(spark):
    G = 1024**3
    cases = {"1.2 GB": round(1.2 * G), "800 MiB": 800 << 20, "512 MB": 512 << 20, "1 TB": 1 << 40, "1 PB": 1 << 50, "1 KB": 1024, "1 K": 1024, "1 KIB": 1024, "2048": 2048, "1.5G": G * 3 // 2, "1,024 MB": G, "0 B": 0, "0": 0, None: None, "": None, "abc": None, "1.2.3 KB": 1229, " 3 mb ": 3 << 20, "3 XB": None, ".": None}
    assert values(spark, cases, canon.parse_size) == list(cases.values())
    text = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 102400: "100 KB", 1484: "1.4 KB", 3_650_722_202: "3.4 GB", None: "—", 5 << 50: "5.0 PB", 2000 << 50: "2000 PB"}
    assert values(spark, text, canon.format_size, "bigint") == list(text.values())
    assert values(spark, [(1 << 63) - 1, 1 << 62], canon.format_size, "bigint") == ["8192 PB", "4096 PB"]


def test_sizes_beyond_a_long(spark, tmp_path):
    from decimal import Decimal

    from gleanfold.plans import queries

    assert values(spark, [Decimal(x) for x in (1023, 1484, 102400, 5 << 50, 10**30)], canon.format_size, "decimal(38,0)") == ["1023 B", "1.4 KB", "100 KB", "5.0 PB", "888178419700125 PB"]
    spark.createDataFrame([(9_000_000, 1_200_000, 7), (1, 1, 1)], "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    exact = 9_000_001 * 1_200_003 * 10**7
    assert {r.l_orderkey: r.size_text for r in queries.format_size_text(spark, str(tmp_path)).collect()} == {9_000_000: f"{(exact + (1 << 49)) >> 50} PB", 1: "80 B"}


def test_dates(spark):
    cases = {"2024-01-15": 1705276800000, None: None, "": None, "not a date": None, "a day ago": None, "3 hours ago": NOW - 3 * 3600000, "an hour ago": NOW - 3600000, "A Minute Ago": NOW - 60000, "2 months ago": NOW - 2 * 2629800000, "yesterday": NOW - 86400000, "today": 1749945600000, "Tue, 15 Jan 2019 04:05:06 +0000": 1547525106000, "2024-01-15T01:02:03Z": 1705280523000, "1652877231": None, "3 May 21": 1620000000000}
    assert values(spark, cases, lambda c: canon.parse_date(c, NOW)) == list(cases.values())
    absolute = {"2024": 1704067200000, "2024-03": 1709251200000, "Mar 2024": 1709251200000, "March 2024": 1709251200000, "1/15/2024, 3:04:05 PM": 1705331045000, "1/15/2024 12:30 AM": 1705278600000, "Jan 15, 2024 3:04 PM": 1705331040000, "Mon Jan 15 2024 05:04:05 GMT+0200 (Some Time)": 1705287845000, "Mon Jan 15 2024 03:04:05 GMT+0000": 1705287845000, "13/45/2024, 3:04 PM": None, "20240": None}
    assert values(spark, absolute, lambda c: canon.parse_date(c, NOW)) == list(absolute.values())
    assert values(spark, [1652877231, 1652877231000, None], lambda c: canon.parse_date(F.lit(None).cast("string"), NOW, c), "bigint") == [1652877231000, 1652877231000, None]
    assert values(spark, [1705276800000, None], canon.format_date, "bigint") == ["2024-01-15", "—"]
    assert values(spark, ["Сегодня", "вчера в 3", "12 мая 2020", "3 Янв 21", "5 окт", "other"], canon.ru_date) == ["Today", "Yesterday в 3", "12 May 2020", "3 Jan 21", "5 Oct", "other"]


def test_magnets_and_text(spark):
    assert values(spark, ["Test Torrent", None, "a!'()*~&é"], lambda c: canon.build_magnet(F.lit("ABC"), c)) == ["magnet:?xt=urn:btih:ABC&dn=Test%20Torrent", "magnet:?xt=urn:btih:ABC", "magnet:?xt=urn:btih:ABC&dn=a!'()*~%26%C3%A9"]
    assert values(spark, ["", None], lambda c: canon.build_magnet(c, F.lit("x"))) == [None, None]
    h = "ABCDEF0123456789ABCDEF0123456789ABCD"
    assert values(spark, [f"magnet:?xt=urn:btih:{h}&dn=x", "short", "btih:abcdef012345", None], canon.extract_info_hash) == [h.lower(), None, None, None]
    assert values(spark, ["1,234 x", "12a", " -3", "x", None, ""], canon.to_int) == [1234, 12, -3, None, None, None]
    assert values(spark, ["http://a/b", "HTTPS://x", "javascript:1", "ftp://x", "no url at all", None], canon.safe_http_url) == ["http://a/b", "HTTPS://x", None, None, None, None]
    assert values(spark, ["My Indexer!", "--", None], canon.slug) == ["my-indexer", "indexer", "indexer"]
    assert values(spark, ["abcdefgh", "", None], canon.mask_key) == ["••••efgh", "", ""]
    assert values(spark, ["a<b> & 'Red' red"], lambda c: canon.highlight(c, "red b")) == ["a&lt;<span class=\"hl\">b</span>&gt; &amp; &#39;<span class=\"hl\">Red</span>&#39; <span class=\"hl\">red</span>"]
    assert values(spark, ["magnet:?xt=1&xl=77", "magnet:?xl=x"], canon.magnet_size) == [77, None]
    assert canon.page_number("3") == 3 and canon.page_number("x") == 1 and canon.page_number(-2) == 1 and canon.page_number(None) == 1


@pytest.mark.parametrize(("raw", "bucket"), [("Movies/HD", "movies"), ("TV", "series"), ("Anime", "anime"), ("PC Games", "games"), ("pc", "apps"), ("Audiobooks", "books"), ("FLAC", "music"), ("XXX", "porn"), ("Hentai", "porn"), ("zz", None), ("", None), (None, None), ("roman", "games"), ("étv", "series")])
def test_raw_bucket(spark, raw, bucket):
    assert values(spark, [raw], classify.bucket_of_raw) == [bucket]


TITLES = {"Show.S01E02.mkv": "series", "Show 1x02": "series", "Season 2": "series", "the complete series": "series", "éS03E04": "series", "some xxx": "porn", "Game fitgirl": "games", "Tool v2.10": "apps", "Tool x64": "apps", "Book.epub": "books", "Album FLAC": "music", "Film 1999 bluray": "movies", "Film 3999 bluray": "other", "plain": "other", "": None, None: None, "s12": "series", "as01e02": "other", "电影 2001 web-dl": "movies"}


def test_title_bucket(spark):
    assert values(spark, TITLES, classify.bucket_of_title) == list(TITLES.values())


def test_quality_and_groups(spark):
    names = ["电影4k", "a 2160p", "4kx", "1080p", "x1080p", "Dolby  Vision", "DV", "dvd", None]
    assert values(spark, names, lambda c: classify.has_quality(c, "2160p")) == [True, True, False, False, False, False, False, False, False]
    assert values(spark, names, lambda c: classify.has_quality(c, "hdr")) == [False, False, False, False, False, True, True, False, False]
    assert values(spark, names, lambda c: classify.has_quality(c, "all")) == [True] * 9
    assert values(spark, ["nyaa", "torznab:x", "what", "sukebei"], classify.source_group) == ["anime", "custom", "general", "adult"]


def test_trim(spark):
    assert values(spark, ["  ﻿a b　\t\n", " x", "-a-", None], canon.trim) == ["a b", "x", "-a-", None]
