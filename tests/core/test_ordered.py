"""Deep pages read one range; merges of a hot hash stay bounded and whole."""

import random

import pytest
from pyspark.sql import functions as F

from gleanfold.operators import listings, ordered


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3, 5]), f"n{i}") for i in range(5000)]  # ties: a key has a fifth of the rows
    df = spark.createDataFrame(rows, "ord long, seeders long, name string").repartition(4)
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))
    return want, ordered.ordered_table(df, F.coalesce("seeders", F.lit(-1)).desc(), F.col("ord"))


@pytest.mark.parametrize("page", [1, 2, 125, 249, 250, 251, 9999])
def test_page(table, page):
    want, t = table
    got = t.page(page)
    assert [(r.ord, r.seeders, r.name) for r in got.collect()] == want[20 * (page - 1) : 20 * page]
    assert [r.place for r in got.collect()] == list(range(20 * (page - 1) + 1, min(20 * page, 5000) + 1))[: len(want[20 * (page - 1) : 20 * page])]


def test_page_reads_one_range(table):
    want, t = table
    assert t.total == 5000 and len(t.ranges) > 4
    plan = t.between(2000, 2020)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    parts = {i for i, first in enumerate(t.firsts) for end in [(t.firsts + [t.total])[i + 1]] if first < 2020 and end > 2000}
    assert len(parts) <= 2


def test_rows_that_follow(table):
    want, t = table
    seen = []
    while len(seen) < 100:
        seen += [(r.ord, r.seeders, r.name) for r in t.after(len(seen), 33).collect()]
    assert seen == want[: len(seen)]
    assert [(r.ord, r.seeders, r.name) for r in t.rows().orderBy("place").collect()] == want


def test_long_stretch_and_empty(spark, table, monkeypatch):
    want, t = table
    many = ordered.OrderedTable(t.spark, t.folder, t.ranges * 1, t.firsts, t.total, t.schema)
    assert many.between(10, 4990).count() == 4980
    empty = ordered.ordered_table(spark.createDataFrame([], "ord long, seeders long, name string"), F.col("ord"))
    assert empty.total == 0 and empty.page(1).count() == 0 and empty.rows().count() == 0


def test_merge_first_is_merge_sources(spark):
    rng = random.Random(9)
    rows = [(f"p{rng.randint(0, 3)}:{i}", f"n{i}", rng.choice(["Aa", "aa", "b", None, ""]), rng.choice([None, 5, 7]), rng.choice([None, 1]), None, rng.choice([None, 3]), f"p{rng.randint(0, 3)}", rng.choice([None, "x"]), rng.choice([None, "u"]), rng.choice([None, 2]), rng.choice([None, f"m{i}"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, name string, info_hash string, size long, seeders long, leechers long, date_ms long, provider string, category string, detail_url string, files long, magnet string, ord long").repartition(5)
    whole = {r.key: r for r in listings.merge_sources(df).collect()}
    cut = {r.key: r for r in listings.merge_first(df, 4).collect()}
    assert set(whole) == set(cut)
    for key, w in whole.items():
        c = cut[key]
        for name in ("ord", "name", "size", "size_text", "seeders", "leechers", "date_ms", "date_text", "category", "files", "info_hash", "magnet", "needs_magnet"):
            assert w[name] == c[name], (key, name)
        assert c.sources == w.sources[:4] and c.n_sources == len(w.sources) and c.n_providers == len(set(w.providers))


def test_hot_hash_is_cut_before_the_shuffle(spark):
    df = spark.range(0, 3000, 1, 6).select(F.col("id").alias("ord"), F.concat(F.lit("h"), (F.col("id") % 1).cast("string")).alias("info_hash"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"), *(F.lit(None).cast("long").alias(c) for c in ("size", "seeders", "leechers", "date_ms", "files")), F.lit("p").alias("provider"), *(F.lit(None).cast("string").alias(c) for c in ("category", "detail_url", "magnet")))
    merged = listings.merge_first(df, 3)
    assert "WindowGroupLimit" in merged._jdf.queryExecution().executedPlan().toString()
    r = merged.first()
    assert (r.n_sources, [s.id for s in r.sources]) == (3000, ["i0", "i1", "i2"])
