"""The trigram index gives what a scan gives, and reads less."""

import random

import pytest

from gleanfold.operators import refine, textindex


def table(spark, n=3000):
    rng = random.Random(5)
    words = ["lamp", "Ember", "été", "quill", "İstanbul", "north", "ab", "x", "电影", "𝔸𝔹𝔸"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), "s", 1) for i in range(n)]
    rows += [(n, None, "s", 1), (n + 1, "", "s", 1), (n + 2, "needle in " + "hay " * 5000, "s", 1)] + [(n + 3, "one row again", "s", 1)] * 700
    return spark.createDataFrame(rows, "id long, name string, segment string, block int").repartition(5, "id")


@pytest.fixture(scope="module")
def index(spark):
    df = table(spark)
    return df, textindex.build_index(df)


@pytest.mark.parametrize("query", ["lamp", "Ember lamp", "ÉTÉ", "ab", "x", "needle", "hay needle", "istanbul", "电影", "𝔸𝔹𝔸", "again one", "nowhere", "", "lam nee"])
def test_as_a_scan(index, query):
    df, built = index
    want = sorted((r.id, r.name) for r in df.where(refine.matches(query)).collect()) if query else sorted(((r.id, r.name) for r in df.collect()), key=repr)
    got = built.search(query).select("id", "name").collect()
    assert sorted(((r.id, r.name) for r in got), key=repr) == sorted(want, key=repr)


def test_a_rare_word_reads_little(spark, monkeypatch):
    monkeypatch.setattr(textindex, "ROW_GROUP", 4096)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))) for i in range(4000)] + [(9999, "the zebra")]
    built = textindex.build_index(spark.createDataFrame(rows, "id long, name string").repartition(4, "id"))
    assert [r.id for r in built.search("zebra").collect()] == [9999]
    part = {r.part: r for r in built.reading("zebra").collect()}
    assert part["rows"].bytes_read < part["rows"].bytes_all / 20 and part["masks"].bytes_read < part["masks"].bytes_all / 5
    assert len(built.segments(textindex.trigrams("zebra"))) == 1
    assert {r.bytes_read for r in built.reading("qqqzzz").collect()} == {0}


def test_many_blocks_are_joined(index, monkeypatch):
    df, built = index
    monkeypatch.setattr(textindex, "NAMED_BLOCKS", 1)
    assert built.search("lamp").count() == df.where(refine.matches("lamp")).count()


def test_empty_table(spark):
    built = textindex.build_index(table(spark).limit(0))
    assert built.search("lamp").count() == 0 and built.search("x").count() == 0
