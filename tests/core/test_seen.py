"""The log of what was seen: right for any rows, and a page's plan doesn't grow with the pages before it."""

import random

from gleanfold.operators import seen


def test_pages_against_sets(spark):
    rng = random.Random(4)
    log, known = seen.SeenLog(spark), set()
    for page in range(4):
        rows = [(rng.choice([None, "", f"i{rng.randint(0, 60)}"]), n) for n in range(50)] + [(f"p{page}-{n}", n) for n in range(200)]
        df = spark.createDataFrame(rows, "id string, n int").repartition(3)
        new = log.unseen(df)
        got = sorted(((r.id, r.n) for r in new.collect()), key=repr)
        assert got == sorted([r for r in rows if r[0] not in known], key=repr)
        assert log.add(new) == len({r[0] for r in rows} - known)
        known |= {r[0] for r in rows}
    assert {r.id for r in log.ids().collect()} == known and log.ids().count() == len(known)
    plan = log.unseen(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") + plan.count("LogicalRDD") <= 4
    log.remove()


def test_full_filter_is_still_right(spark, monkeypatch):
    """A filter with all bits set sends every row to the log."""
    monkeypatch.setattr(seen, "WORDS", 1)
    log = seen.SeenLog(spark)
    log.add(spark.createDataFrame([(f"i{n}",) for n in range(300)], "id string"))
    assert {r.id for r in log.unseen(spark.createDataFrame([("i7",), ("new",), (None,)], "id string")).collect()} == {"new", None}


def test_nothing(spark):
    log = seen.SeenLog(spark)
    assert log.ids().count() == 0 and log.add(spark.createDataFrame([], "id string")) == 0
    assert log.unseen(spark.createDataFrame([("a",)], "id string")).count() == 1
