"""Pushing once: a ledger of what was sent, tasks and jobs that run again."""

import os
from collections import Counter

import pytest

from gleanfold import pushing
from gleanfold.shared import names, opened

CONFIG = {"url": "http://client.test"}


def sent(folder) -> Counter:
    return Counter(line for n in os.listdir(folder) if n.startswith("sent-") for line in open(f"{folder}/{n}").read().splitlines())


@pytest.fixture
def listed(spark):
    rows = [(i, None if i % 10 == 9 else f"magnet:?xt={'bad' if i % 4 == 3 else 'ok'}{i % 30}") for i in range(60)]
    return spark.createDataFrame(rows, "ord long, magnet string")


def test_once(spark, listed, tmp_path):
    send = "tests.core.test_pushing:folder_client"
    ledger = f"file://{tmp_path}/ledger"
    want = {m for i in range(60) if i % 10 != 9 for m in [f"magnet:?xt={'bad' if i % 4 == 3 else 'ok'}{i % 30}"]}
    n_bad = sum("bad" in m for m in want)
    config = {"url": f"http://client.test/{tmp_path}"}
    first = pushing.push_once(listed, "aria2", config, ledger, job="a", chunk=4, send=send)
    assert first == {"taken": len(want) - n_bad, "refused": n_bad, "unknown": 0}
    # the same job again, as when the driver was lost before it heard of the end: nothing is sent, the outcome is known
    assert set(sent(tmp_path).values()) == {1}
    before = sent(tmp_path)
    pushing.push_once(listed, "aria2", config, ledger, job="a", chunk=4, send=send)
    assert sent(tmp_path) == before
    # another job sends only what was refused
    later = pushing.push_once(listed, "aria2", config, ledger, job="b", send=send)
    assert later == {"taken": 0, "refused": n_bad, "unknown": 0}
    again = sent(tmp_path)
    assert {m: n for m, n in again.items() if "ok" in m} == {m: 1 for m in again if "ok" in m} and all(n == 2 for m, n in again.items() if "bad" in m)
    rows = pushing.ledger_rows(spark, ledger).where("job = 'a'").collect()
    assert len(rows) == len(want) and sum(r.taken for r in rows) == len(want) - n_bad


def test_begun_but_unknown(spark, listed, tmp_path):
    """A chunk that was begun and has no outcome is left out, or sent again if that is asked for."""
    send, ledger = "tests.core.test_pushing:folder_client", f"file://{tmp_path}/ledger"
    config = {"url": f"http://client.test/{tmp_path}"}
    pushing.push_once(listed, "aria2", config, ledger, job="a", chunk=3, send=send, tasks=2)
    files, path = opened(ledger)
    lost = names(files, f"{path}/done")[0]
    files.delete_file(f"{path}/done/{lost}")  # as if its executor had been lost while it sent
    files.delete_file(f"{path}/jobs/a.json")
    before = sent(tmp_path)
    skipped = pushing.push_once(listed, "aria2", config, ledger, job="a", chunk=3, send=send, tasks=2)
    assert skipped["unknown"] == 3 and sent(tmp_path) == before
    files.delete_file(f"{path}/jobs/a.json")
    resent = pushing.push_once(listed, "aria2", config, ledger, job="a", chunk=3, send=send, tasks=2, unsure="send")
    assert resent["unknown"] == 0 and sum((sent(tmp_path) - before).values()) == 3


def test_nothing_and_unknown_client(spark, listed, tmp_path):
    assert pushing.push_once(listed.where("magnet IS NULL"), "gopeed", CONFIG, f"file://{tmp_path}/l") == {"taken": 0, "refused": 0, "unknown": 0}
    with pytest.raises(ValueError, match="unknown client"):
        pushing.push_once(listed, "nope", CONFIG, f"file://{tmp_path}/l")


def folder_client(url, body, headers):
    """An aria2 stand-in that notes every magnet in the folder that its address names."""
    import json

    folder = url.removeprefix("http://client.test").removesuffix("/jsonrpc")
    magnet = json.loads(body)["params"][-1][0]
    with open(f"{folder}/sent-{os.getpid()}", "a") as f:
        f.write(magnet + "\n")
    return 200, {}, b'{"error": {"code": 1}}' if "bad" in magnet else b'{"result": "1"}'
