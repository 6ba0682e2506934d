"""Concurrent writers of the indexer registry: every change stays."""

import multiprocessing
import os

from gleanfold.sources.indexers import KEPT, Indexers


def _adds(path, who, n):
    for i in range(n):
        Indexers(path).add(f"w{who} n{i}", "http://h.test")


def test_concurrent_adds_all_stay(tmp_path):
    path = f"{tmp_path}/i.json"
    ways = multiprocessing.get_context("spawn")
    writers = [ways.Process(target=_adds, args=(path, w, 25)) for w in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(60)
    assert sorted(r["id"] for r in Indexers(path).load()) == sorted(f"torznab:w{w}-n{i}" for w in range(4) for i in range(25))
    files = os.listdir(tmp_path)
    assert not [f for f in files if f.endswith(".tmp")] and len(files) == 100
    assert sum(os.path.getsize(f"{tmp_path}/{f}") > 0 for f in files) <= KEPT + 5


def test_a_very_late_writer(tmp_path):
    """However far the others are, a writer can't take a number that is behind them."""
    store, other = Indexers(f"{tmp_path}/i.json"), Indexers(f"{tmp_path}/i.json")
    calls = []

    def slow(rows):
        calls.append(1)
        for i in range(3 * KEPT if len(calls) == 1 else 0):
            other.add(f"n{i}", "http://h.test")
        return [*rows, {"id": "late"}]

    assert len(store.change(slow)) == 3 * KEPT + 1 == len(other.load()) and len(calls) == 2


def test_a_writer_that_is_overtaken_starts_anew(tmp_path):
    store, other = Indexers(f"{tmp_path}/i.json"), Indexers(f"{tmp_path}/i.json")
    calls = []

    def slow(rows):
        calls.append(len(rows))
        if len(calls) == 1:
            other.add("Quick", "http://q.test")
        return [*rows, {"id": "slow"}]

    assert [r["id"] for r in store.change(slow)] == ["torznab:quick", "slow"] and calls == [0, 1]
    assert store.add("Quick", "http://q.test")["id"] == "torznab:quick-2"
    assert store.remove("slow") and not store.remove("slow") and len(other.load()) == 2


def test_store_of_one_file(tmp_path):
    """A store that was one file is read as its first version."""
    (tmp_path / "i.json").write_text('[{"id": "torznab:a", "name": "A"}, {"no": "id"}, 7]')
    store = Indexers(f"{tmp_path}/i.json")
    assert [r["id"] for r in store.load()] == ["torznab:a"]
    store.add("B", "https://b.test")
    assert [r["id"] for r in store.load()] == ["torznab:a", "torznab:b"]
