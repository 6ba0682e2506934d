"""Sharding, packing, token tables, SimHash and quality rules against brute force."""

import io
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from .helpers import SCHEMA, awkward_rows, crc, frame, roots

ROWS = awkward_rows()


def least_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 4, 40])
def test_shards(spark, n):
    from gleanfold.llm.sharding import minimax_shards

    got = minimax_shards(frame(spark, ROWS), n).collect()
    assert len(got) == len(ROWS)
    expected = sorted((r[0], len((r[1] or "").encode()) + 16, crc((r[1] or "").encode())) for r in ROWS)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    slots, where, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    assert all(len(s) == 1 for s in where.values())
    groups = Counter()
    for r in got:
        groups[r.text_crc32] += r["size"]
    assert max(load.values()) <= max(max(groups.values()), sum(groups.values()) / n + sorted(groups.values())[-min(2, len(groups))])


@pytest.mark.parametrize("n_groups,n_cells,n", [(100_000, 64, 40), (3000, 64, 7), (500, 1 << 15, 3), (12, 4, 13), (40, 64, 1)])
def test_capacity_is_least_over_groups(spark, n_groups, n_cells, n):
    """However coarse the cells at first, the capacity is that of the exact search over all groups in order."""
    from pyspark.sql import functions as F

    from gleanfold.llm.sharding import best_cuts

    rng = np.random.default_rng(n_groups)
    sizes = rng.integers(16, 4000, n_groups)
    sizes[: min(3, n_groups // 10)] = sizes.sum() // 5  # larger than an even share, if there are many shards
    groups = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "i long, bytes long").select(F.xxhash64("i").alias("h"), "bytes")
    own, cuts, capacity = best_cuts(groups, n, n_cells)
    rows = sorted((r.h, r.bytes) for r in groups.collect())
    big = sorted(rows, key=lambda r: (-r[1], r[0]))
    left, alone = sum(r[1] for r in rows), []
    while len(alone) < n - 1 and big and big[0][1] * (n - len(alone)) > left:
        left -= big[0][1]
        alone.append(big.pop(0)[0])
    rest = [(h, x) for h, x in rows if h not in alone]
    assert own == alone and capacity == (least_capacity([x for _, x in rest], n - len(own)) if rest else 0) and len(cuts) < n - len(own)
    loads = [0] * (len(cuts) + 1)
    for h, x in rest:
        loads[sum(c <= h for c in cuts)] += x
    assert max(loads) <= capacity and cuts == sorted(cuts)
    if n_groups == 100_000:
        assert min(loads) > 0.9 * sum(loads) / len(loads) and len(loads) == n - len(own)


def test_two_shardings_at_once(spark):
    """Nothing of one call, nor a view of the user's, stands in another's way."""
    from gleanfold.llm.sharding import minimax_shards

    spark.range(3).createOrReplaceTempView("gathered_cells")
    a, b = (minimax_shards(frame(spark, ROWS[k:]), 4) for k in (0, 30))
    assert a.count() == len(ROWS) and b.count() == len(ROWS) - 30 and spark.table("gathered_cells").count() == 3


def brute_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_packing(spark):
    from gleanfold.llm.packing import pack_documents

    rows = [(i, *r[1:]) for i, r in enumerate(ROWS)]
    ids = dict(zip((r[0] for r in rows), brute_ids([r[1] for r in rows])))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in pack_documents(frame(spark, rows), block_tokens=20000).coalesce(1).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.ids_crc32 == crc(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length, r.window, r.step_group))
    for d, p in pieces.items():
        assert sum(n for _, n in p) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
    assert set(pieces) == set(ids)
    groups = Counter()
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n, *_), (b, *_) in zip(w, w[1:]))
        size = sum(x[1] for x in w)
        assert size == w[0][2] <= 2048 and size & (size - 1) == 0
        groups[w[0][3]] += size
    assert max(groups.values()) <= 8 * 2048


def test_token_tables(spark):
    from gleanfold.llm.sstable import read_token_tables, write_token_tables
    from gleanfold.llm.common import new_path

    rows = [*ROWS, (None, "no name", None, None, 7), (-5, "below zero", None, None, 10)]
    manifest = write_token_tables(frame(spark, rows), new_path(spark, "t"), n_shards=5)
    got = read_token_tables(spark, manifest, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = brute_ids([r[1] for r in order])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert sorted((r.doc_id or -99, tuple(r.ids)) for r in got) == sorted((r[0] or -99, tuple(i.tolist())) for r, i in zip(order, ids))
    assert all(r.ids_crc32 == crc(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)


def test_token_tables_hot_identifier(spark):
    from gleanfold.llm.common import new_path
    from gleanfold.llm.sstable import decode_key, lookup, read_token_tables, write_token_tables

    rows = [(i, f"text {i}") for i in range(1000, 1200)] + [(7, f"other text {i}") for i in range(100)] + [(7, "the same text")] * 100 + [(None, None), (None, "no name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = write_token_tables(docs, new_path(spark, "hot"), n_shards=8)
    holding = [m for m in manifest if decode_key(bytes.fromhex(m["first"])) in (None, 7) and decode_key(bytes.fromhex(m["last"])) is not None]
    assert len(holding) >= 3 and max(m["n_docs"] for m in manifest) < 150
    got = sorted(read_token_tables(spark, manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    expected = {(r[0], tuple(i.tolist())) for r, i in zip(rows, brute_ids([r[1] for r in rows]))}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == expected and len(got) == len(rows)
    for k, n in ((7, 200), (None, 2), (1100, 1), (5, 0), (5000, 0)):
        assert sorted(lookup(manifest, k)) == sorted(r.ids for r in got if r.doc_id == k) and len(lookup(manifest, k)) == n


def test_table_lookup():
    from gleanfold.llm.sstable import TableReader, decode_key, encode_key, write_table

    keys = [None, -7, -7, *range(0, 3000, 3)]
    out = io.BytesIO()
    write_table(out, ((encode_key(k), bytes([(k or 0) % 251, 0]) * 50) for k in keys), 2, block_bytes=1000)
    table = TableReader(out)
    assert len(table.index) > 20 and [decode_key(k) for k, _ in table] == keys
    assert len(table.get(encode_key(-7))) == 2 and table.get(encode_key(33)) == [bytes([33, 0]) * 50]
    assert table.get(encode_key(34)) == [] and sum(table.may_contain(encode_key(k)) for k in range(1, 3000, 3)) < 60
    empty = io.BytesIO()
    write_table(empty, [], 2)
    assert list(TableReader(empty)) == [] and TableReader(empty).get(encode_key(1)) == []


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("split", [4096, 2])
def test_simhash(spark, split, monkeypatch):
    from gleanfold.llm import simhash

    monkeypatch.setattr(simhash, "SPLIT", split)
    rows = [(i, *r[1:]) for i, r in enumerate(ROWS)]
    fp = {r[0]: brute_fingerprint(r[1]) for r in rows}
    ids = list(fp)
    expected = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = {r.doc_id: r for r in simhash.simhash_components(frame(spark, rows)).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{x:016x}" for d, x in fp.items()}
    assert {d: r.component_id for d, r in got.items()} == expected


@pytest.mark.parametrize("split", [4096, 3])
def test_near_edges_lose_nothing(spark, split, monkeypatch):
    from gleanfold.llm import simhash
    from gleanfold.llm.common import connected_components

    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(12):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = [x - 2**64 if x >= 2**63 else x for x in fps]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    expected = roots(fps, near)
    got = {r.node: r.root for r in connected_components(simhash.near_edges(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    assert {x: got.get(x, x) for x in fps} == expected


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(three), set()
    for i, t in enumerate(three):
        if times[t] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_quality(spark):
    from gleanfold.llm.quality import BASE, fit_quality, quality_rules, text_statistics, train_forest

    for t in [*[r[1] for r in ROWS], "a b c a b c", "a a a a", "x\nx\n\n \n y\ny", "#*$ | <> é"]:
        assert text_statistics(t)[0] == brute_base(t)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(61, None)], "doc_id long, quality int")
    docs = frame(spark, ROWS)
    got = quality_rules(docs, fit_quality(docs, labels)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    none = quality_rules(docs, fit_quality(docs, labels.limit(0))).collect()
    assert all(r.kept == (not r.base_failed) for r in none) and [x for x in BASE if x not in none[0]] == []
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 0]) + 0.2 * rng.random(400) > 0.6).astype(float)
    free, held = train_forest(x, y, [0, 0]), train_forest(x, y, [1, 0])
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], axis=1)
    assert np.all(np.diff(held.score(grid)) >= -1e-12) and not np.all(np.diff(free.score(grid)) >= -1e-12)


def test_flat_forest_is_its_trees():
    """Vectorised scoring equals walking every tree node by node, and verdicts follow from it."""
    from gleanfold.llm.quality import train_forest

    rng = np.random.default_rng(7)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = train_forest(x, y, [0, 0, 1, -1])
    probes = np.vstack([rng.random((200, 4)), x[:50], np.full((1, 4), np.inf), np.zeros((1, 4))])

    def walk(row):
        total = forest.bias
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(probes), [walk(r) for r in probes], atol=1e-12) and np.mean((forest.score(x) > 0.5) == y) > 0.95


def test_empty_tables(spark):
    from gleanfold.llm.packing import pack_documents
    from gleanfold.llm.quality import fit_quality, quality_rules
    from gleanfold.llm.sharding import minimax_shards
    from gleanfold.llm.simhash import simhash_components
    from gleanfold.llm.sstable import token_tables

    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (minimax_shards(none, 40), pack_documents(none), simhash_components(none), token_tables(none), quality_rules(none, fit_quality(none, labels))):
        assert df.count() == 0
