"""Bin slack packing, vector codes and the conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from .helpers import awkward_rows, crc, frame


# ---- op11


def test_fullest_is_the_fullest():
    from gleanfold.llm.slack import fullest

    rng = random.Random(1)
    for _ in range(200):
        left = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        gap = rng.randint(0, 60)
        sums = {0}
        for n, c in left.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= gap}
        used = fullest(gap, sorted(left), left)
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= left[n] for n, k in used.items())


def test_plan_is_small_and_tight():
    from gleanfold.llm.slack import plan

    rng = np.random.default_rng(4)
    for n in (5_000, 5_000_000):
        lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 4096), return_counts=True)
        slots = plan(dict(zip(lengths.tolist(), counts.tolist())), 4096)
        assert len({s[3] for s in slots}) < 4096 * 10  # the bound in the module's text
        bins, least = max(s[3] for s in slots) + 1, -(-int((lengths * counts).sum()) // 4096)
        assert bins <= least * 1.03 + 1


@pytest.mark.parametrize("window", [4096, 64])
def test_bin_slack(spark, window):
    from gleanfold.llm.slack import pack_fullest
    from gleanfold.llm.tokens import default_tokenizer, encoder

    rows = awkward_rows() + [(9000 + i, None, None, None, None) for i in range(40)]  # one length in a third of the rows
    encode = encoder(default_tokenizer())
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(encode(r[1]))
    got = pack_fullest(frame(spark, rows), window=window).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, texts in ids.items():
        want = []
        for x in texts:
            n = len(x) // 4
            want += [(k, s, min(window, n - s), crc(x[4 * s : 4 * min(n, s + window)])) for k, s in enumerate(range(0, n, window))]
        assert sorted(pieces[doc_id]) == sorted(want)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= window
    assert set(pieces) == set(ids)
    total = sum(len(x) // 4 for xs in ids.values() for x in xs)
    assert len(bins) <= -(-total // window) * 1.05 + 1


def test_bin_slack_of_nothing(spark):
    from gleanfold.llm.slack import pack_fullest

    assert pack_fullest(frame(spark, awkward_rows()).limit(0)).count() == 0


# ---- op12


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [int(np.floor(scale * float(v))) for v in x], lab) for i, x, lab in rows if x is not None and None not in x and np.isfinite(x).all() and len(x)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    books = [[r[1][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(parts)]

    def near(p, x):
        own = x[p * width : (p + 1) * width]
        d = [sum((a - b) ** 2 for a, b in zip(own, e)) for e in books[p]]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        sums = defaultdict(lambda: [0] * width)
        n = Counter()
        for _, x, _ in kept:
            for p in range(parts):
                j, _ = near(p, x)
                n[p, j] += 1
                sums[p, j] = [a + b for a, b in zip(sums[p, j], x[p * width : (p + 1) * width])]
        for (p, j), c in n.items():
            books[p][j] = [s // c for s in sums[p, j]]
    out, by_label = [], Counter()
    for i, x, lab in kept:
        found = [near(p, x) for p in range(parts)]
        error = sum(d for _, d in found)
        by_label[lab] += error
        out.append((i, tuple(j for j, _ in found), error, lab))
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return sorted((i, c, min(e, most), min(by_label[lab], most)) for i, c, e, lab in out), digest


def code_rows(scale=1.0, grid=False):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        x = rng.integers(-3, 4, 16) / 4096 if grid else rng.normal(size=16) * scale  # on the grid most distances tie
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(3)) if i % 4 else None))
    rows += [(7, rows[7][1], 1), (7, rows[9][1], 2)] + [(500 + i, rows[3][1], 1) for i in range(120)]
    return rows + [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("-inf")] * 16, None)]


@pytest.mark.parametrize("case", ["plain", "ties", "wide", "few"])
def test_vector_codes(spark, case):
    from gleanfold.llm.vectorcodes import books_sha256, compress_vectors, decode_vectors, with_label_error

    rows = {"plain": code_rows(), "ties": code_rows(grid=True), "wide": code_rows(3e5), "few": code_rows()[:5]}[case]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' code", "'y' id", "'z' x").repartition(5)
    codes, books = compress_vectors(df)
    got = sorted((r.id, tuple(r.code), r.error, r.label_error) for r in with_label_error(codes).collect())
    want, digest = brute_codes(rows)
    assert got == want and books_sha256(books) == digest
    if case == "plain":
        first = decode_vectors(codes, books).where("id = 3").first()
        width = 2
        assert first.vector == [(int(v) + 0.5) / 4096 for p, j in enumerate(first.code) for v in books[p][j][:width]]


def test_vector_codes_without_vectors(spark):
    from gleanfold.llm.vectorcodes import books_sha256, compress_vectors, with_label_error

    df = spark.createDataFrame([(1, None, 1), (2, [1.0] * 7, 1), (3, [], None)], "vec_id long, embedding array<float>, label int")
    codes, books = compress_vectors(df)
    assert with_label_error(codes).count() == 0 and books_sha256(books) == hashlib.sha256(b"").hexdigest()


def test_bounds_prune():
    """On clustered parts the bounds leave out most distances, and the codes stay those of a full search."""
    from gleanfold.llm.vectorcodes import _root, assign

    rng = np.random.default_rng(8)
    book = rng.integers(-2000, 2000, (16, 8))
    x = book[rng.integers(16, size=3000)] + rng.integers(-40, 40, (3000, 8))
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, 1 << 61), np.zeros((3000, 16), np.int64)
    first = assign(x, book, code, upper, lower)
    moved = rng.integers(-5, 6, book.shape)
    shift = _root((moved**2).sum(1), up=True)
    upper += shift[code]
    lower = np.maximum(0, lower - shift)
    again = assign(x, book + moved, code, upper, lower)
    full = ((x[:, None] - (book + moved)[None]) ** 2).sum(2).argmin(1)
    assert (code == full).all() and again < 0.1 * 16 * 3000 < first


# ---- op13


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c].sort(key=lambda t: (t[0], t[1], t[2], hashlib.sha256((str(len(t[2].encode())) + ":" + t[2] + t[3]).encode()).digest()))
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(t[2:] for t in convs.get(c - c % 5, [])[:h] + convs[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[k] for k in kids[path])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def talk_rows(seed=3, n=90):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 10:
            continue  # an absent base for some
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hé", "yes", "no", "", None, "maybe so"]) if t else "Hello"))
    rows += [(200 + c, t, "user", f"turn {t}") for c in range(700) for t in range(2)]  # a third of the rows: copies
    rows += [(1001 + 5 * c, t, "user", f"same {min(t, 10 + c)}") for c in range(2) for t in range(14)]  # a deep fork
    rows += [(1200, None, None, None), (1200, 0, "user", "x"), (1200, 0, "user", "x"), (1200, 0, "user", "a"), (1200, None, "", "")]
    return rows + [(None, 0, "user", "lost"), rows[0], (1301, 0, "user", "one turn that its head replaces")]


@pytest.mark.parametrize("chunk", [512, 3])
def test_conversation_trie(spark, chunk, monkeypatch):
    from gleanfold.llm import convtrie

    monkeypatch.setattr(convtrie, "CHUNK", chunk)
    rows = talk_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' conv", "'y' depth", "'z' n", "1 as range").repartition(4)
    nodes = convtrie.conversation_trie(*convtrie.rebuilt_turns(df))
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())
    assert got == brute_trie(rows)


def test_one_endless_conversation(spark):
    """One conversation with most rows, all of them alike."""
    from gleanfold.llm import convtrie

    rows = [(5, 1, "user", "again")] * 600 + [(c, t, "user", "again") for c in (7, 10) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in convtrie.conversation_trie(*convtrie.rebuilt_turns(df)).collect())
    assert got == brute_trie(rows)


def test_no_conversations(spark):
    from gleanfold.llm import convtrie

    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert convtrie.conversation_trie(*convtrie.rebuilt_turns(df)).count() == 0
