"""Cover tree, pieces, suffix arrays, language ID and license scan against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from .helpers import SCHEMA, awkward_rows, crc, frame, prose, roots


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(40, 8))
    for i in range(300):
        x = base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.03, 0.2])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(3))))
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [], 1), (403, [float("nan")] * 8, 1), (404, [1.0, None] + [0.0] * 6, 1), (405, [float("inf")] + [1.0] * 7, 1), (406, rows[0][1], None), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1)]
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(30)]
    return rows


def test_tiny_and_huge_vectors(spark):
    """Squares that under- or overflow make no links: (1, 2) and (2, 1) have cosine 0.8 at any scale."""
    from gleanfold.llm.covertree import embedding_components

    rows = [(0, [1e-200, 2e-200], 1), (1, [2e-200, 1e-200], 1), (2, [1e-200, 2.01e-200], 1), (3, [1e200, 2e200], 1), (4, [2.0, 1.0], 1), (5, [-1e300, -2e300], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 1: (1, 1), 2: (2, 0), 3: (2, 0), 4: (1, 1), 5: (0, 5)}


@pytest.mark.parametrize("node_rows", [2048, 16])
def test_cover_tree(spark, node_rows):
    from gleanfold.llm.covertree import embedding_components

    rows = vectors()
    ok = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = list(ok)
    links = [(a, b) for a in ids for b in ids if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    expected = roots([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' rep", "'y' n", "'z' cell")
    got = {r.vec_id: r for r in embedding_components(df, node_rows=node_rows).collect()}
    assert len(got) == len(rows) and len(links) > 100
    assert {i: r.n_links for i, r in got.items()} == {r[0]: degree[r[0]] for r in rows}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_pieces(spark):
    import sentencepiece

    from gleanfold.llm.pieces import decode_pieces, default_model, encode_pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    odd = ["Hello  world \n x  ", " a b c ﬁ ½ ﻿ 한글 \U0001F9FF", "  lead", "x\n\n\ny\t z", "▁a ▁▁b", "    ", "<s> </s> <unk> <0x0A>", "\r\n a", "unbelievably internationalization" * 5]
    rows = [(i, r[1], None, None, None) for i, r in enumerate(awkward_rows())] + [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    texts = {r[0]: r[1] for r in rows}
    got = decode_pieces(encode_pieces(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "")
        assert list(r.ids) == ids and r.ids_crc32 == crc(np.array(ids, "<u4").tobytes()) and r.decoded == sp.decode(ids)


def test_suffix_array():
    from gleanfold.llm.suffix import suffix_array

    rng = random.Random(3)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randrange(40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_cover(texts, width=400):
    times = Counter(x[i : i + width] for x in texts for i in range(len(x) - width + 1))
    out = []
    for x in texts:
        mark = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if times[x[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        out.append(bytes(mark))
    return out


def repeated_texts(seed=9):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (50, 70, 90, 200, 400)]
    texts = []
    for i in range(90):
        parts = [prose(rng, rng.choice([1, 10, 60]))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            if rng.random() < 0.5:
                a = rng.randrange(len(s) // 3)
                s = s[a : len(s) - rng.randrange(len(s) // 3)]
            if rng.random() < 0.4:
                at = rng.randrange(len(s))
                s = s[:at] + "é" + s[at + 1 :]
            parts += [s, prose(rng, rng.choice([0, 3, 30]))]
        texts.append(rng.choice([" ", "\n"]).join(parts))
    texts += [shared[3] * 3, "ab" * 1000, "ab" * 900 + "c" + "ab" * 300, "q" * 399, "q" * 400, "z" * 401, "word " * 700]
    return texts


@pytest.mark.parametrize("limits", [{}, {"bucket_bytes": 3000}, {"max_contexts": 3}])
def test_repeats(spark, limits):
    from gleanfold.llm.suffix import remove_repeats

    awkward = awkward_rows()
    rows = [(i, t, None, None, None) for i, t in enumerate([*repeated_texts(), *(r[1] for r in awkward)])]
    raw = [(r[1] or "").encode() for r in rows]
    marks = brute_cover(raw)
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows), **limits).collect()}
    assert len(got) == len(rows) and sum(map(sum, marks)) > 20000
    for i, (b, m) in enumerate(zip(raw, marks)):
        kept = bytes(c for c, x in zip(b, m) if not x)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(m), len(re.findall(b"\1+", m)), hashlib.sha256(kept).hexdigest()), i
        assert bytes(r.kept) == kept


@pytest.mark.parametrize("limits", [{}, {"bucket_bytes": 3000}, {"max_contexts": 3}])
def test_repeats_and_passages(spark, limits):
    """Both windows in one table equal brute force, whether or not a text is searched for the longer one."""
    from gleanfold.llm.suffix import remove_repeats

    rng = random.Random(12)
    short = [prose(rng, n) for n in (40, 52, 56, 60)]
    texts = [" ".join([prose(rng, 30), short[i % 4], prose(rng, 20), *(short[:2] if i % 7 == 0 else [])]) for i in range(40)]
    rows = [(i, t, None, None, None) for i, t in enumerate([*repeated_texts(), *texts, *(r[1] for r in awkward_rows())])]
    raw = [(r[1] or "").encode() for r in rows]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows), passage_window=240, passage_words=50, **limits).collect()}
    assert len(got) == len(rows)
    only_short = 0
    for i, (b, m, n) in enumerate(zip(raw, brute_cover(raw), brute_cover(raw, 240))):
        r = got[i]
        kept = bytes(c for c, x in zip(b, m) if not x)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), sum(m), len(re.findall(b"\1+", m)), hashlib.sha256(kept).hexdigest(), kept), i
        found = [x.span() for x in re.finditer(b"\1+", n) if len(b[x.start() : x.end()].split()) >= 50]
        left = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in found)], [*(x for x, _ in found), len(b)]))
        assert (r.n_passages, r.passage_bytes, bytes(r.kept_passages)) == (len(found), sum(y - x for x, y in found), left), i
        only_short += bool(found) and not any(m)
    assert only_short > 10


def test_planted_passages_of_the_query(spark, tmp_path):
    """Passages of 51 to 59 words, all under 400 bytes, in two documents or more: found by the query, clean documents stay."""
    from gleanfold.llm.queries import op5_suffix_array

    rng = random.Random(13)
    vary = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 7))) for _ in range(n))
    planted = [vary(n) for n in range(51, 60)]
    assert all(240 <= len(p.encode()) < 400 for p in planted)
    texts = [" ".join([vary(80), planted[i % 9], vary(90)]) if i < 40 else vary(200) for i in range(80)]
    frame(spark, [(i, t, "en", None, len(t)) for i, t in enumerate(texts)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_suffix_array(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_removed, r.text) == (0, t)  # the contract's 400 bytes
        if i < 40:
            assert r.n_passages == 1 and planted[i % 9] not in r.text_without_passages and len(t) - len(r.text_without_passages) == r.passage_bytes
        else:
            assert (r.n_passages, r.text_without_passages) == (0, t)


def test_repeats_by_segments(spark, monkeypatch):
    from gleanfold.llm import anchors
    from gleanfold.llm.suffix import suffix_array, repeated_windows

    rng = random.Random(1)
    raw = (prose(rng, 3000)).encode()
    whole = anchors.anchors(raw)
    monkeypatch.setattr(anchors, "_SEGMENT", 5000)
    cut = anchors.anchors(raw)
    assert set(whole[0].tolist()) == set(cut[0].tolist())
    owned = [s for a, b in zip(cut[1].tolist(), cut[2].tolist()) for s in range(a, b + 1)]
    assert owned == list(range(len(raw) - 399))
    assert repeated_windows([(10, raw[:700]), (10, raw[:700][:500] + b"x" * 200)])[0] == [0, 101]


def test_language(spark):
    from gleanfold.llm.langid import BitmaskFilter, fit_languages, held_out, identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs.where(~held_out()))
    got = identify(docs, model).join(docs.select("doc_id", "lang", held_out().alias("out")), "doc_id").where("out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    rows = [*awkward_rows(), (900, "1234 !!", "en", None, 7)]
    odd = identify(frame(spark, rows), model).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for r, t in ((r, dict((x[0], x[1]) for x in rows)[r.doc_id]) for r in odd))
    codes = np.arange(3000, dtype=np.uint32)
    masks = np.stack([codes % 2 == 0, codes % 3 == 0], axis=1)
    f = BitmaskFilter.build(["a", "b"], codes, masks)
    slots = f.slots
    hit = slots[:, next(iter(f._places(codes, f.bits)))]
    for p in f._places(codes, f.bits):
        hit = hit & slots[:, p]
    assert all((hit[0] & 1)[masks[:, 0]]) and all((hit[0] >> 1 & 1)[masks[:, 1]]) and f.rates.max() < 0.05
    many = BitmaskFilter.build([f"l{i}" for i in range(70)], codes[:70], np.eye(70, dtype=bool))
    assert many.slots.shape[0] == 2
    none = fit_languages(docs.limit(0))
    assert identify(docs.limit(3), none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_against_exact_sets(spark):
    """The filters' decision is that of exact sets of n-grams, but for false positives; rare languages, ties and uncovered texts."""
    from gleanfold.llm.langid import _codes, fit_languages, identify

    rng = random.Random(6)
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "nopqrstu"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(x, 300), x, None, None) for i, x in enumerate(["aa"] * 60 + ["bb"] * 30 + ["cc"] * 2)]
    model = fit_languages(spark.createDataFrame(rows, SCHEMA), docs_per_lang=100)
    assert model.languages == ["aa", "bb", "cc"]
    counts = {x: Counter() for x in alphabets}
    picked = {x: [r for r in rows if r[2] == x] for x in alphabets}
    for x, rs in picked.items():
        for r in rs:
            counts[x].update(_codes(r[1]).tolist())
    probes = [(1000 + i, text(rng.choice("abc") * 2, rng.randrange(5, 60)), None, None, None) for i in range(80)] + [(2000, "\u0416\u0416\u0416\u0416", None, None, None), (2001, "\u0416 xyz wvz", None, None, None), (2002, "12 !", None, None, None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(probes, SCHEMA), model).collect()}
    for i, t, *_ in probes[:80]:
        share = {x: sum(counts[x][c] >= 2 for c in _codes(t).tolist()) / len(_codes(t)) for x in alphabets}
        best = max(share.values())
        assert share[got[i].lang_pred] > best - 0.1 and abs(got[i].score - share[got[i].lang_pred]) < 0.15, (share, got[i])
    assert (got[2000].lang_pred, got[2000].score) == ("aa", 0.0) and got[2001].lang_pred == "aa" and got[2002].lang_pred == "und"


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), sorted(places), ",".join(sorted(labels))


def test_licenses(spark):
    from gleanfold.llm.licenses import scan_licenses

    rng = random.Random(4)
    lines = ["Licensed under CC BY-NC 4.0.", "ALL RIGHTS reserved", "the GNU General Public  License, version 3", "Released under the MIT License.", "licensed under the brand new Apache License, Version 2.0", "cc cc by by", "rights reserved all", "public license"]
    rows = list(awkward_rows())
    for i in range(60):
        parts = [prose(rng, rng.choice([0, 2, 30])) for _ in range(4)]
        rows.append((2000 + i, "\n".join(x for p in parts for x in (p, rng.choice([*lines, ""]))), None, None, None))
    rows += [(3000, "cc by", None, None, None), (3001, "x cc by", None, None, None), (3002, "all", None, None, None), (3003, "all rights reserved " * 500, None, None, None)]
    got = scan_licenses(frame(spark, rows)).collect()
    want = sorted((r[0], *brute_places(r[1])) for r in rows)
    assert sorted((r.doc_id, r.n_words) for r in got) == [(d, n) for d, n, *_ in want]
    found = {r.doc_id: r for r in got}
    for d, n, places, labels in want:
        r = found[d]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), labels), d
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1 or not labels)
    text = dict((r[0], r[1] or "") for r in rows)
    for d, r in found.items():
        if d >= 2000 and d < 3000:
            assert ("mit" in r.labels.split(",")) == ("MIT" in text[d]) and ("apache" in r.labels.split(",")) == ("Apache" in text[d])


def test_empty(spark):
    from gleanfold.llm.covertree import embedding_components
    from gleanfold.llm.langid import fit_languages, identify
    from gleanfold.llm.licenses import scan_licenses
    from gleanfold.llm.pieces import decode_pieces, encode_pieces
    from gleanfold.llm.suffix import remove_repeats

    none = spark.createDataFrame([], SCHEMA)
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (embedding_components(vec), identify(none, fit_languages(none)), scan_licenses(none), decode_pieces(encode_pieces(none)), remove_repeats(none)):
        assert df.count() == 0
