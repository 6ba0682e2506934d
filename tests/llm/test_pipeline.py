"""The pipeline against brute force, stage by stage, and what it does with planted rows."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from .helpers import SCHEMA, awkward_rows, crc, prose, roots
from .test_first import brute_base, brute_ids
from .test_second import brute_cover, repeated_texts


def brute_marks(text):
    """Three SimHashes of distinct words, bit by bit."""
    words = set(re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()))
    full = 2**64 - 1

    def mixed(h):
        h = (h ^ h >> 32) * 0xFF51AFD7ED558CCD & full
        h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & full
        return h ^ h >> 32

    made = [[mixed(xxhash.xxh64_intdigest(w, 42) + i & full) for w in words] for i in range(3)]
    return [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) for h in made]


def near(a, b):
    return any((x ^ y).bit_count() <= 3 for x, y in zip(a, b))


def varied(rng, n):
    """Prose of many different words."""
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def stripped(raw, mark):
    """What is left of raw without marked runs of 50 words or more."""
    gone = [m.span() for m in re.finditer(b"\1+", mark) if len(raw[slice(*m.span())].split()) >= 50]
    return bytes(c for i, c in enumerate(raw) if not any(a <= i < b for a, b in gone)).decode("utf-8", "ignore")


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    src = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{src}/documents.parquet").select(*P.COLUMNS).collect()]
    extra = [(10_000 + i, t, "en", "src1", len(t)) for i, t in enumerate(repeated_texts()[:60])]
    odd = [(20_000 + i, *r[1:]) for i, r in enumerate(awkward_rows())] + [(30_000, "123 !", None, None, 5)]
    spark.createDataFrame([*given, *extra, *odd], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, steps = {}, []
    for i, (name, f) in enumerate(P.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == P.COLUMNS
            steps.append({r.doc_id: r for r in docs.collect()})
            assert len(steps[-1]) == docs.count()
    texts = {r[0]: r[1] for r in [*given, *extra, *odd]}
    lang, good, single, left = steps
    assert 30_000 not in lang and {r[0] for r in given} <= set(lang)
    assert all(any(map(str.isalpha, texts[d] or "")) for d in lang)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{src}/labels.parquet").collect()}
    for d in lang:
        b = brute_base(texts[d])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert not (failed and d in good)
        assert failed or labels.get(d) != 1 or d in good
        assert labels.get(d) != 0 or d not in good
    fp = {d: brute_marks(texts[d]) for d in good}
    ids = sorted(fp)
    pairs = [(a, b) for a in ids for b in ids if a < b]
    group = roots(ids, [(a, b) for a, b in pairs if near(fp[a], fp[b])])
    words = {d: texts[d].encode().lower().split() for d in ids}
    root = roots(ids, [(a, b) for a, b in pairs if group[a] == group[b] and agreement(words[a], words[b]) >= 0.8])
    assert any(root[d] != group[d] for d in ids)  # candidates that don't agree
    assert set(single) == {d for d in ids if root[d] == d}
    raw = {d: texts[d].encode() for d in sorted(single)}
    marks = dict(zip(raw, brute_cover(list(raw.values()), 240)))
    assert set(left) == set(single) and any(map(any, marks.values()))
    for d, r in left.items():
        assert r.text == stripped(raw[d], marks[d]) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (single[d].lang, single[d].source)
    tokens = dict(zip(left, brute_ids([r.text for r in left.values()])))
    pieces = defaultdict(int)
    for r in docs.collect():
        assert r.ids_crc32 == crc(tokens[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id] += r.length
    assert pieces == {d: len(x) for d, x in tokens.items()}


def test_run(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_copies", "passages", "packing"]
    assert P.run(spark, "/root/testdata/sf0.001").count() > 50


def test_tables_in_the_shared_folder(spark):
    from gleanfold.llm.common import materialize, remove, remove_all

    kept, gone = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    assert kept.count() == 3 and gone.count() == 4
    remove(spark, gone.inputFiles()[0].rpartition("/")[0])
    assert spark.read.parquet(kept.inputFiles()[0]).count() >= 0
    remove_all(spark)


def test_empty_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in P.STAGES:
        assert f(spark, docs, str(tmp_path)).count() == 0
    rng = random.Random(0)
    rows = [(1, varied(rng, 90), "en", None, None)] * 3 + [(None, varied(rng, 90), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    once = P.near_copies(spark, docs, str(tmp_path)).collect()
    assert len(once) == 2 and np.sum([r.doc_id == 1 for r in once]) == 1


def test_near_copies_are_rows(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(1)
    a, b, c, d, e, f, g = (varied(rng, 300) for _ in range(7))
    rows = [(7, a), (7, b), (3, c), (7, c), (9, c), (5, d), (5, d), (None, d), (None, e), (None, e), (4, f), (8, f + " "), (8, g), (None, None), (None, "")]
    marks = [brute_marks(t) for t in (a, b, c, d, e, f, g)]
    assert not any(near(x, y) for i, x in enumerate(marks) for y in marks[:i])
    docs = spark.createDataFrame([(i, t, None, "src", None) for i, t in rows], SCHEMA).repartition(3)
    once = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, docs, str(tmp_path)).collect()), key=str)
    assert once == sorted([(7, a), (7, b), (3, c), (5, d), (None, e), (4, f), (8, g), (None, None)], key=str)


def test_planted_passages(spark, tmp_path):
    """Passages of 51 to 60 words in otherwise unlike documents go; all other words and all other documents stay."""
    import corpus_pipeline as P

    rng = random.Random(8)
    passages = [varied(rng, n) for n in range(51, 61)]
    short = varied(rng, 30)
    rows, own = [], {}
    for i in range(200):
        head, tail = varied(rng, rng.randrange(60, 120)), varied(rng, rng.randrange(60, 120))
        middle = passages[i % 10] if i < 60 else short if i < 90 else varied(rng, 55)
        rows.append((i, f"{head} {middle} {tail}", None, None, None))
        own[i] = f"{head} {'' if i < 60 else middle} {tail}".split()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r.text for r in P.passages(spark, docs, str(tmp_path)).collect()}
    assert len(got) == 200
    for i, words in own.items():
        left = got[i].split()
        assert left == words if i >= 60 else abs(len(left) - len(words)) <= 1 and not any(p in got[i] for p in passages)


def agreement(a, b):
    """Jaccard similarity of five-word shingles; of a shorter text, its whole sequence."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))} for w in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_sets_agree_as_shingles_do():
    from gleanfold.llm.simhash import set_agreement, shingle_set

    rng = random.Random(5)
    for n in (0, 3, 5, 400, 5000, 40000):
        a = [varied(rng, 1) for _ in range(n)]
        for rate in (0, 0.01, 0.03, 0.2):
            b = [varied(rng, 1) if rng.random() < rate else w for w in a]
            got = set_agreement(*(shingle_set(" ".join(w)) for w in (a, b)))
            assert abs(got - agreement(a, b)) <= 1e-4
    assert set_agreement(shingle_set("one"), shingle_set(None)) == 0.0 and shingle_set(" \t") == b""


def test_long_texts_near_the_threshold(spark):
    """Texts of thousands of shingles just below and just above 0.8: an estimate could not tell them apart."""
    from gleanfold.llm.simhash import shingle_set, verified_edges

    rng = random.Random(8)
    texts, edges, want = {}, [], set()
    for i in range(12):
        words = [varied(rng, 1) + str(k) for k in range(3000)]
        copy = words[:]
        for k in range(66 + i % 3):  # every changed word takes five of 2,996 shingles: 0.8016, 0.7989, 0.7962
            copy[10 + 44 * k] = f"changed{i}"
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(copy)}
        edges.append((2 * i, 2 * i + 1))
        if agreement(words, copy) >= 0.8:
            want.add((2 * i, 2 * i + 1))
    sets = spark.createDataFrame([(k, bytearray(shingle_set(t))) for k, t in texts.items()], "node long, shingles binary")
    got = verified_edges(spark.createDataFrame(edges, "src long, dst long"), sets, 0.8)
    assert len(want) == 4 and {tuple(r) for r in got.collect()} == want


def test_candidates_below_the_similarity_stay(spark, tmp_path):
    """The same words in another order share all fingerprints but no shingle; a copy in another case and spacing goes."""
    import corpus_pipeline as P

    rng = random.Random(6)
    texts = [varied(rng, 200).split() for _ in range(4)]
    rows = []
    for i, words in enumerate(texts):
        turned = words[100:] + words[:100]
        half = [w for at in range(0, 200, 4) for w in reversed(words[at : at + 4])]
        assert agreement(words, turned) >= 0.8 > 0.1 > agreement(words, half)
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(turned)), (10 * i + 2, " ".join(half)), (10 * i + 3, "\n".join(words).upper())]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in P.near_copies(spark, docs, str(tmp_path)).collect()) == [10 * i + j for i in range(4) for j in (0, 2)]


def test_recall_of_near_copies(spark, tmp_path):
    """Nine in ten copies whose five-word shingles agree to 0.8 or more go; unlike documents of the same words stay."""
    import corpus_pipeline as P

    rng = random.Random(3)
    lexicon = [varied(rng, 1) for _ in range(3000)]
    weights = [1 / (i + 5) for i in range(3000)]
    rows, copies = [], 0
    for i in range(300):
        words = rng.choices(lexicon, weights, k=rng.randrange(120, 400))
        rows.append((1000 * i, " ".join(words), None, None, None))
        rate = rng.uniform(0, 1 / 40)
        copy = [rng.choice(lexicon) if rng.random() < rate else w for w in words]
        if agreement(words, copy) >= 0.8:
            rows.append((1000 * i + 1, " ".join(copy), None, None, None))
            copies += 1
    kept = {r.doc_id for r in P.near_copies(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert all(1000 * i in kept for i in range(300))
    assert copies > 200 and copies - sum(d % 1000 == 1 for d in kept) >= 0.9 * copies
