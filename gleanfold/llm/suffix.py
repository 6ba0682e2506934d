"""Suffix-array dedup: remove every byte under a long byte string that starts at two places or more.

1. Every text's windows are given to anchors (see ``anchors``); equal windows meet under one anchor key.
2. Counting (key, context) finds contexts that occur twice whole: all their windows repeat.
3. Where a key has several contexts and one of them is unique, one copy of each context is cut into
   BLOCK-byte symbols from its anchor on, and a suffix array over a bucket of such keys is built by linear grouping.
   Suffixes that agree in the whole symbols inside a window are neighbours there, and windows
   around them are compared by two independent hashes of their bytes (one modulo 2^64, one modulo a prime).
4. A key with more than ``max_contexts`` contexts isn't brought into one task: its windows' XXH64 are counted by Spark.
5. Each text is covered by its repeated windows and what is left is returned.

Passages of many words that are shorter than a window are found by the same steps with a shorter one. As a text that holds a repeated
long window holds all its short ones, only texts with enough repeated short windows are searched for long ones.

Only narrow rows are shuffled besides the texts, which are dealt by their key; keys that hold
many rows (boilerplate, repeated rows) are salted. Equality rests on hashes: anchors meet by a 64-bit key
and 64 more bits of their context's bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import WINDOW, Hashes, PrimeHashes, anchors, mix
from .common import hot_hashes, materialize, release, salted_join

BLOCK = 40
#: A passage is a repeated run of at least PASSAGE_WORDS words; PASSAGE_BYTES is below the length of so many words (4.8 bytes each, space included).
PASSAGE_WORDS, PASSAGE_BYTES = 50, 240


def suffix_array(symbols) -> list[int]:
    """Suffix array of a sequence of comparable symbols, by linear grouping construction.

    Suffixes start in groups by first symbol. Groups are taken in descending order; each member's
    pointer to the previous smaller suffix is found by following earlier pointers, and the suffixes
    pointed at move up into a group of their own right above their old one, those pointed at more often above the
    others. In the end a group holds suffixes with the same Lyndon prefix. Then one ascending
    pass emits each group's order: a placed suffix places the one before it and that one's chain of pointers.
    """
    n = len(symbols) + 1  # with an end that is smaller than all
    members: list[list[int]] = [[n - 1]]
    by_symbol: dict = {}
    for i, s in enumerate(symbols):
        by_symbol.setdefault(s, []).append(i)
    group = [0] * n
    for s in sorted(by_symbol):
        for i in by_symbol[s]:
            group[i] = len(members)
        members.append(by_symbol[s])
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = [False] * len(members)
    prev = [-1] * n
    g = len(members) - 1
    while g >= 0:
        done[g] = True
        pointed: dict[int, int] = {}
        own = [s for s in members[g] if group[s] == g]
        members[g] = own
        for s in own:  # ascending, so pointers of the group's earlier members are known
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                moves.setdefault((times, group[p]), []).append(p)
            for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                new = len(members)
                moved = moves[times, old]
                for p in moved:
                    group[p] = new
                members.append(moved)
                done.append(False)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                below[up] = new
        g = below[g]
    place, at, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    place[group[n - 1]] += 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            order[place[group[s]]] = s
            place[group[s]] += 1
            s = prev[s]
    return order[1:]


def repeated_windows(contexts: list[tuple[int, bytes]], window: int = WINDOW) -> list[list[int]]:
    """For each (anchor's offset, bytes) context: [first, end) pairs of the window starts found elsewhere too, flattened."""
    import numpy as np

    offset = np.array([c[0] for c in contexts], np.int64)
    size = np.array([len(c[1]) for c in contexts], np.int64)
    base = np.cumsum(size) - size
    inner = window // BLOCK - 1  # whole blocks in any window
    joined = b"".join(c[1] for c in contexts)
    h, second = Hashes(joined), PrimeHashes(joined)
    lead = offset % BLOCK  # bytes before the first whole block
    n_blocks = (size - lead) // BLOCK
    owner = np.repeat(np.arange(len(contexts)), n_blocks + 1)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks + 1) - (n_blocks + 1), n_blocks + 1)
    start = base[owner] + lead[owner] + nth * BLOCK
    ends = nth == n_blocks[owner]
    hashed = np.zeros(len(owner), np.uint64)
    hashed[~ends] = h.at(start[~ends], start[~ends] + BLOCK)
    _, symbols = np.unique(hashed, return_inverse=True)
    symbols = np.where(ends, 0, symbols + 1)
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[nth[order] + inner <= n_blocks[owner[order]]]  # with all inner blocks in the context
    if not len(order):
        return [[] for _ in contexts]
    same = np.ones(len(order), bool)
    same[0] = False
    for k in range(inner):
        same[1:] &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    cls = np.cumsum(~same) - 1
    many = np.bincount(cls)[cls] > 1
    order, cls = order[many], cls[many]
    # every window whose first whole block is a class member's
    begin = (start[order][:, None] - np.arange(BLOCK)[None, :]).ravel()
    who = np.repeat(owner[order], BLOCK)
    kind = np.repeat(cls, BLOCK) * BLOCK + np.tile(np.arange(BLOCK), len(order))
    ok = (begin >= base[who]) & (begin + window <= base[who] + size[who])
    begin, who, kind = begin[ok], who[ok], kind[ok]
    value = mix(h.at(begin, begin + window) + kind.astype(np.uint64)) ^ second.at(begin, begin + window) << np.uint64(33)
    rank = np.argsort(value, kind="stable")
    equal = value[rank[1:]] == value[rank[:-1]]
    twice = np.zeros(len(rank), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    hit = np.sort(begin[rank[twice]])
    whose = np.searchsorted(base, hit, "right") - 1
    out: list[list[int]] = [[] for _ in contexts]
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(whose) > 0)) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(hit)]))):
            c = whose[a]
            out[c] += [int(hit[a] - base[c]), int(hit[b - 1] - base[c]) + 1]
    return out


def _signed(x):
    import numpy as np

    return x.view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, the other columns as one struct, and a 128-bit key of the row."""
    rest = [F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.struct(*rest).alias("rest"))
    return rows.select(F.xxhash64("doc_id", "t").alias("ref"), F.xxhash64("t", F.lit(1)).alias("ref2"), "doc_id", "t", "rest")


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """(ref, ref2, key, context, n, width, offset, firsts) of every text's anchors; equal ones of a text are one row, firsts has their starts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["ref", "ref2", "key", "context", "n", "width", "offset"]
        for batch in batches:
            parts, starts = [], []
            for ref, ref2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                place, first, last, key, context = anchors((text.as_py() or "").encode(), window)
                if not len(key):
                    continue
                if len(key) > 1:
                    order = np.lexsort((context, key))
                    k, c = key[order], context[order]
                    new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
                    at = np.flatnonzero(new)
                    n, pick = np.diff(np.append(at, len(k))), order[at]
                    starts.append(first[order])
                else:
                    n, pick = np.ones(1, np.int64), np.zeros(1, np.int64)
                    starts.append(first)
                parts.append((np.full(len(pick), ref), np.full(len(pick), ref2), _signed(key[pick]), _signed(context[pick]), n, (last - first)[pick] + window, (place - first)[pick]))
            if parts:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
                ends = np.concatenate(([0], np.cumsum(cols[4]))).astype(np.int32)
                firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(starts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), firsts], names=[*names, "firsts"])

    return texts.select("ref", "ref2", "t").mapInArrow(run, "ref long, ref2 long, key long, context long, n long, width long, offset long, firsts array<int>")


def _cut_contexts(met: DataFrame, window: int) -> DataFrame:
    """Rows (t, wanted) to the wanted contexts' bytes, or for keys in many contexts to their windows' hashes; each once a task."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("offset", pa.int32()), ("bytes", pa.binary()), ("windows", pa.list_(pa.int64()))])
        done = set()
        for batch in batches:
            rows, held = [], 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                view = memoryview(raw)
                for w in wanted.as_py():
                    if (at := (w["key"], w["context"])) in done:
                        continue
                    done.add(at)
                    row = {"key": at[0], "context": at[1], "offset": w["offset"], "bytes": None, "windows": None}
                    a, end = w["first"], w["first"] + w["width"]
                    if w["many"]:
                        hashes = [xxhash.xxh64_intdigest(view[x : x + window]) for x in range(a, end - window + 1)]
                        row["windows"] = [x - (1 << 64) if x >> 63 else x for x in hashes]
                    else:
                        row["bytes"] = raw[a:end]
                    rows.append(row)
                    held += 2 * w["width"]
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return met.select("t", "wanted").mapInArrow(run, "key long, context long, offset int, bytes binary, windows array<long>")


def _by_suffix_arrays(cut: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """(key, context, ranges) for contexts with some repeated windows."""

    def run(pdf):
        pdf = pdf.drop_duplicates(["key", "context"])
        found = repeated_windows(list(zip(pdf.offset.tolist(), map(bytes, pdf.bytes))), window)
        keep = [i for i, r in enumerate(found) if r]
        return pd.DataFrame({"key": pdf.key.to_numpy()[keep], "context": pdf.context.to_numpy()[keep], "ranges": pd.Series([found[i] for i in keep], dtype=object)})

    bucket = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(n_buckets)).alias("bucket")
    return cut.where("bytes IS NOT NULL").select(bucket, "key", "context", "offset", "bytes").groupBy("bucket").applyInPandas(run, "key long, context long, ranges array<int>")


def _by_counting(cut: DataFrame) -> DataFrame:
    """The same for keys in many contexts, by counting window hashes."""
    windows = cut.where("windows IS NOT NULL").select("key", "context", F.posexplode("windows").alias("at", "w")).distinct()
    twice = materialize(windows.groupBy("key", "w").agg(F.count("*").alias("n")).where("n > 1"), "windows")
    hot = hot_hashes(twice, ["key", "w"], "n", twice.agg(F.sum("n")).first()[0] or 0)
    starts = salted_join(windows, twice.drop("n"), ["key", "w"], hot, ["context", "at"]).groupBy("key", "context").agg(F.collect_set("at").alias("at"))
    return starts.select("key", "context", F.flatten(F.transform(F.array_sort("at"), lambda x: F.array(x, x + 1))).alias("ranges"))


def cover(places) -> list[tuple[int, int]]:
    """Maximal [start, end) runs under the repeated windows; places: flattened (start, end) pairs in any order."""
    import numpy as np

    pairs = np.asarray(places, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1])
    at = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist()))


def _wordy(raw: bytes, runs: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """Without the runs of fewer words (parts of words count)."""
    return [(x, y) for x, y in runs if not least_words or len(raw[x:y].split()) >= least_words]


def _hot_rows(texts: DataFrame) -> list[int]:
    return hot_hashes(texts.groupBy("ref", "ref2").count(), ["ref", "ref2"], "count", texts.count())


def _repeats(texts: DataFrame, window: int, hot_rows: list[int], max_contexts: int = 4096, bucket_bytes: int = 1 << 20) -> DataFrame:
    """The texts with repeated windows: ref, ref2, starts (how many windows repeat, at least), places (flattened [start, end) pairs under them)."""
    if window < 2 * BLOCK:
        raise ValueError(f"window must be {2 * BLOCK} bytes or more")
    ref, at = ["ref", "ref2"], ["key", "context"]
    rows = materialize(_anchor_rows(texts, window), "anchors")
    one = F.struct(*ref, F.element_at("firsts", 1).alias("first"), "offset")
    contexts = rows.groupBy(*at).agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"), F.min(one).alias("one"), F.first("width").alias("width"))
    contexts = materialize(contexts.withColumn("twice", F.col("n") > 1), "contexts")
    shared = contexts.groupBy("key").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1").select("key", "d", (F.col("d") > max_contexts).alias("many"))
    shared = materialize(shared, "shared")
    n_contexts, n_rows = contexts.agg(F.count("*"), F.sum("n_rows")).first()
    wanted = salted_join(contexts, shared.drop("d"), ["key"], hot_hashes(shared, ["key"], "d", n_contexts), ["context"])
    wanted = materialize(wanted.select("one.*", *at, "many", "width"), "wanted")
    release(shared)
    width, any_many = wanted.agg(F.sum("width"), F.coalesce(F.max("many"), F.lit(False))).first()
    n_buckets = 1 + (width or 0) // bucket_bytes
    lists = wanted.groupBy(*ref).agg(F.collect_list(F.struct(*at, "many", "first", "width", "offset")).alias("wanted"))
    cut = materialize(_cut_contexts(salted_join(texts, lists, ref, hot_rows, ["doc_id"]), window), "cut")
    release(wanted)
    whole = contexts.where("twice").select(*at, F.array(F.lit(0), F.col("width").cast("int")).alias("spans"), (F.col("width") - window + 1).alias("starts"))
    parts = _by_suffix_arrays(cut, n_buckets, window)
    if any_many:
        parts = parts.unionByName(_by_counting(cut))
    signed = F.transform("ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    spans = F.transform("ranges", lambda x, i: F.when(i % 2 == 1, x + (window - 1)).otherwise(x))
    parts = parts.select(*at, spans.alias("spans"), F.aggregate(signed, F.lit(0), lambda a, x: a + x).cast("long").alias("starts"))
    found = whole.unionByName(parts.join(contexts.where("twice").select(*at), at, "left_anti"))
    hot = hot_hashes(contexts.where("twice"), at, "n_rows", n_rows or 0)
    moved = F.flatten(F.transform("firsts", lambda first: F.transform("spans", lambda x: first + x)))
    placed = salted_join(rows.select(*ref, *at, "n", "firsts"), found, at, hot, ref).select(*ref, (F.col("n") * F.col("starts")).alias("starts"), moved.alias("places"))
    repeated = placed.groupBy(*ref).agg(F.sum("starts").alias("starts"), F.flatten(F.collect_set("places")).alias("places"))
    repeated = materialize(repeated, "repeated")
    release(rows, contexts, cut)
    return repeated


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Every row's text with what repeats: ref, ref2, doc_id, t, rest, starts, places (see _repeats; null: nothing)."""
    texts = keyed(docs, id_col, text_col)
    hot_rows = _hot_rows(texts)
    return salted_join(texts, _repeats(texts, window, hot_rows, **options), ["ref", "ref2"], hot_rows, ["doc_id"], "left")


def find_repeats_and_passages(docs: DataFrame, id_col: str, text_col: str, window: int, passage_window: int, **options) -> DataFrame:
    """As find_repeats, with the column short: places under the repeated windows of ``passage_window`` bytes."""
    if passage_window > window:
        raise ValueError("passage_window must not be longer than window")
    texts, ref = keyed(docs, id_col, text_col), ["ref", "ref2"]
    hot_rows = _hot_rows(texts)
    short = _repeats(texts, passage_window, hot_rows, **options)
    joined = salted_join(texts, short.select(*ref, "starts", F.col("places").alias("short")), ref, hot_rows, ["doc_id"], "left")
    joined = materialize(joined.withColumn("long", F.coalesce(F.col("starts"), F.lit(0)) > window - passage_window).drop("starts"), "joined")
    release(short)
    # a window that repeats holds window - passage_window + 1 short ones that do, in either text
    long = _repeats(joined.where("long").drop("short", "long"), window, hot_rows, **options)
    none = [F.lit(None).cast(kind).alias(c) for c, kind in long.dtypes if c not in ref]
    return joined.where("NOT long").select("*", *none).unionByName(salted_join(joined.where("long"), long, ref, hot_rows, ["doc_id"], "left"))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, passage_window: int | None = None, passage_words: int = PASSAGE_WORDS, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A null text counts as empty. Texts shorter than the window keep everything; copies of longer ones go whole. Matches within
    one text count. Repeated rows count as copies of each other. An empty table gives no rows. Other columns are ignored,
    whatever their names. Very long texts are read in segments.

    With ``passage_window`` follow n_passages, passage_bytes and kept_passages, of the maximal runs under repeated windows
    of that many bytes that have ``passage_words`` words or more: how many there are, their bytes, and the bytes left without them.
    """
    kind = dict(docs.dtypes)[id_col]
    names, schema = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    if passage_window is not None:
        names, schema = [*names, "n_passages", "passage_bytes", "kept_passages"], schema + ", n_passages long, passage_bytes long, kept_passages binary"

    def run(batches):
        import hashlib

        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

        def made(ids, rows):
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

        for batch in batches:
            rows, at, held = [], 0, 0
            for text, *places in zip(*batch.columns[1:]):
                raw = (text.as_py() or "").encode()
                runs, *short = [cover(p.values.to_numpy()) if p.is_valid else [] for p in places]
                kept = _kept(raw, runs) if runs else raw
                row = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)
                if short:
                    found = _wordy(raw, short[0], passage_words)
                    left = _kept(raw, found) if found else raw
                    row += (len(found), len(raw) - len(left), left)
                rows.append(row)
                held += len(raw)
                if held > 8_000_000:
                    yield made(batch.column(0).slice(at, len(rows)), rows)
                    rows, at, held = [], at + len(rows), 0
            if rows:
                yield made(batch.column(0).slice(at), rows)

    chosen = docs.select(id_col, text_col)
    if passage_window is None:
        found = find_repeats(chosen, id_col, text_col, window, **options).select("doc_id", "t", "places")
    else:
        found = find_repeats_and_passages(chosen, id_col, text_col, window, passage_window, **options).select("doc_id", "t", "places", "short")
    return found.mapInArrow(run, schema)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_words: int = 0, **options) -> DataFrame:
    """docs with the repeated passages taken out of the text: maximal runs under repeated windows, of ``least_words`` words or more.

    A character that is cut goes whole. A null text stays null, an empty one empty; a text that repeats as a whole becomes empty.
    """

    @F.pandas_udf("string")
    def stripped(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, places):
            if text is not None and found is not None and len(found):
                raw = text.encode()
                text = _kept(raw, _wordy(raw, cover(found), least_words)).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    found = find_repeats(docs, id_col, text_col, window, **options)
    other = [F.col(f"rest.{c}").alias(c) for c in docs.columns if c not in (id_col, text_col)]
    done = found.select(F.col("doc_id").alias(id_col), stripped("t", "places").alias(text_col), *other)
    return done.select(*docs.columns)
