"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit of their low or of
their high half. In each half, 31 of the 32 bits are covered by the (31, 26) Hamming code: a perfect
code, so every point has exactly one codeword (its home anchor) within the covering radius 1. If x
and y differ in at most one of those bits, x's home anchor lies within 1 + 1 of y. So each
fingerprint is sent to every anchor within 2 of it (1 or 16 per half), and at each anchor its home
fingerprints are compared with all that came. No pair is missed, and each group is a tiny part
of the space.

At an anchor with more than ``SPLIT`` fingerprints the comparison is dealt out by equal parts of
the other half: of four parts, one at least is equal in any pair within 3 bits. A part that still holds more
(a dense cluster) is cut into blocks: every block of home fingerprints meets every chunk of the
part in a group of its own, so no row or task holds more than two times ``SPLIT``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import connected_components, hot_hashes, materialize, n_partitions, salted_join

N_BITS, LIMIT, SPLIT = 64, 3, 4096
#: Parity masks of the Hamming code: bit i - 1 of mask j is set where position i has bit j.
_MASKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]


def shingle_hashes(words: list[bytes], n: int, seed: int = 42):
    """XXH64 of every run of n words, space-joined, in order; of the whole sequence if it is shorter."""
    import numpy as np
    import xxhash

    joined = b" ".join(words)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-n] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())), np.uint64, len(starts))


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles as an unsigned 64-bit number; 0 without a word."""
    import numpy as np

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    h = shingle_hashes(words, shingle, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((text_fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _anchors(half: F.Column) -> F.Column:
    """All codewords within 2 of a 31-bit number, as array<struct<anchor, home>>."""
    syndrome = sum((F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(_MASKS)), F.lit(0)).cast("int")

    def flip(x: F.Column, i: F.Column) -> F.Column:
        return x.bitwiseXOR(F.when(i > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int") - 1)).otherwise(F.lit(0).cast("long")))

    home = F.array(F.struct(flip(half, syndrome).alias("anchor"), F.lit(True).alias("home")))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (syndrome > 0) & (i.bitwiseXOR(syndrome) > i) & (i != syndrome))
    others = F.transform(pairs, lambda i: F.struct(flip(flip(half, i), i.bitwiseXOR(syndrome)).alias("anchor"), F.lit(False).alias("home")))
    return F.concat(home, others)


def _star_edges(x, role):
    """Spanning edges, by positions, between values within LIMIT bits: those with role bit 1 are compared with those with role bit 2."""
    import numpy as np

    values, at = np.unique(x, return_inverse=True)
    others = np.unique(at[(role & 2) > 0])
    group = np.arange(len(values))
    for i in np.unique(at[(role & 1) > 0]):
        near = others[np.bitwise_count(values[others] ^ values[i]) <= LIMIT]
        kinds, place = np.unique(group[near], return_index=True)
        for kind, j in zip(kinds, near[place]):
            if kind != group[i]:
                group[group == kind] = group[i]
                yield values[i], values[j]


def _by_anchor(batches, split: int):
    """Rows (fp, at) in order of at, which is an anchor and whether the row is a guest there, to edges; rows of crowded anchors go through."""
    import numpy as np
    import pyarrow as pa

    def out(edges, fp, at):
        ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        n, m = len(ends), len(fp)
        given = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(x, pa.int64()), pa.nulls(after, pa.int64())])
        return pa.RecordBatch.from_arrays([given(ends[:, 0], 0, m), given(ends[:, 1], 0, m), given(fp, n, 0), given(at, n, 0)], names=["src", "dst", "fp", "at"])

    def compared(fp, at):
        """Edges of whole groups."""
        anchor = at >> 1
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        size = np.diff(np.append(first, len(anchor)))
        some = (size > 1) & (at[first] & 1 == 0)  # homes come first
        two = first[some & (size == 2)]
        x = fp.view(np.uint64)
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= LIMIT]
        edges = list(zip(x[two].tolist(), x[two + 1].tolist()))
        for i, n in zip(first[some & (size > 2)].tolist(), size[some & (size > 2)].tolist()):
            edges += _star_edges(x[i : i + n], np.where(at[i : i + n] & 1, 2, 3))
        return edges

    held_fp, held_at, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        fp = np.concatenate((held_fp, batch.column(0).to_numpy()))
        at = np.concatenate((held_at, batch.column(1).to_numpy()))
        if not len(at):
            continue
        through = np.zeros(len(at), bool)
        if crowded is not None:
            through = at >> 1 == crowded
        last = np.searchsorted(at, at[-1] >> 1 << 1)  # the last group may go on
        first = np.concatenate(([0], np.flatnonzero(np.diff(at >> 1)) + 1))
        size = np.diff(np.append(first, len(at)))
        for i, n in zip(first[size > split].tolist(), size[size > split].tolist()):
            through[i : i + n] = True
        if through[-1]:
            crowded = at[-1] >> 1
        ready = ~through
        ready[last:] = False
        yield out(compared(fp[ready], at[ready]) if ready.any() else [], fp[through], at[through])
        keep = ~through
        keep[:last] = False
        held_fp, held_at = fp[keep], at[keep]
    if len(held_at):
        yield out(compared(held_fp, held_at), held_fp[:0], held_at[:0])


def near_edges(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (src, dst) that join all within LIMIT bits; local stars, not all pairs.

    The anchors' rows are shuffled once and read in order, group by group; no group of more than SPLIT rows is held.
    """
    spark = distinct.sparkSession
    n, split = n_partitions(spark), SPLIT
    low, high = F.col("fp").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright("fp", 32).bitwiseAND(F.lit((1 << 31) - 1))
    places = lambda half, side: F.transform(_anchors(half), lambda a: (F.lit(side << 31).cast("long") + a["anchor"]) * 2 + F.when(a["home"], 0).otherwise(1))
    distinct = distinct.repartition(n, F.xxhash64("fp"))  # a small table that grows 32-fold here; dealt anew, as its own partitions may be merged
    dealt = distinct.select("fp", F.explode(F.concat(places(low, 0), places(high, 1))).alias("at"))
    read = dealt.repartition(n, F.shiftright("at", 1)).sortWithinPartitions("at").mapInArrow(lambda batches: _by_anchor(batches, split), "src long, dst long, fp long, at long")
    read = materialize(read, "by-anchor")
    edges = read.where("src IS NOT NULL").select("src", "dst")
    crowded = read.where("fp IS NOT NULL").select("fp", F.shiftright("at", 1).alias("anchor"), (F.col("at") % 2 == 0).alias("home"))
    if not crowded.limit(1).count():
        return edges.distinct()
    side = F.shiftright("anchor", 31)
    # the 33 bits outside the side's code, in four parts
    rest = F.when(side == 0, F.call_function("shiftrightunsigned", F.col("fp"), F.lit(31))).otherwise(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)) * 2 + F.call_function("shiftrightunsigned", F.col("fp"), F.lit(63)))
    parts = F.array(*(F.lit(i << 40).cast("long") + F.call_function("shiftrightunsigned", rest, F.lit(9 * i)).bitwiseAND(F.lit(511)) for i in range(4)))
    crowded = crowded.select("anchor", "fp", "home", F.explode(parts).alias("part"))
    key = ["anchor", "part"]
    dense = materialize(crowded.groupBy(*key).agg(F.count("*").alias("m"), F.max("home").alias("any_home")).where("m > 1 AND any_home").drop("any_home"), "part-sizes")
    crowded = salted_join(crowded, dense, key, hot_hashes(dense, key, "m", dense.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]), ["fp"])
    k = F.ceil(F.col("m") / SPLIT)
    own, many = F.pmod(F.xxhash64("fp"), k), F.sequence(F.lit(0).cast("long"), k - 1)
    place = lambda b, c, r: F.struct(b.alias("block"), c.alias("chunk"), F.lit(r).alias("role"))
    none = F.array().cast("array<struct<block:bigint,chunk:bigint,role:int>>")
    cells = F.concat(F.when(F.col("home"), F.transform(many, lambda c: place(own, c, 1))).otherwise(none), F.transform(many, lambda b: place(b, own, 2)))
    groups = crowded.select(*key, "fp", F.explode(cells).alias("c")).select(*key, "c.block", "c.chunk", "fp", "c.role")
    lists = groups.groupBy(*key, "block", "chunk").agg(F.collect_list("fp").alias("fps"), F.collect_list("role").alias("roles")).where("size(fps) > 1").select("fps", "roles")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [e for fps, roles in zip(batch.column(0), batch.column(1)) for e in _star_edges(np.array(fps.as_py(), np.int64).view(np.uint64), np.array(roles.as_py()))]
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["src", "dst"])

    return edges.unionByName(lists.mapInArrow(compare, "src long, dst long")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and wordless texts have fingerprint zero and link like any other; a text of fewer
    than three words hashes whole, a very long one is hashed in blocks. Copies share a fingerprint and are compared once. Null
    identifiers are kept and are never a component's smallest unless it has no other; repeated identifiers get a row each.
    Other columns are ignored. Empty table: no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    hot = hot_hashes(least, ["fp"], "n", least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    stars = connected_components(near_edges(least.select("fp")))
    named = least.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "roots")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    hot_roots = hot_hashes(roots, ["root"], "n", named.count())
    by_fp = salted_join(named.select("fp", "root"), roots.drop("n"), ["root"], hot_roots, ["fp"]).select("fp", "component_id")
    return salted_join(fps, by_fp, ["fp"], hot, ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_fingerprints(text: str | None, n: int = 3, seed: int = 42) -> list[int]:
    """n SimHashes of the text's distinct words (not shingles), by independent mixes of each word's XXH64; zeros without a word."""
    import numpy as np
    import xxhash

    words = sorted(set((text or "").encode().lower().split()))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    ones = np.zeros((n, 64), np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)]
        for i in range(n):
            ones[i] += np.unpackbits(mix(part + np.uint64(i)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8").ravel().tolist()


def shingle_set(text: str | None, shingle: int = 5) -> bytes:
    """The text's distinct shingle hashes (32 bits each, ascending), however many; none without a word.

    Two shingles share a hash once in 2^32 pairs, which moves the similarity of million-word texts by 0.0002 at most.
    """
    import numpy as np

    words = (text or "").encode().lower().split()
    if not words:
        return b""
    return np.unique((shingle_hashes(words, shingle) >> np.uint64(32)).astype("<u4")).tobytes()


def set_agreement(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' shingles by their whole sets."""
    import numpy as np

    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())  # each set is distinct, so a value stands twice if both hold it
    return shared / (len(both) - shared)


def verified_edges(edges: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The edges (src, dst) whose ends, by their shingles (node, shingles), agree to the similarity or more. A node with very many edges is salted."""

    @F.pandas_udf("boolean")
    def agrees(a, b):
        import pandas as pd

        return pd.Series([set_agreement(x, y) >= similarity for x, y in zip(a, b)], dtype=bool)

    total = edges.count()
    for end, other, name in (("src", "dst", "a"), ("dst", "src", "b")):
        hot = hot_hashes(edges.groupBy(end).count(), [end], "count", total)
        edges = salted_join(edges, shingles.select(F.col("node").alias(end), F.col("shingles").alias(name)), [end], hot, [other])
    return edges.where(agrees("a", "b")).select("src", "dst")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_marks: int = 3, similarity: float = 0.8) -> DataFrame:
    """Of each group of near copies one row: the smallest identifier (nulls last), of equal ones the smallest text.

    Candidates are texts of which one of the ``n_marks`` fingerprints of distinct words differs in 3 bits or
    fewer. A word that is changed moves one feature here but five five-word shingles, so this finds most
    copies whose shingles agree to 0.8, where 3 bits of a shingle fingerprint find a tenth of them. A candidate counts only if
    the Jaccard similarity of the five-word shingles (fewer words: the whole sequence) is ``similarity`` or more, by
    the whole sets of both texts, however long. Compared are
    the spanning links between fingerprints and every text with the smallest identifier of its candidate group, not all pairs. Null, empty and
    wordless texts are copies of each other.

    Rows are told apart by what they hold, not by identifier: other texts under a repeated identifier stay,
    and copies without an identifier go. Other columns stay, whatever their names. Empty table: no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([word_fingerprints(t.as_py(), n_marks) for t in batch.column(at)], np.uint64).reshape(-1, n_marks).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(n_marks))], names=names)

    marks = [f"fp{i}" for i in range(n_marks)]
    names = [f"c{i}" for i in range(len(docs.columns))] + marks  # docs may have columns of any name
    c = dict(zip(docs.columns, names))
    given = docs.toDF(*names[: len(docs.columns)])
    marked = given.mapInArrow(run, ", ".join([*(f"{x} {k}" for x, k in given.dtypes), *(f"{m} long" for m in marks)]))
    order = [id_col, text_col, *sorted(x for x in set(docs.columns) - {id_col, text_col} if not dict(docs.dtypes)[x].startswith("map"))]
    rest = F.struct(*(F.col(c[x]) for x in docs.columns if x not in order), F.lit(0).alias("none"))
    row = F.struct(F.col(c[id_col]).isNull().alias("last"), *(c[x] for x in order))
    # minima of rows have a partial stage, so no task holds the copies of one text or group
    first = marked.groupBy(*marks, F.xxhash64(c[text_col]).alias("same")).agg(F.min_by(F.struct(row.alias("row"), rest.alias("rest")), row).alias("r"))
    first = materialize(first.select(F.xxhash64(*marks, "same").alias("node"), *marks, "r.row", "r.rest"), "firsts")
    edges = None
    for m in marks:
        hubs = materialize(first.groupBy(F.col(m).alias("fp")).agg(F.min("node").alias("hub"), F.count("*").alias("n")), "hubs")
        hot = hot_hashes(hubs, ["fp"], "n", hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        same = salted_join(first.select("node", F.col(m).alias("fp")), hubs.where("n > 1").drop("n"), ["fp"], hot, ["node"]).select(F.col("node").alias("src"), F.col("hub").alias("dst"))
        near = near_edges(hubs.select("fp"))
        ends = [hubs.select(F.col("fp").alias(x), F.col("hub").alias(f"{x}_hub")) for x in ("src", "dst")]
        near = near.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_hub").alias("src"), F.col("dst_hub").alias("dst"))
        found = same.unionByName(near)
        edges = found if edges is None else edges.unionByName(found)
    candidates = materialize(edges.where("src <> dst").distinct(), "candidates")
    # spanning links join copies of copies; a group's first text, most often their original, is compared with all of them too
    groups = materialize(connected_components(candidates), "groups")
    ranked = first.select("node", F.struct("row.last", f"row.{c[id_col]}", "node").alias("rank")).join(groups, "node")
    leaders = ranked.groupBy("root").agg(F.min_by("node", "rank").alias("dst"), F.count("*").alias("n"))
    leaders = materialize(leaders, "leaders")
    hot = hot_hashes(leaders, ["root"], "n", leaders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    led = salted_join(groups, leaders.drop("n"), ["root"], hot, ["node"]).select(F.col("node").alias("src"), "dst").where("src <> dst")
    pairs = materialize(candidates.unionByName(led).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    shingled = F.pandas_udf(lambda texts: texts.map(shingle_set), "binary")
    shingles = first.join(groups.select("node"), "node", "left_semi").select("node", shingled(f"row.{c[text_col]}").alias("shingles"))
    stars = connected_components(verified_edges(pairs, materialize(shingles, "shingles"), similarity))
    rooted = first.join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "row", "rest")
    kept = rooted.groupBy("root").agg(F.min_by(F.struct("row", "rest"), F.col("row")).alias("r"))
    return kept.select(*(F.col(f"r.row.{c[x]}" if x in order else f"r.rest.{c[x]}").alias(x) for x in docs.columns))
