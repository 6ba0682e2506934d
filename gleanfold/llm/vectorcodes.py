"""Vector code compression: one small codebook per part of the vectors, trained by Elkan's form of Lloyd's algorithm.

All arithmetic is in integers, so results don't depend on the order of rows or tasks. Each row carries,
from round to round, the entry of each of its parts, an upper bound of the distance to it, and a lower
bound of the distance to every entry; bounds are whole numbers rounded outwards. An entry is left out only if the triangle
inequality proves it strictly farther, and what remains is compared by exact squared distances, so ties go to the lower
index. When the entries move, the bounds are shifted by their movement. A round is one pass over the rows and a sum over parts
and entries; only the codebooks (parts x entries) pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_hashes, materialize, release, salted_join

STATE = "id long, label string, x array<long>, code array<long>, upper array<long>, lower array<long>"
#: Integer components are held to this size, so that distances and a batch's sums stay within 64 bits.
LARGEST = 1 << 44
LONG_MAX = (1 << 63) - 1


def _root(square: np.ndarray, up: bool) -> np.ndarray:
    """Whole square roots, rounded down or up, without an error from floating point."""
    if square.dtype == object:
        from math import isqrt

        return np.array([isqrt(int(s)) + (up and isqrt(int(s)) ** 2 != int(s)) for s in square.ravel()], dtype=object).reshape(square.shape)
    r = np.sqrt(square.astype(np.float64)).astype(np.int64)
    r -= r * r > square
    r += (r + 1) * (r + 1) <= square
    return r + (r * r != square) if up else r


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move the rows of one part to their nearest entries; code, upper and lower are updated in place. Returns the number of exact distances taken.

    x: rows x width, book: entries x width. Squares are exact: object arrays where 64 bits could be too few.
    """
    if (2 * int(max(abs(x).max(initial=0), abs(book).max(initial=0)))) ** 2 * x.shape[1] >= 1 << 62:
        x, book = x.astype(object), book.astype(object)
    n, k = lower.shape
    own = np.arange(k)
    between = _root(((book[:, None] - book[None]) ** 2).sum(2), up=False)
    nearest_other = np.where(own[:, None] == own, LONG_MAX, between).min(1)
    # twice the upper bound could leave 64 bits, so half the distances (rounded down: still strict) serve
    rows = np.flatnonzero(upper >= (nearest_other[code] - 1) // 2 + 1)
    rows = rows[((lower[rows] <= upper[rows, None]) & (own != code[rows, None])).any(1)]
    if not len(rows):
        return 0
    at = code[rows]
    square = ((x[rows] - book[at]) ** 2).sum(1)
    upper[rows] = _root(square, up=True)
    lower[rows, at] = _root(square, up=False)
    maybe = (lower[rows] <= upper[rows, None]) & (upper[rows, None] >= (between[at] - 1) // 2 + 1) & (own != at[:, None])
    r, j = np.nonzero(maybe)
    exact = ((x[rows[r]] - book[j]) ** 2).sum(1)
    lower[rows[r], j] = _root(exact, up=False)
    seen = np.full((len(rows), k), 1 << 200 if square.dtype == object else LONG_MAX, dtype=square.dtype)
    seen[np.arange(len(rows)), at] = square
    seen[r, j] = exact
    best = seen.argmin(1).astype(np.int64)  # the first of equals: the lower index
    code[rows] = best
    upper[rows] = _root(seen[np.arange(len(rows)), best], up=True)
    return len(rows) + len(r)


def _arrays(batch) -> list[np.ndarray]:
    n = batch.num_rows
    return [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) for c in (batch.column(i) for i in range(2, batch.num_columns))]


def _pass(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Shift the bounds by the entries' movement, then assign every part."""
    parts, k, width = books.shape

    def step(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, code, upper, lower = (a.copy() for a in _arrays(batch))
            x, lower = x.reshape(n, parts, width), lower.reshape(n, parts, k)
            for p in range(parts):
                upper[:, p] += moved[p, code[:, p]]
                lower[:, p] = np.maximum(0, lower[:, p] - moved[p])
                c, u, low = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                assign(x[:, p], books[p], c, u, low)
                code[:, p], upper[:, p], lower[:, p] = c, u, low
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (a.size // n)), pa.array(a.ravel())) for a in (x, code, upper, lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "label", "x", "code", "upper", "lower"])

    return state.mapInArrow(step, STATE)


def _sums(state: DataFrame, parts: int, k: int) -> list:
    """(part, entry, place, count, sum) of all rows: parts x entries x width rows at most."""

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, code = _arrays(batch)
            x = x.reshape(n, parts, -1)
            rows = []
            for p in range(parts):
                for j in np.unique(code[:, p]):
                    own = x[code[:, p] == j, p]
                    rows.append((p, int(j), len(own), own.sum(0)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([a.tolist() for a in cols[3]], pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    partial = state.select("id", "label", "x", "code").mapInArrow(add, "part long, entry long, n long, total array<long>")
    places = partial.select("part", "entry", "n", F.posexplode("total").alias("place", "v"))
    return places.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).collect()


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, x): integer components of the vectors that are not null and hold finite components only."""
    limit = float(LARGEST)
    whole = F.transform(vector_col, lambda v: F.floor(F.greatest(F.least(v.cast("double") * F.lit(float(scale)), F.lit(limit)), F.lit(-limit))).cast("long"))
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("x"))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each kept row, and the codebooks (parts x entries x width).

    Kept are vectors that are not null and hold finite components only, of the length of the first of
    them by id whose length is a multiple of ``parts``: others have no such parts. Components beyond
    2^44 are held to that size; an error beyond a long is the largest long. Repeated rows and ids count
    each; rows of one id go by their components; null ids come last. Fewer rows than ``entries`` make fewer entries. Empty table: no rows, no entries.
    """
    whole = whole_vectors(vectors, id_col, vector_col, label_col, scale)
    fits = (F.size("x") > 0) & (F.size("x") % parts == 0)
    order = [F.col("id").asc_nulls_last(), F.col("x").asc()]
    first = whole.where(fits).orderBy(*order).limit(1).collect()
    if not first:
        return whole.limit(0).select("id", "label", F.array().cast("array<long>").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    whole = whole.where(F.size("x") == len(first[0].x))
    start = np.array([r.x for r in whole.orderBy(*order).limit(entries).collect()], dtype=np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    k = books.shape[1]
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    state = whole.select("id", "label", "x", zeros(parts).alias("code"), F.array_repeat(F.lit(1 << 61).cast("long"), parts).alias("upper"), zeros(parts * k).alias("lower"))
    moved, before = np.zeros((parts, k), np.int64), None
    for _ in range(rounds):
        state = materialize(_pass(state, books, moved), "codes")
        if before is not None:
            release(before)
        before, old = state, books.copy()
        for r in _sums(state, parts, k):
            books[r.part, r.entry, r.place] = int(r.total) // r.n
        moved = _root(((books.astype(object) - old.astype(object)) ** 2).sum(2), up=True).astype(np.int64)
    codes = materialize(_measured(_pass(state, books, moved), books), "codes")
    if before is not None:
        release(before)
    return codes, books


def _measured(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The code of each row and its squared distances, summed over the parts."""
    parts, _, width = books.shape

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, code = _arrays(batch)
            near = np.concatenate([books[p][code[:, p]] for p in range(parts)], axis=1)
            if (2 * int(max(abs(x).max(), abs(near).max()))) ** 2 * parts * width >= 1 << 62:
                error = [min(int(e), LONG_MAX) for e in ((x.astype(object) - near) ** 2).sum(1)]
            else:
                error = ((x - near) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return state.select("id", "label", "x", "code").mapInArrow(measure, "id long, label string, code array<long>, error long")


def decode_vectors(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """The codes with ``vector``: the entries that they name, at the middle of their integer cells."""
    parts, k, width = books.shape
    table = F.lit([[(int(v) + 0.5) / scale for v in row] for row in books.reshape(parts * k, width)])
    return codes.withColumn("vector", F.flatten(F.transform("code", lambda c, p: F.element_at(table, (p * k + c + 1).cast("int")))))


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: error summed over the rows of an equal label, nulls together; beyond a long the largest long."""
    keyed = codes.withColumn("none", F.col("label").isNull()).withColumn("name", F.coalesce("label", F.lit("")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    labels = materialize(keyed.groupBy("none", "name").agg(F.count("*").alias("n"), total.alias("label_error")), "labels")
    rows = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_hashes(labels, ["none", "name"], "n", rows)
    return salted_join(keyed, labels.select("none", "name", "label_error"), ["none", "name"], hot, ["id"]).drop("none", "name")
