"""Minimax contiguous sharding with DataFrame and SQL functions only.

Rows with equal text form an atomic group. In order come first the groups larger than an even share, the largest first, each a
shard of its own (no cut makes them smaller), then all others by hash, which are cut contiguously into the shards that are left.

The search sees atoms: runs of neighbouring groups, ``n_cells`` at first. A binary search finds the smallest capacity with which a
greedy walk (jumps over prefix sums) needs no more than the shards left. With that capacity, a cut of the best partition can only lie in
certain ranges of bytes; atoms of several groups in those ranges are split, and the search is run again, until every such atom is a single
group. Then the capacity is the smallest over all groups, and what was held at once never exceeded ``max_atoms`` rows. (If it would,
the search ends there, and the capacity is too large by less than an atom.) The cuts keep to that capacity and,
where it leaves room, lie next to their even places.

``slot`` numbers a shard's rows without gaps: rows before the cell (or, in a cell with many rows, before
the salted part of it), plus the place within that part. So no window covers a whole shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release

#: A cell with more than 1/HOT of all rows is numbered in SALTS parts.
HOT, SALTS = 256, 64


def _find(x: str) -> str:
    """SQL: the last index of the ascending array ``pre`` (of m + 1 numbers) whose number is at most x."""
    mid = "(s.lo + s.hi + 1) div 2"
    return f"""aggregate(sequence(1, 24), struct(0L AS lo, m AS hi), (s, q) -> IF(s.lo >= s.hi, s, IF(pre[{mid}] <= {x}, struct({mid} AS lo, s.hi AS hi), struct(s.lo AS lo, {mid} - 1 AS hi))), s -> s.lo)"""


_OWN_SQL = """
    SELECT aggregate(big, struct(total AS rest, array_repeat(0L, 0) AS own, true AS open),
             (s, c) -> IF(s.open AND size(s.own) < :n - 1 AND c.bytes * (:n - size(s.own)) > s.rest,
                          struct(s.rest - c.bytes AS rest, s.own || array(c.h) AS own, true AS open),
                          struct(s.rest AS rest, s.own AS own, false AS open))).own AS own
    FROM (SELECT big, (SELECT coalesce(sum(bytes), 0L) FROM {groups}) AS total FROM (SELECT array_sort(collect_list(struct(bytes, h)), (a, b) -> IF(a.bytes <> b.bytes, IF(a.bytes > b.bytes, -1, 1), IF(a.h < b.h, -1, 1))) AS big FROM {largest}))
"""
_SEARCH_SQL = f"""
    WITH summed AS (SELECT first, bytes, sum(bytes) OVER (ORDER BY first) AS pre FROM {{atoms}}),
    one AS (SELECT array_sort(collect_list(struct(first, pre))) AS a, coalesce(max(pre), 0L) AS total, coalesce(max(bytes), 0L) AS most, count(*) AS m FROM summed),
    arrays AS (SELECT array(0L) || transform(a, x -> x.pre) AS pre, transform(a, x -> x.first) AS firsts, total, most, m, CAST(ceil(total / :n) AS BIGINT) AS even FROM one),
    searched AS (
      SELECT *, aggregate(sequence(1, 64), struct(greatest(even, most) AS lo, even + most AS hi),
        (r, k) -> IF(r.lo >= r.hi, r, IF(aggregate(sequence(1, :n), 0L, (p, i) -> {_find('pre[p] + (r.lo + r.hi) div 2')}) >= m,
                  struct(r.lo AS lo, (r.lo + r.hi) div 2 AS hi), struct((r.lo + r.hi) div 2 + 1 AS lo, r.hi AS hi))), r -> r.hi) AS capacity
      FROM arrays),
    fitted AS (  -- least[k]: the first place of the cut after shard k with which the shards behind it hold the rest
      SELECT *, reverse(aggregate(filter(sequence(1, :n), z -> z < :n), array(m), (e, i) -> e || array(IF(pre[e[size(e) - 1]] <= capacity, 0L, {_find('pre[e[size(e) - 1]] - capacity - 1')} + 1)))) AS least
      FROM searched),
    cut AS (
      SELECT *, aggregate(filter(sequence(1, :n), z -> z < :n), array(0L), (c, i) -> c || array(greatest(least[i - 1], c[size(c) - 1], least({_find('pre[c[size(c) - 1]] + capacity')},
        {_find('total * i div :n')} + IF({_find('total * i div :n')} < m AND pre[least({_find('total * i div :n')} + 1, m)] - total * i div :n < total * i div :n - pre[{_find('total * i div :n')}], 1L, 0L))))) AS places
      FROM fitted)
    SELECT total, capacity, m, transform(filter(slice(places, 2, :n), p -> p < m), p -> firsts[p]) AS cuts FROM cut
"""


def best_cuts(groups: DataFrame, n_shards: int, n_cells: int = 1 << 15, max_atoms: int = 1 << 17) -> tuple[list[int], list[int], int]:
    """Groups (h, bytes) to: the h of the groups that stand alone, the first h of each further shard but the first, and the capacity."""
    spark = groups.sparkSession
    largest = groups.orderBy(F.desc("bytes"), "h").limit(n_shards)
    own = list(spark.sql(_OWN_SQL.replace(":n", str(n_shards)), largest=largest, groups=groups).first()["own"])  # fewer than n_shards
    rest = groups.where(~F.col("h").isin(own)) if own else groups
    n = n_shards - len(own)
    shift = 64 - max(1, (n_cells - 1).bit_length())

    def summed(rows: DataFrame, bits: int) -> DataFrame:
        return rows.groupBy(F.shiftright("h", bits).alias("cell")).agg(F.min("h").alias("first"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_groups")).withColumn("bits", F.lit(bits))

    atoms = materialize(summed(rest, shift), "atoms")
    while True:
        plan = spark.sql(_SEARCH_SQL.replace(":n", str(n)), atoms=atoms).first()  # at most n_shards numbers
        total, capacity = plan["total"], plan["capacity"]
        end = F.sum("bytes").over(W.orderBy("first"))  # atoms are bounded
        ranges = F.array(*(F.struct(F.lit(total - (n - k) * capacity).alias("low"), F.lit(k * capacity).alias("high")) for k in range(1, n))) if n > 1 else None
        if ranges is None:
            break
        placed = atoms.withColumn("end", end)
        open_ = placed.where("n_groups > 1").where(F.exists(ranges, lambda r: (F.col("end") > r["low"]) & (F.col("end") - F.col("bytes") < r["high"])))
        m = open_.count()
        if not m or not shift or plan["m"] + 2 * m > max_atoms:
            break
        bits = min(shift, 8, max(1, ((max_atoms - plan["m"]) // m).bit_length() - 1))
        chosen = open_.select("cell")
        finer = summed(rest.withColumn("cell", F.shiftright("h", shift)).join(F.broadcast(chosen), "cell", "left_semi"), shift - bits)  # at most max_atoms keys
        latest = F.col("bits") == shift
        kept = atoms.where(~latest).unionByName(atoms.where(latest).join(F.broadcast(chosen), "cell", "left_anti"))
        before, atoms = atoms, materialize(kept.unionByName(finer), "atoms")
        release(before)
        shift -= bits
    release(atoms)
    return own, list(plan["cuts"]), capacity


def minimax_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16, n_cells: int = 1 << 15) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    size is the text's UTF-8 bytes plus ``row_bytes``; a null text counts as empty and is of the empty
    text's group. Null and repeated identifiers are kept, ties in a group go by identifier. An empty
    table gives no rows; with fewer groups than shards some shards are empty. Extra columns are ignored, whatever their names.
    Very long texts are single groups like any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int")).withColumn("cell", F.shiftright("h", 64 - max(1, (n_cells - 1).bit_length())))
    parts = materialize(rows.groupBy("h", "cell", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "group-parts")  # combined before the shuffle
    groups = materialize(parts.groupBy("h").agg(F.sum("bytes").alias("bytes")), "groups")
    own, cuts, _ = best_cuts(groups, n_shards, n_cells)
    release(groups)
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") * HOT > F.lit(total)).select("cell").collect()]  # fewer than HOT
    salt = F.when(F.col("cell").isin(hot), F.col("salt")).otherwise(0).alias("salt") if hot else F.lit(0).alias("salt")
    alone = F.array_position(F.array(*map(F.lit, own)).cast("array<bigint>"), F.col("h")).cast("int") - 1
    later = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("h"))) + len(own)
    shard = F.when(alone >= 0, alone).otherwise(later).cast("int").alias("shard")
    place = (
        parts.select(shard, "cell", salt, "n").groupBy("shard", "cell", "salt").agg(F.sum("n").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("cell", "salt").rowsBetween(W.unboundedPreceding, -1)))
        .select("shard", "cell", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    place = materialize(place, "places")  # at most n_cells + n_shards + HOT * SALTS rows
    release(parts)
    within = W.partitionBy("shard", "cell", "salt").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.select("doc_id", "size", "text_crc32", shard, "cell", salt)
        .withColumn("at", F.row_number().over(within))
        .join(F.broadcast(place), ["shard", "cell", "salt"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"))
    )
