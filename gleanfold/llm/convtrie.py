"""Prefix trie of conversations, built level by level.

Turns are reduced to digests first; equal whole conversations become one sequence with a count of its
copies. Per depth the live sequences are grouped by (parent node, next turn); a group's node gets its smallest
conversation id. A sequence that is alone in its group leaves: what follows is a chain, whose nodes are read off its turns.
So there are as many rounds as the deepest prefix that two different conversations share. Then the
levels are joined in reverse, from the deepest up, to roll up leaves and savings.

Rows of one conversation are placed by ranges of (conversation, turn), so a conversation of very many turns spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_hashes, materialize, n_partitions, release, salted_join

#: Ids of equal conversations are joined into texts of so many before they are hashed in order.
CHUNK = 512
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def placed_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes, through): each turn's place from 1, and the bytes of its conversation up to it.

    Rows without a conversation id belong to none and are left out. Null turns come first; equal turns
    go by role and digest; null role or text counts as empty.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    narrow = materialize(narrow, "turns")
    order = ["turn", "role", "digest", "row"]
    dealt = materialize(narrow.repartitionByRange(n_partitions(narrow.sparkSession), "conv", *order).withColumn("range", F.spark_partition_id()), "ranges")
    release(narrow)
    counts = dealt.groupBy("conv", "range").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(*_BEFORE)
    before = counts.select("conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"))
    own = Window.partitionBy("conv", "range").orderBy(*order)
    inner = dealt.select("conv", "range", "digest", "bytes", F.row_number().over(own).alias("n1"), F.sum("bytes").over(own.rowsBetween(*_SO_FAR)).alias("b1"))
    return inner.join(before, ["conv", "range"]).select("conv", (F.col("n0") + F.col("n1")).alias("pos"), "digest", "bytes", (F.col("b0") + F.col("b1")).alias("through"))


def rebuilt_turns(conversations: DataFrame, siblings: int = 5, heads: int = 9, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(conv) and (conv, depth, digest, bytes, through) of the rebuilt conversations.

    Conversation c takes the first h = crc32(c) % heads turns of c - c % siblings, then its own after
    its first h. ``%`` keeps the sign of c, as in SQL.
    """
    placed = materialize(placed_turns(conversations, **columns), "placed")
    head = F.crc32(F.col("conv").cast("string")) % heads
    sums = placed.groupBy("conv").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("pos") <= head, F.col("bytes"))), F.lit(0)).alias("own_bytes"))
    convs = materialize(sums.withColumn("h", head).withColumn("base", F.col("conv") - F.col("conv") % siblings), "convs")
    first = placed.where(F.col("pos") < heads).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "h"), "base").where("pos <= h")
    first = first.select("conv", F.col("pos").alias("depth"), "digest", "bytes", "through")
    taken = first.groupBy("conv").agg(F.max("depth").alias("n_head"), F.max("through").alias("head_bytes"))
    shift = convs.join(taken, "conv", "left").select("conv", (F.coalesce("n_head", F.lit(0)) - F.col("h")).alias("d"), (F.coalesce("head_bytes", F.lit(0)) - F.col("own_bytes")).alias("b"))
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_hashes(convs, ["conv"], "n", total)
    rest = salted_join(placed.where(F.col("pos") > head), shift, ["conv"], hot, ["digest"])
    rest = rest.select("conv", (F.col("pos") + F.col("d")).alias("depth"), "digest", "bytes", (F.col("through") + F.col("b")).alias("through"))
    turns = materialize(first.unionByName(rest), "rebuilt")
    release(placed)
    return convs.select("conv"), turns


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Equal whole conversations as one: (conv: the smallest id, copies, len, total, ends: SHA-256 of all ids in order).

    A sequence is known by its length and two 64-bit hashes of (depth, digest). A hash needs its ids in order, so ids are sorted by
    ranges and joined into texts of CHUNK by many tasks; one task then hashes a sequence's texts, one after the other.
    """
    key = ["h1", "h2", "len"]
    whole = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64("depth", "digest")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("b"), "digest", "depth")).alias("h2"), F.count("*").alias("len"), F.max("through").alias("total"))
    zero = F.lit(0).cast("long")
    members = materialize(convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in [*key, "total"]]), "members")

    def chunks(batches):
        import pyarrow as pa

        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("len", pa.int64()), ("total", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
        now, ids = None, []

        for batch in batches:
            out = []
            for *group, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now or len(ids) == CHUNK:
                    if ids:
                        out.append((*now, ids[0], len(ids), ",".join(map(str, ids))))
                    now, ids = group, []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*now, ids[0], len(ids), ",".join(map(str, ids))), schema)], schema=schema)

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema([("conv", pa.int64()), ("copies", pa.int64()), ("len", pa.int64()), ("total", pa.int64()), ("ends", pa.string())])
        now, row, digest = None, None, None

        def flushed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            out = []
            for h1, h2, n_turns, total, conv, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (h1, h2, n_turns) != now:
                    if row:
                        out.append((row[0], row[1], *row[2:], digest.hexdigest()))
                    now, row, digest = (h1, h2, n_turns), [conv, 0, n_turns, total], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                row[1] += n
            if out:
                yield flushed(out)
        if row:
            yield flushed([(row[0], row[1], *row[2:], digest.hexdigest())])

    parts = n_partitions(convs.sparkSession)
    sorted_ids = members.select(*key, "total", "conv").repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv")
    texts = sorted_ids.mapInArrow(chunks, "h1 long, h2 long, len long, total long, conv long, n long, ids string")
    found = materialize(texts.repartition(parts, *key).sortWithinPartitions(*key, "conv").mapInArrow(hashed, "conv long, copies long, len long, total long, ends string"), "sequences")
    release(members)
    return found


def _saved(n: str, size: str) -> Column:
    return (F.col(n) - 1) * F.col(size)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: see NODE. convs: every conversation, turnless ones included; turns: as of rebuilt_turns.

    Without conversations there is no node, no root either. A root has no parent, and its conv_id is the smallest of all.
    """
    none = F.sha2(F.lit("").cast("binary"), 256)
    seqs = sequences(convs, turns)
    root = seqs.agg(F.min("conv").alias("node"), F.sum("copies").alias("n"), F.min(F.when(F.col("len") == 0, F.col("conv"))).alias("ender"), F.sum(F.col("len") + 1).alias("rows"), F.count("*").alias("live")).first()
    hot_convs = hot_hashes(seqs, ["conv"], "len", root["rows"] or 0)
    steps = salted_join(turns, seqs.select("conv", "copies", "len", "total"), ["conv"], hot_convs, ["depth"])
    steps = steps.select("conv", "depth", "digest", "bytes", "copies", "len", (F.col("total") - F.col("through") + F.col("bytes")).alias("left"))
    steps = materialize(steps.repartitionByRange(n_partitions(convs.sparkSession), "depth", "conv").sortWithinPartitions("depth"), "steps")  # a level reads its own row groups

    live, n_live, levels, depth = seqs.where("len > 0").select("conv", F.lit(root["node"]).cast("long").alias("node")), root["live"], [], 0
    while n_live:
        depth += 1
        following = live.join(steps.where(F.col("depth") == depth), "conv")
        groups = following.groupBy("node", "digest").agg(F.min("conv").alias("conv"), F.sum("copies").alias("n"), F.count("*").alias("n_seqs"), F.min("bytes").alias("bytes"), F.min("left").alias("left"), F.min("len").alias("len"), F.min(F.when(F.col("len") == depth, F.col("conv"))).alias("ender"))
        groups = materialize(groups, f"level-{depth}")
        levels.append(groups)
        n_live = groups.agg(F.coalesce(F.sum(F.when(F.col("n_seqs") > 1, F.col("n_seqs"))), F.lit(0))).first()[0]
        if n_live:
            shared = groups.where("n_seqs > 1").select("node", "digest", F.col("conv").alias("child"))
            hot = hot_hashes(groups, ["node", "digest"], "n_seqs", n_live)
            going = salted_join(following.where(F.col("len") > depth), shared, ["node", "digest"], hot, ["conv"])
            before, live = live, materialize(going.select("conv", F.col("child").alias("node")), "live")
            release(before)

    # single sequences: chains below the last shared node
    alone = None
    for d, groups in enumerate(levels, 1):
        heads = groups.where("n_seqs = 1").select("conv", F.col("node").alias("parent"), F.lit(d).cast("long").alias("since"))
        alone = heads if alone is None else alone.unionByName(heads)
    parts = []
    if alone is not None:
        alone = alone.join(seqs.select("conv", "ends"), "conv")
        chain = salted_join(steps, alone, ["conv"], hot_convs, ["depth"]).where("depth >= since")
        last = F.col("depth") == F.col("len")
        parts.append(chain.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), _saved("copies", "left").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(none).alias("ends_sha256")))

    # shared nodes, from the deepest level up
    rolled, shared_nodes = None, []
    tops = seqs.limit(0).select(F.lit(None).cast("long").alias("node"), "conv", F.col("copies").alias("n"), F.lit(0).cast("long").alias("bytes"), F.col("conv").alias("ender"))
    if root["node"] is not None:
        tops = convs.sparkSession.createDataFrame([(None, root["node"], root["n"], 0, root["ender"])], "node long, conv long, n long, bytes long, ender long")
    for d in range(len(levels), -1, -1):
        own = levels[d - 1].where("n_seqs > 1").select("node", "conv", "n", "bytes", "ender") if d else tops
        if d < len(levels):
            kids = levels[d].where("n_seqs = 1").select("node", F.lit(1).cast("long").alias("leaves"), _saved("n", "left").alias("saved"))
            if rolled is not None:
                kids = kids.unionByName(rolled.select("node", "leaves", "saved"))
            sums = kids.groupBy(F.col("node").alias("conv")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
            own = own.join(sums, "conv", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "leaves", "below")})
        rolled = own.select("node", "conv", F.lit(d).cast("long").alias("depth"), "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (_saved("n", "bytes") + F.coalesce("below", F.lit(0))).alias("saved"), "ender")
        rolled = materialize(rolled, f"rolled-{d}")
        shared_nodes.append(rolled)
    for level in shared_nodes:
        shape = [F.col("conv").alias("conv_id"), "depth", F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
        parts.append(level.where("ender IS NULL").select(*shape, none.alias("ends_sha256")))
        parts.append(level.where("ender IS NOT NULL").join(seqs.select(F.col("conv").alias("ender"), F.col("ends").alias("ends_sha256")), "ender").select(*shape, "ends_sha256"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*NODE)
