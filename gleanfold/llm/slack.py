"""Best-fit packing by minimum bin slack: as few token windows as possible, no document cut that fits one.

How many pieces there are of each length is all that a packing depends on, and there are at most
``window`` lengths. So the packing is planned on that histogram: the longest piece that is left opens
a window, a subset-sum over bitsets finds the fullest combination of the lengths still available for
its gap, and that combination is removed as often as the histogram holds it. The plan is a list of such
combinations; each makes one of its lengths too rare to be used so often again, so there are at most
window * (1 + ln(window)) of them, however large the corpus. Spark counts, numbers the pieces of each length, and gives
piece number r of a length the place that the plan has for it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(gap: int, lengths: list[int], left: Mapping[int, int]) -> Counter:
    """How many pieces of each length fill the gap best; ``lengths`` ascends, ``left`` has what there is of each.

    Bit s of ``reach`` says that some combination adds up to s. Lengths enter from the longest down, a
    count as its binary parts, and the search ends when the gap can be filled, so short pieces are kept for later gaps.
    """
    reach, full, steps = 1, (2 << gap) - 1, []
    for i in range(bisect_right(lengths, gap) - 1, -1, -1):
        if reach >> gap & 1:
            break
        length, part = lengths[i], 1
        more = min(left[length], gap // length)
        while more > 0:
            take = min(part, more)
            grown = reach | reach << length * take & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            more -= take
            part *= 2
    used, total = Counter(), reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def plan(histogram: Mapping[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, uses, sequence, offset): pieces lo, lo + 1, ... of a length go to windows from ``sequence`` on, ``uses`` to each, from ``offset`` on."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths, taken, slots, sequence = sorted(left), Counter(), [], 0
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        used = fullest(window - longest, lengths, left)
        left[longest] += 1
        used[longest] += 1
        times, offset = min(left[n] // uses for n, uses in used.items()), 0
        for n in sorted(used, reverse=True):
            slots.append((n, taken[n], used[n], sequence, offset))
            taken[n] += times * used[n]
            left[n] -= times * used[n]
            offset += n * used[n]
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
        sequence += times
    return slots


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int) -> DataFrame:
    """A row per piece; ``nth`` numbers the pieces of one length within the task ``part``."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        encode, seen = encoder(tokenizer), Counter()
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(text.as_py())
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, window)):
                    length = min(window, n - start)
                    for c, v in zip(cols, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length])):
                        c.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), F.spark_partition_id().alias("p")).mapInArrow(cut, PIECES)


def pack_fullest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 4096) -> DataFrame:
    """One row per piece: which ids of the document, in which sequence, at which offset.

    Documents longer than the window are cut into full windows and a rest. Null text: the end id alone. Empty table: no rows.
    Repeated rows and identifiers are packed each; pieces of one length are interchangeable and go by
    task and place. Extra columns are ignored, whatever their names. A length that very many pieces have
    is one number in the plan; its pieces are numbered task by task.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), window), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``window`` rows
    slots = np.array(sorted(plan(histogram, window)), dtype=np.int64).reshape(-1, 5)

    def place(batches):
        import pyarrow as pa

        first = (slots[:, 0] << 44) + slots[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = slots[np.searchsorted(first, (length << 44) + rank, side="right") - 1]
            turn, use = np.divmod(rank - slot[:, 1], slot[:, 2])
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(slot[:, 3] + turn), pa.array(slot[:, 4] + use * length)], names=[x.split()[0] for x in PLACED.split(", ")])

    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, PLACED)
