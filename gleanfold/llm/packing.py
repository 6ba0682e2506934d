"""Hierarchical packing of token sequences into windows of several lengths.

Documents are routed to tiers by length (the window lengths double from tier to tier). Each tier
is packed on its own, longest tier first; the gaps of a long window are filled from shorter
tiers, whole documents first, and a last small gap with the head of a document, whose rest goes
back to its tier. What a block of documents leaves over is cut into windows of powers of two, so
that no window is padded. Windows are then dealt into step groups of equal tokens, in an order that
evens out the attention cost (sum of squared piece lengths) of a tier's groups.

Every task packs the documents of its own partition, block by block: no shuffle, and memory is
bounded by ``block_tokens`` plus the longest document.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_tokenizer, encoder

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def pack_block(lengths: list[int], window: int = 2048, n_tiers: int = 4) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces that hold each token of the block exactly once.

    A full window has exactly ``window`` ids or a smaller power of two of them.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    tiers = [window >> i for i in reversed(range(n_tiers))]
    queues: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start), ascending
    done: list[list[tuple[int, int, int]]] = []

    def route(doc: int, start: int, length: int) -> None:
        if length:
            t = next(i for i, size in enumerate(tiers) if length <= size)
            insort(queues[t], (length, doc, start))

    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
    for doc, n in enumerate(lengths):
        full = n // window
        done += [[(doc, i * window, window)] for i in range(full)]
        if rest := n - full * window:
            waiting[next(i for i, size in enumerate(tiers) if rest <= size)].append((rest, doc, full * window))
    for t, items in enumerate(waiting):
        queues[t] = sorted(items)

    for t in range(len(tiers) - 1, -1, -1):
        size = tiers[t]
        while queues[t] and sum_at_least(queues[: t + 1], size):
            gap, pieces = size, []
            while gap:
                for q in range(t, -1, -1):  # the longest whole document that fits, from the longest tier
                    i = bisect_right(queues[q], (gap, 1 << 62, 1 << 62))
                    if i:
                        length, doc, start = queues[q].pop(i - 1)
                        pieces.append((doc, start, length))
                        gap -= length
                        break
                else:  # none fits: cut the shortest one there is
                    q = next(q for q in range(t + 1) if queues[q])
                    length, doc, start = queues[q].pop(0)
                    pieces.append((doc, start, gap))
                    route(doc, start + gap, length - gap)
                    gap = 0
            done.append(pieces)
    rest = [x for q in reversed(queues) for x in reversed(q)]
    left = sum(x[0] for x in rest)
    size = 1 << max(0, left.bit_length() - 1)
    while left:  # the binary digits of what is left
        gap, pieces = size, []
        while gap:
            length, doc, start = rest.pop()
            take = min(gap, length)
            pieces.append((doc, start, take))
            if take < length:
                rest.append((length - take, doc, start + take))
            gap -= take
        done.append(pieces)
        left -= size
        size = 1 << max(0, left.bit_length() - 1)
    return done


def sum_at_least(queues: list[list[tuple[int, int, int]]], size: int) -> bool:
    total = 0
    for q in reversed(queues):
        for x in reversed(q):
            total += x[0]
            if total >= size:
                return True
    return False


def step_groups(windows: list[list[tuple[int, int, int]]], group_tokens: int) -> list[int]:
    """A group for each window: one window length in a group, ``group_tokens`` ids at most, similar attention cost."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_size.setdefault(sum(p[2] for p in w), []).append(i)
    groups, first = [0] * len(windows), 0
    for size, members in sorted(by_size.items()):
        n = -(-len(members) * size // max(size, group_tokens))
        members.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i]))
        for k, i in enumerate(members):  # there and back again
            lap, at = divmod(k, n)
            groups[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 2048, n_tiers: int = 4, group_tokens: int = 8 * 2048, block_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece; sequence_id and step_group are unique over the job (partition in the high bits).

    Null text: the end id alone. Empty table: no rows. Repeated rows are packed each. Extra columns
    are ignored, whatever their names. Very long texts are cut into full windows; pieces of equal length go by their place in the block.
    """
    tokenizer = tokenizer or default_tokenizer()

    def pack(batches):
        import zlib

        import pyarrow as pa

        encode = encoder(tokenizer)
        base = 0
        n_sequences = n_groups = held = 0
        block: list[tuple[int | None, bytes]] = []

        def packed():
            nonlocal n_sequences, n_groups
            windows = pack_block([len(ids) // 4 for _, ids in block], window, n_tiers)
            groups = step_groups(windows, group_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for pieces, group in zip(windows, groups):
                offset, size = 0, sum(p[2] for p in pieces)
                for d, start, length in pieces:
                    doc_id, ids = block[d]
                    row = doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + n_sequences, offset, size, base + n_groups + group
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += length
                n_sequences += 1
            n_groups += max(groups, default=-1) + 1
            names = [x.split()[0] for x in OUT.split(", ")]
            kinds = [pa.int32() if n == "window" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            base = batch.column(2)[0].as_py() << 40 if batch.num_rows else base
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                block.append((doc_id, ids))
                held += len(ids) // 4
                if held >= block_tokens:
                    yield packed()
                    block, held = [], 0
        if block:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), F.spark_partition_id().alias("p")).mapInArrow(pack, OUT)
