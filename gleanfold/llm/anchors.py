"""Content-defined anchors: where equal long byte strings are sure to meet.

Every window of ``window`` bytes is given to the leftmost of its strings of ``gram_of(window)`` bytes with the smallest hash. That choice
depends on the window's bytes alone, so equal windows, wherever they are, choose strings with equal key at
equal places. Neighbouring windows mostly share their anchor: an anchor owns a run of window starts, and
its context is the bytes under them. A context's identity is XXH64 of those bytes and of its shape.
"""

from __future__ import annotations

WINDOW = 400
_SEGMENT = 1 << 20
_PRIME = (1 << 31) - 1
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, object] = {}


def _tables(n: int):
    import numpy as np

    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M2))
    return _powers["up"], _powers["down"], _powers["byte"]


def mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(_M1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_M2)
    return h ^ (h >> np.uint64(32))


def gram_of(window: int) -> int:
    return window * 4 // 25


class PrimeHashes:
    """As Hashes, modulo a prime: a second opinion where equality must not rest on one hash."""

    def __init__(self, raw: bytes):
        import numpy as np

        def powers(base: int):
            table = np.ones(1, np.uint64)
            while len(table) < n:
                table = np.concatenate((table, table * np.uint64(pow(base, len(table), _PRIME)) % p))
            return table[:n]

        n, p = len(raw) + 1, np.uint64(_PRIME)
        up, self.down = powers(1_000_003), powers(pow(1_000_003, -1, _PRIME))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: n - 1] % p, out=self.sums[1:])

    def at(self, start, end):
        import numpy as np

        p = np.uint64(_PRIME)
        return (self.sums[end] - self.sums[start]) % p * self.down[start] % p


class Hashes:
    """Hashes of any substrings of a byte string, from one pass over it."""

    def __init__(self, raw: bytes):
        import numpy as np

        b = np.frombuffer(raw, np.uint8)
        up, self.down, byte = _tables(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(byte[b] * up[: len(b)], out=self.sums[1:])

    def at(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(raw: bytes, window: int = WINDOW):
    """(place, first, last, key, context) arrays of the anchors: first to last are the window starts that it owns."""
    import numpy as np
    import xxhash

    gram = gram_of(window)
    empty = np.zeros(0, np.int64)
    parts = []
    for base in range(0, max(1, len(raw) - window + 1), _SEGMENT):  # windows start in [base, base + _SEGMENT)
        seg = raw[base : base + _SEGMENT + window - 1]
        n = len(seg) - window + 1
        if n <= 0:
            continue
        h = Hashes(seg)
        i = np.arange(len(seg) - gram + 1)
        grams = h.at(i, i + gram)
        order = grams >> np.uint64(24) << np.uint64(24) | i.astype(np.uint64)
        w = window - gram + 1
        padded = np.full(-(-len(order) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(order)] = order
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        place = place[first]
        shape = ((place - first) << 20 | (last - first)).astype(np.uint64)
        digest, view = xxhash.xxh64_intdigest, memoryview(seg)
        whole = np.fromiter((digest(view[a : b + window]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
        parts.append((place + base, first + base, last + base, grams[place], mix(whole + shape * np.uint64(_M2))))
    if not parts:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts))
