"""Small tables with awkward rows, and brute-force rules to hold operators against."""

import random
import zlib

WORDS = "the of and river stone light walk over under green seven house mark tide ember quill north lamp".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "ing", "ed", "s", "", "er"])
        out.append(w + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def awkward_rows(seed: int = 5, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and very long texts, copies, repeated rows and identifiers."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 20, 80, 300])) for _ in range(n)]
    texts += [None, "", " \n\t ", "   é 한글 \U0001F9FF x\x00y", prose(rng, 20000), "aaaa " * 3000]
    texts += [texts[3]] * 12
    near = texts[5].split(" ")
    for k in range(4):
        near = near[:]
        near[k % len(near)] = "changed"
        texts.append(" ".join(near))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        for name in ("fp", "cell", "shard", "k", "t", "size", "u", "v", "key", "part"):
            df = df.withColumn(name, F.lit("x"))
    return df


def crc(b: bytes) -> int:
    return zlib.crc32(b)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
