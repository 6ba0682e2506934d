"""The generated source: 120 listings that depend on the query alone.

Its generator's state after k draws is the seed plus k times a constant, so every row is computed on its own
from its place: no row waits for the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the generated pool.
CATEGORIES = ["Movies", "TV", "Anime", "Music", "Software", "Games"]
SUFFIXES = ["[1080p]", "[720p]", "[2160p 4K]", "EXTENDED", "REMASTERED", "COMPLETE", "[WEB-DL]", "[BluRay]", "SEASON 1", "COLLECTION"]
ROWS, PAGE, DRAWS = 120, 20, 47
GAMMA, OFFSET_BASIS, PRIME = 0x6D2B79F5, 2166136261, 16777619
_MASK = 0xFFFFFFFF


def seed_of(query: str) -> int:
    """FNV-1a over UTF-16 code units."""
    h = OFFSET_BASIS
    units = (query or "demo").encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * PRIME) & _MASK
    return h


def draw(seed: int, k: int) -> float:
    """The k-th draw (from 0) in [0, 1)."""
    s = (seed + (k + 1) * GAMMA) & _MASK
    t = ((s ^ s >> 15) * (s | 1)) & _MASK
    t = (t ^ (t + (t ^ t >> 7) * (t | 61))) & _MASK
    return (t ^ t >> 14) / 4294967296


def row(query: str, i: int) -> dict:
    seed, at = seed_of(query), DRAWS * i
    x = [draw(seed, at + k) for k in range(DRAWS)]
    category, suffix = CATEGORIES[int(x[0] * 6)], SUFFIXES[int(x[1] * 10)]
    return {
        "ord": i, "provider": "demo", "name": f"{query} {suffix} - S01E{1 + int(x[2] * 24):02d} [{category}]", "size_num": int((x[3] * 48 + 0.2) * 1024**3), "seeders": str(int(x[4] * 5000)),
        "leechers": str(int(x[5] * 1500)), "age_days": int(x[6] * 730), "category": category, "info_hash": "".join(f"{int(v * 16):x}" for v in x[7:]),
    }


def pool(spark: SparkSession, query: str, now_ms: int) -> DataFrame:
    """The raw rows; dates count back from now_ms."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = pd.DataFrame([row(query, int(i)) for i in pdf.id], columns=["ord", "provider", "name", "size_num", "seeders", "leechers", "age_days", "category", "info_hash"])
            out["date_num"] = now_ms - out.pop("age_days") * 86_400_000
            yield out

    return spark.range(ROWS).mapInPandas(run, "ord long, provider string, name string, size_num long, seeders string, leechers string, category string, info_hash string, date_num long")


def has_more(page: int) -> bool:
    return page * PAGE < ROWS
