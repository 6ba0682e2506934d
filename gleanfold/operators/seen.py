"""What a search has shown so far: a log of identifiers in the shared folder, with a Bloom filter in front of it.

    log = SeenLog(spark)
    new = log.unseen(page.select("id"))   # reads the log only for rows that the filter can't clear
    log.add(new)                          # a folder a page

A page costs its own rows and one reading of the log's identifiers; no earlier page is computed again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, work_dir

#: The filter has WORDS of 64 bits, of which an identifier sets three.
WORDS = 1 << 14


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64 * WORDS)) for seed in (1, 2, 3)]


class SeenLog:
    def __init__(self, spark: SparkSession, key: str = "id"):
        self.spark, self.key, self.folder = spark, key, work_dir(spark, "seen")
        self.words: dict[int, int] = {}
        self.pages = 0

    def ids(self) -> DataFrame:
        """All identifiers so far, each once; null for rows without one."""
        if not self.pages:
            return self.spark.createDataFrame([], f"{self.key} string")
        return self.spark.read.schema(f"{self.key} string").parquet(*[f"{self.folder}/page-{i}" for i in range(self.pages)])

    def _maybe(self) -> Column:
        """Whether the filter can't rule out that a row was seen."""
        words = np.zeros(WORDS, np.uint64)
        for at, word in self.words.items():
            words[at] = word & (1 << 64) - 1

        @F.pandas_udf("boolean")
        def holds(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            held = np.ones(len(a), bool)
            for bit in (a.to_numpy(np.uint64), b.to_numpy(np.uint64), c.to_numpy(np.uint64)):
                held &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pd.Series(held)

        return holds(*_bits(F.coalesce(F.col(self.key), F.lit(""))))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose identifier is not in the log; a null identifier counts as one."""
        if not self.pages:
            return rows
        marked = rows.withColumn("_maybe", self._maybe())
        seen = self.ids().select(F.col(self.key).alias("_seen"))
        held = marked.where("_maybe").join(seen, F.col(self.key).eqNullSafe(F.col("_seen")), "left_anti")
        return marked.where(~F.col("_maybe")).unionByName(held).drop("_maybe")

    def add(self, rows: DataFrame) -> int:
        """Log the identifiers of rows that ``unseen`` has left; how many different ones there are."""
        path = f"{self.folder}/page-{self.pages}"
        rows.select(F.col(self.key).cast("string").alias(self.key)).distinct().write.mode("overwrite").parquet(path)
        own = self.spark.read.schema(f"{self.key} string").parquet(path)
        bits = own.select(F.explode(F.array(*_bits(F.coalesce(F.col(self.key), F.lit(""))))).alias("bit"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
        for r in bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("word")).collect():  # WORDS rows at most
            self.words[r["at"]] = self.words.get(r["at"], 0) | r["word"]
        self.pages += 1
        return own.count()

    def remove(self) -> None:
        delete(self.spark, self.folder)
