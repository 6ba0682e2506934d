"""Deep pages: a sorted table with the number of rows of each of its ranges, so that page n reads one range.

    table = ordered_table(merged, F.desc("seeders"), F.col("ord"))
    table.page(5000)           # rows 99,980 to 99,999 of the order, from the one or two ranges that hold them
    table.after(row["place"])  # the rows that follow one that was seen

Sorting is done once, by ranges; the ranges' sizes are the order statistic. A page is then a filter on
(range, place in the range): the first chooses a folder, the second a row group.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import delete, work_dir

ROW_GROUP = 1 << 20


@dataclass
class OrderedTable:
    """A sorted table in a folder. ``firsts``: the place, from 0, of each range's first row; a number per range."""

    spark: SparkSession
    folder: str
    ranges: list[int]
    firsts: list[int]
    total: int
    schema: StructType

    def rows(self) -> DataFrame:
        """All rows with ``place``, from 1."""
        return self.between(0, self.total)

    def between(self, first: int, end: int) -> DataFrame:
        """The rows of places first to end - 1, counted from 0, with ``place`` from 1; only the ranges that hold them are read."""
        first, end = max(0, first), min(end, self.total)
        table = self.spark.read.schema(self.schema).parquet(self.folder)
        a, b = bisect_right(self.firsts, first) - 1, bisect_right(self.firsts, max(first, end - 1))
        chosen = list(zip(self.ranges[max(a, 0) : b], self.firsts[max(a, 0) : b])) if first < end else []
        test, start = F.lit(False), F.lit(0).cast("long")
        for r, at in chosen if len(chosen) <= 64 else []:
            low, high = first - at, end - at
            test = test | ((F.col("_range") == r) & (F.col("_at") >= low) & (F.col("_at") < high))
            start = F.when(F.col("_range") == r, F.lit(at).cast("long")).otherwise(start)
        if len(chosen) > 64:  # a long stretch: the sizes as a table
            at = self.spark.createDataFrame(chosen, "_range int, _first long")
            table = table.join(F.broadcast(at), "_range")  # a row per range
            test, start = (F.col("_first") + F.col("_at")).between(first, end - 1), F.col("_first")
        return table.where(test).withColumn("place", start + F.col("_at") + 1).drop("_range", "_at", "_first")

    def page(self, number: int, size: int = 20) -> DataFrame:
        return self.between((number - 1) * size, number * size).orderBy("place")

    def after(self, place: int, size: int = 20) -> DataFrame:
        """The rows that follow a place, as a page that begins there."""
        return self.between(place, place + size).orderBy("place")

    def remove(self) -> None:
        delete(self.spark, self.folder)


def ordered_table(rows: DataFrame, *by: Column) -> OrderedTable:
    """Sort once into ranges. ``by`` should be a total order; rows that it leaves equal lie together in some order that stays.

    Columns named place, _range or _at are replaced.
    """
    spark = rows.sparkSession
    folder, n = work_dir(spark, "ordered"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.drop("place").repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    dealt.write.partitionBy("_range").option("parquet.block.size", ROW_GROUP).parquet(folder)
    stored = spark.read.schema(dealt.schema).parquet(folder)
    sizes = sorted((r["_range"], r["n"]) for r in stored.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row per range
    firsts, total = [], 0
    for _, size in sizes:
        firsts.append(total)
        total += size
    return OrderedTable(spark, folder, [r for r, _ in sizes], firsts, total, dealt.schema)
