"""Keyword search without a full scan: a trigram index whose candidates are verified on the texts.

The index is built where the rows are: a task numbers its rows, and for every block of 64 rows and each trigram keeps one 64-bit
mask of the rows that hold it. Masks are written sorted by trigram, so a search reads the row groups of its own trigrams; a Bloom
filter per segment (the rows of one task) spares segments that can't hold them all. What is left is looked up by segment and block, and
checked by ``contains``, so the index only ever saves reading. Tokens of less than three letters prune nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import work_dir
from .refine import matches

BLOCK = 64
#: Bits of a segment's filter: BLOOM_WORDS of 64 each, two of them set by a trigram.
BLOOM_WORDS = 4096
#: So many blocks can be named in the scan's filter; more of them are joined.
NAMED_BLOCKS = 2000
ROW_GROUP = 1 << 20


def trigrams(token: str) -> set[str]:
    return {token[i : i + 3] for i in range(len(token) - 2)}


def _bits(trigram: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(trigram, F.lit(seed)), F.lit(64 * BLOOM_WORDS)) for seed in (1, 2)]


def _has_bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftright", word, at.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


@dataclass
class TextIndex:
    """An index in a folder: ``rows`` (the table, with segment, block and place), ``masks`` and ``filters``."""

    spark: SparkSession
    folder: str
    text_col: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def masks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/masks")

    def filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/filters")

    def segments(self, wanted: set[str]) -> list[int]:
        """Segments whose filter has every bit of the trigrams: a row per task that built the index, as many as it has files."""
        test = F.lit(True)
        for t in sorted(wanted):
            for h in _bits(F.lit(t)):
                test = test & _has_bit(F.coalesce(F.try_element_at("words", F.shiftright(h, 6).cast("int")), F.lit(0).cast("long")), h.bitwiseAND(F.lit(63)))
        return [r[0] for r in self.filters().where(test).select("segment").collect()]

    def candidates(self, query: str) -> DataFrame | None:
        """(segment, block, mask) of the rows that hold every trigram of the query's tokens; None if no token has one."""
        wanted = set().union(*(trigrams(t) for t in query.lower().split())) if query.split() else set()
        if not wanted:
            return None
        found = self.masks().where(F.col("trigram").isin(sorted(wanted)) & F.col("segment").isin(self.segments(wanted)))
        whole = found.groupBy("segment", "block", "trigram").agg(F.bit_or("mask").alias("mask"))  # a block that two tasks read has two masks
        blocks = whole.groupBy("segment", "block").agg(F.bit_and("mask").alias("mask"), F.count("*").alias("n"))
        return blocks.where((F.col("n") == len(wanted)) & (F.col("mask") != 0)).select("segment", "block", "mask")

    def search(self, query: str) -> DataFrame:
        """The table's rows whose text holds every token of the query; the same as a scan with ``matches`` gives."""
        table, found = self.rows(), self.candidates(query)
        if found is not None:
            few = found.select("segment", "block").limit(NAMED_BLOCKS + 1).collect()
            if len(few) <= NAMED_BLOCKS:  # names in the scan's filter: other row groups aren't read
                table = table.where(F.col("segment").isin(sorted({r.segment for r in few})) & F.col("block").isin(sorted({r.block for r in few})))
            table = table.join(found, ["segment", "block"]).where(_has_bit(F.col("mask"), F.col("place"))).drop("mask")
        own = [c for c in table.columns if c not in ("segment", "block", "place")]
        return table.where(matches(query, self.text_col)).select(*own)

    def reading(self, query: str) -> DataFrame:
        """part (masks or rows), bytes_all, bytes_read: compressed bytes of the row groups that a search can't rule out by their statistics."""
        wanted = set().union(set(), *(trigrams(t) for t in query.lower().split()))
        found = self.candidates(query)
        masks = _row_groups(self.spark, f"{self.folder}/masks", "trigram")
        segments = self.segments(wanted) if wanted else []
        hit = F.lit(False)
        for t in sorted(wanted):
            hit = hit | ((F.col("low") <= t) & (F.col("high") >= t))
        own = F.exists(F.lit(segments).cast("array<long>"), lambda s: s.between(F.col("segment"), F.col("last_segment")))
        read = masks.withColumn("read", hit & own)
        rows = _row_groups(self.spark, f"{self.folder}/rows", "block").withColumn("low", F.col("low").cast("long")).withColumn("high", F.col("high").cast("long"))
        if found is None:
            rows = rows.withColumn("read", F.lit(True))
        else:
            near = rows.join(found.select(F.col("segment").alias("s"), "block").distinct(), (F.col("segment") == F.col("s")) & F.col("block").between(F.col("low"), F.col("high")), "left_semi").select("file", "group")
            rows = rows.join(near.withColumn("read", F.lit(True)), ["file", "group"], "left").withColumn("read", F.coalesce("read", F.lit(False)))
        both = read.select(F.lit("masks").alias("part"), "bytes", "read").unionByName(rows.select(F.lit("rows").alias("part"), "bytes", "read"))
        return both.groupBy("part").agg(F.sum("bytes").alias("bytes_all"), F.coalesce(F.sum(F.when(F.col("read"), F.col("bytes"))), F.lit(0)).alias("bytes_read"))


def _row_groups(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """file, group, segment (first and last), low, high, bytes of every row group; footers are read by tasks."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        from ..shared import opened

        for batch in batches:
            out = []
            for address in batch.column(0).to_pylist():
                files, path = opened(address)
                meta = pq.ParquetFile(files.open_input_file(path)).metadata
                where = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    own, seg = (group.column(where[c]).statistics for c in (column, "segment"))
                    size = sum(group.column(i).total_compressed_size for i in range(group.num_columns))
                    out.append((address, g, int(seg.min), int(seg.max), str(own.min), str(own.max), size))
            names = ["file", "group", "segment", "last_segment", "low", "high", "bytes"]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    listed = spark.read.parquet(folder).inputFiles()
    return spark.createDataFrame([(f,) for f in listed], "file string").repartition(max(1, min(len(listed), 64))).mapInArrow(run, "file string, group int, segment long, last_segment long, low string, high string, bytes long")


def build_index(table: DataFrame, text_col: str = "name", folder: str | None = None) -> TextIndex:
    """Index a table. Two passes over it without a shuffle: one writes its rows, numbered; one makes the masks from what was written.

    Null texts match nothing. Columns named segment, block or place are replaced.
    """
    spark = table.sparkSession
    folder = folder or work_dir(spark, "textindex")
    at = F.monotonically_increasing_id()
    numbered = table.withColumn("at", at).withColumn("segment", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = numbered.withColumn("block", F.shiftright("row", 6)).withColumn("place", F.col("row").bitwiseAND(F.lit(BLOCK - 1)).cast("int")).drop("at", "row")
    numbered.write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/rows")

    def mask(batches):
        import pyarrow as pa

        at, found = None, {}

        def flushed():
            keys = sorted(found)
            signed = [m - (1 << 64) if m >> 63 else m for m in map(found.get, keys)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(keys), pa.int64()), pa.array([at[1]] * len(keys), pa.int64()), pa.array(keys, pa.string()), pa.array(signed, pa.int64())], names=["segment", "block", "trigram", "mask"])

        for batch in batches:
            for segment, block, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (segment, block) != at:
                    if found:
                        yield flushed()
                    at, found = (segment, block), {}
                if text:
                    bit = 1 << place
                    for t in trigrams(text):
                        found[t] = found.get(t, 0) | bit
        if found:
            yield flushed()

    texts = spark.read.parquet(f"{folder}/rows").select("segment", "block", "place", F.lower(text_col).alias("t"))
    made = texts.mapInArrow(mask, "segment long, block long, trigram string, mask long").sortWithinPartitions("trigram", "segment", "block")
    made.write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/masks")
    index = TextIndex(spark, folder, text_col)
    bits = index.masks().select("segment", F.explode(F.array(*_bits(F.col("trigram")))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = bits.groupBy("segment", F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("word"))
    filters = words.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("words"))  # BLOOM_WORDS entries at most
    filters.write.parquet(f"{folder}/filters")
    return index
