"""Helpers shared by the corpus operators: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_made: list[str] = []
_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: A key with more than 1/HOT of a table's rows is hot: its rows are dealt to SALTS tasks.
HOT, SALTS = 256, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode; on a cluster that is an error,
    as executors wouldn't see each other's files.
    """
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gleanfold-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleanfold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove materialised tables whose last reader has finished."""
    for t in tables:
        path = _path_of.pop(t, None)
        if path:
            _made.remove(path)
            remove(t.sparkSession, path)


def mark() -> int:
    """A point in the list of tables made, for remove_since."""
    return len(_made)


def remove_since(spark: SparkSession, point: int) -> None:
    """Remove the tables made since that point; frames that read from them are of no use afterwards."""
    while len(_made) > point:
        remove(spark, _made.pop())



def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared folder, wherever that is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_all(spark: SparkSession) -> None:
    """Delete every intermediate table; frames that still read from one are of no use afterwards."""
    remove(spark, f"{shared_dir(spark)}/gleanfold")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_hashes(counts: DataFrame, keys: list[str], n: str, total: int) -> list[int]:
    """Hashes of the keys that hold more than 1/HOT of ``total`` rows: fewer than HOT, so they fit the driver."""
    return [r[0] for r in counts.where(F.col(n) * HOT > F.lit(total)).select(F.xxhash64(*keys)).collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[int], vary: list[str], how: str = "inner") -> DataFrame:
    """left joined to right, whose keys are unique; rows of hot keys are dealt to SALTS tasks.

    The salt comes from the columns ``vary`` and the row's partition, so a task that runs again deals alike.
    """
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*vary, F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) longs to (node, root): root is the smallest node reachable. Nodes without an edge don't appear.

    Alternating large-star and small-star steps. Each is an aggregate with a partial stage and a
    join back; the edges of a node with very many neighbours are salted.
    """
    spark = edges.sparkSession

    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = materialize(e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return e, tuple(row)

    e, state = stored(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        hot = hot_hashes(both.groupBy("u").count(), ["u"], "count", 2 * state[0])
        large = salted_join(both.where("v > u"), low.withColumnRenamed("k", "u"), ["u"], hot, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = salted_join(large, low.select(F.col("k").alias("u"), "m"), ["u"], hot, ["v"])
        pairs = small.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(low.select(F.col("k").alias("src"), F.col("m").alias("dst")))
        before = e
        e, after = stored(pairs)
        release(before)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
