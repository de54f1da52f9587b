"""Helpers that the pipeline operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a side that may be broadcast. A row here is a key or a few numbers, so this is some tens of MB.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written(list):
    """Folders written by one call of an operator, to be dropped once they are of no more use, and names of tables over them."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []


def _folder(spark: SparkSession, kept: Written | None) -> str:
    """A new folder in the shared one. What its writer doesn't drop goes when the session ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if kept is not None:
        kept.append(path)
    return path


def materialize(df: DataFrame, kept: Written | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = _folder(df.sparkSession, kept)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, kept: Written, least: int = 48) -> DataFrame:
    """Like materialize(), in buckets of `column`: grouping by it later needs no shuffle. A task writes a file for each of its values at most."""
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept.names.append(name)
    df.write.bucketBy(n, column).option("path", _folder(spark, kept)).saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession, kept: Written) -> None:
    """Delete written tables that no later step reads."""
    for name in kept.names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in kept:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    kept.clear()
    kept.names.clear()


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many groups of about `each` rows hold `total` rows."""
    return max(least, -(-total // each))


def numbered(df: DataFrame, shard: list[str], order: list[str], into: str, rows: int, each: int = 20_000, kept: Written | None = None) -> DataFrame:
    """Add `into`: a number from 0, without gaps, within each group of `shard`.

    Rows of a group are dealt to buckets by a hash of `order`, numbered within
    the bucket and shifted by the sizes of the buckets before it, so no task
    sorts a whole group. df must give the same rows each time it is read.
    """
    from pyspark.sql import Window

    n = pieces(rows, each, 8)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*shard, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*shard, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(sizes, [*shard, "_bucket"]).withColumn(into, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_before", "_rank")


def give_back() -> None:
    """Return memory that Arrow's pool and the C library hold unused; a Python worker lives on for the next stage's tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """mapInArrow, after which a task's worker gives back unused memory."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)
