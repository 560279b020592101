"""Deterministic draws and dense numbers, without a single-partition window."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def order_key(seed: int, tag: str, *ids: Column) -> Column:
    """A random-looking order that every engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[i.cast("string") for i in ids]).cast("binary"))


def accepted(rate: float, seed: int, tag: str, *ids: Column) -> Column:
    """A hash draw that comes true with probability ``rate``."""
    return F.lit(True) if rate >= 1 else F.substring(order_key(seed, tag, *ids), 1, 8) < F.lit(f"{int(rate * 2**32):08x}")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, a new folder on a local master, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphmill-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is planned and run meanwhile leaves no shuffle files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (shared folder) and cut its lineage.

    A checkpoint inherits the size estimate of the plan it replaces, and in loops of joins these
    products grow to numbers of millions of digits. So the checkpointed rows are wrapped anew,
    without an estimate; adaptive execution sees their true size. The shuffle files behind the
    checkpoint are dropped at once: nothing reads them again.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    with shuffles_dropped(spark):
        done = df.select("*").checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """``df`` as compressed columns in a folder that all executors share: a fraction of a checkpoint's bytes, for rows whose partitions don't matter.

    ``partitions``: columns by which readers find their part.
    """
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.option("compression", "zstd").option("maxRecordsPerFile", 0).partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``new_folder``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def in_order(df: DataFrame, name: str, *order: Column | str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with 0, 1, 2, ... in the given order, which must not leave ties; the sort keys aren't written.

    A task writes its range as one file, whose rows the reader numbers by their place in it.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep)
    rows = written(sorted_, new_folder(spark, "ordered"))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)-", 1).cast("int").alias("_p")
    counts = sorted((r["_p"], r["n"]) for r in rows.select(part).groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a file
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    first = spark.createDataFrame(offsets, "_p int, _o long")
    placed = rows.select(part, F.col("_metadata.row_index").alias("_l"), *keep)
    return placed.join(F.broadcast(first), "_p").select((F.col("_o") + F.col("_l")).alias(name), *keep)


def dealt_in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` materialised in range partitions, each sorted; equal keys may span partitions, so no key fills a task."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order))


def place_in_partition() -> tuple[Column, Column]:
    """(partition, place in it) of a row of a materialised table; only projections may lie between."""
    number = F.monotonically_increasing_id()
    return F.shiftright(number, 33).cast("int"), number.bitwiseAND(F.lit((1 << 33) - 1))


def numbered(dealt: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Adds 0, 1, 2, ... to what ``dealt_in_order`` gave, without another shuffle; and the number of rows."""
    partition, place = place_in_partition()
    counts = dict(dealt.select(partition.alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    first = dealt.sparkSession.createDataFrame(offsets, "_p int, _o long")
    rows = dealt.withColumns({"_p": partition, "_l": place}).join(F.broadcast(first), "_p")
    return rows.withColumn(name, F.col("_o") + F.col("_l")).drop("_p", "_o", "_l"), total


def dense_index(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds 0, 1, 2, ... in the given order, which must not leave ties."""
    return numbered(dealt_in_order(df, *order), name)[0]
