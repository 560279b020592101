"""Helpers shared by the corpus operators: lineage cuts, bounded text chunks, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.ordering import checkpoint_folder, cut  # noqa: F401

#: Characters that separate words in every contract of this subpackage: space and \t\n\v\f\r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table counts as small enough to broadcast.
BROADCAST_ROWS = 20_000
#: Text bytes that one NumPy step works on, so that memory does not follow the batch.
CHUNK_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Fewer rows an Arrow batch than Spark's default, unless the session has a number of its own: rows hold whole texts here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path for ``drop_table``: for wide rows that are read a few times and then in the way.

    As behind ``cut``, the shuffle files that the table was made from are dropped at once.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete what ``write_table`` wrote; nothing may read it afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``limit`` rows; ``df`` must be cheap to read (cut)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hashed(df: DataFrame) -> DataFrame:
    """The side of a join that has a row or a few for each key: each task holds its share in a hash table, and the many rows of the other side aren't sorted."""
    return df.hint("shuffle_hash")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` that hold about ``limit`` text bytes each (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            ends.append((start, i))
            start, total = i, 0
        total += n
    ends.append((start, len(sizes)))
    for a, b in ends:
        yield batch.slice(a, b - a)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column end to end, and each row's start (one more at the end); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
