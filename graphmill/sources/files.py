"""Graph files: ``.npy`` arrays as a data source, and tables for adjacency, colors and affinities.

``.npy`` files are read and written with plain file calls, so their folder must be mounted on every
executor; tables go through Spark's own writers and may be anywhere.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a ``.npy`` file that one task reads or one part holds, and of one Arrow batch.
BYTES_A_TASK, BYTES_A_BATCH = 32 << 20, 4 << 20
#: Ranges of target nodes that a CSC graph is partitioned by at most, and nodes of one at least.
BLOCKS, BLOCK_NODES = 256, 1024
TYPES = {"i": ("long", np.int64), "u": ("long", np.int64), "f": ("double", np.float64)}


def mounted(path: str) -> str:
    """The plain path of a local or mounted folder; other schemes raise ValueError."""
    scheme = re.match(r"([a-z0-9+.-]+):", path)
    if scheme and scheme[1] != "file":
        raise ValueError(f".npy files need a folder that is mounted on every executor, not {path}")
    return re.sub(r"^file:/*", "/", path)


def read_header(path: str) -> tuple[tuple, np.dtype, int]:
    """(shape, type, offset of the data) of a ``.npy`` file of version 1 or 2; Fortran order and other versions raise ValueError."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"{path}: version {version} isn't read")
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or kind.kind not in TYPES:
            raise ValueError(f"{path}: only rows of numbers in C order are read")
        return shape, kind, f.tell()


def parts_of(path: str) -> list[tuple[str, int]]:
    """(file, number of its first row): a file, or a folder of parts named by their first row."""
    if not os.path.isdir(path):
        return [(path, 0)]
    return sorted((os.path.join(path, n), int(n[5:-4])) for n in os.listdir(path) if re.fullmatch(r"part-\d+\.npy", n))


class Slice(InputPartition):
    def __init__(self, path: str, base: int, first: int, last: int):
        self.path, self.base, self.first, self.last = path, base, first, last


def rows_a_part(bytes_a_row: int, bytes_a_part: int) -> int:
    return max(1, bytes_a_part // max(1, bytes_a_row))


class NpyReader(DataSourceReader):
    """Slices of bounded bytes; filters on ``row`` leave out the slices that hold no wanted row."""

    def __init__(self, path: str, across: bool, bytes_a_task: int):
        self.path, self.across, self.bytes, self.least, self.most = path, across, bytes_a_task, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ``row`` are kept; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    most = f.value - isinstance(f, LessThan)
                    self.most = most if self.most is None else min(self.most, most)
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, base in parts_of(self.path):
            shape, kind, _ = read_header(path)
            n, width = (shape[1], shape[0]) if self.across else (shape[0], int(np.prod(shape[1:])))
            step = rows_a_part(width * kind.itemsize, self.bytes)
            first, last = max(0, self.least - base), n if self.most is None else min(n, self.most - base + 1)
            out += [Slice(path, base, a, min(last, a + step)) for a in range(first, last, step)]
        return out or [Slice("", 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        shape, kind, offset = read_header(part.path)
        whole = np.memmap(part.path, kind, "r", offset, shape)
        step = max(1, BYTES_A_BATCH // max(8, 8 * (shape[0] if self.across else int(np.prod(shape[1:])))))
        for a in range(part.first, part.last, step):
            b = min(part.last, a + step)
            some = np.ascontiguousarray(whole[:, a:b].T if self.across else whole[a:b]).reshape(b - a, -1).astype(TYPES[kind.kind][1])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.base + a + np.arange(len(some))), values], names=["row", "values"])


class NpySource(DataSource):
    """``spark.read.format("npy").option("path", ...)``: row, values; with option ``across`` columns are rows, as in a [2, E] edge list; ``bytes`` bounds what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        path = mounted(self.options["path"])
        parts = parts_of(path)
        kind = TYPES[read_header(parts[0][0])[1].kind][0] if parts else "double"
        return f"row long, values array<{kind}>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(mounted(self.options["path"]), self.options.get("across", "false").lower() == "true", int(self.options.get("bytes", BYTES_A_TASK)))


def read_npy(spark: SparkSession, path: str, across: bool = False, bytes_a_task: int = BYTES_A_TASK) -> DataFrame:
    """(row, values); filters on ``row`` reach the source."""
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it Spark refuses sources that take filters
    return spark.read.format("npy").option("path", path).option("across", str(across)).option("bytes", str(bytes_a_task)).load()


def write_npy(rows: DataFrame, path: str, kind: str, across: bool = False, bytes_a_part: int = BYTES_A_TASK) -> int:
    """Writes (row, values), rows numbered 0, 1, 2, ..., as parts named by their first row; returns the number of rows.

    Parts are ranges of rows of at most ``bytes_a_part`` bytes. A task writes one part as its sorted
    rows come, a batch at a time, so that no part is held in Python; it is written under another name
    and then renamed, so a task may run twice. With ``across`` a part has a column for each row.
    Numbers with a gap, or rows that differ in length, raise ValueError.
    """
    folder, first = mounted(path), rows.agg(F.first(F.size("values")).alias("n"), F.max("row").alias("last")).first()
    width, total, kind_ = first.n or 0, 0 if first.last is None else first.last + 1, np.dtype(kind)
    per = rows_a_part((width or 1) * kind_.itemsize, bytes_a_part)
    os.makedirs(folder, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, part, start, at, n = None, 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, values = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if f is None:
                part = int(row[0]) // per
                n, name = min(per, total - part * per), os.path.join(folder, f"part-{part * per:015d}.npy")
                f = open(f"{name}.{os.getpid()}", "wb")  # noqa: SIM115
                np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind_), "fortran_order": False, "shape": (width, n) if across else (n, width)})
                start = f.tell()
            if len(values) != len(row) * width or not np.array_equal(row, part * per + at + np.arange(len(row))):
                raise ValueError(f"rows must be numbered without gaps and hold {width} values each")
            data = values.reshape(len(row), width).astype(kind_, copy=False)
            if across:
                for k in range(width):
                    f.seek(start + (k * n + at) * kind_.itemsize)
                    f.write(np.ascontiguousarray(data[:, k]).data)
            else:
                f.write(np.ascontiguousarray(data).data)
            at += len(row)
        if f is not None:
            f.close()
            if at != n:
                raise ValueError(f"rows {part * per + at} to {part * per + n - 1} are missing")
            os.replace(f.name, name)
            yield pa.RecordBatch.from_pydict({"n": [at]})

    dealt = rows.select("row", "values", F.floor(F.col("row") / per).cast("int").alias("part")).repartitionById(max(1, -(-total // per)), "part")
    return dealt.sortWithinPartitions("row").select("row", "values").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def edges_of(rows: DataFrame) -> DataFrame:
    """edge_id, src, dst of the rows of an edge list."""
    return rows.select(F.col("row").alias("edge_id"), F.col("values")[0].cast("long").alias("src"), F.col("values")[1].cast("long").alias("dst"))


def write_csc(adjacency: DataFrame, indptr: DataFrame, path: str, blocks: int = BLOCKS, least: int = BLOCK_NODES) -> None:
    """The three arrays of a CSC graph as two tables: ``indptr`` (node_id, first, last) and ``indices`` (at, src, edge_id, dst).

    Both are partitioned by ``block``, a range of target nodes, and in order within it, so that a
    reader opens the blocks of its nodes only; a hub's block has several files. ``meta`` holds the
    nodes of a block.
    """
    spark = indptr.sparkSession
    width = max(least, -(-((indptr.agg(F.max("node_id")).first()[0] or 0) + 1) // blocks))
    block = lambda c: F.floor(F.col(c) / width).cast("int").alias("block")
    indptr.select("node_id", "first", "last", block("node_id")).repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("overwrite").partitionBy("block").parquet(f"{path}/indptr")
    placed = adjacency.join(indptr.select(F.col("node_id").alias("dst"), "first"), "dst").select((F.col("first") + F.col("pos")).alias("at"), "src", "edge_id", "dst", block("dst"))
    placed.repartitionByRange("dst", "at").sortWithinPartitions("dst", "at").write.mode("overwrite").partitionBy("block").parquet(f"{path}/indices")
    spark.createDataFrame([(width,)], "width long").write.mode("overwrite").parquet(f"{path}/meta")


def read_csc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(indptr, indices) as written; ``dst`` is kept beside each index, so that edges need no range join."""
    return spark.read.parquet(f"{path}/indptr"), spark.read.parquet(f"{path}/indices")


def blocks_of(spark: SparkSession, path: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indptr, indices) of the blocks that hold some nodes (node_id); other blocks aren't opened."""
    width = spark.read.parquet(f"{path}/meta").first().width
    numbers = nodes.select(F.floor(F.col("node_id") / width).cast("int").alias("block")).distinct()
    held = [r.block for r in numbers.collect()]  # at most BLOCKS numbers
    return tuple(t.where(F.col("block").isin(held)) for t in read_csc(spark, path))


def in_edges(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """edge_id, src, dst, pos of the in-edges of some nodes (node_id), from the blocks that hold them; an index outside its node's range of ``indptr`` raises."""
    asked = nodes.select("node_id").distinct()
    indptr, indices = blocks_of(spark, path, asked)
    found = indices.join(indptr.drop("block").join(asked, "node_id").withColumnRenamed("node_id", "dst"), "dst")
    right = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last"))
    pos = F.when(right, F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("an index lies outside its node's range")).cast("long"))
    return found.select("edge_id", "src", "dst", pos.alias("pos"))


def write_colors(colors: DataFrame, nodes: DataFrame, matrix: DataFrame, path: str) -> None:
    """``color`` (node_id, color; 0 for none), ``topk`` (color, neighbors) and ``score`` (color, scores) tables."""
    nodes.select("node_id").join(colors.select("node_id", "color"), "node_id", "left").fillna(0, ["color"]).write.mode("overwrite").parquet(f"{path}/color")
    matrix.select("color", "neighbors").write.mode("overwrite").parquet(f"{path}/topk")
    matrix.select("color", "scores").write.mode("overwrite").parquet(f"{path}/score")


def read_colors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("color", "topk", "score"))


def read_node_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct node ids of text lines of numbers between blanks; other words raise as they are cast."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("w <> ''")
    return words.select(F.col("w").cast("long").alias("node_id")).distinct()
