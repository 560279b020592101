"""Suffix-array deduplication: repeated byte strings by distributed prefix doubling.

A byte goes when a ``length``-byte string over it also starts in a document with a smaller id.
Positions are ranked by the first ``first`` bytes that start there. Then, round by round, Spark
sorts pairs of a position's rank and the rank an offset on (as far as the rank reaches, at most what
is left to ``length``), and the pairs' numbers in that order are the ranks of the next round: 24, 48
and 50 bytes. A pair that one text has alone is final and leaves.

Three things keep the sorted rows few, and none loses a repeat. Equal texts are one text. And of
a text only the surroundings of positions are sorted whose first rank is the least in some
``length``-byte window: every repeat has such a position at the same place in each occurrence. If one
text has that rank alone, its windows are final at once; windows around the same position in equal
surroundings (a context) are ranked once, not once an occurrence. And a window reaches half of the bytes
that the first rank leaves beyond its position on one side at least: windows of which one text has
both sides alone are final too. Names that only decide what is final are dealt to buckets packed, not a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.ordering import dense_index
from graphmill.llm.common import cut, drop_table, hashed, joined_bytes, mix64, shuffle_partitions, small_batches, text_chunks, write_table

BASE = 0x9E3779B97F4A7C15
ONE = np.arange(1, 257, dtype=np.uint64)
BYTE_NAME = mix64(ONE)
#: Windows that one context holds at most; a bit each in a 64-bit answer.
MOST_WINDOWS = 62
#: Bits that a position in its context takes beside the context's number.
SHIFT = 7
#: Text bytes that one NumPy step ranks, so that its arrays stay in a core's cache.
STEP_BYTES = 128 << 10
#: Bytes from which a text is a batch of its own; other batches are 512 texts.
ALONE_BYTES = 32 << 10
#: Names that a task gathers before it deals them to buckets.
PACKED_NAMES = 1 << 20
PACKED = "bucket int, batch long, names binary, docs binary"


@dataclass(frozen=True)
class Params:
    length: int = 50
    first: int = 24

    def __post_init__(self) -> None:
        if not 0 < 2 * self.first < self.length or self.length + MOST_WINDOWS - 1 - self.first >= 1 << SHIFT:
            raise ValueError("the first rank must reach less than half of the length, and a context fit its positions")

    def offsets(self) -> list[int]:
        """How far on the second rank of each round's pairs starts."""
        size, out = self.first, []
        while size < self.length:
            out.append(min(size, self.length - size))
            size += out[-1]
        return out


def double_names(names: np.ndarray, length: int) -> np.ndarray:
    """Names of all ``length``-long strings along the last axis, by doubling from names of single bytes."""
    out, got, current, size = None, 0, names, 1
    while True:
        if length & size:
            if out is None:
                out, got = current, size
            else:
                m = names.shape[-1] - got - size + 1
                out = out[..., :m] * np.uint64(pow(BASE, size, 1 << 64)) + current[..., got : got + m]
                got += size
        if size * 2 > length:
            return out
        m = current.shape[-1] - size
        current = current[..., :m] * np.uint64(pow(BASE, size, 1 << 64)) + current[..., size : size + m]
        size *= 2


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    current, size = x, 1
    while size * 2 <= width:
        current = np.minimum(current[:-size], current[size:])
        size *= 2
    return np.minimum(current[: len(current) - (width - size)], current[width - size :]) if size < width else current


def segments(data: np.ndarray, starts: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least rank: (row, first window, windows, rank), windows within a row only."""
    n = len(data) - p.length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    ranks = mix64(double_names(BYTE_NAME[data], p.first))
    least = window_minimum(ranks, p.length - p.first + 1)[:n]
    breaks = np.zeros(n, dtype=bool)
    breaks[0] = True
    breaks[1:] = least[1:] != least[:-1]
    inner = starts[:-1]
    breaks[inner[inner < n]] = True
    first = np.flatnonzero(breaks)
    row = np.searchsorted(starts, first, side="right") - 1
    size = np.minimum(np.append(first[1:], n), starts[row + 1] - p.length + 1) - first
    keep = size > 0
    first, row, size = first[keep], row[keep], size[keep]
    if len(size) and size.max() > MOST_WINDOWS:  # long runs of one rank (periodic text) are cut; any cut is right
        parts = -(-size // MOST_WINDOWS)
        at = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, row, size = first[at] + k * MOST_WINDOWS, row[at], np.minimum(size[at] - k * MOST_WINDOWS, MOST_WINDOWS)
    return row, first, size, least[first]


def packed(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, batch, names, docs) of parts (batch, names, docs): a batch's distinct names of a bucket, each with its smallest and its largest document."""

    def rows(held: list) -> pa.RecordBatch:
        at = {k: i for i, k in enumerate(dict.fromkeys(k for k, _, _ in held))}
        batches, sizes = np.array([*at], np.int64), [len(x) for _, x, _ in held]
        names, docs = (np.concatenate([part[k] for part in held]) for k in (1, 2))
        cell = np.repeat(np.array([at[k] for k, _, _ in held], np.uint64), sizes) * np.uint64(buckets) + names % np.uint64(buckets)
        order = np.argsort((cell << np.uint64(36)) | (names >> np.uint64(28)))  # by cell; equal names lie together
        cell, names, docs = cell[order], names[order], docs[order]
        first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (cell[1:] != cell[:-1])))
        least, most = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
        times = 1 + (least < most)
        last = np.cumsum(times) - 1
        docs = np.repeat(least, times)
        docs[last] = most
        names, cell = np.repeat(names[first], times), np.repeat(cell[first], times)
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        offsets = pa.py_buffer((np.append(edges, len(cell)) * 8).astype(np.int32).tobytes())
        binary = [pa.Array.from_buffers(pa.binary(), len(edges), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (names, docs)]
        bucket, batch = (cell[edges] % np.uint64(buckets)).astype(np.int32), batches[(cell[edges] // np.uint64(buckets)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(batch), *binary], names=["bucket", "batch", "names", "docs"])

    held, n = [], 0
    for part in parts:
        if len(part[1]):
            held.append(part)
            n += len(part[1])
        if n >= PACKED_NAMES:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def unpacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def shared_names(rows: DataFrame) -> DataFrame:
    """(batch, names) of ``packed`` rows: those of a batch's names that two documents have. A bucket holds all rows of its names, a hot name has two numbers a batch."""

    def run(group: pa.Table) -> pa.Table:
        names, docs = unpacked(group.column("names"), np.uint64), unpacked(group.column("docs"), np.int64)
        order = np.argsort(names)
        ordered, docs = names[order], docs[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        shared = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        on = np.empty(len(names), bool)
        on[order] = np.repeat(shared, np.diff(first, append=len(names)))
        ends = np.cumsum([len(x) // 8 for x in group.column("names").to_pylist()])
        parts = [names[a:b][on[a:b]].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"batch": group.column("batch"), "names": pa.array(parts, pa.binary())}).filter(pa.array([len(x) > 0 for x in parts]))

    return rows.groupBy("bucket").applyInArrow(run, "batch long, names binary")


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each value of the column ``batch``."""
    column = batch.column(batch.schema.get_field_index("batch"))
    values = column.to_numpy()
    for value in dict.fromkeys(values.tolist()):
        yield value, batch.filter(pa.array(values == value))


def first_ranks(texts: DataFrame, p: Params) -> DataFrame:
    """The ranks of the positions of texts (key, doc_id, text, batch) that take part, ``packed``."""
    buckets = 2 * shuffle_partitions(texts.sparkSession)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for whole in batches:
            for value, batch in parts_of(whole):
                for part in text_chunks(batch, "text", STEP_BYTES):
                    row, _, _, rank = segments(*joined_bytes(part.column(1)), p)
                    yield value, rank, part.column(0).to_numpy()[row]

    return texts.select("doc_id", "text", "batch").mapInArrow(lambda batches: packed(ranks(batches), buckets), PACKED)


def string_names(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A name of each string (flat[offsets[i] : offsets[i + 1]]), from its bytes, their places and its length."""
    if len(offsets) < 2:
        return np.empty(0, np.uint64)
    span = np.diff(offsets)
    powers = np.ones(int(span.max(initial=1)), np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, BASE, np.uint64))
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], span)
    return mix64(np.add.reduceat(BYTE_NAME[flat] * powers[place], offsets[:-1]) + span.astype(np.uint64))


def contexts(texts: DataFrame, shared: DataFrame, p: Params) -> DataFrame:
    """(rank, ctx, windows, doc_id, key, start, context) of the positions whose rank is among the ``shared`` ones (batch, names) of the text's batch.

    ``context`` holds all bytes of the ``windows`` windows that the position stands for, ``ctx`` is a name of them.
    """
    names = ["rank", "ctx", "windows", "doc_id", "key", "start", "context"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, out = np.unique(unpacked(right.column("names"), np.uint64)), []
        for batch in left.select(["key", "doc_id", "text"]).combine_chunks().to_batches() if len(wanted) else []:
            for part in text_chunks(batch, "text", STEP_BYTES):
                data, starts = joined_bytes(part.column(2))
                row, first, size, rank = segments(data, starts, p)
                on = wanted[np.minimum(np.searchsorted(wanted, rank), len(wanted) - 1)] == rank
                row, first, size, rank = row[on], first[on], size[on], rank[on]
                span = size + p.length - 1
                offsets = np.concatenate([[0], np.cumsum(span)])
                flat = data[np.repeat(first - offsets[:-1], span) + np.arange(offsets[-1])]
                at = pa.array(row)
                context = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                columns = [pa.array(rank.view(np.int64)), pa.array(string_names(flat, offsets).view(np.int64)), pa.array(size.astype(np.int32)), part.column(1).take(at), part.column(0).take(at), pa.array((first - starts[row]).astype(np.int32)), context]
                out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        return pa.Table.from_batches(out, schema)

    return texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(run, "rank long, ctx long, windows int, doc_id long, key long, start int, context binary")


def squared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings of a column as rows of one array, zeros behind them, and their lengths."""
    data, offsets = joined_binary(column)
    span = np.diff(offsets)
    square = np.zeros((len(span), int(span.max())), np.uint8)
    row = np.repeat(np.arange(len(span)), span)
    square[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]] = data[offsets[0] : offsets[-1]]
    return square, span


def sides(rank: np.ndarray, ranks: np.ndarray, span: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, name, low, high) for each place in a context that has its rank, and each side of it.

    A window reaches ``half`` bytes beyond such a place on one side at least. ``name`` stands for the pair
    of the place's rank and the rank ``half`` bytes on (or back); windows low to high hold both.
    """
    half = -(-(p.length - p.first) // 2)
    row, at = np.nonzero((ranks == rank[:, None]) & (np.arange(ranks.shape[1])[None, :] <= (span - p.first)[:, None]))
    left, right = at >= half, at + half <= (span - p.first)[row]
    before = mix64(ranks[row[left], at[left] - half]) ^ rank[row[left]]
    after = mix64(ranks[row[right], at[right] + half] ^ np.uint64(BASE)) ^ rank[row[right]]
    row = np.concatenate([row[left], row[right]])
    low = np.concatenate([at[left] + p.first - p.length, at[right] + p.first + half - p.length])
    high = np.concatenate([at[left] - half, at[right]])
    low, high = np.maximum(low, 0), np.minimum(high, span[row] - p.length)
    keep = low <= high
    return row[keep], mix64(np.concatenate([before, after]))[keep], low[keep], high[keep]


def context_ranks(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """First ranks at all places of each context, and the contexts' lengths."""
    square, span = squared(column)
    return mix64(double_names(BYTE_NAME[square], p.first)), span


def side_names(open_: DataFrame, p: Params) -> DataFrame:
    """The names of the ``sides`` of contexts (rank, context, least, batch), ``packed``."""
    buckets = 2 * shuffle_partitions(open_.sparkSession)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for whole in batches:
            for value, batch in parts_of(whole):
                ranks, span = context_ranks(batch.column(1), p)
                row, name, _, _ = sides(batch.column(0).to_numpy().view(np.uint64), ranks, span, p)
                yield value, name, batch.column(2).to_numpy()[row]

    return open_.select("rank", "context", "least", "batch").mapInArrow(lambda batches: packed(named(batches), buckets), PACKED)


def open_windows(open_: DataFrame, shared: DataFrame, p: Params) -> DataFrame:
    """(cid, context, least, open): the contexts that have a side in ``shared`` (batch, names), and a bit for each window that holds such a side; the others are final."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, out = left.select(["cid", "context", "least", "rank"]).combine_chunks(), []
        wanted = np.unique(unpacked(right.column("names"), np.uint64))
        schema = pa.schema([("cid", pa.int64()), ("context", pa.binary()), ("least", pa.int64()), ("open", pa.int64())])
        for part in left.to_batches(max_chunksize=1024) if len(wanted) else []:
            ranks, span = context_ranks(part.column(1), p)
            row, name, low, high = sides(part.column(3).to_numpy().view(np.uint64), ranks, span, p)
            on = wanted[np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)] == name
            bits = np.zeros(part.num_rows, np.int64)
            np.bitwise_or.at(bits, row[on], (np.int64(1) << (high[on] + 1)) - (np.int64(1) << low[on]))
            some = np.flatnonzero(bits)
            out.append(pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(some)) for k in range(3)), pa.array(bits[some])], schema=schema))
        return pa.Table.from_batches(out, schema)

    return open_.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(run, "cid long, context binary, least long, open long")


def first_pairs(open_: DataFrame, p: Params) -> DataFrame:
    """(place, a, b, least) of every position that an open window of a context needs: its first rank and the first rank an offset on; ``place`` is the context's number and the position."""
    offset, *later = p.offsets()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ranks, _ = context_ranks(part.column(1), p)
                on = np.zeros(ranks.shape, bool)
                width = min(MOST_WINDOWS, ranks.shape[1])
                on[:, :width] = (part.column(3).to_numpy()[:, None] >> np.arange(width)[None, :]) & 1
                for x in later:
                    on[:, x:] |= on[:, :-x].copy()
                row, start = np.nonzero(on)
                pair = [pa.array(ranks[row, start + k].view(np.int64)) for k in (0, offset)]
                place = (part.column(0).to_numpy()[row] << SHIFT) + start
                yield pa.RecordBatch.from_arrays([pa.array(place), *pair, part.column(2).take(pa.array(row))], names=["place", "a", "b", "least"])

    return open_.select("cid", "context", "least", "open").mapInArrow(run, "place long, a long, b long, least long")


def next_pairs(ranked: DataFrame, offset: int) -> DataFrame:
    """(place, a, b, least) of the positions (place, rank, least) that have a rank ``offset`` bytes on in their context too."""
    on = F.col("place").bitwiseAND(F.lit((1 << SHIFT) - 1)) >= offset
    return ranked.join(ranked.where(on).select((F.col("place") - offset).alias("place"), F.col("rank").alias("b")), "place").select("place", F.col("rank").alias("a"), "b", "least")


def shared_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, first) of the pairs that two texts have, ``first`` the smallest document; the others are final and leave."""
    return pairs.groupBy("a", "b").agg(F.min("least").alias("first"), F.max("least").alias("most")).where("first < most").select("a", "b", "first")


def joined_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def doubled(open_: DataFrame, p: Params) -> DataFrame:
    """(cid, better): the windows (start, first) of a context that another has in a document smaller than its own least.

    ``open_``: a row for each context of a rank that has several (cid, rank, context, least).
    """
    spark = open_.sparkSession
    batched, batched_path = write_table(open_.withColumn("batch", F.shiftright(F.monotonically_increasing_id(), 13)))
    shared = shared_names(side_names(batched, p))
    table, path = write_table(open_windows(batched, shared, p))
    drop_table(spark, batched_path)
    pairs = first_pairs(table, p)
    for offset in p.offsets()[1:]:
        ranks = dense_index(cut(shared_pairs(pairs)), "rank", "a", "b").select("a", "b", "rank")
        old = path
        ranked, path = write_table(pairs.join(hashed(ranks), ["a", "b"]).select("place", "rank", "least"))
        drop_table(spark, old)
        pairs = next_pairs(ranked, offset)
    final, final_path = write_table(pairs)
    drop_table(spark, path)
    found = final.join(hashed(shared_pairs(final)), ["a", "b"]).where("first < least").select("place", "first")
    start = F.col("place").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")
    better = cut(found.groupBy(F.shiftright("place", SHIFT).alias("cid")).agg(F.collect_list(F.struct(start.alias("start"), "first")).alias("better")))
    drop_table(spark, final_path)
    return better


def removed_runs(starts: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the marked windows."""
    row, k = np.nonzero((windows[:, None] >> np.arange(MOST_WINDOWS)[None, :]) & 1)
    at = starts[row] + k
    at.sort()
    if not len(at):
        return []
    first = np.flatnonzero(np.append(True, at[1:] > at[:-1] + length))
    last = np.append(first[1:] - 1, len(at) - 1)
    return list(zip(at[first].tolist(), (at[last] + length).tolist(), strict=True))


def answered(texts: DataFrame, p: Params) -> DataFrame:
    """(key, doc_id, answers) of distinct texts (key, doc_id, text) that lose something: starts, and a bit for each window after it."""
    mine, spark = ["key", "doc_id"], texts.sparkSession
    number = F.monotonically_increasing_id()
    batch = F.when(F.octet_length("text") > ALONE_BYTES, number * 2 + 1).otherwise(F.shiftright(number, 9) * 2)  # a long text is a batch of its own
    texts, texts_path = write_table(texts.withColumn("batch", batch))
    shared = cut(shared_names(first_ranks(texts, p)))
    found, found_path = write_table(contexts(texts, shared, p))
    drop_table(spark, texts_path)
    grouped = found.groupBy("rank", "ctx", "context").agg(F.min("doc_id").alias("least"))
    distinct, path = write_table(grouped.withColumn("cid", F.monotonically_increasing_id()))
    several = cut(distinct.groupBy("rank").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rank"))
    better = doubled(distinct.join(hashed(several), "rank", "left_semi"), p)
    known = cut(distinct.select("rank", "ctx", "least", "cid").join(hashed(better), "cid", "left").drop("cid"))
    drop_table(spark, path)
    one = F.lit(1).cast("long")
    all_ = F.call_function("shiftleft", one, F.col("windows")) - one
    some = F.aggregate(F.coalesce("better", F.array().cast("array<struct<start: int, first: bigint>>")), F.lit(0).cast("long"), lambda bits, x: F.when(x["first"] < F.col("doc_id"), bits.bitwiseOR(F.call_function("shiftleft", one, x["start"]))).otherwise(bits))
    marked = found.drop("context").join(hashed(known), ["rank", "ctx"]).select(*mine, "start", F.when(F.col("least") < F.col("doc_id"), all_).otherwise(some).alias("windows")).where("windows <> 0")
    answers = cut(marked.groupBy(*mine).agg(F.collect_list(F.struct("start", "windows")).alias("answers")))
    drop_table(spark, found_path)
    return answers


def remove_repeats(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (binary), spans (removed byte runs), and the columns in ``keep`` (as kept_...), a row for each row.

    With ``characters`` ``kept`` is a string, without the characters that a run cuts in two.

    Null text is empty; texts shorter than ``length`` bytes lose nothing; rows that repeat an id are
    one document to the rule (nothing is removed for the sake of an equal id), each with its own
    result; a null id neither loses nor makes others lose. Copies keep only the smallest id's text.
    An empty table gives no rows. A very long text is held whole by its task.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, check = F.xxhash64("text"), F.xxhash64(F.lit("check"), "text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep]).withColumn("key", key)
    names = rows.where("doc_id is not null").select("doc_id", "key", check.alias("check"), F.octet_length("text").alias("bytes")).where(F.col("bytes") >= p.length)
    same = ["key", "check", "bytes"]
    firsts = cut(names.groupBy(*same).agg(F.min("doc_id").alias("first")))
    own = names.select("doc_id", *same).distinct()
    texts = rows.select("doc_id", "key", "text").join(hashed(firsts.select(F.col("first").alias("doc_id"), "key")), ["doc_id", "key"], "left_semi").select("key", "doc_id", "text")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).cast("long").alias("windows")))  # no window bit: a copy goes whole
    copies = own.join(hashed(firsts), same).where("first < doc_id").select("key", "doc_id", whole.alias("answers"))
    final = rows.join(hashed(answered(texts, p).unionByName(copies)), ["key", "doc_id"], "left")
    columns = [f.name for f in final.schema if f.name not in ("key", "text", "answers")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = {n: i for i, n in enumerate(batch.schema.names)}
            texts_, lists = batch.column(place["text"]), batch.column(place["answers"])
            sizes, kept, spans = [], [], []
            ends, held = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].tolist(), lists.is_valid().to_pylist()
            starts, windows = (lists.values.field(n).to_numpy().astype(np.int64) for n in ("start", "windows"))
            for i, data in enumerate(texts_.cast(pa.binary()).to_pylist()):
                runs, mine = [], slice(ends[i], ends[i + 1])
                if held[i]:
                    runs = removed_runs(starts[mine], windows[mine], p.length) if windows[mine].any() else [(0, len(data))]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(data)]
                parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept.append("".join(part.decode("utf-8", "ignore") for part in parts) if characters else b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(place[n]) for n in columns), pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if characters else pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*columns, "n_bytes", "kept", "spans"],
            )

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in final.schema if f.name in columns)
    return final.mapInArrow(run, f"{head}, n_bytes long, kept {'string' if characters else 'binary'}, spans array<struct<start: long, end: long>>")


def clean_documents(docs: DataFrame, p: Params = Params(), columns: tuple = ("doc_id", "lang", "source", "n_chars")) -> DataFrame:
    """The documents without their repeats, same columns; a character cut in two goes whole, n_chars follows the text.

    Nulls, repeated rows and an empty table as in ``remove_repeats``; a null text becomes an empty one.
    """
    others = tuple(c for c in columns if c != "text")
    done = remove_repeats(docs, p, keep=others, characters=True)
    out = {c: F.col(f"kept_{c}") for c in others} | {"text": F.col("kept")}
    rows = done.select(*[out[c].alias(c) for c in docs.columns if c in out])
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
