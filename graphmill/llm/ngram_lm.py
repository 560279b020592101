"""Interpolated modified Kneser-Ney language model: n-grams counted in Spark, kept as sorted hash arrays, scored from memory maps.

Words are numbered by the rank of their hash. N-grams of numbers are counted where the texts are,
sent to the shard of their context and merged there; a shard writes its counts and the statistics of
its contexts as one file a table, and passes on how many different words stand before each shorter
n-gram, which is what the next order counts. A context of frequent words alone ("hot") would fill a
shard, so its n-grams are spread by their last word and its statistics summed by Spark afterwards.

The files lie in a folder that driver and executors share; scoring tasks map them, so that pages
are shared between workers and nothing of the model's size passes through a closure or the driver.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import checkpoint_folder, cut, drop_table, mix64, small_batches, text_chunks, write_table
from graphmill.llm.shingles import word_hashes

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hash of the end of a text; no word has the bytes that it is made of.
END = np.uint64(0xD1B54A32D192ED03)
#: Text bytes that one NumPy step works on, and n-grams counted together before they are sent.
CHUNK, BUFFER = 3 << 20, 1 << 20
#: A word is hot from an eighth of a shard's tokens.
HOT_SHARE = 8
#: Entries of a hash bucket, about.
BUCKET = 6
#: Discounts where the counts of counts give none (too small a corpus).
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)


@dataclass(frozen=True)
class Params:
    order: int = 3
    shard_tokens: int = 2 << 20


@dataclass(frozen=True)
class Model:
    """Where the tables lie, and what every worker needs to read them: shards (2 ** bits), word numbers by shard, hot words, discounts by order."""

    folder: str
    order: int
    bits: int
    tokens: int
    words: int
    starts: np.ndarray
    hot: np.ndarray
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)

    @property
    def kind(self) -> type:
        """Holds word numbers and counts."""
        return np.uint32 if self.tokens + 2 < 1 << 32 else np.uint64

    def path(self, table: str, shard: int) -> str:
        return f"{self.folder}/{table}-{shard}"

    def drop(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def shared_path(folder: str) -> str:
    """The folder as a path: tables are mapped, so every machine must have it mounted."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped tables need a mounted folder, not {folder!r}")
    return unquote(url.path)


# Tables: one file of a few arrays, in place at once or not at all.


def save_arrays(path: str, arrays: list[np.ndarray]) -> None:
    head = json.dumps([(a.dtype.str, a.shape) for a in arrays]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            f.write(data + bytes(-len(data) % 8))
    os.replace(part, path)  # a task that runs again writes the same table


MAPPED: dict[str, list[np.ndarray]] = {}


def mapped_arrays(path: str) -> list[np.ndarray] | None:
    """The arrays of a table, mapped once a worker; None where the shard is empty."""
    if path not in MAPPED:
        if len(MAPPED) > 60_000 or (MAPPED and os.path.dirname(next(iter(MAPPED))) != os.path.dirname(path)):
            MAPPED.clear()  # maps of a model that is dropped would keep its disk
        if not os.path.exists(path):
            return None
        whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
        size = int(whole[:8].view(np.int64)[0])
        at, out = 8 + size, []
        for kind, shape in json.loads(whole[8:at].tobytes()):
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            out.append(whole[at : at + n].view(kind).reshape(shape))
            at += n + -n % 8
        MAPPED[path] = out
    return MAPPED[path]


def coded(values: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, and each row's number in the narrowest type: counts are few and small, so most rows are numbered by their digits without sorting."""
    rows = values.reshape(len(values), -1)
    base = int(round(65536 ** (1 / rows.shape[1])))
    digits = base ** np.arange(rows.shape[1])
    small = (rows < base).all(1)
    code = rows[small] @ digits
    used = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else np.empty(0, np.int64)
    place = np.zeros(int(used.max(initial=0)) + 1, np.int64)
    place[used] = np.arange(len(used))
    rest, back = np.unique(rows[~small], axis=0, return_inverse=True)
    at = np.empty(len(rows), np.int64)
    at[small], at[~small] = place[code], len(used) + back.reshape(-1)
    table = np.concatenate([used[:, None] // digits % base, rest])
    return [table.reshape(-1, *values.shape[1:]), at.astype(np.min_scalar_type(max(len(table) - 1, 0)))]


def hash_index(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes as bucket starts and 32 bits each; with the bucket and the shard some 50 bits are compared."""
    bits = max(0, (len(keys) // BUCKET).bit_length() - 1)
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    starts = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    return [starts, ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)]


def find(index: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's place, or -1: a binary search within its bucket, all keys at once."""
    starts, short = index
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    mine = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    kind = np.int32 if len(short) < 1 << 30 else np.int64
    low, end = starts[bucket].astype(kind), starts[bucket + 1].astype(kind)
    high, last = end.copy(), len(short) - 1
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (short[np.minimum(middle, last)] < mine)
        high = np.where((low < high) & ~less, middle, high)
        low = np.where(less, middle + 1, low)
    hit = low < end
    hit[hit] = short[low[hit]] == mine[hit]
    return np.where(hit, low, -1)


def save_table(path: str, keys: np.ndarray, values: np.ndarray) -> None:
    """A table from hashes to values (a number or a row of numbers each)."""
    keys = mix64(keys)
    order = np.argsort(keys)
    save_arrays(path, hash_index(keys[order]) + coded(values[order]))


def read_table(model: Model, table: str, shards: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Values of the keys, rows of ``width`` numbers; zeros where a key is unknown."""
    out = np.zeros((len(keys), width), np.int64)
    shards = shards.astype(np.uint16) if model.bits <= 16 else shards  # narrow numbers are sorted by digits
    order = np.argsort(shards, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(shards[order]) != 0))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        if a < b and (arrays := mapped_arrays(model.path(table, int(shards[order[a]])))) is not None:
            mine = order[a:b]
            place = find(arrays[:2], mix64(keys[mine]))
            known = place >= 0
            out[mine[known]] = arrays[2].reshape(-1, width)[arrays[3][place[known]]]
    return out


# Words.


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) with an end after each text, and each text's start (one more at the end)."""
    words, rows = word_hashes(text)
    return np.insert(words, rows[1:], END), rows + np.arange(len(rows))


def top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def numbered(model: Model, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ascending hashes (``words`` + 1 if unknown; ``words`` stands before every text) and their counts (0 if unknown)."""
    number, count = np.full(len(distinct), model.words + 1, np.int64), np.zeros(len(distinct), np.int64)
    shards = top(distinct, model.bits)
    edges = np.searchsorted(shards, np.arange((1 << model.bits) + 1))
    for shard in np.unique(shards).tolist():
        if (arrays := mapped_arrays(model.path("words", shard))) is not None:
            mine = slice(edges[shard], edges[shard + 1])
            place = np.searchsorted(arrays[0], distinct[mine])
            known = (place < len(arrays[0])) & (arrays[0][np.minimum(place, len(arrays[0]) - 1)] == distinct[mine])
            number[mine] = np.where(known, model.starts[shard] + place, model.words + 1)
            count[mine] = np.where(known, arrays[1][np.minimum(place, len(arrays[0]) - 1)], 0)
    return number, count


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) of the words and ends of all texts, added up in each task before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, n = added(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                kept.append(np.unique(tokens_of(part.column(0))[0], return_counts=True))
                if sum(len(k) for k, _ in kept) > BUFFER:
                    yield flush()
        if kept:
            yield flush()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each shard, from batches ordered by their first column."""
    at, kept = None, []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))[: len(shards)]
        for a, b in zip(edges, np.append(edges[1:], len(shards)), strict=True):
            if at is not None and shards[a] != at:
                yield at, kept
                kept = []
            at = int(shards[a])
            kept.append(batch.slice(a, b - a))
    if at is not None:
        yield at, kept


def to_shards(rows: DataFrame, bits: int) -> DataFrame:
    """The rows of a shard in one task, shard by shard."""
    return rows.repartition(1 << bits, "shard").sortWithinPartitions("shard")


def write_words(counts: DataFrame, model: Model) -> Model:
    """The table of words: hashes ascending and counts; numbers follow from the shards' sizes."""
    least = model.tokens / (HOT_SHARE << model.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in by_shard(batches):
            hashes = np.concatenate([p.column(1).to_numpy() for p in parts]).view(np.uint64)
            n = np.concatenate([p.column(2).to_numpy() for p in parts])
            order = np.argsort(hashes)
            save_arrays(model.path("words", shard), [hashes[order], n[order]])
            hot = pa.array([np.flatnonzero(n[order] > least).tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(n)], pa.int64()), hot], names=["shard", "n", "hot"])

    shard = F.shiftrightunsigned("hash", 64 - model.bits) if model.bits else F.lit(0)
    done = to_shards(counts.select(shard.cast("int").alias("shard"), "hash", "n"), model.bits).mapInArrow(run, "shard int, n long, hot array<long>").collect()  # a row a shard; of hot words there are at most HOT_SHARE a shard
    sizes = np.zeros(1 << model.bits, np.int64)
    for r in done:
        sizes[r.shard] = r.n
    starts = np.cumsum(sizes) - sizes
    hot = [int(starts[r.shard]) + k for r in done for k in r.hot]
    return replace(model, starts=starts, hot=np.array(sorted([*hot, model.words]), np.int64))


# N-grams.


def chained(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(key * BASE + words.astype(np.uint64) + np.uint64(1))


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]) if columns else 0, np.uint64)
    for words in columns:
        key = chained(key, words)
    return key


def context_keys(columns: list[np.ndarray]) -> np.ndarray:
    return keys_of(columns[:-1]) if len(columns) > 1 else np.zeros(len(columns[0]), np.uint64)


def among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether each number is one of a few, which ascend."""
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def hot_contexts(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """Whether a context holds hot words alone, as the empty one does."""
    on = np.ones(len(columns[0]), bool)
    for words in columns[:-1]:
        on &= among(words, model.hot)
    return on


def shards_of(model: Model, context: np.ndarray, key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return top(np.where(hot, key, context), model.bits)


def packed(columns: list[np.ndarray], kind: type) -> bytes:
    """Columns of numbers byte by byte, the first one (ascending) as differences."""
    rows = np.stack([np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]).astype(kind)
    planes = rows.view(np.uint8).reshape(len(columns), -1, rows.itemsize).transpose(0, 2, 1)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(blob: bytes, count: int, kind: type) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(count, size, -1)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind)[:, :, 0].astype(np.int64)
    rows[0] = np.cumsum(rows[0])
    return list(rows)


def merged_grams(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams and their sums."""
    key = keys_of(columns)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(key) else n


def shard_blobs(model: Model, columns: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) of distinct n-grams with their numbers."""
    if not len(n):
        return
    context = context_keys(columns)
    hot = hot_contexts(model, columns)
    shards = shards_of(model, context, chained(context, columns[-1]), hot)
    order = np.argsort((shards << np.int64(40)) + columns[0], kind="stable")  # shards and word numbers have less than 2^23 and 2^40 values
    columns, n, shards = [c[order] for c in columns], n[order], shards[order]
    edges = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(shards)), strict=True):
        yield int(shards[a]), packed([*(c[a:b] for c in columns), n[a:b]], model.kind)


@dataclass(frozen=True)
class Tokens:
    """Texts with ``order`` - 1 starts before each: ``codes`` are places in ``words`` (numbers, the start last) and ``counts``; ``place`` holds the tokens' places in ``codes``."""

    words: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    place: np.ndarray


def padded(model: Model, hashes: np.ndarray, starts: np.ndarray) -> Tokens:
    distinct, back = np.unique(hashes, return_inverse=True)
    number, count = numbered(model, distinct)
    before = model.order - 1
    place = np.arange(len(hashes)) + before * (np.repeat(np.arange(len(starts) - 1), np.diff(starts)) + 1)
    codes = np.full(len(hashes) + before * (len(starts) - 1), len(distinct), np.int32)
    codes[place] = back
    return Tokens(np.append(number, model.words), np.append(count, 0), codes, place)


def text_grams(docs: DataFrame, model: Model) -> DataFrame:
    """(shard, blob): the n-grams of the highest order, counted in each task before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[list[np.ndarray], np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([c[k] for c, _ in kept]) for k in range(model.order)]
            rows = list(shard_blobs(model, *merged_grams(columns, np.concatenate([n for _, n in kept]))))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])

        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                hashes, starts = tokens_of(part.column(0))
                x = padded(model, hashes, starts)
                whole = x.words[x.codes]
                kept.append(([whole[x.place - k] for k in range(model.order - 1, -1, -1)], np.ones(len(x.place), np.int64)))
                if sum(len(n) for _, n in kept) > BUFFER:
                    yield flush()
        if kept:
            yield flush()

    return docs.select("text").mapInArrow(run, "shard int, blob binary")


def statistics(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts, and of the counts behind each: their sum, how many are one, two, and more."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    if not len(keys):
        return keys, np.zeros((0, 4), np.int64)
    return keys[first], np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n >= 3)], 1)


MERGED = "kind string, shard int, blob binary, key long, a long, b long, c long, d long"


def merge_order(grams: DataFrame, model: Model, order: int) -> DataFrame:
    """Writes the tables of one order; rows: blobs of the next lower one, statistics of hot contexts, counts of counts (one to four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("blob", pa.binary()), ("key", pa.int64()), *[(c, pa.int64()) for c in "abcd"]])
        for shard, parts in by_shard(batches):
            lists = [unpacked(b.as_py(), order + 1, model.kind) for p in parts for b in p.column(1)]
            columns, n = merged_grams([np.concatenate([x[k] for x in lists]) for k in range(order)], np.concatenate([x[order] for x in lists]))
            del lists
            context, hot = context_keys(columns), hot_contexts(model, columns)
            save_table(model.path(f"grams{order}", shard), chained(context, columns[-1]), n)
            if not hot.all():
                save_table(model.path(f"contexts{order}", shard), *statistics(context[~hot], n[~hot]))
            keys, stats = statistics(context[hot], n[hot])
            rows = [("counts", 0, None, 0, *[int((n == k).sum()) for k in (1, 2, 3, 4)])]
            rows += [("hot", int(s), None, int(k), *x) for k, s, x in zip(keys.view(np.int64), top(keys, model.bits), stats.tolist(), strict=True)]
            if order > 1:
                from_start = columns[1] == model.words if order > 2 else np.zeros(len(n), bool)  # nothing stands before a text's start, so its own counts count
                rows += [("next", s, b, 0, 0, 0, 0, 0) for s, b in shard_blobs(model, *merged_grams(columns[1:], np.where(from_start, n, 1)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return to_shards(grams.select("shard", "blob"), model.bits).mapInArrow(run, MERGED)


def write_hot(rows: DataFrame, model: Model, order: int) -> None:
    """The table of hot contexts' statistics, summed over the shards that hold a part of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in by_shard(batches):
            keys = np.concatenate([p.column(1).to_numpy() for p in parts]).view(np.uint64)
            save_table(model.path(f"hot{order}", shard), keys, np.stack([np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(2, 6)], 1))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    sums = rows.groupBy("shard", "key").agg(*[F.sum(c).alias(c) for c in "abcd"])
    to_shards(sums.select("shard", "key", *"abcd"), model.bits).mapInArrow(run, "shard int").agg(F.count(F.lit(1))).collect()


def discounts(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and more, from how often the counts one to four occur."""
    if min(n) <= 0:
        return PLAIN_DISCOUNTS
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return d if all(0 < x < k for k, x in enumerate(d, 1)) else PLAIN_DISCOUNTS


def train(docs: DataFrame, p: Params = Params(), text_col: str = "text") -> Model:
    """The model of all texts. Null and empty texts are an end alone; repeated rows count each; a table without rows gives a model that knows no word.

    The vocabulary is counted first, since its size and tokens set the number of shards; a very long
    text is held whole by its task, its n-grams in buffers of bounded size. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, counts_path = write_table(count_words(texts))
    words, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (max(1, int(tokens)) // p.shard_tokens).bit_length())
    folder = f"{shared_path(checkpoint_folder(spark))}/model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    model = write_words(counts, Model(folder, p.order, bits, int(tokens), int(words), np.zeros(1 << bits, np.int64), np.empty(0, np.int64)))
    drop_table(spark, counts_path)
    grams, path = text_grams(texts, model), None
    for order in range(p.order, 0, -1):
        done, next_path = write_table(merge_order(grams, model, order))
        if path:
            drop_table(spark, path)
        n = done.where("kind = 'counts'").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "abcd"]).first()
        model.discounts[order] = discounts(tuple(int(x) for x in n))
        write_hot(done.where("kind = 'hot'"), model, order)
        grams, path = done.where("kind = 'next'"), next_path
    drop_table(spark, path)
    return model


def context_statistics(model: Model, order: int, context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Of each context: the sum of the counts behind it, and how many are one, two, and more."""
    stats = np.zeros((len(context), 4), np.int64)
    for table, on in ((f"hot{order}", hot), (f"contexts{order}", ~hot)):
        at = np.flatnonzero(on)
        stats[at] = read_table(model, table, top(context[at], model.bits), context[at], 4)
    return stats


def discounted(model: Model, order: int, stats: np.ndarray, n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of counts ``n`` behind known contexts: what is discounted is shared out as the next lower order says."""
    d = np.array([0.0, *model.discounts[order]])
    return (n - d[np.minimum(n, 3)] + stats[:, 1:] @ d[1:] * lower) / stats[:, 0]


def probabilities(model: Model, x: Tokens) -> np.ndarray:
    """Each token's probability, from the uniform one upwards. Single words and contexts of one are looked up once for all their places."""
    hot, one = among(x.words, model.hot), np.zeros(len(x.words), np.uint64)
    all_ = context_statistics(model, 1, one[:1], np.ones(1, bool))
    word = np.full(len(x.words), 1 / (model.words + 1))
    single = chained(one, x.words)
    if all_[0, 0]:
        word = discounted(model, 1, all_, read_table(model, "grams1", top(single, model.bits), single, 1)[:, 0], word)
    p = word[x.codes[x.place]]
    for order in range(2, model.order + 1):
        if order == 2:
            behind = x.codes[x.place - 1]
            context, all_hot, stats = single[behind], hot[behind], context_statistics(model, 2, single, hot)[behind]
        else:
            context, all_hot = np.zeros(len(p), np.uint64), np.ones(len(p), bool)
            for k in range(order - 1, 0, -1):
                behind = x.codes[x.place - k]
                context = chained(context, x.words[behind])
                all_hot &= hot[behind]
            stats = context_statistics(model, order, context, all_hot)
        known = np.flatnonzero(stats[:, 0] > 0)
        key = chained(context[known], x.words[x.codes[x.place[known]]])
        n = read_table(model, f"grams{order}", shards_of(model, context[known], key, all_hot[known]), key, 1)[:, 0]
        p[known] = discounted(model, order, stats[known], n, p[known])
    return p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, n_tokens, n_known (tokens with a trained word), base_score (add-one unigrams), score: log10 probabilities of whole texts, a row for each row; ``keep`` names more columns.

    A null or empty text is an end alone; repeated rows score alike; an empty table gives no rows;
    an unknown word has the share of the uniform distribution over the words and one more.
    """
    small_batches(docs.sparkSession)
    more = tuple(keep or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                hashes, starts = tokens_of(part.column(1))
                x = padded(model, hashes, starts)
                count = x.counts[x.codes[x.place]]
                sums = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731 - no text is without a token
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                columns = [np.diff(starts), sums((count > 0).astype(np.int64)), sums(base), sums(np.log10(probabilities(model, x)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *map(pa.array, columns)], names=["doc_id", *more, "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(name) for name, c in (keep or {}).items()])
    head = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(run, f"doc_id long{head}, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: Column, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens of every row, by a model of the rows that aren't held out (null: not held out).

    Nulls, repeated rows, long texts and empty tables as in ``train`` and ``score``. The result is
    written before the model's tables are dropped, so nothing reads them afterwards.
    """
    out = F.coalesce(held_out, F.lit(False))
    model = train(docs.where(~out), p, text_col)
    done = cut(score(docs, model, id_col, text_col, {"held_out": out}).withColumn("train_tokens", F.lit(model.tokens).cast("long")))
    model.drop()
    return done
