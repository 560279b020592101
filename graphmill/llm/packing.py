"""Packing token sequences as a cutting-stock problem.

Documents are cut into full sequences and one remainder. The histogram of remainder sizes (in
units of ``UNIT`` tokens) is a cutting-stock problem of fixed size: a linear program over
patterns whose columns an integer knapsack prices. Rounded patterns are dealt to the pieces,
which are ranked within their size without any global sort.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import cut, shuffle_partitions, small_batches, text_chunks

LENGTH, UNIT, END_ID = 2048, 16, 1
DEFAULT_TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, doc_key long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words kept with their ids in a worker; beyond it the table starts anew.
CACHED_WORDS = 150_000
# Fixed value: how the tokenizer file splits normalised text into words.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+")
#: Texts of these characters split alike under SPLIT and the tokenizer's own pattern; others are encoded as a whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x5e\x60-\x7eÀ-ÖØ-öø-ſ]*")


# How byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: b for b in SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(SHOWN))}


def takes_bytes(path: str) -> bool:
    """Whether the tokenizer's model gets a split word as the letters of its bytes, whole and unchanged."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    last = steps[-1]
    return spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and last.get("type") == "ByteLevel" and not last.get("add_prefix_space", True) and not last.get("use_regex", True)


class Index(dict):
    """Word -> number; a new word gets the next number and waits in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


def grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class WordEncoder:
    """Token ids of whole texts, equal to the tokenizer's, with each distinct word encoded once."""

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT_TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if takes_bytes(path) else None
        vocabulary = self.tokenizer.get_vocab()
        # Added tokens are met in raw text before it is split, also inside words; matched here in any case, to be safe.
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()} - {""})
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.starts, self.counts, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat, self.used = np.zeros(1 << 17, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def learn(self) -> None:
        """Encodes the waiting words: by the model alone where it takes bytes, else in one text; a token that ends a word tells them apart."""
        words, self.index.fresh = self.index.fresh, []
        if self.model is not None:
            each = [[t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS))] for w in words]
            counts = np.array([len(x) for x in each])
            ids = np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(counts.sum()))
        else:
            ids = self.whole(" ".join(words))
            ends = np.nonzero(self.last[ids])[0] + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                counts = np.diff(ends, prepend=0)
            else:
                each = [self.whole(w) for w in words]
                ids, counts = np.concatenate(each), np.array([len(x) for x in each])
        n = self.known + len(words)
        self.starts, self.counts, self.flat = grown(self.starts, n), grown(self.counts, n), grown(self.flat, self.used + len(ids))
        self.starts[self.known : n], self.counts[self.known : n] = self.used + np.cumsum(counts) - counts, counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used, self.known = self.used + len(ids), n

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHED_WORDS:
            self.clear()
        get, at = self.index.__getitem__, []
        for text in texts:
            apart = PLAIN.fullmatch(text) and not (self.added and self.added.search(text))
            words = SPLIT.findall(text.lower()) if apart else None
            at.append(None if words is None else np.fromiter(map(get, words), np.int64, len(words)))
        if self.index.fresh:
            self.learn()
        return [self.whole(text) if i is None else self.gather(i) for text, i in zip(texts, at, strict=True)]

    def gather(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.uint32)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1])]


ENCODERS: dict = {}


def shared_encoder(path: str | None) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full sequences, then the remainder; texts are tokenized once, whole."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            for part in text_chunks(batch, "text", 512 << 10):
                place, out = [], []
                for row, ids in enumerate(encoder.encode_many([t or "" for t in part.column(2).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(ids), length):
                        piece = ids[a : a + length]
                        place.append(row)
                        out.append((a, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                rows_ = pa.array(place, pa.int64())
                numbers = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_), part.column(1).take(rows_), *numbers], names=["doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, PIECES)


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: sizes 1..len(values) units, most value in ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    n = len(values)
    for c in range(1, capacity + 1):
        m = min(c, n)
        gains = best[c - m : c][::-1] + values[:m]
        k = int(gains.argmax())
        if gains[k] > best[c - 1] + 1e-15:
            best[c], pick[c] = gains[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(n, dtype=np.int64), capacity
    while c > 0:
        if pick[c]:
            counts[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def inverted(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with pivoting. Small matrices don't pay for threads, which the driver's JVM would contend with."""
    n = len(basis)
    work = np.hstack([basis, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        work -= np.outer(others, work[k])
    return work[:, n:]


def solve_cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces by size, in units) with how often to use each; together they cover ``demand`` exactly.

    Revised simplex with column generation: the basis starts with one homogeneous pattern a size,
    the knapsack prices columns with the dual values, and the loop ends when the bound is within
    half a sequence or 0.01 %. Patterns are used a whole number of times (rounded down); what is left
    over, fewer sequences than there are sizes, is packed by first fit decreasing.
    """
    sizes = np.nonzero(demand)[0] + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1] * (1 + 1e-7 * np.arange(len(sizes)))  # a little uneven, against stalling at ties
    basis = np.diag((capacity // sizes).astype(float))
    inverse, level = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    for k in range(rounds):
        dual = inverse.sum(0)
        values = np.zeros(capacity)
        values[sizes - 1] = np.maximum(dual, 0)
        worth, counts = best_pattern(values, capacity)
        # Farley's bound: no solution uses less than the present level / worth
        if level.sum() * (1 - 1 / max(worth, 1)) <= max(0.5, 1e-4 * level.sum()):
            break
        column = counts[sizes - 1].astype(float)
        direction = (inverse * column).sum(1)
        able = direction > 1e-10
        if not able.any():
            break
        ratio = np.where(able, level / np.where(able, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        level = level - step * direction
        level[out] = step
        level = np.maximum(level, 0)
        basis[:, out] = column
        if k % 50 == 49:
            inverse = inverted(basis)
            level = np.maximum((inverse * need).sum(1), 0)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
    left = demand.astype(np.int64).copy()
    used = []
    for j in np.argsort(-level, kind="stable"):
        counts = np.zeros(len(demand), dtype=np.int64)
        counts[sizes - 1] = np.round(basis[:, j]).astype(np.int64)
        on = counts > 0
        times = min(int(np.floor(level[j] + 1e-9)), int((left[on] // counts[on]).min())) if on.any() else 0
        if times > 0:
            used.append((counts, times))
            left -= counts * times
    bins: list[list] = []
    for size in range(len(left), 0, -1):
        for _ in range(int(left[size - 1])):
            for b in bins:
                if b[0] >= size:
                    b[0] -= size
                    b[1][size - 1] += 1
                    break
            else:
                counts = np.zeros(len(demand), dtype=np.int64)
                counts[size - 1] = 1
                bins.append([capacity - size, counts])
    return used + [(b[1], 1) for b in bins]


class Deal:
    """Where the r-th piece of each size goes: sequence number and slot."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], sizes: int):
        first = np.cumsum([0, *(n for _, n in patterns)])
        self.until, self.rows = [[] for _ in range(sizes)], [[] for _ in range(sizes)]
        taken = np.zeros(sizes, dtype=np.int64)
        for (counts, times), base in zip(patterns, first, strict=False):
            slot = 0
            for s in np.nonzero(counts)[0][::-1]:
                self.rows[s].append((taken[s], base, counts[s], slot))
                taken[s] += counts[s] * times
                self.until[s].append(taken[s])
                slot += counts[s]
        self.sequences = int(first[-1])

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            on = np.nonzero(size == s)[0]
            rows = np.array(self.rows[s - 1], dtype=np.int64)
            at = rows[np.searchsorted(self.until[s - 1], rank[on], side="right")]
            local = rank[on] - at[:, 0]
            sequence[on], slot[on] = at[:, 1] + local // at[:, 2], at[:, 3] + local % at[:, 2]
        return sequence, slot


def pack_pieces(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``length`` tokens.

    A piece's size is its length in units, rounded up, so patterns never overflow; offsets run over
    true lengths, gapless from 0. Only the histogram (length / unit numbers) and the patterns made
    from it are on the driver. Pieces are ranked within (size, salt) after the counts of the salts
    have been summed up, so that no size is ranked in one task.
    """
    capacity, salts = length // unit, max(8, shuffle_partitions(pieces.sparkSession))
    sized = cut(pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_key", "start"), F.lit(salts)).cast("int")))
    counts = cut(sized.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")))
    demand = np.zeros(capacity, dtype=np.int64)
    for size, n in counts.groupBy("size").agg(F.sum("n")).collect():
        demand[size - 1] = n
    deal = Deal(solve_cutting_stock(demand, capacity), capacity)
    before = counts.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("base"))
    local = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_key", "start")) - 1
    ranked = sized.withColumn("local", local).join(before, ["size", "salt"]).withColumn("rank", F.col("local") + F.col("base"))

    @F.pandas_udf("sequence_id long, slot long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, slot = deal.place(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("at", place("size", "rank"))
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("at.sequence_id").alias("sequence_id"), F.col("at.slot").alias("slot")).withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("long")).drop("slot")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, length: int = LENGTH, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    Every row of ``docs`` is packed, repeated ids each on their own; null and empty texts are the
    end id alone; other columns are ignored; an empty table gives no rows.
    """
    return pack_pieces(cut_documents(docs, id_col, text_col, tokenizer_path, length, end_id), length, unit)
