"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

Two sets link when their Jaccard similarity is at least ``num / den``. Light sets (few
shingles) are listed under all their subsets of the size that a link needs in common, so linked
light sets meet in a list. Heavy sets are cut into blocks by shingle hash, one block more than
a linked pair can differ in, so linked sets share a whole block; the inverted lists hold blocks
instead of single shingles, which keeps passages that many documents share from making every
list long. Which sets are light is decided by cost over the histogram of set sizes.

Texts are shingled once for names and list keys. Equal sets are one set from then on. Lists only
gather sets into clusters, over those pairs of a list whose sketches (counters of shingles by
hash, an exact lower bound of the difference) don't rule a link out. Inside a cluster sets are
compared exactly, in pairs of blocks of bounded size, by scanning the inverted lists of their
shingles; only a spanning forest and link counts leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import WORD_PATTERN, broadcast_if_small, cut, drop_table, hashed, mix64, small_batches, text_chunks, write_table
from graphmill.llm.components import connected_components
from graphmill.llm.shingles import BASE, shingle_sets


@dataclass(frozen=True)
class Params:
    width: int = 5
    num: int = 80
    den: int = 100
    #: Widest ratio of set sizes within a class of heavy sets.
    spread: float = 0.65
    #: More blocks than a linked pair can differ in, so that a few may be empty.
    slack: float = 0.05
    #: Price of a block list against a subset list: the rows that scanning it is expected to read.
    scan_cost: int = 8
    #: Shingles and sets that one side of a comparison holds (a larger set is a side of its own), and sets compared at a time.
    block_shingles: int = 1 << 19
    block_sets: int = 2048
    tile: int = 512
    #: Members of a part of a list; longer lists are dealt in parts, and every two parts meet in a unit of their own.
    list_part: int = 4096

    def needs(self, n: int, m: int) -> int:
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def differs(self, n: int, m: int) -> int:
        """Most shingles in which linked sets of these sizes differ."""
        return (self.den - self.num) * (n + m) // (self.num + self.den)

    def smallest(self, m: int) -> int:
        """Least size that can link with size ``m``."""
        return max(1, -(-self.num * m // self.den))


@lru_cache
def class_ends(spread: float, upto: int) -> tuple:
    """Largest size of each class of heavy sets."""
    ends = [1]
    while ends[-1] < upto:
        ends.append(max(ends[-1] + 1, int(ends[-1] / spread)))
    return tuple(ends)


def subset_sizes(n: int, p: Params) -> list[int]:
    """Sizes of the subsets a light set is listed under, one for each partner size there can be."""
    return sorted({p.needs(n, m) for m in range(p.smallest(n), n * p.den // p.num + 1)})


@lru_cache(maxsize=1 << 16)
def blocks_of(n: int, p: Params) -> tuple:
    """(class, blocks, most differences) under which a heavy set of size ``n`` is listed: its own class, and the next if it can link into it."""
    ends = class_ends(p.spread, 1 << 40)
    k, out = int(np.searchsorted(ends, n)), []
    for c in (k, k + 1):
        if c == k or n >= p.smallest(ends[k] + 1):
            most = p.differs(ends[c], ends[c])
            out.append((c, most + 1 + int(np.ceil(p.slack * most)), p.differs(n, min(ends[c], n * p.den // p.num))))
    return tuple(out)


def light_cost(n: int, p: Params) -> int:
    """Lists of a light set of this size."""
    return sum(comb(n, c) for c in subset_sizes(n, p))


def heavy_cost(n: int, p: Params) -> int:
    """What the block lists of a heavy set of this size are expected to cost."""
    return p.scan_cost * sum(b for _, b, _ in blocks_of(n, p))


@lru_cache
def largest_light(p: Params) -> int:
    """The largest size at which a set costs less as a light one; no cost-based boundary lies beyond it."""
    best = n = 1
    while n < 4 * best + 64:  # light costs outgrow heavy ones; past a gap of this width they don't fall back
        n += 1
        if light_cost(n, p) < heavy_cost(n, p):
            best = n
    return best


def light_limit(histogram: dict[int, int], p: Params) -> int:
    """The size up to which sets are light: the least total cost over the histogram of sizes."""
    best, at, total = 0, 0, 0
    for n in sorted(n for n in histogram if 0 < n <= largest_light(p)):
        total += histogram[n] * (light_cost(n, p) - heavy_cost(n, p))
        if total < best:
            best, at = total, n
    return at


def list_keys(s: np.ndarray, light: int, p: Params) -> np.ndarray:
    """The lists (64-bit keys) that a set of shingle hashes stands in."""
    n, out = len(s), []
    if n == 0:
        return np.empty(0, np.uint64)
    if n <= light:
        values = mix64(s + np.uint64(0x51))
        for c in subset_sizes(n, p):
            sums = [values[list(pick)].sum(dtype=np.uint64) for pick in combinations(range(n), c)]
            out.append(mix64(np.array(sums, dtype=np.uint64) + np.uint64(c)))
    if n >= p.smallest(light + 1):
        for k, blocks, most in blocks_of(n, p):
            for salt in range(SALTS):
                mixed = mix64(s + np.uint64(k * 7919 + salt + 1))
                place = (mixed % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place = place[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                tag = np.uint64(k << 40 | salt << 32)
                out.append(mix64(np.add.reduceat(mix64(mixed[order]), first) * BASE + place[first].astype(np.uint64) + tag))
                if len(first) > most:  # a linked set leaves one of these blocks as it is
                    break
            else:
                out.append(mix64(np.setdiff1d(np.arange(blocks), place).astype(np.uint64) + tag + BASE))
    return np.unique(np.concatenate(out))


#: Ways to cut a set into blocks. Where so many are empty that a linked set might share none of
#: the others, the set is cut anew (as its partner is); after the last way, empty blocks are listed.
SALTS = 16


#: Least counters of a sketch, and shingles a counter: so many that sets without much in common differ beyond the bound of a link.
COUNTERS, SHINGLES_A_COUNTER = 64, 12


def set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes, as two signed numbers."""
    sums = np.array([s.sum(dtype=np.uint64), mix64(s + BASE).sum(dtype=np.uint64)]).view(np.int64)
    return int(sums[0]), int(sums[1])


def sketches(sets: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A sketch of each set: shingles counted in places by hash, a power of two of them that grows with the set.

    A shingle that only one of two sets has moves one counter by one, so the sum of differences
    never exceeds the number of shingles in which the sets differ: a pair beyond the bound cannot
    link. That holds for clipped counters too, and for a larger sketch folded to the size of a smaller.
    """
    n = np.diff(rows)
    size = np.maximum(COUNTERS, 1 << np.ceil(np.log2(np.maximum(n / SHINGLES_A_COUNTER, 1))).astype(np.int64))
    ends = np.cumsum(np.append(0, size))
    owner = np.repeat(np.arange(len(n)), n)
    place = ends[owner] + (sets % size[owner].astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=ends[-1]), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(counts.tobytes())])


class Sketched:
    """Sizes and sketches of some rows."""

    def __init__(self, n: np.ndarray, sketch: pa.Array):
        wide = sketch.cast(pa.large_binary())
        ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        self.n, self.first, self.size = n, ends[:-1], np.diff(ends)
        self.flat = np.frombuffer(wide.buffers()[2], np.uint8)

    def folded(self, rows: np.ndarray, k: int) -> np.ndarray:
        out = np.empty((len(rows), k), np.int32)
        for c in np.unique(self.size[rows]):
            on = np.flatnonzero(self.size[rows] == c)
            out[on] = self.flat[self.first[rows[on]][:, None] + np.arange(c)].reshape(len(on), c // k, k).sum(1)
        return out

    def possible(self, i: np.ndarray, j: np.ndarray, p: Params) -> np.ndarray:
        """Whether the sets of rows ``i`` and ``j`` can link, pair by pair."""
        n, m = self.n[i], self.n[j]
        out = p.den * np.minimum(n, m) >= p.num * np.maximum(n, m)
        size = np.minimum(self.size[i], self.size[j])
        for k in np.unique(size[out]):
            every = np.flatnonzero(out & (size == k))
            step = max(1, (1 << 20) // int(k))
            for at in range(0, len(every), step):
                on = every[at : at + step]
                differ = np.abs(self.folded(i[on], int(k)) - self.folded(j[on], int(k))).sum(1)
                out[on] = differ * (p.num + p.den) <= (p.den - p.num) * (n[on] + m[on])
        return out


NAMED = "doc_id long, n long, h1 long, h2 long, sketch binary, lists array<long>"


def named(docs: DataFrame, light: int, p: Params) -> DataFrame:
    """(doc_id, n, h1, h2, sketch, lists) of every row: size, name and sketch of its set, and the lists it stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                sets, rows = shingle_sets(part.column(1), p.width)
                each = [sets[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
                names = np.array([set_name(s) for s in each], dtype=np.int64).reshape(-1, 2)
                keys = [list_keys(s, light, p).view(np.int64) for s in each]
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys]), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(rows)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), sketches(sets, rows), lists], names=["doc_id", "n", "h1", "h2", "sketch", "lists"])

    return docs.mapInArrow(run, NAMED)


def list_links(doc: np.ndarray, sketched: Sketched, rows: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Spanning links of the rows of one list over the pairs that can link, breadth first; reached members aren't compared again."""
    edges, left = [], rows
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            at = wave.pop()
            on = sketched.possible(np.full(len(left), at), left, p)
            edges += [(doc[at], d) for d in doc[left[on]]]
            wave += left[on].tolist()
            left = left[~on]
    return edges


def linked_lists(ordered: DataFrame, p: Params) -> DataFrame:
    """(a, b) links between members of a list that can link, from rows sorted by list."""

    def judge(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        key, doc, n = (table.column(i).to_numpy() for i in (0, 1, 2))
        sketched = Sketched(n, table.column(3).combine_chunks())
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        star = np.repeat(first, size)
        on = sketched.possible(np.arange(len(key)), star, p)
        whole = np.logical_and.reduceat(on, first)  # the first member may link with all others
        rows = np.flatnonzero(np.repeat(whole, size) & (star != np.arange(len(key))))
        a, b = [doc[star[rows]]], [doc[rows]]
        for f, s in zip(first[~whole & (size > 2)], size[~whole & (size > 2)], strict=True):
            found = list_links(doc, sketched, np.arange(f, f + s), p)
            if found:
                x, y = zip(*found, strict=True)
                a.append(np.array(x))
                b.append(np.array(y))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            if last == 0:
                continue
            yield judge([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield judge(held)

    return ordered.mapInArrow(run, "a long, b long")


def gathered(met: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(a, b) candidate links between distinct sets (doc_id, n, sketch) that meet in a list, from (doc_id, list) rows.

    Lists of one member go first, then all but one of the lists that have the same members. A list of more than ``list_part`` members is dealt in parts
    by hash, and every two of its parts are judged together, so that any two members meet and a unit stays bounded.
    """
    # lists that hold the same sets say the same: one of them goes on
    alike = ["members", "x", "y"]
    every = met.groupBy("list").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    shared = cut(every.where("members > 1").groupBy(*alike).agg(F.min("list").alias("list")).select("list", F.ceil(F.col("members") / p.list_part).cast("int").alias("parts")))
    side = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: (k != side) | (F.col("parts") == 1))
    unit = F.transform(others, lambda k: F.when(F.col("parts") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least(side, k), F.greatest(side, k))))
    dealt = met.join(hashed(shared), "list").select("doc_id", unit.alias("units"))
    ordered = dealt.join(hashed(sets.select("doc_id", "n", "sketch")), "doc_id").select(F.explode("units").alias("unit"), "doc_id", "n", "sketch").repartition("unit").sortWithinPartitions("unit", "doc_id")
    return linked_lists(ordered, p)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by scanning the inverted lists of the shingles that both sides have.

    Short lists are expanded into their pairs; lists so long that this would cost more than a
    column of a dense product go into one.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(a) or not len(b):
        return out
    ha, hb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(ha, hb)
    if not len(both):
        return out
    sides = []
    for h, r in ((ha, ra), (hb, rb)):
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        on = both[at] == h
        at, r = at[on], r[on]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], r[order], np.bincount(at, minlength=len(both))))
    (at_a, ra, na), (at_b, rb, nb) = sides
    first_b = np.cumsum(nb) - nb
    short = na * nb * 256 <= len(a) * len(b)
    rows = np.flatnonzero(short[at_a])
    for lo in range(0, len(rows), 1 << 16):
        x = rows[lo : lo + (1 << 16)]
        reps = nb[at_a[x]]
        k = np.repeat(first_b[at_a[x]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        out += np.bincount(np.repeat(ra[x], reps) * len(b) + rb[k], minlength=out.size).reshape(out.shape)
    long_ = np.flatnonzero(~short)
    where = np.full(len(both), -1)
    where[long_] = np.arange(len(long_))
    step = 2048
    for lo in range(0, len(long_), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        for m, at, r in ((x, where[at_a], ra), (y, where[at_b], rb)):
            on = (at >= lo) & (at < lo + step)
            m[r[on], at[on] - lo] = 1
        out += x @ y.T
    return out


def forest(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> list:
    """A spanning forest of the links, breadth first: every node is reached by one edge."""
    edges, seen = [], [np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)]
    if same:
        seen[1] = seen[0]
    sides = ((linked, ids_a, ids_b), (linked.T, ids_b, ids_a))
    for start in np.flatnonzero(linked.any(1)):
        if seen[0][start]:
            continue
        seen[0][start] = True
        wave, side = np.array([start]), 0
        while len(wave):
            matrix, here, there = sides[side]
            reach = matrix[wave]
            new = np.flatnonzero(reach.any(0) & ~seen[1 - side])
            edges += list(zip(here[wave[reach[:, new].argmax(0)]].tolist(), there[new].tolist(), strict=True)) if len(new) else []
            seen[1 - side][new] = True
            wave, side = new, 0 if same else 1 - side
    return edges


class Side:
    """Sets of one side of a comparison: ids, sizes, copies, shingles."""

    def __init__(self, rows: list[tuple]):
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.n = np.array([r[1] for r in rows], dtype=np.int64)
        self.copies = np.array([r[2] for r in rows], dtype=np.int64)
        self.shingles = [r[3] for r in rows]

    def __len__(self) -> int:
        return len(self.ids)

    def linked(self, mine: np.ndarray, other: Side, theirs: np.ndarray, p: Params) -> np.ndarray:
        both = overlaps([self.shingles[i] for i in mine], [other.shingles[i] for i in theirs])
        return p.den * both >= p.num * (self.n[mine][:, None] + other.n[theirs][None, :] - both)


def compare(a: Side, b: Side | None, p: Params) -> tuple[list, list]:
    """Spanning links, and (id, number of documents linked) of both sides, over every pair."""
    edges, counts, other = [], [], a if b is None else b
    for x in range(0, len(a), p.tile):
        mine = np.arange(x, min(x + p.tile, len(a)))
        for y in range(x if b is None else 0, len(other), p.tile):
            theirs = np.arange(y, min(y + p.tile, len(other)))
            same = b is None and x == y
            on = a.linked(mine, other, theirs, p)
            if same:
                np.fill_diagonal(on, False)
            edges += forest(on, a.ids[mine], other.ids[theirs], same)
            counts += list(zip(a.ids[mine].tolist(), (on @ other.copies[theirs]).tolist(), strict=True))
            if not same:
                counts += list(zip(other.ids[theirs].tolist(), (on.T @ a.copies[mine]).tolist(), strict=True))
    return edges, [c for c in counts if c[1]]


def connect(a: Side, b: Side | None, p: Params) -> list:
    """Spanning links alone, breadth first: a set that has been reached isn't compared with others that have."""
    if b is not None:
        return compare(a, b, p)[0]
    edges, left = [], np.arange(len(a))
    while len(left) > 1:
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            on = np.hstack([a.linked(wave[: p.tile], a, left[y : y + p.tile], p) for y in range(0, len(left), p.tile)])
            reached = on.any(0)
            edges += list(zip(a.ids[wave[: p.tile][on[:, reached].argmax(0)]].tolist(), a.ids[left[reached]].tolist(), strict=True))
            wave, left = np.concatenate([wave[p.tile :], left[reached]]), left[~reached]
    return edges


def compared(dealt: DataFrame, p: Params, count_links: bool) -> DataFrame:
    """(a, b, n) from rows sorted by (cluster, i, j): links, and with null b the link counts of a set.

    A task holds one unit: two sides of bounded shingles, whatever the batches hold.
    """

    def judge(rows: list[tuple], i: int, j: int) -> list[tuple]:
        sides = []
        for k in (i, j):
            known: dict = {}
            for side, doc, n, copies, name, shingles in rows:
                if side == k:
                    known.setdefault((doc, name), (doc, n, copies, shingles))
            sides.append(Side(list(known.values())))
        a, b = sides[0], None if i == j else sides[1]
        if not count_links:
            return [(x, y, 0) for x, y in connect(a, b, p)]
        edges, counts = compare(a, b, p)
        return [(x, y, 0) for x, y in edges] + [(x, None, n) for x, n in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out = None, [], []

        def packed() -> pa.RecordBatch:
            a, b, n = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for part in text_chunks(batch, "text"):
                sets, at = shingle_sets(part.column("text"), p.width)
                columns = [part.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "doc_id", "n", "copies", "h1", "h2")]
                for k, (cluster, i, j, side, doc, n, copies, h1, h2) in enumerate(zip(*columns, strict=True)):
                    if (cluster, i, j) != unit:
                        if held:
                            out += judge(held, *unit[1:])
                        unit, held = (cluster, i, j), []
                        if len(out) > 20_000:
                            yield packed()
                    shingles = sets[at[k] : at[k + 1]]
                    if set_name(shingles) == (h1, h2):  # not so for another text under a repeated id
                        held.append((side, doc, n, copies, (h1, h2), shingles))
        if held:
            out += judge(held, *unit[1:])
        if out:
            yield packed()

    return dealt.mapInArrow(run, "a long, b long, n long")


def sizes_of(rows: DataFrame, p: Params) -> dict[int, int]:
    """How many texts have so many shingles, by their words (repeats within a text counted), up to the largest size that can be light.

    Longer texts, which no boundary makes light, are left as soon as so many words have been read.
    """
    most = largest_light(p) + p.width - 1
    short = F.col("text").rlike(rf"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{1,{most}}}+\z")
    n = F.greatest(F.regexp_count("text", F.lit(WORD_PATTERN)) - (p.width - 1), F.lit(1))
    counts = rows.where(short).groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return dict(map(tuple, counts.collect()))  # as many numbers as there are light sizes


def linked_sets(rows: DataFrame, p: Params, count_links: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of all rows, (doc_id, first, copies) of rows with a set, and what comparing found."""
    small_batches(rows.sparkSession)
    table, path = write_table(named(rows, light_limit(sizes_of(rows, p), p), p))
    names = cut(table.drop("lists"))
    key = ["n", "h1", "h2"]
    valid = names.where("n > 0 and doc_id is not null")
    # equal sets are one from here on; counts are summed up before they are shuffled
    firsts = cut(valid.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    tied = cut(valid.select("doc_id", *key).join(hashed(firsts), key))
    sets = cut(valid.join(tied.where("doc_id = first").select("doc_id", *key, "copies").distinct(), ["doc_id", *key]).dropDuplicates(["doc_id", *key]))
    met = table.select("doc_id", *key, "lists").join(hashed(sets.select("doc_id", *key)), ["doc_id", *key], "left_semi").select("doc_id", F.explode("lists").alias("list"))
    clusters = connected_components(gathered(met, sets, p)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    drop_table(rows.sparkSession, path)
    members = cut(sets.select("doc_id", *key, "copies").join(clusters, "doc_id"))
    size = F.greatest(F.ceil(F.sum("n") / p.block_shingles), F.ceil(F.count(F.lit(1)) / p.block_sets))
    per = members.groupBy("cluster").agg(size.cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    plan = cut(members.join(per, "cluster").select("doc_id", *key, "copies", "cluster", "blocks", F.pmod(F.xxhash64("doc_id", "h1"), F.col("blocks")).cast("int").alias("side")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")))
    dealt = rows.join(hashed(plan), "doc_id").withColumn("u", F.explode(pairs)).select("cluster", "u.i", "u.j", "side", "doc_id", "n", "copies", "h1", "h2", "text")
    unit = ["cluster", "i", "j"]
    return names, tied, cut(compared(dealt.repartition(*unit).sortWithinPartitions(*unit), p, count_links))


def joined(names: DataFrame, tied: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) over links between sets and between equal sets."""
    copies = tied.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return connected_components(found.where("b is not null").select("a", "b").unionByName(copies))


def join(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``.

    Words are runs of anything but space, tab, newline, vertical tab, form feed, return; A-Z are
    lower-cased. component_id is the smallest doc_id reachable by links, n_links the number of
    other documents linked directly (copies included). Null or wordless texts have no shingles and
    link with nothing, as do rows without an id (component_id null). Rows that repeat an id are one
    node. Other columns are ignored; an empty table gives no rows. Link counts make every pair of
    distinct sets of a cluster be compared; ``drop_near_duplicates`` does without.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names, tied, found = linked_sets(rows, p, count_links=True)
    components = joined(names, tied, found)
    counts = found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("others"))
    links = tied.join(broadcast_if_small(cut(counts)), "first", "left").select("doc_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")).groupBy("doc_id").agg(F.max("links").alias("links"))
    labels = components.withColumnRenamed("node", "doc_id")
    out = names.select("doc_id", "n").join(labels, "doc_id", "left").join(links, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; all columns stay.

    Rows that repeat the kept id and its text keep one of them; a row that repeats it with another
    text stays if no smaller id is linked with that text's document. Rows without an id all stay, as
    do wordless texts under ids of their own; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = cut(joined(*linked_sets(rows, p, count_links=False)).where("component <> node").select(F.col("node").alias("doc_id")))
    kept = docs.join(hashed(gone), "doc_id", "left_anti").select(*docs.columns)
    same = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text"), F.length("text")))
    repeated = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").select("doc_id"))
    if repeated.limit(1).count() == 0:
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").withColumn("_same", same).dropDuplicates(["_same"]).drop("_same")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
