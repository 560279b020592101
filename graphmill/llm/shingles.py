"""Hashed word shingles of whole texts, many documents in one NumPy pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graphmill.llm.common import joined_bytes, mix64

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Powers of BASE by the byte's place in its word, and a random-looking value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows (A-Z lower-cased), and each row's first word (one more at the end)."""
    data, starts = joined_bytes(text)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    blank = SPACE[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    edges = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
    begins[edges] = ~blank[edges]
    first = np.flatnonzero(begins)
    rows = np.searchsorted(first, starts)
    if not len(first):
        return np.empty(0, np.uint64), rows
    values = BYTE_VALUE[LOWER[data]]
    values[blank] = 0
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - first[np.maximum(word, 0)]
    longest = int(place.max()) + 1
    powers = np.empty(longest, np.uint64)
    powers[0] = 1
    step = 1
    while step < longest:
        n = min(step, longest - step)
        powers[step : step + n] = powers[:n] * np.uint64(int(powers[step - 1]) * int(BASE) % (1 << 64))
        step += n
    values *= powers[np.maximum(place, 0)]
    return mix64(np.add.reduceat(values, first)), rows


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending within the row, and each row's first (one more at the end).

    With fewer words than ``width`` the whole sequence is one shingle; without words there is none.
    """
    words, rows = word_hashes(text)
    n = np.diff(rows)
    if not len(words):
        return words, np.zeros(len(rows), np.int64)
    sums = words.copy()
    total = len(words)
    full = total - width + 1
    if full > 0:
        acc = words[:full].copy()
        for k in range(1, width):
            acc = mix64(acc * BASE + words[k : k + full])
        sums[:full] = acc
    owner = np.repeat(np.arange(len(n)), n)
    keep = np.arange(total) - rows[owner] <= n[owner] - width
    for r in np.flatnonzero((n > 0) & (n < width)):
        h = words[rows[r] : rows[r] + 1].copy()
        for k in range(1, int(n[r])):
            h = mix64(h * BASE + words[rows[r] + k : rows[r] + k + 1])
        sums[rows[r]] = mix64(h + np.uint64(int(n[r])))[0]
        keep[rows[r]] = True
    sums, owner = sums[keep], owner[keep]
    order = np.lexsort((sums, owner))
    sums, owner = sums[order], owner[order]
    fresh = np.ones(len(sums), dtype=bool)
    fresh[1:] = (sums[1:] != sums[:-1]) | (owner[1:] != owner[:-1])
    sums, owner = sums[fresh], owner[fresh]
    return sums, np.searchsorted(owner, np.arange(len(n) + 1))
