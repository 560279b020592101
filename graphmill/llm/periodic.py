"""Periodic runs of words: how often words match at each lag, and islands of matches at the lags with enough of them.

A run of period q over 4q words has each of its words four times, so words of fewer occurrences
take no part. The matches at all lags are counted at once: words that are frequent in their text by
autocorrelation (the Fourier transforms of their indicators are exact after rounding), the others
by differences of the places of their pairs. A run of period q holds at least 3q matches at lag q,
so only lags with as many are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import small_batches, text_chunks

#: Numbers that one block of indicators holds at most, so that memory doesn't follow the frequent words.
BLOCK = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Params:
    """A run has ``times`` periods at least and ``shortest`` words at least."""

    times: int = 4
    shortest: int = 6


def needed(lags: np.ndarray, p: Params) -> np.ndarray:
    """Matches in a row at a lag that make a run."""
    return np.maximum(np.maximum(p.shortest - lags, (p.times - 1) * lags), 1)


def heavy_counts(ids: np.ndarray, words: np.ndarray, lags: int) -> np.ndarray:
    """Matches at lags 0 to ``lags`` of the given words, by autocorrelation."""
    size = 1 << int(len(ids) + lags).bit_length()
    power = np.zeros(size // 2 + 1)
    for k in range(0, len(words), max(1, BLOCK // size)):
        spectrum = np.fft.rfft(ids[None, :] == words[k : k + max(1, BLOCK // size), None], size, axis=1)
        power += (spectrum.real**2 + spectrum.imag**2).sum(0)
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def light_counts(places: np.ndarray, owner: np.ndarray, lags: int, most: int) -> np.ndarray:
    """The same for words of at most ``most`` occurrences; ``places`` ascend within an ``owner``, whose rows are adjacent."""
    total = np.zeros(lags + 1, np.int64)
    for k in range(1, most):
        far = places[k:] - places[:-k]
        far = far[(owner[k:] == owner[:-k]) & (far <= lags)]
        if len(far):
            total += np.bincount(far, minlength=lags + 1)
    return total


def lag_counts(ids: np.ndarray, p: Params) -> np.ndarray:
    """Matches at each lag (0 is unused) of the words that a run can hold."""
    seen = np.bincount(ids)
    able = seen >= p.times
    lags = int(seen[able].sum()) // p.times
    if not lags:
        return np.zeros(1, np.int64)
    size = len(ids)
    most = max(4, int(np.sqrt(size * np.log2(size + 1)) / 4))  # beyond it pairs cost more than transforms
    heavy = np.flatnonzero(able & (seen > most))
    total = heavy_counts(ids, heavy, lags) if len(heavy) else np.zeros(lags + 1, np.int64)
    light = able & (seen <= most)
    places = np.flatnonzero(light[ids])
    if len(places):
        order = np.argsort(ids[places], kind="stable")
        places = places[order]
        total += light_counts(places, ids[places], lags, int(seen[light].max()))
    return total


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, words) of the maximal stretches that repeat themselves ``lag`` words on."""
    at = np.flatnonzero(ids[lag:] == ids[:-lag])
    if len(at) < least:
        return []
    first = np.flatnonzero(np.append(True, at[1:] > at[:-1] + 1))
    length = np.diff(np.append(first, len(at)))
    return [(int(at[f]), int(n) + lag) for f, n in zip(first, length, strict=True) if n >= least]


def runs_of(ids: np.ndarray, p: Params = Params()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. A stretch that a smaller period explains is that period's."""
    total = lag_counts(ids, p)
    lags = np.arange(len(total))
    least = needed(lags, p)
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero((total >= least) & (lags > 0)).tolist():
        for stretch in islands(ids, lag, int(least[lag])):
            found.setdefault(stretch, lag)
    return sorted((start, length, period) for (start, length), period in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties go to the smaller start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of words), best (one of them), collapsed: the text with one period of each run left, words joined by a space; a row for each row.

    Null and empty texts have no words, no runs and a null ``best``; repeated rows are alike; ties of
    ``best`` go to the smaller start; other columns are ignored; an empty table gives no rows. A text is
    held whole by its task, and its frequent words' transforms in blocks of ``BLOCK`` numbers.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                counts, every, best, kept = [], [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    words = (text or b"").split()  # ASCII white space, no other
                    seen: dict[bytes, int] = {}
                    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                    runs = runs_of(ids, p) if len(words) - len(seen) >= p.times - 1 else []
                    if runs:
                        stay = np.ones(len(words), bool)
                        for start, length, period in runs:
                            stay[start + period : start + length] = False
                        words = [words[k] for k in np.flatnonzero(stay).tolist()]
                    counts.append(len(ids))
                    every.append(runs)
                    best.append(strongest(runs))
                    kept.append(b" ".join(words))
                names = [f.name for f in RUN]
                lists = pa.array([[dict(zip(names, r, strict=True)) for r in runs] for runs in every], pa.list_(RUN))
                top = pa.array([r and dict(zip(names, r, strict=True)) for r in best], RUN)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), lists, top, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    struct = "struct<start: long, length: long, period: long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs array<{struct}>, best {struct}, collapsed string")
