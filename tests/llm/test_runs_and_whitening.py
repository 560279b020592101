"""Periodic runs against a brute-force search, whitening against one eigendecomposition of all rows."""

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from graphmill.llm import periodic, queries, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, runs string, best long, n_words string, x array<long>"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(a == b for a, b in zip(w, w[q:], strict=False)))


def brute_runs(w):
    """Every maximal stretch of every period, one by one."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and (i == 0 or i - 1 + q >= len(w) or w[i - 1] != w[i - 1 + q]) and smallest_period(w[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def texts():
    r = random.Random(3)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "x y x y x y x y"), (4, "x y x y x y x y"), (5, "a a a a a"), (6, "a a a a a a"), (7, "é é é é é é é é é é é é")]
    for i in range(60):
        w = [r.choice("abc"[: 1 + i % 3] + "defgh"[: i % 6]) for _ in range(r.randint(1, 80))]
        at, q = r.randrange(len(w)), r.randint(1, 9)
        w[at:at] = (w[at : at + q] or ["z"]) * r.randint(2, 9)
        rows.append((10 + i, "  ".join(w)))
    long_ = [f"w{r.randrange(300)}" for _ in range(6000)]
    long_[1000:1000] = long_[100:450] * 5
    long_[300:300] = ["the"] * 700
    return [*rows, (99, "\n".join(long_))]


def test_runs_equal_brute_force(spark):
    rows = texts()
    got = periodic.find_runs(spark.createDataFrame([(i, t, "s", 1, "s", [1]) for i, t in rows], DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for x in got:
        w = (by_id[x.doc_id] or "").encode().split()
        want = brute_runs(w) if len(w) < 5000 else None
        runs = [tuple(r) for r in x.runs]
        if want is not None:
            assert runs == want, x.doc_id
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert x.collapsed.encode() == b" ".join(t for k, t in enumerate(w) if k not in gone) and x.n_words == len(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert (x.best and tuple(x.best)) == best
    assert next(x for x in got if x.doc_id == 99).runs[0]["length"] >= 700 and any(r["period"] == 350 for r in next(x for x in got if x.doc_id == 99).runs)


@pytest.mark.parametrize("most", [4, 1000])
def test_both_ways_of_counting_agree(most, monkeypatch):
    r = np.random.default_rng(1)
    ids = np.unique(r.zipf(1.4, 900) % 60, return_inverse=True)[1].astype(np.int64)
    counts = np.bincount(ids)
    want = [int((ids[q:] == ids[:-q]).sum()) if q else len(ids) for q in range(226)]
    got = np.zeros(226, np.int64)
    heavy = np.flatnonzero(counts > most)
    monkeypatch.setattr(periodic, "BLOCK", 5000)  # several blocks of transforms
    if len(heavy):
        got += periodic.heavy_counts(ids, heavy, 225)
    at = np.flatnonzero(counts[ids] <= most)
    if len(at):
        at = at[np.argsort(ids[at], kind="stable")]
        got += periodic.light_counts(at, ids[at], 225, int(counts.max()))
    assert got[1:].tolist() == want[1:]


def test_other_bounds_of_a_run():
    assert periodic.runs_of(np.array([0, 1, 0, 1, 0, 1]), periodic.Params(times=3, shortest=6)) == [(0, 6, 2)]
    assert periodic.runs_of(np.array([0, 1, 0, 1, 0, 1])) == [] and periodic.runs_of(np.zeros(0, np.int64)) == []


def test_runs_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op11_periodic_runs(spark, SF)
    want = duck.sql(queries.OP11_SQL)
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(want.columns).collect()) == rows and sum("None" not in r for r in rows) > 5
    small = spark.createDataFrame([(None, None, "s", 1, "s", [1]), (3, "", "s", 1, "s", [1])], DOCS)
    assert [(r.doc_id, r.text) for r in queries.with_planted_periods(small).collect()] == [(None, None), (3, "")]


def planted(text, h):
    """The rule of the query's planted periods, word by word."""
    w = text.split()
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]


def test_planted_periods(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(400)]
    for x in queries.with_planted_periods(spark.createDataFrame([(i, t, "s", 1, "s", [1]) for i, t in rows], DOCS)).collect():
        assert x.text.split() == planted(rows[x.doc_id][1], zlib.crc32(str(x.doc_id).encode()))


def brute_whitening(vectors):
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in vectors}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return {i: (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)), (v - s / n) @ u[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()) for i, v in x.items()}


VECTORS = "vec_id long, embedding array<double>, label int, x string, n long, node string, component int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", 2, "s", 3) for i, v in rows], VECTORS)


def same_up_to_sign(a, b):
    return np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)


def test_whitening_equals_one_decomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(5)
    v = r.standard_normal((900, 12)) @ np.diag(np.linspace(3, 0.5, 12)) + 7
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + k, v[0].tolist()) for k in range(400)]  # one vector holds a third of all rows
    odd = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [1.0] * 11 + [float("nan")]), (2003, [float("inf")] * 12), (2004, [])]
    got = whitening.whiten(vector_frame(spark, rows + odd).repartition(7)).collect()
    want = brute_whitening(rows)
    assert len(got) == 4 * len(rows) and {x.n for x in got} == {900} and {x.vec_id for x in got} == set(want)
    assert all(x.deviation == want[x.vec_id][1] and x.identity_error < 1e-9 for x in got)
    for c in range(4):
        mine = sorted((x.vec_id, x.whitened, x.explained) for x in got if x.component == c + 1)
        assert same_up_to_sign(np.array([m[1] for m in mine]), np.array([want[m[0]][2][c] for m in mine]))
        assert np.allclose([m[2] for m in mine], want[0][3][c], rtol=1e-9)


def test_merges_keep_every_dimension():
    r = np.random.default_rng(2)
    x = r.integers(-500, 500, (300, 6))
    parts = [whitening.summarised(p) for p in (x[:1], x[1:3], x[3:150], x[150:])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.merged(whole, p)
    centred = x - x.mean(0)
    assert np.allclose(whole.basis.T @ np.diag(whole.s**2) @ whole.basis, centred.T @ centred, rtol=1e-10) and whole.n == 300 and (whole.sums == x.sum(0)).all()


def test_whitening_edges(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 2.0]), (3, [2.0, 4.0]), (4, [5.0]), (5, [5.0]), (6, [1e300, -1e300, 0.0])]
    got = {}
    for x in whitening.whiten(vector_frame(spark, rows)).collect():
        got.setdefault((x.vec_id, x.component), []).append(x)
    assert len(got[(1, 1)]) == 2 and got[(1, 2)][0].whitened is None and got[(None, 1)][0].n == 3
    assert abs(got[(3, 1)][0].whitened) == pytest.approx(1.5**0.5) and got[(3, 1)][0].explained == pytest.approx(1)
    assert got[(4, 1)][0].whitened is None and got[(4, 1)][0].explained is None and got[(4, 1)][0].n == 1 and (4, 2) not in got
    assert got[(6, 1)][0].deviation == 0
    assert whitening.deviations(np.array([[1 << 39, 0]]), whitening.Model(1 << 20, np.array([5, 5]), *[np.zeros(1)] * 3)) == [None]


def test_empty_tables_of_runs_and_whitening(spark):
    assert periodic.find_runs(spark.createDataFrame([], DOCS)).count() == 0 and whitening.whiten(vector_frame(spark, [])).count() == 0
    assert whitening.whiten(vector_frame(spark, [(1, None), (2, [])])).count() == 0
