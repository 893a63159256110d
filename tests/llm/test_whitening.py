"""Whitening against dense eigenvectors, and the solver on operators of many shapes."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternscan.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"
EPS = np.finfo(float).eps


def covariances():
    r = np.random.default_rng(1)
    for d in (1, 2, 16, 17, 64, 130):
        a = r.standard_normal((1000, d)) * 10
        yield f"random-{d}", (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) / 1000
    q = np.linalg.qr(r.standard_normal((90, 90)))[0]
    shapes = {"falling": 0.8 ** np.arange(90), "cluster": np.r_[np.full(20, 5.0), np.ones(70)], "low-rank": np.r_[[9, 9, 8, 3, 2, 1, 1e-9], np.zeros(83)], "close": 1 + 1e-9 * np.arange(90), "zero": np.zeros(90)}
    for name, values in shapes.items():
        yield name, (q * values) @ q.T


@pytest.mark.parametrize("name,v", list(covariances()), ids=lambda x: x if isinstance(x, str) else "")
def test_solver(name, v):
    passes = []

    def product(columns):
        assert columns.shape[1] <= W.BLOCK * W.BLOCKS_HELD  # never the whole of a wide matrix
        passes.append(columns.shape[1])
        return v @ columns

    values, axes = W.jacobi_davidson(product, len(v), 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 100 * EPS * top and (np.diff(values) <= 0).all()
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() <= 200 * EPS * top
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 100 * EPS and len(passes) < 150


def test_minres_solves_the_projected_equation():
    r = np.random.default_rng(2)
    a = r.standard_normal((30, 30))
    v, own = a @ a.T, np.linalg.qr(r.standard_normal((30, 3)))[0]
    locked, shift = W.orthonormal(r.standard_normal((30, 2)), own), np.array([1.0, 40.0, 0.0])
    rhs = r.standard_normal((30, 3))
    z = W.minres(lambda x: v @ x, shift, locked, own, rhs, 400, 1e-13)
    for k in range(3):
        q = np.c_[locked, own[:, k]]
        p = np.eye(30) - q @ q.T
        assert np.allclose(p @ (v - shift[k] * np.eye(30)) @ p @ z[:, k], p @ rhs[:, k], atol=1e-8) and np.abs(q.T @ z[:, k]).max() < 1e-10


def brute(rows, components=16):
    ok = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not ok:
        return {}, 0, []
    sizes = Counter(len(v) for _, v in ok)
    d = max(sizes, key=lambda s: (sizes[s], s))
    ok = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for k, v in ok if len(v) == d]
    fit = sorted({x for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = Counter()
    for k, x in ok:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ axes / np.sqrt(np.maximum(values, 1e-300))
        out[k, n, dev, tuple(np.round(np.abs(w), 6))] += 1
    return out, values, float((c * c).sum() / n)


@pytest.mark.parametrize("d", [3, 24, 40])
def test_whitening(spark, d):
    r = np.random.default_rng(d)
    base = r.standard_normal((150, d)) * np.linspace(3, 0.2, d)
    rows = [(int(k), v.tolist()) for k, v in enumerate(base)]
    rows += [(500 + k, rows[7][1]) for k in range(60)] + [(7, rows[7][1])] * 2  # a group of copies, and repeated rows
    rows += [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [1.0] * (d - 1) + [float("inf")]), (904, []), (905, [1.0] * (d + 1)), (None, rows[3][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "n", "block", "rows", "component")})
    got = W.whiten(df, "vec_id", "embedding").collect()
    want, values, trace = brute(rows)
    k = min(16, d)
    assert len(got) == k * sum(want.values()) and {g.component for g in got} == set(range(1, k + 1))
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9
    for g in got:
        assert abs(g.explained - values[g.component - 1] / trace) < 1e-10
    have = Counter()
    by = {}
    for g in got:
        by.setdefault((g.vec_id, g.n, g.deviation), {}).setdefault(g.component, []).append(g.whitened)
    for (vec, n, dev), parts in by.items():
        for at in range(len(parts[1])):
            have[vec, n, dev, tuple(np.round([abs(parts[c][at]) for c in range(1, k + 1)], 6))] += 1
    assert have == want
    # one sign for all rows: the whitened vectors have no correlation
    fit = {}
    for g in got:
        fit.setdefault(g.vec_id, {})[g.component] = g.whitened
    m = np.array([[fit[i][c] for c in range(1, k + 1)] for i in range(150)])
    assert np.abs(m.T @ m / 150 - np.eye(k)).max() < 1e-6


def test_directions_without_variance(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0, -1.0]) for k in range(20)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    assert {g.component for g in got} == {1} and abs(got[0].explained - 1) < 1e-12 and len(got) == 20
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])]):
        assert W.whiten(spark.createDataFrame(few, SCHEMA), "vec_id", "embedding").count() == 0


def test_deviation_is_exact_or_null():
    x = np.array([[3, -4], [1 << 40, 5], [1 << 61, 7]], dtype=np.int64)
    sums = [int(s) for s in x.astype(object).sum(axis=0)]
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert W.deviations(x, 3, sums) == [w if w < 1 << 63 else None for w in want]
    small = x[:2] % 1000
    sums = small.sum(axis=0).tolist()
    assert W.deviations(small, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in small]
