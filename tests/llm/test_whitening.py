"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeoff.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, deviation int").repartition(3)


def reference(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (x - s // n) - (s % n) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, c, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [5, 60])
def test_whitening_by_numpy(spark, d):
    rng = np.random.default_rng(d)
    good = (rng.standard_normal((400, d)) * np.linspace(3, 0.5, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(good)]
    rows += [(7, good[7].tolist(), None, None), (None, good[8].tolist(), None, None)]  # a repeated row and a null id count
    bad = [None, [], [None] + [0.0] * (d - 1), [float("nan")] + [0.0] * (d - 1), [float("inf")] * d, [1.0] * (d - 1), [1e20] + [0.0] * (d - 1)]
    rows += [(1000 + i, v, None, None) for i, v in enumerate(bad)]
    out = whitening.whitened(table(spark, rows)).collect()
    x, c, e, u = reference([r[1] for r in rows[:402]])
    k = min(d, 8)
    assert len(out) == 402 and all(len(r["whitened"]) == k for r in out)
    by = sorted(out, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    place = [*range(8), 400, *range(8, 400), 401]
    w, want = np.array([r["whitened"] for r in by]), (c @ u[:, :k] / np.sqrt(e[:k]))[place]
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    n = len(x)
    assert [int(r["deviation"]) for r in by] == [int(((n * x[i] - x.sum(axis=0)) ** 2).sum()) for i in place]
    assert np.allclose(by[0]["explained"], e[:k] / e.sum(), rtol=1e-10) and {r["n"] for r in out} == {n} and max(r["identity_error"] for r in out) < 1e-9


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**25), 2**25, (50, 3)) * 1024.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    x = [[int(c) * 1024 + 100_000 for c in v] for v in values]
    s = [sum(r[j] for r in x) for j in range(3)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(df).collect()}
    assert got == {i: sum((50 * r[j] - s[j]) ** 2 for j in range(3)) for i, r in enumerate(x)}


def test_without_variance(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(0, [1.0, 2.0], None, None)] * 3)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0], None, None) for i in range(20)]
    out = whitening.whitened(table(spark, line)).collect()
    assert len(out) == 20 and all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-9 for r in out)


def test_the_filter_needs_no_whole_covariance(spark):
    """200 dimensions, a block of 10 columns: the passes converge although the block is far from the whole space."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    v = rng.standard_normal((900, 200)) * np.r_[9, 7, 5, np.full(197, 1.0)] @ q
    df = whitening.staged(whitening.vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")), "v")
    at = whitening.moments(df)
    found = whitening.spectrum(df, at, 3, 7)
    x = np.floor(1024 * v).astype(np.int64) + 100_000
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(found.values, e[:3], rtol=1e-9) and found.residual < 1e-12 and df.select(F.size("x")).first()[0] == 200
