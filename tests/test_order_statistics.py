import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeoff.operators import ordered, quantiles


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 50, [random.Random(1).lognormvariate(0, 5) for _ in range(997)],
    [0.0] * 300 + [1e-9, 1e12], [float(i % 7) for i in range(500)], [1e300, -1e300, 5e-324, 0.0, 1.0, 1.0000000000000002, 3.0]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert np.allclose(quantiles.exact_quantiles(df, F.col("v"), probs), np.quantile(values, probs), rtol=1e-12)


def test_infinities_count(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [inf, -inf, 1.0, 2.0, inf]], "v double")
    assert quantiles.exact_quantiles(df, F.col("v"), [0.0, 0.25, 0.5, 0.75, 1.0]) == [-inf, 1.0, 2.0, inf, inf]
    assert quantiles.exact_quantiles(df.filter("v > 5"), F.col("v"), [0.1, 0.9]) == [inf, inf]


def test_no_values(spark):
    assert quantiles.median(spark.createDataFrame([], "v double"), F.col("v")) is None


def test_in_row_quantile(spark, one):
    assert abs(one(quantiles.in_row_quantile(F.array(F.lit(4.0), F.lit(None), F.lit(1.0), F.lit(2.0)), 0.9)) - np.quantile([1, 2, 4], 0.9)) < 1e-12


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_carry_forward_with_a_hot_group(spark, chunk):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}", i, rnd.choice(["A", "B", "", "", "", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, n int, t string")
    mark = F.when(F.col("t") != "", F.struct(F.nullif("t", F.lit("B")).alias("v")))  # a B header resets to null
    got = {(r.g, r.n): (r.c.v if r.c else "none") for r in ordered.carry_forward(df, ["g"], "n", mark, "c", chunk).collect()}
    want, state = {}, {}
    for g, n, t in rows:
        if t:
            state[g] = None if t == "B" else t
        want[(g, n)] = state.get(g, "none")
    assert got == want


def test_fill_down(spark):
    df = spark.createDataFrame([("s", 1, "土石方工程"), ("s", 2, None), ("s", 3, ""), ("t", 1, "")], "s string, n int, name string")
    got = [(r.s, r.n, r.name) for r in ordered.fill_down(df, ["s"], "n", "name", chunk=2).orderBy("s", "n").collect()]
    assert got == [("s", 1, "土石方工程"), ("s", 2, "土石方工程"), ("s", 3, "土石方工程"), ("t", 1, None)]


def test_grouped_quantiles_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, values in (("a", rng.normal(0, 1e6, 9000)), ("b", rng.integers(0, 3, 500)), ("c", [1.5]), ("d", [2.0, 7.0]), (None, rng.exponential(1, 700))) for v in values]
    rows += [("a", None), ("e", None), ("b", float("nan")), ("f", float("inf")), ("f", 1.0), ("f", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for margin in (quantiles.RANK_MARGIN, 0.0):  # without a margin many brackets miss and are mended
        got = {r["g"]: r for r in quantiles.grouped_quantiles(df, ["g"], F.col("v"), probs, margin).collect()}
        assert set(got) == {"a", "b", "c", "d", None, "f"}
        for g, r in got.items():
            values = np.array([v for k, v in rows if k == g and v is not None and not np.isnan(v)])
            assert r["n"] == len(values)
            if g != "f":
                assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(values, probs), rtol=1e-12)
            else:
                assert [r["q0"], r["q2"], r["q4"]] == [1.0, 2.0, np.inf]
