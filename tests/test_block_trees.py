import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from takeoff.operators import block_trees, ml

TEXTS, NUMBERS = ["c", "d"], ["x", "z"]


def rows_of(spark, n=3000):
    noise = F.pmod(F.xxhash64("key"), F.lit(1000)) / 1000.0
    return spark.range(n).select(
        F.col("id").alias("key"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("c"), F.lit("one").alias("d"),
        (F.col("id") % 97).cast("double").alias("x"), F.lit(0.0).alias("z")).withColumn(
        "y", F.when(F.col("c") == "b", 3.0).otherwise(1.0) * F.sqrt("x") + noise)


def plain(bins, y, drawn, texts, depth, least, step):
    """Trees grown with masks over all rows at once, no blocks; the values of leaves as the module counts them."""
    left, out = y.copy(), np.zeros(len(y))

    def grow(rows, used, level, part):
        s = left[rows & used]
        best, value = None, s.mean() * part
        if level < depth:
            for f in range(bins.shape[1]):
                for b in sorted(set(bins[rows & used, f])):
                    goes = bins[:, f] == b if f < texts else bins[:, f] <= b
                    a, c = left[rows & used & goes], left[rows & used & ~goes]
                    if min(len(a), len(c)) >= max(least, 1):
                        gain = a.sum() ** 2 / len(a) + c.sum() ** 2 / len(c) - s.sum() ** 2 / len(s)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, goes)
        if best is None:
            return np.where(rows, value, 0.0)
        return grow(rows & best[1], used, level + 1, part) + grow(rows & ~best[1], used, level + 1, part)

    for t, used in enumerate(drawn):
        more = grow(np.ones(len(y), bool), used, 0, 1.0 if t == 0 else 2 * step)
        out, left = out + more, left - more
    return out


def test_trees_equal_plain_ones(spark, monkeypatch):
    frame = rows_of(spark, 400)
    monkeypatch.setattr(block_trees, "CUT", 2)
    monkeypatch.setattr(block_trees, "BLOCK", 64)  # many blocks and tasks
    model = block_trees.fit(frame, "key", TEXTS, NUMBERS, "y", trees=5, depth=3, step=0.1, least=8, share=1.0)
    told = frame.select("key", "y", model.binning.columns().alias("b")).orderBy("key").collect()
    bins, y = np.array([r["b"] for r in told]), np.array([r["y"] for r in told])
    assert len(set(bins[:, 2])) > 20 and len(set(bins[:, 3])) == 1
    want = plain(bins, y, [np.ones(len(y), bool)] * 5, 2, 3, 8, 0.1)
    got = block_trees.score(frame, model).orderBy("key").collect()
    assert np.allclose([r["prediction"] for r in got], want, atol=1e-5)
    own = model.score(frame).orderBy("key").collect()  # as column expressions
    assert np.allclose([r["pred_y"] for r in own], want, atol=1e-5)


def test_model_is_the_same_however_rows_lie(spark):
    frame = rows_of(spark)
    models = [block_trees.fit(f, "key", TEXTS, NUMBERS, "y", trees=4, depth=4, share=0.8).to_json()
              for f in (frame.repartition(1), frame.repartition(7).orderBy(F.desc("x")))]
    assert models[0] == models[1]


def test_as_good_as_the_library_s_trees(spark):
    frame = ml.feature_frame(rows_of(spark).withColumnsRenamed({"c": "building_type", "x": "floors"}), ml.TREE, ["key", "y"]).cache()
    texts, numbers, _ = ml.TREE
    est = ml.gbt(20, 0.1, 4)
    model = block_trees.fit(frame, "key", texts, numbers, "y", **ml.tree_sizes(est))
    ours = block_trees.score(frame, model).select(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)), F.stddev("y"), F.count("*")).first()
    library = Pipeline(stages=[*ml.preprocessor(ml.TREE), est.setLabelCol("y")]).fit(frame).transform(frame)
    theirs = library.select(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert ours[2] == 3000 and ours[0] < 0.2 * ours[1] and ours[0] == pytest.approx(theirs, rel=0.1)


def test_odd_rows_and_none(spark):
    frame = rows_of(spark, 60)
    odd = frame.union(spark.createDataFrame([(1000, None, None, None, float("nan"), None), (1001, "new", "d", 5.0, 0.0, float("inf"))], "key long, c string, d string, x double, z double, y double"))
    model = block_trees.fit(odd, "key", TEXTS, NUMBERS, "y", trees=3, depth=2)
    assert model.to_json() == block_trees.fit(frame, "key", TEXTS, NUMBERS, "y", trees=3, depth=2).to_json()
    assert block_trees.score(odd, model).where("prediction is not null").count() == 62
    one = block_trees.fit(frame.where("key = 9"), "key", TEXTS, NUMBERS, "y", trees=2, depth=2, share=1.0)
    y = frame.where("key = 9").first()["y"]
    assert block_trees.score(frame, one).first()["prediction"] == pytest.approx(y, rel=1e-6)
    none = block_trees.fit(frame.limit(0), "key", TEXTS, NUMBERS, "y", trees=2, depth=2)
    assert {r["prediction"] for r in block_trees.score(frame, none).collect()} == {0.0} and block_trees.score(frame.limit(0), model).count() == 0


def test_seismic_of_each_location_once(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["成都市新都区", "成都市新都区", None, "", " 大连 ", "海外"])], "key long, location string")
    got = ml.feature_frame(ml.with_seismic(rows), ml.SAFE, ["key"]).orderBy("key").collect()
    assert got == ml.feature_frame(rows, ml.SAFE, ["key"]).orderBy("key").collect()
