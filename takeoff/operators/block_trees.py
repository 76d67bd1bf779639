"""Boosted regression trees of one output, over rows kept as blocks of small whole numbers.

A tree is what Spark ML's `GBTRegressor` grows on one-hot categories: one value against the others, or a number up to the edge of a bin, by least
squares; the first tree counts whole, each later one learns what is left with twice the step (the gradient of the squared error). A row is a byte a
feature, what is left of its target, and a hash of its key. Blocks of such rows stay with the executors, so a level of a tree is one pass over some
20 bytes a row: every task adds up (node, feature, bin), a shuffle by node merges the sums and picks the best split, and only splits come to the
driver, at most 2^depth a level.

What is left and the values of leaves are whole numbers, and the draw of a tree's rows comes from the hash, so a model doesn't depend on the
order of rows or partitions; ties go to the first feature and bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from takeoff.operators import boosting
from takeoff.session import checkpoint_folder

SEED = 42
#: Rows of a block.
BLOCK = 1 << 16
#: Trees after which the rows are written to the checkpoint folder and the lineage ends.
CUT = 25


def _to_blocks(block: int, scale: float, places: int) -> Callable:
    """Rows of y, hash and bins as blocks: bins feature by feature, what is left in whole parts, hashes."""
    def made(parts):
        y = np.concatenate([p[0] for p in parts])
        cut = np.rint(y / scale * places).astype(np.int64)
        bins = np.ascontiguousarray(np.concatenate([p[2] for p in parts]).T)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, cut, np.concatenate([p[1] for p in parts]))], ["bins", "r", "h"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            n = batch.num_rows
            if n:
                bins = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.uint8)
                parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), bins))
                held += n
            if held >= block:
                yield made(parts)
                parts, held = [], 0
        if held:
            yield made(parts)

    return run


def _walker(heap: list[dict], width: int) -> Callable:
    """The node a row is in after some steps down a tree; node 0 (a row that isn't drawn) stays."""
    feature, after = np.zeros(len(heap) + 1, np.int64), np.tile(np.arange(len(heap) + 1)[:, None], width)
    for i, node in enumerate(heap, 1):
        if node.get("feature") is not None:
            own = np.arange(width)
            feature[i], after[i] = node["feature"], 2 * i + ((own != node["bin"]) if node["equal"] else (own > node["bin"]))
    after = after.ravel()

    def walk(bins, at, steps):
        flat, n = bins.ravel(), bins.shape[1]
        rows = np.arange(n)
        for _ in range(steps):
            at = after[at * width + flat[feature[at] * n + rows]]
        return at

    return walk


def _level_sums(heap: list[dict], level: int, width: int, tree: int, share: float, seed: int = SEED) -> Callable:
    """A task's weights and sums of what is left, by feature and bin, of every node of a level."""
    walk, first, nodes = _walker(heap, width), 1 << level, 1 << level
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % (1 << 64))

    def drawn(h):
        x = h.view(np.uint64) + start
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        return ((x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share).astype(np.int64)

    def run(blocks):
        total = None
        for bins, r, h in blocks:
            at = walk(bins, drawn(h), level)
            node = np.where(at >= first, at - first + 1, 0)
            left = r.astype(np.float64)  # a block's sums stay below 2^53, so they are exact
            whole = np.bincount(node, minlength=nodes + 1), np.bincount(node, left, nodes + 1).astype(np.int64)
            place = node * width
            if total is None:
                total = np.zeros((bins.shape[0], 2, (nodes + 1) * width), np.int64)
            for f in range(bins.shape[0]):
                if (bins[f] == bins[f, 0]).all():  # a feature of one value here
                    for k in (0, 1):
                        total[f, k, bins[f, 0]::width] += whole[k]
                    continue
                key = place + bins[f]
                total[f, 0] += np.bincount(key, minlength=total.shape[2])
                total[f, 1] += np.bincount(key, left, total.shape[2]).astype(np.int64)
        if total is not None:
            told = total.reshape(total.shape[0], 2, nodes + 1, width)
            for i in range(nodes):
                if told[0, 0, i + 1].any():
                    yield first + i, told[:, :, i + 1].copy()

    return run


def _best(texts: int, least: int, least_gain: float = boosting.LEAST_GAIN) -> Callable:
    """The best split of a node's sums: feature, bin, equal (None: no split), and the means of left, right and all."""
    def run(sums):
        w, s = sums[:, 0], sums[:, 1]
        count, total = int(w[0].sum()), int(s[0].sum())
        lw, ls = w.copy(), s.copy()
        lw[texts:], ls[texts:] = np.cumsum(w[texts:], 1), np.cumsum(s[texts:], 1)
        rw, rs = count - lw, total - ls
        own = float(total) ** 2 / count
        gain = ls.astype(float) ** 2 / np.maximum(lw, 1) + rs.astype(float) ** 2 / np.maximum(rw, 1) - own
        gain = np.where((lw >= least) & (rw >= least) & (lw > 0) & (rw > 0) & (gain > least_gain * (own + 1)), gain, -1.0)
        f, b = (int(x) for x in np.unravel_index(np.argmax(gain), gain.shape))
        if gain[f, b] <= 0:
            return None, total / count
        return (f, b, f < texts, int(ls[f, b]) / int(lw[f, b]), int(rs[f, b]) / int(rw[f, b])), total / count

    return run


def _moved(heap: list[dict], depth: int, width: int) -> Callable:
    """A block with what a tree leaves of its rows' targets."""
    walk, value = _walker(heap, width), np.array([0, *[n.get("units", 0) for n in heap]], np.int64)

    def run(block):
        bins, r, h = block
        return bins, r - value[walk(bins, np.ones(len(r), np.int64), depth)], h

    return run


def fit(frame: DataFrame, key: str, texts: list[str], numbers: list[str], target: str, trees: int = 100, depth: int = 6, step: float = 0.05,
        least: int = 8, share: float = 0.8, bins: int = boosting.BINS) -> boosting.Trees:
    """The model of all rows with a target. `frame` is read three times and `key` tells its rows apart. No rows: predictions of 0."""
    spark = frame.sparkSession
    checkpoint_folder(spark)
    y = F.col(target).cast("double")
    rows = frame.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < math.inf))
    how = boosting.binning(rows, texts, numbers, bins)
    width = max([bins, *[len(v) + 1 for v in how.texts.values()]])
    if width > 256:
        raise ValueError(f"{width} bins don't fit a byte")
    n, most = rows.agg(F.count(F.lit(1)), F.max(F.abs(y))).first()
    scale = most or 1.0
    places = 1 << max(8, min(32, 58 - max(n, 1).bit_length()))
    grown = []
    if n:
        parts = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK)))
        blocks = rows.select(y.alias("y"), F.xxhash64(F.col(key)).alias("h"), how.columns().alias("bins")).mapInArrow(
            _to_blocks(BLOCK, scale, places), "bins binary, r binary, h binary").repartition(parts)
        features = len(texts) + len(numbers)
        state = blocks.rdd.map(lambda b: (np.frombuffer(b[0], np.uint8).reshape(features, -1), np.frombuffer(b[1], np.int64), np.frombuffer(b[2], np.int64)))
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        best, former = _best(len(texts), least), None
        for t in range(trees):
            heap = [{} for _ in range((1 << (depth + 1)) - 1)]
            part = 1.0 if t == 0 else 2 * step
            for level in range(depth):
                sums = state.mapPartitions(_level_sums(heap, level, width, t, share)).reduceByKey(np.add, min(parts, 1 << level))
                found = sums.mapValues(best).collect()  # at most 2^level splits
                if former is not None:
                    former.unpersist()
                    former = None
                for node, (split, mean) in found:
                    if level == 0:
                        heap[0]["units"] = round(mean * part)
                    if split is not None:
                        f, b, equal, *sides = split
                        heap[node - 1] |= {"feature": f, "bin": b, "equal": equal}
                        for child, side in zip((2 * node - 1, 2 * node), sides):
                            heap[child]["units"] = round(side * part)
                if not any(split for _, (split, _) in found):
                    break
            grown.append([[{"feature": h.get("feature"), "bin": h.get("bin"), "equal": h.get("equal"), "value": [h.get("units", 0) / places]} for h in heap]])
            if t + 1 < trees:
                former, state = state, state.map(_moved(heap, depth, width)).persist(StorageLevel.MEMORY_AND_DISK)
                if (t + 1) % CUT == 0:
                    state.checkpoint()
        for held in (former, state):
            if held is not None:
                held.unpersist()
    return boosting.Trees([target], [scale], how, depth, [[0.0]], grown)


def _scorer(heaps: list[list[dict]], width: int, depth: int, scale: float) -> Callable:
    told = [(_walker(h, width), np.array([0.0, *[n["value"][0] for n in h]])) for h in heaps]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            bins = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            bins, out = np.ascontiguousarray(bins.T.astype(np.uint8)), np.zeros(n)
            for walk, value in told if n else []:
                out += value[walk(bins, np.ones(n, np.int64), depth)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out * scale)], [*batch.schema.names[:-1], "prediction"])

    return run


def score(df: DataFrame, model: boosting.Trees) -> DataFrame:
    """All rows with `prediction`, by the trees of `fit` in Arrow batches."""
    width = max([256, *[len(v) + 1 for v in model.binning.texts.values()]])
    run = _scorer([t[0] for t in model.trees], width, model.depth, model.scales[0])
    schema = StructType([*df.schema.fields, StructField("prediction", DoubleType())])
    return df.select("*", model.binning.columns().alias("_bins")).mapInArrow(run, schema)
