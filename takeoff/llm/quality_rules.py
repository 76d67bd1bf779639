"""Quality rules with an isolation forest over the rules' statistics.

Documents that fail a base rule go. Of the others, those that random splits of the statistics isolate early are anomalous. The
statistics are distances from the centre of good labelled documents, in their spreads. Centre, spreads and the threshold, the one that
parts the labels best, come from all labelled documents; each tree grows in a task from its own draw of SUBSAMPLE of them, as the method
has it.

Null text: no word, so the base rules fail. Without labels of both kinds, or an empty table, the default threshold holds. A
null doc_id keeps its row, repeated rows too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from takeoff.llm.common import documents, few, shipped, staged
from takeoff.llm.statistics import COUNTS, RATIOS, known_labels, measured
from takeoff.operators import quantiles

#: Bins of the scores in which the threshold is looked for.
SCORE_BINS = 4096
TREES, SUBSAMPLE, SEED = 200, 256, 7
DEFAULT_THRESHOLD = 0.6
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FEATURES = ("upper_share", "symbols_a_word", "bangs_a_word", "pipes_a_word", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "word_length")
#: Distances from the centre of good documents count from this many of their spreads on: nearer ones are usual, and would
#: only part clean documents from each other by noise.
USUAL = 1.5
SPREAD_SHARE, LEAST_SPREAD = 0.99, 0.05


def levels(table: np.ndarray) -> np.ndarray:
    """Logarithms of the ratios of rows of COUNTS."""
    at = {c: table[:, i].astype(float) for i, c in enumerate(COUNTS)}
    ratios = [at[RATIOS[f][0]] / np.maximum(at[RATIOS[f][1]], 1) for f in FEATURES]
    return np.log1p(100 * np.column_stack(ratios)) if len(table) else np.zeros((0, len(FEATURES)))


@dataclass
class Scale:
    """Centre and spread of each statistic among good documents."""

    centre: np.ndarray
    spread: np.ndarray

    def features(self, table: np.ndarray) -> np.ndarray:
        """Distances from the centre in spreads; all usual ones are one value."""
        return np.maximum(np.abs(levels(table) - self.centre) / self.spread, USUAL)


def scale_of(table: np.ndarray) -> Scale:
    x = levels(table)
    if not len(x):
        return Scale(np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    centre = np.median(x, axis=0)
    return Scale(centre, np.quantile(np.abs(x - centre), SPREAD_SHARE, axis=0) + LEAST_SPREAD)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Tree:
    feature: np.ndarray  # of inner nodes; -1: leaf
    cut: np.ndarray
    below: np.ndarray  # child for values below the cut; the other one is next to it
    path: np.ndarray  # of leaves


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    """One tree of random splits: a random feature that still varies, a random cut between its extremes."""
    feature, cut, below, path, todo = [-1], [0.0], [0], [0.0], [(0, rows, 0)]
    while todo:
        node, x, d = todo.pop()
        low, high = x.min(axis=0), x.max(axis=0)
        varying = np.flatnonzero(high > low)
        if d == depth or not len(varying):
            path[node] = d + mean_path(len(x))
            continue
        f = int(rng.choice(varying))
        c = float(rng.uniform(low[f], high[f])) or float(high[f])
        feature[node], cut[node], below[node] = f, c, len(feature)
        for side in (x[x[:, f] < c], x[x[:, f] >= c]):
            if not len(side):  # a cut at the very end
                side = x
            todo.append((len(feature), side, d + 1))
            feature.append(-1), cut.append(0.0), below.append(0), path.append(0.0)
    return Tree(np.array(feature), np.array(cut), np.array(below), np.array(path))


@dataclass
class Forest:
    trees: list[Tree]
    rows: int  # of each tree's sample
    threshold: float = DEFAULT_THRESHOLD
    scale: Scale | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the mean of a random tree: near 1 is anomalous, 0.5 usual."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        at, total = np.arange(len(x)), np.zeros(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := t.feature[node] >= 0).any():
                step = t.below[node] + (x[at, t.feature[node]] >= t.cut[node])
                node = np.where(inner, step, node)
            total += t.path[node]
        return 2 ** (-total / len(self.trees) / max(mean_path(self.rows), 1e-9))


def fit(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    if not len(x):
        return Forest([], 0)
    rng = np.random.default_rng(seed)
    n = min(subsample, len(x))
    depth = max(1, math.ceil(math.log2(n)))
    return Forest([grow(x[rng.choice(len(x), n, replace=False)], rng, depth) for _ in range(trees)], n)


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut midway between two scores that maximises the share of good rows below it plus that of bad rows at or above it."""
    if good.all() or not good.any():
        return DEFAULT_THRESHOLD
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    gain = np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum()
    ends = np.flatnonzero(np.append(s[1:] > s[:-1], True))
    k = ends[gain[ends].argmax()]
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] + 1e-9)


def base_failed(table: np.ndarray) -> np.ndarray:
    words, repeat = table[:, COUNTS.index("n_words")], table[:, COUNTS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)


def with_columns(table: DataFrame, measure: Callable[[np.ndarray], list], columns: str) -> DataFrame:
    """The table of COUNTS and what `measure` gives for its rows: one array for each of `columns`, a DDL string."""
    shipped(table.sparkSession)
    added = T.StructType.fromDDL(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(added)
        for batch in batches:
            got = measure(np.column_stack([batch.column(c).to_numpy() for c in COUNTS]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, f.type) for x, f in zip(got, arrow, strict=True))], names=[*batch.schema.names, *arrow.names])

    return table.mapInArrow(run, T.StructType(table.schema.fields + added.fields))


def scale_from(rows: DataFrame) -> Scale:
    """As `scale_of`, from rows of COUNTS, by exact quantiles of all statistics at once."""
    made = with_columns(rows.select(*COUNTS), lambda table: list(levels(table).T), ", ".join(f"{f} double" for f in FEATURES))
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in FEATURES]))
    told = staged(made.select(told.alias("_l")).select("_l.*"), "levels")
    centre = {r["f"]: r["q0"] for r in quantiles.grouped_quantiles(told, ["f"], F.col("x"), [0.5]).collect()}
    if not centre:
        return scale_of(np.zeros((0, len(COUNTS))))
    at = F.element_at(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.lit(centre[f]))]), F.col("f"))
    spread = {r["f"]: r["q0"] for r in quantiles.grouped_quantiles(told, ["f"], F.abs(F.col("x") - at), [SPREAD_SHARE]).collect()}
    return Scale(np.array([centre[f] for f in FEATURES]), np.array([spread[f] for f in FEATURES]) + LEAST_SPREAD)


def fit_rows(rows: DataFrame, n: int, scale: Scale, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """As `fit`, from n rows of doc_id and COUNTS: each tree draws its rows from all of them and grows in a task.

    A row is offered to a run of trees that begins at a place told by its hash, so that each tree is offered about twice what it takes.
    """
    if not n:
        return Forest([], 0, scale=scale)
    shipped(rows.sparkSession)
    size = min(subsample, n)
    depth, copies = max(1, math.ceil(math.log2(size))), min(trees, math.ceil(2 * trees * size / n))
    start = F.pmod(F.xxhash64("doc_id", *COUNTS, F.lit(seed)), F.lit(trees))
    offered = rows.select("doc_id", *COUNTS, F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: ((start + i) % trees).cast("int"))).alias("tree"))
    draw = W.partitionBy("tree").orderBy(F.xxhash64("doc_id", *COUNTS, "tree"), "doc_id", *COUNTS)
    drawn = offered.withColumn("place", F.row_number().over(draw)).where(F.col("place") <= size).select("tree", "place", *COUNTS)

    def one(table: pa.Table) -> pa.Table:
        table, tree = table.sort_by("place"), table.column("tree")[0].as_py()
        x = scale.features(np.column_stack([table.column(c).to_numpy() for c in COUNTS]))
        t = grow(x, np.random.default_rng([seed, tree]), depth)
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": pa.array([t.feature.tolist()], pa.list_(pa.int32())), "cut": pa.array([t.cut.tolist()], pa.list_(pa.float64())),
                         "below": pa.array([t.below.tolist()], pa.list_(pa.int32())), "path": pa.array([t.path.tolist()], pa.list_(pa.float64()))})

    grown = drawn.groupBy("tree").applyInArrow(one, "tree int, feature array<int>, cut array<double>, below array<int>, path array<double>")
    found = sorted(grown.collect(), key=lambda r: r["tree"])  # a bounded model: trees of at most twice SUBSAMPLE nodes
    return Forest([Tree(*(np.array(r[c]) for c in ("feature", "cut", "below", "path"))) for r in found], size, scale=scale)


def threshold_of(scored: DataFrame) -> float:
    """As `best_threshold`, from rows of anomaly and good: running sums within bins of the score, over what the bins before hold."""
    each = scored.groupBy("anomaly").agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    each = staged(each.withColumn("bin", F.floor(F.col("anomaly") * SCORE_BINS)), "scores")
    good, bad = each.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not good or not bad:
        return DEFAULT_THRESHOLD
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # SCORE_BINS rows at most
    bins = each.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    bins = bins.select("bin", F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    upto = W.partitionBy("bin").orderBy("anomaly").rowsBetween(W.unboundedPreceding, 0)
    gain = (F.sum("g").over(upto) + F.col("g0")) / F.lit(float(good)) - (F.sum("b").over(upto) + F.col("b0")) / F.lit(float(bad))
    gains = each.join(F.broadcast(bins), "bin").select("anomaly", gain.alias("gain"))
    best = gains.agg(F.max(F.struct("gain", (-F.col("anomaly")).alias("order")))["order"]).first()[0]
    above = each.where(F.col("anomaly") > -best).agg(F.min("anomaly")).first()[0]
    return float((above - best) / 2) if above is not None else float(-best + 1e-9)


def fitted(table: DataFrame, labels: DataFrame) -> Forest:
    """A forest fitted on all labelled rows of a table of doc_id and COUNTS that pass the base rules, with the threshold of their labels."""
    rows = table.select("doc_id", *COUNTS).join(few(known_labels(labels, "quality")), "doc_id")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = staged(rows.where(~failed).select("doc_id", *COUNTS, (F.col("label") == 1).alias("good")), "labelled")
    n, good = passed.agg(F.count(F.lit(1)), F.count(F.when(F.col("good"), 1))).first()
    forest = fit_rows(passed, n, scale_from(passed.where("good") if good else passed))
    forest.threshold = threshold_of(anomalies(passed, forest))
    return forest


def calibrated(docs: DataFrame, labels: DataFrame) -> Forest:
    """The forest of the labelled documents."""
    return fitted(staged(measured(docs), "counts"), labels)


def anomalies(table: DataFrame, forest: Forest) -> DataFrame:
    """A table of COUNTS with base_failed, anomaly (0 to 1) and kept."""
    shared = table.sparkSession.sparkContext.broadcast(forest)  # a bounded model: trees of at most twice SUBSAMPLE nodes

    def judge(rows: np.ndarray) -> list:
        failed, score = base_failed(rows), shared.value.scores(shared.value.scale.features(rows))
        return [failed, score, ~failed & (score < shared.value.threshold)]

    return with_columns(table, judge, "base_failed boolean, anomaly double, kept boolean")


def judged(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, all counts, base_failed, anomaly (0 to 1) and kept."""
    return anomalies(measured(docs, keep), forest)


def op3_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = staged(measured(documents(spark, sf_dir)), "counts")
    out = anomalies(table, fitted(table, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("anomaly", 9).alias("anomaly"))
