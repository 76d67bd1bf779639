"""Quality classifier: a sparse ensemble of rules.

Trees over the statistics of labelled documents give conjunctive rules, one for each path from the root; a logistic model with
lasso weighs them, and most weights become zero. The rest is compiled into one Spark column expression.

Null text: empty, scored as such. Without labels of both kinds the score is the share of label 1, or 0.5 without any label. A
null doc_id keeps its row, repeated rows too. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, held_out, staged
from takeoff.llm.statistics import RATIOS, labelled_sample, measured, with_ratios

#: Labelled rows that the trees and weights are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 11
CUT = 0.7
FEATURES = tuple(RATIOS)

#: A rule: (feature, whether its value is above the bound, bound), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


def holds(rule: Rule) -> Column:
    tests = [F.col(f) > F.lit(b) if above else F.col(f) <= F.lit(b) for f, above, b in rule]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def simplified(path: list[tuple[str, bool, float]]) -> Rule:
    """Only the tightest bound of a feature in each direction, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for f, above, b in path:
        old = best.get((f, above), b)
        best[f, above] = max(old, b) if above else min(old, b)
    return tuple(sorted((f, above, b) for (f, above), b in best.items()))


def paths(description: str, features: tuple[str, ...]) -> list[Rule]:
    """The rules of all inner and outer nodes of trees, read from the model's own description of its conditions."""
    rules, path = {}, []
    for line in description.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), (features[int(m[2])], m[3] == ">", float(m[4]))))
            rules[simplified([c for _, c in path])] = None
        elif re.match(r" *Tree \d+", line):
            path = []
    return list(rules)


@dataclass
class Ensemble:
    weights: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.weights:
            total = total + F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """From rows with the ratios and `label`."""
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return Ensemble([], 0.0 if not n else 20.0 if ones else -20.0)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label", *FEATURES)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED).fit(data)
    rules = paths(forest.toDebugString, FEATURES)
    as_numbers = data.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(as_numbers).select("label", "rules")
    model = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(table)
    return Ensemble([(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist()) if w], float(model.intercept))


def trained(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Ensemble:
    rows = measured(labelled_sample(docs, labels, "quality", limit), ("doc_id", "label"))
    return fit(staged(with_ratios(rows).select("label", *FEATURES), "quality-sample"))


def scored(docs: DataFrame, ensemble: Ensemble, keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from `cut` on)."""
    out = with_ratios(measured(docs, keep)).select(*keep, F.round(ensemble.score(), 9).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op9_sparse_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, trained(docs, documents(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
