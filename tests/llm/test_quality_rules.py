"""Scale and threshold of the rules come from all labelled documents, however many there are."""

import numpy as np
import pytest

from takeoff.llm import quality_rules as q
from takeoff.llm.statistics import COUNTS, measured


def test_all_labelled_documents_count(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(12_000):
        own = rng.choice(words, 52 + i % 7).tolist()
        if i % 10 == 0:
            own = [w.upper() + "!#" * (i % 5) for w in own]
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i, _ in texts], "doc_id long, quality int")
    forest = q.calibrated(docs, labels)
    rows = measured(docs).join(q.known_labels(labels, "quality"), "doc_id").orderBy("doc_id").collect()
    assert len(rows) > 8_000  # more than the sample of old
    table, good = np.array([[r[c] for c in COUNTS] for r in rows]), np.array([r["label"] == 1 for r in rows])
    passed = ~q.base_failed(table)
    scale = q.scale_of(table[passed & good])
    assert forest.scale.centre == pytest.approx(scale.centre, abs=1e-12) and forest.scale.spread == pytest.approx(scale.spread, abs=1e-12)
    scores = forest.scores(forest.scale.features(table[passed]))
    assert forest.threshold == pytest.approx(q.best_threshold(scores, good[passed]), abs=1e-12)
    assert len(forest.trees) == q.TREES and forest.rows == q.SUBSAMPLE
