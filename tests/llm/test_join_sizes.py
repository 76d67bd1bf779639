"""Tables that grow with the input are not broadcast for a size that Spark only guesses."""

import pytest

import corpus_pipeline
from takeoff.llm import common, decontamination, secrets, similar, simhash


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plan of each staged table as Spark makes it before a row is read, by its name."""
    told, staged = {}, common.staged

    def kept(df, name):
        told.setdefault(name, []).append(plan_of(df))
        return staged(df, name)

    for module in (common, decontamination, secrets, similar, simhash):
        monkeypatch.setattr(module, "staged", kept)
    return told


def test_fingerprints_and_their_cells_are_joined_by_a_shuffle(spark, plans):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(f"d{i}", text + " more" * (i % 3)) for i in range(9)], "doc_id string, text string")
    out = simhash.near_duplicates(docs)
    plans["result"] = [plan_of(out)]
    assert {"midpoints", "edges", "result"} <= set(plans)
    assert not [name for name, each in plans.items() if "Broadcast" in "".join(each)]
    assert out.count() == 9


def test_texts_their_bands_and_hits_are_joined_by_a_shuffle(spark, plans, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_TERMS", 0)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[: 120 - i]) for i in range(20)] + [" ".join(reversed(words)), "password: monday77 " + " ".join(words[50:])]
    rows = [(f"d{i:02}", t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id string, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    plans["near_dedup"] = [plan_of(kept)]
    assert {"midpoints", "edges", "bands", "prints", "met", "links", "pairs", "copies"} <= set(plans)
    assert not [name for name, each in plans.items() if "Broadcast" in "".join(each)]
    plans.clear()
    benchmark = spark.createDataFrame([("b", " ".join(words[5:25]))], "item_id string, text string")
    plans["result"] = [plan_of(decontamination.contamination(docs, benchmark)), plan_of(secrets.redacted(docs))]
    assert {"postings", "found", "secrets"} <= set(plans) and "Broadcast" not in "".join(plans["postings"] + plans["result"])
    assert 1 < kept.count() < len(texts)
