"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from takeoff.llm import decontamination, language, licenses, packing, quality_classifier, quality_rules, secrets, simhash, statistics, suffix_dedup, wrappers

LONG = "the sea was calm and the long road went on past the hills until night fell over it " * 3000
TEXTS = [None, "", " \n\t ", "Word", "One two", "Ende der Straße im Norden", LONG, "same text here", "same text here", "!!! ### |||", "\U0001f600 ünï"]
#: Extra columns that carry names the operators use themselves.
CLASH = "key string, words string, fp string, score double, component string, _n long, found string, label int, value string, host string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else 7 if i in (7, 8) else i, t, ("en", "de", None)[i % 3], None if i == 4 else "src", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for column in CLASH.split(", "):
        name, kind = column.split()
        df = df.withColumn(name, F.lit(1).cast(kind))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i != 5 else None, 0) for i in range(11)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(0, "the long road went on past the hills until night fell over it"), (0, "same text"), (None, "one two"), (2, None), (3, ""), (4, "nowhere to be found")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "suffix_dedup": lambda d, b, y: suffix_dedup.repeated_spans(d),
    "simhash": lambda d, b, y: simhash.near_duplicates(d),
    "quality_rules": lambda d, b, y: quality_rules.judged(d, quality_rules.calibrated(d, y)),
    "decontamination": lambda d, b, y: decontamination.contamination(d, b),
    "language": lambda d, b, y: language.identified(d, language.trained(d)),
    "packing": lambda d, b, y: packing.tokenised(d),
    "licenses": lambda d, b, y: licenses.scanned(d),
    "quality_classifier": lambda d, b, y: quality_classifier.scored(d, quality_classifier.trained(d, y)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(odd, benchmark, labels, name):
    out = OPERATORS[name](odd, benchmark, labels).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(odd, benchmark, labels, name):
    assert OPERATORS[name](odd.where("false"), benchmark, labels.where("false")).count() == 0


def test_defined_results(odd, benchmark, labels):
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(odd).collect()}
    assert (got[0]["n_bytes"], got[0]["spans"]) == (0, []) and got[0]["kept_sha256"] == got[1]["kept_sha256"]
    assert [(s["start"], s["end"]) for s in got[6]["spans"]] == [(0, len(LONG))] and got[7]["spans"] == []
    rows = simhash.near_duplicates(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == got[2]["fingerprint"] == "0" * 16 and {got[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert [r["component_id"] for r in rows if r["doc_id"] == 7] == [7, 7]
    got = {r["doc_id"]: r for r in decontamination.contamination(odd, benchmark).collect()}
    assert (got[0]["n_words"], got[0]["contaminated"], got[0]["items"]) == (0, False, [])
    assert got[4]["items"] == [""] and got[4]["n_hit"] == 2 and got[7]["items"] == ["0"] and got[7]["n_hit"] == 2
    assert got[6]["n_hit"] == 3000 * 13 and got[6]["n_words"] == len(LONG.split())
    got = {r["doc_id"]: r for r in language.identified(odd, language.trained(odd)).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (0, 1, 2, 9)] == [("und", 0.0)] * 4
    got = {r["doc_id"]: r for r in packing.tokenised(odd).collect()}
    assert [p["length"] for p in got[0]["pieces"]] == [1] and {p["length"] for p in got[6]["pieces"][1:]} == {2048}
    got = {r["doc_id"]: r for r in licenses.scanned(odd).collect()}
    assert (got[0]["n_words"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (0, None, "", 0.0)
    got = {r["doc_id"]: r for r in statistics.measured(odd).collect()}
    assert all(got[0][c] == 0 for c in statistics.COUNTS) and got[9]["n_symbols"] == 6 and got[10]["word_chars"] == 4


def test_an_empty_benchmark_leaves_all_clean(odd, benchmark):
    assert not any(r["contaminated"] for r in decontamination.contamination(odd, benchmark.where("false")).collect())


def test_secrets_of_odd_documents(odd):
    more = odd.withColumn("text", F.concat("text", F.lit(' api_key = "a8F3kd93kdK39dkw02"')))
    assert secrets.redacted(more, "source").where("text like '%a8F3kd%'").count() == 0
    assert secrets.redacted(odd).exceptAll(odd).count() == 0 and secrets.redacted(odd).columns == odd.columns
    assert secrets.findings(odd.where("false")).count() == 0


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "", ""), (2, "http://a.b/c", "<p>x"), (2, "http://a.b/c", "<p>x"), (3, "no url", "a < b & c &lt; <article>"), (4, "http://a.b", "</div></p><p>" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit("clash"))
    out = wrappers.extracted(pages)
    assert out.count() == 6 and out.columns == ["page_id", "url", "text"]
    assert out.where("page_id is null").first()["text"] == "" and out.where("page_id = 4").first()["text"] == ""
    assert wrappers.extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, tmp_path, k):
    spark.createDataFrame([(0, "the long road went on past the hills until night")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, str(tmp_path))
    if name != "packing":
        assert out.columns == odd.columns
    expected = {"language_id": 11 - 4, "simhash_near_dedup": 8, "benchmark_decontamination": 10, "secret_scan": 11}
    assert out.count() == expected.get(name, out.count())
    assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
