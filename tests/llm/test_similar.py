"""The pipeline's near-dedup against brute force over all pairs."""

import random

import corpus_pipeline
from takeoff.llm import similar, simhash


def jaccard(a: str, b: str) -> float:
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_beyond_two_bits_go(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        for changes in (0, 3, 4, 4, 12):
            copy = list(base)
            for k in rng.sample(range(200), changes):
                copy[k] = word()
            texts.append(" ".join(copy))
    hub = [word() for _ in range(200)]  # a group larger than a round's leaders
    for _ in range(60):
        copy = list(hub)
        for k in rng.sample(range(200), 3):
            copy[k] = word()
        texts.append(" ".join(copy))
    near = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.8]
    assert any((simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() > 2 for a, b in near)
    root = list(range(len(texts)))
    for a, b in near * 10:
        root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()}
    assert kept == set(root)


def test_a_group_of_texts_below_the_similarity_makes_few_pairs(spark):
    """400 texts that share two thirds of their shingles, none similar: far fewer pairs than the 79,800 that there are, each once."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(200)]
    texts = [" ".join(common + [f"x{rng.getrandbits(40)}" for _ in range(100)]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(4)
    marked = similar.staged(similar.signatures(rows, ("key",)), "signatures")
    entries = similar.staged(marked.select(similar.F.col("key").alias("node"), similar.F.explode("bands").alias("band")), "entries")
    pairs = similar.candidates(entries, rows.select(similar.F.col("key").alias("node"), similar.F.col("key").alias("component")).limit(0))
    assert pairs.count() == pairs.distinct().count() < 12_000
    assert similar.one_of_each(rows.withColumnRenamed("key", "doc_id")).count() == 400


def test_band_keys_reach_the_similarity():
    rng = random.Random(1)
    missed = 0
    for _ in range(200):
        common = [str(rng.random()) for _ in range(80)]
        a, b = (similar.np.unique(similar.np.array([similar.xxhash.xxh64_intdigest(x) for x in common + [str(rng.random()) for _ in range(10)]], "u8")) for _ in range(2))
        missed += not set(similar.bands(a)) & set(similar.bands(b))
    assert missed == 0


def test_large_key_tables_are_joined_by_a_shuffle(spark, monkeypatch):
    """Without a broadcast: near copies, hits of decontamination and secrets come out the same."""
    from takeoff.llm import common, decontamination, secrets

    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    texts = [" ".join(base), " ".join(base + ["end"]), " ".join(base), "password: monday77 " + " ".join(reversed(base)), None, "", "plain words"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")], "doc_id long, text string, source string").repartition(3)
    bench = spark.createDataFrame([(1, " ".join(base[5:20]))], "item_id long, text string")

    def results():
        near = sorted(r["doc_id"] for r in similar.one_of_each(df).collect())
        dirty = sorted(r["doc_id"] for r in decontamination.contamination(df, bench).where("contaminated").collect())
        return near, dirty, sorted(map(repr, secrets.redacted(df).collect()))

    few = results()
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert results() == few and few[0] == [0, 3, 4, 6] and few[1] == [0, 0, 1, 2] and "[SECRET]" in "".join(few[2])


def test_fingerprints_within_two_bits_are_candidates(spark):
    """op2's links bring near copies to the exact test without any band, and nothing below the similarity passes it."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(50_000)}" for _ in range(900)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(4)
    marked = similar.staged(similar.signatures(rows, ("key",)), "signatures")
    told = {r["key"]: r["fp"] & (2**64 - 1) for r in marked.collect()}
    assert all(told[i] == simhash.fingerprint(t.encode(), similar.SHINGLE) for i, t in enumerate(texts))
    bare = marked.withColumn("bands", similar.F.array(similar.F.col("key")))  # no two share a band
    firsts = similar.groups(bare, rows)
    found = {(r["key"], r["first"]) for r in marked.join(firsts, "sig").select("key", "first").collect()}
    near = {(2 * k + 1, 2 * k) for k in range(40) if (told[2 * k] ^ told[2 * k + 1]).bit_count() <= 2}
    assert len(near) > 20 and near == {(a, b) for a, b in found if a != b}
