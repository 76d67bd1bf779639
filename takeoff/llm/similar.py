"""Near-duplicates for the pipeline: texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles; one of each group stays.

Candidates come from op2's method first: SimHash fingerprints of the same shingles, linked within 2 bits through its grid of popcounts. A 64-bit
SimHash can't tell a similarity of 0.8, though: such texts differ in about 10 bits, and a grid that reaches so far holds nearly everything.
So texts that share one of 20 bands of 6 min-hashes are candidates, too: a pair at 0.8 is missed with a probability of 0.2 %,
a more similar one more rarely. Both kinds are judged by the exact similarity. Groups are the components of the links, so pairs that others join needn't be compared. Small bands
compare all of different components, larger ones first only the members with a hub, the one that has most company over all bands:
near copies of one text then make as many pairs as copies. Two such rounds, each with components drawn, join most. What is left of a larger
band, members of different components, is compared in blocks inside of tasks, where sketches of 120 bytes decide first: no
pair leaves the task but a link. Links are exact similarities of the shingle sets (64-bit hashes). Texts with the same set are one node.

Null text: empty. Texts without a word are copies of each other; one of fewer than five words is one shingle. Of a group the smallest
doc_id stays, null ids last, then the smallest MD5 of the text; of repeated rows of one id and text one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from takeoff.llm import simhash
from takeoff.llm.common import components, few, per_text, shipped, shuffled, staged

SHINGLE, SIMILARITY, BANDS, BAND_ROWS, SEED = 5, 0.8, 20, 6, 42
#: A band of so many texts at most compares all of different components; each text has half as many partners there at most.
SMALL_BAND = 16
#: Rounds of hubs; more bring next to nothing.
ROUNDS = 2
#: Members of a larger band that a task compares with as many others.
BLOCK = 2048
#: Of the min-hashes of similar texts, a lower share agrees with a probability of 3e-5.
SKETCH_SHARE = 0.65
CHUNK = 1 << 10


def grams(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    flips, factors = (rng.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[start : start + CHUNK, None] ^ flips) * factors).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def bands(hashes: np.ndarray) -> list[int]:
    """A signed long for each band; none without a shingle."""
    return band_keys(min_hashes(hashes)) if len(hashes) else []


def sketch(least: np.ndarray) -> bytes:
    """A byte of each min-hash."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, sig (of the set of shingles), fp (the fingerprint as a signed long, repeats included) and bands."""
    def measure(texts: list[bytes]) -> list:
        each = [simhash.shingle_hashes(t, SHINGLE) for t in texts]
        sets = [np.unique(h) for h in each]
        fps = np.array([simhash.fingerprint_of(h) for h in each], np.uint64).view(np.int64)
        return [pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(fps), [bands(s) for s in sets]]

    return per_text(docs, measure, "sig binary, fp bigint, bands array<bigint>", keep)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes whose fingerprints are equal, each with the least one, or linked within 2 bits, the least ones of both."""
    least = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least")
    equal = nodes.join(shuffled(least), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = [shuffled(least.select(F.col("fp").alias(e), F.col("least").alias(f"node_{e}"))) for e in "ab"]
    linked = simhash.links(least.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return equal.union(linked.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))).distinct()


def candidates(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes of different components that share a band: all of a small band, with its hub in a larger one."""
    e, mixed = with_components(entries, labels)
    active = staged(e.join(shuffled(mixed), "band"), "active")
    company = active.groupBy("node").agg(F.sum("n").alias("company"))
    hub = active.where(F.col("n") > SMALL_BAND).join(shuffled(company), "node").groupBy("band").agg(F.max(F.struct("company", (-F.col("node")).alias("order"), "component")).alias("hub"))
    led = active.join(shuffled(hub), "band").select("node", "component", (-F.col("hub.order")).alias("other"), F.col("hub.component").alias("other_component"))
    small = active.where(F.col("n") <= SMALL_BAND).groupBy("band").agg(F.collect_list(F.struct("node", "component")).alias("all"))
    each = small.select("all", F.explode("all").alias("x")).select("x.*", F.explode("all").alias("y")).where("node < y.node")
    pairs = led.union(each.select("node", "component", "y.node", "y.component")).where("component <> other_component")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def with_components(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, node, component), and (band, n) of the bands that hold more than one component."""
    e = entries.join(shuffled(labels), "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = e.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return e, mixed.select("band", "n")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets (node, size, grams) are similar enough; sizes decide first, and each pair moves one set."""
    sizes = shuffled(sets.select("node", "size"))
    near = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("size_b")), "b")
    near = near.where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
    both = near.join(shuffled(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))), "a").join(shuffled(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.where(shared >= similarity * (F.col("size_a") + F.col("size_b") - shared)).select("a", "b")


def rest(entries: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) within bands over SMALL_BAND between members of different components, each pair judged in the first band it shares.

    A band is cut into blocks of about `block` members, and each two blocks meet in a task. Links found there spare further ones.
    """
    shipped(entries.sparkSession)
    e, mixed = with_components(entries, labels)
    cut = F.ceil(F.col("n") / block)
    active = e.join(shuffled(mixed.where(F.col("n") > SMALL_BAND)), "band").withColumn("own", F.pmod(F.xxhash64("node"), cut))
    meet = active.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    meet = meet.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        node, component, own = (table.column(c).to_numpy() for c in ("node", "component", "own"))
        root, split = component.copy(), table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        here = int(np.flatnonzero(keys[0] == table.column("band")[0].as_py())[0])
        lists = table.column("grams").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        held, found = [flat[a:b] for a, b in zip(ends, ends[1:])], []
        size = np.diff(ends)
        for i in range(len(node) - 1):
            js = np.flatnonzero((root[i + 1 :] != root[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i])) & ((own[i + 1 :] != own[i]) | (not split))) + i + 1
            js = js[(marks[js] == marks[i]).sum(axis=1) >= SKETCH_SHARE * marks.shape[1]]
            js = js[(keys[js] == keys[i]).argmax(axis=1) == here] if len(js) else js
            for j in js.tolist():
                if root[j] != root[i]:
                    shared = len(np.intersect1d(held[i], held[j], assume_unique=True))
                    if shared >= similarity * (size[i] + size[j] - shared):
                        found.append((node[i], node[j]))
                        root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return meet.join(shuffled(sets), "node").groupBy("band", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def groups(marked: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(sig, first): the key of the text that stays, for each shingle set; marked: (key, sig, fp, bands), rows: (key, text)."""
    nodes = staged(marked.groupBy("sig").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.min("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    entries = staged(each.join(shuffled(shared), "band").select("band", "node"), "bands")
    alike_prints = staged(fingerprint_pairs(nodes.where(F.size("bands") > 0).select("node", "fp")), "prints")
    in_pairs = alike_prints.select(F.explode(F.array("a", "b")).alias("node"))
    met = staged(nodes.join(shuffled(entries.select("node").union(in_pairs).distinct()), "node", "left_semi").select("node", "key"), "met")
    texts = rows.join(few(met), "key").groupBy("node").agg(F.first("text").alias("text"))

    def measure(some: list[bytes]) -> list:
        held = [grams(t) for t in some]
        least = [min_hashes(h) for h in held]
        return [[h.view(np.int64).tolist() for h in held], [len(h) for h in held], [sketch(x) for x in least], [band_keys(x) for x in least]]

    sets = staged(per_text(texts, measure, "grams array<bigint>, size int, sketch binary, bands array<bigint>", ("node",)), "grams")
    labels = nodes.select("node", F.col("node").alias("component")).limit(0)
    done = alike_prints
    links = staged(alike(alike_prints, sets, similarity), "links")
    if not links.isEmpty():
        labels = components(links)
    for _ in range(ROUNDS):
        pairs = staged(candidates(entries, labels).join(shuffled(done), ["a", "b"], "left_anti"), "pairs")
        found = staged(alike(pairs, sets, similarity), "links")
        if found.isEmpty():
            break
        links, done = links.union(found), done.union(pairs)
        labels = components(links)
    last = staged(rest(entries, labels, sets, similarity), "links")
    if not last.isEmpty():
        labels = components(links.union(last))
    labelled = nodes.join(shuffled(labels), "node", "left").select("sig", "key", F.coalesce("component", "node").alias("component"))
    firsts = labelled.groupBy("component").agg(F.min("key").alias("first"))
    return labelled.join(shuffled(firsts), "component").select("sig", "first")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("hash")).alias("key")
    rows = docs.select(key, text.alias("text"))
    marked = staged(signatures(rows, ("key",)), "signatures")
    firsts = groups(marked, rows, similarity)
    seen = marked.join(shuffled(firsts), "sig").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"))
    # what goes, and what stays once: few against all documents
    seen = staged(seen.select("key", "n", (F.col("key") == F.col("first")).alias("stays")).where("n > 1 or not stays"), "copies")
    found = docs.select(F.struct(*docs.columns).alias("_row"), key)
    alone = found.join(few(seen.select("key")), "key", "left_anti").select("_row")
    again = found.join(few(seen.where("stays").select("key")), "key", "left_semi")
    once = again.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("key"))).where("_n = 1").select("_row")
    return alone.union(once).select("_row.*")
