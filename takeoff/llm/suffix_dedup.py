"""Removal of byte strings of a given length that occur more than once, by sorting suffixes.

Sorting every suffix of a corpus isn't needed. Each start of a 400-byte string is given an anchor: the place within its first
257 bytes where a hash of 32 bytes is least. Equal strings have their anchors at the same distance, so it is enough to sort the
suffixes at anchors (about 1 of 128 bytes) and the reversed text before them, and to ask for each distance d which anchors
agree in d bytes to the left and 400 - d to the right. Both orders come from deep-shallow sorting; their common prefixes
give the classes for all d.

 1. An anchor's first 144 bytes lie in all its strings: anchors whose key (a hash of those) occurs once are dropped.
 2. Anchors with the same whole surroundings are one class with a count, however many copies there are. One of each class goes
    on, so hot passages are small when they are sorted.
 3. Classes are sorted with those of the same key, some thousands at a time. A key with more classes than `HOT_CLASSES` is
    split: by distance, 16 at a time, and by the 385 bytes that these strings have in common.
 4. The repeated starts of a class hold for all its anchors, and so for the texts.

Null text: empty. Exact copies are keyed by the MD5 of the text, so neither nulls nor repeats in doc_id matter; every row gives a
row. Texts shorter than the length lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, per_text, shipped, staged
from takeoff.llm.suffixes import deep_shallow

LENGTH, KEY, GRAM = 400, 144, 32
REACH = LENGTH - KEY + 1  # places that can be the anchor of a start
HOT_CLASSES, SPLIT = 4096, 16
CHUNK_STARTS = 1 << 22
CHUNK_ROWS = 16_384
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def least_places(block: np.ndarray) -> np.ndarray:
    """For each start, the place in its reach whose 32 bytes have the least hash; the first of equal ones."""
    n = len(block) - GRAM + 1
    words = np.ndarray((len(block) - 7,), "<u8", block, strides=(1,))
    h = words[:n] * MIX[0]
    for k in range(1, 4):
        h += words[8 * k : 8 * k + n] * MIX[k]
        h ^= h >> np.uint64(29)
    h *= MIX[0]
    h = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = h
    full = full.reshape(-1, REACH)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(block) - LENGTH + 1
    return (np.minimum(behind[:starts], ahead[REACH - 1 : REACH - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(text: bytes) -> list[tuple[int, int, int]]:
    """(first start, number of starts, anchor) of each run of starts with one anchor."""
    out, data = [], np.frombuffer(text, np.uint8)
    for at in range(0, len(text) - LENGTH + 1, CHUNK_STARTS):
        places = least_places(data[at : at + CHUNK_STARTS + LENGTH - 1])
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        runs = np.diff(np.append(first, len(places)))
        out += zip((at + first).tolist(), runs.tolist(), (at + places[first]).tolist())
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(tk, start, starts, rel: anchor minus start, key, h1, h2: hash of the whole surroundings), a row per run."""
    def measure(texts: list[bytes]) -> list:
        out = []
        for t in texts:
            rows = []
            for s, n, a in anchors(t):
                h = xxhash.xxh3_128_intdigest(t[s : s + n - 1 + LENGTH], a - s)
                rows.append((s, n, a - s, signed(xxhash.xxh3_64_intdigest(t[a : a + KEY])), signed(h >> 64), signed(h & (2**64 - 1))))
            out.append(rows)
        return [out]

    rows = per_text(docs, measure, "runs array<struct<start: int, starts: int, rel: int, key: bigint, h1: bigint, h2: bigint>>", ("tk",))
    return rows.select("tk", F.explode("runs").alias("r")).select("tk", "r.*")


def surroundings(joined: DataFrame) -> DataFrame:
    """A row for each class, or for each part of a hot one: what lies left of its anchor, from the anchor on, and the distances to decide."""
    shipped(joined.sparkSession)
    columns = "bucket bigint, key bigint, h1 bigint, h2 bigint, n bigint, least int, most int, left binary, right binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("least", pa.int32()),
                            ("most", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
        for batch in batches:
            for text, members in zip(batch.column("text"), batch.column("members")):
                t, rows = text.as_py().encode(), []
                for m in members.as_py():
                    a = m["start"] + m["rel"]
                    least, most = m["rel"] - m["starts"] + 1, m["rel"]
                    parts = [(m["key"], least, most)]
                    if m["hot"]:
                        parts = [(d, max(d, least), min(d + SPLIT - 1, most)) for d in range(least - least % SPLIT, most + 1, SPLIT)]
                        # what all strings at distances d to d + 15 hold, whether or not this class has all of these distances
                        parts = [(signed(xxhash.xxh3_64_intdigest(t[a - d : a + LENGTH - d - SPLIT + 1], d)), lo, hi) for d, lo, hi in parts]
                    rows += [(b, m["key"], m["h1"], m["h2"], m["n"], lo, hi, t[a - hi : a], t[a : a + LENGTH - lo]) for b, lo, hi in parts]
                for i in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096]), schema)], schema=schema)

    return joined.mapInArrow(run, columns)


def repeated_distances(left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray, n: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each member the ranges of distances d at which its string, d bytes before the anchor to 400 - d after, occurs twice or more."""
    size = len(left)
    by_right, right_shared = deep_shallow(right)
    by_left, left_shared = deep_shallow([x[::-1] for x in left])
    twice = np.zeros((size, int(most.max()) + 3), bool)
    of_right, of_left = np.empty(size, np.int64), np.empty(size, np.int64)
    for d in range(int(least.min()), int(most.max()) + 1):
        now = np.flatnonzero((least <= d) & (d <= most))
        if not len(now):
            continue
        of_right[by_right] = np.cumsum(right_shared < LENGTH - d)
        of_left[by_left] = np.cumsum(left_shared < d) if d else 0
        both = of_right[now] * (size + 1) + of_left[now]
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(both[order]) != 0))
        total = np.add.reduceat(n[now][order], first)
        twice[now[order], d + 1] = np.repeat(total > 1, np.diff(np.append(first, len(now))))
    change = np.diff(twice.astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    for (i, lo), (_, hi) in zip(np.argwhere(change == 1).tolist(), np.argwhere(change == -1).tolist()):
        out[i].append((lo, hi - 1))
    return out


def decided(rows: DataFrame) -> DataFrame:
    """(key, h1, h2, ranges) of classes with repeated strings. Whole buckets are sorted together, some thousand rows at a time."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column("bucket").to_numpy()
            if held and sum(x.num_rows for x in held) >= CHUNK_ROWS:
                cut = int(np.searchsorted(b, held[-1].column("bucket")[-1].as_py(), "right"))
                if cut < batch.num_rows:
                    yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for t in chunks(batches):
            got = repeated_distances(t.column("left").to_pylist(), t.column("right").to_pylist(), *(t.column(c).to_numpy().astype(np.int64) for c in ("least", "most", "n")))
            some = [i for i, r in enumerate(got) if r]
            ranges = pa.array([[{"lo": lo, "hi": hi} for lo, hi in got[i]] for i in some], kind)
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(pa.array(some, pa.int64())).combine_chunks() for c in ("key", "h1", "h2")), ranges], names=["key", "h1", "h2", "ranges"])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key bigint, h1 bigint, h2 bigint, ranges array<struct<lo: int, hi: int>>")


def repeated_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes, spans (maximal runs of bytes to remove: start, end) and kept_sha256 of the remaining bytes; a row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*keep, text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tk"))
    found = anchor_rows(keyed)
    # a table of its own, not an aggregate below the join: so Spark can split a hot key's anchors in the join
    often = staged(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    found = staged(found.join(often, "key"), "anchors")
    classes = staged(found.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "start", "starts", "rel")).alias("one")), "classes")
    hot = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_CLASSES).select("key", F.lit(True).alias("hot"))
    split = F.coalesce("hot", F.lit(False)).alias("hot")
    members = classes.join(hot, "key", "left").select("one.tk", F.struct("key", "h1", "h2", "n", "one.start", "one.starts", "one.rel", split).alias("m"))
    lists = members.groupBy("tk").agg(F.collect_list("m").alias("members"))
    ranges = decided(surroundings(lists.join(keyed, "tk").select("tk", "text", "members").dropDuplicates(["tk"]).select("text", "members")))
    starts = found.join(ranges, ["key", "h1", "h2"]).select("tk", F.explode("ranges").alias("d"), (F.col("start") + F.col("rel")).alias("a")).select(
        "tk", F.struct((F.col("a") - F.col("d.hi")).alias("first"), (F.col("a") - F.col("d.lo")).alias("last")).alias("s"))
    of_text = starts.groupBy("tk").agg(F.sort_array(F.collect_set("s")).alias("repeated"))
    return cut_out(keyed.join(of_text, "tk", "left"), keep)


def cut_out(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Joins the removed strings of each text to maximal spans and hashes what is left."""
    def merged(repeated: list[dict]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for r in repeated:
            lo, hi = r["first"], r["last"] + LENGTH
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, spans, hashes = [], [], []
            for text, repeated in zip(batch.column("text"), batch.column("repeated")):
                t = text.as_py().encode()
                cut = merged(repeated.as_py() or [])
                h, at = hashlib.sha256(), 0
                for lo, hi in cut:
                    h.update(t[at:lo])
                    at = hi
                h.update(t[at:])
                sizes.append(len(t)), spans.append([{"start": lo, "end": hi} for lo, hi in cut]), hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(hashes, pa.string())],
                                             names=[*keep, "n_bytes", "spans", "kept_sha256"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "text", "repeated").mapInArrow(run, f"{fields}, n_bytes bigint, spans array<struct<start: int, end: int>>, kept_sha256 string")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
