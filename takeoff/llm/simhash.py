"""SimHash near-duplicates: fingerprints, their links within a Hamming distance of 2, and the components of those links.

Links are found through an embedding: the counts of one bits in 16 segments of 4 bits. Two fingerprints that differ in at
most 2 bits lie at most 2 apart there in Manhattan distance, so some point of the grid is within 1 of both. Every
fingerprint is put in its own cell and the cells one step away (33 at most), and only cells with company go on. In those, the
exact test is made without pairs: fingerprints within 2 bits share a fingerprint within 1 bit of each, so each writes the
ones of the cell and joins the least fingerprint that wrote the same. Links grow with the fingerprints, however many are
alike; equal fingerprints are one node.

Null text: empty. No word: fingerprint zero. A null doc_id keeps its row and never is a component's id, unless all of its
component are null. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from takeoff.llm.common import LOWER, components, documents, per_text, shuffled, staged

SHINGLE, SEED, SEGMENT = 3, 42, 4


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle in order, repeats included; of fewer words that of the whole sequence, none without a word."""
    words = text.translate(LOWER).split()  # bytes split at space and 0x09 to 0x0D
    if not words:
        return np.zeros(0, "<u8")
    parts = [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)))] if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), "<u8", len(parts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits; a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        some = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and `fp`, the fingerprint as a signed long."""
    def measure(texts: list[bytes]) -> list:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return per_text(docs, measure, "fp bigint", keep)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) of distinct fingerprints `fp`; two within 2 bits are joined through the least one that shares a midpoint with them."""
    # each nibble of `v` counts the one bits of that nibble of the fingerprint
    v = sum((F.shiftrightunsigned("fp", b).bitwiseAND(0x1111111111111111) for b in range(1, SEGMENT)), F.col("fp").bitwiseAND(0x1111111111111111))
    counted = fps.select("fp", v.alias("v"))

    def cell(to: Column, step: int) -> Column:  # step: 0 for the own cell, else plus or minus the segment's number from 1
        return F.struct(to.alias("cell"), F.lit(step).cast("byte").alias("step"))

    def beside(j: int) -> list[Column]:
        one = F.shiftleft(F.lit(1).cast("long"), SEGMENT * j)
        ones = F.shiftrightunsigned("v", SEGMENT * j).bitwiseAND(15)
        return [F.when(ones < SEGMENT, cell(F.col("v") + one, j + 1)), F.when(ones > 0, cell(F.col("v") - one, -j - 1))]

    cells = F.array(cell(F.col("v"), 0), *[c for j in range(64 // SEGMENT) for c in beside(j)])
    in_grid = counted.select("fp", F.explode(cells).alias("c")).where("c is not null").select("fp", "c.*")
    company = in_grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    place = lambda b: (F.abs("step").cast("int") - 1) * SEGMENT + b
    # the fingerprints one flipped bit away that lie in this cell: ones to clear for a step down, zeros to set for a step up
    flipped = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.array(*[
        F.when((F.call_function("shiftrightunsigned", F.col("fp"), place(b)).bitwiseAND(1) == 1) == (F.col("step") < 0),
               F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(b))))
        for b in range(SEGMENT)]))
    shared = staged(in_grid.join(shuffled(company), "cell").select("fp", F.explode(flipped).alias("mid")).where("mid is not null"), "midpoints")
    least = shared.groupBy("mid").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.join(shuffled(least), "mid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def grouped(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The kept columns (doc_id among them), fp, component (its least fingerprint) and component_id (its smallest doc_id), a row per document."""
    fps = staged(fingerprints(docs, keep, shingle), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    reached = components(links(nodes.select("fp")))
    labelled = nodes.join(shuffled(reached.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return fps.join(shuffled(labelled.join(shuffled(ids), "component").select("fp", "component", "component_id")), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach), a row per document."""
    return grouped(docs, ("doc_id",), shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest doc_id, then the smallest MD5 of its text."""
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", key.alias("_key"))
    marked = grouped(docs.select("doc_id", "text", key.alias("_key")), ("doc_id", "_key"), shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("f")
    kept = marked.groupBy("component").agg(first).select("f.doc_id", "f._key").distinct()
    found = rows.join(shuffled(kept), rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["_key"] == kept["_key"]), "left_semi")
    once = W.partitionBy("_key", "doc_id").orderBy("doc_id")  # repeated rows of one text and id
    return found.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
