"""Helpers shared by the operators: staged tables, text batches, held-out rows, bounded samples, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Sizes of so many groups are broadcast.
BROADCAST_GROUPS = 10_000
#: Tables of so many keys (20 bytes each or so) are broadcast, larger ones joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Python works on so many bytes of text at a time, whatever the size of Spark's Arrow batches.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh one only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("takeoff.shared.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("takeoff.shared.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_few(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def few(keys: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows, else never."""
    return F.broadcast(keys) if is_few(keys) else shuffled(keys)


def shuffled(df: DataFrame) -> DataFrame:
    """The table, never to be broadcast whole in a join: Spark guesses its size from files and column widths, without the rows that an
    explode makes or what a file's compression saves, and may take millions of rows for a small table."""
    return df.hint("merge")


def shipped(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application: their Python needn't have it installed."""
    if spark.conf.get("takeoff.shipped", None) == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "takeoff.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("takeoff.shipped", spark.sparkContext.applicationId)


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of about BATCH_BYTES: first row and its texts as bytes, null as empty."""
    values = column.cast(pa.large_binary())
    start, held, size = 0, [], 0
    for i, v in enumerate(values):
        b = v.as_py() or b""
        held.append(b)
        size += len(b)
        if size >= BATCH_BYTES:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def per_text(df: DataFrame, measure: Callable[[list[bytes]], list], columns: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and those that `measure` gives for a list of texts: one list or array for each of `columns`, a DDL string.

    The text is a column, or a field `kept.field` of a kept one, which then is sent to Python once only.
    """
    shipped(df.sparkSession)
    added = T.StructType.fromDDL(columns)
    schema = T.StructType([df.schema[k] for k in keep] + added.fields)
    n = len(keep)
    inside = text.split(".") if text.partition(".")[0] in keep and "." in text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(added)
        for batch in batches:
            column = pc.struct_field(batch.column(keep.index(inside[0])), inside[1]) if inside else batch.column(n)
            for start, texts in text_batches(column):
                kept = batch.slice(start, len(texts))
                got = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(measure(texts), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns[:n], *got], names=[*kept.schema.names[:n], *arrow.names])

    sent = df.select(*keep) if inside else df.select(*keep, F.col(text).cast("string").alias("_text"))
    return sent.mapInArrow(run, schema)


def bounded(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, spread by a hash of the key, the same rows in every run over the same data."""
    return df.orderBy(F.xxhash64(key), key).limit(limit)


def few_of_each(df: DataFrame, group: str, by: list[str], limit: int) -> DataFrame:
    """At most `limit` rows of each group that isn't null, the same in every run, spread by a hash of the columns `by`.

    Groups are counted first, and only about four times `limit` rows of a large one (all of a small one) are ever gathered.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        sizes = F.broadcast(sizes)  # else the join would deal all rows out by group first
    mark = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    some = df.join(sizes, group).where(mark * F.col("_n") < (1 << 30) * 4 * limit)
    ranked = some.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(*by), *by)))
    return ranked.where(F.col("_k") <= limit).drop("_n", "_k")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component: its smallest reachable node) for an edge list (a, b) of longs; nodes without an edge don't show.

    Alternating large-star and small-star steps: each points a node's neighbours to the smallest one it sees, so no step
    gathers a neighbourhood, and a path of n nodes needs about log n rounds. Each round is a table in the shared folder.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: a > b. Large star: every neighbour above a node goes to the least neighbour; small star: the node and those below.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        seen = both.join(shuffled(least), "a")
        out = seen.where("b > a") if large else seen.where("b <> m")
        moved = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    for _ in range(rounds if before[0] else 0):
        e = staged(star(star(e, True), False), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components are still moving after {rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))).distinct()
