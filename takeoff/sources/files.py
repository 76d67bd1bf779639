"""Readers and writers: flat tables, JSON history, parquet tables, file listings."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from takeoff import constants as C
from takeoff.functions import names, rules


#: Lines of a piece of a split, as a power of two.
PIECE_BITS = 14


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of flat files whose quoted cells may hold line breaks, with files read by many tasks.

    Lines are read in splits, and a split is worked on in pieces, so that a window sees a piece at most and pieces are dealt evenly to tasks.
    Whether a line begins inside of a cell is the parity of all quotes before it: counted within the piece, and carried over from the pieces
    before, one row a piece. Lines that begin and end outside are records; the others are joined, each under the line where its cell
    began. `first` is true for a file's first record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value",
        F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2)).alias("odd"))
    # a split is read by one task, where places rise
    lines = lines.withColumn("split", F.struct("split", F.shiftright("place", PIECE_BITS).alias("piece")))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("_odd", F.coalesce(F.sum("odd").over(inside), F.lit(0)) % 2)
    # of each piece (from here on, a split is a piece of it): parity, and its last line that begins outside of a cell, for either parity before it
    ends = counted.groupBy("file", "split").agg(
        F.min("place").alias("_head"), F.pmod(F.sum("odd"), F.lit(2)).alias("_parity"), *[F.max(F.when(F.col("_odd") == p, F.col("place"))).alias(f"_last{p}") for p in (0, 1)])
    over = before.partitionBy("file").orderBy("split")
    carried = ends.withColumn("_carry", F.coalesce(F.sum("_parity").over(over), F.lit(0)) % 2)
    carried = carried.withColumn("_last", F.when(F.col("_carry") == 0, F.col("_last0")).otherwise(F.col("_last1")))
    carried = carried.withColumn("_open", F.last(F.when(F.col("_last").isNotNull(), F.struct("split", F.col("_last").alias("place"))), ignorenulls=True).over(over))
    carried = carried.withColumn("_head", F.first("_head").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    known = counted.join(carried.select("file", "split", "_carry", "_open", "_head"), ["file", "split"])
    starts = (F.col("_odd") + F.col("_carry")) % 2 == 0
    own = F.last(F.when(starts, F.struct("split", "place")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("_whole", starts & (F.col("odd") == 0)).withColumn("_at", F.coalesce(own, "_open")).withColumn("first", F.col("_at.place") == F.col("_head"))
    single = known.where("_whole").select("file", "first", F.col("value").alias("record"))
    pieces = known.where("not _whole").groupBy("file", "_at").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", "place", "value"))).alias("_v"))
    joined = pieces.select("file", "first", F.array_join(F.transform("_v", lambda v: v["value"]), "\n").alias("record"))
    return single.union(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_flat(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv", line_breaks: bool = True) -> DataFrame:
    """Flat table with a header row; bad cells become null, rows without any value are dropped, reading goes on behind them.

    Quoted cells may hold line breaks, commas and doubled quotes; a quote stands in quoted cells only. Files are read by many
    tasks either way; those known to hold no line breaks are read straight, without joining lines.
    """
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    if kind == "csv" and line_breaks:
        records = quoted_records(spark, path).where(~F.col("first") & (F.trim("record") != ""))
        df = records.select(F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), options).alias("_r")).select("_r.*")
    elif kind == "csv":
        df = spark.read.schema(schema).options(header=True, **options).csv(path)
    else:
        df = spark.read.schema(schema).format(kind).load(path)
    return df.dropna("all")


def write_flat(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.options(header=True, quote='"', escape='"').csv(path) if kind == "csv" else writer.format(kind).save(path)


def read_history(spark: SparkSession, path: str, schema: T.StructType | None = None, array: bool = False) -> DataFrame:
    """JSON history: one record a line, as `write_history` leaves it, or files that hold one array each.

    Files of lines are split among tasks; an array file is one task's, since its records end nowhere in particular.
    """
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def write_history(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of named sources; weight and grade are filled only where the source has no such column."""
    tagged = []
    for name, df in sources.items():
        real = "real" in name
        if "_sample_weight" not in df.columns:
            df = df.withColumn("_sample_weight", F.lit(1.0 if real else 0.7))
        if "source_type" not in df.columns:
            df = df.withColumn("source_type", F.lit("A" if real else "B"))
        tagged.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def admit_files(files: DataFrame, path: Column, size: Column, extensions: list[str] = C.ALLOWED_EXTENSIONS) -> DataFrame:
    """Reason why a listed file is not accepted, null for accepted files."""
    ext = names.extension(path)
    return files.withColumn("extension", ext).withColumn(
        "rejected",
        rules.chain([(~ext.isin(extensions), F.lit("extension")),
                     (size > C.MAX_FILE_BYTES, F.lit("size"))]),
    )

