"""Batches of small record files: a ledger tells what was read, and a bad file is a row with a reason, not a failed job."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from takeoff.functions import rules
from takeoff.sources import files

LEDGER = "path string, size bigint, modified timestamp, rows bigint, reason string, batch string"
FILE_KEY = ["path", "size", "modified"]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and modified of every file below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty before the first batch."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def parsed_files(spark: SparkSession, pending: DataFrame, schema: T.StructType) -> DataFrame:
    """The ledger's columns and `records` of each pending file, which holds an array of JSON records.

    The files' names are on the driver anyway, where Spark lists them; their contents are read by tasks, a file a row, up to the size that is
    admitted. A file without the right extension or size, of broken UTF-8, without valid JSON or without records has a reason.
    """
    told = files.admit_files(pending, F.col("path"), F.col("size"), extensions=[".json", ".txt"])
    paths = [r["path"] for r in told.where("rejected IS NULL").select("path").toLocalIterator()]
    refused = told.where("rejected IS NOT NULL").select(*FILE_KEY, F.lit(None).cast(T.ArrayType(schema)).alias("records"), F.col("rejected").alias("reason"))
    if not paths:
        return refused.withColumn("rows", F.lit(0).cast("bigint"))
    content = spark.read.format("binaryFile").load(paths).select("path", F.col("content").cast("string").alias("text"))
    read = told.where("rejected IS NULL").select(*FILE_KEY).join(content, "path")
    whole = F.is_valid_utf8("text")
    json = F.when(whole & F.col("text").rlike(r"[\]}]\s*\z"), F.try_parse_json("text")).isNotNull()  # the parser alone passes over what follows
    read = read.withColumn("records", F.when(json, F.from_json("text", T.ArrayType(schema))))
    reason = rules.chain([(~whole, F.lit("encoding")), (~json, F.lit("json")), (F.coalesce(F.size("records"), F.lit(0)) <= 0, F.lit("empty"))])
    return read.select(*FILE_KEY, "records", reason.alias("reason")).union(refused).withColumn("rows", F.when(F.col("reason").isNull(), F.size("records")).otherwise(0).cast("bigint"))


def load_batch(spark: SparkSession, folder: str, ledger: str, out: str, schema: T.StructType) -> DataFrame:
    """Read the files that the ledger doesn't have as they are now, append their records to `out`, and return the ledger's new rows.

    Records are written before the ledger: a batch that is lost between the two is read again.
    """
    name = uuid.uuid4().hex
    done = read_ledger(spark, ledger)
    pending = listed(spark, folder).join(done.select(*FILE_KEY), FILE_KEY, "left_anti")
    batch = parsed_files(spark, pending, schema).persist()
    try:
        batch.where("reason IS NULL").select(F.explode("records").alias("r")).select("r.*").write.mode("append").parquet(out)
        batch.select(*FILE_KEY, "rows", "reason", F.lit(name).alias("batch")).write.mode("append").parquet(ledger)
    finally:
        batch.unpersist()
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("batch") == name)


def batch_outcome(rows: DataFrame) -> DataFrame:
    """Files and records by reason; a null reason stands for files that were read."""
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
