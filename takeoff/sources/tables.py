"""Table snapshots on parquet: conform, upsert, delete, update, compare, list."""

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from takeoff import schemas
from takeoff.functions import names, scalars


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The frame in the schema's columns: missing ones added, types tried, defaults put in for nulls."""
    defaults = defaults or {}
    out = []
    for field in schema:
        if field.name in df.columns:
            col = F.col(field.name)
            if df.schema[field.name].dataType != field.dataType:
                col = col.try_cast(field.dataType)
        else:
            col = F.lit(None).cast(field.dataType)
        if field.name in defaults:
            col = F.coalesce(col, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(col.alias(field.name))
    return df.select(*out)


def conform_table(df: DataFrame, table: str) -> DataFrame:
    return conform(df, schemas.TABLES[table][0], schemas.DEFAULTS.get(table))


def add_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Additive evolution: columns of the wanted types where missing; running it again changes nothing."""
    missing = {name: F.lit(None).cast(kind) for name, kind in wanted.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def create_tables(spark: SparkSession, folder: str) -> list[str]:
    """Write an empty snapshot of every typed table that does not exist yet; returns the new ones."""
    made = []
    for name, (schema, _) in schemas.TABLES.items():
        path = os.path.join(folder, name)
        if not table_exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
            made.append(name)
    return made


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = os.path.join(folder, name), os.path.join(folder, f"_{name}_last")
    fs = Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found = aside if fs.exists(Path(aside)) and not fs.exists(Path(target)) else target
    return spark.read.schema(schemas.TABLES[name][0]).parquet(found)


def save(df: DataFrame, folder: str, name: str) -> None:
    """Write a new snapshot to a fresh folder, move the old one aside, move the new one in, then drop the old one.

    A crash at any point leaves a whole snapshot: `load` falls back to the one set aside.
    """
    spark = df.sparkSession
    target, staged, aside = (os.path.join(folder, x) for x in (name, f"_{name}_next", f"_{name}_last"))
    df.write.mode("overwrite").parquet(staged)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(Path(target)):
        fs.delete(Path(aside), True)
        if not fs.rename(Path(target), Path(aside)):
            raise OSError(f"could not set the old snapshot of {target} aside")
    if not fs.rename(Path(staged), Path(target)):
        raise OSError(f"could not move the new snapshot to {target}")
    fs.delete(Path(aside), True)


def append(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(os.path.join(folder, name))


def newest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in the given order.  Spark trims each key to one row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert(current: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """Incoming rows replace rows of the same key; several incoming rows of a key: the first in the order wins."""
    fresh = incoming.withColumn("_age", F.lit(0))
    old = current.withColumn("_age", F.lit(1))
    both = fresh.unionByName(old, allowMissingColumns=True)
    return newest_per_key(both, [key], F.col("_age"), *order).drop("_age")


def insert_missing(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return current.unionByName(incoming.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed: deletes, incremental work lists, rows only one side has."""
    return df.join(keys.select(key), key, "left_anti")


def listed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def find(df: DataFrame, **keys) -> DataFrame:
    """Point look-up by equality; the conditions reach the scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def keys_of(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def upload_record(task_id: Column, filename: Column, uploaded_at: Column, *features: Column) -> list[Column]:
    """Columns of an upload row with its JSON payload and expiry."""
    return [
        task_id.cast("string").alias("task_id"), filename.alias("filename"),
        names.extension(filename).alias("file_format"), uploaded_at.alias("uploaded_at"),
        scalars.as_json(*features).alias("extracted_features"), scalars.expiry(uploaded_at).alias("expires_at"),
    ]


def expired(uploads: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Uploads past their expiry, oldest first; the limit is the batch size of one clean-up run."""
    gone = uploads.filter(F.col("expires_at") < as_of).select("task_id", "expires_at")
    return gone if limit is None else gone.orderBy("expires_at", "task_id").limit(limit)


def orphan_files(files: DataFrame, name: Column, active: DataFrame) -> DataFrame:
    """Stored files whose 8-character id belongs to no upload."""
    tagged = files.withColumn("task_id", F.substring(F.substring_index(name, ".", 1), 1, 8))
    return tagged.filter(F.length("task_id") == 8).join(active.select("task_id"), "task_id", "left_anti")


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top n rows; Spark keeps n rows a partition and merges them."""
    return df.orderBy(*order).limit(n)


def signature(df: DataFrame) -> str:
    return ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: row count and sorted name:type signature."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(signature(df)).alias("signature"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that differ between two snapshots, with what differs."""
    joined = before.alias("b").join(after.alias("a"), "table_name", "full_outer")
    reason = F.array_compact(F.array(
        F.when(F.col("b.row_count").isNull(), F.lit("added")),
        F.when(F.col("a.row_count").isNull(), F.lit("removed")),
        F.when(F.col("b.row_count") != F.col("a.row_count"), F.lit("row_count")),
        F.when(F.col("b.signature") != F.col("a.signature"), F.lit("signature")),
    ))
    return joined.select(
        "table_name", F.col("b.row_count").alias("rows_before"), F.col("a.row_count").alias("rows_after"),
        F.concat_ws(",", reason).alias("difference"),
    ).filter("difference <> ''")


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns and types of the tables, one row a column."""
    rows = [(name, i + 1, f.name, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
