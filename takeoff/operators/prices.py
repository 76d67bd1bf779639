"""Price normalisation to the base year."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions.numbers import money, round_half


def price_index(spark: SparkSession) -> DataFrame:
    rows = [(y, v, v, v) for y, v in C.PRICE_INDEX]
    return spark.createDataFrame(rows, "year int, labor_index double, material_index double, adjustment_factor double")


def seeded_price_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        C.SEEDED_PRICE_INDEX, "year int, labor_index double, material_index double, adjustment_factor double")


def index_report(index: DataFrame, projects: DataFrame) -> DataFrame:
    """The price index in year order, with the number of projects of each year."""
    built = projects.groupBy(F.col("build_year").alias("year")).agg(F.count(F.lit(1)).alias("projects"))
    return index.join(built, "year", "left").withColumn("projects", F.coalesce("projects", F.lit(0).cast("bigint"))).orderBy("year")


def project_factors(projects: DataFrame, index: DataFrame, base_year: int = C.PRICE_BASE_YEAR) -> DataFrame:
    """Deflation factor of every project, 1 for an unknown year.

    The index has one row a calendar year; Spark broadcasts it by its size.
    """
    base = index.filter(F.col("year") == base_year).select("adjustment_factor").scalar()
    factors = index.select(
        F.col("year").alias("build_year"), round_half(base / F.col("adjustment_factor"), 6).alias("_factor"))
    return projects.select("project_id", "build_year").join(factors, "build_year", "left").select(
        "project_id", "build_year", F.coalesce("_factor", F.lit(1.0)).alias("factor"),
        F.col("_factor").isNotNull().alias("year_known"))


def normalize_prices(items: DataFrame, projects: DataFrame, index: DataFrame,
                     base_year: int = C.PRICE_BASE_YEAR) -> DataFrame:
    """Fill the adjusted prices of items that have none; items already adjusted stay as they are."""
    factors = project_factors(projects, index, base_year).drop("build_year")
    open_item = F.col("comp_unit_price_adj").isNull() & F.col("factor").isNotNull()

    def adjusted(price: str, current: str) -> Column:
        new = F.when(F.col("year_known"), round_half(F.col(price) * F.col("factor"), 4)).otherwise(F.col(price))
        return F.when(open_item, new).otherwise(F.col(current))

    return items.join(factors, "project_id", "left").withColumns({
        "price_adjust_factor": F.when(open_item, F.col("factor")).otherwise(F.col("price_adjust_factor")),
        "price_base_year": F.when(open_item, F.lit(base_year)).otherwise(F.col("price_base_year")),
        "total_price_adj": adjusted("total_price", "total_price_adj"),
        "comp_unit_price_adj": adjusted("comp_unit_price", "comp_unit_price_adj"),
    }).drop("factor", "year_known")


def price_report(items: DataFrame) -> DataFrame:
    """Counts and before/after means of a normalised item table, one row."""
    used = ((F.col("is_active") == 1) & (F.col("comp_unit_price") > 0)
            & (F.col("comp_unit_price_adj") > 0))

    def mean(c: str) -> Column:
        v = F.when(used, F.col(c))
        return F.sum(money(v)).cast("double") / F.nullif(F.count(v), F.lit(0))

    one = items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count(F.when(F.col("comp_unit_price_adj").isNull(), 1)).alias("open_items"),
        F.count(F.when(F.col("price_adjust_factor") != 1.0, 1)).alias("adjusted_items"),
        mean("comp_unit_price").alias("p0"), mean("comp_unit_price_adj").alias("p1"),
        mean("total_price").alias("t0"), mean("total_price_adj").alias("t1"),
    )
    return one.select(
        "total_items", "open_items", "adjusted_items",
        (F.col("total_items") - F.col("open_items") - F.col("adjusted_items")).alias("unchanged_items"),
        round_half(F.col("p0"), 4).alias("avg_unit_price"), round_half(F.col("p1"), 4).alias("avg_unit_price_adj"),
        round_half(F.try_divide("p1", "p0"), 4).alias("unit_price_ratio"),
        round_half(F.col("t0"), 4).alias("avg_total_price"), round_half(F.col("t1"), 4).alias("avg_total_price_adj"),
        round_half(F.try_divide("t1", "t0"), 4).alias("total_price_ratio"),
    )


def run_stats(items: DataFrame, projects: DataFrame, index: DataFrame) -> DataFrame:
    """Projects with and without a known year, and items that a run would adjust or leave, per build year.

    Items are counted per project before they meet the projects, so a very large project is one row in the join.
    """
    open_items = items.filter(F.col("comp_unit_price_adj").isNull()).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("items"))
    factors = project_factors(projects, index)
    return (
        factors.join(open_items, "project_id", "left")
        .groupBy(F.when(F.col("year_known"), F.col("build_year")).alias("build_year"), "factor", "year_known")
        .agg(F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))
    )
