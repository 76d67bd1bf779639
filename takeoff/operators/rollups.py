"""Bill-of-quantities roll-ups and category reports."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import names, rules
from takeoff.functions.numbers import MONEY, money, round_half
from takeoff.operators import quality


def trade_rollup(items: DataFrame) -> DataFrame:
    """Per-project trade, division and material sums in one pass over active priced items.

    The amount is turned into a decimal once; every conditional sum reuses it.
    """
    amount = money(F.col("comp_unit_price") * F.col("quantity"))
    base = quality.active_priced(items).select(
        "project_id", "trade", "division", "item_name", amount.alias("amount"), money(F.col("quantity")).alias("qty"))
    zero = F.lit(0).cast(MONEY)

    def total(condition: Column, value: str, name: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(zero)).cast("double").alias(name)

    def has(column: str, *words: str) -> Column:
        return reduce(lambda a, b: a | b, [F.col(column).contains(w) for w in words])

    return base.groupBy("project_id").agg(
        total(has("trade", "建筑", "土建"), "amount", "arch_cost"),
        total(has("trade", "装饰"), "amount", "deco_cost"),
        total((F.col("trade") == "装修") | has("trade", "安装"), "amount", "inst_cost"),
        total(has("division", "基础"), "amount", "foundation_cost"),
        total(has("division", "主体", "结构"), "amount", "structure_cost"),
        total(has("division", "屋面", "楼地面"), "amount", "roof_cost"),
        total(has("division", "外墙"), "amount", "wall_cost"),
        total(has("item_name", "混凝土", "砼"), "qty", "concrete_total"),
        total(has("item_name", "钢筋", "螺纹钢"), "qty", "rebar_total"),
        total(has("item_name", "砌块", "砖"), "qty", "block_total"),
        F.count(F.lit(1)).alias("item_count"),
        F.countDistinct("division").alias("division_count"),
        F.sum("amount").cast("double").alias("total_boq_cost"),
    )


def global_ratios(rollup: DataFrame) -> DataFrame:
    """Overall trade ratios, one row: split decoration when installation is zero, smooth a building share above 0.80."""
    d_arch, d_deco, d_inst = C.TRADE_RATIO_DEFAULTS
    b_arch, b_deco, b_inst = C.TRADE_RATIO_BENCHMARK
    sums = rollup.agg(*[F.coalesce(F.sum(F.col(c).cast("decimal(28,4)")).cast("double"), F.lit(0.0)).alias(c)
                        for c in ("arch_cost", "deco_cost", "inst_cost")])
    split = (F.col("inst_cost") == 0) & (F.col("deco_cost") > 0)
    parts = sums.select(
        F.col("arch_cost").alias("a"),
        F.when(split, F.col("deco_cost") * 0.5).otherwise(F.col("deco_cost")).alias("d"),
        F.when(split, F.col("deco_cost") * 0.5).otherwise(F.col("inst_cost")).alias("i"),
    ).withColumn("t", F.col("a") + F.col("d") + F.col("i"))
    raw = parts.select(
        F.when(F.col("t") > 0, F.col("a") / F.col("t")).otherwise(d_arch).alias("a"),
        F.when(F.col("t") > 0, F.col("d") / F.col("t")).otherwise(d_deco).alias("d"),
        F.when(F.col("t") > 0, F.col("i") / F.col("t")).otherwise(d_inst).alias("i"),
        (F.col("t") > 0).alias("known"))
    high = F.col("known") & (F.col("a") > 0.80)
    smooth = raw.select(
        F.when(high, F.col("a") * 0.5 + 0.5 * b_arch).otherwise(F.col("a")).alias("a"),
        F.when(high, F.col("d") * 0.5 + 0.5 * b_deco).otherwise(F.col("d")).alias("d"),
        F.when(high, F.col("i") * 0.5 + 0.5 * b_inst).otherwise(F.col("i")).alias("i"))
    whole = F.col("a") + F.col("d") + F.col("i")
    return smooth.select((F.col("a") / whole).alias("arch_ratio"), (F.col("d") / whole).alias("deco_ratio"),
                         (F.col("i") / whole).alias("inst_ratio"))


def active_items(items: DataFrame, project_id=None) -> DataFrame:
    """Active items of all projects or of one."""
    active = items.filter(F.col("is_active") == 1)
    return active if project_id is None else active.filter(F.col("project_id") == F.lit(project_id))


def item_training_rows(items: DataFrame) -> DataFrame:
    """Active priced items with the division filled from the code prefix and neutral project features."""
    return quality.active_priced(items).select(
        "project_id", "boq_code", names.division_of_prefix2(F.col("division"), F.col("boq_code")).alias("division"),
        "trade", "unit", "quantity", "comp_unit_price", "is_active",
        F.lit("未知").alias("building_type"), F.lit("未知").alias("structure_type"), F.lit("未知").alias("location"),
        F.lit(0).alias("above_ground_floors"), F.lit(0).alias("total_area"), F.lit(2020).alias("build_year"))


def division_trade_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(
        F.coalesce("division", F.lit("未分类")).alias("division"), F.coalesce("trade", F.lit("未分类")).alias("trade")
    ).agg(F.count(F.lit(1)).alias("n"))


def joined_sums(items: DataFrame, projects: DataFrame, group: str) -> DataFrame:
    """Item counts and conditional sums by a project column; items are summed per project before the join."""
    per_project = items.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(money(F.col("total_price"))).alias("total"),
        F.sum(F.when(F.col("comp_unit_price_adj").isNotNull(), money(F.col("total_price_adj")))).alias("adjusted"))
    return per_project.join(projects.select("project_id", group), "project_id").groupBy(group).agg(
        F.count(F.lit(1)).alias("projects"), F.sum("items").alias("items"),
        F.sum("total").cast("double").alias("total_price"),
        F.sum("adjusted").cast("double").alias("total_price_adj"))


def typical_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.TYPICAL_PRICE_RANGES, "type_word string, typical_low double, typical_high double")


def type_price_band(projects: DataFrame) -> DataFrame:
    """Count, min, max and mean price for each type word, next to the typical range.

    Projects are first reduced to one row a building type; a type may hold
    several words, so the small result is matched with the eight words.
    """
    price = F.col("unit_price").try_cast("double")
    per_type = projects.groupBy("building_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(price).alias("priced"), F.min(price).alias("low"),
        F.max(price).alias("high"), F.sum(money(price)).alias("total"))
    words = F.array(*[F.struct(F.lit(w).alias("type_word")) for w, _, _ in C.TYPICAL_PRICE_RANGES])
    matched = per_type.select("*", F.explode(words).alias("w")).filter(
        F.coalesce(F.col("building_type").contains(F.col("w.type_word")), F.lit(False)))
    bands = matched.groupBy(F.col("w.type_word").alias("type_word")).agg(
        F.sum("n").alias("n"), F.min("low").alias("price_min"), F.max("high").alias("price_max"),
        (F.sum("total").cast("double") / F.nullif(F.sum("priced"), F.lit(0))).alias("mean"))
    return typical_ranges(projects.sparkSession).join(bands, "type_word", "left").select(
        "type_word", "typical_low", "typical_high", F.coalesce("n", F.lit(0)).alias("n"), "price_min", "price_max",
        round_half(F.col("mean"), 4).alias("price_mean"), F.col("n").isNotNull().alias("from_data"))


def steel_scale(df: DataFrame, steel_per_m2: Column) -> DataFrame:
    """Factor that brings steel use to kg/m²: 1000 when the median of the positive values is below 1, else 1.

    The median is not computed: how many values lie below 1, and the two values
    next to 1, decide on which side of 1 it falls.
    """
    v = F.when(steel_per_m2 > 0, steel_per_m2.cast("double"))
    one = df.agg(F.count(v).alias("n"), F.count(F.when(v < 1, 1)).alias("below"),
                 F.max(F.when(v < 1, v)).alias("last_below"), F.min(F.when(v >= 1, v)).alias("first_above"))
    half = (F.col("n") % 2 == 0) & (F.col("below") * 2 == F.col("n")) & (F.col("n") > 0)
    in_tonnes = F.when(half, (F.col("last_below") + F.col("first_above")) / 2 < 1).otherwise(
        F.col("below") * 2 > F.col("n"))
    return one.select("n", F.when(in_tonnes, 1000.0).otherwise(1.0).alias("factor"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return quality.value_counts(df, F.col(column), column)


def sheet_labor(rows: DataFrame, by_sheet: bool) -> DataFrame:
    """Labour total over all sheets or per sheet."""
    keys = ["project_id", "sheet_name"] if by_sheet else ["project_id"]
    return rows.groupBy(*keys).agg(F.sum(money(F.col("labor"))).cast("double").alias("labor"))
