"""Balanced synthetic training sample, the same rows for the same size."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import rules
from takeoff.functions.numbers import round_half

SEED = 42


def _unit(salt: str) -> Column:
    """Even number in [0, 1) that depends on the row id only."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)


def _between(low: Column, high: Column, salt: str) -> Column:
    return low + (high - low) * _unit(salt)


def _pick(values: Column, salt: str) -> Column:
    return F.get(values, F.floor(_unit(salt) * F.size(values)).cast("int"))


def sample_projects(spark: SparkSession, n: int = 80) -> DataFrame:
    """n projects spread evenly over eight types; all attributes are drawn from the row id."""
    ids = spark.range(n)
    types = F.array(*[F.struct(
        F.lit(t).alias("type"), F.lit(float(p)).alias("price"), F.array(*[F.lit(s) for s in ss]).alias("structures"),
        F.lit(a[0]).alias("area_low"), F.lit(a[1]).alias("area_high"), F.lit(f[0]).alias("floor_low"),
        F.lit(f[1]).alias("floor_high"), F.array(*[F.lit(d) for d in ds]).alias("decorations"))
        for t, p, ss, a, f, ds in C.SAMPLE_TYPES])
    regions = F.array(*[F.lit(r) for r in C.REGIONS])

    def whole(low: Column, high: Column, salt: str) -> Column:
        return F.floor(_between(low, high + 1, salt)).cast("int")

    drawn = ids.withColumn("t", F.get(types, (F.col("id") % len(C.SAMPLE_TYPES)).cast("int"))).select(
        "id", "t.type", "t.price", _pick(F.col("t.structures"), "structure").alias("structure"),
        _pick(regions, "region").alias("region"), _pick(F.col("t.decorations"), "decoration").alias("decoration"),
        whole(F.col("t.area_low"), F.col("t.area_high"), "area").alias("area"),
        whole(F.col("t.floor_low"), F.col("t.floor_high"), "floors").alias("floors"),
        whole(F.lit(C.SAMPLE_YEARS[0]), F.lit(C.SAMPLE_YEARS[1]), "year").alias("year"))
    unit = (F.col("price") * rules.lookup(F.col("structure"), C.STRUCTURE_FACTOR, 1.0)
            * rules.lookup(F.col("region"), C.REGION_FACTOR, 1.0)
            * rules.lookup(F.col("decoration"), C.DECORATION_FACTOR, 1.0)
            * _between(F.lit(C.SAMPLE_NOISE[0]), F.lit(C.SAMPLE_NOISE[1]), "noise"))
    priced = drawn.withColumn("unit", unit).withColumn("total", F.col("unit") * F.col("area"))

    def by_type(table: list, other: tuple, salt: str) -> Column:
        low = rules.lookup(F.col("type"), [(t, a) for t, a, _ in table], other[0])
        high = rules.lookup(F.col("type"), [(t, b) for t, _, b in table], other[1])
        return _between(low, high, salt)

    shares = [round_half(F.col("total") * _between(F.lit(r - d), F.lit(r + d), n), 2).alias(n) if d else
              round_half(F.col("total") * r, 2).alias(n) for n, r, d in C.SAMPLE_SHARES]
    concrete = by_type(C.SAMPLE_CONCRETE, C.SAMPLE_CONCRETE_OTHER, "concrete")
    steel = by_type(C.SAMPLE_STEEL, C.SAMPLE_STEEL_OTHER, "steel")
    block = _between(F.lit(C.SAMPLE_BLOCK[0]), F.lit(C.SAMPLE_BLOCK[1]), "block")
    return priced.select(
        F.format_string("%s%s%d年第%03d号项目", "type", "region", "year", F.col("id") + 1).alias("项目名称"),
        F.col("type").alias("建筑类型"), F.col("structure").alias("结构类型"), F.col("area").alias("总建筑面积"),
        F.col("floors").alias("楼层数"), F.col("region").alias("所在地区"), F.col("year").alias("建造年份"),
        F.col("decoration").alias("装修标准"), round_half(F.col("total"), 2).alias("项目总造价"),
        round_half(F.col("unit"), 2).alias("单方造价"), *shares,
        round_half(F.col("area") * concrete, 2).alias("混凝土总用量"), round_half(F.col("area") * steel, 2).alias("钢筋总用量"),
        round_half(F.col("area") * block, 2).alias("砌块总用量"), round_half(concrete, 4).alias("混凝土单方耗量"))


def shuffled(df: DataFrame, *key: Column) -> DataFrame:
    """Rows in an order that depends on a hash of the key."""
    return df.orderBy(F.xxhash64(*key, F.lit(SEED)), *key)
