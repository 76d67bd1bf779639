"""Gates, weights, profiles and audits of the project table."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import rules
from takeoff.functions.numbers import money, round_half
from takeoff.operators import quantiles


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct value (scalar subquery) for use in another frame."""
    return df.select(F.struct(*df.columns)).scalar()


def missing_fields(df: DataFrame, required: list[str] = C.REQUIRED_FIELDS) -> list[str]:
    return [f for f in required if f not in df.columns]


def active_priced(items: DataFrame) -> DataFrame:
    return items.filter((F.col("is_active") == 1) & (F.col("comp_unit_price") > 0))


def trainable(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("building_type").isNotNull() & (F.col("unit_price") > 0))


def gate_flags(unit_price: Column, area: Column, cost: Column) -> dict[str, Column]:
    """One flag a drop reason.  Missing or unreadable values pass."""
    low, high = C.UNIT_PRICE_RANGE
    price, area, cost = (c.try_cast("double") for c in (unit_price, area, cost))
    return {
        "bad_unit_price": F.coalesce(~price.between(low, high), F.lit(False)),
        "bad_area": F.coalesce(area <= 0, F.lit(False)),
        "bad_cost": F.coalesce(cost <= 0, F.lit(False)),
    }


def quality_gate(df: DataFrame, unit_price: Column, area: Column, cost: Column) -> DataFrame:
    """Rows that pass every gate rule."""
    flags = gate_flags(unit_price, area, cost)
    return df.filter(~reduce(lambda a, b: a | b, flags.values()))


def drop_reasons(df: DataFrame, unit_price: Column, area: Column, cost: Column) -> DataFrame:
    """Kept and dropped rows and the count of every reason, in one pass."""
    flags = gate_flags(unit_price, area, cost)
    any_bad = reduce(lambda a, b: a | b, flags.values())
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(~any_bad, 1)).alias("kept"),
        F.count(F.when(any_bad, 1)).alias("dropped"),
        *[F.count(F.when(flag, 1)).alias(name) for name, flag in flags.items()],
    )


def sample_weight(df: DataFrame) -> Column:
    """Weight of a row by source grade and confidence; a fixed low weight when the table has no grade."""
    if "source_type" not in df.columns:
        return F.lit(C.NO_SOURCE_WEIGHT)
    label = F.col("data_confidence") if "data_confidence" in df.columns else F.lit("")
    return rules.chain([((F.col("source_type") == g) & (label == c), F.lit(w)) for g, c, w in C.SAMPLE_WEIGHTS],
                       C.OTHER_SAMPLE_WEIGHT)


def grade_of(source: Column, label: Column) -> Column:
    return rules.chain([((source == g) & (label == c), F.lit(g)) for g, c, _ in C.SAMPLE_WEIGHTS], "C")


def grade_weight(grade: Column) -> Column:
    return rules.lookup(grade, C.GRADE_WEIGHT, 0.5)


def grade_label(grade: Column) -> Column:
    return rules.lookup(grade, C.GRADE_CONFIDENCE_LABEL, "low")


def label_confidence(label: Column) -> Column:
    return rules.lookup(label, C.LABEL_CONFIDENCE, 0.5)


def source_grade(has_info: Column, sheets: dict[str, Column]) -> Column:
    """A with an info sheet; B with all key sheets or the quantity sheet; else C."""
    all_sheets = reduce(lambda a, b: a & b, sheets.values())
    return F.when(has_info, "A").when(all_sheets | sheets["表-21"], "B").otherwise("C")


def filled_share(cols: list[Column]) -> Column:
    """Share of the columns that are not null."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols]) / F.lit(float(len(cols)))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column with its null count; all columns counted in one pass."""
    one = df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_count")


def range_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max and mean over the positive values of each column."""
    aggs = []
    for c in columns:
        v = F.when(F.col(c) > 0, F.col(c))
        aggs += [F.struct(F.min(v).alias("min"), F.max(v).alias("max"),
                          (F.sum(money(v)).cast("double") / F.count(v)).alias("avg")).alias(c)]
    wide = df.agg(*aggs)
    return wide.unpivot([], columns, "column_name", "s").select(
        "column_name", F.col("s.min").alias("min_value"), F.col("s.max").alias("max_value"),
        round_half(F.col("s.avg"), 4).alias("avg_value"))


def value_counts(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def fill_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows above zero and their percentage for each column."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in columns])
    return wide.unpivot(["_rows"], columns, "column_name", "non_zero").select(
        "column_name", "non_zero", "_rows",
        round_half(F.col("non_zero") / F.nullif(F.col("_rows"), F.lit(0)) * 100, 1).alias("pct"),
    ).withColumnRenamed("_rows", "total")


def feature_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample variance of each column and whether it carries no information."""
    wide = df.agg(*[F.coalesce(F.var_samp(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "variance").withColumn("is_constant", F.col("variance") == 0)


def duplicate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in all, keys that occur more than once, and the rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"),
        F.sum(F.col("n") - 1).alias("surplus_rows"))


def coexistence_audit(df: DataFrame, name: str, marker: str) -> DataFrame:
    """Names that have rows both with and without the marker column."""
    return df.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.count(marker).alias("with_marker")
    ).filter("with_marker > 0 and with_marker < n")


def sufficiency(df: DataFrame, type_col: str, region_col: str, numeric: list[str], simulated: Column) -> DataFrame:
    """Score of a training table: 100 less penalties, with the issues named.

    Types and regions are counted first, so only as many rows as there are
    different types or regions meet in the final one-row result.
    """
    base = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count(F.when(simulated, 1)).alias("simulated_samples"),
        *[F.coalesce(F.var_samp(F.col(c).cast("double")), F.lit(0.0)).alias(f"var_{c}") for c in numeric],
    )
    types = df.groupBy(type_col).agg(F.count(F.lit(1)).alias("n")).agg(
        *[F.coalesce(F.max(F.when(F.col(type_col) == t, F.col("n"))), F.lit(0)).alias(f"type_{i}")
          for i, t in enumerate(C.SUFFICIENCY_CATEGORIES)])
    regions = df.filter(F.col(region_col).isNotNull()).groupBy(region_col).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.when(F.col("n") < C.SUFFICIENCY_PER_REGION, 1)).alias("thin_regions"))
    one = base.select("*", one_row(types).alias("t"), one_row(regions).alias("r")).select(
        *base.columns, "t.*", "r.*")

    thin_types = F.array_compact(F.array(*[
        F.when(F.col(f"type_{i}") < C.SUFFICIENCY_PER_CATEGORY, F.lit(t))
        for i, t in enumerate(C.SUFFICIENCY_CATEGORIES)]))
    flat = F.array_compact(F.array(*[F.when(F.col(f"var_{c}") == 0, F.lit(c)) for c in numeric]))
    total = F.col("total_samples")
    mostly_simulated = F.coalesce(F.col("simulated_samples") / F.nullif(total, F.lit(0)) > 0.5, F.lit(False))
    penalty = (
        F.when(total < C.SUFFICIENCY_MIN, 30).when(total < C.SUFFICIENCY_RECOMMENDED, 10).otherwise(0)
        + F.size("missing_categories") * 5 + F.col("thin_regions") * 2 + F.size("constant_features") * 10
        + F.when(mostly_simulated, 10).otherwise(0)
    )
    issues = F.array_compact(F.array(
        F.when(total < C.SUFFICIENCY_MIN, "too_few_samples").when(
            total < C.SUFFICIENCY_RECOMMENDED, "below_recommended_samples"),
        F.when(F.size("missing_categories") > 0, "thin_categories"),
        F.when(F.col("thin_regions") > 0, "thin_regions"),
        F.when(F.size("constant_features") > 0, "constant_features"),
        F.when(mostly_simulated, "mostly_simulated"),
    ))
    return (
        one.withColumn("missing_categories", thin_types).withColumn("constant_features", flat)
        .withColumn("score", F.greatest(F.lit(0), F.lit(100) - penalty).cast("double"))
        .select(
            "total_samples", (total - F.col("simulated_samples")).alias("real_samples"), "simulated_samples", "score",
            ((F.col("score") >= 60) & (total >= C.SUFFICIENCY_MIN)).alias("sufficient"),
            F.concat_ws(",", issues).alias("issues"),
            F.concat_ws(",", "missing_categories").alias("missing_categories"),
            "thin_regions", F.concat_ws(",", "constant_features").alias("constant_features"))
    )


def training_statistics(df: DataFrame, unit_price: str, area: str) -> DataFrame:
    """Count, price and area ranges and the exact median price, as one row."""
    price, size = F.col(unit_price).try_cast("double"), F.col(area).try_cast("double")
    middle = quantiles.median(df, price)

    def mean(c: Column) -> Column:
        return round_half(F.sum(money(c)).cast("double") / F.nullif(F.count(c), F.lit(0)), 4)

    return df.agg(
        F.count(F.lit(1)).alias("n"), F.min(price).alias("price_min"), F.max(price).alias("price_max"),
        mean(price).alias("price_mean"), F.lit(middle).cast("double").alias("price_median"),
        F.min(size).alias("area_min"), F.max(size).alias("area_max"), mean(size).alias("area_mean"))


def range_violations(rules_table: list[tuple], prefix: str = "") -> list[Column]:
    """Name of every violated range rule; nulls pass, as an absent parameter does."""
    out = []
    for name, low, inclusive, high in rules_table:
        c = F.col(name)
        bad = (c < low if inclusive else c <= low) | (c > high)
        out.append(F.when(bad, F.lit(prefix + name)))
    return out


def _outside(name: str, low: float, inclusive: bool, high: float):
    return lambda b: (b[name] < low if inclusive else b[name] <= low) | (b[name] > high)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Violated rules of every request as a sorted list, empty when valid."""
    ranges = [r for r in C.REQUEST_RANGES if r[0] in requests.columns]
    found = range_violations(ranges)
    found += [F.when(F.length(c) > n, F.lit(c)) for c, n in C.REQUEST_LENGTHS if c in requests.columns]
    found += [F.when(F.size(c) > n, F.lit(c)) for c, n in C.REQUEST_LIST_LENGTHS if c in requests.columns]
    if "buildings" in requests.columns:
        too_long = lambda name, n: lambda b: F.length(b[name]) > n
        found += [F.when(F.exists("buildings", too_long(c, n)), F.lit(f"buildings.{c}")) for c, n in C.BUILDING_LENGTHS]
        found += [F.when(F.exists("buildings", _outside(*rule)), F.lit(f"buildings.{rule[0]}")) for rule in C.BUILDING_RANGES]
        found.append(F.when(~area_consistent(F.col("buildings"), F.col("total_area")), F.lit("buildings.area_sum")))
    return requests.withColumn("violations", F.array_sort(F.array_compact(F.array(*found))))


def area_consistent(buildings: Column, total_area: Column) -> Column:
    """The buildings' areas add up to the total within one percent; no areas given is fine."""
    summed = F.aggregate(buildings, F.lit(0.0), lambda acc, b: acc + F.coalesce(b["area"], F.lit(0.0)))
    return F.coalesce(~((summed > 0) & (F.abs(summed - total_area) / F.nullif(total_area, F.lit(0.0)) > 0.01)),
                      F.lit(True))


def parse_failed(full_text: Column, tables: Column, warnings: Column) -> Column:
    """No text, no tables and a fatal warning."""
    fatal = F.exists(warnings, lambda w: rules.contains_any(w, C.FATAL_WARNING_WORDS))
    return (F.coalesce(full_text, F.lit("")) == "") & (F.coalesce(F.size(tables), F.lit(0)) <= 0) & F.coalesce(
        fatal, F.lit(False))
