"""Estimates: coefficients, scale, composition, confidence, fused predictions.

Everything here is a column expression over one request row; only the fusion of
model predictions groups rows (per request).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import names, rules
from takeoff.functions.numbers import clamp, money, round_half, strip
from takeoff.operators import quantiles

# -- coefficients ------------------------------------------------------------


def coefficient_table(spark: SparkSession) -> DataFrame:
    """Rows (building type, structure type, division, material, composition).

    A row without structure holds the mean of its type, the row without type the default.
    """
    rows = [(t, s, *[list(g) for g in (d, m, c)]) for t, s, d, m, c in C.COEFFICIENTS]
    for t in dict.fromkeys(row[0] for row in C.COEFFICIENTS):
        own = [r for r in C.COEFFICIENTS if r[0] == t]
        rows.append((t, "", *[[sum(col) / len(own) for col in zip(*[r[2 + g] for r in own])] for g in range(3)]))
    rows.append(("", "", *[list(g) for g in C.DEFAULT_COEFFICIENTS]))
    return spark.createDataFrame(
        rows, "_type string, _structure string, division array<double>, material array<double>, composition array<double>")


def adjusted_division(division: Column, floors: Column) -> Column:
    """Division ratios after the floor adjustment, in whole ten-thousandths of 1."""
    d = [division[i] for i in range(4)]
    high, low = floors > 50, floors < 6
    shifted = [F.when(high, d[0] * 1.3).otherwise(d[0]), F.when(high, d[1] * 1.1).otherwise(d[1]),
               F.when(low & ~high, d[2] * 1.2).otherwise(d[2]), d[3]]
    return normalised(shifted)


def normalised(values: list[Column], digits: int = 4) -> Column:
    """Array of the values as shares of their sum."""
    given = F.array(*[v.cast("double") for v in values])
    # the sum is bound once, in a field of a one-element array
    bound = F.array(F.struct(given.alias("v"), reduce(lambda a, b: a + b, values).cast("double").alias("s")))
    return F.transform(bound, lambda x: F.when(
        x["s"] > 0, F.transform(x["v"], lambda v: round_half(v / x["s"], digits))).otherwise(x["v"]))[0]


def with_coefficients(df: DataFrame, building_type: str = "building_type", structure: str = "structure_type",
                      floors: str = "floors") -> DataFrame:
    """Add division, material and composition arrays.

    Exact type and structure, else the mean of the type, else the default: first
    the key of the best row is found, then one join with the constant table (a
    few dozen rows, so it is broadcast).  High and low buildings shift the divisions.
    """
    exact = [f"{t}|{s}" for t, s, *_ in C.COEFFICIENTS]
    types = list(dict.fromkeys(row[0] for row in C.COEFFICIENTS))
    both = F.concat_ws("|", F.col(building_type), F.coalesce(structure, F.lit("")))
    keyed = df.withColumn("_key", F.when(both.isin(exact), both).when(
        F.col(building_type).isin(types), F.concat(F.col(building_type), F.lit("|"))).otherwise("|"))
    table = coefficient_table(df.sparkSession).withColumn("_key", F.concat_ws("|", "_type", "_structure")).drop(
        "_type", "_structure")
    joined = keyed.join(F.broadcast(table), "_key", "left").drop("_key")
    return joined.withColumn("division", adjusted_division(F.col("division"), F.coalesce(floors, F.lit(10))))


# -- scale and base price ----------------------------------------------------

def scale_factor(area: Column) -> Column:
    small = F.least(1.0 + 0.60 * F.log10(1 + 9 * (1 - area / 3000.0)), F.lit(1.60))
    medium = 1.25 + 0.35 * (1 - (area - 3000) / 7000.0)
    large = 1.0 - 0.12 * F.least(F.lit(1.0), (area - 100000) / 200000.0)
    return (F.when((area > 0) & (area < 3000), small).when((area >= 3000) & (area < 10000), medium)
            .when(area > 100000, large).otherwise(F.lit(1.0)))


def complexity_factor(building_count: Column, floor_std: Column) -> Column:
    return F.when((building_count > 1) & (floor_std > 0), 1.0 + F.least(floor_std / 50.0, F.lit(0.15))).otherwise(1.0)


def base_price(building_type: Column, structure: Column, region: Column) -> Column:
    return (rules.lookup(building_type, C.BASE_UNIT_PRICE, C.DEFAULT_UNIT_PRICE)
            * rules.lookup(structure, C.STRUCTURE_FACTOR, 1.0) * rules.lookup(region, C.REGION_FACTOR, 1.0))


def baseline_price(building_type: Column, structure: Column, region: Column, decoration: Column, build_year: Column,
                   floors: Column) -> Column:
    """Unit price with decoration, year and height corrections."""
    return (rules.lookup(building_type, C.BASE_UNIT_PRICE, C.DEFAULT_UNIT_PRICE)
            * rules.lookup(structure, C.STRUCTURE_FACTOR, 1.0) * rules.lookup(decoration, C.DECORATION_FACTOR, 1.0)
            * rules.lookup(region, C.REGION_FACTOR, 1.0) * (1.0 + (build_year - 2026) * 0.02)
            * (1.0 + F.greatest(F.lit(0.0), (floors - 20) * 0.005)))


def split_rows(df: DataFrame, keys: list[str], amount: Column, shares: list[tuple]) -> DataFrame:
    """One row a share of the amount; the share list is a fixed one."""
    parts = F.array(*[F.struct(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(row)]) for row in shares])
    out = df.select(*keys, amount.alias("_amount"), F.explode(parts).alias("p"))
    last = f"c{len(shares[0]) - 1}"
    labels = [F.col(f"p.c{i}").alias("parent" if len(shares[0]) == 3 and i == 0 else "part")
              for i in range(len(shares[0]) - 1)]
    return out.select(*keys, *labels, F.col(f"p.{last}").alias("ratio"),
                      round_half(F.col("_amount") * F.col(f"p.{last}"), 2).alias("amount"))


def item_amounts(df: DataFrame, keys: list[str], area: Column) -> DataFrame:
    """Usual items with quantity and amount for the area."""
    parts = F.array(*[F.struct(F.lit(n).alias("item"), F.lit(u).alias("unit"), F.lit(q).alias("q"), F.lit(p).alias("p"))
                      for n, u, q, p in C.ITEM_QUANTITIES])
    out = df.select(*keys, area.alias("_area"), F.explode(parts).alias("i"))
    return out.select(*keys, "i.item", "i.unit", F.col("i.q").alias("per_m2"), F.col("i.p").alias("unit_price"),
                      round_half(F.col("i.q") * F.col("i.p") * F.col("_area"), 2).alias("amount"))


def indicator_rows(df: DataFrame, keys: list[str], area: Column) -> DataFrame:
    """The usual economic and technical indicators of a project, with their amount for its area."""
    parts = F.array(*[F.struct(F.lit(n).alias("indicator"), F.lit(v).alias("value"), F.lit(u).alias("unit")) for n, v, u in C.INDICATOR_LIST])
    out = df.select(*keys, area.alias("_area"), F.explode(parts).alias("i"))
    return out.select(*keys, "i.indicator", "i.value", "i.unit", round_half(F.col("i.value") * F.col("_area"), 2).alias("amount"))


def concrete_per_m2(floors: Column, structure: Column) -> Column:
    step = F.when(floors > 0, F.least(floors, F.lit(5))).otherwise(1)
    return rules.lookup(step, C.CONCRETE_BY_FLOOR, 0.45) * rules.lookup(structure, C.STRUCTURE_FACTOR, 1.0)


# -- several buildings -------------------------------------------------------

def building_features(buildings: Column, floors: Column, project_type: Column) -> Column:
    """Struct of count, floor statistics, area shares and mixed flag from the list of buildings."""
    def value(b, f):
        return F.coalesce(b[f].cast("double"), F.lit(0.0))

    heights = F.transform(buildings, lambda b: value(b, "floors"))
    kinds = F.transform(buildings, lambda b: F.coalesce(b["type"], F.lit("住宅")))
    n = F.size(buildings)
    total = F.aggregate(heights, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    spread = F.aggregate(heights, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))

    def area_of(word: str | None) -> Column:
        return F.aggregate(buildings, F.lit(0.0), lambda a, b: a + (
            value(b, "area") if word is None else F.when(
                F.coalesce(b["type"], F.lit("住宅")).contains(word), value(b, "area")).otherwise(0.0)))

    whole = F.when(area_of(None) > 0, area_of(None)).otherwise(1.0)
    many = F.struct(
        n.alias("building_count"), F.array_max(heights).cast("int").alias("max_floor"),
        F.array_min(heights).cast("int").alias("min_floor"), round_half(mean, 1).alias("avg_floor"),
        round_half(F.sqrt(spread / n), 2).alias("floor_std"), round_half(area_of("住宅") / whole, 3).alias("residential_ratio"),
        round_half(area_of("商业") / whole, 3).alias("commercial_ratio"),
        (F.size(F.array_distinct(kinds)) > 1).cast("int").alias("mixed_types"))
    f = F.coalesce(floors, F.lit(10))
    kind = F.coalesce(project_type, F.lit(""))
    single = F.struct(
        F.lit(1).alias("building_count"), f.cast("int").alias("max_floor"), f.cast("int").alias("min_floor"),
        f.cast("double").alias("avg_floor"), F.lit(0.0).alias("floor_std"),
        F.when(kind.contains("住宅"), 1.0).otherwise(0.0).alias("residential_ratio"),
        F.when(kind.contains("商业"), 1.0).otherwise(0.0).alias("commercial_ratio"), F.lit(0).alias("mixed_types"))
    return F.when(F.coalesce(n, F.lit(0)) > 0, many).otherwise(single)


# -- compositions ------------------------------------------------------------

def trade_shares(residential: Column, commercial: Column) -> Column:
    """Default building / decoration / installation shares shifted by the use of the buildings."""
    arch = clamp(0.55 + 0.10 * residential - 0.05 * commercial, 0.35, 0.75)
    inst = clamp(0.15 + 0.10 * commercial, 0.05, 0.30)
    return F.array(arch, round_half(1.0 - arch - inst, 4), inst)


def cost_shares(composition: Column, mixed: Column, decoration: Column) -> Column:
    """Composition ratios adjusted for mixed use and decoration, summing to 1."""
    direct = (composition[0] + F.when(mixed > 0, 0.02).otherwise(0.0)
              + F.when(decoration == "精装修", 0.03).when(decoration == "豪华装修", 0.06).otherwise(0.0))
    indirect = composition[1] - F.when(decoration == "精装修", 0.02).when(decoration == "豪华装修", 0.04).otherwise(0.0)
    return normalised([direct, indirect, composition[2], composition[3], composition[4]])


def division_shares(correction: Column, predicted: Column | None = None) -> Column:
    """Predicted or default divisions with the foundation scaled by its empirical factor, summing to 1."""
    values = [F.lit(v) if predicted is None else F.coalesce(predicted[i], F.lit(v))
              for i, (_, v) in enumerate(C.DIVISION_DEFAULTS)]
    values[0] = values[0] * F.coalesce(correction, F.lit(1.0))
    return normalised(values)


def material_use(area: Column, predicted: Column | None = None) -> Column:
    """Use per square metre, predicted or usual, and the total for the area."""
    def entry(i: int, name: str, usual: float, unit: str) -> Column:
        per_m2 = F.lit(usual) if predicted is None else F.coalesce(predicted[i], F.lit(usual))
        return F.struct(F.lit(name).alias("material"), per_m2.alias("per_m2"), F.lit(unit).alias("unit"),
                        round_half(area * per_m2, 2).alias("total"))

    return F.array(*[entry(i, *row) for i, row in enumerate(C.MATERIAL_DEFAULTS)])


def indicator_shares(predicted: Column | None = None) -> Column:
    """Labour, foundation and structure indicators, summing to 1."""
    return normalised([F.lit(v) if predicted is None else F.coalesce(predicted[i], F.lit(v))
                       for i, (_, v) in enumerate(C.INDICATOR_DEFAULTS)])


# -- confidence --------------------------------------------------------------

def filled(df: DataFrame, param: str) -> Column:
    """Value of a parameter under any of its names; blanks and the words none and undefined do not count."""
    found = []
    for name in [param, *C.PARAM_ALIASES.get(param, [])]:
        if name in df.columns:
            text = F.col(name).cast("string")
            found.append(F.when((text != "") & ~F.lower(text).isin("none", "undefined"), strip(text)))
    value = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.nullif(value, F.lit(""))


def confidence(df: DataFrame, keys: list[str], base_accuracy: dict[str, Column]) -> DataFrame:
    """Bonus, effective accuracy and breakdown of every model of a request, one row a model.

    The rules are a fixed list, so a request needs no join and no shuffle.
    """
    entries = []
    for model, (limit, rule_list) in C.BONUS_RULES.items():
        base = base_accuracy[model]
        bonuses = [F.when(filled(df, p).isNotNull(), b).otherwise(0.0) for p, b in rule_list]
        bonus = F.least(reduce(lambda a, b: a + b, bonuses), F.lit(limit))
        parts = F.map_filter(F.map_from_arrays(F.array(*[F.lit(p) for p, _ in rule_list]), F.array(*bonuses)),
                             lambda k, v: v > 0)
        entries.append(F.struct(
            F.lit(model).alias("model_id"), base.alias("base_accuracy"), bonus.alias("input_bonus"),
            F.least(base + bonus, F.lit(100.0)).alias("effective_accuracy"), F.lit(limit).alias("max_bonus"),
            F.size(parts).alias("filled_params"), F.lit(len(rule_list)).alias("total_params"), parts.alias("breakdown")))
    return df.select(*keys, F.explode(F.array(*entries)).alias("c")).select(*keys, "c.*")


def correction(df: DataFrame, model: str, target: str) -> Column:
    """Empirical factor for a target share, null when no parameter corrects it; a later parameter wins."""
    factor = F.lit(None).cast("double")
    for param, entries in C.CORRECTIONS[model]:
        value = filled(df, param)
        # the first matching value decides, whether or not it holds this target
        known = list(dict.fromkeys(v for v, _, _ in entries))
        factor_of = {(v, t): x for v, t, x in entries}

        def pick(v):
            return F.lit(factor_of.get((v, target))).cast("double")

        exact = [(value == v, pick(v)) for v in known]
        fuzzy = [(value.contains(v) | F.lit(v).contains(value), pick(v)) for v in known]
        factor = F.coalesce(rules.chain(exact + fuzzy), factor)
    return factor


def stage_models(spark: SparkSession) -> DataFrame:
    rows = [(s, m) for s, ms in C.STAGE_MODELS for m in ms]
    return spark.createDataFrame(rows, "stage string, model_id string")


def models_for(requests: DataFrame, trained: list[str]) -> DataFrame:
    """Default models of the stage; the trained ones of them, or all when none is trained."""
    known = F.array(*[F.lit(m) for m in trained]) if trained else F.array().cast("array<string>")
    default = rules.chain(
        [(F.col("stage") == s, F.array(*[F.lit(m) for m in ms])) for s, ms in C.STAGE_MODELS[:-1]],
        F.array(*[F.lit(m) for m in C.STAGE_MODELS[-1][1]]))
    usable = F.filter(default, lambda m: F.array_contains(known, m))
    return requests.withColumn("models", F.when(F.size(usable) > 0, usable).otherwise(default))


def stage_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(s, c, len(ps), ",".join(ps)) for s, cs in C.STAGE_PARAMS.items() for c, ps in cs]
    return spark.createDataFrame(rows, "stage string, category string, n int, params string")


# -- fused predictions -------------------------------------------------------

def fuse(predictions: DataFrame) -> DataFrame:
    """Weighted mean of the predictions of a request, plain mean when all weights are zero.

    predictions: request_id, model_id, value, weight (effective accuracy / 100), accuracy.
    """
    used = predictions.filter(F.col("value") > 0)
    v, w = F.col("value"), F.coalesce("weight", F.lit(0.0))
    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(28,8)")).cast("double")

    n = F.count(F.lit(1))
    one = used.groupBy("request_id").agg(
        total(v * w).alias("vw"), total(w).alias("w"), total(v).alias("v"), n.alias("model_count"),
        (total(w) / n).alias("mean_w"))
    return one.select(
        "request_id", F.coalesce(F.col("vw") / F.nullif("w", F.lit(0.0)), F.col("v") / F.col("model_count")).alias("fused"),
        "model_count", round_half(F.col("mean_w") * 100, 1).alias("average_accuracy"))


def prediction_interval(requests: DataFrame, predictions: DataFrame, model_ids: list[str], fallback: Column) -> DataFrame:
    """10th to 90th percentile of the predictions of models with enough accuracy, a row for every request.

    Each model gives at most one value a request (its largest, if repeated), so
    the sorted list is as short as the model list.  Fewer than two values: both
    ends are the fallback, a column of the requests (the adjusted price).
    """
    good = predictions.filter((F.col("accuracy") >= C.INTERVAL_ACCURACY) & (F.col("value") != 0))
    wide = good.groupBy("request_id").agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("value"))).alias(f"m{i}") for i, m in enumerate(model_ids)])
    values = F.array_compact(F.array(*[F.col(f"m{i}") for i in range(len(model_ids))]))
    told = wide.select("request_id", values.alias("vals"))
    asked = requests.select("request_id", fallback.alias("_fallback")).join(told, "request_id", "left")
    end = lambda p: F.when(F.size("vals") >= 2, quantiles.in_row_quantile(F.col("vals"), p)).otherwise(F.col("_fallback"))
    return asked.select("request_id", round_half(end(0.1), 2).alias("lower"), round_half(end(0.9), 2).alias("upper"))


def evidence_score(samples: Column) -> Column:
    return rules.bands(samples, [(50, 80.0), (20, 60.0), (10, 40.0)], 20.0)


def best_importance(models: DataFrame) -> DataFrame:
    """Feature importance of the most accurate trained model that has one."""
    has = F.col("is_trained") & (F.col("accuracy") > 0) & (F.size("importance") > 0)
    return models.filter(has).agg(
        F.max_by("model_id", F.struct("accuracy", "model_id")).alias("model_id"),
        F.max_by("importance", F.struct("accuracy", "model_id")).alias("importance"))


def overall_confidence(assessed: DataFrame, key: str = "request_id") -> DataFrame:
    """Mean effective accuracy and bonus over the models of a request."""
    def mean(c: str) -> Column:
        return round_half(F.sum(money(F.col(c))).cast("double") / F.count(F.lit(1)), 1)

    return assessed.groupBy(key).agg(mean("effective_accuracy").alias("effective_accuracy"),
                                     mean("input_bonus").alias("total_bonus"))


def cost_levels(df: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Six-level breakdown rows: total, single project, unit projects, sections, items, details."""
    def entry(level: int, label: str, part: str, ratio: float | None) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(label).alias("label"), F.lit(part).alias("part"),
                        F.lit(ratio).cast("double").alias("ratio"))

    parts = {1: [("", 1.0)], 2: [("", 1.0)], 3: C.UNIT_PROJECT_SPLIT, 4: C.FEE_COMPOSITION, 5: [("", None)], 6: [("", None)]}
    rows = F.array(*[entry(level, label, part, ratio)
                     for level, label, _ in C.COST_LEVELS for part, ratio in parts[level]])
    out = df.select(*keys, total.alias("_total"), F.explode(rows).alias("e"))
    return out.select(*keys, "e.level", "e.label", "e.part", "e.ratio",
                      round_half(F.col("_total") * F.col("e.ratio"), 2).alias("amount"))


PREDICTED = ["trades", "divisions", "materials", "indicators"]


def estimate(requests: DataFrame, fused: DataFrame | None = None, predicted: DataFrame | None = None) -> DataFrame:
    """One result row a request: unit price, total, compositions, materials, indicators.

    requests: request_id, project_type, structure_type, total_area, floors, location, decoration_level, buildings.
    fused: request_id, fused (a model price) - a request without one is priced from the base table.
    predicted: request_id and, as arrays in the order of the fixed lists, any of trades, divisions, materials and
    indicators - what is missing takes the usual values.
    """
    df = requests if fused is None else requests.join(fused.select("request_id", "fused"), "request_id", "left")
    model_price = F.lit(None).cast("double") if fused is None else F.col("fused")
    told = {}
    if predicted is not None:
        given = [c for c in PREDICTED if c in predicted.columns]
        df = df.join(predicted.select("request_id", *[F.col(c).alias(f"_p_{c}") for c in given]), "request_id", "left")
        told = {c: F.col(f"_p_{c}") for c in given}
    area = F.coalesce("total_area", F.lit(C.DEFAULT_AREA))
    df = df.withColumns({
        "_area": area, "_b": building_features(F.col("buildings"), F.col("floors"), F.col("project_type")),
        "_raw": F.coalesce(model_price, base_price(F.col("project_type"), F.col("structure_type"),
                                                   names.region(F.col("location"))))})
    df = df.withColumn("_scale", scale_factor(F.col("_area")) * complexity_factor(
        F.col("_b.building_count"), F.col("_b.floor_std")))
    df = df.withColumn("_price", F.col("_raw") * F.col("_scale")).withColumn("_total", F.col("_price") * F.col("_area"))
    df = with_coefficients(df, "project_type", "structure_type", "floors").withColumn(
        "_rounded", round_half(F.col("_total"), 2))
    trades = trade_shares(F.col("_b.residential_ratio"), F.col("_b.commercial_ratio"))
    if "trades" in told:
        trades = F.coalesce(told["trades"], trades)
    # a column of its own: the shares name it several times, and Spark doesn't copy a costly expression into each
    df = df.withColumn("_fix", correction(requests, "subsection_xgb", "基础占比"))
    df = df.withColumns({
        "_trades": trades, "_divisions": division_shares(F.col("_fix"), told.get("divisions")),
        "_fees": cost_shares(F.col("composition"), F.col("_b.mixed_types"), F.col("decoration_level")),
        "_indicators": indicator_shares(told.get("indicators"))})

    def with_amounts(labels: list[str], shares: str, whole: str) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("part"), F.col(shares)[i].alias("ratio"),
                                  round_half(F.col(whole) * F.col(shares)[i], 2).alias("amount"))
                         for i, n in enumerate(labels)])

    return df.select(
        "request_id", round_half(F.col("_price"), 2).alias("unit_price"), F.col("_rounded").alias("total_cost"),
        round_half(F.col("_raw"), 2).alias("unit_price_raw"), round_half(F.col("_scale"), 4).alias("scale_factor"),
        (model_price.isNotNull() if fused is not None else F.lit(False)).alias("from_models"),
        with_amounts(["建筑工程", "装饰工程", "安装工程"], "_trades", "_rounded").alias("trade_composition"),
        with_amounts(C.MAIN_DIVISIONS, "_divisions", "_rounded").alias("division_composition"),
        with_amounts(C.COEFFICIENT_ITEMS["composition"], "_fees", "_total").alias("composition"),
        material_use(F.col("_area"), told.get("materials")).alias("materials"),
        F.map_from_arrays(F.array(*[F.lit(n) for n, _ in C.INDICATOR_DEFAULTS]), F.col("_indicators")).alias("indicators"))


def estimate_record(requests: DataFrame, predictions: DataFrame, model_ids: list[str], models: DataFrame) -> DataFrame:
    """The estimate of every request with its interval, the number and mean accuracy of its models, and the features that weigh most.

    predictions: request_id, model_id, value, weight, accuracy. models: model_id, accuracy, is_trained, importance (a map). A request
    without models has its base price at both ends of the interval, no model and no accuracy.
    """
    fused = fuse(predictions)
    record = estimate(requests, fused)
    interval = prediction_interval(record.select("request_id", "unit_price"), predictions, model_ids, F.col("unit_price"))
    best = best_importance(models).select(F.col("model_id").alias("importance_model"), F.col("importance").alias("feature_importance"))  # one row
    return record.join(interval, "request_id", "left").join(fused.select("request_id", "model_count", "average_accuracy"), "request_id", "left").withColumn(
        "model_count", F.coalesce("model_count", F.lit(0))).crossJoin(F.broadcast(best))


def with_references(estimates: DataFrame, similar: DataFrame, projects: DataFrame) -> DataFrame:
    """Attach the (at most k) similar projects of a request and a warning when none is of its type."""
    info = projects.select("project_id", "name", "building_type", "total_area", "unit_price")
    refs = similar.join(info, "project_id").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "building_type", "total_area", "unit_price"))).alias("references"),
        F.max("same_type").alias("_same"))
    return estimates.join(refs, "request_id", "left").withColumn(
        "reference_warning", F.coalesce(~F.col("_same"), F.lit(False))).drop("_same")
