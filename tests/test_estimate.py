import math

import pytest
from pyspark.sql import functions as F

from takeoff.operators import estimate, ml, quality, training_set

BUILDINGS = "array<struct<floors:int,area:double,type:string,basement:int>>"
REQUEST = ("request_id int, project_name string, project_type string, structure_type string, total_area double, floors int, location string, build_year int,"
           f"decoration_level string, stage string, foundation_type string, soil_condition string, buildings {BUILDINGS}")


def request(spark, *rows):
    base = dict(request_id=1, project_name="a", project_type="住宅", structure_type="框架结构", total_area=20000.0, floors=18, location="成都", build_year=2026,
                decoration_level="精装修", stage="estimation", foundation_type="", soil_condition="none", buildings=None)
    return spark.createDataFrame([tuple({**base, "request_id": i, **r}.values()) for i, r in enumerate(rows)], REQUEST)


def test_shares_sum_to_one_and_are_repeatable(spark):
    df = request(spark, {}, {"project_type": "商业综合体", "structure_type": "钢结构", "floors": 60}, {"project_type": "火星"}, {"floors": 2, "total_area": 900.0},
                 {"buildings": [(18, 9000.0, "住宅", 1), (3, 11000.0, "商业", 0)], "foundation_type": "桩基础（管桩）"})
    got = estimate.estimate(df).orderBy("request_id").collect()
    assert got == estimate.estimate(df).orderBy("request_id").collect()
    for r in got:
        for part in (r.trade_composition, r.division_composition, r.composition):
            assert abs(sum(x.ratio for x in part) - 1) < 2e-3
    assert got[0].unit_price == round(3200 * 1.0 * 0.92, 2) and got[0].total_cost == round(3200 * 0.92 * 20000, 2)
    assert got[3].scale_factor == round(min(1 + 0.6 * math.log10(1 + 9 * (1 - 900 / 3000)), 1.6), 4)
    assert got[4].scale_factor == 1.15  # floor spread 7.5 is 0.15 of 50
    assert got[4].division_composition[0].ratio > got[0].division_composition[0].ratio


@pytest.mark.parametrize("area,want", [(0.0, 1.0), (2999.999, 1.0), (3000.0, 1.6), (10000.0, 1.0), (100000.0, 1.0), (300000.0, 0.88), (9e6, 0.88)])
def test_scale_borders(one, area, want):
    assert abs(one(estimate.scale_factor(F.lit(area))) - want) < 1e-4


def test_coefficients(spark):
    df = spark.createDataFrame([("住宅", "砖混结构", 10), ("住宅", "钢结构", 10), ("别墅", "钢结构", 55), (None, None, None)], "building_type string, structure_type string, floors int")
    got = {r.building_type: r for r in estimate.with_coefficients(df).collect() if r.structure_type != "砖混结构"}
    exact = estimate.with_coefficients(df).filter("structure_type = '砖混结构'").first()
    assert exact.material == [0.30, 0.035, 0.30] and exact.division == [round(x / 0.77, 4) for x in (0.12, 0.40, 0.10, 0.15)]
    assert got["住宅"].material == pytest.approx([0.40, 0.05, 0.65 / 3])
    high = [0.16 * 1.3, 0.43 * 1.1, 0.07, 0.13]
    assert got["别墅"].division == [round(x / sum(high), 4) for x in high]
    assert got[None].composition == [0.60, 0.15, 0.07, 0.04, 0.14]


def test_confidence_and_correction(spark):
    df = request(spark, {"foundation_type": "桩基础、筏板基础"}, {"foundation_type": "undefined", "soil_condition": "较差"}, {"foundation_type": "桩"})
    acc = {m: F.lit(90.0) for m in ("subsection_xgb", "section_xgb", "item_xgb")}
    c = {(r.request_id, r.model_id): r for r in estimate.confidence(df, ["request_id"], acc).collect()}
    a = c[(0, "subsection_xgb")]
    assert (a.input_bonus, a.effective_accuracy, a.filled_params, a.total_params, a.breakdown) == (15.0, 100.0, 1, 7, {"foundation_type": 15.0})
    assert c[(1, "subsection_xgb")].breakdown == {"soil_condition": 5.0}
    fix = {r.request_id: r.x for r in df.select("request_id", estimate.correction(df, "subsection_xgb", "基础占比").alias("x")).collect()}
    assert fix == {0: 1.25, 1: 1.15, 2: 1.35}  # exact, later parameter, contained in a known value


def test_fusion_and_interval(spark):
    rows = [(1, "a", 100.0, 0.5, 50.0), (1, "b", 200.0, 0.5, 60.0), (1, "c", 0.0, 9.0, 99.0), (2, "a", 10.0, 0.0, 40.0), (2, "b", 30.0, 0.0, 80.0)]
    p = spark.createDataFrame(rows, "request_id int, model_id string, value double, weight double, accuracy double")
    f = {r.request_id: r for r in estimate.fuse(p).collect()}
    assert (f[1].fused, f[1].model_count, f[1].average_accuracy, f[2].fused) == (150.0, 2, 50.0, 20.0)
    asked = spark.createDataFrame([(1, 7.0), (2, 15.5), (3, None)], "request_id int, price double")
    i = {r.request_id: (r.lower, r.upper) for r in estimate.prediction_interval(asked, p, ["a", "b", "c"], F.col("price")).collect()}
    assert i == {1: (110.0, 190.0), 2: (15.5, 15.5), 3: (None, None)}
    m = spark.createDataFrame([("x", True, 70.0, {"f": 1.0}), ("y", True, 80.0, {"g": 1.0}), ("z", True, 99.0, {})], "model_id string, is_trained boolean, accuracy double, importance map<string,double>")
    assert estimate.best_importance(m).first().model_id == "y"


def test_stage_models(spark):
    df = request(spark, {}, {"stage": "budget"})
    got = [r.models for r in estimate.models_for(df, ["section_xgb", "boq_xgb"]).orderBy("request_id").collect()]
    assert got == [["section_xgb"], ["section_xgb", "boq_xgb"]]
    assert len(estimate.models_for(df, []).orderBy("request_id").first().models) == 3
    assert estimate.stage_catalogue(spark).filter("stage = 'estimation'").first().n == 7


def test_request_rules(spark):
    df = request(spark, {}, {"floors": 501, "total_area": 0.0}, {"buildings": [(0, 5.0, "住宅", 0), (3, 19990.0, "住宅", 30)]}, {"buildings": [(3, 15000.0, "住宅", 0)], "stage": "x" * 21})
    got = [r.violations for r in quality.validate_requests(df).orderBy("request_id").collect()]
    assert got == [[], ["floors", "total_area"], ["buildings.basement", "buildings.floors"], ["buildings.area_sum", "stage"]]
    df = request(spark, {"buildings": [(3, 20.0, "住" * 51, 0)] * 51}, {}).withColumn("selected_models", F.array_repeat(F.lit("m"), 21))
    df = df.withColumn("hvac", F.repeat(F.lit("x"), F.lit(101) - F.col("request_id")))
    got = [r.violations for r in quality.validate_requests(df).orderBy("request_id").collect()]
    assert {"hvac", "buildings", "buildings.type", "selected_models"} <= set(got[0]) and got[1] == ["selected_models"]


def test_training_table_keeps_real_costs(spark):
    p = spark.createDataFrame(
        [("1", "甲", "住宅", "框架结构", None, "成都", None, None, "桩基础", 1000.0, 100.0, 10.0, "A"), ("2", "乙", "学校", "框架结构", -3, "西北", 2020, "毛坯", None, 500.0, 50.0, 10.0, "B"),
         ("3", "丙", None, "x", 1, "西北", 2020, "毛坯", None, 500.0, 50.0, 10.0, "B")],
        "project_id string, name string, building_type string, structure_type string, above_ground_floors int, location string, build_year int, decoration_standard string, foundation_type string, total_cost double, total_area double, unit_price double, data_quality_grade string")
    b = spark.createDataFrame([("2", "乙", 300.0, 40.0)], "project_id string, project_name string, building_trade_cost double, foundation_division_cost double")
    for c in training_set.COSTS:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(0.0))
    for c in training_set.TEXTS:
        b = b.withColumn(c, F.lit(None).cast("string"))
    base = spark.createDataFrame([("甲", "华东", 2000.0)], "name string, location string, total_cost double")
    ratios = spark.createDataFrame([(0.5, 0.3, 0.2)], "arch_ratio double, deco_ratio double, inst_ratio double")
    t = {r.name: r for r in training_set.training_table(base, p, b, ratios, F.desc("project_id")).collect()}
    assert sorted(t) == sorted(["甲", "乙"])
    assert (t["甲"].arch_cost, t["甲"].floors, t["甲"].build_year, t["甲"].region) == (1000.0, 1, 2023, "华东")
    assert (t["乙"].arch_cost, t["乙"].deco_cost, t["乙"].floors, t["乙"].data_confidence, t["乙"].seismic) == (300.0, 150.0, 1, "medium", "8度")
    y = ml.with_trade_targets(spark.createDataFrame([("住宅", 1.0, 1.0, 2.0), ("火星", 0.0, 1.0, 1.0)], "building_type string, arch_cost double, deco_cost double, inst_cost double")).collect()
    assert (y[0].arch_share, y[0].inst_share, y[1].arch_share) == (0.25, 0.5, 0.60)


def test_sufficiency_rules(spark):
    df = spark.createDataFrame([("住宅", "西南", float(i), 1.0, "A" if i % 2 else None) for i in range(40)], "t string, r string, a double, b double, g string")
    r = quality.sufficiency(df, "t", "r", ["a", "b"], F.col("g").isNull()).first()
    assert r.score == 100 - 10 - 35 - 10 and not r.sufficient and r.constant_features == "b" and r.simulated_samples == 20
    empty = quality.sufficiency(df.limit(0), "t", "r", ["a"], F.col("g").isNull()).first()
    assert empty.total_samples == 0 and not empty.sufficient


def test_references(spark):
    df = request(spark, {}, {"project_type": "酒店"})
    p = spark.createDataFrame([("p1", "甲", "住宅", 100.0, 5.0)], "project_id string, name string, building_type string, total_area double, unit_price double")
    sim = spark.createDataFrame([(0, 1, "p1", 3, True), (1, 1, "p1", 1, False)], "request_id int, rank int, project_id string, score int, same_type boolean")
    got = {r.request_id: r for r in estimate.with_references(estimate.estimate(df), sim, p).collect()}
    assert got[0].references[0].name == "甲" and not got[0].reference_warning and got[1].reference_warning


def test_predicted_parts_are_used(spark):
    df = request(spark, {}, {})
    given = spark.createDataFrame([(0, [0.7, 0.2, 0.1], [0.5, 0.5, 0.5, 0.5], [1.0, None, 0.3])], "request_id int, trades array<double>, divisions array<double>, materials array<double>")
    got = {r.request_id: r for r in estimate.estimate(df, None, given).collect()}
    assert [x.ratio for x in got[0].trade_composition] == [0.7, 0.2, 0.1] and [x.ratio for x in got[0].division_composition] == [0.25] * 4
    assert [x.per_m2 for x in got[0].materials] == [1.0, 55.0, 0.3] and got[0].materials[0].total == 20000.0
    assert [x.per_m2 for x in got[1].materials] == [0.45, 55.0, 0.25] and got[1].indicators == {"人工费占比": 0.2667, "基础占比": 0.2, "主体占比": 0.5333}
    fused = spark.createDataFrame([(1, 5000.0)], "request_id int, fused double")
    both = {r.request_id: r for r in estimate.estimate(df, fused).collect()}
    assert both[1].from_models and both[1].unit_price == 5000.0 and not both[0].from_models
