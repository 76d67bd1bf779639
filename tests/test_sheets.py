import random
import json

from pyspark.sql import functions as F

from takeoff import schemas
from takeoff.functions import names
from takeoff.operators import sheets
from takeoff.plans import standins


def rows_of(spark, *sheet_list, project="P1", source="main.xlsx"):
    out = []
    for order, (name, lines) in enumerate(sheet_list):
        for i, cells in lines:
            out.append((project, source, name, order, i, [None if c is None else str(c) for c in cells]))
    return spark.createDataFrame(out, schemas.SHEET_ROWS)


BILL = ("表-08 土建", [
    (1, ["", "", "A 土石方工程", "", "", "", "", "", ""]),
    (2, [1, "10101001001", "平整场地", "机械", "m2", 100, 5, 500, 120]),
    (3, ["", "", "小计", "", "", "", "", 500, ""]),
    (4, ["", "", "其他零星工程", "", "", "", "", "", ""]),
    (5, [2, None, "零星项目", "x" * 600, "项", 1, 50, 80, 10]),
    (6, [3, "", "说明行", "", "", "", "", "", ""]),
    (7, ["short"]),
])


def test_bill_items(spark):
    for chunk in (1, 65536):
        got = {r.item_name: r for r in sheets.bill_items(rows_of(spark, BILL, ("表-08 单价措施", BILL[1])), chunk).collect()}
        assert sorted(got) == ["平整场地", "零星项目"]
        a, b = got["平整场地"], got["零星项目"]
        assert (a.boq_code, a.section, a.division, a.unit_project, a.flag_outlier, a.flag_code_error) == (
            "010101001001", "A 土石方工程", "基础工程", "土建", 0, 0)
        assert (b.boq_code, b.section, b.division, len(b.spec_text), b.flag_outlier, b.flag_code_error) == (
            "SUB_00005", "其他零星工程", None, 600, 1, 1)
        assert a.item_id.startswith("P1_010101001001_") and a.item_id != b.item_id


def test_equal_rows_of_two_sheets_stay_apart(spark):
    items = sheets.bill_items(rows_of(spark, BILL, ("表-08 安装", BILL[1])))
    assert items.select("item_id").distinct().count() == items.count() == 4


def test_fee_variants_differ(spark):
    fee = ("表-04 E.3 a", [(4, [1, "分部分项工程费", 500]), (5, ["1.1", "1.1 分部分项工程", 300]), (6, [2, "措施项目费", 40]), (7, [2, "措施项目费", 50]),
                         (8, [2, "其中：安全措施项目", 9]), (9, [4, "4.1 规费", 7]), (10, [5, "税金", 6]), (30, [5, "税金", 1000])])
    rows = rows_of(spark, fee, BILL)
    t = sheets.fee_totals(rows).first()
    assert (t.part_fee, t.measure_fee, t.regulation_fee, t.tax_fee) == (500.0, 90.0, 7.0, 1006.0)
    b = sheets.breakdown(rows).first()
    assert (b.part_item_cost, b.measure_cost, b.regulation_cost, b.tax_cost) == (500.0, 9.0, 7.0, 6.0)
    c = sheets.crosscheck(sheets.bill_items(rows), sheets.fee_totals(rows)).first()
    assert (c.extracted, c.diff_pct) == (580.0, 16.0)


def test_breakdown_labour_falls_back_to_the_pension_line(spark):
    f11 = ("表-08 F.1.1", [(2, ["工程名称：某建筑工程"]), (8, [1, "010101001001", "a", "", "", "", "", "1,000.5", ""]), (9, ["", "010101001001", "b", "", "", "", "", 7, 7]),
                         (10, [2, "010901001001", "c", "", "", "", "", 20, ""])])
    h = ("表-13 H", [(4, [1, "养老保险费", "", "", "", 0]), (5, [1, "养老保险费", "", "", "", 23.415]), (6, [1, "养老保险费", "", "", "", 99])])
    e2 = ("表-03 E.2", [(4, [1, "建筑工程", 1]), (5, [1, "建筑工程", 100]), (6, [2, "装饰工程", 50]), (7, [3, "消防", 25]), (51, [4, "建筑工程", 9])])
    b = sheets.breakdown(rows_of(spark, f11, h, e2)).first()
    assert (b.foundation_division_cost, b.roofing_cost, b.labor_cost, b.labor_source) == (1000.5, 20.0, 1000.0, "h13_pension_reverse")
    assert (b.building_trade_cost, b.decoration_trade_cost, b.installation_trade_cost) == (100.0, 50.0, 25.0)
    assert (b.e2_count, b.f11_count, b.e3_count, b.h13_count) == (1, 1, 0, 1)
    assert json.loads(b.extraction_errors) == ["no e3 sheet"]


def test_project_record_with_info_sheet(spark):
    main = rows_of(
        spark, ("表-02", [(1, ["合 计", "", 3000000, "", 100, 50])]), ("表-11", [(1, [1, "环境保护费", "", "", "", 11]), (2, ["合计", "", "", "", "", 77])]),
        ("表-21", [(1, [1, "C30混凝土", "", 450]), (2, [1, "页岩多孔砖", "", 20]), (3, [1, "地砖", "", 5]), (4, [1, "防水砂浆", "", 5]), (5, [1, "SBS防水卷材", "", 3])]), BILL)
    info = rows_of(spark, ("Sheet1", [(1, ["字段", "值", "", "field"]), (2, ["", "1000", "", "build_area"]), (3, ["", "某医院", "", "name"]), (4, ["", "-", "", "address"]),
                                      (5, ["", "12层", "", "above_ground_floors"]), (6, ["", "医疗", "", "type"]), (7, ["", "框剪", "", "category_structure"])]),
                   source="项目信息.xlsx")
    folders = spark.createDataFrame([("P1", "07.某项目"), ("P2", "08.无表")], "project_id string, folder string")
    records = sheets.project_records(main.unionByName(info), folders)
    r = records.first().asDict()
    assert records.count() == 1
    assert (r["项目名称"], r["建筑类型"], r["结构类型"], r["总建筑面积"], r["楼层数"], r["所在地区"]) == ("某医院", "医院", "框剪结构", 1000.0, 12, "四川")
    assert (r["项目总造价"], r["单方造价"], r["措施费"], r["规费"], r["人工费"]) == (3000000.0, 3000.0, 77.0, 50.0, 130.0)
    assert (r["混凝土总用量"], r["砌块总用量"], r["防水卷材总用量"], r["砂总用量"], r["混凝土单方用量"]) == (450.0, 20.0, 3.0, 0.0, 0.45)
    assert (r["基础工程费"], r["清单项目数"], r["清单总合价"], r["材料费"]) == (500.0, 2, 580.0, 315.0)
    assert (r["source_type"], r["data_confidence"], r["errors"]) == ("A", "high", [])
    done = spark.createDataFrame([("P3",)], "project_id string")
    out = {(x.status, x.reason): x.n for x in sheets.batch_outcome(records, folders, done).collect()}
    assert out == {("ok", ""): 1, ("failed", "no main workbook"): 1}


def test_buildings(spark, one):
    units = sheets.building_units(rows_of(spark, ("表-08 1#楼18层", BILL[1]), ("表-08 商铺", BILL[1]), ("表-08 (3#楼)", BILL[1])))
    s = sheets.building_summary(units).first()
    assert (s.building_count, s.max_floor, s.min_floor, s.mixed_types) == (3, 18, 3, True)
    listed = json.loads(sheets.building_list(units).first().buildings_json)
    assert [(b["name"], b["floors"], b["type"]) for b in listed] == [("1#楼18层", 18, "住宅"), ("商铺", 1, "商业"), ("3#楼", 3, "住宅")]
    single = sheets.building_summary(sheets.building_units(rows_of(spark, BILL))).first()
    assert (single.building_count, single.max_floor, single.mixed_types) == (1, None, False)
    made = sheets.buildings_from_floors(F.lit("18，x 33,7"), F.lit(3), F.lit("住宅"))
    assert one(made["max_floor"]) == 33 and json.loads(one(made["buildings_json"])) == [{"floors": 18, "type": "住宅"}, {"floors": 33, "type": "住宅"}]
    assert one(sheets.buildings_from_floors(F.lit("18,33"), F.lit(1), F.lit("住宅"))["max_floor"]) is None


def test_info_sheet_and_enrichment(spark):
    info = rows_of(spark, ("项目基础信息", [(2, ["基础类别", "桩基础"]), (3, ["抗震等级", "nan"]), (4, ["混凝土价格", "320"]), (5, ["钢筋价格", "3800"])]), source="项目信息.xlsx")
    r = sheets.info_sheet(info).first()
    assert (r.foundation_type, r.seismic_grade, r.concrete_grade, r.steel_grade) == ("桩基础", None, "C30", "HRB400")
    text = rows_of(spark, ("表-01 说明", [(1, ["本工程为框架", "剪力墙"]), (2, ["地上18层，地下2层", "桩承台基础"]), (3, ["2019年", "15定额"])]),
                   ("表-01 二", [(1, ["毛坯"])]))
    p = spark.createDataFrame(
        [("P1", "某楼", None, None, None, None, None, None, "imported"), ("P2", "砖混精装楼", None, 2020, None, None, 3, None, "imported"), ("P3", "某楼", "钢结构", 2020, "毛坯", "x", 1, 1, "imported")],
        "project_id string, name string, structure_type string, build_year int, decoration_standard string, foundation_type string, above_ground_floors int, under_ground_floors int, field_source string")
    e = {r.project_id: r for r in sheets.enrich(p, sheets.overview_facts(text)).collect()}
    a = e["P1"]
    # the structure words stand in two cells, so no line holds the whole pattern
    assert (a.structure_type, a.build_year, a.decoration_standard, a.foundation_type, a.above_ground_floors, a.under_ground_floors, a.field_source) == (
        None, 2017, None, "桩基础", 18, 2, "extracted")
    assert (e["P2"].structure_type, e["P2"].decoration_standard, e["P2"].field_source) == ("砖混结构", "精装修", "inferred")
    assert (e["P3"].field_source, e["P3"].outcome, e["P3"].metadata_completeness) == ("imported", "failed", 1.0)
    s = sheets.enrich_stats(sheets.enrich(p, sheets.overview_facts(text))).first()
    assert (s.extracted, s.inferred, s.failed, s.filled_build_year, s.filled_structure_type) == (1, 1, 1, 1, 1)


def test_text_and_coverage(spark):
    rows = rows_of(spark, ("表-12-1", [(1, ["a", "b"]), (2, ["", None]), (3, ["c"])]), ("表-12", [(1, ["x"])]), ("封面", [(1, ["x"])]))
    texts = {r.sheet_name: r.text for r in sheets.sheet_text(rows).collect()}
    assert texts["表-12-1"] == "a\tb\nc"
    assert {r.sheet_kind: r.n for r in sheets.sheet_histogram(rows).collect()} == {"表-12-1": 1, "表-12": 1, "other": 1}
    c = sheets.sheet_coverage(rows).first()
    assert c.sheet_count == 3 and not c.has_08 and not c.has_info


def test_merged_ranges(spark):
    rows = rows_of(spark, ("表-08", [(1, ["分部名称", "项目编码"]), (2, ["土石方工程", "010101001001"]), (3, [None, "010101002001"]), (4, [None, None])]))
    ranges = spark.createDataFrame([("P1", rows.first().source_file, "表-08", 0, 2, 4, 1, 1), ("P1", rows.first().source_file, "表-08", 0, 3, 4, 1, 1)],
                                   "project_id string, source_file string, sheet_name string, sheet_order int, min_row int, max_row int, min_col int, max_col int")
    got = [r.cells for r in sheets.expand_merged(rows, ranges).orderBy("row_num").collect()]
    assert got == [["分部名称", "项目编码"], ["土石方工程", "010101001001"], ["土石方工程", "010101002001"], ["土石方工程", None]]


def test_merged_ranges_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sheets, "RANGE_BINS", (2, 8, 32))
    rng = random.Random(3)
    table = {r: [rng.choice([None, f"{r}.{c}"]) for c in range(4)] for r in rng.sample(range(1, 300), 220)}
    ranges = []
    for _ in range(60):
        lo, a = rng.choice(sorted(table)), rng.randint(1, 4)
        ranges.append((lo, lo + rng.choice([0, 1, 5, 40, 200]), a, rng.randint(a, 4)))
    rows = spark.createDataFrame([("P1", "f", "s", 0, r, c) for r, c in table.items()], "project_id string, source_file string, sheet_name string, sheet_order int, row_num bigint, cells array<string>")
    df = spark.createDataFrame([("P1", "f", "s", 0, *r) for r in ranges], "project_id string, source_file string, sheet_name string, sheet_order int, min_row int, max_row int, min_col int, max_col int")
    got = {r.row_num: r.cells for r in sheets.expand_merged(rows, df).collect()}

    def filled(r, c):
        over = sorted((lo, a, hi, b, table[lo][a - 1]) for lo, hi, a, b in ranges if lo <= r <= hi and a <= c + 1 <= b and table[lo][a - 1] is not None)
        return table[r][c] if table[r][c] is not None else over[0][4] if over else None

    assert got == {r: [filled(r, c) for c in range(4)] for r in table}


def test_a_long_merged_range_costs_some_hundred_rows(spark):
    one = spark.createDataFrame([(17, 100_000_017)], "min_row int, max_row int")
    pieces = sheets._range_pieces(one).groupBy("level").count().collect()
    assert {r["level"] for r in pieces} == {0, 1, 2} and sum(r["count"] for r in pieces if r["level"] < 2) < 260


def test_generated_methods_are_compiled(spark):
    """The Java compiler leaves methods over 8,000 bytes to the interpreter, which takes several times as long a row."""
    sf = "/root/testdata/sf0.001"
    rows = standins.sheet_rows(spark, sf)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (rows, sheets.breakdown(rows), sheets.sheet_costs(rows), sheets.section_costs(rows)):
            parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
