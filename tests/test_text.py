import random

import pytest
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff import schemas
from takeoff.operators import conversations, quality, text


def doc(spark, full_text="", tables=None, warnings=None, filename="工程 概况.v2.pdf"):
    row = (filename, ".pdf", full_text, tables or [], {}, 1, False, warnings or [])
    return spark.createDataFrame([row], schemas.PARSED_DOCUMENT)


def test_text_fields(spark):
    t = "工程名称：新都安置小区二期\n总建筑面积约69474.5 平方米，占地面积1200㎡，地上18层，地下2层，3#楼共20楼\n框架-剪力墙结构，公共区域精装，建于2018年，筏形基础"
    r = text.text_features(doc(spark, t)).first()
    assert (r.project_name, r.building_type, r.structure_type, r.total_area, r.land_area) == ("新都安置小区二期", "住宅", "框剪结构", 69474.5, 1200.0)
    assert (r.location, r.build_year, r.floor_count, r.above_ground_floors, r.under_ground_floors, r.decoration_standard) == ("新都", 2018, 20, 18, 2, "精装修")
    assert text.text_features(doc(spark)).first().project_name == "工程 概况.v2"
    assert spark.range(1).select(text.foundation(F.lit(t)), text.year(F.lit("1949年"))).first() == ("筏板基础", None)


def test_table_fields_fill_only_what_is_missing(spark):
    tables = [[["总建筑面积", "5000"], ["建筑面积", "9999"], ["楼层数： 12层", "x"], ["only"]],
              [["建造年份", "2015年"], ["装修标准", ""], ["建设地点 郫都区", ""], ["工程类型", "中学教学楼"], ["项目名称", "某校"]]]
    r = text.table_features(text.text_features(doc(spark, "结构为框架结构", tables))).first()
    assert (r.total_area, r.floor_count, r.build_year, r.location, r.building_type) == (5000.0, 12, 2015, "郫都区", "学校")
    assert r.decoration_standard is None and r.structure_type == "框架结构" and r.project_name == "工程 概况.v2"


@pytest.mark.parametrize("cell,label,want", [("建筑面积", "建筑面积", True), ("建筑面积(m2)", "总建筑面积", False), ("总建筑面", "总建筑面积", True), ("面积", "建筑面积", False), ("建x筑y面z积", "建筑面积", True),
                                             ("楼层", "楼层数", True), ("", "楼层数", False)])
def test_one_error_is_forgiven(one, cell, label, want):
    assert one(text.fuzzy_contains(F.lit(cell), F.lit(label))) is want


@pytest.mark.parametrize("cell,want", [("1,234,567.89", 1234567.89), ("1234.56万元", 12345600.0), ("1.23亿元", 1.23e8), ("900", None), ("无", None), ("合同价 12，000 元", 12000.0)])
def test_cost_values(one, cell, want):
    got = one(text.cost_value(F.lit(cell)))
    assert got == want or abs(got - want) < 1e-3


def test_cost_of_the_first_total_row(spark):
    tables = [[["项目", "99999999"], ["合计", "800", "9,000"]], [["总造价", "500", "1200万元", "3亿元"], ["合计", "5亿元"]]]
    d = doc(spark, "建筑面积4000㎡", tables)
    r = text.document_features(d).first()
    assert (r.total_cost, r.unit_price) == (12000000.0, 3000.0)
    assert r.confidence["total_cost"] == 0.7 and r.confidence["unit_price"] == 0.6 and r.confidence["total_area"] == 0.8 and r.confidence["location"] == 0.0
    assert r.extraction_source == {"total_area": "text", "total_cost": "table", "unit_price": "inferred"}
    assert "总建筑面积: 4000" in text.document_features(d).select(text.context_summary(text.document_features(d))).first()[0]
    assert text.document_features(d).select(text.completeness(text.document_features(d))).first()[0] == 0.25


@pytest.mark.parametrize("raw,want", [
    ("本工程为\n住宅楼。\n下一段", "本工程为住宅楼。\n下一段"), ("标题\n\n\n正文", "标题\n\n正文"), ("\n\n开头  空格\n", "开头 空格\n"), ("前文\n1、列表\n【注】", "前文\n1、列表\n【注】"),
    ("1l2", "112"), ("2O5 l O", "205 l O"), ("好。。。，，", "好。，"), ("共69,\n474元", "共69,474元"), ("100m2", "100㎡"), ("100 rn2", "100 ㎡"),
    ("version2 m25", "version2 m25"), ("行尾空格   \n续行", "行尾空格续行")])
def test_ocr_cleaning(one, raw, want):
    assert one(text.clean_ocr(F.lit(raw))) == want


def test_scanned_documents(spark):
    rows = [("a", "x" * 10, 50.0), ("a", " " * 80, 40.0), ("a", "y" * 100, 0.0), ("b", "z" * 300, 90.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "doc string, t string, c double")
    got = {r.doc: r for r in text.page_scan(df, "doc", F.col("t"), F.col("c")).collect()}
    assert (got["a"].scanned_pages, got["a"].partial_pages, got["a"].is_scanned, got["a"].avg_confidence, got["a"].low_confidence) == (2, 1, True, 45.0, True)
    assert (got["b"].is_scanned, got["b"].low_confidence) == (False, False)


def test_parse_failure(one):
    def failed(t, n, w):
        tables = F.array(*[F.array(F.array(F.lit("a")))] * n) if n else F.expr("array()").cast("array<array<array<string>>>")
        return one(quality.parse_failed(F.lit(t).cast("string"), tables, F.array(*[F.lit(x) for x in w]) if w else F.expr("array()").cast("array<string>")))

    assert failed("", 0, ["无法打开 PDF"]) is True and failed(None, 0, ["x", "empty file"]) is True
    assert failed("t", 0, ["出错"]) is False and failed("", 1, ["出错"]) is False and failed("", 0, []) is False


@pytest.mark.parametrize("message,want", [
    ("数据够吗", "check_data"), ("哪里找数据", "search_data"), ("医院造价一般是多少", "knowledge_query"), ("帮我算一下", "predict"), ("重新训练", "train"), ("什么是概算", "explain_term"),
    ("模型列表", "list_models"), ("类似项目", "find_similar"), ("费用构成", "cost_breakdown"), ("你好", "greeting"), ("谢谢", "thanks"), ("怎么用", "help"), ("拟建8000平米住宅", "predict"),
    ("成都的话", "region_refine"), ("高新区", "region_refine"), ("偏高", "feedback"), ("另外", "supplement"), ("改为20层", "supplement"), ("调整", "repredict"), ("甲vs乙", "compare"),
    ("和去年比", "compare"), ("变成医院", "repredict"), ("20层", "repredict"), ("有没有样本", "data_query"), ("天府呢", "region_refine"), ("晴天", "general")])
def test_intents(one, message, want):
    assert one(conversations.intent(F.lit(message))) == want


def test_request_parameters(one):
    p = conversations.request_params(F.lit("在成都建1.5万平米的酒店，框剪，18层，毛坯"))
    assert {k: one(v) for k, v in p.items()} == {
        "total_area": 15000.0, "project_type": "商业建筑", "location": "成都", "structure_type": "框剪结构", "floors": 18, "decoration_level": "简单装修", "build_year": 2026,
        "project_name": "对话生成项目"}
    d = conversations.request_params(F.lit("你好"))
    assert (one(d["total_area"]), one(d["project_type"]), one(d["floors"])) == (10000.0, "住宅", 6)
    assert [one(conversations.refined_region(F.lit(x))) for x in ("成都高新区呢", "CBD", "武汉怎么样", "晴天")] == ["成都高新区", "CBD", "武汉", None]
    assert one(conversations.term(F.lit("预算和定额"))) == "预算"


def test_sessions(spark):
    rows = [(s, t, f"消息{t}" + "长" * 40, s * 100 + t) for s in (1, 2, 3) for t in range(5)]
    df = spark.createDataFrame(rows, "session_id int, turn int, text string, seq int")
    s = {r.session_id: r for r in conversations.session_summary(df).collect()}
    assert len(s[1].title) == 43 and s[1].message_count == 5
    kept = sorted((r.session_id, r.turn) for r in conversations.retain(df, sessions=2, per_session=2).collect())
    assert kept == [(2, 3), (2, 4), (3, 3), (3, 4)]
    assert [r.seq for r in conversations.last_messages(df, 2).collect()] == [303, 304]


def test_label_scan_equals_one_label_after_another(spark):
    """Any texts over the labels' own characters, look-alikes among them: the bits of all labels tell what each label alone does."""
    rng = random.Random(4)
    labels = [*C.TABLE_LABELS, ("楼1O", "x"), ("：年", "y")]
    chars = sorted({c for x, _ in labels for c in x} | set("0OlI1：: x"))
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 12))) for _ in range(60)]
    texts += [x[:-1] for x, _ in labels] + [x[1:] for x, _ in labels] + ["--".join(x) for x, _ in labels]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    scan = text.LabelScan(labels)
    assert len(scan.start) > 1
    told = F.transform(F.filter(scan.labels(), lambda x: scan.told(scan.states(F.col("t")), x)), lambda x: x["label"])
    single = F.array_compact(F.array(*[F.when(text.fuzzy_contains(F.col("t"), F.lit(x)), F.lit(x)) for x, _ in labels]))
    assert df.where(~told.eqNullSafe(single)).count() == 0 and df.where(F.size(told) > 0).count() > 60
