import pytest
from pyspark.sql import functions as F

from takeoff.functions import names, numbers, scalars


@pytest.mark.parametrize("file,task,want", [
    ("工程量清单.pdf", "task9999", "task9999.pdf"), ("REPORT.PDF", "task0006", "task0006.pdf"), ("report.pdf.exe", "task0004", "task0004"),
    (None, "task0009", "task0009"), ("../../../etc/backdoor.pdf", "task0011", "task0011.pdf"), (".pdf", "task0012", "task0012"), ("a.b/c", "t", "t")])
def test_stored_names(one, file, task, want):
    assert one(names.stored_name(F.lit(task), F.lit(file).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("12", 12.0), (" 1.5 ", 1.5), ("-", 0.0), ("—", 0.0), ("", 0.0), (None, 0.0), ("1,234", 0.0), ("1d", 0.0),
                                       ("NaN", 0.0), ("1e3", 1000.0), ("-2.", -2.0), ("abc", 0.0)])
def test_tolerant_numbers(one, text, want):
    assert one(numbers.number_or(F.lit(text).cast("string"))) == want


def test_comma_numbers_and_rounding(one):
    assert one(numbers.comma_number(F.lit("1,234,567.5"))) == 1234567.5
    assert one(numbers.comma_number(F.lit("无")) ) is None
    assert one(numbers.round_half(F.lit(1.005), 2)) == 1.01 and one(numbers.round_half(F.lit(2.5), 0)) == 3.0


@pytest.mark.parametrize("raw,code,valid", [("10101001001", "010101001001", True), ("0101 0100\n1001", "010101001001", True), ("010101-001001", "010101-001001", True),
                                            ("AB01", "AB01", False), ("", "", False), ("1234567890123", "1234567890123", True)])
def test_bill_codes(one, raw, code, valid):
    c = names.bill_code(F.lit(raw))
    assert one(c) == code and one(names.is_bill_code(c)) is valid


def test_classification(one):
    L = F.lit
    assert one(names.building_type(L("某小学教学楼"), L(None).cast("string"))) == "学校"
    assert one(names.building_type(L("安置房商业街"))) == "住宅"
    assert one(names.building_type(L("无名"))) == "住宅"
    assert one(names.structure_type(L("现浇框架剪力墙"))) == "框剪结构"
    assert one(names.structure_type(L("其他结构"))) == "其他结构"
    assert one(names.division_of_section(L("A 土石方工程"))) == "基础工程" and one(names.division_of_section(L("其他零星工程"))) is None
    assert one(names.trade_of_item(L("抹灰"), L(""))) == "装饰" and one(names.trade_of_item(L("防雷"), L(""))) == "安装"
    assert one(names.trade_of_item(L("其他"), L("混凝土"))) == "土建"
    assert one(names.division_of_prefix4(L("010901001001"))) == "屋面工程" and one(names.division_of_prefix4(L("9901"))) == "其他"
    assert one(names.division_of_prefix2(L(None).cast("string"), L("0301"))) == "安装工程"


def test_places(one):
    L = F.lit
    assert [one(names.region(L(x))) for x in ("西南", "成都", " 北京 ", "火星", "")] == ["西南", "西南", "华北", "华东", "华东"]
    assert one(names.region(L(None).cast("string"))) == "华东"
    assert [one(names.seismic_level(L(x))) for x in ("天津", "四川成都市新都区", "德阳绵竹市", "西北", "大西北", "海外")] == ["7.5度", "7度", "7度", "8度", "8度", "7度"]
    assert one(names.seismic_level(L(None).cast("string"))) == "7度"
    assert one(names.address_region(L("四川省攀枝花市"))) == "攀枝花" and one(names.address_region(L("火星"))) == "四川"


def test_floor_texts(one):
    L = F.lit
    assert [one(names.floor_count(L(x))) for x in ("1#2#楼23层，3#楼33层", "18", "18.7", "-3", "多层")] == [33, 18, 18, 6, 6]
    assert [one(names.unit_floors(L(x))) for x in ("1#楼 18层", "10#楼", "10~12#", "地下车库")] == [18, 10, 12, None]
    assert [one(names.unit_type(L(x))) for x in ("商铺", "写字楼", "地下室", "教学楼", "1#楼")] == ["商业", "办公", "车库", "学校", "住宅"]
    assert one(names.floor_tier(L(6)))["tier"] == "多层" and one(names.floor_tier(L(19)))["tier"] == "高层"


def test_labels_and_keys(one):
    L = F.lit
    assert [one(names.money_label(L(x))) for x in (1.234e8, 54000.0, 12.345)] == ["1.23亿元", "5.40万元", "12.35元"]
    assert one(names.folder_title(L("12. 某 项目"))) == "某 项目" and one(names.project_key(L(" 某 项目（一期）"))) == "某项目(一期)"
    assert one(names.project_id(L("某 项目"))) == one(names.project_id(L("某项目")))
    assert one(names.concrete_grade(L(320.0))) == "C30" and one(names.steel_grade(L(4500.0))) == "HRB500"
    assert one(names.decoration_level(L("毛坯"))) == "简单装修" and one(names.decoration_level(L(None).cast("string"))) == "普通装修"
    assert one(names.type_synonym(L("五星酒店"))) == "商业建筑" and one(names.type_synonym(L("飞船"))) == "飞船"


def test_scalars(one):
    assert one(scalars.iso_week(F.lit("2024-12-30").cast("timestamp"))) == "2025-W01"
    assert str(one(scalars.week_start(F.lit("2026-01-01").cast("timestamp")))) == "2025-12-29"
    assert one(scalars.is_date(F.lit("2026-02-29"))) is False and one(scalars.is_date(F.lit("2024-02-29"))) is True
    assert one(scalars.same_text(F.lit("AbC"), F.lit("aBc"))) is True
    assert one(scalars.json_field(F.lit('{"a":{"b":[1,2]}}'), "$.a.b[1]", "int")) == 2
    assert one(scalars.json_kind(F.lit('{"a":"x"}'), "$.a")) == "STRING"
