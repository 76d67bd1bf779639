"""Extraction from sheet rows: bill items, cost breakdown, fees, materials, project records.

The input is one long table of sheet rows (project, sheet, row number, cells).
Sheets are told apart by the table number in their name; cells are read by
position.  Every report is a grouped aggregate over classified rows; only the
running section of a bill sheet needs row order.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import names, rules
from takeoff.functions.numbers import comma_number, money, number_or, round_half, share, strip
from takeoff.operators import ordered, quality

SHEET = ["project_id", "source_file", "sheet_name", "sheet_order"]
BILL_SHEET = "表-08"


def cell(i: int) -> Column:
    """Trimmed text of a cell, '' when blank or outside the row."""
    return strip(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))


def number(i: int) -> Column:
    return number_or(F.get("cells", F.lit(i)))


def amount(i: int) -> Column:
    return comma_number(F.get("cells", F.lit(i)))


def width(n: int) -> Column:
    return F.size("cells") >= n


def is_kind(*words: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col("sheet_name").contains(w) for w in words])


def bill_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(is_kind(BILL_SHEET) & ~is_kind("单价措施"))


def unit_name(sheet_name: Column) -> Column:
    bare = F.regexp_replace(F.replace(sheet_name, F.lit(BILL_SHEET), F.lit("")), "^[ \\-_()（）]+|[ \\-_()（）]+$", "")
    return F.when(bare == "", F.lit("单位工程")).otherwise(bare)


def worked_out(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator: later steps read their columns and have a generated method of their own.

    One over 8,000 bytes would be left to Java's interpreter.
    """
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def sum_when(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, money(value))).cast("double"), F.lit(0.0))


def last_when(condition: Column, value: Column, *order: Column) -> Column:
    """Value of the last row (in the order) that meets the condition."""
    return F.max_by(F.when(condition, value), F.when(condition, F.struct(*order, value)))


def first_when(condition: Column, value: Column, *order: Column) -> Column:
    return F.min_by(F.when(condition, value), F.when(condition, F.struct(*order, value)))


# -- merged cells ------------------------------------------------------------

#: Sizes of the row bins that ranges are cut into: at their ends bins of the first size, between them whole ones of the others.
RANGE_BINS = (16, 1024, 65536)


def _range_pieces(ranges: DataFrame) -> DataFrame:
    """Each range as pieces (level, bin); a range has some hundred for its ends, and one for every 65,536 rows between them."""
    lo, end = F.col("min_row").cast("bigint"), F.col("max_row").cast("bigint") + 1
    down = lambda c, size: F.floor(c / size).cast("bigint")  # noqa: E731  bin of a row
    up = lambda c, size: down(c + (size - 1), size)  # noqa: E731  first bin that begins at the row or later

    def bins(level: int, first: Column, last: Column) -> Column:
        """Pieces of a level from bin `first` to before bin `last`."""
        made = F.transform(F.sequence(first, last - 1), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))
        return F.when(last > first, made).otherwise(F.array().cast("array<struct<level: int, bin: bigint>>"))

    small, middle, large = RANGE_BINS
    in_middle, in_large = middle // small, large // middle
    a1, b1, a2, b2 = up(lo, middle), down(end, middle), up(lo, large), down(end, large)
    ends = F.when(b1 > a1, F.concat(bins(0, down(lo, small), a1 * in_middle), bins(0, b1 * in_middle, up(end, small)))).otherwise(bins(0, down(lo, small), up(end, small)))
    inner = F.when(b2 > a2, F.concat(bins(1, a1, a2 * in_large), bins(1, b2 * in_large, b1))).otherwise(bins(1, a1, b1))
    pieces = F.concat(ends, inner, bins(2, a2, b2))
    return ranges.select("*", F.explode(pieces).alias("_p")).select(*ranges.columns, "_p.level", "_p.bin")


def expand_merged(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Null cells inside a merged range take its top-left value; where ranges overlap, that of the first one.

    ranges: project_id, source_file, sheet_name, sheet_order, min_row, max_row, min_col, max_col (columns counted from 1).
    Rows with a null cell meet the pieces of ranges in their bins, so a range costs some hundred rows however long it is; the
    columns are settled inside of the row.
    """
    corner = rows.select(*SHEET, F.col("row_num").alias("min_row"), F.col("cells").alias("_corner"))
    valued = ranges.join(corner, [*SHEET, "min_row"]).select(
        *SHEET, "min_row", "max_row", "min_col", "max_col", F.get("_corner", (F.col("min_col") - 1).cast("int")).alias("value"))
    pieces = _range_pieces(valued.where(F.col("value").isNotNull()))
    row = F.col("row_num").cast("bigint")
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(row / size).cast("bigint").alias("bin")) for i, size in enumerate(RANGE_BINS)])
    open_rows = rows.where(F.exists("cells", lambda c: c.isNull())).select(*SHEET, "row_num", F.explode(keys).alias("_k")).select(*SHEET, "row_num", "_k.level", "_k.bin")
    over = open_rows.join(pieces, [*SHEET, "level", "bin"]).where(row.between(F.col("min_row"), F.col("max_row")))
    per_row = over.groupBy(*SHEET, "row_num").agg(
        F.array_sort(F.collect_set(F.struct("min_row", "min_col", "max_row", "max_col", "value"))).alias("_over"))
    value = lambda i: F.get(F.filter("_over", lambda o: (i + 1).between(o["min_col"], o["max_col"])), F.lit(0))["value"]
    filled = F.transform("cells", lambda c, i: F.coalesce(c, value(i)))
    return rows.join(per_row, [*SHEET, "row_num"], "left").withColumn(
        "cells", F.when(F.col("_over").isNull(), F.col("cells")).otherwise(filled)).select(*rows.columns)


# -- bill items --------------------------------------------------------------

def bill_items(rows: DataFrame, chunk: int = ordered.CHUNK, spec_length: int | None = None) -> DataFrame:
    """Bill items of all bill sheets with section, division, trade and flags; spec texts are whole unless a length is given."""
    lines = bill_rows(rows).filter(width(8)).select(
        *SHEET, "row_num", unit_name(F.col("sheet_name")).alias("unit_project"), cell(1).alias("code"),
        cell(2).alias("item_name"), (cell(3) if spec_length is None else F.substring(cell(3), 1, spec_length)).alias("spec_text"), cell(3).alias("spec"),
        cell(4).alias("unit"),
        number(5).alias("quantity"), number(6).alias("comp_unit_price"), number(7).alias("total_price"),
        number(8).alias("labor_fee"),
    ).filter((F.col("item_name") != "") & ~names.is_summary(F.col("item_name")))
    header = names.is_section_header(F.col("item_name"), F.col("total_price"), F.col("labor_fee"))
    mark = F.when(header, F.struct(
        F.col("item_name").alias("section"), names.division_of_section(F.col("item_name")).alias("division")))
    filled = ordered.carry_forward(lines.withColumn("_header", header), SHEET, "row_num", mark, "_section", chunk,
                                   ties=("item_name", "code", "total_price"))
    staged = filled.withColumn("_code", names.bill_code(F.col("code"))).withColumn(
        "_valid", names.is_bill_code(F.col("_code")))
    calc = F.col("comp_unit_price") * F.col("quantity")
    off = (calc > 0) & (F.col("total_price") > 0) & (
        F.abs(F.col("total_price") - calc) / F.nullif(F.col("total_price"), F.lit(0.0)) > 0.01)
    return (
        staged.filter(~F.col("_header") & (F.col("_valid") | (F.col("total_price") > 0)))
        .withColumn("boq_code", F.when(F.col("_valid"), F.col("_code")).otherwise(F.format_string("SUB_%05d", "row_num")))
        .select(
            names.item_id(F.col("project_id").cast("string"), F.col("boq_code"), F.col("item_name"),
                          F.col("unit_project")).alias("item_id"),
            "project_id", "unit_project", "boq_code", "item_name", "spec_text",
            F.col("_section.section").alias("section"), F.col("_section.division").alias("division"),
            names.trade_of_item(F.col("item_name"), F.col("spec")).alias("trade"), "unit", "quantity",
            "comp_unit_price", "total_price", "labor_fee", F.lit(1).alias("is_active"),
            F.coalesce(off, F.lit(False)).cast("int").alias("flag_outlier"),
            (~F.col("_valid")).cast("int").alias("flag_code_error"))
    )


def fee_totals(rows: DataFrame) -> DataFrame:
    """All matching fee lines of all fee sheets summed per project."""
    label = cell(1)
    part = label.contains("分部分项工程") & ~label.contains("清单")
    measure = label.contains("措施项目") & ~label.contains("其中") & ~label.contains("安全")
    regulation = (label == "规费") | (label.startswith("4") & label.contains("规费"))
    kind = (F.when(part, F.when(~label.startswith("1."), "part")).when(measure, "measure")
            .when(regulation, "regulation").when(label.contains("税金"), "tax"))
    lines = rows.filter(is_kind("表-04") & width(3)).select("project_id", kind.alias("kind"), number(2).alias("v"))
    return lines.groupBy("project_id").agg(
        *[sum_when(F.col("kind") == k, F.col("v")).alias(f"{k}_fee") for k in ("part", "measure", "regulation", "tax")])


def crosscheck(items: DataFrame, fees: DataFrame) -> DataFrame:
    """Extracted sum against the fee sheet total, difference in percent; null when either is zero."""
    extracted = items.groupBy("project_id").agg(F.sum(money(F.col("total_price"))).cast("double").alias("extracted"))
    joined = extracted.join(fees.select("project_id", "part_fee"), "project_id", "left")
    a, b = F.col("extracted"), F.col("part_fee")
    return joined.select("project_id", "extracted", "part_fee",
                         F.when((a > 0) & (b > 0), round_half(F.abs(a - b) / b * 100, 2)).alias("diff_pct"))


# -- buildings of a project --------------------------------------------------

def building_units(rows: DataFrame) -> DataFrame:
    """One row a bill sheet: unit name with the floors and type its name tells."""
    units = bill_rows(rows).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("sheet_rows"))
    name = unit_name(F.col("sheet_name"))
    return units.select("project_id", "sheet_order", name.alias("unit_project"),
                        names.unit_floors(name).alias("floors"), names.unit_type(name).alias("type"))


def building_summary(units: DataFrame) -> DataFrame:
    """Building count, floor range and mixed types; a single unit gives the neutral row."""
    n = F.count(F.lit(1))
    types = reduce(lambda a, b: a + b, [
        F.max((F.col("type") == t).cast("int")) for t in ["住宅", *[t for t, _ in C.UNIT_TYPE_WORDS]]])
    return units.groupBy("project_id").agg(
        n.alias("building_count"), F.when(n > 1, F.max("floors")).alias("max_floor"),
        F.when(n > 1, F.min("floors")).alias("min_floor"), ((n > 1) & (types > 1)).alias("mixed_types"))


def building_list(units: DataFrame, segment: int = 1000, name_length: int | None = None) -> DataFrame:
    """JSON lists of the buildings in sheet order, in segments of sheet numbers so no list grows without bound."""
    name = F.col("unit_project") if name_length is None else F.substring("unit_project", 1, name_length)
    entry = F.struct("sheet_order", F.struct(
        name.alias("name"), F.coalesce("floors", F.lit(1)).alias("floors"), "type"
    ).alias("b"))
    return units.groupBy("project_id", F.floor(F.col("sheet_order") / segment).alias("segment")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["b"])).alias("buildings_json"))


# -- cost breakdown ----------------------------------------------------------

def breakdown(rows: DataFrame) -> DataFrame:
    """Cost breakdown per project: first one row a sheet, then the sheets of a project together."""
    e2 = is_kind("表-03", "E.2")
    f11 = is_kind("表-08", "F.1.1") & ~e2
    e3 = is_kind("表-04", "E.3") & ~e2 & ~f11
    h13 = is_kind("表-13", "H") & ~e2 & ~f11 & ~e3
    kind = F.when(e2, "e2").when(f11, "f11").when(e3, "e3").when(h13, "h13")
    raw = lambda i: F.get("cells", F.lit(i))
    bill, told = F.col("kind") == "f11", F.when(F.col("kind").isin("e2", "e3"), raw(2)).when(F.col("kind") == "f11", raw(7)).otherwise(raw(5))
    lines = rows.withColumn("kind", kind).filter("kind is not null").select(
        *SHEET, "row_num", "kind", F.when(bill, cell(0)).alias("seq"), cell(1).alias("label"), comma_number(told).alias("v"),
        F.when(bill, amount(8)).alias("labor"))

    seq, label, v, row, k = F.col("seq"), F.col("label"), F.col("v"), F.col("row_num"), F.col("kind")
    building = (label.contains("建筑") & ~label.contains("装饰") & ~label.contains("安装")) | \
        label.contains("建筑与装饰") | label.contains("建筑及装饰")
    trade = F.when(building, "building").when(label.contains("装饰"), "decoration").otherwise("installation")
    fee = (F.when(label.contains("分部分项工程费") | label.startswith("分部分项"), "part")
           .when(label.contains("措施项目") | label.startswith("措施"), "measure")
           .when(label.contains("规费") & ~label.contains("税金"), "regulation").when(label.contains("税金"), "tax"))
    arch_title = (k == "f11") & (row == 2) & (seq.contains("建筑工程") | seq.contains("建筑与装饰"))
    deco_title = (k == "f11") & (row == 2) & seq.contains("装饰工程")
    lines = lines.select(
        *SHEET, "row_num", "kind", "v", "labor", arch_title.alias("arch_title"), (arch_title | deco_title).alias("wanted_title"),
        F.when((k == "e2") & row.between(5, 50) & (label != "") & (v != 0), trade)
        .when((k == "f11") & (row >= 8) & seq.rlike("^[0-9]+$") & (label != ""), names.division_of_prefix4(label))
        .when((k == "e3") & row.between(4, 25) & (label != "") & v.isNotNull(), fee)
        .when((k == "h13") & row.between(4, 30) & label.contains("养老保险") & (v > 0), "pension").alias("class"))
    cls = F.col("class")
    f11_row = (k == "f11") & cls.isNotNull()
    e3_row = k == "e3"
    pension = cls == "pension"

    def fee_line(name: str) -> Column:
        return F.coalesce(last_when(e3_row & (cls == name), v, row), F.lit(0.0)).alias(f"{name}_fee")

    per_sheet = lines.groupBy(*SHEET, "kind").agg(
        *[sum_when((k == "e2") & (cls == t), v).alias(t) for t in ("building", "decoration", "installation")],
        *[round_half(sum_when(f11_row & (cls == d), v), 2).alias(f"div{i}") for i, d in enumerate(C.MAIN_DIVISIONS)],
        round_half(sum_when(f11_row, F.col("labor")), 2).alias("labor"),
        *[fee_line(n) for n in ("part", "measure", "regulation", "tax")],
        first_when(pension, v, row).alias("pension"),
        F.coalesce(F.max("arch_title"), F.lit(False)).alias("arch"),
        F.coalesce(F.max("wanted_title"), F.lit(False)).alias("wanted"))

    used = F.col("wanted") | (F.col("kind") != "f11")
    has_pension = F.col("pension").isNotNull()

    def total(name: str) -> Column:
        return round_half(sum_when(used, F.col(name)), 2)

    def sheets_of(k: str) -> Column:
        return F.count(F.when((F.col("kind") == k) & (F.col("arch") | (F.col("kind") != "f11")), 1)).cast("int")

    labels = ["foundation_division_cost", "main_structure_cost", "roofing_cost", "exterior_wall_cost"]
    per_project = per_sheet.groupBy("project_id").agg(
        total("building").alias("building_trade_cost"), total("decoration").alias("decoration_trade_cost"),
        total("installation").alias("installation_trade_cost"),
        *[total(f"div{i}").alias(c) for i, c in enumerate(labels)],
        total("part_fee").alias("part_item_cost"), total("measure_fee").alias("measure_cost"),
        total("regulation_fee").alias("regulation_cost"), total("tax_fee").alias("tax_cost"),
        total("labor").alias("_labor"), first_when(has_pension, F.col("pension"), F.col("sheet_order")).alias("_pension"),
        *[sheets_of(k).alias(f"{k}_count") for k in ("e2", "f11", "e3", "h13")])
    reverse = round_half(F.col("_pension") / C.PENSION_RATE, 2)
    errors = F.array_compact(F.array(*[
        F.when(F.col(f"{k}_count") == 0, F.lit(f"no {k} sheet")) for k in ("e2", "f11", "e3")]))
    return per_project.withColumns({
        "labor_cost": F.when(F.col("_labor") > 0, F.col("_labor")).otherwise(reverse),
        "labor_source": F.when(F.col("_labor") > 0, "f11_c9_sum").when(reverse > 0, "h13_pension_reverse"),
        "extraction_errors": F.to_json(errors),
    }).drop("_labor", "_pension")


# -- project records ---------------------------------------------------------

def sheet_coverage(rows: DataFrame) -> DataFrame:
    """Which key sheets a project has, how many sheets, and whether there is an info sheet."""
    return rows.groupBy("project_id").agg(
        *[F.max(is_kind(k)).alias(f"has_{k[2:]}") for k in C.SHEET_KINDS],
        F.countDistinct("sheet_name").alias("sheet_count"),
        F.max(F.coalesce(F.col("source_file").contains("项目信息"), F.lit(False))).alias("has_info"))


def sheet_histogram(rows: DataFrame) -> DataFrame:
    """Sheets per kind, the first matching kind counts."""
    kind = F.coalesce(rules.first_contained(F.col("sheet_name"), C.SHEET_HISTOGRAM_KINDS), F.lit("other"))
    return rows.select("project_id", "sheet_name").distinct().groupBy(kind.alias("sheet_kind")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("sheet_kind")


def first_sheets(rows: DataFrame, n: int = 1) -> DataFrame:
    """The first n sheets of each kind in a workbook, in sheet order; sheets of no kind are left out."""
    kind = rules.first_contained(F.col("sheet_name"), C.SHEET_HISTOGRAM_KINDS)
    known = rows.select(*SHEET, kind.alias("sheet_kind")).filter(F.col("sheet_kind").isNotNull()).distinct()
    place = Window.partitionBy("project_id", "source_file", "sheet_kind").orderBy("sheet_order", "sheet_name")
    return known.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)


def sheet_text(rows: DataFrame, segment: int = 10000) -> DataFrame:
    """Non-blank rows as text, cells tab-joined and rows newline-joined, in segments of row numbers."""
    lines = rows.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")).select(
        *SHEET, F.floor(F.col("row_num") / segment).alias("segment"),
        F.struct("row_num", F.array_join("cells", "\t", "").alias("line")).alias("r"))
    return lines.groupBy(*SHEET, "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("text"))


def material_class(name: Column) -> Column:
    """First matching material class; exclusions inside a class do not fall through to a later one for sand."""
    upper = F.upper(name)

    def has(*words: str) -> Column:
        return rules.contains_any(name, list(words))

    steel = has("钢筋", "螺纹钢", "圆钢", "钢材") | upper.contains("HRB") | upper.contains("HPB")
    block = (has("砌块", "加气") | (has("砖") & ~has(*C.BLOCK_EXCLUDED)) | (has("页岩") & has(*C.BLOCK_KINDS))
             | (has("烧结") & has("实心", "空心", "多孔")))
    water = has("防水") & (has("卷材", "薄膜") | upper.contains("SBS"))
    return rules.chain([
        (has("混凝土", "砼"), F.lit("混凝土总用量")), (steel, F.lit("钢筋总用量")), (block, F.lit("砌块总用量")),
        (has("水泥"), F.lit("水泥总用量")),
        (has("砂"), F.when(~has("防水", "模板"), F.lit("砂总用量"))),
        (has("碎石", "卵石", "砾石"), F.lit("碎石总用量")), (water, F.lit("防水卷材总用量")),
        (has("模板"), F.lit("模板总用量"))])


def section_costs(rows: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """Section subtotals put to the running section, and labour of data rows, per project."""
    lines = bill_rows(rows).filter(width(3)).select(
        *SHEET, "row_num", cell(2).alias("name"), number(7).alias("v"), number(8).alias("labor")).filter("name <> ''")
    subtotal = F.col("name").contains("小计")
    total = ~subtotal & F.col("name").contains("合计")
    empty = ~subtotal & ~total & (F.col("v") == 0) & (F.col("labor") == 0)
    header = empty & names.is_section_header(F.col("name"), F.col("v"), F.col("labor"))
    mark = F.when(header, F.struct(F.col("name").alias("section")))
    filled = ordered.carry_forward(lines, SHEET, "row_num", mark, "_s", chunk, ties=("name", "v"))
    field = names.cost_field_of_section(F.col("_s.section"))
    work = ~subtotal & ~total & ~empty & (F.col("labor") > 0)
    return filled.withColumn("_field", field).groupBy("project_id").agg(
        sum_when(work, F.col("labor")).alias("人工费"),
        *[sum_when(subtotal & (F.col("_field") == f), F.col("v")).alias(f) for f, _ in C.SECTION_COST_WORDS])


def sheet_costs(rows: DataFrame) -> DataFrame:
    """Fees, trades, materials and bill statistics of all other sheets, with the source priority applied.

    The kind of a row and its parsed cells are worked out once; the aggregates then only compare columns.
    """
    bill = is_kind(BILL_SHEET) & ~is_kind("单价措施") & width(8)
    kind = (F.when(is_kind("表-02") & width(3), "02").when(is_kind("表-03") & width(3), "03").when(bill, "08")
            .when(is_kind("表-11") & width(6), "11").when(is_kind("表-12") & ~is_kind("表-12-") & width(3), "12")
            .when(is_kind("表-13") & width(6), "13").when(is_kind("表-21") & width(4), "21"))
    k = F.col("kind")
    # only the cells that a kind of sheet reads are parsed
    raw = lambda i: F.get("cells", F.lit(i))
    told = F.when(k.isin("03", "12"), raw(2)).when(k == "08", raw(7)).when(k == "21", raw(3)).otherwise(raw(5))
    parsed = rows.select(*SHEET, "row_num", kind.alias("kind"), "cells").select(
        *SHEET, "row_num", "kind", F.when(k.isin("02", "11"), cell(0)).alias("c0"), F.when(k.isin("03", "11", "12", "13", "21"), cell(1)).alias("c1"),
        F.when(k == "08", cell(2)).alias("c2"), *[F.when(k == "02", raw(i)).alias(f"n{i}") for i in (2, 4, 5)], told.alias("told"))
    c0, c1, c2 = F.col("c0"), F.col("c1"), F.col("c2")
    lines = worked_out(parsed).withColumns({
        "v": number_or(F.col("told")),
        "class": (
            F.when(k == "03", F.when(c1.contains("合") & c1.contains("计"), None)
                   .when(c1.contains("建筑") & (c1.contains("工程") | c1.contains("土建")), "arch")
                   .when(c1.contains("装饰") | c1.contains("装修"), "deco").when(c1.contains("安装"), "inst"))
            .when(k == "11", F.when(c0.contains("合计") | c1.contains("合计"), "total")
                  .when(rules.contains_any(c1, C.SAFETY_WORDS), "safety"))
            .when(k == "13", F.when(c1 == "规费", "regulation").when(c1.contains("税金") | c1.contains("增值税"), "tax"))
            .when(k == "12", F.when(c1.contains("暂列") | c1.contains("暂估"), "provisional"))
            .when((k == "08") & (c2 != "") & ~c2.contains("小计") & ~c2.contains("合计"), "item")
            .when((k == "21") & (c1 != ""), material_class(c1)))})
    lines = lines.withColumns({f"n{i}": F.when(k == "02", number_or(F.col(f"n{i}"))) for i in (2, 4, 5)})
    row, order, v, cls = F.col("row_num"), F.col("sheet_order"), F.col("v"), F.col("class")
    total02 = (k == "02") & c0.contains("合") & c0.contains("计")
    pos = lambda c: F.greatest(F.col(c), F.lit(0.0))
    first02 = F.struct(F.when(F.col("n2") > 0, F.col("n2")).otherwise(F.col("n4")).alias("cost"), pos("n4").alias("safety"),
                       pos("n5").alias("regulation"))

    def of(name: str) -> Column:
        return sum_when((cls == name) & (v > 0), v)

    per_sheet = lines.groupBy(*SHEET).agg(
        first_when(total02, first02, row).alias("t02"), *[of(t).alias(t) for t in ("arch", "deco", "inst")],
        last_when((cls == "total") & (v > 0), v, row).alias("measure11"), of("safety").alias("safety11"),
        of("regulation").alias("regulation13"), of("tax").alias("tax13"),
        F.count(F.when((cls == "item") & (v > 0), 1)).alias("items08"), of("item").alias("amount08"),
        of("provisional").alias("provisional"), *[of(m).alias(m) for m in C.MATERIAL_FIELDS])
    is02, is03 = is_kind("表-02"), is_kind("表-03")
    first03 = F.min_by(F.struct("arch", "deco", "inst"), F.when(is03, order))
    return per_sheet.groupBy("project_id").agg(
        F.min_by("t02", F.when(is02, order)).alias("t02"), first03.alias("t03"),
        last_when(F.col("measure11").isNotNull(), F.col("measure11"), order).alias("measure11"),
        *[sum_when(F.lit(True), F.col(c)).alias(c) for c in ("safety11", "regulation13", "tax13", "amount08", "provisional")],
        F.sum("items08").alias("items08"), *[sum_when(F.lit(True), F.col(m)).alias(m) for m in C.MATERIAL_FIELDS])


def first_positive(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in cols], F.lit(0.0))


def workbook_costs(rows: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """Everything the main workbook tells about a project, fees taken from the best source."""
    joined = sheet_costs(rows).join(fee_totals(rows), "project_id", "left").join(
        section_costs(rows, chunk), "project_id", "left")
    zero = F.lit(0.0)
    return joined.select(
        "project_id", F.coalesce("t02.cost", zero).alias("total_cost"),
        first_positive(F.col("measure11"), F.col("measure_fee")).alias("措施费"),
        first_positive(F.col("safety11"), F.col("t02.safety")).alias("安全文明施工费"),
        first_positive(F.col("regulation13"), F.col("regulation_fee"), F.col("t02.regulation")).alias("规费"),
        first_positive(F.col("tax13"), F.col("tax_fee")).alias("税金"),
        F.coalesce("part_fee", zero).alias("分部分项费"),
        *[F.coalesce(c, zero).alias(c) for c in ["人工费", *[f for f, _ in C.SECTION_COST_WORDS]]],
        F.coalesce("t03.arch", zero).alias("建筑工程费"), F.coalesce("t03.deco", zero).alias("装饰工程费"),
        F.coalesce("t03.inst", zero).alias("安装工程费"),
        F.col("items08").alias("清单项目数"), F.col("amount08").alias("清单总合价"),
        F.col("provisional").alias("暂列金额"), *C.MATERIAL_FIELDS)


INFO_COLUMNS = ["name", "type", "category_structure", "build_area", "above_ground_floors", "address",
                "decoration_situation", "settlement_price", "sign_price", "cost_unilateral"]


def info_values(rows: DataFrame, key_cell: int, value_cell: int, fields: list[tuple[str, str]]) -> DataFrame:
    """Key/value sheet turned into columns; blank words count as missing and the last row of a key wins."""
    value = F.when(~F.lower(cell(value_cell)).isin("none", "", "-", "nan"), cell(value_cell))
    lines = rows.select("project_id", "row_num", cell(key_cell).alias("k"), value.alias("v")).filter(
        F.col("k").isin([k for k, _ in fields]) & F.col("v").isNotNull())
    return lines.groupBy("project_id").agg(
        *[last_when(F.col("k") == k, F.col("v"), F.col("row_num")).alias(name) for k, name in fields])


def info_sheet(rows: DataFrame) -> DataFrame:
    """Structural facts of the info workbook, with grades told by the material prices."""
    fields = [*C.INFO_FIELDS, ("混凝土价格", "_concrete"), ("钢筋价格", "_steel")]
    facts = info_values(rows.filter(F.col("source_file").contains("项目信息")), 0, 1, fields)
    concrete, steel = F.nullif(comma_number(F.col("_concrete")), F.lit(0.0)), F.nullif(
        comma_number(F.col("_steel")), F.lit(0.0))
    return facts.select("project_id", *[c for _, c in C.INFO_FIELDS], names.concrete_grade(concrete).alias("concrete_grade"),
                        names.steel_grade(steel).alias("steel_grade"))


def project_records(rows: DataFrame, folders: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """One training record a project from its workbook and, where there is one, its info sheet.

    folders: project_id, folder.  Projects with no main workbook rows give no record.
    """
    info_part = F.coalesce(F.col("source_file").contains("项目信息"), F.lit(False))
    main = rows.filter(~info_part)
    info = info_values(rows.filter(info_part), 3, 1, [(c, f"i_{c}") for c in INFO_COLUMNS])
    has_info = rows.filter(info_part).select("project_id").distinct().withColumn("_has_info", F.lit(True))
    cover = sheet_coverage(main).drop("has_info")
    joined = (folders.join(workbook_costs(main, chunk), "project_id").join(cover, "project_id")
              .join(info, "project_id", "left").join(has_info, "project_id", "left"))

    title = names.folder_title(F.col("folder"))
    found_area = number_or(F.col("i_build_area"))
    area = F.when(found_area > 0, found_area).when(F.col("total_cost") > 0, F.col("total_cost") / C.AREA_COST_DIVISOR)\
        .otherwise(0.0)
    cost = first_positive(F.col("total_cost"), number_or(F.col("i_settlement_price")), number_or(F.col("i_sign_price")))
    told_unit = number_or(F.col("i_cost_unilateral"))
    grade = quality.source_grade(F.coalesce("_has_info", F.lit(False)), {k: F.col(f"has_{k[2:]}") for k in C.SHEET_KINDS})
    rest = F.greatest(F.col("清单总合价") - F.col("人工费"), F.lit(0.0))
    base = joined.withColumns({"_area": area, "_cost": cost, "_rest": rest, "_grade": grade}).withColumn(
        "_unit", F.when(told_unit > 0, told_unit).when((F.col("_area") > 0) & (F.col("_cost") > 0),
                                                     F.col("_cost") / F.nullif(F.col("_area"), F.lit(0.0)))
        .otherwise(0.0))
    whole, a = round_half(F.col("_cost"), 2), F.col("_area")
    amounts = ["人工费", "措施费", "规费", "税金", *[f for f, _ in C.SECTION_COST_WORDS], *C.MATERIAL_FIELDS,
               "建筑工程费", "装饰工程费", "安装工程费", "清单总合价", "暂列金额"]

    def per_area(c: str) -> Column:
        return F.when(a > 0, round_half(round_half(F.col(c), 2) / F.nullif(a, F.lit(0.0)), 4)).otherwise(0.0)

    return base.select(
        "project_id", F.coalesce("i_name", title).alias("项目名称"), names.building_type(title, F.col("i_type")).alias("建筑类型"),
        F.coalesce(names.structure_type(F.col("i_category_structure")), F.lit(C.DEFAULT_STRUCTURE)).alias("结构类型"),
        round_half(a, 2).alias("总建筑面积"), names.floor_count(F.col("i_above_ground_floors")).alias("楼层数"),
        names.address_region(F.col("i_address")).alias("所在地区"), F.lit(C.DEFAULT_YEAR).alias("建造年份"),
        F.coalesce("i_decoration_situation", F.lit(C.DEFAULT_DECORATION)).alias("装修标准"), whole.alias("项目总造价"),
        round_half(F.col("_unit"), 2).alias("单方造价"),
        *[round_half(F.col(c), 2).alias(c) for c in amounts], "清单项目数",
        *[round_half(F.col("_rest") * p, 2).alias(n) for n, p in C.NON_LABOR_SHARES],
        F.when(a > 0, round_half(F.col("混凝土总用量") / F.nullif(a, F.lit(0.0)), 4)).otherwise(0.0).alias("混凝土单方耗量"),
        *[share(round_half(F.col(c), 2), whole).alias(f"{c}比例")
          for c in ["基础工程费", "主体结构费", "屋面工程费", "外墙工程费", "人工费"]],
        per_area("钢筋总用量").alias("钢筋单方用量"), per_area("混凝土总用量").alias("混凝土单方用量"),
        per_area("砌块总用量").alias("砌块单方用量"), F.col("_grade").alias("source_type"),
        rules.lookup(F.col("_grade"), [("A", "high"), ("B", "medium")], "low").alias("data_confidence"),
        F.array_compact(F.array(F.when(whole <= 0, F.lit("no_cost")), F.when(a <= 0, F.lit("no_area")))).alias("errors"))


def batch_outcome(records: DataFrame, folders: DataFrame, done: DataFrame) -> DataFrame:
    """Projects per status and reason: skipped when done before, failed without a record, else ok."""
    def outcome(status: str, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    status = (F.when(F.col("_done").isNotNull(), outcome("skipped", F.lit("already done")))
              .when(F.col("errors").isNull(), outcome("failed", F.lit("no main workbook")))
              .otherwise(outcome("ok", F.array_join("errors", ","))))
    return (folders.select("project_id").join(records.select("project_id", "errors"), "project_id", "left")
            .join(done.select("project_id").distinct().withColumn("_done", F.lit(1)), "project_id", "left")
            .select(status.alias("s")).groupBy("s.status", "s.reason").agg(F.count(F.lit(1)).alias("n")))


# -- metadata enrichment -----------------------------------------------------

def overview_facts(rows: DataFrame) -> DataFrame:
    """What the text of the first overview sheet of a project tells.

    The text is never put together: the rank of the first matching pattern, the
    largest year and the largest floor number are aggregates over its rows.
    """
    overview = is_kind("表-01") | (F.col("sheet_name").startswith("D ") & is_kind("工程计价总说明"))
    text = F.array_join("cells", "\n")
    lines = rows.filter(overview).select(
        "project_id", "sheet_order",
        rules.first_pattern_rank(text, C.STRUCTURE_PATTERNS).alias("structure"),
        rules.first_pattern_rank(text, C.SHEET_DECORATION_PATTERNS).alias("decoration"),
        rules.first_pattern_rank(text, C.FOUNDATION_PATTERNS).alias("foundation"),
        rules.first_pattern_rank(text, C.QUOTA_YEARS).alias("quota"),
        names.max_number(text, "(20\\d{2})年").alias("year"), names.max_number(text, "(\\d+)\\s*层").alias("above"),
        names.max_number(text, "[地底]下?\\s*(\\d+)\\s*层").alias("under"))
    ranks = ["structure", "decoration", "foundation", "quota"]
    per_sheet = lines.groupBy("project_id", "sheet_order").agg(
        *[F.min(c).alias(c) for c in ranks], *[F.max(c).alias(c) for c in ("year", "above", "under")])
    first = per_sheet.groupBy("project_id").agg(
        F.min_by(F.struct(*ranks, "year", "above", "under"), "sheet_order").alias("t"))
    year = F.coalesce(rules.value_at_rank(F.col("t.quota"), C.QUOTA_YEARS), F.col("t.year"))
    return first.select(
        "project_id", rules.value_at_rank(F.col("t.structure"), C.STRUCTURE_PATTERNS).alias("structure_type"),
        year.alias("build_year"),
        rules.value_at_rank(F.col("t.decoration"), C.SHEET_DECORATION_PATTERNS).alias("decoration_standard"),
        rules.value_at_rank(F.col("t.foundation"), C.FOUNDATION_PATTERNS).alias("foundation_type"),
        F.nullif(F.col("t.above"), F.lit(0)).alias("above_ground_floors"),
        F.nullif(F.col("t.under"), F.lit(0)).alias("under_ground_floors"))


ENRICHED = ["structure_type", "build_year", "decoration_standard", "foundation_type", "above_ground_floors",
            "under_ground_floors"]


def enrich(projects: DataFrame, facts: DataFrame) -> DataFrame:
    """Fill missing metadata from the overview sheet, else from the project name; tag the source."""
    numeric = {"build_year", "above_ground_floors", "under_ground_floors"}
    joined = projects.join(facts.select("project_id", *[F.col(c).alias(f"_f_{c}") for c in ENRICHED]), "project_id", "left")
    empty = {c: F.col(c).isNull() | (F.col(c) == (0 if c in numeric else "")) for c in ENRICHED}
    from_sheet = {c: F.when(empty[c], F.col(f"_f_{c}")) for c in ENRICHED}
    extracted = reduce(lambda a, b: a | b, [v.isNotNull() for v in from_sheet.values()])
    from_name = {
        "structure_type": F.when(empty["structure_type"], names.structure_of_name(F.col("name"))),
        "decoration_standard": F.when(empty["decoration_standard"], names.decoration_of_name(F.col("name")))}
    inferred = ~extracted & reduce(lambda a, b: a | b, [v.isNotNull() for v in from_name.values()])
    tagged = joined.withColumns({"_x": extracted, "_i": inferred, **{f"_s_{c}": v for c, v in from_sheet.items()},
                                 **{f"_n_{c}": v for c, v in from_name.items()}})
    new = {}
    for c in ENRICHED:
        name_value = F.when(F.col("_i"), F.col(f"_n_{c}")) if c in from_name else F.lit(None)
        new[c] = F.coalesce(F.col(f"_s_{c}"), name_value, F.col(c))
    out = tagged.withColumns({
        **new,
        "field_source": F.when(F.col("_x"), "extracted").when(F.col("_i"), "inferred").otherwise(F.col("field_source")),
        "outcome": F.when(F.col("_x"), "extracted").when(F.col("_i"), "inferred").otherwise("failed"),
        **{f"filled_{c}": (F.col(f"_s_{c}").isNotNull() | (
            (F.col("_i") & F.col(f"_n_{c}").isNotNull()) if c in from_name else F.lit(False))) for c in ENRICHED}})
    out = out.withColumn("metadata_completeness", quality.filled_share([F.col(c) for c in ENRICHED]))
    return out.select(*projects.columns, *[c for c in ("outcome", "metadata_completeness", *[f"filled_{c}" for c in ENRICHED])
                                           if c not in projects.columns])


def enrich_stats(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("extracted", "inferred", "failed")],
        *[F.count(F.when(F.col(f"filled_{c}"), 1)).alias(f"filled_{c}") for c in ENRICHED])


def buildings_from_floors(floors: Column, count: Column, kind: Column) -> dict[str, Column]:
    """Multi-building columns of a list of floors such as 18,18,33, read up to the stated number of buildings."""
    parts = F.slice(F.split(floors, "[,，\\s]+"), F.lit(1), F.greatest(count, F.lit(1)))
    numbers = F.filter(F.transform(parts, lambda s: s.try_cast("int")), lambda n: n.isNotNull())
    used = F.when((count > 1) & (F.coalesce(floors, F.lit("")) != ""), numbers)
    return {
        "max_floor": F.array_max(used), "min_floor": F.array_min(used),
        "buildings_json": F.when(F.size(used) > 0, F.to_json(F.transform(
            used, lambda f: F.struct(f.alias("floors"), F.coalesce(kind, F.lit("住宅")).alias("type"))))),
    }
