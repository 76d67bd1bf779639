"""Domain tables derived from the driver tables, row for row, so that queries grow with them.

Orders stand for projects, line items for bill items and for the rows of
workbook sheets, events for uploads, documents and conversations for themselves
with a domain sentence added to each text.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import rules
from takeoff.sources import tables as table_ops


# What the driver's codes stand for
TYPES = ["住宅", "办公楼", "学校", "医院", "工业建筑"]
STRUCTURES = [("F", "框架结构"), ("O", "剪力墙结构"), ("P", "钢结构")]
NAME_WORDS = ["安置小区", "教学楼", "医院综合楼", "写字楼", "商场", "产业园厂房", "道路桥梁", "文化中心", "配套用房"]
PLACES = ["成都市新都区", "北京", "四川", "广元", "西南", "重庆", "上海", "江苏", "广州", "深圳", "武汉", "湖南", "西安",
          "新疆", "沈阳", "大连", "西南地区", "都江堰市", "昆明", "拉萨", "甘孜州", "华北", "海外", "", "杭州市"]
DECORATIONS = ["毛坯", "简单装修", "普通装修", "精装修", "豪华装修", ""]
GRADES = ["A", "B", "C", ""]
FOUNDATIONS = ["独立基础", "筏板基础", "桩基础", "条形基础", "桩基础（预制管桩）", "", ""]
SOILS = ["良好", "一般", "较差", "复杂", ""]
SEISMIC_GRADES = ["特一级", "一级", "二级", "三级", "四级", "none", ""]
HVACS = ["无", "分体空调", "中央空调", "多联机", ""]
WALLS = ["幕墙", "石材", "面砖", "涂料", "undefined", ""]
STAGES = ["estimation", "preliminary", "budget"]
SEGMENT_TYPES = [("MACHINERY", "工业建筑"), ("BUILDING", "住宅"), ("AUTOMOBILE", "学校"), ("FURNITURE", "办公楼"),
                 ("HOUSEHOLD", "酒店")]
REQUEST_STRUCTURES = ["框架结构", "剪力墙结构", "钢结构", "砖混结构"]
DIVISIONS = [("MEDIUM", "基础工程"), ("STANDARD", "主体结构"), ("LARGE", "屋面工程"), ("PROMO", "外墙工程"),
             ("SMALL", "楼地面")]
TRADES = ["土建", "建筑", "装饰", "安装", "装修"]
ITEMS = [("ring", "砌块墙"), ("bolt", "螺纹钢"), ("plate", "钢筋"), ("rod", "圆钢"), ("anvil", "C30混凝土"),
         ("widget", "水泥砂浆"), ("gear", "中粗砂"), ("gizmo", "防水卷材")]
CODE_HEADS = [p for p, _ in C.PREFIX4_DIVISION] + ["0301", "0999", "AB01"]
UNITS = ["1#楼 18层", "2#商业楼 6F", "地下车库", "10~12#楼"]
TITLES = ["建筑工程", "装饰工程", "市政工程"]
HEADERS = ["A 土石方工程", "砌筑工程", "屋面及防水工程", "墙、柱面装饰工程", "门窗工程", "其他零星工程"]
BILL_ITEMS = ["砌块墙", "螺纹钢", "门窗油漆", "给排水管", "C30混凝土", "水泥砂浆抹灰", "照明灯具", "防水卷材"]
E2_LABELS = ["建筑工程", "装饰工程", "安装工程", "建筑与装饰工程", "合 计", "市政"]
E3_LABELS = ["分部分项工程费", "1.1 分部分项工程", "措施项目费", "其中：措施项目", "规费", "4.1 规费", "税金", "其他"]
MEASURES = ["环境保护费", "文明施工费", "夜间施工", "其他措施"]
PROVISIONS = ["暂列金额", "材料暂估价", "计日工"]
FEES = ["规费", "税金", "养老保险费", "增值税", "失业保险"]
MATERIAL_ROWS = ["C30混凝土", "螺纹钢", "页岩砖", "地砖", "水泥", "中砂", "防水砂浆", "碎石", "SBS防水卷材", "模板"]
EXTENSIONS = [".pdf", ".PDF", ".xlsx", ".exe", ".docx", ".doc", ""]
AS_OF = "2024-01-15 00:00:00"
DOC_STRUCTURES = ["框架-剪力墙", "剪力墙结构", "框架结构", "砖混结构", "钢结构", ""]
DOC_DECORATIONS = ["精装修", "简装", "毛坯", "公共区域精装", ""]
DOC_PLACES = ["成都", "北京", "青羊", "广元", "德阳", "", "新都"]
COST_CELLS = ["1,234.5万元", "2.5亿元", "987654", "900", "合同 88,000 元"]
PHRASES = ["数据够不够？", "去哪找数据", "造价一般是多少", "帮我估算一下", "重新训练模型", "什么是概算", "模型列表", "有类似项目吗",
           "费用构成拆分", "你好", "谢谢", "你的功能有哪些", "拟建一栋8000平米住宅", "成都高新区呢", "价格偏高，为什么", "另外还有地下室",
           "换成精装修", "对比两个方案", "如果是医院", "改20层", "有没有样本", "数据涵盖学校吗", "天府呢", "今天天气"]


# sheet name and order by kind (ten) and unit (four)
SHEETS = [(f"表-08 F.1.1 {u}", i) for _ in range(3) for i, u in enumerate(UNITS)] + [
    ("表-02 汇总", 10)] * 4 + [(f"表-03 E.2 {i % 2}", 20 + i % 2) for i in range(4)] + [
    (f"表-04 E.3 {i}", 30 + i) for i in range(4)] + [("表-11 措施", 40)] * 4 + [("表-12 其他", 50)] * 3 + [
    ("表-12-1 子表", 51)] + [(f"表-13 H {i % 2}", 60 + i % 2) for i in range(4)] + [("表-21 材料", 70)] * 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    listed = F.expr("array(" + ", ".join(rules.sql_literal(v) for v in values) + ")")
    return F.get(listed, (index % len(values)).cast("int"))


def code_of(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return rules.lookup(col, pairs)


def project_meta(spark: SparkSession, sf_dir: str, area: bool = True, place: bool = True) -> DataFrame:
    """Projects from orders; area from their line items, place from the customer's nation."""
    k = F.col("o_orderkey")
    year = F.year("o_orderdate")
    cols = {
        "project_id": k, "seq": k, "name": F.concat_ws(" ", pick(NAME_WORDS, k), k.cast("string")),
        "building_type": pick(TYPES, F.substring("o_orderpriority", 1, 1).cast("int") - 1),
        "structure_type": code_of(F.col("o_orderstatus"), STRUCTURES),
        "build_year": F.when(k % 11 == 0, F.lit(None).cast("int")).when(k % 13 == 0, year + 25).otherwise(year + 20),
        "total_cost": F.col("o_totalprice") * 100, "above_ground_floors": (k % 60).cast("int"),
        "decoration_standard": F.nullif(pick(DECORATIONS, k), F.lit("")),
        "foundation_type": F.nullif(pick(FOUNDATIONS, k), F.lit("")),
        "data_quality_grade": F.nullif(pick(GRADES, F.col("o_custkey")), F.lit("")),
        "extraction_date": F.to_date("o_orderdate"),
    }
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("_cust"), *[v.alias(n) for n, v in cols.items()])
    if place:
        nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_cust"), "c_nationkey")
        df = df.join(nation, "_cust").withColumn("location", pick(PLACES, F.col("c_nationkey"))).drop("c_nationkey")
    if area:
        size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(
            F.sum("l_quantity").alias("_q"))  # whole numbers: exact in any order
        df = df.join(size, "project_id", "left").withColumn("total_area", F.col("_q") * 200).withColumn(
            "unit_price", F.col("total_cost") / F.col("total_area")).drop("_q")
    return df.drop("_cust")


def boq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill items from line items and their parts."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", code_of(F.col("p_type"), DIVISIONS).alias("division"),
        pick(TRADES, F.element_at(F.split("p_brand", "#"), 2).cast("int")).alias("trade"))
    item = F.concat_ws(" ", code_of(F.element_at(F.split("p_name", " "), 2), ITEMS), F.col("p_name"))
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("supplier"),
        F.concat(pick(CODE_HEADS, p), F.lpad(p.cast("string"), 8, "0")).alias("boq_code"), item.alias("item_name"),
        "division", "trade", F.when(F.col("l_linestatus") == "O", "m3").otherwise("t").alias("unit"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("comp_unit_price"),
        F.col("l_extendedprice").alias("total_price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("labor_fee"),
        (F.col("l_returnflag") != "R").cast("int").alias("is_active"),
        F.lit(None).cast("double").alias("price_adjust_factor"), F.lit(None).cast("int").alias("price_base_year"),
        F.lit(None).cast("double").alias("comp_unit_price_adj"), F.lit(None).cast("double").alias("total_price_adj"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook rows from line items: the supplier tells the sheet, the part the kind of row.

    Cells are made in steps, each a generated method of its own: one over 8,000 bytes would be interpreted.
    """
    p, s, line, kind, r = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("kind"), F.col("r")
    bill = kind <= 2
    title, header, subtotal, item = 1, 2, 3, 4  # rows of a bill; those of other sheets have their kind and 10
    row = (F.when(bill & (line == 1) & (p % 3 == 0), title)
           .when(bill, F.when(p % 5 == 0, header).when(p % 5 == 1, subtotal).otherwise(item)).otherwise(kind + 10))
    whole = lambda c: F.floor(c).cast("bigint").cast("string")
    code = F.when(bill, F.concat(pick(CODE_HEADS, p), F.lpad(p.cast("string"), 8, "0")))
    lines = table(spark, sf_dir, "lineitem").select(
        "*", (s % 10).alias("kind"), ((s % 10) * 4 + F.floor(s / 10) % 4).alias("sheet")).select(
        "*", row.alias("r"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("ext"), code.alias("code"))
    ext, price, code = F.col("ext"), F.col("l_extendedprice"), F.col("code")
    told = F.when(p % 7 == 0, "").when((p % 2 == 0) & code.startswith("0"), F.substring(code, 2, 20)).otherwise(code)
    cells = {
        "c0": F.when(r == title, pick(TITLES, s)).when(r.isin(item, 13), F.when((r == 13) & (p % 3 == 0), "合 计").otherwise(line.cast("string")))
        .when(r == 16, F.when(p % 5 == 0, "合计").otherwise("1")).otherwise(""),
        "c1": F.when(r == item, told).when(r < 10, "").when(r == 13, "名称").when(r == 14, pick(E2_LABELS, p)).when(r == 15, pick(E3_LABELS, p))
        .when(r == 16, pick(MEASURES, p)).when(r == 17, pick(PROVISIONS, p)).when(r == 18, pick(FEES, p)).otherwise(pick(MATERIAL_ROWS, p)),
        "c2": F.when(r == header, pick(HEADERS, F.floor(p / 5))).when(r == subtotal, "小计").when(r == item, pick(BILL_ITEMS, p))
        .when(r == 13, F.when(p % 2 == 0, ext).otherwise("-")).when(r.isin(14, 15, 17), ext).otherwise(""),
        "c3": F.when(r == item, F.concat(F.lit("规格"), (p % 9).cast("string"))).when(r < 19, "").otherwise(whole(F.col("l_quantity"))),
        "c4": F.when(r == item, F.col("l_linestatus")).when(r == 13, whole(price / 10)).otherwise(""),
        "c5": F.when(r == item, whole(F.col("l_quantity"))).when(r == 13, whole(price / 20)).when(r.isin(16, 18), ext).otherwise(""),
        "c6": F.when(r == item, whole(price / F.col("l_quantity"))).otherwise(""), "c7": F.when(r.isin(subtotal, item), ext).otherwise(""),
        "c8": F.when(r == item, whole(price * F.col("l_tax"))).otherwise(""),
        "width": F.when(r == title, 1).when(r < 10, 9).when(r.isin(13, 16, 18), 6).when(r.isin(14, 15, 17), 3).otherwise(4),
        "number": F.when(r == title, 2).when(r < 10, 8 + line.cast("bigint") * 1000000 + p % 1000000).otherwise(line + 4).cast("bigint")}
    made = F.struct(
        F.col("l_orderkey").alias("project_id"), F.lit("main.xlsx").alias("source_file"), pick([n for n, _ in SHEETS], F.col("sheet")).alias("sheet_name"),
        F.get(F.array(*[F.lit(o) for _, o in SHEETS]), F.col("sheet").cast("int")).cast("int").alias("sheet_order"),
        F.col("number").alias("row_num"), F.slice(F.array(*[f"c{i}" for i in range(9)]), F.lit(1), F.col("width")).alias("cells"))
    # a generator: later filters then read the made row instead of working it out again
    return lines.select("l_orderkey", "sheet", *[v.alias(n) for n, v in cells.items()]).select(F.explode(F.array(made)).alias("r")).select("r.*")


def merged_sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One sheet of all order lines with open cells, and its merged ranges: one an order, and long ones over up to 120,000 rows."""
    row = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    at = [F.lit(0).cast("bigint").alias("project_id"), F.lit("main.xlsx").alias("source_file"), F.lit("表-08").alias("sheet_name"), F.lit(0).alias("sheet_order")]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", row.alias("row_num")).agg(F.min("l_partkey").alias("p"))
    p = F.col("p")
    cells = F.array(F.col("row_num").cast("string"), F.when(p % 3 == 0, F.concat(F.lit("p"), p.cast("string"))), F.when(p % 5 == 0, F.concat(F.lit("v"), p.cast("string"))))
    small = lines.groupBy("l_orderkey").agg(F.min("row_num").alias("min_row")).select("min_row", (F.col("l_orderkey") * 8 + 7).alias("max_row"), F.lit(2).alias("min_col"), F.lit(2).alias("max_col"))

    def long(orders: int, rows: int, divisor: int, first: int, last: int) -> DataFrame:
        starts = lines.where(p % divisor == 0).groupBy(F.floor(F.col("l_orderkey") / orders)).agg(F.min("row_num").alias("min_row"))
        return starts.select("min_row", (F.col("min_row") + rows).alias("max_row"), F.lit(first).alias("min_col"), F.lit(last).alias("max_col"))

    ranges = small.union(long(16384, 120000, 5, 3, 3)).union(long(3000, 5000, 3, 2, 3))
    return lines.select(*at, "row_num", cells.alias("cells")), ranges.select(*at, "min_row", "max_row", "min_col", "max_col")


ROW_CHUNK = 1000  # bill rows of the stand-in are numbered line * 1e6 + part


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate requests from customers."""
    k = F.col("c_custkey")
    area = F.round(F.col("c_acctbal").cast("decimal(18,2)") * 15, 2).cast("double")
    floors = (k % 65).cast("int")
    b = lambda f, a, t: F.struct(f.cast("int").alias("floors"), a.cast("double").alias("area"), F.lit(t).alias("type"),
                                 F.lit(1).alias("basement"))
    buildings = F.when(k % 3 == 0, F.array(b(floors, area / 2, "住宅"), b(k % 20 + 1, area / 4, "商业"), b(k % 7 + 1, area / 4, "住宅"))) \
        .when(k % 3 == 1, F.array(b(floors, area, "住宅")))
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.col("c_name").alias("project_name"),
        code_of(F.col("c_mktsegment"), SEGMENT_TYPES).alias("project_type"),
        pick(REQUEST_STRUCTURES, k).alias("structure_type"), area.alias("total_area"), floors.alias("floors"),
        pick(PLACES, F.col("c_nationkey")).alias("location"), (1890 + k % 230).cast("int").alias("build_year"),
        pick(DECORATIONS, k).alias("decoration_level"), pick(STAGES, k).alias("stage"),
        pick(FOUNDATIONS, k).alias("foundation_type"), pick(SOILS, k).alias("soil_condition"),
        pick(SEISMIC_GRADES, k).alias("seismic_grade"), pick(HVACS, k).alias("hvac"), pick(WALLS, k).alias("exterior_wall"),
        buildings.alias("buildings"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model predictions per order: each model's price and its effective accuracy."""
    k = F.col("o_orderkey")
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("i")) for i, (m, *_) in enumerate(C.MODEL_REGISTRY)])
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), F.col("o_totalprice").alias("t"), F.explode(models).alias("m")) \
        .select("request_id", "m.model_id",
                F.when((F.col("request_id") + F.col("m.i")) % 5 == 0, 0.0).otherwise(
                    F.col("t") / 100 * (1 + 0.25 * F.col("m.i"))).alias("value"),
                ((F.col("request_id") * 7 + F.col("m.i") * 13) % 101).cast("double").alias("accuracy")) \
        .withColumn("weight", F.col("accuracy") / 100)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.concat(F.lit("file_"), e.cast("string"), pick(EXTENSIONS, e))
    return table(spark, sf_dir, "events").select(*table_ops.upload_record(
        F.lpad(e.cast("string"), 8, "0"), name, F.col("ts"), F.col("event_type"), F.col("value")))


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a paragraph and a table about a project added."""
    d, n = F.col("doc_id"), F.col("n_chars")
    area = (F.when(d % 4 == 0, F.concat(F.lit("总建筑面积约"), n.cast("string"), F.lit("平方米")))
            .when(d % 4 == 1, F.concat(F.lit("建筑面积"), n.cast("string"), F.lit(".5㎡")))
            .when(d % 4 == 2, F.concat(F.lit("占地面积"), n.cast("string"))).otherwise(""))
    floors = (F.when(d % 3 == 0, F.concat(F.lit("地上"), (d % 40 + 1).cast("string"), F.lit("层，地下"), (d % 4 + 1).cast("string"), F.lit("层")))
              .when(d % 3 == 1, F.concat(F.lit("共"), (d % 33 + 1).cast("string"), F.lit("楼"))).otherwise(""))
    text = F.concat_ws("\n", F.col("text"), F.when(d % 2 == 0, F.concat(F.lit("项目名称："), pick(NAME_WORDS, d), F.lit("二期"))),
                       area, floors, pick(DOC_STRUCTURES, d), pick(DOC_DECORATIONS, d), pick(DOC_PLACES, d),
                       F.when(d % 3 == 0, "2018年"))
    s = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    tables = F.array(F.array(s("序号", "名称"), s("建筑总面积", (n * 3).cast("string")), s("楼层数：12", "x")),
                     F.array(s(F.when(d % 7 == 0, "建造年").otherwise("建造年份"), (1990 + d % 40).cast("string")), s("合计", pick(COST_CELLS, d), "12000")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), d.cast("string"), F.lit(".pdf")).alias("filename"), F.lit(".pdf").alias("file_format"),
        text.alias("full_text"), tables.alias("tables"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        (n / 2000 + 1).cast("int").alias("pages"), (n < 50).alias("is_scanned"),
        F.when(d % 10 == 0, F.array(F.lit("出错: 第1页"))).otherwise(F.array().cast("array<string>")).alias("warnings"), "doc_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        c.alias("session_id"), "turn", "role", F.concat(pick(PHRASES, c * 7 + t), F.col("text")).alias("text"),
        (c * 1000 + t).alias("seq"))
