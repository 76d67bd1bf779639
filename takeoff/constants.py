"""Fixed values.

Everything in this module is a domain constant: word lists, lookup tables,
ratios, thresholds and text formats.  Results are only right when they equal
the published values, so they are stated plainly here and nowhere else.
Order matters wherever a list is matched "first hit wins".
"""

# --------------------------------------------------------------------------
# Project table fields
# --------------------------------------------------------------------------
REQUIRED_FIELDS = ["项目名称", "建筑类型", "结构类型", "总建筑面积", "楼层数", "所在地区", "建造年份", "装修标准",
                   "项目总造价", "单方造价"]
OPTIONAL_FIELDS = ["人工费", "材料费", "机械费", "措施费", "企业管理费", "规费", "利润", "税金",
                   "基础工程费", "主体结构费", "屋面工程费", "外墙工程费",
                   "混凝土总用量", "钢筋总用量", "砌块总用量",
                   "水泥总用量", "砂总用量", "碎石总用量", "防水卷材总用量", "模板总用量",
                   "建筑工程费", "装饰工程费", "安装工程费",
                   "清单项目数", "清单总合价", "暂列金额"]

# Quality gate of the import
UNIT_PRICE_RANGE = (500, 50000)

# Sample weights and grades
SAMPLE_WEIGHTS = [("A", "high", 1.0), ("B", "medium", 0.7), ("C", "low", 0.5)]
OTHER_SAMPLE_WEIGHT = 0.7
NO_SOURCE_WEIGHT = 0.3
GRADE_WEIGHT = [("A", 1.0), ("B", 0.7), ("C", 0.5)]
GRADE_CONFIDENCE_LABEL = [("A", "high"), ("B", "medium")]
LABEL_CONFIDENCE = [("high", 0.9), ("medium", 0.7), ("low", 0.5)]

# --------------------------------------------------------------------------
# Ordered keyword rules (value, keywords), first hit wins
# --------------------------------------------------------------------------
BUILDING_TYPE_WORDS = [
    ("住宅", ["住宅", "居住", "安置", "小区", "公租房", "住房", "宿舍", "公寓", "棚户"]),
    ("商业建筑", ["商业", "商铺", "商场", "营业", "门店", "商业开发"]),
    ("办公楼", ["办公", "写字楼", "行政", "业务"]),
    ("学校", ["学校", "学院", "幼儿园", "教学", "教育", "文轩"]),
    ("医院", ["医院", "卫生", "医疗"]),
    ("工业建筑", ["厂房", "工业", "车间", "产业园", "产业"]),
    ("基础设施", ["基础设施", "道路", "桥梁", "管网", "市政"]),
    ("公共建筑", ["文化", "图书", "展览", "体育", "综合", "服务", "活动"]),
]
DEFAULT_BUILDING_TYPE = "住宅"

DOCUMENT_TYPE_WORDS = [
    ("住宅", ["住宅", "安置", "小区", "住房", "公寓", "别墅", "公租房", "保障房"]),
    ("学校", ["学校", "学院", "幼儿园", "教学", "校区", "教育"]),
    ("医院", ["医院", "卫生", "医疗", "诊所"]),
    ("商业建筑", ["商业", "酒店", "商场", "宾馆", "饭店", "度假", "商铺"]),
    ("办公楼", ["办公", "写字楼", "行政", "商务楼"]),
    ("工业建筑", ["厂房", "工业", "车间", "仓库", "产业园"]),
    ("基础设施", ["基础设施", "道路", "桥梁", "管网", "市政", "隧道"]),
    ("公共建筑", ["文化", "图书", "展览", "体育", "综合", "服务", "活动"]),
]

TYPE_SYNONYMS = [
    ("住宅", ["住宅", "安置", "小区", "住房", "公寓", "别墅"]),
    ("学校", ["学校", "学院", "教育", "教学", "校区", "幼儿园"]),
    ("医院", ["医院", "卫生", "医疗", "诊所"]),
    ("办公楼", ["办公", "写字楼", "行政", "商务楼"]),
    ("商业建筑", ["商业", "商铺", "商场", "酒店", "宾馆", "饭店", "旅馆", "度假", "餐饮"]),
    ("工业建筑", ["厂房", "工业", "车间", "仓库"]),
    ("基础设施", ["道路", "桥梁", "管网", "市政", "隧道"]),
    ("公共建筑", ["文化", "图书", "展览", "体育", "综合", "服务", "活动"]),
]

SIMILAR_NAME_WORDS = [
    ("住宅", ["住宅", "安置", "小区", "楼", "住房", "公苑", "居", "苑", "房", "新村", "花园", "家园"]),
    ("学校", ["学校", "学院", "教育", "教学", "校区"]),
    ("商业建筑", ["商业", "商铺", "商场", "营业"]),
    ("办公楼", ["办公", "写字楼", "行政"]),
    ("公共建筑", ["文化", "图书", "展览", "体育", "综合", "整治", "环境", "服务"]),
    ("工业建筑", ["厂房", "工业", "车间", "产业园"]),
    ("基础设施", ["道路", "桥梁", "管网", "市政"]),
]

STRUCTURE_WORDS = [
    ("框剪结构", ["框架及剪力墙"]),
    ("框剪结构", ["框架剪力墙"]),
    ("框剪结构", ["框剪"]),
    ("框架结构", ["框架结构", "框架"]),
    ("砖混结构", ["砖混"]),
    ("钢结构", ["钢结构"]),
    ("框剪结构", ["剪力墙"]),
]
VALID_STRUCTURES = ["框架结构", "框剪结构", "砖混结构", "钢结构", "其他结构"]
DEFAULT_STRUCTURE = "框架结构"

DIVISION_WORDS = [
    ("基础工程", ["土（石）方工程", "土石方工程", "桩与地基基础", "桩基工程", "支护工程", "地基处理", "基坑支护"]),
    ("主体结构", ["砌筑工程", "混凝土及钢筋混凝土", "金属结构工程", "钢筋混凝土", "混凝土工程"]),
    ("屋面工程", ["屋面及防水工程", "屋面防水", "屋面工程"]),
    ("外墙工程", ["墙、柱面装饰", "幕墙工程", "墙、柱面工程", "墙面装饰"]),
    ("楼地面", ["楼地面工程", "地面工程"]),
    ("天棚", ["天棚工程", "吊顶工程"]),
    ("门窗", ["门窗工程"]),
    ("油漆涂料", ["油漆、涂料、裱糊", "油漆涂料"]),
]
SECTION_COST_WORDS = [
    ("基础工程费", ["土（石）方工程", "土石方工程", "桩与地基基础", "桩基工程", "支护工程", "地基处理", "基坑支护"]),
    ("主体结构费", ["砌筑工程", "混凝土及钢筋混凝土", "金属结构工程", "钢筋混凝土", "混凝土工程"]),
    ("屋面工程费", ["屋面及防水工程", "屋面防水", "屋面工程"]),
    ("外墙工程费", ["墙、柱面装饰", "幕墙工程", "墙、柱面工程", "墙面装饰"]),
]
TRADE_WORDS = [
    ("土建", ["混凝土", "钢筋", "模板", "砌体", "砌筑", "土方", "桩基"]),
    ("装饰", ["抹灰", "涂料", "油漆", "瓷砖", "吊顶", "门窗", "装饰", "装修"]),
    ("安装", ["给排水", "暖通", "电气", "消防", "弱电", "智能化"]),
    ("安装", ["给排水", "暖通", "电气", "弱电", "消防", "智能化", "强电", "照明", "动力", "防雷", "接地"]),
]
DEFAULT_TRADE = "土建"
SUMMARY_WORDS = ["小计", "合计", "总计", "合 计", "小 计"]

# Division of a bill item by code prefix
PREFIX2_DIVISION = [("00", "土建结构"), ("01", "土建结构"), ("02", "门窗工程"), ("03", "安装工程"),
                    ("04", "装饰装修"), ("05", "装饰装修"), ("07", "土建结构"), ("20", "其他")]
PREFIX2_DEFAULT = "未知"
PREFIX4_DIVISION = [
    ("0101", "基础工程"), ("0102", "基础工程"), ("0103", "基础工程"),
    ("0104", "主体结构"), ("0105", "主体结构"), ("0106", "主体结构"), ("0107", "主体结构"), ("0108", "主体结构"),
    ("0109", "屋面工程"), ("0110", "装饰工程"), ("0111", "装饰工程"), ("0112", "外墙工程"),
    ("0113", "装饰工程"), ("0114", "装饰工程"), ("0115", "装饰工程"),
    ("0201", "装饰工程"), ("0202", "外墙工程"), ("0203", "装饰工程"), ("0204", "主体结构"),
    ("0205", "装饰工程"), ("0206", "装饰工程"),
    ("0116", "主体结构"), ("0117", "主体结构"), ("0118", "屋面工程"),
]
MAIN_DIVISIONS = ["基础工程", "主体结构", "屋面工程", "外墙工程"]

# Material classes of the quantity sheet
BLOCK_EXCLUDED = ["地砖", "面砖", "瓷砖", "墙砖", "踢脚", "腰线"]
BLOCK_KINDS = ["实心", "空心", "多孔", "标砖", "配砖"]
MATERIAL_FIELDS = ["混凝土总用量", "钢筋总用量", "砌块总用量", "水泥总用量", "砂总用量", "碎石总用量",
                   "防水卷材总用量", "模板总用量"]

# Safety items of the measure-fee sheet
SAFETY_WORDS = ["环境保护", "文明施工", "安全施工", "临时设施", "夜间施工", "冬季施工", "雨季施工", "二次搬运"]
PENSION_RATE = 0.023415
SHEET_KINDS = ["表-02", "表-03", "表-04", "表-08", "表-11", "表-13", "表-21"]
SHEET_HISTOGRAM_KINDS = ["封-2", "扉-2", "表-01", "表-02", "表-03", "表-04", "表-08", "表-11",
                         "表-12-1", "表-12-3", "表-12-5", "表-12", "表-13", "表-21"]

# Conversion defaults
AREA_COST_DIVISOR = 1500
DEFAULT_FLOORS = 6
DEFAULT_YEAR = 2023
DEFAULT_DECORATION = "一般装修"
NON_LABOR_SHARES = [("材料费", 0.70), ("机械费", 0.08), ("企业管理费", 0.06), ("利润", 0.05)]

# Sub-region of an address, in order
ADDRESS_CITIES = ["成都", "绵阳", "德阳", "宜宾", "泸州", "南充", "广元", "遂宁", "乐山", "达州", "眉山",
                  "资阳", "雅安", "巴中", "自贡", "攀枝花", "内江", "广安", "凉山", "甘孜", "阿坝"]
DEFAULT_ADDRESS_REGION = "四川"

# Concrete and steel grade by price
CONCRETE_GRADE_BANDS = [(450, "C50"), (390, "C40"), (350, "C35"), (310, "C30")]
CONCRETE_GRADE_LOWEST = "C25"
STEEL_GRADE_BANDS = [(4500, "HRB500"), (3700, "HRB400")]
STEEL_GRADE_LOWEST = "HRB335"

# Info-sheet keys and the column they fill
INFO_FIELDS = [("基础类别", "foundation_type"), ("结构类别", "structure_type_detail"),
               ("桩基类别", "pile_foundation_type"), ("抗震等级", "seismic_grade"),
               ("土方处理难度", "earthwork_difficulty")]

# --------------------------------------------------------------------------
# Ordered text patterns (pattern, value)
# --------------------------------------------------------------------------
STRUCTURE_PATTERNS = [("框.*?剪.*?墙", "框剪结构"), ("剪力墙结构", "框剪结构"), ("框架结构", "框架结构"),
                      ("砖混结构", "砖混结构"), ("钢结构", "钢结构")]
SHEET_DECORATION_PATTERNS = [("精装修", "精装修"), ("精装", "精装修"), ("简装", "简装修"), ("毛坯", "毛坯")]
DOCUMENT_DECORATION_PATTERNS = [("精装修", "精装修"), ("精装", "精装修"), ("简装|简单装修", "简装修"),
                                ("毛坯", "毛坯"), ("公共区域精装", "公共区域精装")]
FOUNDATION_PATTERNS = [("筏板基础", "筏板基础"), ("筏.*?基础", "筏板基础"), ("桩.*?基础", "桩基础"),
                       ("独立基础", "独立基础"), ("条.*?基础", "条形基础")]
QUOTA_YEARS = [("09定额", 2012), ("15定额", 2017), ("20定额", 2021)]
NAME_STRUCTURE_WORDS = [("框架结构", ["框架"]), ("框剪结构", ["剪力墙", "框剪"]), ("砖混结构", ["砖混"]),
                        ("钢结构", ["钢结构"])]
NAME_DECORATION_WORDS = [("精装修", ["精装"]), ("简装修", ["简装"]), ("毛坯", ["毛坯"])]
UNIT_TYPE_WORDS = [("商业", ["商业", "商铺"]), ("办公", ["办公", "写字楼"]), ("车库", ["车库", "地下"]),
                   ("学校", ["学校", "教学"])]
AREA_UNIT = "(?:平方米|m[²2]|平米|㎡)"
AREA_PATTERNS = ["总.*?面积.*?(\\d+(?:\\.\\d+)?)\\s*" + AREA_UNIT,
                 "建筑.*?面积.*?(\\d+(?:\\.\\d+)?)\\s*" + AREA_UNIT,
                 "(\\d+(?:\\.\\d+)?)\\s*" + AREA_UNIT,
                 "占地面积.*?(\\d+(?:\\.\\d+)?)"]
LAND_AREA_PATTERNS = ["占地.*?面积.*?(\\d+(?:\\.\\d+)?)\\s*" + AREA_UNIT,
                      "用地.*?面积.*?(\\d+(?:\\.\\d+)?)\\s*" + AREA_UNIT]
DOCUMENT_CITIES = ["成都", "北京", "上海", "广州", "深圳", "杭州", "武汉", "重庆", "西安", "南京", "天津", "苏州",
                   "长沙", "郑州", "东莞", "青岛", "四川", "广元", "新都", "青羊", "锦江", "天府", "邛崃", "崇州",
                   "德阳", "宜宾", "绵阳", "南充", "达州", "乐山", "自贡", "泸州"]
TABLE_LABELS = [("建筑面积", "total_area"), ("总建筑面积", "total_area"), ("建筑总面积", "total_area"),
                ("占地面积", "land_area"), ("用地面积", "land_area"),
                ("楼层数", "floor_count"), ("总层数", "floor_count"),
                ("地上层数", "above_ground_floors"), ("地下层数", "under_ground_floors"),
                ("建造年份", "build_year"), ("建设年份", "build_year"), ("竣工年份", "build_year"),
                ("装修标准", "decoration_standard"), ("装修等级", "decoration_standard"),
                ("所在地区", "location"), ("建设地点", "location"), ("项目地点", "location"),
                ("结构类型", "structure_type"), ("建筑类型", "building_type"), ("工程类型", "building_type"),
                ("项目名称", "project_name"), ("工程名称", "project_name")]
OCR_PAIRS = [("0", "O"), ("1", "l"), ("1", "I"), ("2", "Z"), ("5", "S"), ("8", "B"), ("：", ":"), ("，", ",")]
LINE_END_MARKS = "。；：！？、）》」』,;:!?)>..．"
TOTAL_ROW_PATTERN = "合计|总计|总造价|招标控制价|合同价"
FATAL_WARNING_WORDS = ["无法打开", "Cannot open", "解析失败", "出错", "failed", "empty file"]
MAIN_WORKBOOK_SUFFIX, INFO_WORKBOOK_MARK = ".xlsx", "项目信息"
ALLOWED_EXTENSIONS = [".docx", ".doc", ".pdf", ".xlsx", ".xls"]
MAX_FILE_BYTES = 50 * 1024 * 1024
UPLOAD_TTL_HOURS = 24

# --------------------------------------------------------------------------
# Regions and seismic intensity
# --------------------------------------------------------------------------
REGIONS = ["华北", "华东", "华南", "华中", "西南", "西北", "东北"]
DEFAULT_REGION = "华东"
REGION_MEMBERS = [
    ("西南", ["四川", "成都", "重庆", "广元", "昆明", "贵阳", "贵州", "云南", "西藏"]),
    ("华北", ["北京", "天津", "河北", "山西", "内蒙古"]),
    ("华东", ["上海", "江苏", "浙江", "安徽", "福建", "江西", "山东"]),
    ("华南", ["广东", "广西", "海南", "深圳", "广州"]),
    ("华中", ["湖北", "湖南", "河南", "武汉", "长沙", "郑州"]),
    ("西北", ["陕西", "甘肃", "青海", "宁夏", "新疆", "西安"]),
    ("东北", ["辽宁", "吉林", "黑龙江", "沈阳", "大连", "哈尔滨"]),
]
SEISMIC_CITIES = [
    ("北京", 8.0), ("天津", 7.5), ("石家庄", 7.0), ("唐山", 8.0), ("邯郸", 7.5), ("保定", 7.0), ("太原", 8.0),
    ("大同", 7.5), ("呼和浩特", 8.0), ("包头", 8.0), ("沈阳", 7.0), ("大连", 7.0), ("鞍山", 7.0), ("长春", 7.0),
    ("哈尔滨", 6.0), ("上海", 7.0), ("南京", 7.0), ("苏州", 7.0), ("无锡", 6.0), ("常州", 7.0), ("杭州", 6.0),
    ("宁波", 6.0), ("温州", 6.0), ("合肥", 7.0), ("福州", 7.0), ("厦门", 7.5), ("泉州", 7.5), ("南昌", 6.0),
    ("济南", 7.0), ("青岛", 7.0), ("烟台", 7.0), ("郑州", 7.5), ("洛阳", 7.0), ("武汉", 6.0), ("长沙", 6.0),
    ("广州", 7.0), ("深圳", 7.0), ("珠海", 7.0), ("东莞", 7.0), ("汕头", 8.0), ("海口", 8.0), ("三亚", 6.0),
    ("南宁", 6.0), ("桂林", 6.0), ("成都", 7.0), ("绵阳", 7.0), ("广元", 7.0), ("宜宾", 7.0), ("德阳", 7.0),
    ("重庆", 6.0), ("贵阳", 6.0), ("昆明", 8.0), ("大理", 8.0), ("拉萨", 9.0), ("西安", 8.0), ("宝鸡", 7.5),
    ("兰州", 8.0), ("天水", 8.0), ("西宁", 7.0), ("银川", 8.0), ("乌鲁木齐", 8.0), ("喀什", 8.5), ("香港", 7.0),
    ("澳门", 7.0), ("台北", 8.0), ("高雄", 8.0), ("都江堰", 8.0), ("邛崃", 7.0), ("崇州", 7.0), ("新都", 7.0),
    ("青羊区", 7.0), ("锦江区", 7.0), ("温江区", 7.0), ("双流", 7.0), ("泸州", 6.0), ("南充", 6.0), ("达州", 6.0),
    ("乐山", 7.0), ("眉山", 7.0), ("遂宁", 6.0), ("自贡", 7.0), ("攀枝花", 7.5), ("西昌", 9.0), ("康定", 9.0),
    ("雅安", 7.0), ("阿坝", 8.0), ("甘孜", 8.0), ("凉山", 8.0), ("广安", 6.0), ("巴中", 6.0), ("内江", 6.0),
    ("资阳", 6.0), ("德阳绵竹", 7.0), ("彭州", 7.5), ("大邑", 7.0), ("蒲江", 7.0),
]
SEISMIC_REGIONS = [("西南", 7.0), ("华北", 7.5), ("华东", 7.0), ("华南", 7.0), ("华中", 6.0), ("西北", 8.0),
                   ("东北", 7.0)]
DEFAULT_SEISMIC = "7度"

# --------------------------------------------------------------------------
# Price index (2020 = 1)
# --------------------------------------------------------------------------
PRICE_INDEX = [(2010, 0.72), (2011, 0.76), (2012, 0.80), (2013, 0.84), (2014, 0.88), (2015, 0.91), (2016, 0.93),
               (2017, 0.95), (2018, 0.97), (2019, 0.99), (2020, 1.00), (2021, 1.04), (2022, 1.07), (2023, 1.10)]
PRICE_BASE_YEAR = 2020
SEEDED_PRICE_INDEX = [(2020, 100.0, 100.0, 1.0), (2021, 105.0, 103.0, 1.03), (2022, 108.0, 106.0, 1.06),
                      (2023, 112.0, 108.0, 1.09), (2024, 115.0, 110.0, 1.12), (2025, 118.0, 112.0, 1.14),
                      (2026, 120.0, 114.0, 1.16)]

# --------------------------------------------------------------------------
# Cost coefficients by building and structure type
# division (基础工程, 主体结构, 屋面工程, 外墙工程)
# material (混凝土, 钢筋, 砌块)
# composition (直接工程费, 间接费, 利润, 税金, 其他)
# --------------------------------------------------------------------------
COEFFICIENT_ITEMS = {
    "division": ["基础工程", "主体结构", "屋面工程", "外墙工程"],
    "material": ["混凝土", "钢筋", "砌块"],
    "composition": ["直接工程费", "间接费", "利润", "税金", "其他"],
}
COEFFICIENTS = [
    ("住宅", "框架结构", (0.15, 0.45, 0.08, 0.12), (0.40, 0.050, 0.20), (0.62, 0.14, 0.07, 0.04, 0.13)),
    ("住宅", "剪力墙结构", (0.18, 0.48, 0.06, 0.10), (0.50, 0.065, 0.15), (0.64, 0.13, 0.06, 0.04, 0.13)),
    ("住宅", "砖混结构", (0.12, 0.40, 0.10, 0.15), (0.30, 0.035, 0.30), (0.60, 0.15, 0.07, 0.04, 0.14)),
    ("商业综合体", "钢结构", (0.20, 0.40, 0.05, 0.15), (0.35, 0.080, 0.10), (0.58, 0.16, 0.08, 0.04, 0.14)),
    ("商业综合体", "框架结构", (0.18, 0.42, 0.06, 0.14), (0.38, 0.070, 0.12), (0.59, 0.15, 0.08, 0.04, 0.14)),
    ("办公楼", "框架结构", (0.16, 0.44, 0.07, 0.13), (0.38, 0.060, 0.18), (0.60, 0.15, 0.07, 0.04, 0.14)),
    ("办公楼", "钢结构", (0.19, 0.41, 0.06, 0.14), (0.33, 0.075, 0.12), (0.58, 0.16, 0.08, 0.04, 0.14)),
    ("学校", "框架结构", (0.14, 0.43, 0.09, 0.14), (0.42, 0.055, 0.22), (0.61, 0.14, 0.07, 0.04, 0.14)),
    ("医院", "框架结构", (0.17, 0.42, 0.07, 0.12), (0.42, 0.065, 0.15), (0.57, 0.16, 0.07, 0.04, 0.16)),
    ("工业厂房", "钢结构", (0.12, 0.38, 0.12, 0.10), (0.25, 0.045, 0.08), (0.65, 0.12, 0.06, 0.04, 0.13)),
    ("酒店", "框架结构", (0.16, 0.43, 0.07, 0.14), (0.40, 0.060, 0.16), (0.56, 0.16, 0.08, 0.04, 0.16)),
    ("酒店", "剪力墙结构", (0.18, 0.46, 0.06, 0.12), (0.48, 0.065, 0.14), (0.55, 0.17, 0.08, 0.04, 0.16)),
]
DEFAULT_COEFFICIENTS = ((0.16, 0.43, 0.07, 0.13), (0.40, 0.055, 0.18), (0.60, 0.15, 0.07, 0.04, 0.14))

# Base price, structure, region and decoration coefficients
BASE_UNIT_PRICE = [("学校", 3500.0), ("医院", 4500.0), ("办公楼", 4000.0), ("住宅", 3200.0), ("工业建筑", 2800.0),
                   ("商业建筑", 5000.0), ("基础设施", 2500.0), ("公共建筑", 3800.0)]
DEFAULT_UNIT_PRICE = 3500.0
STRUCTURE_FACTOR = [("框架结构", 1.00), ("框剪结构", 1.05), ("剪力墙结构", 1.08), ("砖混结构", 0.85),
                    ("钢结构", 1.25), ("木结构", 1.40), ("框架-核心筒", 1.15), ("筒中筒", 1.20)]
REGION_FACTOR = [("华北", 1.05), ("华东", 1.12), ("华南", 1.08), ("华中", 0.95), ("西南", 0.92), ("西北", 0.88),
                 ("东北", 0.85)]
DECORATION_FACTOR = [("简单装修", 0.85), ("普通装修", 1.00), ("精装修", 1.25), ("豪华装修", 1.60)]
DECORATION_LEVELS = [("毛坯", "简单装修"), ("一般装修", "普通装修"), ("精装修", "精装修"), ("豪华装修", "豪华装修"),
                     ("简单装修", "简单装修"), ("普通装修", "普通装修")]
DEFAULT_DECORATION_LEVEL = "普通装修"

# Default splits
FEE_COMPOSITION = [("直接工程费", 0.60), ("间接费", 0.15), ("利润", 0.07), ("税金", 0.04), ("其他", 0.14)]
UNIT_PROJECT_SPLIT = [("土建工程", 0.55), ("安装工程", 0.25), ("装饰工程", 0.20)]
SECTION_SPLIT = [("基础工程", 0.15), ("主体结构", 0.40), ("屋面工程", 0.05), ("外墙工程", 0.10), ("内墙及隔断", 0.08),
                 ("楼地面工程", 0.07), ("天棚工程", 0.03), ("其他", 0.12)]
SUBSECTION_SPLIT = [("基础工程", "土方工程", 0.30), ("基础工程", "基础混凝土", 0.40), ("基础工程", "基础钢筋", 0.25),
                    ("基础工程", "基础模板", 0.05), ("主体结构", "混凝土结构", 0.35), ("主体结构", "钢筋工程", 0.30),
                    ("主体结构", "砌体工程", 0.15), ("主体结构", "模板工程", 0.20)]
ITEM_QUANTITIES = [("现浇混凝土柱", "m³", 0.18, 1200.0), ("现浇混凝土梁", "m³", 0.12, 1100.0),
                   ("现浇混凝土板", "m³", 0.22, 1050.0), ("钢筋", "t", 0.055, 5500.0), ("砌块墙", "m³", 0.25, 450.0),
                   ("水泥砂浆找平", "m²", 2.8, 25.0), ("内外墙抹灰", "m²", 3.2, 32.0), ("防水卷材", "m²", 1.2, 65.0)]
INDICATOR_LIST = [("单方造价", 3500.0, "元/m²"), ("钢材单方耗量", 55.0, "kg/m²"), ("混凝土单方耗量", 0.45, "m³/m²"),
                  ("水泥单方耗量", 220.0, "kg/m²"), ("门窗单方含量", 0.25, "m²/m²"), ("模板单方耗量", 2.8, "m²/m²")]
CONCRETE_BY_FLOOR = [(1, 0.35), (2, 0.40), (3, 0.42), (4, 0.45), (5, 0.50)]
MATERIAL_DEFAULTS = [("混凝土", 0.45, "m³/m²"), ("钢筋", 55.0, "kg/m²"), ("砌块", 0.25, "m³/m²")]
MATERIAL_LIMITS = [("混凝土", 0.1, 1.5, 4), ("钢筋", 20.0, 200.0, 2), ("砌块", 0.02, 1.0, 4)]
DIVISION_DEFAULTS = [("基础工程", 0.15), ("主体结构", 0.40), ("屋面工程", 0.05), ("外墙工程", 0.10)]
INDICATOR_DEFAULTS = [("人工费占比", 0.20), ("基础占比", 0.15), ("主体占比", 0.40)]
TRADE_RATIO_DEFAULTS = (0.72, 0.14, 0.14)
TRADE_RATIO_BENCHMARK = (0.60, 0.20, 0.20)
TRADE_TARGETS = [("住宅", 0.65, 0.15, 0.20), ("学校", 0.58, 0.20, 0.22), ("医院", 0.50, 0.22, 0.28),
                 ("办公楼", 0.52, 0.23, 0.25), ("商业建筑", 0.50, 0.25, 0.25), ("工业建筑", 0.70, 0.10, 0.20),
                 ("公共建筑", 0.55, 0.22, 0.23), ("基础设施", 0.72, 0.08, 0.20)]
TRADE_TARGET_DEFAULT = (0.60, 0.18, 0.22)
FALLBACK_COST_SHARES = [("人工费", 0.20), ("措施费", 0.05), ("规费", 0.05), ("税金", 0.04), ("基础工程费", 0.15),
                        ("主体结构费", 0.40), ("屋面工程费", 0.05), ("外墙工程费", 0.10)]
FALLBACK_MATERIAL_PER_M2 = [("混凝土总用量", 0.45), ("钢筋总用量", 0.055), ("砌块总用量", 0.25)]
COST_LEVELS = [(1, "项目总造价", "total"), (2, "单项工程", "single_project"), (3, "单位工程", "unit_project"),
               (4, "分部工程", "section_project"), (5, "分项工程", "item_project"), (6, "明细级别", "detail_level")]
TYPICAL_PRICE_RANGES = [("医院", 3500.0, 8000.0), ("学校", 2500.0, 5000.0), ("办公楼", 3000.0, 7000.0),
                        ("商业", 3000.0, 8000.0), ("住宅", 2000.0, 5000.0), ("工业", 1500.0, 4000.0),
                        ("基础设施", 1000.0, 5000.0), ("公共", 2500.0, 6000.0)]
FLOOR_TIERS = [(6, "多层", 2000.0, 4000.0), (18, "小高层", 3000.0, 5000.0)]
FLOOR_TIER_TOP = ("高层", 4000.0, 7000.0)

# --------------------------------------------------------------------------
# Confidence bonus per filled parameter and its cap
# --------------------------------------------------------------------------
BONUS_RULES = {
    "subsection_xgb": (36.0, [("foundation_type", 15.0), ("seismic_grade", 5.0), ("soil_condition", 5.0),
                              ("basement_area", 3.0), ("building_height", 4.0), ("special_equipment", 2.0),
                              ("green_rating", 2.0)]),
    "section_xgb": (49.0, [("foundation_type", 8.0), ("seismic_grade", 5.0), ("soil_condition", 3.0), ("hvac", 5.0),
                           ("elevator", 4.0), ("fire_system", 4.0), ("smart_building", 3.0), ("exterior_wall", 4.0),
                           ("roof_type", 3.0), ("window_type", 3.0), ("green_rating", 2.0),
                           ("building_height", 3.0), ("special_equipment", 2.0)]),
    "item_xgb": (40.0, [("seismic_grade", 8.0), ("foundation_type", 5.0), ("soil_condition", 3.0), ("duration", 3.0),
                        ("special_equipment", 3.0), ("building_height", 4.0), ("green_rating", 2.0), ("hvac", 2.0),
                        ("exterior_wall", 2.0), ("roof_type", 2.0), ("concrete_grade", 3.0),
                        ("steel_grade", 3.0)]),
}
# Other names a parameter may come under
PARAM_ALIASES = {
    "foundation_type": ["基础形式", "基础类型", "基础类别"], "seismic_grade": ["抗震等级"],
    "soil_condition": ["地质条件", "土质条件"], "basement_area": ["地下室面积"], "building_height": ["建筑高度"],
    "duration": ["工期"], "special_equipment": ["特殊设备"], "hvac": ["暖通空调"], "elevator": ["电梯配置"],
    "fire_system": ["消防系统"], "smart_building": ["智能化"], "parking_ratio": ["车位配比"],
    "green_rating": ["绿色等级"], "exterior_wall": ["外墙装饰"], "roof_type": ["屋面做法"], "window_type": ["门窗类型"],
    "elevator_count": ["电梯数量"], "parking_count": ["车位数量"], "concrete_grade": ["混凝土等级"],
    "steel_grade": ["钢筋等级"],
}
# Empirical correction of shares, model -> parameter -> (known value, target, factor) in order
CORRECTIONS = {
    "subsection_xgb": [
        ("foundation_type", [("独立基础", "基础占比", 0.85), ("筏板基础", "基础占比", 1.10), ("桩基础", "基础占比", 1.35),
                             ("条形基础", "基础占比", 0.90), ("独立基础、筏板基础", "基础占比", 1.00),
                             ("桩基础、筏板基础", "基础占比", 1.25)]),
        ("soil_condition", [("良好", "基础占比", 0.92), ("一般", "基础占比", 1.00), ("较差", "基础占比", 1.15),
                            ("复杂", "基础占比", 1.30)]),
    ],
    "section_xgb": [
        ("foundation_type", [("桩基础", "建筑占比", 1.05), ("筏板基础", "建筑占比", 1.03), ("独立基础", "建筑占比", 0.98)]),
        ("hvac", [("中央空调", "安装占比", 1.25), ("多联机", "安装占比", 1.15), ("分体空调", "安装占比", 1.05),
                  ("无", "安装占比", 0.85)]),
        ("exterior_wall", [("幕墙", "装饰占比", 1.30), ("石材", "装饰占比", 1.15), ("面砖", "装饰占比", 1.00),
                           ("涂料", "装饰占比", 0.85)]),
    ],
    "item_xgb": [
        ("seismic_grade", [("特一级", "混凝土总用量", 1.18), ("特一级", "钢筋总用量", 1.25),
                           ("一级", "混凝土总用量", 1.12), ("一级", "钢筋总用量", 1.15),
                           ("二级", "混凝土总用量", 1.06), ("二级", "钢筋总用量", 1.08),
                           ("三级", "混凝土总用量", 1.00), ("三级", "钢筋总用量", 1.00),
                           ("四级", "混凝土总用量", 0.95), ("四级", "钢筋总用量", 0.93)]),
        ("exterior_wall", [("幕墙", "砌块总用量", 0.70), ("石材", "砌块总用量", 0.85), ("面砖", "砌块总用量", 0.95),
                           ("涂料", "砌块总用量", 1.00)]),
        ("roof_type", [("种植屋面", "混凝土总用量", 1.08), ("金属屋面", "混凝土总用量", 0.90),
                       ("金属屋面", "钢筋总用量", 0.90), ("坡屋面", "混凝土总用量", 0.95),
                       ("平屋面", "混凝土总用量", 1.00)]),
    ],
}
# Share name of a correction -> division it scales
SHARE_DIVISION = [("基础占比", "基础工程"), ("主体占比", "主体结构"), ("屋面占比", "屋面工程"), ("外墙占比", "外墙工程")]

# Model registry (id, layer, target, published accuracy)
MODEL_REGISTRY = [
    ("total_pso_svr", "总造价预测模型", "单方造价", 86.9),
    ("unit_gbt", "总造价预测模型", "单方造价", 74.6),
    ("section_xgb", "分部/分项工程模型", "专业造价占比", 51.6),
    ("subsection_xgb", "分部/分项工程模型", "分部造价占比", 36.7),
    ("item_xgb", "分部/分项工程模型", "材料单方耗量", 39.4),
    ("indicator_rf", "清单项目模型", "经济技术指标", 60.3),
    ("boq_xgb", "清单项目模型", "综合单价", 73.7),
    ("boq_lr_v2", "清单项目模型", "综合单价", 68.3),
]
STAGE_MODELS = [
    ("estimation", ["total_pso_svr", "section_xgb", "indicator_rf"]),
    ("preliminary", ["total_pso_svr", "unit_gbt", "section_xgb", "item_xgb", "indicator_rf"]),
    ("budget", ["total_pso_svr", "unit_gbt", "section_xgb", "subsection_xgb", "item_xgb", "indicator_rf", "boq_xgb",
                "boq_lr_v2"]),
]
SMALL_TABLE_ROWS, SMALL_TABLE_REPEATS = 100, 10
MIN_ACCURACY = 30.0
INTERVAL_ACCURACY = 50.0

# Stage parameter catalogue (stage, category, parameter keys)
DETAIL_PARAMS = [
    ("基础参数", ["total_area", "floors", "basement_area", "building_height", "build_year", "duration"]),
    ("结构参数", ["foundation_type", "seismic_grade", "concrete_grade", "steel_grade", "soil_condition",
              "special_equipment"]),
    ("系统参数", ["hvac", "elevator", "fire_system", "smart_building", "parking_ratio", "green_rating"]),
    ("装修参数", ["decoration_level", "exterior_wall", "roof_type", "window_type", "elevator_count", "parking_count"]),
]
STAGE_PARAMS = {
    "estimation": [("基础参数", ["project_type", "structure_type", "total_area", "floors", "location", "build_year",
                             "decoration_level"])],
    "preliminary": DETAIL_PARAMS,
    "budget": DETAIL_PARAMS,
}

# Request ranges (column, lower, lower inclusive, upper)
REQUEST_RANGES = [("total_area", 0, False, 10_000_000), ("floors", 1, True, 500), ("build_year", 1900, True, 2100),
                  ("basement_area", 0, True, 10_000_000), ("building_height", 0, True, 2000),
                  ("duration", 0, True, 3600), ("parking_ratio", 0, True, 100), ("elevator_count", 0, True, 200),
                  ("parking_count", 0, True, 1_000_000)]
DEFAULT_AREA = 10000.0
REQUEST_LENGTHS = [("project_name", 200), ("project_type", 50), ("structure_type", 50), ("location", 50),
                   ("decoration_level", 50), ("stage", 20), ("foundation_type", 100), ("seismic_grade", 100),
                   ("concrete_grade", 100), ("steel_grade", 100), ("soil_condition", 100), ("special_equipment", 100),
                   ("hvac", 100), ("elevator", 100), ("fire_system", 100), ("smart_building", 100), ("exterior_wall", 100),
                   ("roof_type", 100), ("window_type", 100), ("green_rating", 100)]
# of lists, and of the text of each building
REQUEST_LIST_LENGTHS = [("selected_models", 20), ("buildings", 50)]
BUILDING_LENGTHS = [("type", 50)]
BUILDING_RANGES = [("floors", 1, True, 500), ("area", 0, False, 1_000_000), ("basement", 0, True, 20)]

# Sufficiency report
SUFFICIENCY_MIN = 30
SUFFICIENCY_RECOMMENDED = 100
SUFFICIENCY_PER_CATEGORY = 5
SUFFICIENCY_PER_REGION = 3
SUFFICIENCY_CATEGORIES = ["住宅", "学校", "医院", "办公楼", "工业建筑", "商业建筑", "基础设施", "公共建筑"]

# Synthetic sample attributes
# (type, base price, structures, area range, floor range, decorations)
SAMPLE_TYPES = [
    ("学校", 3500, ["框架结构", "框剪结构"], (5000, 50000), (3, 8), ["普通装修", "简单装修", "精装修"]),
    ("医院", 4500, ["框架结构", "框剪结构"], (8000, 80000), (5, 20), ["普通装修", "精装修"]),
    ("办公楼", 4000, ["框架结构", "框剪结构", "钢结构"], (10000, 100000), (8, 40), ["普通装修", "精装修", "豪华装修"]),
    ("住宅", 3200, ["剪力墙结构", "框剪结构", "砖混结构"], (3000, 60000), (6, 33),
     ["简单装修", "普通装修", "精装修", "豪华装修"]),
    ("工业建筑", 2800, ["钢结构", "框架结构"], (2000, 30000), (1, 5), ["简单装修", "普通装修"]),
    ("商业建筑", 5000, ["框架结构", "钢结构", "框剪结构"], (5000, 80000), (3, 12), ["普通装修", "精装修", "豪华装修"]),
    ("基础设施", 2500, ["框架结构", "钢结构"], (1000, 20000), (1, 4), ["简单装修"]),
    ("公共建筑", 3800, ["框架结构", "框剪结构", "钢结构"], (3000, 40000), (3, 15), ["普通装修", "精装修"]),
]
SAMPLE_YEARS = (2020, 2025)
SAMPLE_NOISE = (0.92, 1.08)
SAMPLE_SHARES = [("人工费", 0.20, 0.02), ("材料费", 0.30, 0.02), ("机械费", 0.10, 0.01), ("措施费", 0.05, 0.0),
                 ("企业管理费", 0.08, 0.0), ("规费", 0.05, 0.0), ("利润", 0.07, 0.0), ("税金", 0.04, 0.0),
                 ("基础工程费", 0.15, 0.02), ("主体结构费", 0.40, 0.03), ("屋面工程费", 0.05, 0.0),
                 ("外墙工程费", 0.10, 0.01)]
SAMPLE_CONCRETE = [("工业建筑", 0.30, 0.45), ("住宅", 0.42, 0.55), ("医院", 0.48, 0.62)]
SAMPLE_CONCRETE_OTHER = (0.40, 0.55)
SAMPLE_STEEL = [("工业建筑", 0.06, 0.09), ("住宅", 0.045, 0.065), ("医院", 0.05, 0.07)]
SAMPLE_STEEL_OTHER = (0.04, 0.07)
SAMPLE_BLOCK = (0.2, 0.3)

# --------------------------------------------------------------------------
# Conversation labelling
# --------------------------------------------------------------------------
ZONE_WORDS = ["高新区", "新区", "开发区", "科技园", "工业园", "经开区", "自贸区", "CBD", "中心区"]
TALK_CITIES = ["成都", "北京", "上海", "广州", "深圳", "杭州", "武汉", "重庆", "西安", "南京", "天津", "苏州", "长沙"]
NEAR_CITIES = ["成都", "北京", "上海", "广州", "深圳", "杭州", "武汉", "重庆", "天府", "锦江", "青羊", "武侯", "新都"]
INTENT_WORDS = {
    "check_data": ["数据够", "数据不足", "样本量", "数据充分", "数据质量", "够不够", "数据检查"],
    "search_data": ["搜索数据", "找数据", "补充数据", "数据源"],
    "knowledge_query": ["造价一般", "通常多少", "行业", "经验", "参考", "一般是多少", "造价范围", "造价水平"],
    "predict": ["预测", "估算", "多少钱", "造价多少", "总造价", "单方造价", "算一下", "帮我算", "造价预测", "预测造价"],
    "train": ["训练", "train", "重新训练", "fit"],
    "explain_term": ["解释", "什么是", "含义", "定义", "什么叫", "是什么意思", "介绍"],
    "list_models": ["推荐模型", "用什么模型", "模型列表", "列出模型", "有哪些模型"],
    "find_similar": ["相似", "类似", "历史项目", "以往项目"],
    "cost_breakdown": ["拆分", "分解", "成本构成", "费用构成", "费用组成"],
    "greeting": ["你好", "您好", "hi", "hello", "Hi", "Hello", "在吗", "嗨"],
    "thanks": ["谢谢", "感谢", "thanks", "thank", "辛苦了", "好的", "明白了", "了解"],
    "help": ["能做什么", "功能", "帮助", "怎么用", "你会什么", "你的功能"],
    "building_action": ["修一", "建一", "盖一", "修建", "建造", "建设", "拟建", "计划建"],
    "region_question": ["呢", "的话", "怎么样", "如何"],
    "feedback": ["太便宜", "太贵", "偏高", "偏低", "不合理", "准确吗", "对吗", "是不是", "会不会", "考虑", "地区", "差异",
                 "影响", "为什么", "怎么", "如何"],
    "supplement": ["补充", "另外", "还有", "修改", "改为", "改成", "不对", "错了", "应该是"],
    "repredict": ["重新预测", "重新算", "再算", "换成", "改为", "改成", "调整"],
    "compare": ["对比", "比较", "差别", "区别"],
    "change": ["如果是", "改为", "变成", "换成", "改成"],
    "data_query": ["有没有", "数据够", "样本", "训练数据", "涵盖", "包含"],
    "data_word": ["数据", "样本", "训练"],
    "question_word": ["吗", "呢", "有没有", "是否"],
    "short_question": ["呢", "怎么样"],
}
AREA_MENTION = "\\d+(?:\\.\\d+)?\\s*(?:平米|平方米|㎡|m[²32]|万平)"
COMPARE_PATTERN = "vs|和.{1,6}比"
CHANGE_PATTERN = "\\d+\\s*(层|楼|平米|m[²2]|平方米)"
REQUEST_AREA_PATTERN = "(\\d+(?:\\.\\d+)?)\\s*(?:万\\s*)?(?:平方米|平米|㎡|m[²32]|平)"
REQUEST_LOCATIONS = ["华北", "华东", "华南", "华中", "西南", "西北", "东北", "北京", "上海", "广州", "深圳", "成都",
                     "杭州", "南京", "武汉"]
REQUEST_STRUCTURES = [("框架结构", "框架"), ("框剪结构", "框剪"), ("剪力墙结构", "剪力墙"), ("钢结构", "钢结构"),
                      ("砖混结构", "砖混")]
REQUEST_DECORATIONS = [("简单装修", "简单装修"), ("普通装修", "普通装修"), ("精装修", "精装修"), ("豪华装修", "豪华装修"),
                       ("简单装修", "毛坯")]
TERMS = ["估算", "概算", "预算", "结算", "决算", "工程量清单", "计价", "定额", "直接费", "间接费", "单方造价",
         "框架结构", "剪力墙结构"]
MAX_SESSIONS = 200
MAX_MESSAGES = 200
MAX_PROJECTS = 500
