"""SQL oracles of the registered queries, written against the driver tables."""

from oracles.views import NEEDS, VIEWS, case, dec, first, has, lit, patterns, pick, rnd, total, total0, with_views, words
from takeoff import constants as C
from takeoff.plans import standins as S

ORACLES: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    ORACLES[name] = with_views(views, body)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) if not isinstance(v, float) else f"CAST({v!r} AS DOUBLE)" for v in r) + ")"
                                  for r in rows) + ")"


# -- helper views ------------------------------------------------------------

REGION = ("CASE WHEN trim({c}) IN (" + ", ".join(lit(r) for r in C.REGIONS) + ") THEN trim({c}) " + " ".join(
    "WHEN trim({c}) IN (" + ", ".join(lit(m) for m in ms) + f") THEN {lit(r)}" for r, ms in C.REGION_MEMBERS) + " ELSE '华东' END")


def region(c: str) -> str:
    return REGION.replace("{c}", c)


SEISMIC = (f"coalesce((SELECT v FROM {values([(i, c, f'{v:g}度') for i, (c, v) in enumerate(C.SEISMIC_CITIES)])} s(i, city, v) "
           "WHERE contains(trim({c}), city) ORDER BY (trim({c}) = city) DESC, length(city) DESC, i LIMIT 1), "
           f"(SELECT v FROM {values([(i, c, f'{v:g}度') for i, (c, v) in enumerate(C.SEISMIC_REGIONS)])} s(i, reg, v) "
           "WHERE contains(trim({c}), reg) ORDER BY i LIMIT 1), '7度')")


def seismic_of_places() -> str:
    return f"(SELECT location AS place, {SEISMIC.replace('{c}', 'location')} AS seismic FROM (SELECT DISTINCT location FROM project_meta))"


VIEWS["rollup"] = f"""
SELECT project_id, {total0('a', "contains(trade,'建筑') OR contains(trade,'土建')")} AS arch_cost,
  {total0('a', "contains(trade,'装饰')")} AS deco_cost, {total0('a', "trade = '装修' OR contains(trade,'安装')")} AS inst_cost,
  {total0('a', "contains(division,'基础')")} AS foundation_cost,
  {total0('a', "contains(division,'主体') OR contains(division,'结构')")} AS structure_cost,
  {total0('a', "contains(division,'屋面') OR contains(division,'楼地面')")} AS roof_cost,
  {total0('a', "contains(division,'外墙')")} AS wall_cost,
  {total0('quantity', "contains(item_name,'混凝土') OR contains(item_name,'砼')")} AS concrete_total,
  {total0('quantity', "contains(item_name,'钢筋') OR contains(item_name,'螺纹钢')")} AS rebar_total,
  {total0('quantity', "contains(item_name,'砌块') OR contains(item_name,'砖')")} AS block_total,
  count(*) AS item_count, count(DISTINCT division) AS division_count, {total('a')} AS total_boq_cost
FROM (SELECT *, comp_unit_price * quantity AS a FROM boq_items WHERE is_active = 1 AND comp_unit_price > 0) GROUP BY 1"""
NEEDS["rollup"] = ["boq_items"]

VIEWS["ratios"] = """
SELECT arch / t AS arch_ratio, deco / t AS deco_ratio, inst / t AS inst_ratio FROM (
  SELECT CAST(sum(CAST(arch_cost AS DECIMAL(28,4))) AS DOUBLE) AS arch, CAST(sum(CAST(deco_cost AS DECIMAL(28,4))) AS DOUBLE) AS deco,
    CAST(sum(CAST(inst_cost AS DECIMAL(28,4))) AS DOUBLE) AS inst, arch + deco + inst AS t FROM rollup)"""
NEEDS["ratios"] = ["boq_items", "rollup"]

VIEWS["price_index"] = f"SELECT * FROM {values(C.PRICE_INDEX)} t(year, idx)"
VIEWS["factors"] = f"""
SELECT project_id, build_year, coalesce({rnd('1.0::DOUBLE / idx', 6)}, 1.0::DOUBLE) AS factor, idx IS NOT NULL AS known
FROM project_meta LEFT JOIN price_index ON year = build_year"""
NEEDS["factors"] = ["project_meta", "price_index"]
VIEWS["priced"] = f"""
SELECT b.*, f.factor AS price_adjust_factor,
  CASE WHEN known THEN {rnd('total_price * factor', 4)} ELSE total_price END AS total_price_adj,
  CASE WHEN known THEN {rnd('comp_unit_price * factor', 4)} ELSE comp_unit_price END AS comp_unit_price_adj
FROM boq_items b JOIN factors f USING (project_id)"""
NEEDS["priced"] = ["project_meta", "price_index", "factors", "boq_items"]

_part = "contains(c1,'分部分项工程') AND NOT contains(c1,'清单')"
_measure = "contains(c1,'措施项目') AND NOT contains(c1,'其中') AND NOT contains(c1,'安全')"
_regul = "c1 = '规费' OR (starts_with(c1,'4') AND contains(c1,'规费'))"
VIEWS["fees"] = f"""
SELECT project_id, {total0('n2', "k = 'part'")} AS part_fee, {total0('n2', "k = 'measure'")} AS measure_fee,
  {total0('n2', "k = 'regulation'")} AS regulation_fee, {total0('n2', "k = 'tax'")} AS tax_fee
FROM (SELECT *, CASE WHEN {_part} THEN CASE WHEN NOT starts_with(c1,'1.') THEN 'part' END WHEN {_measure} THEN 'measure'
      WHEN {_regul} THEN 'regulation' WHEN contains(c1,'税金') THEN 'tax' END AS k FROM sheet_rows WHERE contains(sheet_name,'表-04'))
GROUP BY 1"""
NEEDS["fees"] = ["sheet_rows"]

_header = "(regexp_matches(c2, '^[A-Z]\\s*[\\x{4e00}-\\x{9fff}]') OR (regexp_matches(c2, '^[\\x{4e00}-\\x{9fff}]') AND contains(c2,'工程')))"
_norm_code = "CASE WHEN regexp_matches(c1,'^[0-9]+$') AND length(c1) < 12 THEN lpad(c1, 12, '0') ELSE c1 END"
VIEWS["bill"] = f"""
SELECT project_id, trim(replace(sheet_name,'表-08','')) AS unit_project,
  CASE WHEN valid THEN code ELSE printf('SUB_%05d', row_num) END AS boq_code, c2 AS item_name, c3 AS spec_text, section,
  {words('section', C.DIVISION_WORDS)} AS division, {words("c2 || ' ' || c3", C.TRADE_WORDS, "'土建'")} AS trade, c4 AS unit,
  n5 AS quantity, n6 AS comp_unit_price, n7 AS total_price, n8 AS labor_fee,
  CASE WHEN n5 * n6 > 0 AND n7 > 0 AND abs(n7 - n6 * n5) / n7 > 0.01 THEN 1 ELSE 0 END AS flag_outlier,
  CASE WHEN valid THEN 0 ELSE 1 END AS flag_code_error
FROM (SELECT *, {_norm_code} AS code, regexp_matches({_norm_code}, '^[0-9]{{9,}}$') AS valid,
        {_header} AND NOT n7 > 0 AND NOT n8 > 0 AS header,
        last_value(CASE WHEN {_header} AND NOT n7 > 0 AND NOT n8 > 0 THEN c2 END IGNORE NULLS) OVER (
          PARTITION BY project_id, sheet_name, sheet_order ORDER BY row_num, c2, c1, n7
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
      FROM sheet_rows WHERE contains(sheet_name,'表-08') AND width >= 8 AND c2 <> '' AND NOT contains(c2,'小计'))
WHERE NOT header AND (valid OR n7 > 0)"""
NEEDS["bill"] = ["sheet_rows"]

_code4 = case("substr(c1,1,4)", C.PREFIX4_DIVISION, "'其他'")
_e3 = ("CASE WHEN contains(c1,'分部分项工程费') OR starts_with(c1,'分部分项') THEN 'part' WHEN contains(c1,'措施项目') OR starts_with(c1,'措施') THEN 'measure' "
       "WHEN contains(c1,'规费') AND NOT contains(c1,'税金') THEN 'regulation' WHEN contains(c1,'税金') THEN 'tax' END")


def _last_fee(k: str) -> str:
    return f"coalesce((max({{'r': row_num, 'v': n2}}) FILTER (WHERE kind = 'e3' AND c1 <> '' AND fee = '{k}')).v, 0.0::DOUBLE) AS {k}_fee"


_e2_building = "((contains(c1,'建筑') AND NOT contains(c1,'装饰') AND NOT contains(c1,'安装')) OR contains(c1,'建筑与装饰') OR contains(c1,'建筑及装饰'))"
VIEWS["breakdown"] = f"""
SELECT *, CASE WHEN l > 0 THEN l ELSE {rnd('pen / 0.023415', 2)} END AS labor_cost,
  CASE WHEN l > 0 THEN 'f11_c9_sum' WHEN {rnd('pen / 0.023415', 2)} > 0 THEN 'h13_pension_reverse' END AS labor_source
FROM (
SELECT project_id, {rnd(total0('building', 'used'), 2)} AS building_trade_cost, {rnd(total0('deco', 'used'), 2)} AS decoration_trade_cost,
  {rnd(total0('inst', 'used'), 2)} AS installation_trade_cost, {rnd(total0('d0', 'used'), 2)} AS foundation_division_cost,
  {rnd(total0('d1', 'used'), 2)} AS main_structure_cost, {rnd(total0('d2', 'used'), 2)} AS roofing_cost,
  {rnd(total0('d3', 'used'), 2)} AS exterior_wall_cost, {rnd(total0('part_fee', 'used'), 2)} AS part_item_cost,
  {rnd(total0('measure_fee', 'used'), 2)} AS measure_cost, {rnd(total0('regulation_fee', 'used'), 2)} AS regulation_cost,
  {rnd(total0('tax_fee', 'used'), 2)} AS tax_cost, {rnd(total0('labor', 'used'), 2)} AS l,
  (min({{'o': sheet_order, 'v': pension}}) FILTER (WHERE pension IS NOT NULL)).v AS pen,
  CAST(count(*) FILTER (WHERE kind = 'e2') AS INTEGER) AS e2_count, CAST(count(*) FILTER (WHERE kind = 'f11' AND arch) AS INTEGER) AS f11_count,
  CAST(count(*) FILTER (WHERE kind = 'e3') AS INTEGER) AS e3_count, CAST(count(*) FILTER (WHERE kind = 'h13') AS INTEGER) AS h13_count
FROM (
  SELECT *, (kind <> 'f11' OR wanted) AS used FROM (
  SELECT project_id, sheet_name, sheet_order, kind,
    {total0('n2', f"kind = 'e2' AND {_e2_building} AND n2 <> 0")} AS building,
    {total0('n2', f"kind = 'e2' AND NOT {_e2_building} AND contains(c1,'装饰')")} AS deco,
    {total0('n2', f"kind = 'e2' AND NOT {_e2_building} AND NOT contains(c1,'装饰')")} AS inst,
    {', '.join(rnd(total0('n7', f"kind = 'f11' AND data AND div = '{d}'"), 2) + f' AS d{i}' for i, d in enumerate(C.MAIN_DIVISIONS))},
    {rnd(total0('n8', "kind = 'f11' AND data"), 2)} AS labor,
    {', '.join(_last_fee(k) for k in ('part', 'measure', 'regulation', 'tax'))},
    (min({{'r': row_num, 'v': n5}}) FILTER (WHERE kind = 'h13' AND contains(c1,'养老保险') AND n5 > 0)).v AS pension,
    coalesce(bool_or(row_num = 2 AND (contains(c0,'建筑工程') OR contains(c0,'建筑与装饰'))), false) AS arch,
    coalesce(bool_or(row_num = 2 AND (contains(c0,'建筑工程') OR contains(c0,'建筑与装饰') OR contains(c0,'装饰工程'))), false) AS wanted
  FROM (SELECT *, {_code4} AS div, {_e3} AS fee, row_num >= 8 AND regexp_matches(c0,'^[0-9]+$') AND c1 <> '' AS data,
          CASE WHEN contains(sheet_name,'表-03') THEN 'e2' WHEN contains(sheet_name,'表-08') THEN 'f11'
               WHEN contains(sheet_name,'表-04') THEN 'e3' WHEN contains(sheet_name,'表-13') THEN 'h13' END AS kind FROM sheet_rows)
  WHERE kind IS NOT NULL GROUP BY ALL))
GROUP BY 1)"""
NEEDS["breakdown"] = ["sheet_rows"]

_steel = "(" + has("{c}", ["钢筋", "螺纹钢", "圆钢", "钢材"]) + " OR contains(upper({c}),'HRB') OR contains(upper({c}),'HPB'))"
_block = ("(" + has("{c}", ["砌块", "加气"]) + " OR (contains({c},'砖') AND NOT " + has("{c}", C.BLOCK_EXCLUDED) + ") OR (contains({c},'页岩') AND "
          + has("{c}", C.BLOCK_KINDS) + "))")
MATERIAL = ("CASE WHEN " + has("{c}", ["混凝土", "砼"]) + " THEN '混凝土总用量' WHEN " + _steel + " THEN '钢筋总用量' WHEN " + _block + " THEN '砌块总用量' "
            "WHEN contains({c},'水泥') THEN '水泥总用量' WHEN contains({c},'砂') THEN CASE WHEN NOT " + has("{c}", ["防水", "模板"]) + " THEN '砂总用量' END "
            "WHEN " + has("{c}", ["碎石", "卵石", "砾石"]) + " THEN '碎石总用量' WHEN contains({c},'防水') AND (" + has("{c}", ["卷材", "薄膜"])
            + " OR contains(upper({c}),'SBS')) THEN '防水卷材总用量' WHEN contains({c},'模板') THEN '模板总用量' END")


def material(c: str) -> str:
    return MATERIAL.replace("{c}", c)


VIEWS["sections"] = f"""
SELECT project_id, {total0('n8', "NOT contains(c2,'小计') AND (n7 <> 0 OR n8 <> 0) AND n8 > 0")} AS labor,
  {', '.join(total0('n7', f"contains(c2,'小计') AND f = '{f}'") + f' AS {n}' for (f, _), n in zip(C.SECTION_COST_WORDS, ('foundation', 'structure', 'roof', 'wall')))}
FROM (SELECT *, {words('s', C.SECTION_COST_WORDS)} AS f FROM (
  SELECT *, last_value(CASE WHEN NOT contains(c2,'小计') AND n7 = 0 AND n8 = 0 AND {_header} THEN c2 END IGNORE NULLS) OVER (
    PARTITION BY project_id, sheet_name, sheet_order ORDER BY row_num, c2, n7 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM sheet_rows WHERE contains(sheet_name,'表-08') AND width >= 3 AND c2 <> ''))
GROUP BY 1"""
NEEDS["sections"] = ["sheet_rows"]

_t03 = "CASE WHEN contains(c1,'建筑') AND (contains(c1,'工程') OR contains(c1,'土建')) THEN 'arch' WHEN contains(c1,'装饰') THEN 'deco' WHEN contains(c1,'安装') THEN 'inst' END"
_split03 = "c1 <> '' AND n2 > 0 AND NOT (contains(c1,'合') AND contains(c1,'计'))"
_first03 = "sheet_order = f03 AND contains(sheet_name,'表-03')"
VIEWS["workbook"] = f"""
SELECT a.project_id, coalesce(t02.c, 0.0::DOUBLE) AS total_cost,
  CASE WHEN m11 > 0 THEN m11 WHEN measure_fee > 0 THEN measure_fee ELSE 0.0 END AS measure,
  CASE WHEN s11 > 0 THEN s11 WHEN t02.s > 0 THEN t02.s ELSE 0.0 END AS safety,
  CASE WHEN r13 > 0 THEN r13 WHEN regulation_fee > 0 THEN regulation_fee WHEN t02.g > 0 THEN t02.g ELSE 0.0 END AS regulation,
  CASE WHEN x13 > 0 THEN x13 WHEN tax_fee > 0 THEN tax_fee ELSE 0.0 END AS tax,
  arch, deco, inst, items, amount, provisional, concrete, coalesce(labor, 0.0::DOUBLE) AS labor, has21, has_all
FROM (
  SELECT project_id,
    min({{'r': row_num, 'c': CASE WHEN n2 > 0 THEN n2 ELSE n4 END, 's': CASE WHEN n4 > 0 THEN n4 ELSE 0.0::DOUBLE END,
          'g': CASE WHEN n5 > 0 THEN n5 ELSE 0.0::DOUBLE END}}) FILTER (WHERE contains(sheet_name,'表-02') AND contains(c0,'合') AND contains(c0,'计')) AS t02,
    {', '.join(total0('n2', f"{_first03} AND {_split03} AND {_t03} = '{t}'") + f' AS {t}' for t in ('arch', 'deco', 'inst'))},
    (max({{'o': sheet_order, 'r': row_num, 'v': n5}}) FILTER (WHERE contains(sheet_name,'表-11') AND contains(c0,'合计') AND n5 > 0)).v AS m11,
    {total0('n5', "contains(sheet_name,'表-11') AND NOT contains(c0,'合计') AND n5 > 0 AND " + has('c1', C.SAFETY_WORDS))} AS s11,
    {total0('n5', "contains(sheet_name,'表-13') AND n5 > 0 AND c1 = '规费'")} AS r13,
    {total0('n5', "contains(sheet_name,'表-13') AND n5 > 0 AND (contains(c1,'税金') OR contains(c1,'增值税'))")} AS x13,
    count(*) FILTER (WHERE contains(sheet_name,'表-08') AND width >= 8 AND n7 > 0 AND c2 <> '' AND NOT contains(c2,'小计')) AS items,
    {total0('n7', "contains(sheet_name,'表-08') AND width >= 8 AND n7 > 0 AND c2 <> '' AND NOT contains(c2,'小计')")} AS amount,
    {total0('n2', "contains(sheet_name,'表-12') AND NOT contains(sheet_name,'表-12-') AND n2 > 0 AND (contains(c1,'暂列') OR contains(c1,'暂估'))")} AS provisional,
    {total0('n3', "contains(sheet_name,'表-21') AND n3 > 0 AND contains(c1,'混凝土')")} AS concrete,
    bool_or(contains(sheet_name,'表-21')) AS has21,
    {' AND '.join(f"bool_or(contains(sheet_name,'{k}'))" for k in C.SHEET_KINDS)} AS has_all
  FROM (SELECT *, min(sheet_order) FILTER (WHERE contains(sheet_name,'表-03')) OVER (PARTITION BY project_id) AS f03 FROM sheet_rows) GROUP BY 1) a
LEFT JOIN fees f ON f.project_id = a.project_id LEFT JOIN sections s ON s.project_id = a.project_id"""
NEEDS["workbook"] = ["sheet_rows", "fees", "sections"]

_coef_rows = [(t, s, *d, *m, *c) for t, s, d, m, c in C.COEFFICIENTS]
_coef_cols = [f"division_{i}" for i in range(4)] + [f"material_{i}" for i in range(3)] + [f"composition_{i}" for i in range(5)]
VIEWS["coef"] = f"SELECT * FROM {values(_coef_rows)} t(ct, cs, {', '.join(_coef_cols)})"
VIEWS["coef_type"] = f"SELECT ct, {', '.join(f'avg({c}) AS {c}' for c in _coef_cols)} FROM coef GROUP BY 1"
NEEDS["coef_type"] = ["coef"]
_defaults = [x for g in C.DEFAULT_COEFFICIENTS for x in g]


def coefficients(source: str, key: str, kind: str, structure: str, floors: str) -> str:
    """Key with all twelve coefficients, divisions adjusted for height and brought to a sum of 1."""
    raw = ", ".join(f"coalesce(e.{c}, y.{c}, CAST({d} AS DOUBLE)) AS {c}" for c, d in zip(_coef_cols, _defaults))
    adj = (f"SELECT *, division_0 * CASE WHEN fl > 50 THEN 1.3 ELSE 1.0 END AS d0, division_1 * CASE WHEN fl > 50 THEN 1.1 ELSE 1.0 END AS d1, "
           f"division_2 * CASE WHEN fl < 6 THEN 1.2 ELSE 1.0 END AS d2, division_3 AS d3 FROM ("
           f"SELECT p.{key}, {floors} AS fl, {raw} FROM {source} p LEFT JOIN coef e ON e.ct = p.{kind} AND e.cs = p.{structure} "
           f"LEFT JOIN coef_type y ON y.ct = p.{kind})")
    div = ", ".join(rnd(f"d{i} / (d0 + d1 + d2 + d3)", 4) + f" AS division_{i}" for i in range(4))
    return f"SELECT {key}, {div}, {', '.join(_coef_cols[4:])} FROM ({adj})"


VIEWS["building_features"] = f"""
SELECT r.request_id, coalesce(n, 1) AS building_count, CAST(coalesce(hi, r.floors) AS INTEGER) AS max_floor, CAST(coalesce(lo, r.floors) AS INTEGER) AS min_floor,
  CASE WHEN n IS NULL THEN CAST(r.floors AS DOUBLE) ELSE {rnd('mean', 1)} END AS avg_floor,
  CASE WHEN n IS NULL THEN 0.0 ELSE {rnd('sd', 2)} END AS floor_std,
  CASE WHEN n IS NULL THEN CASE WHEN contains(coalesce(project_type,''),'住宅') THEN 1.0 ELSE 0.0 END ELSE {rnd('home / CASE WHEN whole > 0 THEN whole ELSE 1 END', 3)} END AS residential_ratio,
  CASE WHEN n IS NULL THEN CASE WHEN contains(coalesce(project_type,''),'商业') THEN 1.0 ELSE 0.0 END ELSE {rnd('shop / CASE WHEN whole > 0 THEN whole ELSE 1 END', 3)} END AS commercial_ratio,
  CASE WHEN kinds > 1 THEN 1 ELSE 0 END AS mixed_types
FROM requests r LEFT JOIN (
  SELECT request_id, count(*) AS n, max(floors) AS hi, min(floors) AS lo, CAST(sum(floors) AS DOUBLE) / count(*) AS mean, stddev_pop(CAST(floors AS DOUBLE)) AS sd,
    sum(area) AS whole, coalesce(sum(area) FILTER (WHERE type = '住宅'), 0) AS home, coalesce(sum(area) FILTER (WHERE type = '商业'), 0) AS shop,
    count(DISTINCT type) AS kinds FROM buildings GROUP BY 1) b USING (request_id)"""
NEEDS["building_features"] = ["requests", "buildings"]


def scale(a: str) -> str:
    return (f"CASE WHEN {a} > 0 AND {a} < 3000 THEN least(1.0::DOUBLE + 0.60::DOUBLE * log10(1 + 9 * (1 - {a} / 3000.0::DOUBLE)), 1.60::DOUBLE) "
            f"WHEN {a} >= 3000 AND {a} < 10000 THEN 1.25::DOUBLE + 0.35::DOUBLE * (1 - ({a} - 3000) / 7000.0::DOUBLE) "
            f"WHEN {a} > 100000 THEN 1.0::DOUBLE - 0.12::DOUBLE * least(1.0::DOUBLE, ({a} - 100000) / 200000.0::DOUBLE) ELSE 1.0::DOUBLE END")


def factor(c: str, pairs: list[tuple], default: float) -> str:
    return "CASE " + " ".join(f"WHEN {c} = {lit(k)} THEN CAST({v} AS DOUBLE)" for k, v in pairs) + f" ELSE CAST({default} AS DOUBLE) END"


def base_price(kind: str, structure: str, place: str) -> str:
    return (f"({factor(kind, C.BASE_UNIT_PRICE, 3500.0)} * {factor(structure, C.STRUCTURE_FACTOR, 1.0)} * {factor(region(place), C.REGION_FACTOR, 1.0)})")


_complexity = "CASE WHEN building_count > 1 AND floor_std > 0 THEN 1.0::DOUBLE + least(floor_std / 50.0::DOUBLE, 0.15::DOUBLE) ELSE 1.0::DOUBLE END"
VIEWS["est"] = f"""
SELECT *, raw * sc AS price, raw * sc * total_area AS whole FROM (
  SELECT r.*, f.building_count, f.floor_std, f.residential_ratio, f.commercial_ratio, f.mixed_types,
    {base_price('project_type', 'structure_type', 'location')} AS raw, ({scale('total_area')}) * ({_complexity}) AS sc
  FROM requests r JOIN building_features f USING (request_id))"""
NEEDS["est"] = ["requests", "buildings", "building_features"]

VIEWS["fused"] = f"""
SELECT request_id, coalesce(vw / nullif(w, 0), v / n) AS fused, n AS model_count, {rnd('(w / n) * 100', 1)} AS average_accuracy FROM (
  SELECT request_id, CAST(sum(CAST(value * weight AS DECIMAL(28,8))) AS DOUBLE) AS vw, CAST(sum(CAST(weight AS DECIMAL(28,8))) AS DOUBLE) AS w,
    CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE) AS v, count(*) AS n
  FROM predictions WHERE value > 0 GROUP BY 1)"""
NEEDS["fused"] = ["predictions"]

# -- roll-ups and reports ----------------------------------------------------

add("boq_trade_rollup", "rollup", "SELECT * FROM rollup")
add("global_ratios", "ratios", f"SELECT {', '.join(rnd(c, 6) + f' AS {c}' for c in ('arch_ratio', 'deco_ratio', 'inst_ratio'))} FROM ratios")
_prefix2 = f"coalesce(division, {case('substr(boq_code,1,2)', C.PREFIX2_DIVISION, lit('未知'))})"
add("item_training_rows", "boq_items", f"""
SELECT {_prefix2} AS division, unit, '未知' AS building_type, count(*) AS n, {total('quantity')} AS quantity
FROM boq_items WHERE is_active = 1 AND comp_unit_price > 0 GROUP BY 1, 2""")
add("division_trade_counts", "boq_items", """
SELECT coalesce(division,'未分类') AS division, coalesce(trade,'未分类') AS trade, count(*) AS n FROM boq_items GROUP BY 1, 2""")
add("joined_sums", "priced", f"""
SELECT building_type, count(DISTINCT project_id) AS projects, count(*) AS items, {total('total_price')} AS total_price, {total('total_price_adj')} AS total_price_adj
FROM priced JOIN project_meta USING (project_id) GROUP BY 1""")
add("type_price_band", "project_meta", f"""
SELECT type_word, typical_low, typical_high, coalesce(n, 0) AS n, price_min, price_max, {rnd('price_mean', 4)} AS price_mean, n IS NOT NULL AS from_data
FROM {values(C.TYPICAL_PRICE_RANGES)} t(type_word, typical_low, typical_high) LEFT JOIN (
  SELECT w, count(*) AS n, min(unit_price) AS price_min, max(unit_price) AS price_max, {total('unit_price')} / count(unit_price) AS price_mean
  FROM project_meta JOIN (SELECT unnest([{', '.join(lit(r[0]) for r in C.TYPICAL_PRICE_RANGES)}]) AS w) ON contains(building_type, w) GROUP BY 1) ON w = type_word""")
add("section_frequency", "sheet_rows", "SELECT c2 AS section, count(*) AS n FROM sheet_rows WHERE contains(sheet_name,'表-08') AND c2 LIKE '%工程%' GROUP BY 1")
add("sheet_labor", "sheet_rows", f"SELECT project_id, sheet_name, {total('n8')} AS labor FROM sheet_rows WHERE contains(sheet_name,'表-08') GROUP BY 1, 2")
add("steel_unit", "boq_items", """
SELECT count(*) AS n, CASE WHEN median(v) < 1 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS factor
FROM (SELECT quantity / total_price * 1000 AS v FROM boq_items WHERE contains(item_name,'钢')) WHERE v > 0""")
add("value_counts", "project_meta", "SELECT building_type, count(*) AS n FROM project_meta GROUP BY 1")
add("training_stats", "project_meta", f"""
SELECT count(*) AS n, min(unit_price) AS price_min, max(unit_price) AS price_max, {rnd(total('unit_price') + ' / count(unit_price)', 4)} AS price_mean,
  quantile_cont(unit_price, 0.5) AS price_median, min(total_area) AS area_min, max(total_area) AS area_max,
  {rnd(total('total_area') + ' / count(total_area)', 4)} AS area_mean FROM project_meta""")
add("training_by_region", "project_meta", f"SELECT {region('location')} AS region, count(*) AS n FROM project_meta GROUP BY 1")

# -- prices ------------------------------------------------------------------

add("price_normalize", "priced", f"""
SELECT project_id, boq_code, supplier, quantity, total_price, price_adjust_factor, 2020 AS price_base_year, total_price_adj,
  {rnd('comp_unit_price_adj', 4)} AS comp_unit_price_adj FROM priced""")


def mean_of(c: str) -> str:
    cond = "is_active = 1 AND comp_unit_price > 0 AND comp_unit_price_adj > 0"
    return f"({total(c, cond)} / count({c}) FILTER (WHERE {cond}))"


add("price_report", "priced", f"""
SELECT count(*) AS total_items, count(*) FILTER (WHERE comp_unit_price_adj IS NULL) AS open_items, count(*) FILTER (WHERE price_adjust_factor <> 1) AS adjusted_items,
  count(*) FILTER (WHERE price_adjust_factor = 1) AS unchanged_items, {rnd(mean_of('comp_unit_price'), 4)} AS avg_unit_price,
  {rnd(mean_of('comp_unit_price_adj'), 4)} AS avg_unit_price_adj, {rnd(mean_of('comp_unit_price_adj') + ' / ' + mean_of('comp_unit_price'), 4)} AS unit_price_ratio,
  {rnd(mean_of('total_price'), 4)} AS avg_total_price, {rnd(mean_of('total_price_adj'), 4)} AS avg_total_price_adj,
  {rnd(mean_of('total_price_adj') + ' / ' + mean_of('total_price'), 4)} AS total_price_ratio FROM priced""")
add("price_run_stats", "factors boq_items", """
SELECT CASE WHEN known THEN build_year END AS build_year, factor, known AS year_known, count(*) AS projects, CAST(sum(coalesce(n, 0)) AS BIGINT) AS items
FROM factors LEFT JOIN (SELECT project_id, count(*) AS n FROM boq_items GROUP BY 1) USING (project_id) GROUP BY 1, 2, 3""")

# -- quality -----------------------------------------------------------------

_bad_up, _bad_area, _bad_cost = "(unit_price < 500 OR unit_price > 50000)", "(total_area <= 0)", "(total_cost <= 0)"
_bad = f"(coalesce({_bad_up}, false) OR coalesce({_bad_area}, false) OR coalesce({_bad_cost}, false))"
add("quality_gate", "project_meta", f"SELECT project_id, total_cost, total_area FROM project_meta WHERE NOT {_bad}")
add("drop_reasons", "project_meta", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE NOT {_bad}) AS kept, count(*) FILTER (WHERE {_bad}) AS dropped, count(*) FILTER (WHERE {_bad_up}) AS bad_unit_price,
  count(*) FILTER (WHERE {_bad_area}) AS bad_area, count(*) FILTER (WHERE {_bad_cost}) AS bad_cost FROM project_meta""")
add("import_projects", "", f"""
SELECT CASE WHEN g = 'A' AND c = 'high' THEN 1.0::DOUBLE WHEN g = 'B' AND c = 'medium' THEN 0.7::DOUBLE WHEN g = 'C' AND c = 'low' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS weight,
  bad AS dropped, count(*) AS n, {total('v')} AS total FROM (
  SELECT l_returnflag AS g, CASE WHEN l_returnflag = 'A' THEN 'high' WHEN l_linestatus = 'O' THEN 'medium' ELSE 'low' END AS c, l_extendedprice AS v,
    l_extendedprice / l_quantity < 500 OR l_extendedprice / l_quantity > 50000 OR l_quantity - 1 <= 0 OR l_extendedprice <= 0 AS bad FROM lineitem) GROUP BY 1, 2""")
add("history_round_trip", "", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
add("flat_round_trip", "", "SELECT o_orderkey, 'a \"' || o_orderstatus || '\", b' || chr(10) || o_custkey AS note, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
add("batch_with_failures", "", """
WITH f AS (SELECT o_orderkey // 2000 AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS k FROM orders GROUP BY 1),
 t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS keys FROM f WHERE part % 5 <> 3)
SELECT CAST(1 AS INTEGER) AS run, reason, files, rows, n, keys FROM (
  SELECT CASE WHEN part % 5 = 3 THEN 'json' END AS reason, count(*) AS files, CAST(sum(CASE WHEN part % 5 = 3 THEN 0 ELSE f.n END) AS BIGINT) AS rows FROM f GROUP BY 1), t""")
add("grade_weights", "project_meta", """
SELECT grade, label, CASE WHEN grade = 'A' THEN 'A' WHEN grade = 'B' THEN 'B' ELSE 'C' END AS mapped,
  CASE grade WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS weight,
  CASE label WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, count(*) AS n
FROM (SELECT data_quality_grade AS grade, CASE data_quality_grade WHEN 'A' THEN 'high' WHEN 'B' THEN 'medium' ELSE 'low' END AS label FROM project_meta) GROUP BY 1, 2""")
_profiled = ["building_type", "build_year", "decoration_standard", "foundation_type", "total_area", "unit_price", "data_quality_grade"]
add("null_profile", "project_meta", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM project_meta" for c in _profiled))
add("range_profile", "project_meta", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value, {rnd(total(c) + f' / count({c})', 4)} AS avg_value FROM project_meta WHERE {c} > 0"
    for c in ("total_cost", "total_area")))
add("fill_rate", "boq_items", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} > 0) AS non_zero, count(*) AS total, "
    f"{rnd(f'CAST(count(*) FILTER (WHERE {c} > 0) AS DOUBLE) / count(*) * 100', 1)} AS pct FROM boq_items" for c in ("labor_fee", "quantity", "is_active")))
add("feature_variance", "project_meta", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, {rnd(f'var_samp(CAST({c} AS DOUBLE)) / 1000', 3)} AS variance_k, var_samp(CAST({c} AS DOUBLE)) = 0 AS is_constant FROM project_meta"
    for n, c in (("total_area", "total_area"), ("above_ground_floors", "above_ground_floors"), ("constant", "1"))))
_cats = ", ".join(lit(c) for c in C.SUFFICIENCY_CATEGORIES)
add("sufficiency", "project_meta", f"""
WITH b AS (SELECT count(*) AS total, count(*) FILTER (WHERE data_quality_grade IS NULL) AS sim FROM project_meta),
 m AS (SELECT list(c ORDER BY i) AS cats FROM (SELECT unnest([{_cats}]) AS c, unnest(range(8)) AS i)
       WHERE coalesce((SELECT count(*) FROM project_meta WHERE building_type = c), 0) < 5),
 g AS (SELECT count(*) AS thin FROM (SELECT {region('location')} AS r, count(*) AS n FROM project_meta GROUP BY 1) WHERE n < 3),
 s AS (SELECT *, greatest(0, 100 - CASE WHEN total < 30 THEN 30 WHEN total < 100 THEN 10 ELSE 0 END - coalesce(len(cats), 0) * 5 - thin * 2 - 10
         - CASE WHEN sim / total > 0.5 THEN 10 ELSE 0 END) AS sc FROM b, m, g)
SELECT total AS total_samples, total - sim AS real_samples, sim AS simulated_samples, CAST(sc AS DOUBLE) AS score, sc >= 60 AND total >= 30 AS sufficient,
  concat_ws(',', CASE WHEN total < 30 THEN 'too_few_samples' WHEN total < 100 THEN 'below_recommended_samples' END, CASE WHEN len(cats) > 0 THEN 'thin_categories' END,
    CASE WHEN thin > 0 THEN 'thin_regions' END, 'constant_features', CASE WHEN sim / total > 0.5 THEN 'mostly_simulated' END) AS issues,
  coalesce(array_to_string(cats, ','), '') AS missing_categories, thin AS thin_regions, 'flat' AS constant_features FROM s""")
add("duplicate_audit", "", "SELECT l_orderkey AS project_id, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add("duplicate_summary", "", """
SELECT count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)""")
add("coexistence_audit", "", """
SELECT o_custkey AS customer, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS with_marker FROM orders GROUP BY 1
HAVING with_marker > 0 AND with_marker < n""")
_six = ["structure_type", "build_year", "decoration_standard", "foundation_type", "total_area", "data_quality_grade"]
add("metadata_completeness", "project_meta", f"""
SELECT {rnd('(' + ' + '.join(f'({c} IS NOT NULL)::INT' for c in _six) + ') / 6.0::DOUBLE', 4)} AS completeness, count(*) AS n FROM project_meta GROUP BY 1""")
add("request_validation", "buildings", """
SELECT request_id, concat_ws(',', CASE WHEN build_year < 1900 OR build_year > 2100 THEN 'build_year' END,
  CASE WHEN request_id IN (SELECT request_id FROM buildings WHERE area <= 0 OR area > 1000000) THEN 'buildings.area' END,
  CASE WHEN request_id IN (SELECT request_id FROM buildings WHERE floors < 1 OR floors > 500) THEN 'buildings.floors' END,
  CASE WHEN floors < 1 OR floors > 500 THEN 'floors' END, CASE WHEN total_area <= 0 OR total_area > 10000000 THEN 'total_area' END) AS violations FROM requests""")
add("area_consistency", "buildings", """
SELECT request_id, coalesce(NOT (s > 0 AND abs(s - t) / nullif(t, 0) > 0.01), true) AS consistent FROM (
  SELECT request_id, sum(b.area) AS s, any_value(total_area * (1 + (request_id % 4) / 100.0::DOUBLE)) AS t FROM buildings b JOIN requests USING (request_id) GROUP BY 1)""")
add("parse_failures", "", "SELECT doc_id % 3 = 0 AND doc_id % 10 = 0 AS failed, count(*) AS n FROM documents GROUP BY 1")

# -- tables ------------------------------------------------------------------

add("newest_projects", "project_meta", """
SELECT project_id, name, building_type, CASE data_quality_grade WHEN 'A' THEN 'high' WHEN 'B' THEN 'medium' ELSE 'low' END AS data_confidence
FROM project_meta ORDER BY extraction_date DESC, project_id LIMIT 1000""")
add("active_items_of_projects", "", f"""
SELECT l_orderkey AS project_id, count(*) AS n, {total('l_extendedprice')} AS total FROM lineitem
WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
add("upsert_latest", "", """
SELECT key, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq % 2 DESC, seq DESC) AS r FROM (
  SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders)) WHERE r = 1""")
add("insert_missing", "", """
SELECT DISTINCT year(o_orderdate) AS year, 'orders' AS origin FROM orders UNION ALL
SELECT DISTINCT year(ts), 'events' FROM events WHERE year(ts) NOT IN (SELECT year(o_orderdate) FROM orders)""")
add("delete_keys", "uploads", f"SELECT task_id, file_format FROM uploads WHERE NOT expires_at < TIMESTAMP '{S.AS_OF}'")
add("expired_uploads", "uploads", f"SELECT task_id, expires_at FROM uploads WHERE expires_at < TIMESTAMP '{S.AS_OF}' ORDER BY expires_at, task_id LIMIT 200")
add("orphan_files", "uploads", """
SELECT id || '.pdf' AS file, id AS task_id FROM (SELECT DISTINCT lpad(CAST(event_id * 3 % 200003 AS VARCHAR), 8, '0') AS id FROM events)
WHERE id NOT IN (SELECT task_id FROM uploads)""")
add("upload_json", "uploads", "SELECT task_id, value, event_type FROM uploads")
add("variant_kinds", "", "SELECT 'BIGINT' AS kind, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum FROM events")
_ext = pick(S.EXTENSIONS, "event_id")
_safe = "(" + ", ".join(lit(e) for e in C.ALLOWED_EXTENSIONS) + ")"
add("stored_names", "", f"SELECT lpad(CAST(event_id AS VARCHAR), 8, '0') || CASE WHEN lower({_ext}) IN {_safe} THEN lower({_ext}) ELSE '' END AS stored FROM events")
add("file_admission", "", f"""
SELECT extension, CASE WHEN extension NOT IN {_safe} THEN 'extension' WHEN n_chars * 10000 > 52428800 THEN 'size' END AS rejected, count(*) AS n
FROM (SELECT lower({pick(S.EXTENSIONS, 'doc_id')}) AS extension, n_chars FROM documents) GROUP BY 1, 2""")
add("snapshot_diff", "", """
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS rows_after, 'row_count' AS difference
UNION ALL SELECT 'part', count(*), count(*), 'signature' FROM part UNION ALL SELECT 'events', count(*), NULL, 'removed' FROM events
UNION ALL SELECT 'nation', NULL, count(*), 'added' FROM nation""")
add("orphan_check", "", """
SELECT l_orderkey AS project_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
add("missing_breakdown", "project_meta", "SELECT project_id, name FROM project_meta WHERE project_id NOT IN (SELECT l_orderkey FROM lineitem)")
add("conformed_projects", "project_meta", """
SELECT CAST(project_id AS VARCHAR) AS project_id, total_cost, coalesce(data_quality_grade, 'C') AS data_quality_grade, 0.5::DOUBLE AS confidence, 1 AS building_count,
  false AS mixed_types, NULL::INTEGER AS max_floor, 'extracted' AS field_source FROM project_meta""")
add("conditional_update", "boq_items", f"""
SELECT coalesce(division, '未分类') AS division, count(*) AS n, {total('CASE WHEN division IS NULL THEN 0 ELSE labor_fee END')} AS labor FROM boq_items GROUP BY 1""")
add("numbered_records", "", "SELECT o_orderkey AS seq, printf('P%04d', row_number() OVER (ORDER BY o_orderkey)) AS record_id FROM orders")
add("source_union", "project_meta", """
SELECT CASE WHEN project_id % 2 = 0 THEN 'A' ELSE 'B' END AS source_type, CASE WHEN project_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS weight, count(*) AS n,
  count(total_cost) FILTER (WHERE project_id % 2 = 0) AS with_cost, count(build_year) FILTER (WHERE project_id % 2 = 1) AS with_year FROM project_meta GROUP BY 1, 2""")

# -- names and rules ---------------------------------------------------------

add("region_lookup", "project_meta", f"SELECT location, {region('location')} AS region, count(*) AS n FROM project_meta GROUP BY 1, 2")
add("longest_match_lookup", "project_meta", f"""
SELECT location, any_value(seismic) AS seismic, count(*) AS n FROM project_meta JOIN {seismic_of_places()} ON place = location GROUP BY 1""")
add("prefix_division", "boq_items", f"""
SELECT {case('substr(boq_code,1,4)', C.PREFIX4_DIVISION, lit('其他'))} AS division4, {_prefix2} AS division2, count(*) AS n, {total('total_price')} AS total
FROM boq_items GROUP BY 1, 2""")
add("building_type_rules", "project_meta", f"""
SELECT {words("coalesce(decoration_standard,'') || ' ' || name", C.BUILDING_TYPE_WORDS, lit('住宅'))} AS inferred,
  {words('building_type', C.TYPE_SYNONYMS, 'building_type')} AS synonym, count(*) AS n FROM project_meta GROUP BY 1, 2""")
add("structure_rules", "project_meta", """
SELECT structure_type AS raw, CASE structure_type WHEN '框架结构' THEN '框架结构' WHEN '剪力墙结构' THEN '框剪结构' ELSE '钢结构' END AS inferred,
  CASE WHEN structure_type = '剪力墙结构' THEN '框架结构' ELSE structure_type END AS repaired,
  CASE structure_type WHEN '框架结构' THEN '框架结构' WHEN '剪力墙结构' THEN '框剪结构' ELSE '钢结构' END AS from_name, count(*) AS n FROM project_meta GROUP BY 1""")
add("trade_rules", "boq_items", f"""
SELECT {words("item_name || ' ' || coalesce(division,'')", C.TRADE_WORDS, lit('土建'))} AS trade, {material('item_name')} AS material, count(*) AS n FROM boq_items GROUP BY 1, 2""")
add("code_rules", "boq_items", """
SELECT code, regexp_matches(replace(replace(code,'-',''),' ',''), '^[0-9]{9,}$') AS valid, count(*) AS n FROM (
  SELECT CASE WHEN regexp_matches(c,'^[0-9]+$') AND length(c) < 12 THEN lpad(c, 12, '0') ELSE c END AS code FROM (
    SELECT CASE WHEN supplier % 2 = 0 THEN substr(boq_code, 2) ELSE substr(boq_code,1,6) || '-' || substr(boq_code,7) END AS c FROM boq_items)) GROUP BY 1, 2""")
add("project_keys", "project_meta", """
SELECT project_id, title, replace(title,' ','').replace('（','(').replace('）',')') AS key, substr(md5(key),1,12) AS hash_id,
  hash_id || '_010101001001_' || substr(md5(hash_id || '|010101001001|' || building_type),1,8) AS item_id
FROM (SELECT project_id, building_type, name || '（一期）' AS title FROM project_meta)""")
add("decoration_levels", "requests", """
SELECT decoration_level, CASE decoration_level WHEN '毛坯' THEN '简单装修' WHEN '简单装修' THEN '简单装修' WHEN '精装修' THEN '精装修' WHEN '豪华装修' THEN '豪华装修'
  ELSE '普通装修' END AS level, count(*) AS n FROM requests GROUP BY 1""")
add("floor_tiers", "project_meta", """
SELECT tier, CASE tier WHEN '多层' THEN 2000.0::DOUBLE WHEN '小高层' THEN 3000.0::DOUBLE ELSE 4000.0::DOUBLE END AS price_low,
  CASE tier WHEN '多层' THEN 4000.0::DOUBLE WHEN '小高层' THEN 5000.0::DOUBLE ELSE 7000.0::DOUBLE END AS price_high, count(*) AS n
FROM (SELECT CASE WHEN above_ground_floors <= 6 THEN '多层' WHEN above_ground_floors <= 18 THEN '小高层' ELSE '高层' END AS tier FROM project_meta) GROUP BY 1""")
add("material_grades", "boq_items", """
SELECT CASE WHEN comp_unit_price >= 450 THEN 'C50' WHEN comp_unit_price >= 390 THEN 'C40' WHEN comp_unit_price >= 350 THEN 'C35' WHEN comp_unit_price >= 310 THEN 'C30' ELSE 'C25' END AS concrete,
  CASE WHEN comp_unit_price >= 4500 THEN 'HRB500' WHEN comp_unit_price >= 3700 THEN 'HRB400' ELSE 'HRB335' END AS steel, count(*) AS n FROM boq_items GROUP BY 1, 2""")
add("money_labels", "project_meta", """
SELECT project_id, CASE WHEN v >= 1e8 THEN CAST(CAST(CAST(v / 1e8 AS DECIMAL(38,6)) AS DECIMAL(30,2)) AS VARCHAR) || '亿元'
  WHEN v >= 1e4 THEN CAST(CAST(CAST(v / 1e4 AS DECIMAL(38,6)) AS DECIMAL(30,2)) AS VARCHAR) || '万元'
  ELSE CAST(CAST(CAST(v AS DECIMAL(38,6)) AS DECIMAL(30,2)) AS VARCHAR) || '元' END AS label
FROM (SELECT project_id, CASE project_id % 3 WHEN 0 THEN total_cost * 100 WHEN 1 THEN total_cost ELSE total_cost / 100000 END AS v FROM project_meta)""")
_cities = first("a", C.ADDRESS_CITIES, "'四川'")
add("floor_texts", "project_meta", f"""
SELECT project_id, CAST(CASE project_id % 4 WHEN 0 THEN greatest(project_id % 30, project_id % 17) WHEN 1 THEN CASE WHEN project_id % 40 > 0 THEN project_id % 40 ELSE 6 END
  ELSE 6 END AS INTEGER) AS floors, {_cities} AS region FROM (SELECT project_id, '四川省' || {pick(S.PLACES, 'project_id')} AS a FROM project_meta)""")
add("date_rules", "", """
SELECT strftime(o_orderdate, '%G-W%V') AS iso_week, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
  try_cast(year(o_orderdate) || '-02-29' AS DATE) IS NOT NULL AS leap, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
add("text_equality", "", "SELECT lower(p_type) = lower(upper(p_type)) AS same, count(*) AS n, max(p_name) AS last_name, "
    f"max({pick(S.PLACES, 'p_partkey')}) AS last_place, min(nullif({pick(S.PLACES, 'p_partkey')}, '')) AS first_place FROM part GROUP BY 1")
add("building_lists", "project_meta", """
SELECT project_id, CASE WHEN n BETWEEN 2 AND 3 THEN greatest(a, b) WHEN n = 4 THEN greatest(a, b, c) END AS max_floor,
  CASE WHEN n BETWEEN 2 AND 3 THEN least(a, b) WHEN n = 4 THEN least(a, b, c) END AS min_floor, CASE WHEN n BETWEEN 2 AND 3 THEN 2 WHEN n = 4 THEN 3 END AS buildings
FROM (SELECT project_id, CAST(project_id % 30 + 1 AS INTEGER) AS a, CAST(project_id % 20 + 1 AS INTEGER) AS b, CAST(project_id % 33 AS INTEGER) AS c, project_id % 5 AS n FROM project_meta)""")
_cjk3 = "'[\\x{4e00}-\\x{9fff}]{3,}'"
add("fuzzy_name_match", "", f"""
WITH p AS (SELECT c_custkey AS project_id, CASE WHEN c_custkey % 11 = 0 THEN '甲' || c_custkey WHEN c_custkey % 13 = 0 THEN '独有名称之处' ELSE
             {pick(S.NAME_WORDS, 'c_custkey')} || '-' || {pick(['建设工程项目', '改造工程', '一期'], 'c_custkey')} || '-' ||
             {pick(['新都片区', '高新园区', '老城'], 'c_custkey // 3')} END AS name FROM customer),
 f AS (SELECT s_suppkey || '.' || {pick(S.NAME_WORDS, 's_suppkey')} || '（' || {pick(['建设工程项目部', '改造工程', '二期'], 's_suppkey')} || '）' ||
         {pick(['新都片区', '高新园区', '旧城区'], 's_suppkey // 5')} AS folder,
       CASE WHEN s_suppkey % 3 = 0 THEN '项目信息表.xlsx' WHEN s_suppkey % 7 = 0 THEN '说明.docx' ELSE 'f' || s_suppkey || '.xlsx' END AS file FROM supplier),
 held AS (SELECT folder, min(file) AS file FROM f WHERE file LIKE '%.xlsx' AND NOT contains(file, '项目信息') GROUP BY 1),
 pt AS (SELECT *, list_distinct(regexp_extract_all(name, {_cjk3})) AS w FROM p), ft AS (SELECT *, list_distinct(regexp_extract_all(folder, {_cjk3})) AS w FROM held),
 m AS (SELECT project_id, min({{'folder': folder, 'file': file}}) AS m FROM pt, ft WHERE len(pt.w) > 0 AND len(ft.w) > 0 AND (
  len(list_intersect(pt.w, ft.w)) >= least(2, len(pt.w)) OR (len(pt.w) <= 3 AND len([x FOR x IN pt.w IF length(x) >= 4 AND contains(folder, x)]) > 0)) GROUP BY 1)
SELECT project_id, m.folder AS folder, m.file AS file FROM p LEFT JOIN m USING (project_id)""")
add("dictionary_lookup", "", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS word FROM benchmark), c AS (SELECT word, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % 1000 AS crc FROM w),
 d AS (SELECT doc_id, max(text) AS text FROM documents GROUP BY 1)
SELECT doc_id, min({{'s': crc, 'w': word}}).w AS first, min({{'l': -length(word), 's': crc, 'w': word}}).w AS longest FROM d JOIN c ON contains(text, word) GROUP BY 1""")
add("file_match", "", f"""
WITH p AS (SELECT c_custkey AS project_id, {pick(S.NAME_WORDS, 'c_custkey')} || (c_custkey % 12) AS name, 'f' || (c_custkey * 3) || '.xlsx' AS source_file FROM customer),
 f AS (SELECT s_suppkey || '.' || {pick(S.NAME_WORDS, 's_suppkey')} || (s_suppkey % 12) || '号' AS folder, 'f' || s_suppkey || '.xlsx' AS file FROM supplier),
 e AS (SELECT project_id, min({{'folder': folder, 'file': file}}) AS m FROM p JOIN f ON file = source_file GROUP BY 1),
 n AS (SELECT project_id, min({{'folder': folder, 'file': file}}) AS m FROM p JOIN f ON contains(folder, name) GROUP BY 1)
SELECT p.project_id, coalesce(e.m, n.m).folder AS folder, coalesce(e.m, n.m).file AS file,
  CASE WHEN e.m IS NOT NULL THEN 'file_name' WHEN n.m IS NOT NULL THEN 'folder_name' ELSE 'none' END AS matched_by
FROM p LEFT JOIN e USING (project_id) LEFT JOIN n USING (project_id)""")

# -- sheets ------------------------------------------------------------------

add("bill_items", "bill", "SELECT * FROM bill")
add("forward_fill_sections", "bill", f"SELECT section, division, count(*) AS n, {total('total_price')} AS total FROM bill GROUP BY 1, 2")
add("filled_codes", "sheet_rows", """
SELECT project_id, count(code) AS filled, min(code) AS first, max(code) AS last FROM (
  SELECT project_id, last_value(nullif(c1,'') IGNORE NULLS) OVER (PARTITION BY project_id, sheet_name, sheet_order ORDER BY row_num
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM sheet_rows WHERE contains(sheet_name,'表-08')) GROUP BY 1""")
add("merged_ranges", "", """
WITH l AS (SELECT l_orderkey AS o, l_orderkey * 8 + l_linenumber AS r, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
 rows_ AS (SELECT o, r, p, CAST(r AS VARCHAR) AS c0, CASE WHEN p % 3 = 0 THEN 'p' || p END AS c1, CASE WHEN p % 5 = 0 THEN 'v' || p END AS c2 FROM l),
 g AS (SELECT min(r) AS lo, o * 8 + 7 AS hi, 2 AS a, 2 AS b FROM rows_ GROUP BY o
       UNION ALL SELECT min(r), min(r) + 120000, 3, 3 FROM rows_ WHERE p % 5 = 0 GROUP BY o // 16384
       UNION ALL SELECT min(r), min(r) + 5000, 2, 3 FROM rows_ WHERE p % 3 = 0 GROUP BY o // 3000),
 v AS (SELECT g.*, CASE a WHEN 2 THEN c1 ELSE c2 END AS x FROM g JOIN rows_ ON r = lo),
 n AS (SELECT rows_.r, min({'lo': lo, 'a': a, 'hi': hi, 'b': b, 'x': x}) FILTER (WHERE 2 BETWEEN a AND b) AS f1,
              min({'lo': lo, 'a': a, 'hi': hi, 'b': b, 'x': x}) FILTER (WHERE 3 BETWEEN a AND b) AS f2
       FROM rows_ JOIN v ON r BETWEEN lo AND hi WHERE x IS NOT NULL GROUP BY 1)
SELECT r AS row_num, c0, coalesce(c1, f1.x) AS c1, coalesce(c2, f2.x) AS c2 FROM rows_ LEFT JOIN n USING (r)""")
add("fee_totals", "fees", "SELECT * FROM fees")
add("crosscheck", "bill fees", f"""
SELECT project_id, extracted, part_fee, CASE WHEN extracted > 0 AND part_fee > 0 THEN {rnd('abs(extracted - part_fee) / part_fee * 100', 2)} END AS diff_pct
FROM (SELECT project_id, {total('total_price')} AS extracted FROM bill GROUP BY 1) LEFT JOIN fees USING (project_id)""")
_unit = "trim(replace(replace(sheet_name,'表-08',''),'F.1.1',''))"
add("building_summary", "sheet_rows", f"""
SELECT project_id, count(*) AS building_count, CASE WHEN count(*) > 1 THEN max(f) END AS max_floor, CASE WHEN count(*) > 1 THEN min(f) END AS min_floor,
  count(*) > 1 AND count(DISTINCT t) > 1 AS mixed_types FROM (
  SELECT project_id, CASE u WHEN '1#楼 18层' THEN 18 WHEN '2#商业楼 6F' THEN 6 WHEN '10~12#楼' THEN 12 END AS f,
    CASE u WHEN '2#商业楼 6F' THEN '商业' WHEN '地下车库' THEN '车库' ELSE '住宅' END AS t
  FROM (SELECT DISTINCT project_id, {_unit} AS u FROM sheet_rows WHERE contains(sheet_name,'表-08'))) GROUP BY 1""")
add("cost_breakdown", "breakdown", """SELECT * EXCLUDE (l, pen), '[' || array_to_string([x FOR x IN [CASE WHEN e2_count = 0 THEN '"no e2 sheet"' END, CASE WHEN f11_count = 0 THEN '"no f11 sheet"' END,
  CASE WHEN e3_count = 0 THEN '"no e3 sheet"' END] IF x IS NOT NULL], ',') || ']' AS extraction_errors FROM breakdown""")
_name = "trim(replace(replace(sheet_name,'表-08',''),'F.1.1',''))"
add("building_json", "sheet_rows", f"""
SELECT project_id, 0::BIGINT AS segment, '[' || string_agg('{{"name":"F.1.1 ' || u || '","floors":' || f || ',"type":"' || t || '"}}', ',' ORDER BY o) || ']' AS buildings_json FROM (
  SELECT project_id, o, u, CASE u WHEN '1#楼 18层' THEN 18 WHEN '2#商业楼 6F' THEN 6 WHEN '10~12#楼' THEN 12 ELSE 1 END AS f, CASE u WHEN '2#商业楼 6F' THEN '商业' WHEN '地下车库' THEN '车库' ELSE '住宅' END AS t
  FROM (SELECT DISTINCT project_id, sheet_order AS o, {_name} AS u FROM sheet_rows WHERE contains(sheet_name,'表-08'))) GROUP BY 1""")
add("coverage_pivot", "sheet_rows", "SELECT project_id, " + ", ".join(f"bool_or(contains(sheet_name,'{k}')) AS has_{k[2:]}" for k in C.SHEET_KINDS)
    + ", count(DISTINCT sheet_name) AS sheet_count, false AS has_info FROM sheet_rows GROUP BY 1")
add("source_grades", "workbook", """
SELECT CASE WHEN project_id % 10 = 0 THEN 'A' WHEN has_all OR has21 THEN 'B' ELSE 'C' END AS grade, count(*) AS n FROM workbook GROUP BY 1""")
add("sheet_histogram", "sheet_rows", f"""
SELECT {first('sheet_name', C.SHEET_HISTOGRAM_KINDS, "'other'")} AS sheet_kind, count(*) AS n FROM (SELECT DISTINCT project_id, sheet_name FROM sheet_rows) GROUP BY 1""")
add("sheet_text", "sheet_rows", """
SELECT project_id, 0::BIGINT AS segment, CAST(sum(3 + length(c1) + length(c3)) + count(*) - 1 AS INTEGER) AS chars, CAST(count(*) AS INTEGER) AS lines
FROM sheet_rows WHERE contains(sheet_name,'表-21') GROUP BY 1""")
add("material_classes", "sheet_rows", f"""
SELECT c1 AS name, {material('c1')} AS material, count(*) AS n, {total('n3')} AS quantity FROM sheet_rows WHERE contains(sheet_name,'表-21') GROUP BY 1, 2""")
add("section_costs", "sections", "SELECT * FROM sections")
add("fee_priority_merge", "workbook", "SELECT project_id, total_cost, measure, safety, regulation, tax, arch, deco, inst, items, amount, provisional FROM workbook")
VIEWS["records"] = f"""
SELECT p.project_id, p.name, {words('p.name', C.BUILDING_TYPE_WORDS, lit('住宅'))} AS building_type, {rnd('a', 2)} AS total_area, {rnd('w.total_cost', 2)} AS total_cost,
  {rnd("CASE WHEN a > 0 AND w.total_cost > 0 THEN w.total_cost / a ELSE 0 END", 2)} AS unit_price, {rnd('greatest(amount - labor, 0) * 0.7::DOUBLE', 2)} AS material_fee,
  CASE WHEN w.total_cost > 0 THEN {rnd('labor / w.total_cost', 4)} ELSE 0.0 END AS labor_share, CASE WHEN a > 0 THEN {rnd('concrete / a', 4)} ELSE 0.0 END AS concrete_per_m2,
  CASE WHEN has_all OR has21 THEN 'B' ELSE 'C' END AS source_type, CASE WHEN has_all OR has21 THEN 'medium' ELSE 'low' END AS data_confidence,
  CASE WHEN w.total_cost > 0 THEN '' ELSE 'no_cost,no_area' END AS errors
FROM (SELECT *, CASE WHEN total_cost > 0 THEN total_cost / 1500 ELSE 0 END AS a FROM workbook) w JOIN project_meta p ON p.project_id = w.project_id"""
NEEDS["records"] = ["project_meta", "sheet_rows", "fees", "sections", "workbook"]
add("project_records", "records", "SELECT * FROM records")
add("batch_outcome", "records", """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'skipped' WHEN errors IS NULL THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'already done' WHEN errors IS NULL THEN 'no main workbook' ELSE errors END AS reason, count(*) AS n
FROM orders LEFT JOIN records ON project_id = o_orderkey GROUP BY 1, 2""")
add("enriched_metadata", "project_meta", f"""
WITH p AS (SELECT project_id AS k, CASE WHEN project_id % 2 = 0 THEN structure_type END AS st, build_year AS y, decoration_standard AS de, foundation_type AS fo, above_ground_floors AS ab,
     project_id % 3 <> 0 AS has FROM project_meta),
 q AS (SELECT *, CASE WHEN has AND st IS NULL THEN CASE k % 4 WHEN 0 THEN '框剪结构' WHEN 1 THEN '砖混结构' WHEN 3 THEN '钢结构' END END AS s_st,
   CASE WHEN has AND y IS NULL AND k % 3 = 1 THEN 2021 END AS s_y, CASE WHEN has AND de IS NULL AND k % 3 = 1 THEN '毛坯' END AS s_de,
   CASE WHEN has AND fo IS NULL AND k % 3 = 1 THEN '桩基础' END AS s_fo, CASE WHEN has AND ab = 0 THEN nullif(CAST(greatest(k % 30, k % 4) AS INTEGER), 0) END AS s_ab,
   CASE WHEN has THEN nullif(CAST(k % 4 AS INTEGER), 0) END AS s_un FROM p),
 r AS (SELECT *, coalesce(s_st, CAST(s_y AS VARCHAR), s_de, s_fo, CAST(s_ab AS VARCHAR), CAST(s_un AS VARCHAR)) IS NOT NULL AS x, k % 6 = 3 AND st IS NULL AS named FROM q)
SELECT k AS project_id, coalesce(s_st, CASE WHEN NOT x AND named THEN '框架结构' END, st) AS structure_type, coalesce(s_y, y) AS build_year, coalesce(s_de, de) AS decoration_standard,
  coalesce(s_fo, fo) AS foundation_type, coalesce(s_ab, ab) AS above_ground_floors, s_un AS under_ground_floors,
  CASE WHEN x THEN 'extracted' WHEN named THEN 'inferred' ELSE 'imported' END AS field_source, CASE WHEN x THEN 'extracted' WHEN named THEN 'inferred' ELSE 'failed' END AS outcome,
  {rnd('((structure_type IS NOT NULL)::INT + (coalesce(s_y, y) IS NOT NULL)::INT + (decoration_standard IS NOT NULL)::INT + (foundation_type IS NOT NULL)::INT + 1 + (s_un IS NOT NULL)::INT) / 6.0::DOUBLE', 4)} AS completeness
FROM r""")

# -- training set ------------------------------------------------------------

add("enrich_by_name", "", """
WITH m AS (SELECT name, arg_max(y, seq) AS y0, max({'s': seq, 'y': y, 'p': p}) AS m FROM (
    SELECT 'N' || (o_custkey % 700) AS name, o_orderkey AS seq, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y, o_orderpriority AS p FROM orders) GROUP BY 1)
SELECT 'N' || (c_custkey % 500) AS name, c_custkey, m.m.y AS build_year, m.m.p AS priority FROM customer LEFT JOIN m ON m.name = 'N' || (c_custkey % 500)""")
add("db_only_rows", "project_meta", "SELECT name, project_id FROM project_meta WHERE structure_type <> '框架结构'")
add("breakdown_overlay", "project_meta breakdown", """
SELECT p.project_id, CASE WHEN b.project_id IS NOT NULL AND p.project_id % 5 = 0 THEN '桩基础' ELSE foundation_type END AS foundation_type,
  CASE WHEN labor_cost > 0 THEN labor_cost ELSE 7.0 END AS labor_cost, CASE WHEN building_trade_cost > 0 THEN building_trade_cost ELSE 0.0 END AS arch_cost,
  CASE WHEN foundation_division_cost > 0 THEN foundation_division_cost ELSE 0.0 END AS foundation_cost, CASE WHEN tax_cost > 0 THEN tax_cost ELSE 0.0 END AS tax_cost,
  CASE WHEN b.project_id IS NOT NULL THEN 'C30' END AS concrete_grade, NULL::VARCHAR AS steel_grade
FROM project_meta p LEFT JOIN breakdown b ON b.project_id = p.project_id""")
_known = "(building_type IS NOT NULL AND unit_price > 0)"
add("training_table", "project_meta breakdown ratios", f"""
WITH t AS (SELECT p.*, structure_type = '框架结构' AS base, {_known} IS TRUE AS known, b.building_trade_cost AS bt, b.decoration_trade_cost AS dt, b.installation_trade_cost AS it,
     CASE WHEN foundation_division_cost > 0 THEN foundation_division_cost ELSE 0 END + CASE WHEN main_structure_cost > 0 THEN main_structure_cost ELSE 0 END
     + CASE WHEN roofing_cost > 0 THEN roofing_cost ELSE 0 END + CASE WHEN exterior_wall_cost > 0 THEN exterior_wall_cost ELSE 0 END AS div
   FROM project_meta p LEFT JOIN breakdown b ON b.project_id = p.project_id)
SELECT name, CASE WHEN known THEN greatest(coalesce(above_ground_floors, 1), 1) END AS floors, CASE WHEN known THEN coalesce(build_year, 2023) END AS build_year,
  {region('location')} AS region, seismic,
  {rnd('CASE WHEN NOT base AND bt > 0 THEN bt WHEN NOT base AND div > 0 THEN div ELSE total_cost * arch_ratio END', 2)} AS arch_cost,
  {rnd('CASE WHEN NOT base AND dt > 0 THEN dt ELSE total_cost * deco_ratio END', 2)} AS deco_cost,
  {rnd('CASE WHEN NOT base AND it > 0 THEN it ELSE total_cost * inst_ratio END', 2)} AS inst_cost
FROM t JOIN {seismic_of_places()} ON place = location, ratios WHERE base OR known""")
add("fixed_share_fill", "project_meta", f"""
SELECT project_id, {rnd('CASE WHEN project_id % 2 = 0 THEN 5.0 ELSE total_cost * 0.2::DOUBLE END', 2)} AS labor_cost, {rnd('total_cost * 0.4::DOUBLE', 2)} AS structure_cost,
  {rnd('coalesce(total_area, 0) * 0.055::DOUBLE', 4)} AS rebar_total FROM project_meta""")
add("log_features", "boq_items", f"""
SELECT substr(boq_code,1,4) AS code4, {_prefix2} AS division, unit, '华东' AS region, count(*) AS n,
  {rnd('CAST(sum(CAST(ln(1 + quantity) AS DECIMAL(18,6))) AS DOUBLE)', 3)} AS log_quantity FROM boq_items WHERE is_active = 1 AND comp_unit_price > 0 GROUP BY 1, 2, 3""")
_target = {i: factor("building_type", [(r[0], r[i + 1]) for r in C.TRADE_TARGETS], C.TRADE_TARGET_DEFAULT[i]) for i in range(3)}
_three = "arch_cost > 0 AND deco_cost > 0 AND inst_cost > 0"
add("trade_targets", "project_meta rollup", f"""
SELECT project_id, {', '.join(rnd(f"CASE WHEN {_three} THEN {c}_cost / (arch_cost + deco_cost + inst_cost) ELSE {_target[i]} END", 6) + f' AS {c}_share' for i, c in enumerate(('arch', 'deco', 'inst')))}
FROM project_meta LEFT JOIN rollup USING (project_id)""")

# -- estimates ---------------------------------------------------------------

add("coefficient_fallback", "project_meta coef coef_type", f"""
SELECT project_id, {', '.join(rnd(c, 6) + f' AS {c}' for c in _coef_cols)} FROM ({coefficients('project_meta', 'project_id', 'building_type', 'structure_type', 'above_ground_floors')})""")
_dcols = ["foundation", "structure", "roof", "wall"]
_dsum = "(foundation_cost + structure_cost + roof_cost + wall_cost)"
add("division_targets", "project_meta rollup coef coef_type", f"""
SELECT project_id, {', '.join(rnd(f"CASE WHEN total_cost > 0 AND {_dsum} <> 0 THEN {c}_cost / {_dsum} ELSE division_{i} END", 6) + f' AS {c}_share' for i, c in enumerate(_dcols))}
FROM project_meta JOIN ({coefficients('project_meta', 'project_id', 'building_type', 'structure_type', 'above_ground_floors')}) USING (project_id) LEFT JOIN rollup USING (project_id)""")
add("scale_factor", "project_meta", f"SELECT project_id, {rnd(scale('total_area'), 4)} AS scale FROM (SELECT project_id, coalesce(total_area, 10000.0::DOUBLE) AS total_area FROM project_meta)")
add("multi_building", "building_features", f"SELECT *, {rnd(_complexity, 4)} AS complexity FROM building_features")
_base = ("({t} * {s} * {d} * {r} * (1.0::DOUBLE + (coalesce(build_year, 2026) - 2026) * 0.02::DOUBLE) * (1.0::DOUBLE + greatest(0.0::DOUBLE, (above_ground_floors - 20) * 0.005::DOUBLE)))"
         .format(t=factor("building_type", C.BASE_UNIT_PRICE, 3500.0), s=factor("structure_type", C.STRUCTURE_FACTOR, 1.0),
                 d=factor("coalesce(decoration_standard,'')", C.DECORATION_FACTOR, 1.0), r=factor(region("location"), C.REGION_FACTOR, 1.0)))
_step = "CASE WHEN above_ground_floors > 0 THEN least(above_ground_floors, 5) ELSE 1 END"
add("baseline_price", "project_meta", f"""
SELECT project_id, {rnd(base_price('building_type', 'structure_type', 'location'), 4)} AS base, {rnd(_base, 4)} AS baseline, {rnd(_base + ' * 0.92::DOUBLE', 4)} AS low,
  {rnd(_base + ' * 1.08::DOUBLE', 4)} AS high, {rnd(factor(_step, C.CONCRETE_BY_FLOOR, 0.45) + ' * ' + factor('structure_type', C.STRUCTURE_FACTOR, 1.0), 3)} AS concrete FROM project_meta""")
add("section_split", "project_meta", f"SELECT project_id, part, ratio, {rnd('total_cost * ratio', 2)} AS amount FROM project_meta, {values(C.SECTION_SPLIT)} t(part, ratio)")
add("subsection_split", "project_meta", f"SELECT project_id, parent, part, ratio, {rnd('total_cost * ratio', 2)} AS amount FROM project_meta, {values(C.SUBSECTION_SPLIT)} t(parent, part, ratio)")
add("unit_split", "project_meta", f"SELECT project_id, part, ratio, {rnd('total_cost * 0.95::DOUBLE * ratio', 2)} AS amount FROM project_meta, {values(C.UNIT_PROJECT_SPLIT)} t(part, ratio)")
add("item_amounts", "project_meta", f"""
SELECT project_id, item, unit, per_m2, unit_price, {rnd('per_m2 * unit_price * total_area', 2)} AS amount
FROM (SELECT project_id, coalesce(total_area, 10000.0::DOUBLE) AS total_area FROM project_meta), {values(C.ITEM_QUANTITIES)} t(item, unit, per_m2, unit_price)""")
add("indicator_list", "project_meta", f"""
SELECT project_id, indicator, value, unit, {rnd('value * coalesce(total_area, 10000.0::DOUBLE)', 2)} AS amount FROM project_meta,
  (VALUES ('单方造价', 3500.0::DOUBLE, '元/m²'), ('钢材单方耗量', 55.0::DOUBLE, 'kg/m²'), ('混凝土单方耗量', 0.45::DOUBLE, 'm³/m²'), ('水泥单方耗量', 220.0::DOUBLE, 'kg/m²'),
   ('门窗单方含量', 0.25::DOUBLE, 'm²/m²'), ('模板单方耗量', 2.8::DOUBLE, 'm²/m²')) t(indicator, value, unit)""")
add("price_index_years", "project_meta", f"""
SELECT year, adjustment_factor, (SELECT count(*) FROM project_meta WHERE build_year = year) AS projects FROM {values(C.SEEDED_PRICE_INDEX)} t(year, labor, material, adjustment_factor)""")
add("first_sheets", "sheet_rows", f"""
SELECT project_id, sheet_name, sheet_kind, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, sheet_kind ORDER BY sheet_order, sheet_name) AS place FROM (
    SELECT DISTINCT project_id, sheet_name, sheet_order, {first('sheet_name', C.SHEET_HISTOGRAM_KINDS, "NULL")} AS sheet_kind FROM sheet_rows) WHERE sheet_kind IS NOT NULL) WHERE place <= 2""")
_levels = [(1, "项目总造价", "", 1.0), (2, "单项工程", "", 1.0), *[(3, "单位工程", p, r) for p, r in C.UNIT_PROJECT_SPLIT], *[(4, "分部工程", p, r) for p, r in C.FEE_COMPOSITION],
           (5, "分项工程", "", None), (6, "明细级别", "", None)]
add("six_level_breakdown", "project_meta", f"SELECT project_id, level, label, part, ratio, {rnd('total_cost * ratio', 2)} AS amount FROM project_meta, {values(_levels)} t(level, label, part, ratio)")
add("weighted_fusion", "fused", f"SELECT request_id, {rnd('fused', 2)} AS fused, model_count, average_accuracy FROM fused")
add("percentile_interval", "predictions fused", f"""
SELECT o_orderkey AS request_id, {rnd('CASE WHEN n >= 2 THEN lo ELSE fused END', 2)} AS lower, {rnd('CASE WHEN n >= 2 THEN hi ELSE fused END', 2)} AS upper
FROM orders LEFT JOIN (SELECT request_id, count(*) AS n, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM predictions WHERE accuracy >= 50 AND value <> 0 GROUP BY 1) q ON q.request_id = o_orderkey
 LEFT JOIN fused f ON f.request_id = o_orderkey""")
_direct = "(composition_0 + CASE WHEN mixed_types > 0 THEN 0.02::DOUBLE ELSE 0 END + CASE decoration_level WHEN '精装修' THEN 0.03::DOUBLE WHEN '豪华装修' THEN 0.06::DOUBLE ELSE 0 END)"
_indirect = "(composition_1 - CASE decoration_level WHEN '精装修' THEN 0.02::DOUBLE WHEN '豪华装修' THEN 0.04::DOUBLE ELSE 0 END)"
_csum = f"({_direct} + {_indirect} + composition_2 + composition_3 + composition_4)"
_comp = {"直接工程费": _direct, "间接费": _indirect, "利润": "composition_2", "税金": "composition_3", "其他": "composition_4"}
add("composition_normalised", "est coef coef_type", f"""
WITH k AS ({coefficients('requests', 'request_id', 'project_type', 'structure_type', 'coalesce(floors, 10)')}),
 s AS ({" UNION ALL ".join(f"SELECT request_id, whole, '{n}' AS part, {rnd(f'{x} / {_csum}', 4)} AS ratio FROM est JOIN k USING (request_id)" for n, x in _comp.items())})
SELECT request_id, part, ratio, {rnd('whole * ratio', 2)} AS amount FROM s""")
add("trade_composition", "est", f"""
WITH r AS (SELECT request_id, whole, greatest(0.35::DOUBLE, least(0.75::DOUBLE, 0.55::DOUBLE + 0.10::DOUBLE * residential_ratio - 0.05::DOUBLE * commercial_ratio)) AS a,
   greatest(0.05::DOUBLE, least(0.30::DOUBLE, 0.15::DOUBLE + 0.10::DOUBLE * commercial_ratio)) AS i FROM est),
 s AS (SELECT request_id, whole, '建筑工程' AS part, a AS ratio FROM r UNION ALL SELECT request_id, whole, '装饰工程', {rnd('1.0::DOUBLE - a - i', 4)} FROM r UNION ALL SELECT request_id, whole, '安装工程', i FROM r)
SELECT request_id, part, {rnd('ratio', 4)} AS ratio, {rnd(rnd('whole', 2) + ' * ratio', 2)} AS amount FROM s""")
_found_fix = ("CASE soil_condition WHEN '良好' THEN 0.92::DOUBLE WHEN '一般' THEN 1.0::DOUBLE WHEN '较差' THEN 1.15::DOUBLE WHEN '复杂' THEN 1.3::DOUBLE ELSE "
              "CASE WHEN foundation_type = '独立基础' THEN 0.85::DOUBLE WHEN foundation_type = '筏板基础' THEN 1.10::DOUBLE WHEN contains(foundation_type,'桩基础') THEN 1.35::DOUBLE "
              "WHEN foundation_type = '条形基础' THEN 0.90::DOUBLE END END")
add("full_estimate", "est fused", f"""
WITH e AS (SELECT request_id, coalesce(fused, raw) AS raw2, sc, total_area, fused IS NOT NULL AS m, 0.15::DOUBLE * coalesce({_found_fix}, 1.0::DOUBLE) AS fo FROM est LEFT JOIN fused USING (request_id))
SELECT request_id, {rnd('raw2 * sc', 2)} AS unit_price, {rnd('raw2 * sc * total_area', 2)} AS total_cost, {rnd('raw2', 2)} AS unit_price_raw, {rnd('sc', 4)} AS scale_factor,
  m AS from_models, {rnd('total_area * 0.45::DOUBLE', 2)} AS concrete, {rnd('fo / (fo + 0.40::DOUBLE + 0.05::DOUBLE + 0.10::DOUBLE)', 4)} AS foundation FROM e""")


add("estimate_record", "est fused", f"""
WITH e AS (SELECT request_id, coalesce(fused, raw) * sc AS price, coalesce(model_count, 0) AS model_count, average_accuracy FROM est LEFT JOIN fused USING (request_id)),
 q AS (SELECT request_id, count(*) AS n, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM predictions WHERE accuracy >= 50 AND value <> 0 GROUP BY 1),
 b AS (SELECT max({{'a': a, 'm': model_id}}) AS b FROM (SELECT model_id, avg(accuracy) AS a FROM predictions WHERE model_id NOT IN ('boq_xgb', 'unit_gbt') GROUP BY 1))
SELECT request_id, {rnd('price', 2)} AS unit_price, {rnd(f"CASE WHEN n >= 2 THEN lo ELSE {rnd('price', 2)} END", 2)} AS lower, {rnd(f"CASE WHEN n >= 2 THEN hi ELSE {rnd('price', 2)} END", 2)} AS upper,
  model_count, average_accuracy, b.m AS importance_model, {rnd('b.a / 100', 6)} AS area_importance FROM e LEFT JOIN q USING (request_id), b""")
add("found_projects", "project_meta", "SELECT project_id, name, build_year FROM project_meta WHERE building_type = '学校' AND build_year = 2015")


def _bonus_view() -> str:
    has_value = lambda c: f"({c} <> '' AND lower({c}) NOT IN ('none', 'undefined'))"
    present = ["foundation_type", "seismic_grade", "soil_condition", "hvac", "exterior_wall"]
    parts, base = [], {"subsection_xgb": 36.7, "section_xgb": 51.6, "item_xgb": 89.4}
    for model, (limit, rule_list) in C.BONUS_RULES.items():
        use = [(p, b) for p, b in rule_list if p in present]
        bonus = " + ".join(f"CASE WHEN {has_value(p)} THEN CAST({b} AS DOUBLE) ELSE 0 END" for p, b in use)
        n = " + ".join(f"CASE WHEN {has_value(p)} THEN 1 ELSE 0 END" for p, _ in use)
        names = ", ".join(f"CASE WHEN {has_value(p)} THEN '{p}' END" for p, _ in sorted(use))
        parts.append(f"SELECT request_id, '{model}' AS model_id, least({bonus}, {limit}::DOUBLE) AS input_bonus, {base[model]}::DOUBLE AS b, {limit}::DOUBLE AS max_bonus, "
                     f"CAST({n} AS INTEGER) AS filled_params, {len(rule_list)} AS total_params, concat_ws(',', {names}) AS filled FROM requests")
    return " UNION ALL ".join(parts)


VIEWS["bonus"] = _bonus_view()
NEEDS["bonus"] = ["requests"]
add("confidence_bonus", "bonus", f"""
SELECT request_id, model_id, input_bonus, {rnd('least(b + input_bonus, 100)', 1)} AS effective_accuracy, max_bonus, filled_params, total_params, filled FROM bonus""")
add("overall_confidence", "bonus", f"""
SELECT request_id, {rnd(total('least(b + input_bonus, 100)') + ' / count(*)', 1)} AS effective_accuracy, {rnd(total('input_bonus') + ' / count(*)', 1)} AS total_bonus FROM bonus GROUP BY 1""")
add("empirical_correction", "requests", f"""
SELECT request_id, {_found_fix} AS foundation,
  CASE WHEN contains(foundation_type,'桩基础') THEN 1.05::DOUBLE WHEN foundation_type = '筏板基础' THEN 1.03::DOUBLE WHEN foundation_type = '独立基础' THEN 0.98::DOUBLE END AS building,
  CASE hvac WHEN '中央空调' THEN 1.25::DOUBLE WHEN '多联机' THEN 1.15::DOUBLE WHEN '分体空调' THEN 1.05::DOUBLE WHEN '无' THEN 0.85::DOUBLE END AS installation,
  CASE exterior_wall WHEN '幕墙' THEN 1.30::DOUBLE WHEN '石材' THEN 1.15::DOUBLE WHEN '面砖' THEN 1.0::DOUBLE WHEN '涂料' THEN 0.85::DOUBLE END AS decoration,
  CASE seismic_grade WHEN '特一级' THEN 1.18::DOUBLE WHEN '一级' THEN 1.12::DOUBLE WHEN '二级' THEN 1.06::DOUBLE WHEN '三级' THEN 1.0::DOUBLE WHEN '四级' THEN 0.95::DOUBLE END AS concrete,
  CASE exterior_wall WHEN '幕墙' THEN 0.70::DOUBLE WHEN '石材' THEN 0.85::DOUBLE WHEN '面砖' THEN 0.95::DOUBLE WHEN '涂料' THEN 1.0::DOUBLE END AS block FROM requests""")
add("stage_models", "requests", """
SELECT request_id, CASE stage WHEN 'budget' THEN 'section_xgb,indicator_rf,boq_xgb' ELSE 'section_xgb,indicator_rf' END AS models FROM requests""")
_detail = [(c, len(p), ",".join(p)) for c, p in C.DETAIL_PARAMS]
_catalogue = [("estimation", "基础参数", 7, "project_type,structure_type,total_area,floors,location,build_year,decoration_level"),
              *[("preliminary", *d) for d in _detail], *[("budget", *d) for d in _detail]]
add("stage_parameters", "requests", f"""
SELECT stage, category, n, params, requests FROM {values(_catalogue)} t(stage, category, n, params) JOIN (SELECT stage, count(*) AS requests FROM requests GROUP BY 1) USING (stage)""")
_fits = "CASE building_type " + " ".join(f"WHEN {lit(t)} THEN {has('name', ws)}" for t, ws in C.SIMILAR_NAME_WORDS) + " ELSE false END"
_ring = ("CASE WHEN p.total_area > 0 AND r.total_area > 0 THEN CASE WHEN abs(p.total_area - r.total_area) / greatest(r.total_area, 1) < 0.3 THEN 3 "
         "WHEN abs(p.total_area - r.total_area) / greatest(r.total_area, 1) < 0.5 THEN 2 WHEN abs(p.total_area - r.total_area) / greatest(r.total_area, 1) < 1 THEN 1 ELSE 0 END ELSE 0 END")


def _similar(k: int) -> str:
    return f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, project_id, score, same_type FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, seq) AS rank FROM (
    SELECT r.request_id, p.project_id, p.seq, {_ring} + CASE WHEN p.structure_type = r.structure_type THEN 2 ELSE 0 END AS score, true AS same_type
    FROM requests r JOIN own p ON p.building_type = r.project_type
    UNION ALL SELECT * FROM (SELECT r.request_id, p.project_id, p.seq, {_ring} + CASE WHEN p.structure_type = r.structure_type THEN 1 ELSE 0 END AS score, false AS same_type
    FROM requests r JOIN project_meta p ON p.building_type <> r.project_type WHERE r.project_type NOT IN (SELECT building_type FROM project_meta)) WHERE score > 0))
WHERE rank <= {k}"""


VIEWS["own"] = f"""
SELECT * FROM (SELECT *, {_fits} AS fits, count(*) OVER (PARTITION BY building_type) AS n, count(*) FILTER (WHERE {_fits}) OVER (PARTITION BY building_type) AS f FROM project_meta)
WHERE NOT (n > 3 AND f >= 3) OR fits"""
NEEDS["own"] = ["project_meta"]
add("similar_topk", "requests project_meta own", _similar(5))
add("estimate_references", "requests project_meta own", f"""
WITH s AS ({_similar(3)}), a AS (SELECT request_id, count(*) AS n, min({{'r': rank, 'n': name}}).n AS f, bool_or(same_type) AS same FROM s JOIN project_meta USING (project_id) GROUP BY 1)
SELECT request_id, CAST(coalesce(n, 0) AS INTEGER) AS references, f AS first, coalesce(NOT same, false) AS reference_warning FROM requests LEFT JOIN a USING (request_id)""")
add("evidence_score", "", """
SELECT o_custkey AS customer, count(*) AS n, CASE WHEN count(*) >= 50 THEN 80.0::DOUBLE WHEN count(*) >= 20 THEN 60.0::DOUBLE WHEN count(*) >= 10 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS score
FROM orders GROUP BY 1""")
add("source_counts", "project_meta", "SELECT CASE WHEN data_quality_grade IS NULL THEN 'simulated' ELSE 'real' END AS source_type, count(*) AS n FROM project_meta GROUP BY 1")

# -- documents and conversations ---------------------------------------------


def rx(p: str, group: int = 1, c: str = "full_text") -> str:
    return f"nullif(regexp_extract({c}, {lit(p)}, {group}), '')"


_area = "try_cast(coalesce(" + ", ".join(rx(p) for p in C.AREA_PATTERNS) + ") AS DOUBLE)"
_land = "try_cast(coalesce(" + ", ".join(rx(p) for p in C.LAND_AREA_PATTERNS) + ") AS DOUBLE)"
_year = "try_cast(" + rx("(20\\d{2}|19\\d{2})") + " AS INTEGER)"
add("text_features", "parsed_documents", f"""
SELECT doc_id, coalesce(trim({rx('(?:项目名称|工程名称|项目).*?[：:]\\s*(.+?)(?:\\n|$)')}), 'doc_' || doc_id) AS project_name,
  {words('full_text', C.DOCUMENT_TYPE_WORDS)} AS building_type, {patterns('full_text', C.STRUCTURE_PATTERNS)} AS structure_type, {_area} AS total_area, {_land} AS land_area,
  {first('full_text', C.DOCUMENT_CITIES)} AS location, CASE WHEN {_year} BETWEEN 1950 AND 2030 THEN {_year} END AS build_year,
  list_max([try_cast(x AS INTEGER) FOR x IN regexp_extract_all(full_text, '(\\d+)\\s*(?:层|楼)', 1)]) AS floor_count,
  try_cast({rx('地上\\s*(\\d+)\\s*(?:层|楼)')} AS INTEGER) AS above_ground_floors, try_cast({rx('地下\\s*(\\d+)\\s*(?:层|楼)')} AS INTEGER) AS under_ground_floors,
  {patterns('full_text', C.DOCUMENT_DECORATION_PATTERNS)} AS decoration_standard, {patterns('full_text', C.FOUNDATION_PATTERNS)} AS foundation FROM parsed_documents""")

# Labels of table cells with their fields, and characters that look alike
_LABELS = [("建筑面积", "total_area"), ("总建筑面积", "total_area"), ("建筑总面积", "total_area"), ("占地面积", "land_area"), ("用地面积", "land_area"),
           ("楼层数", "floor_count"), ("总层数", "floor_count"), ("地上层数", "above_ground_floors"), ("地下层数", "under_ground_floors"),
           ("建造年份", "build_year"), ("建设年份", "build_year"), ("竣工年份", "build_year"), ("装修标准", "decoration_standard"),
           ("装修等级", "decoration_standard"), ("所在地区", "location"), ("建设地点", "location"), ("项目地点", "location"),
           ("结构类型", "structure_type"), ("建筑类型", "building_type"), ("工程类型", "building_type"), ("项目名称", "project_name"), ("工程名称", "project_name")]
_ALIKE = ["0O", "1l", "1I", "2Z", "5S", "8B", "：:", "，,"]


def _near(text: str, label: str) -> str:
    """All characters of the label but the last stand in the text in order; the state is the number found so far."""
    alike = ", ".join(lit(p) for a, b in _ALIKE for p in (a + b, b + a))
    return (f"list_reduce(list_prepend(0, list_transform(string_split({text}, ''), lambda ch: unicode(ch))), lambda n, ch: CASE WHEN n < length({label}) AND "
            f"(chr(ch) = substr({label}, n + 1, 1) OR (chr(ch) || substr({label}, n + 1, 1)) IN ({alike})) THEN n + 1 ELSE n END) >= length({label}) - 1")


VIEWS["document_table"] = f"""
SELECT p.doc_id, field, nullif(regexp_extract(value, CASE WHEN field IN ('total_area', 'land_area') THEN '(\\d+(?:\\.\\d+)?)' ELSE '(\\d+)' END, 1), '') AS value, r, i
FROM (
  SELECT doc_id, r, i, label, field, arg_min(v, j) FILTER (WHERE v IS NOT NULL) AS value FROM (
    SELECT doc_id, r, i, label, field, j, CASE WHEN {_near('c', 'label')} THEN
        coalesce(nullif(trim(regexp_extract(c, label || '\\s*[:：]\\s*(.+)', 1)), ''), CASE WHEN nullif(f, '') IS DISTINCT FROM label THEN nullif(f, '') END,
                 CASE WHEN len(string_split_regex(c, '\\s+')) >= 2 THEN string_split_regex(c, '\\s+')[-1] END) END AS v
    FROM (SELECT *, cells[j] AS c, coalesce(cells[j + 1], '') AS f FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS j FROM (
      SELECT doc_id, r, cells, array_to_string(cells, ' ') AS line FROM (
        SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS r, unnest([['序号', '名称'], ['建筑总面积', CAST(n_chars * 3 AS VARCHAR)], ['楼层数：12', 'x'],
          [CASE WHEN doc_id % 7 = 0 THEN '建造年' ELSE '建造年份' END, CAST(1990 + doc_id % 40 AS VARCHAR)],
          ['合计', ['1,234.5万元', '2.5亿元', '987654', '900', '合同 88,000 元'][doc_id % 5 + 1], '12000']]) AS cells FROM documents)),
      {values([(i, x, f) for i, (x, f) in enumerate(_LABELS)])} l(i, label, field) WHERE {_near('line', 'label')}))) GROUP BY ALL) AS p"""
VIEWS["text_fields"] = f"""
SELECT doc_id, coalesce(trim({rx('(?:项目名称|工程名称|项目).*?[：:]\\s*(.+?)(?:\\n|$)')}), 'doc_' || doc_id) AS project_name,
  {words('full_text', C.DOCUMENT_TYPE_WORDS)} AS building_type, {patterns('full_text', C.STRUCTURE_PATTERNS)} AS structure_type, {_area} AS total_area, {_land} AS land_area,
  {first('full_text', C.DOCUMENT_CITIES)} AS location, CASE WHEN {_year} BETWEEN 1950 AND 2030 THEN {_year} END AS build_year,
  list_max([try_cast(x AS INTEGER) FOR x IN regexp_extract_all(full_text, '(\\d+)\\s*(?:层|楼)', 1)]) AS floor_count,
  try_cast({rx('地上\\s*(\\d+)\\s*(?:层|楼)')} AS INTEGER) AS above_ground_floors, try_cast({rx('地下\\s*(\\d+)\\s*(?:层|楼)')} AS INTEGER) AS under_ground_floors,
  {patterns('full_text', C.DOCUMENT_DECORATION_PATTERNS)} AS decoration_standard FROM parsed_documents"""
# of each row of a table the first label whose field the text left empty; no field stands in two rows
VIEWS["document_facts"] = """
SELECT t.* REPLACE (coalesce(t.total_area, try_cast(a.m['total_area'][1] AS DOUBLE)) AS total_area, coalesce(t.build_year, try_cast(a.m['build_year'][1] AS INTEGER)) AS build_year,
    coalesce(t.floor_count, try_cast(a.m['floor_count'][1] AS INTEGER)) AS floor_count), coalesce(a.from_table, '') AS from_table,
  CASE t.doc_id % 5 WHEN 0 THEN 1234.5::DOUBLE * 1e4 WHEN 1 THEN 2.5::DOUBLE * 1e8 WHEN 2 THEN 987654.0::DOUBLE WHEN 3 THEN 12000.0::DOUBLE ELSE 88000.0::DOUBLE END AS total_cost
FROM text_fields t LEFT JOIN (
  SELECT doc_id, MAP_FROM_ENTRIES(list((field, [value]))) AS m, string_agg(field, ',' ORDER BY field) AS from_table FROM (
    SELECT d.doc_id, r, arg_min(field, i) AS field, arg_min(value, i) AS value FROM document_table d JOIN text_fields t USING (doc_id)
    WHERE value IS NOT NULL AND CASE field WHEN 'total_area' THEN t.total_area IS NULL WHEN 'land_area' THEN t.land_area IS NULL WHEN 'floor_count' THEN t.floor_count IS NULL
      WHEN 'build_year' THEN t.build_year IS NULL ELSE false END GROUP BY 1, 2) GROUP BY 1) a ON a.doc_id = t.doc_id"""
NEEDS["document_facts"] = ["parsed_documents", "document_table", "text_fields"]
_unit = rnd("total_cost / total_area", 2)
_unit = f"CASE WHEN total_area > 0 THEN {_unit} END"
_complete = "((building_type IS NOT NULL)::INT + (total_area IS NOT NULL)::INT + (structure_type IS NOT NULL)::INT + (location IS NOT NULL)::INT) / 4.0::DOUBLE"
add("table_fields", "document_facts", "SELECT doc_id, total_area, build_year, floor_count, from_table FROM document_facts")
_known = ["above_ground_floors", "build_year", "building_type", "decoration_standard", "floor_count", "land_area", "location", "structure_type", "total_area"]
add("document_confidence", "document_facts", f"""
SELECT doc_id, array_to_string(list_sort(list_concat([x FOR x IN [{', '.join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in [*_known, 'under_ground_floors'])}] IF x IS NOT NULL],
  ['total_cost'], CASE WHEN total_area > 0 THEN ['unit_price'] ELSE [] END, CASE WHEN contains(from_table, 'project_name') THEN ['project_name'] ELSE [] END)), ',') AS known,
  {rnd(_complete, 4)} AS completeness FROM document_facts""")
add("document_context", "document_facts", f"""
SELECT doc_id, concat_ws(chr(10), '文件: ' || filename, '格式: .pdf | 页数: ' || (n_chars // 2000 + 1) || ' | 扫描件: ' || CASE WHEN n_chars < 50 THEN '是' ELSE '否' END,
  '项目名称: ' || project_name, '建筑类型: ' || building_type, '结构类型: ' || structure_type,
  '总建筑面积: ' || nullif(CAST(round(CAST(total_area AS DECIMAL(24,4)), 0) AS BIGINT), 0), '楼层数: ' || floor_count,
  CASE WHEN above_ground_floors IS NOT NULL OR under_ground_floors IS NOT NULL THEN '   (地上 ' || coalesce(CAST(above_ground_floors AS VARCHAR), '?') || ' 层, 地下 ' || coalesce(CAST(under_ground_floors AS VARCHAR), '?') || ' 层)' END,
  '所在地区: ' || location, '建造年份: ' || build_year, '装修标准: ' || decoration_standard, '项目总造价: ' || CAST(total_cost AS DECIMAL(24,2)),
  '单方造价: ' || CAST({_unit} AS DECIMAL(24,2)), '特征完整度: ' || CAST({_complete} * 100 AS INTEGER) || '%',
  CASE WHEN full_text <> '' THEN '文档摘要: ' || replace(full_text, chr(10), ' ') END, CASE WHEN doc_id % 10 = 0 THEN '解析警告: 出错: 第1页' END) AS context
FROM document_facts JOIN parsed_documents USING (doc_id)""")
add("cost_value_parse", "parsed_documents", f"""
SELECT doc_id, cost AS total_cost, CASE WHEN area > 0 THEN {rnd('cost / area', 2)} END AS unit_price FROM (
  SELECT doc_id, {_area} AS area, CASE doc_id % 5 WHEN 0 THEN 1234.5::DOUBLE * 1e4 WHEN 1 THEN 2.5::DOUBLE * 1e8 WHEN 2 THEN 987654.0::DOUBLE WHEN 3 THEN 12000.0::DOUBLE ELSE 88000.0::DOUBLE END AS cost
  FROM parsed_documents)""")
def _ocr() -> str:
    """Clean-up in the order of the rules. Where a rule looks behind a match, the character is captured and put back; such rules run
    twice, as one run can't use a character for two matches. Line breaks before list entries are hidden as chr(1) meanwhile."""
    t = "full_text"

    def sub(pattern: str, to: str, times: int = 1) -> None:
        nonlocal t
        for _ in range(times):
            t = f"regexp_replace({t}, '{pattern}', {to}, 'g')"

    sub(r"[^\S\n]+(\n|\z)", r"'\1'")
    sub(r"\A\n+", "''")
    sub(r"\n+\z", "chr(10)")
    sub(r"\n{3,}", "chr(10) || chr(10)")
    sub(r"\n([\d一二三四五六七八九十]+[、.．]|【)", r"chr(1) || '\1'", 2)
    sub(r"([^\n\x01。；：！？、）》」』,;:!?)>.．])\n([^\n\x01])", r"'\1\2'", 2)
    t = f"replace({t}, chr(1), chr(10))"
    sub(r"(\d)l(\d)", r"'\11\2'", 2)
    sub(r"(\d)O(\d)", r"'\10\2'", 2)
    sub("。。+", "'。'")
    sub("，，+", "'，'")
    sub("  +", "' '")
    sub(r",\n(\d)", r"',\1'")
    sub(r"([\d ])(?:rn2|[rnm]2)([^0-9]|\z)", r"'\1㎡\2'", 2)
    return t


add("ocr_cleanup", "parsed_documents", f"SELECT doc_id, {_ocr()} AS text FROM parsed_documents")
add("scanned_pages", "", f"""
SELECT source, count(*) AS pages, count(*) FILTER (WHERE n < 50) AS scanned_pages, count(*) FILTER (WHERE n >= 50 AND n < 200) AS partial_pages,
  count(*) FILTER (WHERE n < 50) / CAST(count(*) AS DOUBLE) > 0.5 AS is_scanned, {rnd(total('nullif(c, 0)') + ' / count(nullif(c, 0))', 2)} AS avg_confidence,
  coalesce({total('nullif(c, 0)')} / count(nullif(c, 0)) < 60, false) AS low_confidence
FROM (SELECT source, length(trim(text, E' \t\n\r')) AS n, CAST(doc_id * 37 % 101 AS DOUBLE) AS c FROM documents) GROUP BY 1""")
_w = {k: has("text", v) for k, v in C.INTENT_WORDS.items()}
_zone = has("text", C.ZONE_WORDS)
_simple = ["check_data", "search_data", "knowledge_query", "predict", "train", "explain_term", "list_models", "find_similar", "cost_breakdown", "greeting", "thanks", "help"]
_intent = "CASE " + " ".join(f"WHEN {_w[k]} THEN '{k}'" for k in _simple) + f"""
 WHEN regexp_matches(text, {lit(C.AREA_MENTION)}) AND {_w['building_action']} THEN 'predict'
 WHEN {_zone} OR ({_w['region_question']} AND {has('text', C.TALK_CITIES)}) THEN 'region_refine'
 WHEN {_w['feedback']} THEN 'feedback' WHEN {_w['supplement']} THEN 'supplement' WHEN {_w['repredict']} THEN 'repredict'
 WHEN {_w['compare']} OR regexp_matches(text, {lit(C.COMPARE_PATTERN)}) THEN 'compare' WHEN {_w['change']} THEN 'repredict'
 WHEN regexp_matches(text, {lit(C.CHANGE_PATTERN)}) AND length(text) < 30 THEN 'repredict' WHEN {_w['data_query']} THEN 'data_query'
 WHEN {_w['data_word']} AND {_w['question_word']} THEN 'data_query' WHEN length(text) < 20 AND {_w['short_question']} AND {has('text', C.NEAR_CITIES)} THEN 'region_refine' ELSE 'general' END"""
add("intent_labels", "messages", f"SELECT {_intent} AS intent, count(*) AS n FROM messages GROUP BY 1")
_num = f"try_cast({rx(C.REQUEST_AREA_PATTERN, 1, 'text')} AS DOUBLE)"
add("request_params", "messages", f"""
SELECT session_id, turn, coalesce(CASE WHEN contains(regexp_extract(text, {lit(C.REQUEST_AREA_PATTERN)}, 0), '万') THEN {_num} * 10000 ELSE {_num} END, 10000.0::DOUBLE) AS total_area,
  {words('text', C.TYPE_SYNONYMS, lit('住宅'))} AS project_type, {first('text', C.REQUEST_LOCATIONS, lit('华东'))} AS location,
  {words('text', [(v, [w]) for v, w in C.REQUEST_STRUCTURES], lit('框架结构'))} AS structure_type, coalesce(try_cast({rx('(\\d+)\\s*[层楼]', 1, 'text')} AS INTEGER), 6) AS floors,
  {words('text', [(v, [w]) for v, w in C.REQUEST_DECORATIONS], lit('普通装修'))} AS decoration_level, 2026 AS build_year, '对话生成项目' AS project_name FROM messages""")
add("refined_regions", "messages", f"""
SELECT coalesce(coalesce({first('text', C.TALK_CITIES)}, '') || {first('text', C.ZONE_WORDS)}, {rx('([\\x{4e00}-\\x{9fff}]{2,4}(?:高新区|新区|开发区|科技园|工业园|经开区))', 1, 'text')},
  {first('text', C.TALK_CITIES)}) AS region, {first('text', C.TERMS)} AS term, count(*) AS n FROM messages GROUP BY 1, 2""")
add("session_summary", "messages", "SELECT session_id, arg_min(text, turn) AS title, count(*) AS message_count FROM messages GROUP BY 1")
add("session_retention", "messages", """
SELECT session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages
  WHERE session_id IN (SELECT session_id FROM messages GROUP BY 1 ORDER BY min(seq) DESC, session_id DESC LIMIT 200)) WHERE r <= 200""")
add("last_messages", "messages", "SELECT session_id, turn FROM messages ORDER BY seq DESC LIMIT 50")
add("project_retention", "project_meta", "SELECT project_id, name FROM project_meta ORDER BY seq DESC LIMIT 500")

# -- models ------------------------------------------------------------------

add("residual_stats", "", f"""
SELECT count(r) AS n, {rnd('CAST(sum(CAST(r AS DECIMAL(18,6))) AS DOUBLE) / count(r)', 4)} AS residual_mean, {rnd('stddev_pop(r)', 4)} AS residual_std,
  {rnd('quantile_cont(r, 0.1)', 4)} AS residual_p10, {rnd('quantile_cont(r, 0.9)', 4)} AS residual_p90 FROM (SELECT l_extendedprice - l_quantity * 1500 AS r FROM lineitem)""")
add("fold_metrics", "", f"""
SELECT 0 AS repeat, CAST(l_orderkey % 5 AS INTEGER) AS fold, count(*) AS n, {rnd('1 - sum(e * e) / (var_pop(l_extendedprice) * count(*))', 6)} AS r2, {rnd('avg(abs(e))', 4)} AS mae,
  {rnd('avg(abs(e) / nullif(abs(l_extendedprice), 0))', 6)} AS mape
FROM (SELECT *, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY 2""")
add("residual_stats_by_group", "", f"""
SELECT l_returnflag, fold, count(r) AS n, {rnd('CAST(sum(CAST(r AS DECIMAL(18,6))) AS DOUBLE) / count(r)', 4)} AS residual_mean, {rnd('stddev_pop(r)', 4)} AS residual_std,
  {rnd('quantile_cont(r, 0.1)', 4)} AS residual_p10, {rnd('quantile_cont(r, 0.9)', 4)} AS residual_p90
FROM (SELECT l_returnflag, nullif(l_linenumber % 4, 0) AS fold, l_extendedprice - l_quantity * 1500 AS r FROM lineitem) GROUP BY 1, 2""")
add("exact_folds", "", " UNION ALL ".join(f"""
SELECT o_orderkey, CAST({r} AS INTEGER) AS repeat, CAST((row_number() OVER (ORDER BY CAST('0x' || substr(md5('{42 + r}|' || o_orderkey), 1, 15) AS BIGINT)) - 1) % 5 AS INTEGER) AS fold FROM orders""" for r in (0, 1)))
add("accuracy_gate", "predictions", "SELECT model_id, accuracy >= 30 AS is_trained, accuracy >= 50 AS in_interval, count(*) AS n FROM predictions GROUP BY 1, 2, 3")
add("model_status", "predictions", f"""
SELECT model_id, layer, target, listed_accuracy, train_rows, train_rows IS NOT NULL AS fitted FROM {values(C.MODEL_REGISTRY)} t(model_id, layer, target, listed_accuracy)
LEFT JOIN (SELECT model_id, count(*) AS train_rows FROM predictions GROUP BY 1) USING (model_id)""")
_sorted_items = sorted(w for _, w in S.ITEMS)
add("fp_patterns", "boq_items", f"""
WITH w AS (SELECT unnest([{', '.join(lit(x) for x in _sorted_items)}]) AS item, unnest(range({len(_sorted_items)})) AS i),
 b AS (SELECT project_id, CAST(sum(1 << i) AS BIGINT) AS mask FROM (SELECT DISTINCT project_id, i FROM boq_items JOIN w ON item = split_part(item_name, ' ', 1)) GROUP BY 1),
 m AS (SELECT unnest(range(1, {1 << len(_sorted_items)})) AS m), c AS (SELECT m, count(*) AS freq FROM m JOIN b ON mask & m = m GROUP BY 1)
SELECT (SELECT string_agg(item, ',' ORDER BY i) FROM w WHERE (c.m >> i) & 1 = 1) AS items, freq, {rnd('freq / CAST((SELECT count(*) FROM b) AS DOUBLE)', 6)} AS support
FROM c WHERE freq >= ceil(0.1 * (SELECT count(*) FROM b))""")
_columns = ("item_name", "unit", "boq_code", "division", "trade")
add("frequent_categories", "boq_items", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, (SELECT count(*) FROM boq_items) AS rows FROM boq_items WHERE {c} IS NOT NULL "
    f"GROUP BY {c} HAVING count(*) >= 0.005::DOUBLE * (SELECT count(*) FROM boq_items)" for c in _columns))
_sum = {n: f"sum({n}) OVER (PARTITION BY model, feature)" for n in ("w", "s0", "s1")}
_left = {n: f"CASE WHEN feature = 0 THEN {n} ELSE sum({n}) OVER (PARTITION BY model, feature ORDER BY bin) END" for n in ("w", "s0", "s1")}
add("split_search", "", f"""
WITH i AS (SELECT l_linenumber AS model, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS f0, CAST(l_quantity AS INT) AS f1,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS r0, CAST(round(l_tax * 100) AS BIGINT) AS r1 FROM lineitem),
  h AS (SELECT model, 0 AS feature, f0 AS bin, CAST(count(*) AS DOUBLE) AS w, CAST(sum(r0) AS DOUBLE) AS s0, CAST(sum(r1) AS DOUBLE) AS s1 FROM i GROUP BY ALL
    UNION ALL SELECT model, 1, f1, count(*), CAST(sum(r0) AS DOUBLE), CAST(sum(r1) AS DOUBLE) FROM i GROUP BY ALL),
  c AS (SELECT model, feature, bin, {', '.join(f'{_sum[n]} AS t_{n}, {_left[n]} AS l_{n}' for n in ('w', 's0', 's1'))} FROM h),
  g AS (SELECT *, (l_s0 ** 2 + l_s1 ** 2) / l_w + ((t_s0 - l_s0) ** 2 + (t_s1 - l_s1) ** 2) / (t_w - l_w) - (t_s0 ** 2 + t_s1 ** 2) / t_w AS gain
    FROM c WHERE l_w >= 5 AND t_w - l_w >= 5)
SELECT model, feature, bin, feature = 0 AS equal, {', '.join(rnd(f'l_s{k} / l_w', 4) + f' AS left_{k}, ' + rnd(f'(t_s{k} - l_s{k}) / (t_w - l_w)', 4) + f' AS right_{k}, ' + rnd(f't_s{k} / t_w', 4) + f' AS mean_{k}' for k in (0, 1))}
FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, feature, bin) = 1""")
