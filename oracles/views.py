"""The stand-in domain tables as plain SQL, independent of the Spark code (only the word lists are shared)."""

from takeoff.plans import standins as S


def lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def pick(values: list[str], index: str) -> str:
    return "[" + ",".join(lit(v) for v in values) + f"][CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def case(col: str, pairs: list[tuple], default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in pairs) + f" ELSE {default} END"


def words(col: str, rules: list[tuple[str, list[str]]], default="NULL") -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({col}, {lit(w)})" for w in ws) + f" THEN {lit(v)}" for v, ws in rules
    ) + f" ELSE {default} END"


def first(col: str, ws: list[str], default="NULL") -> str:
    return words(col, [(w, [w]) for w in ws], default)


def has(col: str, ws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in ws) + ")"


def patterns(col: str, rules: list[tuple[str, object]], default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {lit(p)}) THEN {lit(v)}" for p, v in rules) + f" ELSE {default} END"


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,{n + 4})), {n}) AS DOUBLE)"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


def total(x: str, where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum({dec(x)}){f} AS DOUBLE)"


def total0(x: str, where: str | None = None) -> str:
    return f"coalesce({total(x, where)}, 0.0)"


VIEWS = {}

VIEWS["project_meta"] = f"""
SELECT o_orderkey AS project_id, o_orderkey AS seq, {pick(S.NAME_WORDS, 'o_orderkey')} || ' ' || o_orderkey AS name,
  {pick(S.TYPES, "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1")} AS building_type,
  {case('o_orderstatus', S.STRUCTURES)} AS structure_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN year(o_orderdate) + 25
       ELSE year(o_orderdate) + 20 END AS build_year,
  o_totalprice * 100 AS total_cost, CAST(o_orderkey % 60 AS INTEGER) AS above_ground_floors,
  nullif({pick(S.DECORATIONS, 'o_orderkey')}, '') AS decoration_standard,
  nullif({pick(S.FOUNDATIONS, 'o_orderkey')}, '') AS foundation_type,
  nullif({pick(S.GRADES, 'o_custkey')}, '') AS data_quality_grade,
  CAST(o_orderdate AS DATE) AS extraction_date, {pick(S.PLACES, 'c_nationkey')} AS location,
  q * 200 AS total_area, o_totalprice * 100 / (q * 200) AS unit_price
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""

VIEWS["boq_items"] = f"""
SELECT l_orderkey AS project_id, l_suppkey AS supplier,
  {pick(S.CODE_HEADS, 'l_partkey')} || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS boq_code,
  {case("split_part(p_name, ' ', 2)", S.ITEMS)} || ' ' || p_name AS item_name,
  {case('p_type', S.DIVISIONS)} AS division, {pick(S.TRADES, "CAST(split_part(p_brand, '#', 2) AS INTEGER)")} AS trade,
  CASE WHEN l_linestatus = 'O' THEN 'm3' ELSE 't' END AS unit, l_quantity AS quantity,
  l_extendedprice / l_quantity AS comp_unit_price, l_extendedprice AS total_price, l_extendedprice * l_tax AS labor_fee,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS is_active
FROM lineitem JOIN part ON p_partkey = l_partkey"""


def _sheet_rows() -> str:
    ext = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
    whole = lambda x: f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"
    bill, title = "l_suppkey % 10 <= 2", "(l_suppkey % 10 <= 2 AND l_linenumber = 1 AND l_partkey % 3 = 0)"
    unit_no = "((l_suppkey // 10) % 4)"
    full = f"{pick(S.CODE_HEADS, 'l_partkey')} || lpad(CAST(l_partkey AS VARCHAR), 8, '0')"
    code = (f"CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 2 = 0 AND starts_with({full}, '0') "
            f"THEN substr({full}, 2) ELSE {full} END")
    header, sub = "l_partkey % 5 = 0", "l_partkey % 5 = 1"
    line = "CAST(l_linenumber AS VARCHAR)"

    def cell(by_kind: dict[int, str], bill_item: str = "''", bill_header: str = "''", bill_sub: str = "''", bill_title: str = "''") -> str:
        rest = " ".join(f"WHEN l_suppkey % 10 = {k} THEN {v}" for k, v in by_kind.items())
        return (f"CASE WHEN {title} THEN {bill_title} WHEN {bill} AND {header} THEN {bill_header} "
                f"WHEN {bill} AND {sub} THEN {bill_sub} WHEN {bill} THEN {bill_item} {rest} ELSE '' END")

    c = [
        cell({3: f"CASE WHEN l_partkey % 3 = 0 THEN '合 计' ELSE {line} END", 6: "CASE WHEN l_partkey % 5 = 0 THEN '合计' ELSE '1' END"},
             line, bill_title=pick(S.TITLES, "l_suppkey")),
        cell({3: "'名称'", 4: pick(S.E2_LABELS, "l_partkey"), 5: pick(S.E3_LABELS, "l_partkey"), 6: pick(S.MEASURES, "l_partkey"),
              7: pick(S.PROVISIONS, "l_partkey"), 8: pick(S.FEES, "l_partkey"), 9: pick(S.MATERIAL_ROWS, "l_partkey")}, code),
        cell({3: f"CASE WHEN l_partkey % 2 = 0 THEN {ext} ELSE '-' END", 4: ext, 5: ext, 7: ext},
             pick(S.BILL_ITEMS, "l_partkey"), pick(S.HEADERS, "l_partkey // 5"), "'小计'"),
        cell({9: whole("l_quantity")}, "'规格' || (l_partkey % 9)"),
        cell({3: whole("l_extendedprice / 10")}, "l_linestatus"),
        cell({3: whole("l_extendedprice / 20"), 6: ext, 8: ext}, whole("l_quantity")),
        cell({}, whole("l_extendedprice / l_quantity")), cell({}, ext, bill_sub=ext), cell({}, whole("l_extendedprice * l_tax")),
    ]
    size = f"CASE WHEN {title} THEN 1 WHEN {bill} THEN 9 WHEN l_suppkey % 10 IN (3, 6, 8) THEN 6 WHEN l_suppkey % 10 = 9 THEN 4 ELSE 3 END"
    name = (f"CASE WHEN {bill} THEN '表-08 F.1.1 ' || {pick(S.UNITS, unit_no)} WHEN l_suppkey % 10 = 3 THEN '表-02 汇总' "
            f"WHEN l_suppkey % 10 = 4 THEN '表-03 E.2 ' || ({unit_no} % 2) WHEN l_suppkey % 10 = 5 THEN '表-04 E.3 ' || {unit_no} "
            f"WHEN l_suppkey % 10 = 6 THEN '表-11 措施' WHEN l_suppkey % 10 = 7 THEN CASE WHEN {unit_no} = 3 THEN '表-12-1 子表' ELSE '表-12 其他' END "
            f"WHEN l_suppkey % 10 = 8 THEN '表-13 H ' || ({unit_no} % 2) ELSE '表-21 材料' END")
    order = (f"CASE WHEN {bill} THEN {unit_no} WHEN l_suppkey % 10 = 3 THEN 10 WHEN l_suppkey % 10 = 4 THEN 20 + {unit_no} % 2 "
             f"WHEN l_suppkey % 10 = 5 THEN 30 + {unit_no} WHEN l_suppkey % 10 = 6 THEN 40 WHEN l_suppkey % 10 = 7 THEN CASE WHEN {unit_no} = 3 THEN 51 ELSE 50 END "
             f"WHEN l_suppkey % 10 = 8 THEN 60 + {unit_no} % 2 ELSE 70 END")
    num = f"CASE WHEN {title} THEN 2 WHEN {bill} THEN 8 + l_linenumber * 1000000 + l_partkey % 1000000 ELSE l_linenumber + 4 END"
    cells = ", ".join(f"{x} AS c{i}" for i, x in enumerate(c))
    n = lambda i: f"coalesce(try_cast(c{i} AS DOUBLE), 0) AS n{i}"
    return (f"SELECT *, {n(2)}, {n(3)}, {n(4)}, {n(5)}, {n(6)}, {n(7)}, {n(8)} FROM (SELECT l_orderkey AS project_id, {name} AS sheet_name, "
            f"{order} AS sheet_order, {num} AS row_num, {size} AS width, {cells} FROM lineitem)")


VIEWS["sheet_rows"] = _sheet_rows()

VIEWS["requests"] = f"""
SELECT c_custkey AS request_id, c_name AS project_name, {case('c_mktsegment', S.SEGMENT_TYPES)} AS project_type,
  {pick(S.REQUEST_STRUCTURES, 'c_custkey')} AS structure_type,
  CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * 15, 2) AS DOUBLE) AS total_area, CAST(c_custkey % 65 AS INTEGER) AS floors,
  {pick(S.PLACES, 'c_nationkey')} AS location, CAST(1890 + c_custkey % 230 AS INTEGER) AS build_year,
  {pick(S.DECORATIONS, 'c_custkey')} AS decoration_level, {pick(S.STAGES, 'c_custkey')} AS stage,
  {pick(S.FOUNDATIONS, 'c_custkey')} AS foundation_type, {pick(S.SOILS, 'c_custkey')} AS soil_condition,
  {pick(S.SEISMIC_GRADES, 'c_custkey')} AS seismic_grade, {pick(S.HVACS, 'c_custkey')} AS hvac,
  {pick(S.WALLS, 'c_custkey')} AS exterior_wall
FROM customer"""

VIEWS["buildings"] = """
SELECT request_id, floors, total_area / 2 AS area, '住宅' AS type FROM requests WHERE request_id % 3 = 0
UNION ALL SELECT request_id, request_id % 20 + 1, total_area / 4, '商业' FROM requests WHERE request_id % 3 = 0
UNION ALL SELECT request_id, request_id % 7 + 1, total_area / 4, '住宅' FROM requests WHERE request_id % 3 = 0
UNION ALL SELECT request_id, floors, total_area, '住宅' FROM requests WHERE request_id % 3 = 1"""

VIEWS["predictions"] = """
SELECT o_orderkey AS request_id, model_id,
  CASE WHEN (o_orderkey + i) % 5 = 0 THEN 0.0 ELSE o_totalprice / 100 * (1 + CAST(0.25 AS DOUBLE) * i) END AS value,
  CAST((o_orderkey * 7 + i * 13) % 101 AS DOUBLE) AS accuracy, CAST((o_orderkey * 7 + i * 13) % 101 AS DOUBLE) / 100 AS weight
FROM orders, (VALUES ('total_pso_svr', 0), ('unit_gbt', 1), ('section_xgb', 2), ('subsection_xgb', 3), ('item_xgb', 4),
  ('indicator_rf', 5), ('boq_xgb', 6), ('boq_lr_v2', 7)) m(model_id, i)"""

VIEWS["uploads"] = f"""
SELECT lpad(CAST(event_id AS VARCHAR), 8, '0') AS task_id, lower({pick(S.EXTENSIONS, 'event_id')}) AS file_format,
  ts + INTERVAL 24 HOUR AS expires_at, event_type, value FROM events"""

VIEWS["parsed_documents"] = f"""
SELECT doc_id, n_chars, source, 'doc_' || doc_id || '.pdf' AS filename,
  concat_ws(chr(10), text, CASE WHEN doc_id % 2 = 0 THEN '项目名称：' || {pick(S.NAME_WORDS, 'doc_id')} || '二期' END,
    CASE doc_id % 4 WHEN 0 THEN '总建筑面积约' || n_chars || '平方米' WHEN 1 THEN '建筑面积' || n_chars || '.5㎡' WHEN 2 THEN '占地面积' || n_chars ELSE '' END,
    CASE doc_id % 3 WHEN 0 THEN '地上' || (doc_id % 40 + 1) || '层，地下' || (doc_id % 4 + 1) || '层' WHEN 1 THEN '共' || (doc_id % 33 + 1) || '楼' ELSE '' END,
    {pick(S.DOC_STRUCTURES, 'doc_id')}, {pick(S.DOC_DECORATIONS, 'doc_id')}, {pick(S.DOC_PLACES, 'doc_id')},
    CASE WHEN doc_id % 3 = 0 THEN '2018年' END) AS full_text
FROM documents"""

VIEWS["messages"] = f"""
SELECT conv_id AS session_id, turn, role, {pick(S.PHRASES, 'conv_id * 7 + turn')} || text AS text, conv_id * 1000 + turn AS seq
FROM conversations"""

NEEDS = {"buildings": ["requests"]}


def with_views(names: str, body: str) -> str:
    """Prefix a query with the stand-in views it uses; body may itself begin with more CTEs after 'WITH'."""
    ordered = []
    for n in names.split():
        for d in [*NEEDS.get(n, []), n]:
            if d not in ordered:
                ordered.append(d)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = body.strip()
    if ctes and body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}" if ctes else body
