"""Typed tables with their keys and defaults."""

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()), "tables": T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))),
    "properties": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """Schema from 'name kind, name kind'; works before a session exists."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


PROJECT_META = _schema(
    "project_id string, name string, building_type string, structure_type string, location string, build_year int,"
    "total_area double, total_cost double, unit_price double, source_file string, source_sheets int,"
    "extraction_date date, extraction_version string, data_quality_grade string, metadata_completeness double,"
    "outlier_count int, crosscheck_diff_pct double, training_weight double, confidence double, field_source string,"
    "building_count int, buildings_json string, max_floor int, min_floor int, mixed_types boolean,"
    "above_ground_floors int, under_ground_floors int, decoration_standard string, foundation_type string"
)
UNIT_PROJECT_META = _schema(
    "unit_id string, project_id string, unit_name string, trade string, floor_count int, area double,"
    "cost_summary double, division string"
)
COST_BREAKDOWN = _schema(
    "project_id string, project_name string, building_trade_cost double, decoration_trade_cost double,"
    "installation_trade_cost double, foundation_division_cost double, main_structure_cost double,"
    "roofing_cost double, exterior_wall_cost double, part_item_cost double, measure_cost double,"
    "regulation_cost double, tax_cost double, labor_cost double, labor_source string, foundation_type string,"
    "concrete_grade string, steel_grade string, extraction_date date, source_file string,"
    "e2_count int, f11_count int, e3_count int, h13_count int, extraction_errors string"
)
BOQ_ITEMS = _schema(
    "item_id string, project_id string, unit_project string, boq_code string, item_name string, spec_text string,"
    "division string, trade string, unit string, quantity double, comp_unit_price double, total_price double,"
    "labor_fee double, is_active int, flag_outlier int, flag_code_error int, price_base_year int,"
    "price_adjust_factor double, comp_unit_price_adj double, total_price_adj double"
)
PRICE_INDEX = _schema("year int, labor_index double, material_index double, adjustment_factor double")
PREDICTION_UPLOADS = _schema(
    "task_id string, filename string, file_format string, uploaded_at timestamp, extracted_features string,"
    "expires_at timestamp"
)
SHEET_ROWS = _schema(
    "project_id string, source_file string, sheet_name string, sheet_order int, row_num bigint, cells strings"
)
PARSED_DOCUMENT = _schema(
    "filename string, file_format string, full_text string, tables tables,"
    "metadata properties, pages int, is_scanned boolean, warnings strings"
)

TABLES = {
    "project_meta": (PROJECT_META, "project_id"),
    "unit_project_meta": (UNIT_PROJECT_META, "unit_id"),
    "project_cost_breakdown": (COST_BREAKDOWN, "project_id"),
    "boq_items": (BOQ_ITEMS, "item_id"),
    "price_index": (PRICE_INDEX, "year"),
    "prediction_uploads": (PREDICTION_UPLOADS, "task_id"),
}
DEFAULTS = {
    "project_meta": {"data_quality_grade": "C", "outlier_count": 0, "confidence": 0.5, "field_source": "extracted",
                     "building_count": 1, "mixed_types": False},
    "boq_items": {"is_active": 1, "flag_outlier": 0, "flag_code_error": 0, "price_base_year": 2020,
                  "price_adjust_factor": 1.0},
}
REFERENCES = [("boq_items", "project_id", "project_meta"), ("unit_project_meta", "project_id", "project_meta"),
              ("project_cost_breakdown", "project_id", "project_meta")]
