"""Registered queries: every operator over the whole stand-in tables."""

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import names, rules, scalars
from takeoff.functions.numbers import money, round_half, share
from takeoff.operators import (block_trees, boosting, categories, conversations, estimate, matching, ml, ordered, prices, quality, rollups,
                               sheets, text, training_set)
from takeoff.plans import standins as S
from takeoff.session import checkpoint_folder, configure
from takeoff.sources import batches, files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _string_id(df: DataFrame) -> DataFrame:
    return df.withColumn("project_id", F.col("project_id").cast("string"))


# -- roll-ups and reports ----------------------------------------------------

@query
def boq_trade_rollup(spark, sf):
    return rollups.trade_rollup(S.boq_items(spark, sf))


@query
def global_ratios(spark, sf):
    return rollups.global_ratios(rollups.trade_rollup(S.boq_items(spark, sf))).select(
        *[round_half(F.col(c), 6).alias(c) for c in ("arch_ratio", "deco_ratio", "inst_ratio")])


@query
def item_training_rows(spark, sf):
    rows = rollups.item_training_rows(S.boq_items(spark, sf))
    return rows.groupBy("division", "unit", "building_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(F.col("quantity"))).cast("double").alias("quantity"))


@query
def division_trade_counts(spark, sf):
    return rollups.division_trade_counts(S.boq_items(spark, sf))


@query
def joined_sums(spark, sf):
    items = S.boq_items(spark, sf)
    done = prices.normalize_prices(items, S.project_meta(spark, sf, False, False), prices.price_index(spark))
    return rollups.joined_sums(done, S.project_meta(spark, sf, False, False), "building_type")


@query
def type_price_band(spark, sf):
    return rollups.type_price_band(S.project_meta(spark, sf, place=False))


@query
def section_frequency(spark, sf):
    rows = sheets.bill_rows(S.sheet_rows(spark, sf)).select(sheets.cell(2).alias("section"))
    return rollups.frequency(rows.filter("section like '%工程%'"), "section")


@query
def sheet_labor(spark, sf):
    rows = sheets.bill_rows(S.sheet_rows(spark, sf)).select("project_id", "sheet_name", sheets.number(8).alias("labor"))
    return rollups.sheet_labor(rows, by_sheet=True)


@query
def steel_unit(spark, sf):
    items = S.boq_items(spark, sf)
    return rollups.steel_scale(items, F.when(F.col("item_name").contains("钢"), F.col("quantity") / F.col("total_price") * 1000))


@query
def value_counts(spark, sf):
    return quality.value_counts(S.project_meta(spark, sf, False, False), F.col("building_type"), "building_type")


@query
def training_stats(spark, sf):
    return quality.training_statistics(S.project_meta(spark, sf, place=False), "unit_price", "total_area")


@query
def training_by_region(spark, sf):
    return quality.value_counts(S.project_meta(spark, sf, area=False), names.region(F.col("location")), "region")


# -- prices ------------------------------------------------------------------

@query
def price_normalize(spark, sf):
    done = prices.normalize_prices(S.boq_items(spark, sf), S.project_meta(spark, sf, False, False), prices.price_index(spark))
    return done.select("project_id", "boq_code", "supplier", "quantity", "total_price", "price_adjust_factor", "price_base_year",
                       "total_price_adj", round_half(F.col("comp_unit_price_adj"), 4).alias("comp_unit_price_adj"))


@query
def price_report(spark, sf):
    done = prices.normalize_prices(S.boq_items(spark, sf), S.project_meta(spark, sf, False, False), prices.price_index(spark))
    return prices.price_report(done)


@query
def price_run_stats(spark, sf):
    return prices.run_stats(S.boq_items(spark, sf), S.project_meta(spark, sf, False, False), prices.price_index(spark))


# -- quality -----------------------------------------------------------------

@query
def quality_gate(spark, sf):
    p = S.project_meta(spark, sf, place=False)
    kept = quality.quality_gate(p, F.col("unit_price"), F.col("total_area"), F.col("total_cost"))
    return kept.select("project_id", "total_cost", "total_area")


@query
def drop_reasons(spark, sf):
    p = S.project_meta(spark, sf, place=False)
    return quality.drop_reasons(p, F.col("unit_price"), F.col("total_area"), F.col("total_cost"))


@query
def import_projects(spark, sf):
    """Read, clean and load: gate, grade and weight flat rows, write kept and dropped ones apart, report what was written."""
    rows = S.table(spark, sf, "lineitem")
    flags = quality.gate_flags(F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity") - 1, F.col("l_extendedprice"))
    bad = flags["bad_unit_price"] | flags["bad_area"] | flags["bad_cost"]
    graded = rows.withColumns({"source_type": F.col("l_returnflag"), "data_confidence": F.when(
        F.col("l_returnflag") == "A", "high").when(F.col("l_linestatus") == "O", "medium").otherwise("low")})
    loaded = graded.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "source_type", "data_confidence",
                           quality.sample_weight(graded).alias("weight"), bad.alias("dropped"))
    folder = _fresh(spark, "import")
    loaded.write.partitionBy("dropped").parquet(folder)
    back = spark.read.schema(loaded.schema).parquet(folder)
    return back.groupBy("weight", "dropped").agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("l_extendedprice"))).cast("double").alias("total"))


@query
def history_round_trip(spark, sf):
    """Every order exported as JSON history and read back."""
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    folder = _fresh(spark, "history")
    files.write_history(orders, folder)
    return files.read_history(spark, folder, orders.schema)


@query
def flat_round_trip(spark, sf):
    """Every order, with a text that holds quotes, commas and line breaks, exported as a flat table and read back."""
    note = F.concat(F.lit('a "'), F.col("o_orderstatus"), F.lit('", b\n'), F.col("o_custkey").cast("string"))
    orders = S.table(spark, sf, "orders").select("o_orderkey", note.alias("note"), F.col("o_totalprice").cast("double").alias("o_totalprice"))
    folder = _fresh(spark, "flat")
    files.write_flat(orders, folder)
    return files.read_flat(spark, folder, orders.schema)


@query
def batch_with_failures(spark, sf):
    """Record files, every fifth of them cut off, read twice with one ledger; the second time there is nothing to read."""
    folder, ledger, out = _fresh(spark, "in"), _fresh(spark, "ledger"), _fresh(spark, "out")
    orders = S.table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 2000).alias("part"), F.struct("o_orderkey", "o_totalprice").alias("r"))
    text = F.to_json(F.collect_list("r"))
    cut = F.when(F.col("part") % 5 == 3, F.concat(F.col("text"), F.lit(","))).otherwise(F.col("text"))
    orders.groupBy("part").agg(text.alias("text")).select(cut.alias("value"), "part").write.partitionBy("part").text(folder)
    schema = orders.schema["r"].dataType
    runs = [batches.batch_outcome(batches.load_batch(spark, folder, ledger, out, schema)).select(F.lit(i).alias("run"), "*") for i in (1, 2)]
    total = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return runs[0].union(runs[1]).crossJoin(F.broadcast(total))


@query
def grade_weights(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    g = F.col("data_quality_grade")
    label = quality.grade_label(g)
    return p.groupBy(g.alias("grade"), label.alias("label"), quality.grade_of(g, label).alias("mapped"),
                     quality.grade_weight(g).alias("weight"), quality.label_confidence(label).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def null_profile(spark, sf):
    p = S.project_meta(spark, sf, place=False)
    return quality.null_profile(p, ["building_type", "build_year", "decoration_standard", "foundation_type", "total_area",
                                    "unit_price", "data_quality_grade"])


@query
def range_profile(spark, sf):
    return quality.range_profile(S.project_meta(spark, sf, place=False), ["total_cost", "total_area"])


@query
def fill_rate(spark, sf):
    return quality.fill_rate(S.boq_items(spark, sf), ["labor_fee", "quantity", "is_active"])


@query
def feature_variance(spark, sf):
    p = S.project_meta(spark, sf, place=False).withColumn("constant", F.lit(1))
    v = quality.feature_variance(p, ["total_area", "above_ground_floors", "constant"])
    return v.select("column_name", round_half(F.col("variance") / 1000, 3).alias("variance_k"), "is_constant")


@query
def sufficiency(spark, sf):
    p = S.project_meta(spark, sf).withColumn("region", names.region(F.col("location"))).withColumn("flat", F.lit(3.0))
    return quality.sufficiency(p, "building_type", "region", ["total_area", "above_ground_floors", "total_cost", "flat"],
                               F.col("data_quality_grade").isNull())


@query
def duplicate_audit(spark, sf):
    items = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("line"))
    return quality.duplicate_audit(items, ["project_id", "line"])


@query
def duplicate_summary(spark, sf):
    items = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("part"))
    return quality.duplicate_summary(items, ["project_id", "part"])


@query
def coexistence_audit(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.when(
        F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("buildings_json"))
    return quality.coexistence_audit(o, "customer", "buildings_json")


@query
def metadata_completeness(spark, sf):
    p = S.project_meta(spark, sf, place=False)
    s = quality.filled_share([F.col(c) for c in ("structure_type", "build_year", "decoration_standard", "foundation_type",
                                                 "total_area", "data_quality_grade")])
    return p.groupBy(round_half(s, 4).alias("completeness")).agg(F.count(F.lit(1)).alias("n"))


@query
def request_validation(spark, sf):
    r = quality.validate_requests(S.requests(spark, sf))
    return r.select("request_id", F.array_join("violations", ",").alias("violations"))


@query
def area_consistency(spark, sf):
    r = S.requests(spark, sf).filter("buildings is not null")
    ok = quality.area_consistent(F.col("buildings"), F.col("total_area") * (1 + (F.col("request_id") % 4) / 100))
    return r.select("request_id", ok.alias("consistent"))


@query
def parse_failures(spark, sf):
    d = S.parsed_documents(spark, sf)
    odd = F.col("doc_id") % 3 == 0
    failed = quality.parse_failed(F.when(odd, "").otherwise(F.col("full_text")), F.when(odd, F.array_except("tables", "tables")).otherwise(
        F.col("tables")), F.col("warnings"))
    return d.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"))


# -- tables ------------------------------------------------------------------

@query
def newest_projects(spark, sf):
    p = training_set.newest_projects(S.project_meta(spark, sf, False, False), 1000)
    return p.select("project_id", F.col("项目名称").alias("name"), F.col("建筑类型").alias("building_type"), "data_confidence")


@query
def active_items_of_projects(spark, sf):
    """Point and list look-ups: items of listed projects only."""
    wanted = S.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("project_id"))
    rows = tables.listed(S.boq_items(spark, sf).filter("is_active = 1"), wanted, "project_id")
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("total_price"))).cast("double").alias("total"))


@query
def upsert_latest(spark, sf):
    o = S.table(spark, sf, "orders")
    old = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v")).filter("seq % 2 = 0")
    new = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") * 2).alias("v")).filter("seq % 2 = 1")
    return tables.upsert(old, new, "key", F.desc("seq"))


@query
def insert_missing(spark, sf):
    have = S.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.lit("orders").alias("origin")).distinct()
    new = S.table(spark, sf, "events").select(F.year("ts").alias("year"), F.lit("events").alias("origin")).distinct()
    return tables.insert_missing(have, new.unionByName(have.withColumn("origin", F.lit("again"))), "year")


@query
def delete_keys(spark, sf):
    u = S.uploads(spark, sf)
    gone = tables.expired(u, F.lit(S.AS_OF).cast("timestamp"))
    return tables.not_in(u, gone, "task_id").select("task_id", "file_format")


@query
def expired_uploads(spark, sf):
    return tables.expired(S.uploads(spark, sf), F.lit(S.AS_OF).cast("timestamp"), 200).select("task_id", "expires_at")


@query
def orphan_files(spark, sf):
    u = S.uploads(spark, sf)
    stored = S.table(spark, sf, "events").select(
        F.concat(F.lpad((F.col("event_id") * 3 % 200003).cast("string"), 8, "0"), F.lit(".pdf")).alias("file"))
    return tables.orphan_files(stored.distinct(), F.col("file"), u).select("file", "task_id")


@query
def upload_json(spark, sf):
    u = S.uploads(spark, sf)
    return u.select("task_id", scalars.json_field(F.col("extracted_features"), "$.value", "double").alias("value"),
                    scalars.json_field(F.col("extracted_features"), "$.event_type", "string").alias("event_type"))


@query
def variant_kinds(spark, sf):
    e = S.table(spark, sf, "events")
    k = scalars.json_field(F.col("props"), "$.k", "int")
    return e.groupBy(scalars.json_kind(F.col("props"), "$.k").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).cast("bigint").alias("k_sum"))


@query
def stored_names(spark, sf):
    e = S.table(spark, sf, "events")
    name = F.concat(F.lit("../dir.x/file_"), F.col("event_id").cast("string"), S.pick(S.EXTENSIONS, F.col("event_id")))
    return e.select(names.stored_name(F.lpad(F.col("event_id").cast("string"), 8, "0"), name).alias("stored"))


@query
def file_admission(spark, sf):
    d = S.table(spark, sf, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), S.pick(S.EXTENSIONS, F.col("doc_id"))).alias("path"),
        (F.col("n_chars") * 10000).alias("size"))
    return files.admit_files(d, F.col("path"), F.col("size")).groupBy("extension", "rejected").agg(F.count(F.lit(1)).alias("n"))


@query
def snapshot_diff(spark, sf):
    before = tables.snapshot({t: S.table(spark, sf, t) for t in ("orders", "lineitem", "part", "events")})
    after = tables.snapshot({
        "orders": S.table(spark, sf, "orders").filter("o_orderstatus <> 'P'"), "lineitem": S.table(spark, sf, "lineitem"),
        "part": tables.add_columns(S.table(spark, sf, "part"), {"note": "string"}), "nation": S.table(spark, sf, "nation")})
    return tables.compare_snapshots(before, after)


@query
def orphan_check(spark, sf):
    parents = S.table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("project_id"))
    child = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), "l_linenumber")
    return tables.orphans(child, parents, "project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query
def missing_breakdown(spark, sf):
    return training_set.without_breakdown(
        S.project_meta(spark, sf, False, False), S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    ).select("project_id", "name")


@query
def conformed_projects(spark, sf):
    p = _string_id(S.project_meta(spark, sf, False, False)).withColumn("total_cost", F.col("total_cost").cast("string"))
    c = tables.conform_table(p, "project_meta")
    return c.select("project_id", "total_cost", "data_quality_grade", "confidence", "building_count", "mixed_types", "max_floor",
                    "field_source")


@query
def conditional_update(spark, sf):
    items = S.boq_items(spark, sf)
    done = tables.update_where(items, F.col("division").isNull(), {"division": F.lit("未分类"), "labor_fee": F.lit(0.0)})
    return done.groupBy("division").agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("labor_fee"))).cast("double").alias("labor"))


@query
def numbered_records(spark, sf):
    """Running record numbers P0001, P0002 ... in order of entry."""
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"))
    n = ordered.number_rows(o, "seq", "n", chunk=4096)
    return n.select("seq", F.format_string("P%04d", "n").alias("record_id"))


@query
def source_union(spark, sf):
    a = S.project_meta(spark, sf, False, False).filter("project_id % 2 = 0").select("name", "total_cost")
    b = S.project_meta(spark, sf, False, False).filter("project_id % 2 = 1").select("name", "build_year")
    both = files.read_sources({"real_projects": a, "sample_projects": b})
    return both.groupBy("source_type", F.col("_sample_weight").alias("weight")).agg(
        F.count(F.lit(1)).alias("n"), F.count("total_cost").alias("with_cost"), F.count("build_year").alias("with_year"))


# -- names and rules ---------------------------------------------------------

@query
def region_lookup(spark, sf):
    p = S.project_meta(spark, sf, area=False)
    return p.groupBy("location", names.region(F.col("location")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query
def longest_match_lookup(spark, sf):
    p = S.project_meta(spark, sf, area=False)
    return p.groupBy("location", names.seismic_level(F.col("location")).alias("seismic")).agg(F.count(F.lit(1)).alias("n"))


@query
def prefix_division(spark, sf):
    items = S.boq_items(spark, sf)
    return items.groupBy(names.division_of_prefix4(F.col("boq_code")).alias("division4"),
                         names.division_of_prefix2(F.col("division"), F.col("boq_code")).alias("division2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(F.col("total_price"))).cast("double").alias("total"))


@query
def building_type_rules(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    n = F.col("name")
    return p.groupBy(names.building_type(n, F.col("decoration_standard")).alias("inferred"), names.type_synonym(F.col("building_type")).alias("synonym")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def structure_rules(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    s = F.col("structure_type")
    return p.groupBy(s.alias("raw"), names.structure_type(F.concat(F.lit("现浇"), s)).alias("inferred"), names.repair_structure(s).alias("repaired"),
                     names.structure_of_name(s).alias("from_name")).agg(F.count(F.lit(1)).alias("n"))


@query
def trade_rules(spark, sf):
    items = S.boq_items(spark, sf)
    return items.groupBy(names.trade_of_item(F.col("item_name"), F.col("division")).alias("trade"), sheets.material_class(F.col("item_name")).alias("material")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def code_rules(spark, sf):
    items = S.boq_items(spark, sf)
    raw = F.when(F.col("supplier") % 2 == 0, F.concat(F.substring("boq_code", 2, 5), F.lit(" "), F.substring("boq_code", 7, 20))).otherwise(
        F.concat(F.substring("boq_code", 1, 6), F.lit("-"), F.substring("boq_code", 7, 20)))
    code = names.bill_code(raw)
    return items.select(code.alias("code"), names.is_bill_code(code).alias("valid")).groupBy("code", "valid").agg(F.count(F.lit(1)).alias("n"))


@query
def project_keys(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    raw = F.concat((F.col("project_id") % 50).cast("string"), F.lit(". "), F.col("name"), F.lit("（一期）"))
    title = names.folder_title(raw)
    return p.select("project_id", title.alias("title"), names.project_key(title).alias("key"), names.project_id(title).alias("hash_id"),
                    names.item_id(names.project_id(title), F.lit("010101001001"), F.col("building_type")).alias("item_id"))


@query
def decoration_levels(spark, sf):
    r = S.requests(spark, sf)
    return r.groupBy("decoration_level", names.decoration_level(F.col("decoration_level")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query
def floor_tiers(spark, sf):
    p = S.project_meta(spark, sf, False, False).withColumn("t", names.floor_tier(F.col("above_ground_floors")))
    return p.groupBy("t.tier", "t.price_low", "t.price_high").agg(F.count(F.lit(1)).alias("n"))


@query
def material_grades(spark, sf):
    items = S.boq_items(spark, sf)
    return items.groupBy(names.concrete_grade(F.col("comp_unit_price")).alias("concrete"), names.steel_grade(F.col("comp_unit_price")).alias("steel")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def money_labels(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    return p.select("project_id", names.money_label(F.when(F.col("project_id") % 3 == 0, F.col("total_cost") * 100).when(
        F.col("project_id") % 3 == 1, F.col("total_cost")).otherwise(F.col("total_cost") / 100000)).alias("label"))


@query
def floor_texts(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    k = F.col("project_id")
    told = (F.when(k % 4 == 0, F.concat(F.lit("1#楼"), (k % 30).cast("string"), F.lit("层，2#楼"), (k % 17).cast("string"), F.lit(" 层")))
            .when(k % 4 == 1, (k % 40).cast("string")).when(k % 4 == 2, "多层"))
    return p.select("project_id", names.floor_count(told).alias("floors"), names.address_region(F.concat(F.lit("四川省"), S.pick(S.PLACES, k))).alias("region"))


@query
def date_rules(spark, sf):
    o = S.table(spark, sf, "orders")
    d = F.col("o_orderdate")
    leap = F.concat(F.year(d).cast("string"), F.lit("-02-29"))
    return o.groupBy(scalars.iso_week(d).alias("iso_week"), scalars.week_start(d).alias("week_start"), scalars.is_date(leap).alias("leap")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def text_equality(spark, sf):
    p = S.table(spark, sf, "part")
    return p.groupBy(scalars.same_text(F.upper("p_type"), F.initcap("p_type")).alias("same")).agg(
        F.count(F.lit(1)).alias("n"), F.max("p_name").alias("last_name"), F.max(S.pick(S.PLACES, F.col("p_partkey"))).alias("last_place"),
        F.min(F.nullif(S.pick(S.PLACES, F.col("p_partkey")), F.lit(""))).alias("first_place"))


@query
def building_lists(spark, sf):
    """Floor lists of several buildings read into columns."""
    p = S.project_meta(spark, sf, False, False)
    k = F.col("project_id")
    told = F.concat((k % 30 + 1).cast("string"), F.lit(","), (k % 20 + 1).cast("string"), F.lit("，x,"), (k % 33).cast("string"))
    return p.withColumns(sheets.buildings_from_floors(told, (k % 5).cast("int"), F.col("building_type"))).select(
        "project_id", "max_floor", "min_floor", F.size(F.from_json("buildings_json", "array<struct<floors:int,type:string>>")).alias("buildings"))


@query
def fuzzy_name_match(spark, sf):
    """Projects named after customers' segments matched with folders of the suppliers; some fit none, some folders lack a main workbook."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = F.concat_ws("-", S.pick(S.NAME_WORDS, k), S.pick(["建设工程项目", "改造工程", "一期"], k), S.pick(["新都片区", "高新园区", "老城"], k / 3))
    name = F.when(k % 11 == 0, F.concat(F.lit("甲"), k.cast("string"))).when(k % 13 == 0, "独有名称之处").otherwise(name)
    folder = F.concat(s.cast("string"), F.lit("."), S.pick(S.NAME_WORDS, s), F.lit("（"), S.pick(["建设工程项目部", "改造工程", "二期"], s), F.lit("）"),
                      S.pick(["新都片区", "高新园区", "旧城区"], s / 5))
    file = F.when(s % 3 == 0, "项目信息表.xlsx").when(s % 7 == 0, "说明.docx").otherwise(F.concat(F.lit("f"), s.cast("string"), F.lit(".xlsx")))
    projects = S.table(spark, sf, "customer").select(k.alias("project_id"), name.alias("name"))
    listed = S.table(spark, sf, "supplier").select(folder.alias("folder"), file.alias("file"))
    return matching.match_folders(projects, listed).select("project_id", "folder", "file")


@query
def dictionary_lookup(spark, sf):
    """First and longest word of the benchmark's vocabulary in every document."""
    words = S.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    dictionary = words.withColumn("seq", F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("bigint") % 1000)
    docs = S.table(spark, sf, "documents").groupBy("doc_id").agg(F.max("text").alias("text"))
    return matching.dictionary_match(docs, "doc_id", "text", dictionary)


@query
def file_match(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    projects = S.table(spark, sf, "customer").select(
        k.alias("project_id"), F.concat(S.pick(S.NAME_WORDS, k), (k % 12).cast("string")).alias("name"),
        F.concat(F.lit("f"), (k * 3).cast("string"), F.lit(".xlsx")).alias("source_file"))
    listed = S.table(spark, sf, "supplier").select(
        F.concat(s.cast("string"), F.lit("."), S.pick(S.NAME_WORDS, s), (s % 12).cast("string"), F.lit("号")).alias("folder"),
        F.concat(F.lit("f"), s.cast("string"), F.lit(".xlsx")).alias("file"))
    return matching.match_files(projects, listed)


# -- sheets ------------------------------------------------------------------

@query
def bill_items(spark, sf):
    b = sheets.bill_items(S.sheet_rows(spark, sf), chunk=S.ROW_CHUNK)
    return b.select("project_id", "unit_project", "boq_code", "item_name", "spec_text", "section", "division", "trade", "unit",
                    "quantity", "comp_unit_price", "total_price", "labor_fee", "flag_outlier", "flag_code_error")


@query
def forward_fill_sections(spark, sf):
    b = sheets.bill_items(S.sheet_rows(spark, sf), chunk=S.ROW_CHUNK)
    return b.groupBy("section", "division").agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("total_price"))).cast("double").alias("total"))


@query
def filled_codes(spark, sf):
    """Blank codes take the code above, as in a merged range."""
    rows = sheets.bill_rows(S.sheet_rows(spark, sf)).select(*sheets.SHEET, "row_num", sheets.cell(1).alias("code"))
    filled = ordered.fill_down(rows, sheets.SHEET, "row_num", "code", chunk=S.ROW_CHUNK)
    return filled.groupBy("project_id").agg(F.count("code").alias("filled"), F.min("code").alias("first"), F.max("code").alias("last"))


@query
def merged_ranges(spark, sf):
    """Open cells under merged ranges, the longest over 120,000 rows."""
    rows, ranges = S.merged_sheet(spark, sf)
    return sheets.expand_merged(rows, ranges).select("row_num", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query
def fee_totals(spark, sf):
    return sheets.fee_totals(S.sheet_rows(spark, sf))


@query
def crosscheck(spark, sf):
    rows = S.sheet_rows(spark, sf)
    return sheets.crosscheck(sheets.bill_items(rows, chunk=S.ROW_CHUNK), sheets.fee_totals(rows))


@query
def building_summary(spark, sf):
    return sheets.building_summary(sheets.building_units(S.sheet_rows(spark, sf)))


@query
def cost_breakdown(spark, sf):
    return sheets.breakdown(S.sheet_rows(spark, sf))


@query
def building_json(spark, sf):
    """The buildings of every project as a JSON list."""
    return sheets.building_list(sheets.building_units(S.sheet_rows(spark, sf))).select("project_id", "segment", "buildings_json")


@query
def coverage_pivot(spark, sf):
    return sheets.sheet_coverage(S.sheet_rows(spark, sf))


@query
def source_grades(spark, sf):
    c = sheets.sheet_coverage(S.sheet_rows(spark, sf))
    g = quality.source_grade(F.col("project_id") % 10 == 0, {k: F.col(f"has_{k[2:]}") for k in C.SHEET_KINDS})
    return c.groupBy(g.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query
def sheet_histogram(spark, sf):
    return sheets.sheet_histogram(S.sheet_rows(spark, sf))


@query
def sheet_text(spark, sf):
    t = sheets.sheet_text(S.sheet_rows(spark, sf).filter(sheets.is_kind("表-21")))
    return t.select("project_id", "segment", F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("lines"))


@query
def material_classes(spark, sf):
    rows = S.sheet_rows(spark, sf).filter(sheets.is_kind("表-21"))
    return rows.groupBy(sheets.cell(1).alias("name"), sheets.material_class(sheets.cell(1)).alias("material")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(sheets.number(3))).cast("double").alias("quantity"))


@query
def section_costs(spark, sf):
    c = sheets.section_costs(S.sheet_rows(spark, sf), chunk=S.ROW_CHUNK)
    return c.toDF("project_id", "labor", "foundation", "structure", "roof", "wall")


@query
def fee_priority_merge(spark, sf):
    c = sheets.workbook_costs(S.sheet_rows(spark, sf), chunk=S.ROW_CHUNK)
    return c.select("project_id", "total_cost", F.col("措施费").alias("measure"), F.col("安全文明施工费").alias("safety"), F.col("规费").alias("regulation"),
                    F.col("税金").alias("tax"), F.col("建筑工程费").alias("arch"), F.col("装饰工程费").alias("deco"), F.col("安装工程费").alias("inst"),
                    F.col("清单项目数").alias("items"), F.col("清单总合价").alias("amount"), F.col("暂列金额").alias("provisional"))


@query
def project_records(spark, sf):
    """Training records converted from the workbooks of all projects."""
    rows = S.sheet_rows(spark, sf)
    folders = S.project_meta(spark, sf, False, False).select("project_id", F.concat(
        (F.col("project_id") % 50).cast("string"), F.lit("."), F.col("name")).alias("folder"))
    r = sheets.project_records(rows, folders, chunk=S.ROW_CHUNK)
    return r.select("project_id", F.col("项目名称").alias("name"), F.col("建筑类型").alias("building_type"), F.col("总建筑面积").alias("total_area"),
                    F.col("项目总造价").alias("total_cost"), F.col("单方造价").alias("unit_price"), F.col("材料费").alias("material_fee"),
                    F.col("人工费比例").alias("labor_share"), F.col("混凝土单方用量").alias("concrete_per_m2"), "source_type", "data_confidence",
                    F.array_join("errors", ",").alias("errors"))


@query
def batch_outcome(spark, sf):
    rows = S.sheet_rows(spark, sf)
    folders = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"), F.lit("x").alias("folder"))
    done = S.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("project_id"))
    return sheets.batch_outcome(sheets.project_records(rows, folders, chunk=S.ROW_CHUNK), folders, done)


@query
def enriched_metadata(spark, sf):
    """Missing metadata filled from an overview sheet made of the projects' documents of labels."""
    k = F.col("o_orderkey")
    line = F.array(S.pick(["结构：框架剪力墙", "砖混结构", "", "钢结构厂房"], k), S.pick(["采用20定额", "2019年开工 2021年竣工", ""], k),
                   F.concat((k % 30).cast("string"), F.lit(" 层，地下"), (k % 4).cast("string"), F.lit("层")), S.pick(["精装", "毛坯", ""], k), S.pick(["筏形基础", "桩承台基础", ""], k))
    line = F.when(k % 3 != 0, line).otherwise(F.array_repeat(F.lit(""), 5))
    rows = S.table(spark, sf, "orders").select(
        k.alias("project_id"), F.lit("表-01 总说明").alias("sheet_name"), F.lit(1).alias("sheet_order"), F.lit(1).cast("bigint").alias("row_num"), line.alias("cells"))
    p = S.project_meta(spark, sf, False, False).withColumns({
        "structure_type": F.when(k_mod("project_id", 2, 0), F.col("structure_type")), "under_ground_floors": F.lit(None).cast("int"),
        "field_source": F.lit("imported"), "name": F.concat("name", F.when(k_mod("project_id", 6, 3), F.lit("框架简装")).otherwise(F.lit("")))})
    e = sheets.enrich(p, sheets.overview_facts(rows))
    return e.select("project_id", "structure_type", "build_year", "decoration_standard", "foundation_type", "above_ground_floors",
                    "under_ground_floors", "field_source", "outcome", round_half(F.col("metadata_completeness"), 4).alias("completeness"))


def k_mod(c: str, n: int, r: int):
    return F.col(c) % n == r


# -- training set ------------------------------------------------------------

@query
def enrich_by_name(spark, sf):
    base = S.table(spark, sf, "customer").select(F.concat(F.lit("N"), (F.col("c_custkey") % 500).cast("string")).alias("name"), "c_custkey",
                                                  F.lit(None).cast("int").alias("build_year"))
    meta = S.table(spark, sf, "orders").select(
        F.concat(F.lit("N"), (F.col("o_custkey") % 700).cast("string")).alias("name"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("build_year"), F.col("o_orderpriority").alias("priority"))
    return training_set.enrich_by_name(base, meta, ["build_year", "priority"], F.desc("seq"))


@query
def db_only_rows(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    base = p.filter("structure_type = '框架结构'").select("name")
    return tables.not_in(p, base, "name").select("name", "project_id")


@query
def breakdown_overlay(spark, sf):
    p = S.project_meta(spark, sf, False, False).select("project_id", "name", "foundation_type", F.lit(7.0).alias("labor_cost"))
    b = sheets.breakdown(S.sheet_rows(spark, sf)).join(p.select("project_id", F.col("name").alias("project_name")), "project_id") \
        .withColumns({"foundation_type": F.when(k_mod("project_id", 5, 0), "桩基础"), "concrete_grade": F.lit("C30"), "steel_grade": F.lit("")})
    out = training_set.overlay_breakdown(p, b, F.desc("project_id"))
    return out.select("project_id", "foundation_type", "labor_cost", "arch_cost", "foundation_cost", "tax_cost", "concrete_grade", "steel_grade")


@query
def training_table(spark, sf):
    """The assembled training table: base rows, projects only the database has, trade costs filled."""
    p = S.project_meta(spark, sf)
    base = p.filter("structure_type = '框架结构'").select(
        "name", "building_type", "structure_type", "location", "total_area", "total_cost", "unit_price",
        F.lit(None).cast("int").alias("build_year"), F.lit(None).cast("string").alias("decoration_standard"))
    b = sheets.breakdown(S.sheet_rows(spark, sf)).join(p.select("project_id", F.col("name").alias("project_name")), "project_id") \
        .withColumns({"foundation_type": F.lit(None).cast("string"), "concrete_grade": F.lit(None).cast("string"), "steel_grade": F.lit(None).cast("string")})
    ratios = rollups.global_ratios(rollups.trade_rollup(S.boq_items(spark, sf)))
    t = training_set.training_table(base, p, b, ratios, F.desc("project_id"))
    return t.select("name", "floors", "build_year", "region", "seismic", round_half(F.col("arch_cost"), 2).alias("arch_cost"),
                    round_half(F.col("deco_cost"), 2).alias("deco_cost"), round_half(F.col("inst_cost"), 2).alias("inst_cost"))


@query
def fixed_share_fill(spark, sf):
    p = S.project_meta(spark, sf, place=False).withColumn("labor_cost", F.when(k_mod("project_id", 2, 0), F.lit(5.0)))
    f = training_set.fill_fixed_shares(p)
    return f.select("project_id", round_half(F.col("labor_cost"), 2).alias("labor_cost"), round_half(F.col("structure_cost"), 2).alias("structure_cost"),
                    round_half(F.col("rebar_total"), 4).alias("rebar_total"))


@query
def log_features(spark, sf):
    f = ml.item_features(rollups.item_training_rows(S.boq_items(spark, sf)), ["project_id"])
    return f.groupBy("code4", "division", "unit", "region").agg(
        F.count(F.lit(1)).alias("n"), round_half(F.sum(F.col("log_quantity").cast("decimal(18,6)")).cast("double"), 3).alias("log_quantity"))


@query
def trade_targets(spark, sf):
    p = S.project_meta(spark, sf, False, False).join(rollups.trade_rollup(S.boq_items(spark, sf)), "project_id", "left")
    t = ml.with_trade_targets(p)
    return t.select("project_id", *[round_half(F.col(c), 6).alias(c) for c in ("arch_share", "deco_share", "inst_share")])


# -- estimates ---------------------------------------------------------------

@query
def coefficient_fallback(spark, sf):
    p = estimate.with_coefficients(S.project_meta(spark, sf, False, False), floors="above_ground_floors")
    cols = [round_half(F.col(g)[i], 6).alias(f"{g}_{i}") for g, items in C.COEFFICIENT_ITEMS.items() for i in range(len(items))]
    return p.select("project_id", *cols)


@query
def division_targets(spark, sf):
    p = estimate.with_coefficients(S.project_meta(spark, sf, False, False), floors="above_ground_floors").join(
        rollups.trade_rollup(S.boq_items(spark, sf)), "project_id", "left")
    t = training_set.division_targets(p, [F.col("division")[i] for i in range(4)])
    return t.select("project_id", *[round_half(F.col(c), 6).alias(c) for c in ("foundation_share", "structure_share", "roof_share", "wall_share")])


@query
def scale_factor(spark, sf):
    p = S.project_meta(spark, sf, place=False)
    return p.select("project_id", round_half(estimate.scale_factor(F.coalesce("total_area", F.lit(C.DEFAULT_AREA))), 4).alias("scale"))


@query
def multi_building(spark, sf):
    r = S.requests(spark, sf)
    b = estimate.building_features(F.col("buildings"), F.col("floors"), F.col("project_type"))
    f = r.select("request_id", b.alias("b")).select("request_id", "b.*")
    return f.withColumn("complexity", round_half(estimate.complexity_factor(F.col("building_count"), F.col("floor_std")), 4))


@query
def baseline_price(spark, sf):
    p = S.project_meta(spark, sf, area=False)
    r = names.region(F.col("location"))
    d = F.coalesce("decoration_standard", F.lit(""))
    full = estimate.baseline_price(F.col("building_type"), F.col("structure_type"), r, d, F.coalesce("build_year", F.lit(2026)), F.col("above_ground_floors"))
    return p.select("project_id", round_half(estimate.base_price(F.col("building_type"), F.col("structure_type"), r), 4).alias("base"),
                    round_half(full, 4).alias("baseline"), round_half(full * 0.92, 4).alias("low"), round_half(full * 1.08, 4).alias("high"),
                    round_half(estimate.concrete_per_m2(F.col("above_ground_floors"), F.col("structure_type")), 3).alias("concrete"))


@query
def section_split(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    return estimate.split_rows(p, ["project_id"], F.col("total_cost"), C.SECTION_SPLIT)


@query
def subsection_split(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    return estimate.split_rows(p, ["project_id"], F.col("total_cost"), C.SUBSECTION_SPLIT)


@query
def unit_split(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    return estimate.split_rows(p, ["project_id"], F.col("total_cost") * 0.95, C.UNIT_PROJECT_SPLIT)


@query
def item_amounts(spark, sf):
    return estimate.item_amounts(S.project_meta(spark, sf, place=False), ["project_id"], F.coalesce("total_area", F.lit(C.DEFAULT_AREA)))


@query
def indicator_list(spark, sf):
    return estimate.indicator_rows(S.project_meta(spark, sf, place=False), ["project_id"], F.coalesce("total_area", F.lit(C.DEFAULT_AREA)))


@query
def price_index_years(spark, sf):
    return prices.index_report(prices.seeded_price_index(spark), S.project_meta(spark, sf, False, False)).select("year", "adjustment_factor", "projects")


@query
def first_sheets(spark, sf):
    return sheets.first_sheets(S.sheet_rows(spark, sf), 2).select("project_id", "sheet_name", "sheet_kind", "place")


@query
def six_level_breakdown(spark, sf):
    return estimate.cost_levels(S.project_meta(spark, sf, False, False), ["project_id"], F.col("total_cost"))


@query
def weighted_fusion(spark, sf):
    f = estimate.fuse(S.predictions(spark, sf))
    return f.select("request_id", round_half(F.col("fused"), 2).alias("fused"), "model_count", "average_accuracy")


@query
def percentile_interval(spark, sf):
    told = S.predictions(spark, sf)
    asked = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id")).join(estimate.fuse(told), "request_id", "left")
    return estimate.prediction_interval(asked, told, [m for m, *_ in C.MODEL_REGISTRY], F.col("fused"))


@query
def composition_normalised(spark, sf):
    r = estimate.estimate(S.requests(spark, sf))
    c = r.select("request_id", F.explode_outer("composition").alias("c"))
    return c.select("request_id", "c.part", "c.ratio", "c.amount")


@query
def trade_composition(spark, sf):
    r = estimate.estimate(S.requests(spark, sf))
    c = r.select("request_id", F.explode_outer("trade_composition").alias("c"))
    return c.select("request_id", "c.part", round_half(F.col("c.ratio"), 4).alias("ratio"), "c.amount")


@query
def full_estimate(spark, sf):
    fused = estimate.fuse(S.predictions(spark, sf))
    r = estimate.estimate(S.requests(spark, sf), fused)
    return r.select("request_id", "unit_price", "total_cost", "unit_price_raw", "scale_factor", "from_models",
                    F.col("materials")[0]["total"].alias("concrete"), F.col("division_composition")[0]["ratio"].alias("foundation"))


@query
def estimate_record(spark, sf):
    """Estimates with interval, number and accuracy of models, and the importance of the best model's features."""
    told = S.predictions(spark, sf)
    models = told.groupBy("model_id").agg(F.avg("accuracy").alias("accuracy")).withColumns({
        "is_trained": F.col("model_id") != "boq_xgb", "importance": F.when(F.col("model_id") != "unit_gbt", F.create_map(F.lit("total_area"), F.col("accuracy") / 100)).otherwise(F.create_map().cast("map<string,double>"))})
    r = estimate.estimate_record(S.requests(spark, sf), told, [m for m, *_ in C.MODEL_REGISTRY], models)
    return r.select("request_id", "unit_price", "lower", "upper", "model_count", "average_accuracy", "importance_model",
                    round_half(F.try_element_at("feature_importance", F.lit("total_area")), 6).alias("area_importance"))


@query
def found_projects(spark, sf):
    """Point look-up by type and year."""
    return tables.find(S.project_meta(spark, sf, False, False), building_type="学校", build_year=2015).select("project_id", "name", "build_year")


@query
def confidence_bonus(spark, sf):
    r = S.requests(spark, sf)
    c = estimate.confidence(r, ["request_id"], {"subsection_xgb": F.lit(36.7), "section_xgb": F.lit(51.6), "item_xgb": F.lit(89.4)})
    return c.select("request_id", "model_id", "input_bonus", round_half(F.col("effective_accuracy"), 1).alias("effective_accuracy"),
                    "max_bonus", "filled_params", "total_params", F.array_join(F.array_sort(F.map_keys("breakdown")), ",").alias("filled"))


@query
def overall_confidence(spark, sf):
    r = S.requests(spark, sf)
    c = estimate.confidence(r, ["request_id"], {"subsection_xgb": F.lit(36.7), "section_xgb": F.lit(51.6), "item_xgb": F.lit(89.4)})
    return estimate.overall_confidence(c)


@query
def empirical_correction(spark, sf):
    r = S.requests(spark, sf)
    return r.select("request_id", estimate.correction(r, "subsection_xgb", "基础占比").alias("foundation"),
                    estimate.correction(r, "section_xgb", "建筑占比").alias("building"), estimate.correction(r, "section_xgb", "安装占比").alias("installation"),
                    estimate.correction(r, "section_xgb", "装饰占比").alias("decoration"), estimate.correction(r, "item_xgb", "混凝土总用量").alias("concrete"),
                    estimate.correction(r, "item_xgb", "砌块总用量").alias("block"))


@query
def stage_models(spark, sf):
    r = estimate.models_for(S.requests(spark, sf), ["section_xgb", "indicator_rf", "boq_xgb"])
    return r.select("request_id", F.array_join("models", ",").alias("models"))


@query
def stage_parameters(spark, sf):
    """Requests per stage next to the stage's parameter catalogue."""
    r = S.requests(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("requests"))
    return estimate.stage_catalogue(spark).join(r, "stage")


@query
def similar_topk(spark, sf):
    r = S.requests(spark, sf).withColumnRenamed("project_type", "building_type")
    return matching.similar_projects(r, S.project_meta(spark, sf, place=False), 5)


@query
def estimate_references(spark, sf):
    r = S.requests(spark, sf)
    p = S.project_meta(spark, sf, place=False)
    similar = matching.similar_projects(r.withColumnRenamed("project_type", "building_type"), p, 3)
    out = estimate.with_references(estimate.estimate(r), similar, p)
    return out.select("request_id", F.coalesce(F.size("references"), F.lit(0)).alias("references"), F.col("references")[0]["name"].alias("first"), "reference_warning")


@query
def evidence_score(spark, sf):
    p = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("customer", "n", estimate.evidence_score(F.col("n")).alias("score"))


@query
def source_counts(spark, sf):
    p = S.project_meta(spark, sf, False, False)
    kind = F.when(F.col("data_quality_grade").isNull(), "simulated").otherwise("real")
    return p.groupBy(kind.alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


# -- documents and conversations ---------------------------------------------

@query
def text_features(spark, sf):
    d = text.text_features(S.parsed_documents(spark, sf))
    return d.select("doc_id", "project_name", "building_type", "structure_type", "total_area", "land_area", "location", "build_year",
                    "floor_count", "above_ground_floors", "under_ground_floors", "decoration_standard",
                    text.foundation(F.col("full_text")).alias("foundation"))


@query
def table_fields(spark, sf):
    d = text.table_features(text.text_features(S.parsed_documents(spark, sf)))
    return d.select("doc_id", "total_area", "build_year", "floor_count", F.array_join(F.array_sort("table_fields"), ",").alias("from_table"))


@query
def cost_value_parse(spark, sf):
    d = text.table_cost(text.text_features(S.parsed_documents(spark, sf)))
    return d.select("doc_id", "total_cost", "unit_price")


@query
def document_confidence(spark, sf):
    d = text.document_features(S.parsed_documents(spark, sf))
    return d.select("doc_id", F.array_join(F.array_sort(F.map_keys(F.map_filter("confidence", lambda k, v: v > 0))), ",").alias("known"),
                    round_half(text.completeness(d), 4).alias("completeness"))


@query
def document_context(spark, sf):
    d = text.document_features(S.parsed_documents(spark, sf))
    return d.select("doc_id", text.context_summary(d).alias("context"))


@query
def ocr_cleanup(spark, sf):
    d = S.parsed_documents(spark, sf)
    return d.select("doc_id", text.clean_ocr(F.col("full_text")).alias("text"))


@query
def scanned_pages(spark, sf):
    d = S.table(spark, sf, "documents")
    conf = (F.col("doc_id") * 37 % 101).cast("double")
    return text.page_scan(d, "source", F.col("text"), conf)


@query
def intent_labels(spark, sf):
    return conversations.intent_counts(S.messages(spark, sf), "text")


@query
def request_params(spark, sf):
    m = S.messages(spark, sf)
    return m.select("session_id", "turn", *[v.alias(k) for k, v in conversations.request_params(F.col("text")).items()])


@query
def refined_regions(spark, sf):
    m = S.messages(spark, sf)
    return m.groupBy(conversations.refined_region(F.col("text")).alias("region"), conversations.term(F.col("text")).alias("term")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def session_summary(spark, sf):
    return conversations.session_summary(S.messages(spark, sf))


@query
def session_retention(spark, sf):
    kept = conversations.retain(S.messages(spark, sf), sessions=C.MAX_SESSIONS, per_session=C.MAX_MESSAGES)
    return kept.select("session_id", "turn", "role")


@query
def last_messages(spark, sf):
    return conversations.last_messages(S.messages(spark, sf), 50).select("session_id", "turn")


@query
def project_retention(spark, sf):
    return conversations.retain_projects(S.project_meta(spark, sf, False, False), n=C.MAX_PROJECTS).select("project_id", "name")


# -- models ------------------------------------------------------------------

@query
def residual_stats(spark, sf):
    items = S.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted"))
    return ml.residual_stats(items, "actual", "predicted")


@query
def residual_stats_by_group(spark, sf):
    """Residual statistics of every return flag and ship mode, as of models, folds and targets."""
    items = S.table(spark, sf, "lineitem").select("l_returnflag", F.nullif(F.col("l_linenumber") % 4, F.lit(0)).alias("fold"), F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted"))
    return ml.grouped_residual_stats(items, ["l_returnflag", "fold"], "actual", "predicted")


@query
def exact_folds(spark, sf):
    """Two draws of five folds over all orders."""
    orders = S.table(spark, sf, "orders").select("o_orderkey")
    draws = [ml.with_folds(orders, "o_orderkey", 5, r).select("o_orderkey", F.lit(r).alias("repeat"), "fold") for r in (0, 1)]
    return draws[0].union(draws[1])


@query
def fold_metrics(spark, sf):
    """R² and error per fold of a price guess against the real amounts."""
    items = S.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.lit(0).alias("repeat"), F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1500).alias("prediction"))
    return ml.fold_metrics(items).select("repeat", "fold", "n", round_half(F.col("r2"), 6).alias("r2"), round_half(F.col("mae"), 4).alias("mae"),
                                         round_half(F.col("mape"), 6).alias("mape"))


@query
def accuracy_gate(spark, sf):
    p = S.predictions(spark, sf).select("request_id", "model_id", "accuracy")
    g = ml.trained_status(p)
    return g.groupBy("model_id", "is_trained", "in_interval").agg(F.count(F.lit(1)).alias("n"))


@query
def model_status(spark, sf):
    """The model list overlaid with how many predictions each model made."""
    made = S.predictions(spark, sf).groupBy("model_id").agg(F.count(F.lit(1)).alias("train_rows")).withColumn("fitted", F.lit(True))
    return ml.registry_overlay(spark, made)


@query
def ml_item_price(spark, sf):
    """Out-of-fold metrics of the linear item price model."""
    items = rollups.item_training_rows(S.boq_items(spark, sf))
    spec = ml.ModelSpec("boq_lr_v2", ["comp_unit_price"], ml.ITEM, ml.linear(), True, 100, folds=5)
    key = F.concat_ws("|", "project_id", "boq_code", "quantity", "comp_unit_price")
    frame = ml.item_features(items.withColumn("row_key", key), ["row_key", "comp_unit_price"])
    return ml.regression_metrics(ml.cross_predict(frame, spec, "comp_unit_price", "row_key"))


@query
def ml_unit_price(spark, sf):
    """Predicted unit price of every trainable project from boosted trees."""
    p = training_set.training_rows(S.project_meta(spark, sf)).withColumns({
        "region": names.region(F.col("location")), "decoration": names.decoration_level(F.col("decoration_standard"))})
    p = ml.with_seismic(p)
    spec = ml.ModelSpec("unit_gbt", ["unit_price"], ml.TREE, ml.gbt(100, depth=6), True, 5)
    frame = ml.staged(ml.feature_frame(p, spec.features, ["project_id", "unit_price"]))  # read by the bins, the rows and the scoring
    texts, numbers, _ = spec.features
    model = block_trees.fit(ml.labelled(frame, spec, "unit_price"), "project_id", texts, numbers, "label", **ml.tree_sizes(spec.estimator))
    return block_trees.score(frame, model).select("project_id", "unit_price", F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("pred_unit_price"))


@query
def frequent_categories(spark, sf):
    """Values of item columns that one row in 200 has, with their exact counts."""
    return categories.frequent_counts(S.boq_items(spark, sf), ["item_name", "unit", "boq_code", "division", "trade"])


@query
def split_search(spark, sf):
    """The best first split of the lines of every line number for two outputs, price and tax in hundredths, over a category and a number."""
    flag = F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag")).cast("int")
    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("model"), F.lit(1).alias("node"), F.lit(1).cast("bigint").alias("w"),
        F.array(*[F.round(F.col(c) * 100).cast("bigint") for c in ("l_extendedprice", "l_tax")]).alias("r"),
        F.array(flag, F.col("l_quantity").cast("int")).alias("bins"))
    best = boosting.best_splits(rows, 2, 1, 5)
    return best.select("model", (-F.col("f")).alias("feature"), (-F.col("b")).alias("bin"), "equal", *[
        round_half(F.col(side)[k], 4).alias(f"{side}_{k}") for side in ("left", "right", "mean") for k in (0, 1)])


@query
def multi_output_models(spark, sf):
    """Metrics of the models with several targets, in the registry's sizes, from their stored out-of-fold predictions."""
    items = S.boq_items(spark, sf)
    labor = items.groupBy("project_id").agg((F.sum(money(F.col("labor_fee"))) / F.nullif(F.sum(money(F.col("total_price"))), F.lit(0))).cast("double").alias("labor_share"))
    p = estimate.with_coefficients(training_set.training_rows(S.project_meta(spark, sf)), floors="above_ground_floors").join(
        rollups.trade_rollup(items), "project_id", "left").join(labor, "project_id", "left").withColumns({
            "region": names.region(F.col("location")), "decoration": names.decoration_level(F.col("decoration_standard"))})
    p = ml.with_trade_targets(training_set.division_targets(p, [F.col("division")[i] for i in range(4)]))
    p = p.withColumns({f"{n}_per_m2": F.col(f"{c}_total") / F.nullif("total_area", F.lit(0.0)) for n, c in (("concrete", "concrete"), ("steel", "rebar"), ("block", "block"))})
    specs = {m: s for m, s in ml.registry().items() if len(s.targets) > 1}
    frame = ml.feature_frame(p, ml.TREE, ["project_id", *sorted({t for s in specs.values() for t in s.targets})]).checkpoint()
    folder, parts = _fresh(spark, "models"), []
    for m, result in ml.train_all(dict.fromkeys(specs, frame), specs, "project_id").items():
        if result.trees is not None:
            ml.save_models(result, folder)
            parts.append(ml.output_metrics(spark.read.parquet(f"{folder}/{m}/predicted")).select(F.lit(m).alias("model_id"), "*"))
    none = spark.createDataFrame([], "model_id string, target string, rows long, accuracy double, r2_std double, mae double, mape double")
    return ml.trained_status(reduce(DataFrame.unionByName, parts, none))


@query
def fp_patterns(spark, sf):
    items = S.boq_items(spark, sf)
    word = F.element_at(F.split("item_name", " "), 1)
    sets, _ = ml.item_patterns(items, ["project_id"], word, support=0.1, confidence=0.3)
    return sets.select(F.array_join("items", ",").alias("items"), "freq", round_half(F.col("support"), 6).alias("support"))
