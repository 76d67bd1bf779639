"""Codes, keys, names and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import rules
from takeoff.functions.numbers import BLANKS, parse_number, round_half, strip

CJK = "\\x{4e00}-\\x{9fff}"


def bill_code(code: Column) -> Column:
    """Spaces and line breaks removed; all-digit codes shorter than 12 zero-padded."""
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), "[ \\n\\r]", "")
    return F.when(bare.rlike("^[0-9]+$") & (F.length(bare) < 12), F.lpad(bare, 12, "0")).otherwise(bare)


def is_bill_code(code: Column) -> Column:
    return F.coalesce(F.regexp_replace(strip(code), "[- ]", "").rlike("^[0-9]{9,}$"), F.lit(False))


def item_id(project: Column, code: Column, name: Column, unit: Column | None = None) -> Column:
    """project_code_hash; the unit project enters the hash so equal rows of two sheets stay apart."""
    parts = [project, code, name] if unit is None else [project, unit, code, name]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("_", project, code, F.substring(digest, 1, 8))


def project_id(name: Column) -> Column:
    return F.substring(F.md5(project_key(name)), 1, 12)


def project_key(name: Column) -> Column:
    """Name without whitespace and with ASCII brackets."""
    return F.translate(name, "（）" + BLANKS, "()")


def folder_title(folder: Column) -> Column:
    return strip(F.regexp_replace(folder, "^\\d+\\.?\\s*", ""))


def is_summary(name: Column) -> Column:
    return rules.contains_any(name, C.SUMMARY_WORDS)


def is_section_header(name: Column, amount: Column, labor: Column) -> Column:
    head = name.rlike(f"^[A-Z]\\s*[{CJK}]") | (name.rlike(f"^[{CJK}]") & name.contains("工程"))
    return F.coalesce(head & ~(amount > 0) & ~(labor > 0), F.lit(False))


def division_of_section(name: Column) -> Column:
    return rules.first_words(name, C.DIVISION_WORDS)


def cost_field_of_section(name: Column) -> Column:
    return rules.first_words(name, C.SECTION_COST_WORDS)


def trade_of_item(name: Column, spec: Column) -> Column:
    return rules.first_words(F.concat_ws(" ", name, F.coalesce(spec, F.lit(""))), C.TRADE_WORDS, C.DEFAULT_TRADE)


def division_of_prefix2(division: Column, code: Column) -> Column:
    return F.coalesce(division, rules.lookup(F.substring(code, 1, 2), C.PREFIX2_DIVISION, C.PREFIX2_DEFAULT))


def division_of_prefix4(code: Column, default: str = "其他") -> Column:
    return rules.lookup(F.substring(code, 1, 4), C.PREFIX4_DIVISION, default)


def building_type(name: Column, usage: Column | None = None) -> Column:
    text = name if usage is None else F.concat_ws(" ", F.coalesce(usage, F.lit("")), name)
    return rules.first_words(text, C.BUILDING_TYPE_WORDS, C.DEFAULT_BUILDING_TYPE)


def structure_type(text: Column) -> Column:
    text = strip(text)
    return F.when(text.isin(C.VALID_STRUCTURES), text).otherwise(
        rules.first_words(text, C.STRUCTURE_WORDS, C.DEFAULT_STRUCTURE)
    )


def repair_structure(structure: Column) -> Column:
    return F.when(structure.isin(C.VALID_STRUCTURES), structure).otherwise(F.lit(C.DEFAULT_STRUCTURE))


def max_number(text: Column, pattern: str) -> Column:
    """Largest integer captured by the pattern anywhere in the text, null when there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.try_cast("int")))


def floor_count(text: Column) -> Column:
    whole = parse_number(text).try_cast("int")
    return F.coalesce(
        max_number(text, "(\\d+)\\s*层"), F.when(whole > 0, whole), F.lit(C.DEFAULT_FLOORS)
    )


def address_region(address: Column) -> Column:
    return F.coalesce(rules.first_contained(address, C.ADDRESS_CITIES), F.lit(C.DEFAULT_ADDRESS_REGION))


def structure_of_name(name: Column) -> Column:
    return rules.first_words(name, C.NAME_STRUCTURE_WORDS)


def decoration_of_name(name: Column) -> Column:
    return rules.first_words(name, C.NAME_DECORATION_WORDS)


def unit_floors(name: Column) -> Column:
    """Floors told by a unit-project name: N层/楼/F, else N#楼, else the first of N~M#."""
    patterns = ["(\\d+)\\s*[层楼Ff]", f"(\\d+)#[{CJK}]*[楼栋幢]?", "(\\d+)\\s*[~\\x{FF5E}]\\s*\\d+\\s*#"]
    hits = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits).try_cast("int")


def unit_type(name: Column) -> Column:
    return rules.first_words(name, C.UNIT_TYPE_WORDS, "住宅")


def concrete_grade(price: Column) -> Column:
    return F.when(price.isNotNull(), rules.bands(price, C.CONCRETE_GRADE_BANDS, C.CONCRETE_GRADE_LOWEST))


def steel_grade(price: Column) -> Column:
    return F.when(price.isNotNull(), rules.bands(price, C.STEEL_GRADE_BANDS, C.STEEL_GRADE_LOWEST))


def decoration_level(text: Column) -> Column:
    return rules.lookup(strip(text), C.DECORATION_LEVELS, C.DEFAULT_DECORATION_LEVEL)


def type_synonym(text: Column) -> Column:
    return rules.first_words(text, C.TYPE_SYNONYMS, text)


def money_label(amount: Column) -> Column:
    def fixed(value: Column, unit: str) -> Column:
        return F.concat(round_half(value, 2).cast("decimal(30,2)").cast("string"), F.lit(unit))

    return (
        F.when(amount >= 1e8, fixed(amount / 1e8, "亿元"))
        .when(amount >= 1e4, fixed(amount / 1e4, "万元"))
        .otherwise(fixed(amount, "元"))
    )


def extension(file_name: Column) -> Column:
    """Lower-case extension with its dot; '' for none and for dot files."""
    base = F.regexp_extract(F.coalesce(file_name, F.lit("")), "([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, "[^.].*?(\\.[^.]*)$", 1))


def stored_name(task_id: Column, file_name: Column) -> Column:
    ext = extension(file_name)
    return F.concat(task_id, F.when(ext.isin(C.ALLOWED_EXTENSIONS), ext).otherwise(F.lit("")))


def region(location: Column) -> Column:
    """One of seven regions: itself, else that of the city or province, else the default."""
    members = [(r, r) for r in C.REGIONS] + [(m, r) for r, ms in C.REGION_MEMBERS for m in ms]
    return rules.lookup(strip(location), members, C.DEFAULT_REGION)


def seismic_level(location: Column) -> Column:
    """Design intensity: exact city, else longest contained city, else region, else contained region."""
    place = strip(location)
    cities = [(c, f"{v:g}度") for c, v in sorted(C.SEISMIC_CITIES, key=lambda pair: -len(pair[0]))]
    regions = [(r, f"{v:g}度") for r, v in C.SEISMIC_REGIONS]
    return F.coalesce(rules.lookup(place, cities), rules.first_contained_value(place, cities),
                      rules.first_contained_value(place, regions), F.lit(C.DEFAULT_SEISMIC))


def floor_tier(floors: Column) -> Column:
    """Band of the floor count with the usual price range, as a struct."""

    def tier(name: str, low: float, high: float) -> Column:
        return F.struct(F.lit(name).alias("tier"), F.lit(low).alias("price_low"), F.lit(high).alias("price_high"))

    branches = [(floors <= top, tier(name, low, high)) for top, name, low, high in C.FLOOR_TIERS]
    return F.when(floors.isNotNull(), rules.chain(branches, tier(*C.FLOOR_TIER_TOP)))
