"""Dates, JSON, collation and variant helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from takeoff import constants as C


def expiry(uploaded_at: Column) -> Column:
    return uploaded_at + F.expr(f"INTERVAL {C.UPLOAD_TTL_HOURS} HOURS")


def iso_week(ts: Column) -> Column:
    """ISO year and week as 2026-W09."""
    year = F.extract(F.lit("YEAROFWEEK"), ts)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def is_date(text: Column) -> Column:
    return text.try_cast("date").isNotNull()


def same_text(a: Column, b: Column) -> Column:
    """Equality ignoring case."""
    return F.collate(a, "UTF8_LCASE") == F.collate(b, "UTF8_LCASE")


def as_json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def json_field(text: Column, path: str, kind: str) -> Column:
    """Typed field of a JSON text through a variant value."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def json_kind(text: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
