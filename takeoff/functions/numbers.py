"""Number parsing and rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,4)"
# Fixed value: white space of Unicode, and the separators that count as such
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


NUMBER = "^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\\s*$"


def parse_number(cell: Column) -> Column:
    """Double value of a cell, null when it is not a plain number.

    The pattern keeps out what the cast alone would take: float suffixes, NaN and infinity words.
    """
    return F.regexp_extract(cell.cast("string"), NUMBER, 1).try_cast("double")


def number_or(cell: Column, default: float = 0.0) -> Column:
    """Tolerant number: blanks, dashes and text give the default; thousands commas are not read."""
    return F.coalesce(parse_number(cell), F.lit(float(default)))


def comma_number(cell: Column) -> Column:
    """Number with thousands commas removed, null on failure."""
    return parse_number(F.replace(cell.cast("string"), F.lit(","), F.lit("")))


def round_half(col: Column, digits: int) -> Column:
    """Round half up through a decimal, so binary noise below the last digits cannot turn a tie."""
    return F.round(col.try_cast(f"decimal(38,{digits + 4})"), digits).cast("double")


def money(col: Column) -> Column:
    """Decimal amount: sums do not depend on the order of rows or partitions. Null where it has over 24 digits before the point."""
    return col.try_cast(MONEY)


def strip(col: Column) -> Column:
    """Text without white space of any kind at its ends, as the readers of sheets take it."""
    return F.trim(col, F.lit(BLANKS))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded part / whole, 0 when the whole is not positive."""
    return F.when(whole > 0, round_half(part / whole, digits)).otherwise(F.lit(0.0))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def log1p_of(col: Column) -> Column:
    return F.log1p(F.coalesce(col.try_cast("double"), F.lit(0.0)))
