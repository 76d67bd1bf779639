"""Rule tables turned into column expressions (no UDF, no join)."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    """A constant as SQL text, so that a whole constant table becomes one expression."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def alternatives(words: list[str]) -> str:
    """Pattern that finds any of the words."""
    return "|".join(re.escape(w) for w in words)


def contains_any(col: Column, words: list[str]) -> Column:
    """True when any of the words occurs in the text; null text gives false."""
    return F.coalesce(col.rlike(alternatives(words)), F.lit(False))


def first_words(col: Column, rules: list[tuple[str, list[str]]], default=None) -> Column:
    """Value of the first rule with a contained word, in rule order."""
    return chain([(col.rlike(alternatives(words)), F.lit(value)) for value, words in rules], default)


def first_words_of_long_text(col: Column, rules: list[tuple[str, list[str]]], default=None) -> Column:
    """As first_words, with plain substring search: faster than alternation over long texts."""
    return chain([(reduce(lambda a, b: a | b, [col.contains(w) for w in words]), F.lit(value)) for value, words in rules],
                 default)


def first_pattern(col: Column, rules: list[tuple[str, object]], default=None) -> Column:
    """Value of the first rule whose pattern is found, in rule order."""
    return chain([(col.rlike(pattern), F.lit(value)) for pattern, value in rules], default)


def first_pattern_rank(col: Column, rules: list[tuple[str, object]]) -> Column:
    """Position of the first pattern found, null when none; its minimum over rows is the rank of the whole text."""
    return chain([(col.rlike(pattern), F.lit(i)) for i, (pattern, _) in enumerate(rules)])


def value_at_rank(rank: Column, rules: list[tuple[str, object]]) -> Column:
    return chain([(rank == i, F.lit(value)) for i, (_, value) in enumerate(rules)])


def first_contained(col: Column, words: list[str]) -> Column:
    """The first word of the list that occurs in the text."""
    listed = F.expr("array(" + ", ".join(sql_literal(w) for w in words) + ")")
    return F.get(F.filter(listed, lambda w: col.contains(w)), F.lit(0))


def first_contained_value(col: Column, pairs: list[tuple[str, object]]) -> Column:
    """Value of the first pair whose key occurs in the text."""
    listed = F.expr("array(" + ", ".join(
        f"named_struct('k', {sql_literal(k)}, 'v', {sql_literal(v)})" for k, v in pairs) + ")")
    return F.get(F.filter(listed, lambda x: col.contains(x["k"])), F.lit(0))["v"]


def lookup(col: Column, pairs: list[tuple], default=None) -> Column:
    """Exact-key lookup in a short constant table, held as one map literal."""
    table = F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs) + ")")
    found = F.try_element_at(table, col)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def bands(col: Column, limits: list[tuple[float, object]], lowest) -> Column:
    """Value of the first limit the number reaches, limits in falling order."""
    return chain([(col >= limit, F.lit(value)) for limit, value in limits], lowest)


def chain(branches: list[tuple[Column, Column]], default=None) -> Column:
    (cond, value), rest = branches[0], branches[1:]
    expr = F.when(cond, value)
    for cond, value in rest:
        expr = expr.when(cond, value)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def longest_first(words: list[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)
