"""Normalization steps that regular expressions can say, as Spark columns.

They stay in generated code and never start Python. The whole of :mod:`values` is only needed
where grammar is (nested calls, colours, exact units); see ``udfs``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .properties import ALIASES
from .values import CASE_COUNTS, FONT_WEIGHTS, LENGTH_UNITS, PERCENT_ZERO_DIFFERS, ZERO_IS_NONE


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def property_name(prop: Column, aggressive: bool = False) -> Column:
    """Trimmed; lower case but for custom properties; newer names if aggressive."""
    name = trimmed(prop)
    lower = F.lower(name)
    if aggressive:
        names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
        lower = F.coalesce(F.try_element_at(names, lower), lower)
    return F.when(name.startswith("--"), name).otherwise(lower)


def spaces(value: Column) -> Column:
    """Runs of white space as one space, none inside parentheses, around commas and slashes."""
    one = F.regexp_replace(value, r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"(?<=[(,]) | (?=[),])", ""), " ?/ ?", "/")


def folded(prop: Column, value: Column) -> Column:
    return F.when(prop.isin(sorted(CASE_COUNTS)), value).otherwise(F.lower(value))


def plus_signs(value: Column) -> Column:
    return F.regexp_replace(value, r"(^|[\s(,])\+(?=[\d.])", "$1")


def decimals(value: Column) -> Column:
    """0.50 and .50 as .5; 1.0 as 1; 0.0 as 0. Points of decimals are marked while zeros go."""
    point = "\u0001"
    marked = F.regexp_replace(value, r"\.(?=\d)(\d*?)0*(?!\d)", point + "$1")
    short = F.regexp_replace(marked, rf"(?<!\d)0?{point}(?=\d)", ".")
    short = F.regexp_replace(F.regexp_replace(short, rf"{point}(?=\d)", "."), rf"(?<=\d){point}", "")
    return F.regexp_replace(short, point, "0")


def zero_lengths(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?i)(?<![A-Za-z0-9_.#])0(?:{'|'.join(LENGTH_UNITS)})(?![A-Za-z0-9_])", "0")


def zero_percents(prop: Column, value: Column) -> Column:
    return F.when(prop.isin(sorted(PERCENT_ZERO_DIFFERS)), value).otherwise(F.regexp_replace(value, r"(?<![A-Za-z0-9_.#])0%(?![A-Za-z0-9_])", "0"))


def font_weights(prop: Column, value: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in FONT_WEIGHTS.items() for x in pair))
    return F.when(prop == "font-weight", F.coalesce(F.try_element_at(named, value), value)).otherwise(value)


def zero_borders(prop: Column, value: Column) -> Column:
    return F.when(prop.isin(sorted(ZERO_IS_NONE)) & (value == "0"), "none").otherwise(value)


def hex_color(value: Column) -> Column:
    """A value that is one hex colour, with six digits, or eight where it is not opaque."""
    digits = F.regexp_extract(value, "^#([0-9a-f]+)$", 1)
    full = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    opaque = F.regexp_replace(full, "^(.{6})ff$", "$1")
    return F.when(F.length(digits).isin(3, 4, 6, 8), F.concat(F.lit("#"), opaque)).otherwise(value)


def milliseconds(value: Column) -> Column:
    """A value that is one time, as exact milliseconds: the decimal point moves by three digits."""
    parts = r"(?i)^([+-]?)(\d*)(?:\.(\d+))?s$"
    fraction = F.rpad(F.regexp_extract(value, parts, 3), F.greatest(F.lit(3), F.length(F.regexp_extract(value, parts, 3))), F.lit("0"))
    digits = F.concat(F.regexp_extract(value, parts, 2), F.substring(fraction, 1, 3))
    whole = F.regexp_replace(digits, r"^0+(?=\d)", "")
    rest = F.regexp_replace(F.substring(fraction, 4, 1 << 30), "0+$", "")
    number = F.when(rest == "", whole).otherwise(F.concat(F.regexp_replace(whole, "^0$", ""), F.lit("."), rest))
    sign = F.regexp_extract(value, parts, 1)
    sign = F.when((whole == "0") & (rest == "") & (sign == "-"), "").otherwise(sign)
    return F.when(value.rlike(r"(?i)^[+-]?(\d+(\.\d+)?|\.\d+)s$"), F.concat(sign, number, F.lit("ms"))).otherwise(value)


def eligible(selectors: Column, patterns: tuple[str, ...]) -> Column:
    """None of a rule's selectors matches a pattern."""
    if not patterns:
        return F.lit(True)
    whole = "|".join(f"(?:{p})" for p in patterns)
    return ~F.exists(selectors, lambda s: s.rlike(whole))


def selector_key(selectors: Column) -> Column:
    """A list of selectors whatever its order and, outside quotes, its white space."""
    spaced = F.transform(selectors, lambda s: F.when(s.rlike("[\"']"), s).otherwise(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.array_join(F.array_sort(spaced), ",")


def source_map_comment(text: Column) -> Column:
    return text.rlike(r"^#\s*sourceMappingURL=")
