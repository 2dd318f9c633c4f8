"""Text as columns: cleaning, labels, numbers, and the text forms of numbers and JSON strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode white space at both ends.
EDGES = r"(?U)^\s+|\s+$"
NUMBER = r"[-+]?[0-9]*[.,]?[0-9]+"
QUANTITY = r"^([-+]?[0-9]+(?:[.,][0-9]+)?)(?U:\s*)([A-Za-zµ°%/]+)?$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def clean(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized_label(x: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, punctuation dropped, white space collapsed."""
    plain = F.regexp_replace(F.translate(F.lower(x), "_-", "  "), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return clean(plain)


def parsed_number(x: Column) -> Column:
    """The first number in x, a decimal comma read as a point; null without one."""
    return F.regexp_replace(F.regexp_extract(x, NUMBER, 0), ",", ".").try_cast("double")


def split_quantity(x: Column, units: list[str]) -> tuple[Column, Column]:
    """Value and unit of `number unit` where the unit is known; else x and null."""
    unit = F.regexp_extract(x, QUANTITY, 2)
    known = F.lower(unit).isin(units)
    return F.when(known, F.regexp_extract(x, QUANTITY, 1)).otherwise(x), F.when(known, unit)


def float_text(x: Column) -> Column:
    """A double as the shortest decimal with a point: positional from 1e-4 up to 1e16."""
    plain = F.regexp_replace(F.format_string("%.17f", x), "0+$", "")
    short = x.cast("string")
    positional = F.when(F.abs(x) >= 1e7, F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0")))
    # the shortest digits come from the cast; only their layout differs outside 1e-3 .. 1e7
    digits = F.regexp_replace(F.regexp_extract(short, r"^-?([0-9.]+)E-4$", 1), r"\.0$|\.", "")
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0.000"), digits)
    whole = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16) & (x == F.floor(x))
    return F.when(x.isNull(), None).when(whole, positional).when(short.rlike("E-4$"), small).when(
        (F.abs(x) >= 1e7) & (F.abs(x) < 1e16), F.regexp_replace(plain, r"\.$", ".0"),
    ).otherwise(F.lower(short))


def json_text(x: Column) -> Column:
    """x as a JSON string."""
    array = F.to_json(F.array(x))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def json_pair(key: Column, value: Column) -> Column:
    """`{"key": "value"}`, with a space after the colon."""
    return F.concat(F.lit("{"), json_text(key), F.lit(": "), json_text(value), F.lit("}"))


def grounded(content: Column, span: Column, value: Column) -> Column:
    """Is the span in the content (white space collapsed), and the value in the span (any case)? Blank ones aren't."""
    inside = F.contains(clean(content), clean(span)) & F.contains(F.lower(span), F.lower(strip(value)))
    return F.coalesce((strip(span) != "") & (strip(value) != "") & inside, F.lit(False))


def entity_id(prefix: str, *keys: Column) -> Column:
    """A prefix and 26 hex digits that depend on the keys alone: a retry or a second run gives the same id."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(k.cast("string"), F.lit("\u0002")) for k in keys)), 256), 1, 26))
