"""Units of measurement and their conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.functions.text import parsed_number, strip

# Dimension, and factor to its base unit.
UNITS = {
    "g": ("mass", 1.0), "kg": ("mass", 1000.0), "mg": ("mass", 0.001), "oz": ("mass", 28.349523125), "lb": ("mass", 453.59237),
    "mm": ("length", 1.0), "cm": ("length", 10.0), "m": ("length", 1000.0), "in": ("length", 25.4),
    "h": ("time", 1.0), "hr": ("time", 1.0), "min": ("time", 1.0 / 60.0), "s": ("time", 1.0 / 3600.0), "ms": ("time", 1.0 / 3_600_000.0),
    "hz": ("frequency", 1.0), "khz": ("frequency", 1e3), "mhz": ("frequency", 1e6), "ghz": ("frequency", 1e9),
    "w": ("power", 1.0), "kw": ("power", 1000.0),
    "mb": ("data", 1.0), "gb": ("data", 1024.0), "tb": ("data", 1048576.0),
    "cores": ("cores", 1.0), "threads": ("threads", 1.0), "slots": ("slots", 1.0),
}

# Units as pages spell them.
SPELLINGS = {
    "gram": "g", "grams": "g", "gramme": "g", "grammes": "g",
    "kilogram": "kg", "kilograms": "kg", "kilogramme": "kg", "kilogrammes": "kg",
    "milligram": "mg", "milligrams": "mg",
    "ounce": "oz", "ounces": "oz",
    "pound": "lb", "pounds": "lb",
    "millimeter": "mm", "millimeters": "mm", "millimetre": "mm", "millimetres": "mm",
    "centimeter": "cm", "centimeters": "cm", "centimetre": "cm", "centimetres": "cm",
    "meter": "m", "meters": "m", "metre": "m", "metres": "m",
    "inch": "in", "inches": "in", '"': "in", "″": "in",
    "hour": "h", "hours": "h", "hrs": "h",
    "minute": "min", "minutes": "min", "mins": "min",
    "second": "s", "seconds": "s", "secs": "s", "sec": "s",
    "millisecond": "ms", "milliseconds": "ms", "msec": "ms",
    "hertz": "hz",
    "kilohertz": "khz",
    "megahertz": "mhz",
    "gigahertz": "ghz",
    "watt": "w", "watts": "w",
    "kilowatt": "kw", "kilowatts": "kw",
    "megabyte": "mb", "megabytes": "mb",
    "gigabyte": "gb", "gigabytes": "gb",
    "terabyte": "tb", "terabytes": "tb",
    "core": "cores",
    "thread": "threads",
    "slot": "slots",
}

#: Units that a value and its unit are split at: all but the counts.
MEASURED = [u for u, (dim, _) in UNITS.items() if dim != u]


def _lookup(table: dict, x: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), x)


def normalized_unit(x: Column) -> Column:
    """Lower case, without trailing points, spelled-out forms shortened; null if empty."""
    low = F.regexp_replace(F.lower(strip(x)), "[.]+$", "")
    return F.when(low != "", F.coalesce(_lookup(SPELLINGS, low), low))


def converted(value: Column, unit: Column, canonical: Column) -> Column:
    """value in the canonical unit, to six places. No unit: it is canonical already. Unknown or of another kind: null."""
    own = F.coalesce(normalized_unit(unit), normalized_unit(canonical))
    to = normalized_unit(canonical)
    dims, factors = {u: d for u, (d, _) in UNITS.items()}, {u: f for u, (_, f) in UNITS.items()}
    same = F.coalesce(_lookup(dims, own) == _lookup(dims, to), F.lit(False))
    out = F.when(own == to, value).when(same, value * _lookup(factors, own) / _lookup(factors, to))
    return F.round(out, 6)


def quantity(raw: Column, unit: Column, canonical: Column) -> Column:
    return converted(parsed_number(raw), unit, canonical)
