"""Functions of other SQL dialects that Spark lacks or spells otherwise, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- numbers -----------------------------------------------------------------------------------------------


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero, to a number of decimal digits. Doubles too large to have such digits stay as they are."""
    scale = float(10**digits)
    return F.when(F.abs(x) >= 2.0**53 / scale, x).otherwise(F.signum(x) * F.floor(F.abs(x) * scale) / scale)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers by Euclid's steps; 92 steps are enough for 64 bits."""
    start = F.struct(F.abs(_c(a)).cast("long").alias("a"), F.abs(_c(b)).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple of whole numbers; an error if it takes more than 64 bits."""
    return F.when((_c(a) == 0) | (_c(b) == 0), F.lit(0).cast("long")).otherwise(integer_divide(F.abs(_c(a)).cast("long"), gcd(a, b)) * F.abs(_c(b)).cast("long"))


def integer_divide(a: Column, b: Column) -> Column:
    """Whole-number division toward zero; null for a zero divisor."""
    return F.call_function("div", _c(a).cast("long"), F.nullif(_c(b).cast("long"), F.lit(0).cast("long")))


# --- strings -----------------------------------------------------------------------------------------------


def concat(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def strpos(text: Column, part: str) -> Column:
    return F.instr(text, part)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def regexp_replace_first(text: Column, pattern: str, by: str) -> Column:
    """Replaces the first match only."""
    at = F.regexp_instr(text, F.lit(pattern))
    found = F.regexp_extract(text, f"(?:{pattern})", 0)
    return F.when(at == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + F.length(found), F.length(text))))


def regexp_match(text: Column, pattern: str) -> Column:
    """The groups of the first match as an array (the whole match if there are none); null without a match."""
    import re

    groups = re.compile(pattern).groups
    parts = F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, groups + 1))) if groups else F.array(F.regexp_extract(text, pattern, 0))
    return F.when(F.regexp_like(text, F.lit(pattern)), parts)


def similar_to(text: Column, pattern: str) -> Column:
    """SQL's SIMILAR TO: % and _ as in LIKE, the rest as a regular expression over the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out += "\\" + pattern[i + 1]
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            end = len(pattern) - 1 if end < 0 else end
            out += pattern[i : end + 1]
            i = end
        else:
            out += {"%": ".*", "_": ".", ".": "\\.", "^": "\\^", "$": "\\$"}.get(c, c)
        i += 1
    return F.rlike(text, F.lit(f"^(?s:{out})$"))


# --- times -------------------------------------------------------------------------------------------------


def date_bin(seconds: int, ts: Column, origin: int = 0) -> Column:
    """The start of the bin of so many seconds that holds ts, bins counted from origin (seconds since 1970)."""
    width, start = seconds * 1_000_000, origin * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - start, F.lit(width))).cast("timestamp_ntz")


def to_unixtime(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    micros, second = F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000).cast("long")
    return F.call_function("div", micros - F.pmod(micros, second), second)


def from_unixtime(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


# --- arrays ------------------------------------------------------------------------------------------------


def range_(start: Column, stop: Column, step: int = 1) -> Column:
    """start, start + step, ... before stop."""
    last = _c(stop) - (1 if step > 0 else -1)
    some = _c(start) <= last if step > 0 else _c(start) >= last
    return F.when(some, F.sequence(_c(start), last, F.lit(step))).otherwise(F.slice(F.array(_c(start)), 1, 0))


def array_has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def array_has_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


# --- types -------------------------------------------------------------------------------------------------

# Arrow's names of types and Spark's.
ARROW = {"Boolean": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "Float32": "float", "Float64": "double", "Utf8": "string", "Binary": "binary", "Date32": "date", "Timestamp(Microsecond, None)": "timestamp_ntz"}


def arrow_cast(x: Column, name: str) -> Column:
    """A cast to a type by its Arrow name."""
    import re

    decimal = re.fullmatch(r"Decimal128\((\d+), (\d+)\)", name)
    if not decimal and name not in ARROW:
        raise ValueError(f"no Arrow type {name}")
    return x.cast(f"decimal({decimal[1]},{decimal[2]})" if decimal else ARROW[name])


def arrow_typeof(x: Column) -> Column:
    """The Arrow name of a value's type; Spark's own where that has none here."""
    kind, names = F.typeof(x), F.create_map(*(F.lit(t) for name, spark in ARROW.items() for t in (spark, name)))
    decimal = F.regexp_replace(kind, r"^decimal\((\d+),(\d+)\)$", "Decimal128($1, $2)")
    return F.coalesce(F.try_element_at(names, kind), decimal)
