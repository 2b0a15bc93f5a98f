"""Column types of versioned tables: what may be declared, and the Spark type that holds it.

A field's original type is kept in its metadata under `type`, so that a widened type is known and its range checked.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType()}
_UNSIGNED = {"uint8": (T.ShortType(), 8), "uint16": (T.IntegerType(), 16), "uint32": (T.LongType(), 32), "uint64": (T.DecimalType(20, 0), 64)}
_PLAIN = {
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "utf8": T.StringType(), "large_utf8": T.StringType(), "utf8_view": T.StringType(),
    "binary": T.BinaryType(), "large_binary": T.BinaryType(), "binary_view": T.BinaryType(), "date32": T.DateType(), "date64": T.DateType(), "time32": T.LongType(), "time64": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamp_tz": T.TimestampType(),
}
#: SQL names of types.
SQL_TYPES = {
    "smallint": "int16", "int": "int32", "integer": "int32", "bigint": "int64", "float": "float32", "real": "float32", "double": "float64", "double precision": "float64", "boolean": "bool", "bool": "bool", "varchar": "utf8", "text": "utf8", "string": "utf8", "date": "date32",
    "timestamp": "timestamp", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamp_tz", "timestamptz": "timestamp_tz",
}
#: Types whose stored minima and maxima may prune files.
PRUNABLE = {*_INTS, *_UNSIGNED, "float16", "float32", "float64", "bool", "utf8", "date32", "date64", "time32", "time64", "timestamp", "timestamp_tz"}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a declared type; a type that isn't in the registry is an error."""
    name = name.strip().lower()
    for known in (_INTS, _PLAIN):
        if name in known:
            return known[name]
    if name in _UNSIGNED:
        return _UNSIGNED[name][0]
    if m := re.fullmatch(r"decimal(?:128|256)?\((\d+),\s*(-?\d+)\)", name):
        precision, scale = int(m[1]), int(m[2])
        if scale < 0:
            precision, scale = precision - scale, 0
        if not 1 <= precision <= 76:
            raise ValueError(f"{name} is out of range")
        return T.DecimalType(precision, scale) if precision <= 38 else T.StringType()  # wider ones as canonical text
    if m := re.fullmatch(r"(?:large_)?list<(.+)>", name) or re.fullmatch(r"fixed_size_list<(.+),\s*\d+>", name):
        item = spark_type(m[1])
        if isinstance(item, T.ArrayType):
            raise ValueError("lists of lists aren't supported")
        return T.ArrayType(item)
    raise ValueError(f"{name} isn't a column type")


def is_prunable(name: str) -> bool:
    return name in PRUNABLE or bool(re.fullmatch(r"decimal\d*\(.*\)", name))


def sql_type(text: str) -> str:
    """The registry's name for a type of CREATE TABLE."""
    low = re.sub(r"\s*([(),])\s*", r"\1", " ".join(text.lower().split()))
    if low in SQL_TYPES:
        return SQL_TYPES[low]
    if m := re.fullmatch(r"varchar\s*\(\d+\)", low):
        return "utf8"
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\((\d+)\s*,\s*(\d+)\)", low):
        return f"decimal({m[1]},{m[2]})"
    raise ValueError(f"{text} isn't a column type")


def field(name: str, kind: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, spark_type(kind), nullable, {"type": kind.lower()})


def schema(columns: list[tuple]) -> T.StructType:
    """(name, type) or (name, type, nullable) of each column."""
    return T.StructType([field(*c) for c in columns])


def check_ranges(rows: DataFrame, schema: T.StructType) -> None:
    """Widened types keep their own range: unsigned numbers, and lists of fixed size."""
    bad = []
    for f in schema.fields:
        kind = f.metadata.get("type", "")
        if kind in _UNSIGNED:
            bits = _UNSIGNED[kind][1]
            bad.append((F.col(f.name) < 0) | (F.col(f.name) > F.lit(str(2**bits - 1)).cast("decimal(20,0)")))
        if m := re.fullmatch(r"fixed_size_list<.+,\s*(\d+)>", kind):
            bad.append(F.size(f.name) != int(m[1]))
    if bad and rows.filter(reduce(lambda a, b: a | b, bad)).take(1):
        raise ValueError("a value is out of the range of its column's type")


def evolved(old: T.StructType, new: T.StructType, pk: list[str]) -> T.StructType:
    """The schema after an ALTER: columns may be added (nullable) or dropped, never change type; keys stay."""
    had = {f.name: f for f in old.fields}
    for f in new.fields:
        if f.name in had:
            if had[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} can't change its type")
        elif not f.nullable:
            raise ValueError(f"new column {f.name} must be nullable")
    if missing := [c for c in pk if c not in new.fieldNames()]:
        raise ValueError(f"primary key columns {missing} can't be dropped")
    return new
