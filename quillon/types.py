"""The engine's types: names in SQL, Spark types, and the rules for writing values.

bool, int (32 bits), long (64 bits), float (32 bits in tables, double in expressions), string(n) and bytes. A string column keeps its
declared length in the field's metadata; longer values are cut when written.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import EngineError, ParseError, TypeMismatch

LENGTH = "quillon.length"
_PLAIN = {"bool": T.BooleanType, "boolean": T.BooleanType, "int": T.IntegerType, "integer": T.IntegerType, "long": T.LongType, "float": T.FloatType}
_SIZED = ("char", "varchar", "string")

#: Kinds that arithmetic takes, in order of rank: the result has the highest kind among int, long and float.
NUMERIC = ("bool", "int", "long", "float")


def kind_of(data_type: T.DataType) -> str:
    """bool, int, long, float, string, bytes; or other, which can only be compared, grouped and passed on."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType):
        return "int"
    if isinstance(data_type, T.LongType):
        return "long"
    if isinstance(data_type, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string"
    return "bytes" if isinstance(data_type, T.BinaryType) else "other"


def wider(*kinds: str) -> str:
    """The kind of an arithmetic result; bool counts as int."""
    for k in kinds:
        if k not in NUMERIC:
            raise TypeMismatch(f"arithmetic takes numbers, not {k}")
    return "float" if "float" in kinds else "long" if "long" in kinds else "int"


def field(name: str, type_name: str, length: int | None = None) -> T.StructField:
    low = type_name.lower()
    if low in _SIZED:
        if length is None:
            raise ParseError(f"{type_name} needs a length")
        if length < 1:
            raise ParseError("a string's length is at least 1")
        return T.StructField(name, T.StringType(), True, {LENGTH: length})
    if low not in _PLAIN:
        raise ParseError(f"unknown type {type_name!r}")
    if length is not None:
        raise ParseError(f"{type_name} takes no length")
    return T.StructField(name, _PLAIN[low](), True)


def type_name(f: T.StructField) -> str:
    if isinstance(f.dataType, T.StringType) and LENGTH in f.metadata:
        return f"string({f.metadata[LENGTH]})"
    return {"bytes": "byte_array", "other": f.dataType.simpleString()}.get(k := kind_of(f.dataType), k)


def written(schema: T.StructType, values: list) -> tuple:
    """The row that is written for these values: int goes into float columns, strings are cut; anything else must fit exactly."""
    if len(values) != len(schema):
        raise EngineError(f"{len(schema)} values are needed, {len(values)} were given")
    out = []
    for f, v in zip(schema, values, strict=True):
        kind = kind_of(f.dataType)
        is_int = isinstance(v, int) and not isinstance(v, bool)
        fits = {"bool": isinstance(v, bool), "int": is_int and -(2**31) <= v < 2**31, "long": is_int and not -(2**31) <= v < 2**31, "float": is_int or isinstance(v, float), "string": isinstance(v, str), "bytes": isinstance(v, bytes)}
        # a literal has no type of its own between int and long: any whole number goes into a long column
        if not (fits.get(kind, False) or kind == "long" and is_int):
            raise TypeMismatch(f"{v!r} does not fit {f.name} {type_name(f)}")
        out.append(float(v) if kind == "float" else v[: f.metadata[LENGTH]] if kind == "string" and LENGTH in f.metadata else v)
    return tuple(out)


def parsed(text: str, f: T.StructField):
    """A CSV cell as a value of the column."""
    kind = kind_of(f.dataType)
    return text == "true" if kind == "bool" else int(text) if kind in ("int", "long") else float(text) if kind == "float" else text
