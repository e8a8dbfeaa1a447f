"""CSV files whose first line declares the columns: `name type` cells, as in `sid int,name string(20)`. Cells are not quoted."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..errors import ParseError

_CELL = re.compile(r"\s*(\S+)\s+(\w+)\s*(?:\(\s*(\d+)\s*\))?\s*")


def header(line: str) -> T.StructType:
    fields = []
    for cell in line.split(","):
        m = _CELL.fullmatch(cell)
        if not m:
            raise ParseError(f"a header cell is `name type`, not {cell!r}")
        fields.append(types.field(m[1], m[2], int(m[3]) if m[3] else None))
    return T.StructType(fields)


def _cell(text: Column, f: T.StructField) -> Column:
    kind = types.kind_of(f.dataType)
    return text == "true" if kind == "bool" else F.trim(text).cast(f.dataType) if kind != "string" else F.substring(text, 1, f.metadata[types.LENGTH])


def read(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        raise ParseError(f"{path} has no header")
    schema = header(first[0])
    # the header names types, which no row can equal
    cells = F.split(F.col("value"), ",", -1)
    rows = lines.where((F.col("value") != first[0]) & (F.col("value") != ""))
    return rows.select(*[_cell(F.get(cells, F.lit(i)), f).alias(f.name) for i, f in enumerate(schema)]).to(schema)


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    return header(spark.read.text(path).first()[0])
