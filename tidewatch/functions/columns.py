"""Small column helpers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_map(values: dict) -> Column:
    """A literal map column."""
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from Python values, held in the plan as one literal: no Python worker reads it."""
    kind = T.StructType.fromDDL(schema)

    def plain(value, dtype):
        if isinstance(dtype, T.ArrayType):
            return [plain(v, dtype.elementType) for v in value]
        if isinstance(dtype, T.StructType):
            return {f.name: plain(v, f.dataType) for f, v in zip(dtype.fields, value)}
        return value

    text = json.dumps([plain(r, kind) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(kind))))


def nested(df: DataFrame, path: str) -> Column:
    """Column at a dotted path, resolved on the schema; null when a part does not exist."""
    missing = F.lit(None).cast("string")
    parts = path.split(".")
    if parts[0] not in df.columns:
        return missing
    col, kind = F.col(f"`{parts[0]}`"), df.schema[parts[0]].dataType
    for i, part in enumerate(parts[1:], start=1):
        if isinstance(kind, T.StructType):
            if part not in kind.fieldNames():
                return missing
            col, kind = col[part], kind[part].dataType
        elif isinstance(kind, T.MapType):
            col, kind = col[part], kind.valueType
        elif isinstance(kind, T.StringType):
            return F.get_json_object(col, "$." + ".".join(parts[i:]))
        else:
            return missing
    return col


def text_of(col: Column) -> Column:
    """Text form in which booleans read true and false."""
    return col.cast("string")


def hash16(col: Column) -> Column:
    """First 16 hex characters of SHA-256; empty text is hashed too."""
    return F.substring(F.sha2(col, 256), 1, 16)
