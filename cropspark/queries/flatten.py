"""Bring a result to plain comparable columns: no nested types, dates as text, rounded doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    def expand(col, name: str, dtype):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from expand(col[f.name], f"{name}_{f.name}", f.dataType)
        elif isinstance(dtype, T.MapType):
            for key in ("low", "medium", "high"):
                yield from expand(F.element_at(col, key), f"{name}_{key}", dtype.valueType)
        elif isinstance(dtype, T.ArrayType):
            yield F.array_join(col.cast("array<string>"), "|").alias(name)
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            yield (F.bround(col.cast("double"), digits) + F.lit(0.0)).alias(name)
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            yield col.cast("string").alias(name)
        elif isinstance(dtype, T.BooleanType):
            yield col.cast("int").alias(name)
        else:
            yield col.alias(name)

    return df.select(*[c for f in df.schema.fields for c in expand(F.col(f"`{f.name}`"), f.name, f.dataType)])
