"""Measures in the shape of a type, in long form: path (of field names) and value.

Adding, mapping and folding measures are then group-bys and projections that never
depend on how deep the type is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Paths and types of a record's fields that are no records."""
    out: list[tuple[tuple[str, ...], T.DataType]] = []
    for f in schema.fields:
        out += leaves(f.dataType, (*prefix, f.name)) if isinstance(f.dataType, T.StructType) else [((*prefix, f.name), f.dataType)]
    return out


#: Bytes of values of fixed size.
FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def sizes(kind: T.DataType, value: Column, path: str = "") -> dict[str, Column]:
    """Bytes of each leaf of a value of any depth; `[]` marks an array's elements, whose number is a leaf too, and `?` the values of a map."""
    match kind:
        case T.StructType():
            return {p: c for f in kind.fields for p, c in sizes(f.dataType, value.getField(f.name), f"{path}.{f.name}".lstrip(".")).items()}
        case T.ArrayType():
            none = F.lit(0).cast("long")

            def summed(p: str) -> Column:
                return F.aggregate(F.transform(value, lambda x: F.coalesce(sizes(kind.elementType, x)[p].cast("long"), none)), none, lambda a, x: a + x)

            sums = {p: summed(p) for p in sizes(kind.elementType, F.lit(None).cast(kind.elementType))}
            return {f"{path}[]": F.when(value.isNull(), 0).otherwise(F.size(value))} | {f"{path}[].{p}".rstrip("."): c for p, c in sums.items() if p}
        case T.MapType():
            return sizes(T.ArrayType(kind.keyType), F.map_keys(value), path) | sizes(T.ArrayType(kind.valueType), F.map_values(value), f"{path}?")
    return {path: F.octet_length(value) if isinstance(kind, T.StringType | T.BinaryType) else F.when(value.isNotNull(), FIXED.get(type(kind), 16))}


def long_form(rows: DataFrame, keys: list[str], of: dict[str, Column]) -> DataFrame:
    """keys, path, value: a row for each leaf."""
    each = F.array(*(F.struct(F.lit(path).alias("path"), value.cast("long").alias("value")) for path, value in of.items()))
    return rows.select(*keys, F.explode(each).alias("m")).select(*keys, "m.path", "m.value")


def mapped(measure: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return measure.withColumn("value", f(F.col("value")))


def zipped(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """path, value of what both have; paths of one alone drop out."""
    return a.select("path", F.col("value").alias("x")).join(b.select("path", F.col("value").alias("y")), "path").select("path", f(F.col("x"), F.col("y")).alias("value"))


def total(measure: DataFrame, keys: list[str]) -> DataFrame:
    return measure.groupBy(*keys).agg(F.sum("value").alias("total"))


def added(measure: DataFrame, keys: list[str]) -> DataFrame:
    """The element-wise sum of many measures."""
    return measure.groupBy(*keys, "path").agg(F.sum("value").alias("value"))


def storage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, value: bytes of each field's values as text of their own type, by key."""
    size = {c: F.octet_length(F.col(c).cast("string")) for c in rows.columns if c not in keys}
    return added(long_form(rows, keys, size), keys)
