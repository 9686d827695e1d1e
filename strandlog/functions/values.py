"""Value semantics of records, enums and tagged unions."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


def arith(op: str, a: list[Column], b: list[Column], names: list[str]) -> Column:
    """Field by field."""
    return F.struct(*(OPS[op](x, y).alias(n) for x, y, n in zip(a, b, names, strict=True)))


def ordinal(value: Column, names: list[str]) -> Column:
    """Position of a constructor, null if there is no such one."""
    return F.when(F.array_contains(F.lit(names), value), F.array_position(F.lit(names), value) - 1)


def from_ordinal(n: Column, names: list[str]) -> Column:
    return F.get(F.lit(names), n.cast("int"))


def enum_text(n: Column, names: list[str]) -> Column:
    """|Name|, or ?value=N? for an ordinal without a name."""
    return F.coalesce(F.concat(F.lit("|"), from_ordinal(n, names), F.lit("|")), F.concat(F.lit("?value="), n.cast("string"), F.lit("?")))


def enum_value(n: Column, values: list[int]) -> Column:
    """The explicit value of an ordinal; 0 for an unknown one."""
    return F.coalesce(F.get(F.lit(values), n.cast("int")), F.lit(0)).cast("long")


def tuple_text(*fields: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *(f.cast("string") for f in fields)), F.lit(")"))


def record_text(**fields: Column) -> Column:
    return F.concat(F.lit("{ "), F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in fields.items())), F.lit(" }"))


def variant_text(tag: Column, value: Column) -> Column:
    return F.concat(F.lit("|"), tag.cast("string"), F.lit("="), value.cast("string"), F.lit("|"))


def variant(tag: Column, **branches: Column) -> Column:
    """A tagged union: one branch holds a value, the others are null."""
    return F.struct(tag.alias("tag"), *(F.when(tag == name, value).alias(name) for name, value in branches.items()))


def case(union: Column, **branches: Callable[[Column], Column]) -> Column:
    """Dispatch on the tag; every constructor needs a branch, an unknown tag is an error."""
    out = None
    for name, f in branches.items():
        hit = (union.getField("tag") == name, f(union.getField(name)))
        out = F.when(*hit) if out is None else out.when(*hit)
    return out.otherwise(F.raise_error(F.concat(F.lit("no case for "), union.getField("tag"))))


def some(condition: Column, value: Column) -> Column:
    """An optional value."""
    return F.when(condition, value)


def unrolled(items: Column) -> Column:
    """A list ^x.(()+(t*x)) as the text of its nested pairs: (1, (2, ()))."""
    opened = F.concat_ws("", F.transform(items, lambda x: F.concat(F.lit("("), x.cast("string"), F.lit(", "))))
    return F.concat(opened, F.lit("()"), F.repeat(F.lit(")"), F.size(items)))
