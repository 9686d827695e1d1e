"""String functions with literal (not regular-expression) delimiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def to_number(s: Column, default: int = 0) -> Column:
    """Parse, with a default instead of an error."""
    return F.coalesce(s.try_cast("long"), F.lit(default))


def lower_ascii(s: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(s, _UPPER, _LOWER)


def split_all(s: Column, delimiter: str) -> Column:
    """All parts, empty ones too; an empty delimiter leaves the text whole."""
    return F.split(s, "\\Q" + delimiter + "\\E", -1) if delimiter else F.array(s)


def split_first(s: Column, delimiter: str) -> Column:
    """(left, right) at the first delimiter; (s, "") without one."""
    at = F.instr(s, delimiter)
    return F.struct(F.when(at > 0, F.left(s, at - 1)).otherwise(s).alias("left"), F.when(at > 0, F.substr(s, at + len(delimiter))).otherwise("").alias("right"))


def split_last(s: Column, delimiter: str) -> Column:
    """(left, right) at the last delimiter; ("", s) without one."""
    tail = F.substring_index(s, delimiter, -1)
    left = F.when(F.instr(s, delimiter) > 0, F.left(s, F.length(s) - F.length(tail) - len(delimiter))).otherwise("")
    return F.struct(left.alias("left"), tail.alias("right"))


def joined(parts: Column, delimiter: str) -> Column:
    return F.array_join(parts, delimiter)


def bounded(s: Column, size: int) -> Column:
    """A text in a field of fixed capacity."""
    return F.left(s, F.lit(size))


def rendered(rows: DataFrame, columns: list[str], gap: str = " ") -> DataFrame:
    """line: the columns as a text table, each but the last right-aligned to its widest cell or name."""
    text = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    wide = text.agg(*(F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"__{c}") for c in columns))
    cells = [F.lpad(c, F.col(f"__{c}"), " ") for c in columns[:-1]] + [F.col(columns[-1])]
    return text.crossJoin(F.broadcast(wide)).select(*columns, F.concat_ws(gap, *cells).alias("line"))  # wide is one row
