"""Rendering of times and durations, and durations of any scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a timespan in microseconds, largest first: fixed values of the text form.
PARTS = (("d", 86_400_000_000), ("h", 3_600_000_000), ("m", 60_000_000), ("s", 1_000_000), ("ms", 1_000), ("us", 1))


def datetime_text(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.uuuuuu, always in full and in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def timespan_text(us: Column) -> Column:
    """Such as -1d2h3m4s5ms6us: parts that are zero are left out, and nothing is 0s."""
    rest, parts = F.abs(us), []
    for name, size in PARTS:
        n = F.floor(rest / size).cast("long")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))))
        rest = rest % size
    return F.when(us == 0, "0s").otherwise(F.concat(F.when(us < 0, "-").otherwise(""), F.concat_ws("", *parts)))


def seconds(value: Column, n: int, d: int) -> Column:
    """Of a duration that counts n / d seconds."""
    return value * n / d


def microseconds(value: Column, n: int, d: int) -> Column:
    """Whole microseconds, cut towards zero."""
    return (value.cast("decimal(38,0)") * (n * 1_000_000) / d).cast("long")
