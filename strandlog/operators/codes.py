"""Dictionary coding of strings, whose dictionary grows with each string of a segment."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.eventlog import within

#: Codes below this are single bytes; 0 ends a string.
FIRST = 256


def encode(strings: Iterable[bytes]) -> list[list[int]]:
    """The codes of each string; what one string teaches serves the next."""
    known: dict[tuple[int, int], int] = {}
    out = []
    for s in strings:
        codes, at = [], None
        for byte in s:
            if at is None:
                at = byte
            elif (at, byte) in known:
                at = known[at, byte]
            else:
                codes.append(at)
                known[at, byte] = FIRST + len(known)
                at = byte
        out.append([*codes, *([] if at is None else [at]), 0])
    return out


def decode(coded: Iterable[list[int]]) -> list[bytes]:
    words: list[bytes] = []
    out = []
    for codes in coded:
        text, last = b"", None
        for c in codes[:-1]:
            if c < FIRST:
                word = bytes([c])
            elif c - FIRST < len(words):
                word = words[c - FIRST]
            else:
                word = last + last[:1]
            if last is not None:
                words.append(last + word[:1])
            text, last = text + word, word
        out.append(text)
    return out


#: Bytes of strings that share a dictionary, about.
BLOCK = 8 << 20


def lzw(log: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """seq, block (of its segment), codes of each string. A dictionary depends on order and serves a block of a segment, which one task holds."""

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame({"seq": rows["seq"], "block": rows["block"], "codes": [",".join(map(str, c)) for c in encode(x.encode() for x in rows[value].fillna(""))]})

    so_far = F.coalesce(F.sum(F.octet_length(value)).over(within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.select("seg", "seq", value, F.floor(so_far / block).cast("long").alias("block"))
    return rows.groupBy("seg", "block").applyInPandas(code, "seq long, block long, codes string")
