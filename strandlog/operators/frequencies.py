"""Frequency tables: cumulative ranges, scaling, running probabilities, bytes and code lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.eventlog import within
from .ranges import running as cumulated

#: Most that scaled frequencies sum to, and the values a model interns.
MAX_TOTAL, INTERNED = 16383, 255


def ranges(rows: DataFrame, symbol: str) -> DataFrame:
    """symbol, n, low, high: [low, high) of each symbol in symbol order. A row for each symbol."""
    counts = rows.groupBy(symbol).agg(F.count("*").alias("n"))
    return cumulated(counts, symbol, F.col("n")).withColumnRenamed("before", "low").withColumn("high", F.col("low") + F.col("n"))


def find(table: DataFrame, probes: DataFrame, symbol: str) -> DataFrame:
    """v, symbol: the symbol whose range holds v. Ranges and probes meet by stretches of an average range's length, of which ranges touch two each on average."""
    most = table.agg(F.max("high").alias("high"), F.count("*").alias("n")).first()  # one row
    step = max(1, (most.high or 0) // max(1, most.n))
    cut = table.withColumn("stretch", F.explode(F.sequence(F.expr(f"low div {step}"), F.expr(f"(high - 1) div {step}"))))
    at = probes.withColumn("stretch", F.expr(f"v div {step}"))
    return at.join(cut, "stretch").where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("high"))).select("v", symbol)


def normalised(rows: DataFrame, symbol: str, most: int = MAX_TOTAL) -> DataFrame:
    """symbol, n, scaled: in proportion, 1 at least, so that they sum to about `most`."""
    counts = rows.groupBy(symbol).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(symbol, "n", F.greatest(F.lit(1), F.expr(f"n * {most} div total")).cast("long").alias("scaled"))  # total is one row


def running(log: DataFrame, symbol: str) -> DataFrame:
    """seq, symbol_before, all_before: what an adaptive model has counted in the segment before each event."""
    return log.select("seq", (F.row_number().over(within(symbol)) - 1).cast("long").alias("symbol_before"), (F.row_number().over(within()) - 1).cast("long").alias("all_before"))


def adaptive(flag: Column) -> Column:
    """P(true) before each event, from one of two: (1 + true so far) / (2 + all so far)."""
    before = within().rowsBetween(Window.unboundedPreceding, -1)
    return (1 + F.coalesce(F.sum(flag.cast("long")).over(before), F.lit(0))) / (2 + F.count(F.lit(1)).over(before))


def byte_histogram(rows: DataFrame, value: str, size: int) -> DataFrame:
    """byte_no (0: lowest), byte, n."""
    each = F.array(*(F.struct(F.lit(i).alias("byte_no"), F.shiftright(F.col(value), 8 * i).bitwiseAND(255).alias("byte")) for i in range(size)))
    return rows.select(F.explode(each).alias("b")).groupBy("b.byte_no", "b.byte").agg(F.count("*").alias("n"))


def code_bits(rows: DataFrame, groups: list[str], symbol: str) -> DataFrame:
    """groups, n, bits: what the symbols of a group cost under their own frequencies."""
    counts = rows.groupBy(*groups, symbol).agg(F.count("*").alias("f"))
    sums = counts.groupBy(*groups).agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.log2("f")).alias("s"))
    return sums.select(*groups, "n", (F.col("n") * F.log2("n") - F.col("s")).alias("bits"))


def entropies(rows: DataFrame, value: str, given: str) -> DataFrame:
    """n, h, h_given: bits for each event without and with a model for each value of `given`."""
    alone = code_bits(rows, [], value).select("n", (F.col("bits") / F.col("n")).alias("h"))
    each = code_bits(rows, [given], value).agg((F.sum("bits") / F.sum("n")).alias("h_given"))
    return alone.crossJoin(each)  # one row each


def interned(rows: DataFrame, value: str, most: int = INTERNED) -> DataFrame:
    """value, n, code (1 for the most frequent) of the typical values; all others are code 0, escaped."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), value).limit(most)  # the feature: at most so many are interned
    return top.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), value)).cast("long"))
