"""Statistics over ordered sequences: dictionaries, deltas, repeats, predecessors and model choice.

Each takes rows with seq and seg and starts anew with each segment, so its windows
are bounded by a segment and run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.eventlog import within
from .ranges import running

#: Observations between two choices of a model, and events looked back on.
BLOCK, LOOKBACK = 256, 5
#: What a sequence without variety scores.
MAX_SCORE = (1 << 63) - 1


def interned(log: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds is_new and symbol: the number, from 1, of the value's first occurrence (within by)."""
    first = log.groupBy(*by, value).agg(F.min("seq").alias("first_seq"))
    if by:
        first = first.withColumn("symbol", F.row_number().over(Window.partitionBy(*by).orderBy("first_seq")).cast("long"))  # a row for each value
    else:
        first = running(first, "first_seq", F.lit(1)).withColumn("symbol", F.col("before") + 1).drop("before")
    return log.join(first, [*by, value]).withColumn("is_new", F.col("seq") == F.col("first_seq")).drop("first_seq")


def delta(value: str) -> Column:
    """Difference from the value before, the first from 0."""
    return F.col(value) - F.lag(value, 1, 0).over(within())


def undelta(value: str) -> Column:
    return F.sum(value).over(within().rowsBetween(Window.unboundedPreceding, 0))


def quantised(log: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Adds quantised and width: times at two-microsecond steps from an absolute anchor, and their bytes.

    The first event, a step back and a gap of 2 ** 31 us or more give an absolute
    time (9 bytes); others take 2, 3 or 4 bytes by half their distance.
    """
    prev = F.lag(ts).over(within())
    gap = F.col(ts) - prev
    anchor = F.when(prev.isNull() | (gap < 0) | (gap >= 1 << 31), F.col(ts))
    rows = log.withColumn("__anchor", F.last(anchor, ignorenulls=True).over(within())).withColumn("__new", anchor.isNotNull())
    rows = rows.withColumn("quantised", F.col(ts) - (F.col(ts) - F.col("__anchor")).bitwiseAND(1))
    half = F.shiftright(F.col("quantised") - F.lag("quantised").over(within()), 1)
    width = F.when(F.col("__new"), 9).when(half < 1 << 14, 2).when(half < 1 << 22, 3).otherwise(4)
    return rows.withColumn("width", width).drop("__anchor", "__new")


def repeats(value: str) -> Column:
    """Whether the value is the last one again; the last one before any is 0."""
    return F.col(value) == F.lag(value, 1, 0).over(within())


def lookback(value: str, k: int = LOOKBACK) -> Column:
    """The last k values, most recent first, 0 where there is none."""
    return F.array(*(F.lag(value, i, 0).over(within()) for i in range(1, k + 1)))


def transitions(log: DataFrame, value: str) -> DataFrame:
    """prev, next, n: how often next follows prev in a segment."""
    rows = log.select(F.lag(value).over(within()).alias("prev"), F.col(value).alias("next")).where("prev is not null")
    return rows.groupBy("prev", "next").agg(F.count("*").alias("n"))


def predecessors(log: DataFrame, value: str, k: int = LOOKBACK) -> DataFrame:
    """seg, prev, next: next comes within k events of prev somewhere in the segment."""
    back = F.array(*(F.lag(value, i).over(within()) for i in range(1, k + 1)))
    rows = log.select("seg", back.alias("back"), F.col(value).alias("next")).select("seg", F.explode("back").alias("prev"), "next")
    return rows.where("prev is not null").distinct()


def block() -> Column:
    """Number of the block of BLOCK rows in its segment."""
    return F.floor((F.row_number().over(within()) - 1) / BLOCK).cast("long")


def score(groups: list[str], rows: DataFrame, value: str) -> DataFrame:
    """groups, score: sum of squared frequencies, by number of values (whole part); MAX_SCORE if all are alike."""
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("f"))
    sums = counts.groupBy(*groups).agg(F.sum(F.col("f") * F.col("f")).alias("s"), F.count("*").alias("d"))
    return sums.select(*groups, F.when(F.col("d") <= 1, F.lit(MAX_SCORE)).otherwise(F.expr("s div d")).alias("score"))


def _so_far(value: str) -> tuple[Column, Column]:
    """Of the rows so far: the sum of squared frequencies grows by 2 k - 1 with a value's k-th occurrence."""
    k = F.row_number().over(within(value))
    return 2 * k - 1, (k == 1).cast("long")


def model_scores(log: DataFrame, value: str) -> DataFrame:
    """seg, block, bytes_score, intern_score, diff_score, chosen: which model the rows so far favour at each block's end.

    Bytes are the default and keep ties. Scores are those of the low four bytes
    (summed, saturating), of the values and of their differences.
    """
    rows = log.withColumn("__diff", delta(value)).withColumn("block", block())
    for i in range(4):
        rows = rows.withColumn(f"__b{i}", F.shiftright(F.col(value), 8 * i).bitwiseAND(255))
    names = {"intern": value, "diff": "__diff"} | {f"b{i}": f"__b{i}" for i in range(4)}
    for name, col in names.items():
        square, new = _so_far(col)
        rows = rows.withColumn(f"__s_{name}", square).withColumn(f"__d_{name}", new)
    run = within().rowsBetween(Window.unboundedPreceding, 0)
    for name in names:
        rows = rows.withColumn(f"__s_{name}", F.sum(f"__s_{name}").over(run)).withColumn(f"__d_{name}", F.sum(f"__d_{name}").over(run))
    ends = rows.groupBy("seg", "block").agg(*(F.max(f"__{x}_{n}").alias(f"{x}_{n}") for n in names for x in "sd"))
    one = {n: F.when(F.col(f"d_{n}") <= 1, F.lit(MAX_SCORE)).otherwise(F.expr(f"s_{n} div d_{n}")) for n in names}
    flat = F.greatest(*(one[f"b{i}"] for i in range(4))) == MAX_SCORE
    total = F.when(flat, F.lit(MAX_SCORE)).otherwise(sum((F.when(flat, F.lit(0)).otherwise(one[f"b{i}"]) for i in range(4)), F.lit(0)))
    out = ends.select("seg", "block", total.alias("bytes_score"), one["intern"].alias("intern_score"), one["diff"].alias("diff_score"))
    most = F.greatest("bytes_score", "intern_score", "diff_score")
    chosen = F.when(F.col("bytes_score") == most, "bytes").when(F.col("intern_score") == most, "intern").otherwise("diff")
    return out.withColumn("chosen", chosen)


def copy_rates(log: DataFrame, value: str, predecessor: Column) -> DataFrame:
    """seg, block, n, n_same, copies: the predecessor is copied where it agrees in half of the block or more."""
    rows = log.select("seg", block().alias("block"), (F.col(value) == predecessor).alias("same"))
    sums = rows.groupBy("seg", "block").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))
    return sums.withColumn("copies", 2 * F.col("n_same") >= F.col("n"))


def difference_sums(log: DataFrame, value: str, k: int = 2) -> DataFrame:
    """seg, block, sum_1 .. sum_k of |value - the i-th value before, or 0|, and best: the i of the least sum."""
    far = [F.abs(F.col(value) - F.lag(value, i, 0).over(within())).alias(f"d{i}") for i in range(1, k + 1)]
    rows = log.select("seg", block().alias("block"), *far)
    sums = rows.groupBy("seg", "block").agg(*(F.sum(f"d{i}").alias(f"sum_{i}") for i in range(1, k + 1)))
    best = F.array_position(F.array(*(f"sum_{i}" for i in range(1, k + 1))), F.least(*(f"sum_{i}" for i in range(1, k + 1))))
    return sums.withColumn("best", best)


def field_pairs(rows: DataFrame, fields: list[str]) -> DataFrame:
    """a, b, n_same, sum_diff for each field and those before it: which field predicts which."""
    pairs = [(a, b) for i, b in enumerate(fields) for a in fields[:i]]
    aggs = [x for a, b in pairs for x in (F.count_if(F.col(a) == F.col(b)).alias(f"{a}|{b}|same"), F.sum(F.abs(F.col(a) - F.col(b))).alias(f"{a}|{b}|diff"))]
    one = rows.agg(*aggs)
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}|same`").alias("n_same"), F.col(f"`{a}|{b}|diff`").cast("long").alias("sum_diff")) for a, b in pairs]
    return one.select(F.explode(F.array(*each)).alias("p")).select("p.*")
