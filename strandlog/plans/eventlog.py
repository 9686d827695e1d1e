"""The event log as a DataFrame: seq (position, from 1), seg (segment), series, ts_us, and the payload.

Position is the order of a log; time is payload. A position is a rank in its
segment plus the counts of the segments before, so no window spans the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commands of the control series.
DEFINE, RESET, TERMINATE = 0, 1, 2


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")


def ordered(rows: DataFrame, order: list[str], seg: str = "seg") -> DataFrame:
    """Adds seq; segments are in the order of seg, rows in a segment in the total order given."""
    counts = rows.groupBy(seg).count()  # a row for each segment
    upto = Window.orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(seg, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("seq_before"))
    own = F.row_number().over(Window.partitionBy(seg).orderBy(*order))
    return rows.withColumn("seq", own).join(before, seg).withColumn("seq", F.col("seq") + F.col("seq_before")).drop("seq_before")


def from_events(events: DataFrame) -> DataFrame:
    """The log of the supplied events: a series for each event_type, a segment for each day."""
    rows = events.withColumn("seg", day("ts")).withColumn("ts_us", micros("ts")).withColumn("cents", F.floor(F.col("value") * 100).cast("long"))
    return ordered(rows, ["ts", "event_id"]).withColumnRenamed("event_type", "series")


def within(*more: str) -> Window:
    """In log order within a segment (and more keys): statistics start anew with each segment."""
    return Window.partitionBy("seg", *more).orderBy("seq")


def registry(log: DataFrame) -> DataFrame:
    """id (from 1, in order of first events), series, first_seq, n_events."""
    found = log.groupBy("series").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_events"))
    return found.withColumn("id", F.row_number().over(Window.orderBy("first_seq")).cast("long"))  # a row for each series


def lookup(registry: DataFrame, names: DataFrame, at: int) -> DataFrame:
    """name, id, status of each name as of position at: defined, not yet defined, or no such series."""
    found = names.join(registry, names["name"] == registry["series"], "left")
    status = F.when(F.col("id").isNull(), "no such series").when(F.col("first_seq") > at, "not yet defined").otherwise("defined")
    return found.select("name", "id", status.alias("status"))


def with_id(log: DataFrame, registry: DataFrame) -> DataFrame:
    return log.join(registry.select("series", F.col("id").alias("series_id")), "series")


#: Series that a word of an index has bits for.
WORD = 63


def segment_index(log: DataFrame, registry: DataFrame) -> DataFrame:
    """seg, word, first_seq, n_events, series_bits: which of series WORD * word + 1 .. WORD * (word + 1) a segment has, from bit 0.

    A row for each word that is not empty, however many series there are. Complete for every segment.
    """
    bit = F.expr(f"shiftleft(1L, cast((series_id - 1) % {WORD} as int))")
    rows = with_id(log, registry).withColumn("word", F.expr(f"(series_id - 1) div {WORD}"))
    return rows.groupBy("seg", "word").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_events"), F.bit_or(bit).alias("series_bits"))


def pruned(log: DataFrame, index: DataFrame, registry: DataFrame, name: str) -> DataFrame:
    """The events of one series, from segments whose index (a table that is there already) has it."""
    at = registry.where(F.col("series") == name).select((F.col("id") - 1).alias("at")).first()
    if at is None:
        return log.where("false")
    segs = index.where(f"word = {at[0] // WORD} and getbit(series_bits, {at[0] % WORD}) = 1").select("seg")
    return log.where(F.col("series") == name).join(segs, "seg", "left_semi")


def rollover(log: DataFrame, size: Column, limit: int) -> DataFrame:
    """seq, bytes, segment: a new segment begins with the event after which limit more bytes are there."""
    rows = log.withColumn("bytes", size.cast("long"))
    sums = rows.groupBy("seg").agg(F.sum("bytes").alias("__sum"))
    before = sums.select("seg", F.coalesce(F.sum("__sum").over(Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum("bytes").over(within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__own", own).join(before, "seg")
    return rows.select("seq", "bytes", F.expr(f"(__own + __before) div {limit}").alias("segment"))


def control(log: DataFrame) -> DataFrame:
    """seq, command, name: definitions before a series' first event, resets before later segments, the end."""
    define = log.groupBy(F.col("series").alias("name")).agg(F.min("seq").alias("seq")).select("seq", F.lit(DEFINE).alias("command"), "name")
    starts = log.groupBy("seg").agg(F.min("seq").alias("seq")).where("seq > 1").select("seq", F.lit(RESET).alias("command"), F.lit(None).cast("string").alias("name"))
    end = log.agg((F.max("seq") + 1).alias("seq")).select("seq", F.lit(TERMINATE).alias("command"), F.lit(None).cast("string").alias("name"))
    return define.unionByName(starts).unionByName(end)


def replay(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Every event with its series' number, to be read in order of seq."""
    return with_id(log, registry)
