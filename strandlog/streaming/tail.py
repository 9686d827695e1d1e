"""Following a log: read what is there and stop, or keep waiting for more.

Reading what is there is a stream with an available-now trigger; waiting is the
same stream with a processing-time trigger. Both go on from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The log at path, a folder or one file, as a stream; its schema is read from the files there."""
    top, name = path.rstrip("/").rsplit("/", 1)
    # A stream lists folders: one file is its folder with a filter on the name, and a folder has no such file in it.
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    return rows.parquet(path) if _is_folder(spark, path) else rows.option("pathGlobFilter", name).parquet(top)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def follow(rows: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, wait: str | None = None) -> StreamingQuery:
    """Gives each batch of new events to handler. wait: an interval to wait for more, else stop at the end."""
    trigger = {"availableNow": True} if wait is None else {"processingTime": wait}
    return rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """series, n, last_id of all that is there, counted batch by batch into a table and summed."""
    own = folder(spark, "tail")
    rows = stream(spark, path).select("event_type", "event_id")

    def handler(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
        sums.write.mode("overwrite").parquet(f"{own}/out/batch={number}")  # a batch that is done again replaces itself

    follow(rows, handler, f"{own}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{own}/out")
    return out.groupBy(F.col("event_type").alias("series")).agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))


def blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, block, n of full blocks of `size` events of a key, whatever batches they come in."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        now = seen + sum(len(p) for p in parts)
        state.update((now,))
        done = range(seen // size, now // size)
        yield pd.DataFrame({key: [k[0]] * len(done), "block": list(done), "n": [size] * len(done)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, block long, n long", "seen long", "append", GroupStateTimeout.NoTimeout)
