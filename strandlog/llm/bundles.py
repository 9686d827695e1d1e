"""Documents in bundles: slices of about a megabyte of text as compressed Arrow data.

Operators that look at the text of all documents more than once write bundles first.
A bundle's number and the order of its documents then stay, so a place in it names a
place in the corpus, without keys that could be alike. Rows travel whole and
compressed, with all their columns, whatever these are called.

Within one query, beside() shuffles the bundles in one and the same way, so Spark does
it once (a reused exchange).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, flat, lean, slices, stash

_COLUMNS = "bundle long, n_bytes long, data binary"


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue())


def unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


def texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a bundle's texts end to end, and their offsets. Null texts are empty."""
    return flat(batch.column(batch.schema.get_field_index("text")).fill_null(""))


def bundled(docs: DataFrame, limit: int = SLICE_BYTES) -> DataFrame:
    """bundle, n_bytes of text, data: the rows of docs with all their columns; a longer text is a bundle of its own."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", limit)):
            size = int(flat(batch.column(batch.schema.get_field_index("text")))[1][-1])
            yield pa.RecordBatch.from_pydict({"bundle": [first + k], "n_bytes": [size], "data": [pack(batch)]})

    return stash(docs.mapInArrow(lean(write), _COLUMNS), "bundles")


def text_size(bundles: DataFrame) -> int:
    return bundles.agg(F.sum("n_bytes")).first()[0] or 0


def beside(bundles: DataFrame, found: DataFrame) -> DataFrame:
    """bundle, data, pos: every bundle with the lists of what was found in it (bundle, pos), or null."""
    gathered = found.groupBy("bundle").agg(F.collect_list("pos").alias("pos"))  # of one bundle
    return bundles.select("bundle", "data").join(gathered.hint("merge"), "bundle", "left")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches one by one, so that a few bundles are not unpacked at once."""
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(c[i].as_py() for c in batch.columns)


def places(found: list[bytes] | None) -> np.ndarray:
    """Packed u32 places as one array."""
    return np.frombuffer(b"".join(found or []), np.uint32)


def replaced(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray, gone: np.ndarray, changed: np.ndarray) -> pa.RecordBatch:
    """The batch with the bytes of its texts that are not gone (halves of characters go too), and n_chars of changed texts."""
    kept = np.append(0, np.cumsum(~gone))[off]
    rest = data[~gone].tobytes()
    out = [rest[kept[i] : kept[i + 1]].decode("utf-8", "ignore") if c else None for i, c in enumerate(changed.tolist())]
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    mask = pa.array(changed)
    kind = columns["text"].type
    columns["text"] = pa.compute.if_else(mask, pa.array(out, kind), columns["text"])
    if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
        columns["n_chars"] = pa.compute.if_else(mask, pa.array([None if x is None else len(x) for x in out], columns["n_chars"].type), columns["n_chars"])
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
