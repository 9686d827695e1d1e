"""What several corpus operators share: shared storage, Arrow slices and rolling hashes.

Python stages get text as binary Arrow columns and work on slices of a few
megabytes, so their memory follows the slice (or one long document), not the
partition.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python stage holds at once (more only for a longer single document).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster has to name a folder that all its machines share")
        found = tempfile.mkdtemp(prefix="strandlog-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> F.Column:
    """Identity of a row: rows that agree in doc_id and text are alike in every result. The doc_id is part of it, so only texts of one doc_id could be confused."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"))


def text_bytes() -> F.Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def release() -> None:
    """Give back what a task has used and freed: Python workers stay, and would wait with it for their next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A stage for mapInArrow that ends with release()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stage(batches)
        release()

    return run


# Arrow columns as numpy arrays


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column end to end, and its n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of text, or one longer row."""
    for batch in batches:
        _, off = flat(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def ints(batch: pa.RecordBatch, name: str, kind=np.int64) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(kind, copy=False)


# Hashing
#
# No sums of powers: such hashes of two regular texts can be equal whatever the base. Every step
# below mixes all bits, and a seed gives a family of its own.

_SEEDS = np.random.default_rng(20240229).integers(0, 2**62, (2, 2), dtype=np.uint64) * np.uint64(4) + np.uint64(3)
#: Bytes up to which words are hashed together; longer ones go to the library one by one.
_LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the public SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of ordered pairs."""
    return mix64(a * _SEEDS[seed, 1] + b)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a little-endian number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def _masked(lane: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Lanes of which only the first `left` bytes count (8 at most)."""
    drop = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    return lane << drop


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of the byte strings [start, end) of data, none of them empty."""
    size = end - start
    lane = lanes(data)
    h = pair(size.astype(np.uint64) + _SEEDS[seed, 0], _masked(lane[start], size), seed)
    more = np.flatnonzero(size > 8)
    at = 8
    while len(more) and at < _LONG:
        h[more] = pair(h[more], _masked(lane[start[more] + at], size[more] - at), seed)
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        own = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
        h[i] = int.from_bytes(own, "little")
    return h


def gram_hashes(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Of the k bytes from every place on where they fit."""
    lane = lanes(data)[: max(0, len(data) - min(k, 8) + 1)]
    if k <= 8:
        return mix64(_masked(lane, np.full(1, k)) + _SEEDS[seed, 0])
    return rolling(lane, k, seed, have=8)


def rolling(values: np.ndarray, k: int, seed: int = 0, have: int = 1) -> np.ndarray:
    """Hashes of every k in a row, by doubling. values: of every `have` in a row."""
    n = len(values) + have - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    while 2 * have <= k:
        values = pair(values[:-have], values[have:], seed)
        have *= 2
    if have < k:  # two that overlap
        values = pair(values[:n], values[k - have :], seed)
    return values


def least_in_row(values: np.ndarray, k: int) -> np.ndarray:
    """The least of every k values in a row."""
    have = 1
    while have < k and len(values):
        step = min(have, k - have)
        values, have = np.minimum(values[:-step], values[step:]), have + step
    return values


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data, and the n + 1 bounds of each document's words."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """The places where k values in a row lie in one document, given the documents' bounds."""
    ok = np.zeros(int(bounds[-1]) + 1, np.int8)
    long = np.diff(bounds) >= k
    np.add.at(ok, bounds[:-1][long], 1)
    np.add.at(ok, bounds[1:][long] - k + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a window of this length that begins at one of start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
