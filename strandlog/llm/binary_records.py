"""Token ids as length-delimited binary records with a separate offset index.

One `.rec` file and one `.idx` file per range of doc_ids. A record is

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

and a payload is u8 (1: doc_id is null) | i64 doc_id | ids, little-endian, two
bytes each where the vocabulary allows, else four. A checksum c is masked as
rotate-right(c, 15) + 0xA282EAD8 modulo 2 ** 32, so that checksums of data that
holds checksums stay useful. An index entry is u64 offset | u32 tokens | i64
doc_id | u8 null, of fixed size, so that a reader of shuffled rows seeks straight
to any record.

Files go to any store that pyarrow opens by URI (the shared folder of the
cluster). A task writes under a name of its own attempt and renames at the end:
repeated and lost attempts leave whole files only.

Defined cases: a null text is an empty one (its record holds the end id alone); a
very long text is encoded in pieces (see tokens) and is one record; a null doc_id comes first; rows with equal doc_ids follow one another, ordered by
text; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, lean, new_folder, slices, text_bytes
from .tokens import encoder

END_ID = 2
INDEX = np.dtype([("offset", "<u8"), ("tokens", "<u4"), ("doc_id", "<i8"), ("null", "u1")])


def masked(c: int) -> int:
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(read) -> bytes | None:
    """The next payload from read(n), None at the end; raises ValueError on damage."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError("damaged record length")
    size = struct.unpack_from("<Q", head)[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked(zlib.crc32(body[:size])) != struct.unpack_from("<I", body, size)[0]:
        raise ValueError("damaged record")
    return body[:size]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))  # the names that Hadoop has for it


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> list[dict]:
    """Encode docs and write them in ascending doc_id order. Returns a line for each file: name, records, tokens."""
    schema = "part int, records long, tokens long, width int"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, own = task.partitionId(), f".{task.taskAttemptId()}"
        enc = encoder(tokenizer)
        width = 2 if enc.vocab_size <= 1 << 16 else 4
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, at, index, tokens = f"{base}/part-{part:06d}", 0, [], 0
        end = np.array([end_id], f"<u{width}").tobytes()
        with store.open_output_stream(f"{name}.rec{own}") as out:
            for batch in slices(batches, "text"):
                data, off = flat(batch.column(1))
                ids, upto = enc.encode(data, off)
                raw = ids.astype(f"<u{width}").tobytes()
                for doc, s, e in zip(batch.column(0).to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    record = frame(struct.pack("<Bq", doc is None, doc or 0) + raw[s * width : e * width] + end)
                    out.write(record)
                    index.append((at, e - s + 1, doc or 0, doc is None))
                    at, tokens = at + len(record), tokens + e - s + 1
        with store.open_output_stream(f"{name}.idx{own}") as out:
            out.write(np.array(index, INDEX).tobytes())
        for kind in ("idx", "rec"):
            store.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": [len(index)], "tokens": [tokens], "width": pa.array([width], pa.int32())})

    rows = (
        docs.select("doc_id", text_bytes().alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(lean(write), schema)
        .collect()  # a line for each file
    )
    return [r.asDict() for r in sorted(rows) if r.records]


def read_records(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """Back from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as u32). Checks all checksums and the index."""
    before, lines = 0, []
    for f in files:
        lines.append((f["part"], before, f["width"]))
        before += f["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for part, start, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{base}/part-{part:06d}"
                with store.open_input_stream(f"{name}.idx", buffer_size=1 << 20) as f:
                    index = np.frombuffer(f.read(), INDEX)
                rows: tuple[list, ...] = ([], [], [], [])
                with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as f:
                    at = 0
                    for entry in index:
                        if entry["offset"] != at:
                            raise ValueError(f"{name}: a record is not where its index says")
                        payload = unframe(f.read)
                        if payload is None:
                            raise ValueError(f"{name}: fewer records than its index has")
                        at += len(payload) + 16
                        null, doc = struct.unpack_from("<Bq", payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=9)
                        if len(ids) != entry["tokens"] or doc != entry["doc_id"]:
                            raise ValueError(f"{name}: index and record differ")
                        for col, x in zip(rows, (None if null else doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            col.append(x)
                        start += len(ids)
                        if len(rows[0]) == 8192:
                            yield _rows(rows)
                            rows = ([], [], [], [])
                    if f.read(1):
                        raise ValueError(f"{name}: more records than its index has")
                yield _rows(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not lines:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(lines, "part int, start long, width int").repartition(len(lines))
    return todo.mapInArrow(lean(read), schema)


def _rows(cols: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(folder: str, part: int, row: int, width: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in a file's index: what a reader of shuffled rows does."""
    store, base = _store(folder)
    name = f"{base}/part-{part:06d}"
    with store.open_input_file(f"{name}.idx") as f:
        f.seek(row * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with store.open_input_file(f"{name}.rec") as f:
        f.seek(int(entry["offset"]))
        payload = unframe(f.read)
    null, doc = struct.unpack_from("<Bq", payload)
    return (None if null else doc), np.frombuffer(payload, f"<u{width}", offset=9)


def tokenised(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """Write docs to a new folder in the shared storage and read them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_records(spark, uri, write_records(docs, uri, tokenizer, end_id))
