"""Best-fit packing of documents into sequences by a plan over their length histogram.

1. Documents are encoded and cut into pieces; only those longer than a sequence
   are cut, the first piece being the shorter one.
2. Pieces are counted by length: at most `capacity` counts, whatever the corpus.
3. Best-fit decreasing runs over the counts on the driver. Sequences with equal
   room are one group, so the plan has some thousand lines at most.
4. Pieces are ranked within their length and take the plan's slots by joining on
   length and rank. Ranks come from windows over (length, salt) and the counts of
   the salts before, with as many salts as the pieces need, so that one very common
   length is dealt to many tasks.

Defined cases: a null text is an empty one (one piece with the end id); a very long
text is encoded in pieces (see tokens); a null
doc_id is kept; repeated rows are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, lean, slices, stash, text_bytes
from .tokens import encoder

#: Groups into which pieces of one length are dealt for ranking, at least; pieces for each; and counts that are broadcast at most.
SALTS, SALT_ROWS, BROADCAST_ROWS = 64, 1_000_000, 1_000_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            data, off = flat(batch.column(1))
            ids, upto = enc.encode(data, off)
            raw = ids.astype("<u4").tobytes()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, s, e in zip(batch.column(0).to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                own, n = raw[4 * s : 4 * e] + end, e - s + 1
                at = 0
                for piece in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    for col, x in zip(rows, (doc, piece, at, size, zlib.crc32(own[4 * at : 4 * (at + size)])), strict=True):
                        col.append(x)
                    at += size
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(lean(cut), schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns lines (length, first rank, end rank, first sequence, pieces per
    sequence, offset): the piece of this length and rank r lies in sequence
    first + (r - first rank) // per, at offset + (r - first rank) % per * length.
    Equal pieces fill a sequence one after another, as the one that has just got
    one has the least room that still fits, so this is best-fit on documents too.
    """
    room: dict[int, list[list[int]]] = {}  # room left: ranges [first, end) of sequences
    plan, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = iter(sorted(r for r, groups in room.items() if r >= length and groups))
        while left:
            r = next(fits, None)
            if r is None:  # new sequences
                r, n = capacity, -(-left // (capacity // length))
                room.setdefault(r, []).append([used, used + n])
                used += n
            per = r // length
            groups = room[r]
            while groups and left:
                first, end = groups.pop()
                whole = min(end - first, left // per)
                if whole:
                    plan.append((length, rank, rank + whole * per, first, per, capacity - r))
                    room.setdefault(r - per * length, []).append([first, first + whole])
                    rank, left, first = rank + whole * per, left - whole * per, first + whole
                if left and left < per and first < end:
                    plan.append((length, rank, rank + left, first, left, capacity - r))
                    room.setdefault(r - left * length, []).append([first, first + 1])
                    first, left = first + 1, 0
                if first < end:
                    groups.append([first, end])
    return plan


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2, salts: int = SALTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    rows = stash(pieces(docs, tokenizer, capacity, end_id), "pieces")
    salts = max(salts, rows.count() // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").count()  # at most capacity * salts lines
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = best_fit(hist, capacity)
    schema = "length long, first_rank long, end_rank long, first_sequence long, per long, base long"
    slots = F.broadcast(spark.createDataFrame(plan, schema))  # its size depends on capacity alone
    before = F.broadcast(before.drop("count")) if capacity * salts <= BROADCAST_ROWS else before.drop("count")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    at = F.col("rank") - F.col("first_rank")
    here = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (
        ranked.join(slots, "length").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select(*here, (F.col("first_sequence") + F.floor(at / F.col("per"))).alias("sequence_id"), (F.col("base") + at % F.col("per") * F.col("length")).alias("offset"))
    )
