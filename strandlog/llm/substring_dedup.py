"""Removal of word sequences that occur elsewhere, by fixed-block anchors.

A repeat has at least `window` words, so it holds a whole block of `block` =
(window + 1) // 2 words wherever blocks are laid end to end from the start of its
document.

1. Index: the hashes of all non-overlapping blocks, with their places. Probe: the
   hashes of every rolling window of `block` words of all documents, as a set for
   each task (sorted and delta-coded; as many bits of a hash as the corpus needs for
   few chance matches, which cost a candidate each, not a wrong result). Both meet by
   hash bucket, and a block is an anchor if its hash is in the sets of two tasks or
   twice in one.
2. Extension: around each anchor all windows of `window` words that hold it whole
   are met by bucket again, by two hashes of different families (64 and 32 bits) of
   their words; those found twice are repeats, and windows side by side join to
   maximal ones.
3. Every word in such a window is removed, all judged on the input.

Texts are shuffled once, compressed, as bundles; no group of rows is ever held for
one hash, as tasks ship one row for equal hashes (see repeats).

Defined cases: a null text has no words; fewer words than a window repeat nothing; a
very long text is a bundle of its own, which one task holds; repeated rows are
occurrences of each other; a null doc_id is kept; an empty table gives no rows; other
columns are ignored by digests() and kept by deduplicated(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import beside, bundled, each, places, replaced, text_size, texts, unpack
from .common import covered, lean, least_in_row, mix64, release, rolling, window_starts, word_hashes, words
from .repeats import FOUND, SHIPPED, Gathered, bucket_of, buckets, flushed, planes, settled, unplanes

WINDOW = 35
#: Probes that a task gathers before it ships them.
PROBES = 1 << 20
_ANCHORS = "bucket int, probes binary, keys binary, bundles binary, owner binary, blocks binary, asks binary"


def key_bits(n_bytes: int) -> int:
    """Of a hash, so that a block meets another by chance once in some hundred times, as a text of n bytes has n / 5 words or so."""
    return min(63, max(32, n_bytes.bit_length() + 5))


def _anchors(bundles: DataFrame, block: int, n_bytes: int) -> DataFrame:
    """(bundle, pos): u32 first words of every block whose words occur elsewhere, and of a few more by chance."""
    n_buckets, shift = buckets(n_bytes), np.uint64(64 - key_bits(n_bytes))

    def ship(probes: list[np.ndarray], keys: list[np.ndarray], at: list[np.ndarray], numbers: list[int]) -> pa.RecordBatch:
        probe, times = _runs(np.sort(np.concatenate(probes)) >> shift)
        key, place = np.concatenate(keys), np.concatenate(at)
        owner = np.repeat(np.arange(len(at), dtype=np.uint32), [len(x) for x in at])
        order = np.argsort(key)
        key, owner, place = key[order] >> shift, owner[order], place[order]
        asks = times[np.searchsorted(probe, key)] == 1  # the others are known to repeat
        coded = probe << np.uint64(1) | (times > 1).astype(np.uint64)
        edges = [np.searchsorted(bucket_of(x << shift, n_buckets), np.arange(n_buckets + 1)) for x in (probe, key)]
        whole, cols = np.array(numbers, np.int64), [[] for _ in range(7)]
        for b in np.flatnonzero(np.diff(edges[0])):
            part, own = coded[edges[0][b] : edges[0][b + 1]], slice(edges[1][b], edges[1][b + 1])
            some, which = np.unique(owner[own], return_inverse=True)
            values = (int(b), planes(np.diff(part, prepend=np.uint64(0))), planes(np.diff(key[own], prepend=np.uint64(0))), whole[some].tobytes(), planes(which.astype(np.uint32)), planes(place[own]), np.packbits(asks[own]).tobytes())
            for col, x in zip(cols, values, strict=True):
                col.append(x)
        kinds = (pa.int32(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _ANCHORS.split(", ")])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size = 0
        for number, raw in each(batches):
            data, off = texts(unpack(raw))
            start, end, upto = words(data, off)
            at = window_starts(upto, block)
            if not len(at):
                continue
            h = rolling(word_hashes(data, start, end), block)[at]
            laid = (at - upto[np.searchsorted(upto, at, "right") - 1]) % block == 0
            for col, x in zip(held, (h, h[laid], at[laid].astype(np.uint32), number), strict=True):
                col.append(x)
            size += len(h)
            if size >= PROBES:
                yield ship(*held)
                held, size = [[], [], [], []], 0
        if size:
            yield ship(*held)

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        seen = np.concatenate([np.cumsum(unplanes(p, np.uint64), dtype=np.uint64) for p in part["probes"]])
        seen.sort()
        key = seen >> np.uint64(1)
        again = (seen & np.uint64(1)) > 0
        again[1:] |= key[1:] == key[:-1]
        again = np.unique(key[again])
        out: list[tuple] = []
        for k, whole, owner, at, asks in zip(part["keys"], part["bundles"], part["owner"], part["blocks"], part["asks"], strict=True):
            k = np.cumsum(unplanes(k, np.uint64), dtype=np.uint64)
            hit = np.unpackbits(np.frombuffer(asks, np.uint8), count=len(k)) == 0
            if len(again):
                hit |= again[np.minimum(np.searchsorted(again, k), len(again) - 1)] == k
            owner, at, whole = unplanes(owner, np.uint32)[hit], unplanes(at, np.uint32)[hit], np.frombuffer(whole, np.int64)
            order = np.argsort(owner, kind="stable")
            owner, at = owner[order], at[order]
            some, first = np.unique(owner, return_index=True)
            out += [(whole[o], x.tobytes()) for o, x in zip(some, np.split(at, first[1:]), strict=False)]
        release()
        return pd.DataFrame({"bundle": np.array([x[0] for x in out], np.int64), "pos": [x[1] for x in out]})

    sent = bundles.select("bundle", "data").mapInArrow(lean(index), _ANCHORS)
    return sent.groupBy("bucket").applyInPandas(meet, FOUND)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and how often each occurs."""
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return a[first], np.diff(np.append(first, len(a)))


def _repeats(bundles: DataFrame, window: int) -> DataFrame:
    """(bundle, pos): u32 first words of repeated windows."""
    block, n_bytes = (window + 1) // 2, text_size(bundles)
    n_buckets = buckets(n_bytes)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(n_buckets, spread=True)
        for number, raw, found in each(batches):
            if not found:
                continue
            data, off = texts(unpack(raw))
            start, end, upto = words(data, off)
            anchor = np.zeros(len(start) + window + block, bool)
            anchor[places(found)] = True
            at = window_starts(upto, window)
            own = upto[np.searchsorted(upto, at, "right") - 1]
            at = at[anchor[own + -(-(at - own) // block) * block]]  # the first block that begins in the window lies in it
            key, check = (rolling(word_hashes(data, start, end, seed), block, seed) for seed in (0, 1))
            # Windows side by side mostly share the least hash of a block in them, and so their bucket.
            least = least_in_row(key, window - block + 1)
            key, check = (mix64(h[at] + mix64(h[at + window - block])) for h in (key, check))
            held.add(number, at, key, check >> np.uint64(32), mix64(least[at]))
            yield from flushed(held, False)
        yield from flushed(held, True)

    return settled(beside(bundles, _anchors(bundles, block, n_bytes)).mapInArrow(lean(extend), SHIPPED))


def _gone(data: np.ndarray, off: np.ndarray, found: list[bytes] | None, window: int) -> tuple[np.ndarray, ...]:
    """Words' starts, ends and bounds of a bundle, and which of them go."""
    start, end, upto = words(data, off)
    return start, end, upto, covered(len(start), np.unique(places(found)).astype(np.int64), window)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, found in each(batches):
            batch = unpack(raw)
            data, off = texts(batch)
            start, end, upto, gone = _gone(data, off, found, window)
            raw, shas, kept = data.tobytes(), [], ~gone
            for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                use = kept[s:e]
                shas.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(start[s:e][use].tolist(), end[s:e][use].tolist(), strict=True)])).hexdigest())
            removed = np.diff(np.append(0, np.cumsum(gone))[upto])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(upto), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    bundles = bundled(docs.select(F.col("doc_id").cast("long"), "text"))
    return beside(bundles, _repeats(bundles, window)).mapInArrow(lean(digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, less the words that occur elsewhere. White space goes with the word before it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, found in each(batches):
            batch = unpack(raw)
            if found:
                data, off = texts(batch)
                start, _, upto, gone = _gone(data, off, found, window)
                edge = np.zeros(len(data) + 1, np.int32)
                until = np.minimum(np.append(start[1:], len(data)), off[np.searchsorted(off, start, "right")])
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, until[gone], -1)
                batch = replaced(batch, data, off, np.cumsum(edge[:-1]) > 0, np.diff(np.append(0, np.cumsum(gone))[upto]) > 0)
            yield batch

    bundles = bundled(docs)
    return beside(bundles, _repeats(bundles, window)).mapInArrow(lean(cut), docs.schema)


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT uid, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT *, md5(string_agg(word, ' ') OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) AS g FROM x),
c AS (SELECT uid, i, word, i <= n - {WINDOW - 1} AND count(*) FILTER (i <= n - {WINDOW - 1}) OVER (PARTITION BY g) > 1 AS again FROM g),
d AS (SELECT uid, i, word, bool_or(again) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT uid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM d GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (uid)
"""
