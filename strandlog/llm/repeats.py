"""Finding hashes that occur again anywhere in a corpus, with little data moved.

A task gathers the hashes of its bundles and settles what it can: of equal hashes it
ships one, marked as known to repeat. So a hash held by a third of all documents
reaches its bucket once for each task and not once for each document. Hashes are
shipped as binary columns, a row for each bucket and flush, and each bucket tells
which of them occur again, as places (u32) in bundles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes that a task gathers before it ships them, and text bytes whose hashes one bucket gets, all tasks together.
FLUSH, BUCKET_BYTES = 1 << 20, 1 << 26

SHIPPED = "bucket int, bundles binary, doc binary, pos binary, key binary, check binary, times binary, rep binary"
#: Set in a place whose hash occurs more often than the caller's limit.
HOT = np.uint32(1 << 31)
FOUND = "bundle long, pos binary"


def buckets(n_bytes: int) -> int:
    """Follows the text, so that a bucket's memory does not."""
    return max(256, n_bytes // BUCKET_BYTES)


def planes(a: np.ndarray) -> bytes:
    """The bytes of a by significance: the shuffle's codec then drops high bytes that are alike."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Gathered:
    """Hashes with their places, until they are shipped.

    spread: places that are known to repeat go to a bucket of their bundle, not of
    their hash. Then a bundle's places come back in few rows, but no bucket can tell
    which of them are HOT.
    """

    def __init__(self, n_buckets: int, spread: bool = False):
        self.n_buckets, self.spread = n_buckets, spread
        self._clear()

    def _clear(self) -> None:
        self.bundles, self.parts, self.size = [], [], 0

    def add(self, bundle: int, pos: np.ndarray, key: np.ndarray, check: np.ndarray, deal: np.ndarray | None = None) -> None:
        """deal: hashes that choose the bucket, equal where keys are (the keys themselves by default)."""
        self.parts.append((np.full(len(pos), len(self.bundles), np.uint32), pos.astype(np.uint32), key, check.astype(np.uint32), key if deal is None else deal))
        self.bundles.append(bundle)
        self.size += len(key)

    def ship(self) -> pa.RecordBatch | None:
        if not self.size:
            self._clear()
            return None
        bundles = np.array(self.bundles, np.int64)
        doc, pos, key, check, deal = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self._clear()
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(k)))
        asks = np.zeros(len(key), bool)  # the others are known to repeat, and follow the one that asks for them
        asks[order] = new
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        nth = np.empty(len(count), np.uint32)
        bucket = bucket_of(deal, self.n_buckets)
        if self.spread:
            bucket[~asks] = (bundles[doc[~asks]].view(np.uint64) % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.lexsort((~asks, bucket))  # then as they came, by bundle and place
        bounds = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        names = [n.split()[0] for n in SHIPPED.split(", ")]
        cols: list[list] = [[] for _ in names]
        for b in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[b] : bounds[b + 1]]
            own, d = np.unique(doc[at], return_inverse=True)
            n = int(asks[at].sum())
            ask, told = at[:n], at[n:]
            nth[group[ask]] = np.arange(n)
            values = (int(b), bundles[own].tobytes(), planes(d.astype(np.uint32)), planes(pos[at]), key[ask].tobytes(), check[ask].tobytes(), planes(count[group[ask]].astype(np.uint32)), b"" if self.spread else planes(nth[group[told]]))
            for col, x in zip(cols, values, strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), *[pa.binary()] * 7], strict=True)], names=names)


def settle(part: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Of one bucket's rows. hot: places of hashes with more occurrences than this are marked by HOT."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in part["key"]])
    check = np.concatenate([np.frombuffer(x, np.uint32) for x in part["check"]])
    times = np.concatenate([unplanes(x, np.uint32) for x in part["times"]])
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    total = np.empty(len(key), np.int64)
    if len(key):
        total[order] = np.repeat(np.add.reduceat(times[order].astype(np.int64), first), np.diff(np.append(first, len(k))))
    at, out = 0, []
    for bundles, doc, pos, keys, rep in zip(part["bundles"], part["doc"], part["pos"], part["key"], part["rep"], strict=True):
        n = len(keys) // 8
        own = total[at : at + n]
        at += n
        bundles, doc, pos = np.frombuffer(bundles, np.int64), unplanes(doc, np.uint32), unplanes(pos, np.uint32)
        own = np.concatenate([own, own[unplanes(rep, np.uint32)] if rep else np.full(len(doc) - n, 2)])
        pos = pos | np.where(own > hot, HOT, np.uint32(0))
        doc, pos = doc[own > 1], pos[own > 1]
        if not len(doc):
            continue
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        out += [(bundles[doc[s]], pos[s:e].tobytes()) for s, e in zip(first, np.append(first[1:], len(doc)), strict=True)]
    return pd.DataFrame({"bundle": np.array([x[0] for x in out], np.int64), "pos": [x[1] for x in out]})


def settled(sent: DataFrame, hot: int = 1 << 62) -> DataFrame:
    """(bundle, pos) of what occurs again: pos holds u32 places of a bundle."""
    return sent.groupBy("bucket").applyInPandas(lambda part: settle(part, hot), FOUND)


def flushed(gathered: Gathered, done: bool, limit: int = FLUSH) -> Iterator[pa.RecordBatch]:
    if done or gathered.size >= limit:
        batch = gathered.ship()
        if batch is not None:
            yield batch
