"""Removal of byte strings that occur elsewhere, by suffix intervals of Burrows-Wheeler transforms.

One transform over a whole corpus would be one machine's work, so it is cut into
transforms that no repeat crosses:

1. Every string of `length` bytes (a window) belongs to the least hash of the
   `GRAM`-byte strings in it, its owner. Equal windows have equal owners. Windows
   side by side with one owner form a stretch of some 600 bytes at most in ordinary
   text. Owners that occur once are dropped (see repeats), and with them nearly all
   text without repeats.
2. The stretches of one owner meet in one bin, equal ones as one row with a count, as
   in a run-length coded transform. Each bin sorts its suffixes by their first
   `length` bytes and more (that order is what makes the transform), takes the
   transform, and expands intervals breadth-first: from the interval of the empty
   string, every interval of a string w is extended backwards to the intervals of
   cw. An interval whose right end has no common-prefix value yet sets it to |w| and
   goes on. Values arise in increasing order; expansion stops at `length`. Ends
   without a value are those where neighbours share at least `length` bytes, and a
   row that counts more than one shares all it has.
3. Every byte in such a window is removed, all judged on the input.

An owner with more than `HOT_OWNER` stretches may belong to a passage in a third of
all documents, each time between other words, so its stretches are not brought
together as they are. First their windows are met by hash, each task shipping equal
ones once, and those that occur once drop out, as owners did. What is left has lost
the words around, so a passage is few different stretches, which tasks again ship
once each. These are dealt by a second owner, the least hash of another family of the
`HOT_GRAM`-byte strings in a window, and go through transforms like all others.

Defined cases: a null text has no bytes; texts shorter than `length` repeat nothing; a
very long text is a bundle of its own, which one task holds; matches do not cross
documents; repeated rows are occurrences of each other; a null doc_id is kept; an
empty table gives no rows; other columns are ignored by digests() and kept by
deduplicated(), whatever their names, where a text cut inside a character drops the
rest of that character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import beside, bundled, each, places, replaced, text_size, texts, unpack
from .common import gram_hashes, lean, least_in_row, mix64, stash, window_starts
from .repeats import HOT, SHIPPED, Gathered, bucket_of, buckets, flushed, settle, settled

LENGTH, GRAM, HOT_OWNER, HOT_GRAM = 400, 32, 1000, 256
#: Bytes of stretches in one transform (more only for one owner), and gathered before they are shipped.
BATCH, SHIP = 1 << 20, 16 << 20
#: What Gathered ships, and stretches: their owners, sizes, counts and bytes, and where each one begins.
_SENT = SHIPPED + ", owner binary, size binary, seen binary, bytes binary, ref_of binary, ref_bundle binary, ref_start binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_SCHEMA = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in _NAMES[1:])])
#: windows: candidates as u32 places, else runs of repeated windows as u32 pairs (first, windows).
_FOUND = "bundle long, windows boolean, pos binary"


def _least_at(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every k values in a row, and its first place."""
    have, where = 1, np.arange(len(values), dtype=np.int32)
    while have < k and len(values):
        step = min(have, k - have)
        right = values[step:] < values[:-step]
        values, where = np.where(right, values[step:], values[:-step]), np.where(right, where[step:], where[:-step])
        have += step
    return values, where


def _stretches(at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and owner of every stretch of the windows at these places."""
    own = least[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))[: len(at)]
    return at[first], np.diff(np.append(first, len(at))), mix64(own[first])


def _owners(bundles: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """(bundle, pos): first windows of the stretches whose owner occurs again."""
    gram = min(GRAM, length)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(n_buckets)
        for number, raw in each(batches):
            data, off = texts(unpack(raw))
            at = window_starts(off, length)
            if len(at):
                least, where = _least_at(gram_hashes(data, gram), length - gram + 1)
                start, n, own = _stretches(at, least)
                # Where the owner moves on to another place, the stretch repeats a part of itself.
                twice = np.repeat(np.arange(len(start)), 1 + (where[start] != where[start + n - 1]))
                held.add(number, start[twice], own[twice], np.zeros(len(twice), np.uint32))
                yield from flushed(held, False)
        yield from flushed(held, True)

    return settled(bundles.select("bundle", "data").mapInArrow(lean(index), SHIPPED), HOT_OWNER)


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below 2 ** (64 - bits), and the keys in it: sorted together with their places, of that many bits."""
    both = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)


def sorted_suffixes(code: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of code (symbols below 512) in the order of at least their first depth symbols."""
    n, have = len(code), 4
    bits = n.bit_length()
    padded = np.concatenate([code.astype(np.uint64), np.zeros(have, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = key << np.uint64(9) | padded[i : i + n]
    while True:
        if bits <= 21:
            order, k = _sorted(key, bits)
        else:
            order = np.argsort(key)
            k = key[order]
        new = np.append(True, k[1:] != k[:-1])
        if have >= depth or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << np.uint64(bits)
        key[: n - have] |= rank[have:]
        have *= 2


def long_ends(code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether it shares at least length symbols with the one before.

    Symbol 0 separates texts: it ends strings, and is not put before any.
    """
    n = len(code)
    order = sorted_suffixes(code, length)
    last = np.where(order > 0, code[order - 1], 0).astype(np.uint16)  # the transform
    step = np.empty(n, np.int32)
    step[np.argsort(last, kind="stable")] = np.arange(n, dtype=np.int32)  # the place of the suffix one symbol longer
    open_ = np.ones(n + 1, bool)  # no common-prefix value yet
    open_[[0, n]] = False
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)  # intervals [lo, hi) of strings of this length
    for value in range(length):
        size = hi - lo
        until = np.cumsum(size, dtype=np.int32)
        which = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        place = np.repeat(lo - until + size, size)
        place += np.arange(len(place), dtype=np.int32)
        symbol = last[place]
        if value:
            use = symbol > 0
            place, which, symbol = place[use], which[use], symbol[use]
            if not len(place):
                break
        by = np.argsort(symbol, kind="stable")  # and so by their places one symbol longer
        at, which, symbol = step[place[by]], which[by], symbol[by]
        first = np.empty(len(at) + 1, bool)
        first[[0, -1]] = True
        first[1:-1] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        hi = at[first[1:]] + 1
        new = open_[hi]
        lo, hi = at[first[:-1]][new], hi[new]
        open_[hi] = False
        if not len(lo):
            break
    return order, open_[:n]


def _repeated(parts: list[np.ndarray], length: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For each different stretch, seen so many times, which of its windows occur again in these stretches."""
    size = np.array([len(p) for p in parts])
    code = np.zeros(int((size + 1).sum()), np.uint16)
    begin = np.cumsum(size + 1) - size - 1
    where = np.ones(len(code), bool)
    where[begin + size] = False
    code[where] = np.concatenate(parts).astype(np.uint16) + 1
    order, same = long_ends(code, length)
    again = np.zeros(len(code), bool)
    again[order[same]] = True
    again[order[np.flatnonzero(same) - 1]] = True
    return [again[b : b + n - length + 1] | (t > 1) for b, n, t in zip(begin, size, times or [1] * len(parts), strict=True)]


def _expanded(blobs: pd.DataFrame, length: int) -> tuple[list[int], list[bytes]]:
    """Bundles and runs (see _FOUND) of one bin's stretches."""
    unzip, known = zstandard.ZstdDecompressor(), {}  # equal stretches are one
    owners: list[int] = []
    times: list[int] = []
    refs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in blobs.itertuples():
        raw, at = unzip.decompress(b.bytes), 0
        number = np.empty(len(b.size) // 4, np.int64)
        for i, (o, n, t) in enumerate(zip(np.frombuffer(b.owner, np.uint64).tolist(), np.frombuffer(b.size, np.uint32).tolist(), np.frombuffer(b.seen, np.uint32).tolist(), strict=True)):
            k = known.setdefault(raw[at : at + n], len(owners))
            at += n
            if k == len(owners):
                owners.append(o)
                times.append(0)
            times[k] += t
            number[i] = k
        refs.append((number[np.frombuffer(b.ref_of, np.uint32)], np.frombuffer(b.ref_bundle, np.int64), np.frombuffer(b.ref_start, np.uint32)))
    parts = [np.frombuffer(x, np.uint8) for x in known]
    runs: list[np.ndarray] = [np.zeros((0, 2), np.uint32)] * len(parts)
    order = np.argsort(np.array(owners, np.uint64), kind="stable").tolist()
    batch: list[int] = []
    held = 0
    for i, k in enumerate(order):
        batch.append(k)
        held += len(parts[k])
        if i + 1 == len(order) or held >= BATCH and owners[order[i + 1]] != owners[k]:
            for j, a in zip(batch, _repeated([parts[j] for j in batch], length, [times[j] for j in batch]), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], a.astype(np.int8), [0]]))).reshape(-1, 2)
                runs[j] = np.stack([edge[:, 0], edge[:, 1] - edge[:, 0]], axis=1).astype(np.uint32)
            batch, held = [], 0
    count = np.array([len(r) for r in runs])
    first, flat_runs = np.cumsum(count) - count, np.concatenate([np.zeros((0, 2), np.uint32), *runs])
    number, bundle, start = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*refs, strict=True))
    n = count[number]
    out = flat_runs[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[number], n)]
    out[:, 0] += np.repeat(start, n).astype(np.uint32)
    bundle = np.repeat(bundle, n)
    by = np.argsort(bundle, kind="stable")
    some, cut = np.unique(bundle[by], return_index=True)
    return some.tolist(), [x.tobytes() for x in np.split(out[by], cut[1:])] if len(some) else []


def _bin(part: pd.DataFrame, length: int) -> pd.DataFrame:
    """Settles one bin: stretches by the transform, hashes of hot owners' windows as candidates."""
    bundle, windows, pos = [], [], []
    hashes, blobs = part[part["owner"].isna()], part[part["owner"].notna()]
    if len(hashes):
        found = settle(hashes, 1 << 62)
        bundle, windows, pos = found["bundle"].tolist(), [True] * len(found), found["pos"].tolist()
    if len(blobs):
        own, runs = _expanded(blobs, length)
        bundle, windows, pos = bundle + own, windows + [False] * len(own), pos + runs
    return pd.DataFrame({"bundle": np.array(bundle, np.int64), "windows": np.array(windows, bool), "pos": pos})


class _Held:
    """Stretches until they are shipped, equal ones once for each bin."""

    def __init__(self, n_buckets: int):
        self.n_buckets, self.bins, self.size = n_buckets, {}, 0

    def add(self, bundle: int, raw: bytes, start: np.ndarray, n: np.ndarray, own: np.ndarray, length: int) -> None:
        for o, b, s, e in zip(own.tolist(), bucket_of(own, self.n_buckets).tolist(), start.tolist(), (start + n + length - 1).tolist(), strict=True):
            x = self.bins.get(b)
            if x is None:
                x = self.bins[b] = ({}, [], [], [], [], [])
            known, owners, seen, ref_of, ref_bundle, ref_start = x
            k = known.setdefault(raw[s:e], len(owners))
            if k == len(owners):
                owners.append(o)
                seen.append(0)
                self.size += e - s
            seen[k] += 1
            ref_of.append(k)
            ref_bundle.append(bundle)
            ref_start.append(s)

    def ship(self) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {n: [] for n in _NAMES}
        for b, (known, owners, seen, ref_of, ref_bundle, ref_start) in self.bins.items():
            values = {
                "bucket": b, "owner": np.array(owners, np.uint64).tobytes(), "size": np.array(list(map(len, known)), np.uint32).tobytes(), "seen": np.array(seen, np.uint32).tobytes(), "bytes": zstandard.ZstdCompressor(1).compress(b"".join(known)),
                "ref_of": np.array(ref_of, np.uint32).tobytes(), "ref_bundle": np.array(ref_bundle, np.int64).tobytes(), "ref_start": np.array(ref_start, np.uint32).tobytes(),
            }
            for n in _NAMES:
                cols[n].append(values.get(n))
        if self.bins:
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)
        self.bins, self.size = {}, 0


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(len(batch), pa.binary())
    return pa.RecordBatch.from_arrays([*batch.columns, *[none] * (len(_NAMES) - len(batch.columns))], schema=_SCHEMA)


def _runs(bundles: DataFrame, length: int) -> DataFrame:
    """(bundle, pos): runs of repeated windows as u32 pairs (first, windows)."""
    n_buckets, gram, hot_gram = buckets(text_size(bundles)), min(GRAM, length), min(HOT_GRAM, length)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held = Gathered(n_buckets, spread=True), _Held(n_buckets)
        for number, raw, found in each(batches):
            if not found:
                continue
            data, off = texts(unpack(raw))
            start, n, own = _stretches(window_starts(off, length), least_in_row(gram_hashes(data, gram), length - gram + 1))
            told = places(found)
            at, first = np.unique(np.searchsorted(start, (told & ~HOT).astype(np.int64)), return_index=True)  # some ask twice
            hot = (told[first] & HOT) > 0
            some = at[hot]
            if len(some):
                w = np.arange(int(n[some].sum())) - np.repeat(np.cumsum(n[some]) - n[some] - start[some], n[some])
                windows.add(number, w, gram_hashes(data, length)[w], np.zeros(len(w), np.uint32))
                yield from map(_whole, flushed(windows, False))
            some = at[~hot]
            held.add(number, data.tobytes(), start[some], n[some], own[some], length)
            if held.size >= SHIP:
                yield from held.ship()
        yield from held.ship()
        yield from map(_whole, flushed(windows, True))

    def expand_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(n_buckets)
        for number, raw, found in each(batches):
            if not found:
                continue
            data, _ = texts(unpack(raw))
            at = np.unique(places(found)).astype(np.int64)
            held.add(number, data.tobytes(), *_stretches(at, least_in_row(gram_hashes(data, hot_gram, 1), length - hot_gram + 1)), length)
            if held.size >= SHIP:
                yield from held.ship()
        yield from held.ship()

    def binned(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInPandas(lambda part: _bin(part, length), _FOUND)

    found = stash(binned(beside(bundles, _owners(bundles, length, n_buckets)).mapInArrow(lean(expand), _SENT)), "runs")
    hot = beside(bundles, found.where("windows").select("bundle", "pos"))
    return found.where("not windows").select("bundle", "pos").unionByName(binned(hot.mapInArrow(lean(expand_hot), _SENT)).select("bundle", "pos"))


def _gone(n: int, found: list[bytes] | None, length: int) -> np.ndarray:
    """Which of a bundle's n bytes lie in a repeated window."""
    runs = places(found).reshape(-1, 2).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, found in each(batches):
            batch = unpack(raw)
            data, off = texts(batch)
            gone = _gone(len(data), found, length)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inner = off[off < len(data)]
            first[inner] = gone[inner]  # a run ends with its document
            kept, rest = np.append(0, np.cumsum(~gone))[off], data[~gone].tobytes()
            shas = [hashlib.sha256(rest[s:e]).hexdigest() for s, e in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            counts = [np.diff(np.append(0, np.cumsum(x))[off]) for x in (gone, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (np.diff(off), *counts)), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    bundles = bundled(docs.select(F.col("doc_id").cast("long"), "text"))
    return beside(bundles, _runs(bundles, length)).mapInArrow(lean(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with all their columns, less the byte strings that occur elsewhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, found in each(batches):
            batch = unpack(raw)
            if found:
                data, off = texts(batch)
                gone = _gone(len(data), found, length)
                batch = replaced(batch, data, off, gone, np.diff(np.append(0, np.cumsum(gone))[off]) > 0)
            yield batch

    bundles = bundled(docs)
    return beside(bundles, _runs(bundles, length)).mapInArrow(lean(cut), docs.schema)


#: Windows by their md5; runs of windows become spans, and what lies between them is kept.
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT uid, i, md5(x[i + 1 : i + {LENGTH}]) AS g FROM (SELECT uid, x, unnest(range(0, octet_length(x) - {LENGTH - 1})) AS i FROM t)),
c AS (SELECT uid, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
b AS (SELECT uid, i, i > lag(i, 1, -{LENGTH + 1}) OVER (PARTITION BY uid ORDER BY i) + {LENGTH} AS first FROM c),
s AS (SELECT uid, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT *, sum(first::INT) OVER (PARTITION BY uid ORDER BY i) AS k FROM b) GROUP BY uid, k),
k AS (
  SELECT uid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(x[p + 1 : a]), '' ORDER BY a) || any_value(hex(x[last + 1 : octet_length(x)])) AS kept
  FROM (SELECT *, lag(z, 1, 0) OVER (PARTITION BY uid ORDER BY a) AS p, max(z) OVER (PARTITION BY uid) AS last FROM s) JOIN t USING (uid) GROUP BY uid)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN x ELSE unhex(kept) END) AS kept_sha256 FROM t LEFT JOIN k USING (uid)
"""
