"""Cross-entropy difference of two word-bigram models.

The target model counts the documents labelled good, the background model all
documents. Both are interpolated bigram models of the same order, smoothing and
vocabulary, the distinct words (ASCII lower case) of all documents:

    P(w | v) = mix * c(v w) / c(v) + (1 - mix) * U(w)    where c(v) > 0, else U(w)
    U(w) = (c(w) + add) / (N + add * vocabulary)

which sums to 1 over the vocabulary. A document is left out of the models that
score it: its own counts are taken off c, c(v) and N of the background, and of the
target if it is labelled good. So no document vouches for itself, and labelled and
other documents are scored alike. A document's score is its mean loss under the
target model less that under the background model, in bits per word; low scores
are like the target. The first word of a text follows a start mark.

Every distinct word and pair has a count of its own, by a 64-bit hash, so the model
grows with the corpus and is never in one place. Documents are packed into slices of
about `slice_bytes` of text. Each slice sends its distinct words and pairs with their
counts, cut by ranges of the hash into parts; a part (about `part_bytes` of the text)
adds them up and sends every slice the sums of its own, which are written. A slice
then has all counts that its documents need. A word or pair is one entry of a slice
however often it occurs, so common ones weigh no more than others. Memory follows a
slice or a part.

Defined cases: a null or empty text has no words and null losses; a very long text is
a slice of its own; a null label is no label; without any good document all scores
come from an empty target model; a null doc_id is kept and never labelled; repeated
rows are counted and scored each, and leave out themselves alone; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, ints, lean, pair as pair_hashes, slices, stash, text_bytes, word_hashes, words

MIX, ADD = 0.5, 0.1
#: Text bytes of a slice and, all slices together, of a part; parts at least.
SLICE_BYTES, PART_BYTES, PARTS = 1 << 22, 1 << 24, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _packed(counts: np.ndarray) -> bytes:
    """Counts of shape (n, k), compressed, after a byte that tells their width."""
    width = next(b for b in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * b - 1))
    return bytes([width]) + pa.compress(counts.T.astype(f"i{width}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, k: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], n * k * data[0], codec="zstd", asbytes=True), f"i{data[0]}").reshape(k, n).T


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as gaps, like bytes together, compressed."""
    return pa.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    gaps = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(gaps).view(np.uint64).ravel(), dtype=np.uint64)


def _entries(lengths: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: its words' hashes (0: start) and its pairs', both sorted; of every word its place among them, its predecessor's and the pair's; the bounds of each document's words."""
    off = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    text = pa.py_buffer(pa.decompress(data, int(off[-1]), codec="zstd", asbytes=True) if off[-1] else b"")
    whole = pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off), text])], ["text"])
    ws, vs, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for batch in slices([whole], "text"):
        part, bound = flat(batch.column(0))
        part = _LOWER[part]
        start, end, upto = words(part, bound)
        w = word_hashes(part, start, end)
        v = np.zeros(len(w), np.uint64)
        v[1:] = w[:-1]
        v[upto[:-1][np.diff(upto) > 0]] = 0
        ws, vs, ns = [*ws, w], [*vs, v], [*ns, np.diff(upto)]
    w, v, upto = np.concatenate(ws), np.concatenate(vs), np.cumsum(np.concatenate(ns))
    word, at = np.unique(np.concatenate([w, v]), return_inverse=True)
    pair, of = np.unique(pair_hashes(v, w), return_inverse=True)
    return word, pair, at[: len(w)], at[len(w) :], of, upto


def _slices(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """slice, n_bytes, ids, lengths, data: the documents packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", slice_bytes)):
            data, off = flat(batch.column(1))
            packed = pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b""
            one = {"slice": [first + k], "n_bytes": [len(data)], "ids": [batch.column(0).to_pylist()], "lengths": [np.diff(off)], "data": [packed]}
            yield pa.RecordBatch.from_pydict(one, pa.schema([("slice", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())]))

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(pack), "slice long, n_bytes long, ids array<long>, lengths array<long>, data binary")


def _marked(packed: DataFrame, labels: DataFrame) -> DataFrame:
    """slice, ids, lengths, data, good: the places of documents labelled good."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    ids = packed.select("slice", F.posexplode("ids").alias("place", "id"))
    good = ids.join(good.hint("merge"), "id").groupBy("slice").agg(F.collect_list("place").alias("good"))  # of one slice
    return packed.join(good.hint("merge"), "slice", "left").select("slice", "ids", "lengths", "data", "good")


def _asked(marked: DataFrame, parts: int) -> DataFrame:
    """part, slice, n, keys, counts: a slice's n entries, words in the first parts (target and background, as words and as predecessors), pairs in the others."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
            word, pair, w, v, vw, upto = _entries(row["lengths"], row["data"])
            use = np.repeat(_members(row), np.diff(upto))
            out = []
            for kind, (keys, places) in enumerate(((word, (w, v)), (pair, (vw,)))):
                counts = np.stack([np.bincount(p, x, len(keys)) for p in places for x in (use, None)], axis=1).astype(np.int64)
                part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                edge = np.searchsorted(part, np.arange(parts + 1))
                out += [(kind * parts + p, row["slice"], b - a, _packed_keys(keys[a:b]), _packed(counts[a:b])) for p, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["part", "slice", "n", "keys", "counts"])

    return marked.mapInArrow(lean(ask), "part long, slice long, n long, keys binary, counts binary")


def _answered(asked: DataFrame, parts: int) -> DataFrame:
    """part, slice, n, counts: over all documents, of the n entries that the slice asked for; and of each part of words vocabulary, target and background (distinct words, sums)."""

    def add(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        asked = [_unpacked_keys(x.as_py(), n.as_py()) for x, n in zip(rows["keys"], rows["n"], strict=True)]
        k, bound = 4 if part < parts else 2, np.concatenate([[0], np.cumsum([len(a) for a in asked])])
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([_unpacked(c.as_py(), len(a), k) for c, a in zip(rows["counts"], asked, strict=True)])
        total = np.stack([np.bincount(at, counts[:, c], len(keys)) for c in range(k)], axis=1).astype(np.int64)
        sizes = (np.count_nonzero(total[:, 1]), *total[:, :2].sum(axis=0).tolist()) if part < parts else (0, 0, 0)
        n = len(asked)
        out = {"part": rows["part"], "slice": rows["slice"], "n": np.diff(bound), "counts": [_packed(total[at[a:b]]) for a, b in zip(bound, bound[1:], strict=False)]}
        return pa.table(out | {c: pa.array([x] + [0] * (n - 1), pa.int64()) for c, x in zip(("vocabulary", "target", "background"), sizes, strict=True)})

    return asked.groupBy("part").applyInArrow(add, "part long, slice long, n long, counts binary, vocabulary long, target long, background long")


def _members(row: dict) -> np.ndarray:
    """1 for each document of a slice that is labelled good, else 0."""
    out = np.zeros(len(row["lengths"]))
    out[row["good"] or []] = 1
    return out


def _own(doc: np.ndarray, entry: np.ndarray, size: int) -> np.ndarray:
    """How often each word's entry occurs in its own document."""
    _, at, n = np.unique(doc * size + entry, return_inverse=True, return_counts=True)
    return n[at]


def score(docs: DataFrame, labels: DataFrame, mix: float = MIX, add: float = ADD, slice_bytes: int = SLICE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score of every row."""
    packed = stash(_slices(docs, slice_bytes), "slices")
    parts = max(PARTS, -(-(packed.agg(F.sum("n_bytes")).first()[0] or 0) // part_bytes))
    marked = _marked(packed, labels)
    counts = stash(_answered(_asked(marked, parts), parts), "counts")
    vocabulary, *sums = (x or 0 for x in counts.agg(F.sum("vocabulary"), F.sum("target"), F.sum("background")).first())

    def apply(one: pa.Table, answers: pa.Table) -> pa.Table:
        row = one.to_pylist()[0]
        word, pair, w, v, vw, upto = _entries(row["lengths"], row["data"])
        found = sorted(answers.to_pylist(), key=lambda a: a["part"])
        ones, pairs = (np.concatenate([np.zeros((0, k)), *(_unpacked(a["counts"], a["n"], k) for a in found if (a["part"] < parts) == (k == 4))]) for k in (4, 2))
        n = np.diff(upto)
        of, cols = np.repeat(np.arange(len(n)), n), []
        own_w, own_v, own_vw = _own(of, w, len(word)), _own(of, v, len(word)), _own(of, vw, len(pair))
        for m, member in ((0, _members(row)[of]), (1, np.ones(len(of)))):
            before = ones[v, 2 + m] - member * own_v
            one_word = (ones[w, m] - member * own_w + add) / (sums[m] - member * n[of] + add * vocabulary)
            p = np.where(before > 0, mix * (pairs[vw, m] - member * own_vw) / np.maximum(before, 1) + (1 - mix) * one_word, one_word)
            cols.append(np.bincount(of, -np.log2(p), len(n)) / np.maximum(n, 1))
        cols.append(cols[0] - cols[1])
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, mask=n == 0) for c in cols)], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    schema = "doc_id long, n_words long, target_loss double, background_loss double, score double"
    answer = counts.select("slice", "part", "n", "counts")
    return marked.groupBy("slice").cogroup(answer.groupBy("slice")).applyInArrow(apply, schema)


def _counted(name: str, by: str) -> str:
    return f"count(*) OVER (PARTITION BY {by}) AS {name}1, count(*) FILTER (good) OVER (PARTITION BY {by}) AS {name}0, count(*) OVER (PARTITION BY uid, {by}) AS {name}"


def _loss(m: int, member: str) -> str:
    one = f"((w{m} - {member} * w + {ADD}) / (all{m} - {member} * n + {ADD} * vocabulary))"
    return f"avg(-log2(CASE WHEN v{m} - {member} * v > 0 THEN {MIX} * (p{m} - {member} * p) / (v{m} - {member} * v) + {1 - MIX} * {one} ELSE {one} END))"


#: Of the query, which rounds to six digits.
ORACLE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
x AS (
  SELECT uid, good, words[i] AS a, CASE WHEN i > 1 THEN words[i - 1] ELSE '' END AS b
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM t)),
c AS (
  SELECT uid, good::INT AS good, {_counted("p", "b, a")}, {_counted("v", "b")}, {_counted("w", "a")},
    count(*) OVER (PARTITION BY uid) AS n, count(*) OVER () AS all1, count(*) FILTER (good) OVER () AS all0 FROM x),
s AS (
  SELECT uid, {_loss(0, "good")} AS target, {_loss(1, "1")} AS background
  FROM c, (SELECT count(DISTINCT a) AS vocabulary FROM x) GROUP BY uid)
SELECT doc_id, len(words)::BIGINT AS n_words, round(target, 6) + 0.0 AS target_loss, round(background, 6) + 0.0 AS background_loss, round(target - background, 6) + 0.0 AS score
FROM t LEFT JOIN s USING (uid)
"""
