"""Near-duplicate documents by SuperMinHash signatures.

1. A document's set is its distinct 5-word shingles (64-bit hashes). Documents with
   the same set are one class from here on, so copies cost one row each.
2. SuperMinHash: every element deals a pseudo-random permutation of the `size`
   places, drawn step by step; at step j it offers j + u (u uniform) to the j-th
   place of its permutation, and a place keeps the least. All elements of a
   document take step j together, and the document stops before step j once every
   place holds less than j, as no later offer can be less. Long texts stop after a
   step or two.
3. Banding: `size / rows` bands. Classes in one bucket are compared with the
   bucket's first class (pairs grow with the bucket, not with its square), if their
   signatures agree in at least `least` places (a link agrees in fewer with a chance
   of about 1e-7). Links are confirmed on the full sets, grouped by union-find, and
   this is done again with the first class that is not in the first one's group.
4. Whatever then still lies in another group than its bucket's largest is compared
   with all of the bucket, by signatures and then on the full sets, inside the join:
   links come out of it, not pairs. It is dealt by bucket and salt, as many salts as
   a bucket's comparisons need, and a pair counts only in the first bucket that it
   shares. So no link is given up for the size of a bucket, and no bucket is one task.
5. Union-find grouping: a task merges the links it has into a forest. What is left
   is finished by one task if it is at most `ONE_TASK` links, and by large-star and
   small-star rounds over tables beyond that; never on the driver.

With 64 places in 16 bands of 4, a link at similarity 0.85 shares no band with a
chance of 7e-6.

Defined cases: fewer words than a shingle make one shingle of the whole sequence;
a text without words, or null, has an empty set, no links and its own component; a
null doc_id is kept, links nothing and has a null component; a very long text is
signed in pieces of its set; rows of equal doc_ids and different texts are documents
of their own, which share a number; an empty table gives no rows; other columns are
ignored by components() and kept by deduplicated(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, lean, mix64, rolling, row_key, slices, stash, text_bytes, window_starts, word_hashes, words

SHINGLE, SIZE, ROWS, THRESHOLD, LEAST = 5, 64, 4, 85, 40
#: Comparisons of signatures that one task makes for a bucket.
PAIRS = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each document's distinct shingles, sorted, end to end, and the bounds of each document's."""
    low = _LOWER[data]
    start, end, upto = words(low, off)
    n = np.diff(upto)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = word_hashes(low, start, end)
    at = window_starts(upto, k)
    h, doc = rolling(word, k)[at], np.searchsorted(upto, at, "right") - 1
    for m in range(1, k):  # whole texts of fewer words
        short = np.flatnonzero(n == m)
        if len(short):
            h, doc = np.append(h, mix64(rolling(word, m)[upto[short]] + np.uint64(m))), np.append(doc, short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    own = np.ones(len(h), bool)
    own[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[own], np.searchsorted(doc[own], np.arange(len(n) + 1))


#: Elements that are signed at once.
PIECE = 1 << 20


def super_minhash(h: np.ndarray, upto: np.ndarray, size: int = SIZE, piece: int = PIECE) -> np.ndarray:
    """Signatures of shape (documents, size): which element won each place, as 64-bit hashes; 0 for empty sets."""
    if len(h) <= piece:
        return _offers(h, upto, size)[1]
    sig = np.zeros((len(upto) - 1, size), np.uint64)
    for d, (s, e) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
        best = np.full(size, np.inf)
        for at in range(s, e, piece):
            offer, won = (x[0] for x in _offers(h[at : min(e, at + piece)], np.array([0, min(e, at + piece) - at]), size))
            less = offer < best
            best[less], sig[d, less] = offer[less], won[less]
    return sig


def _offers(h: np.ndarray, upto: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least offer of each place, and who made it."""
    docs = len(upto) - 1
    best = np.full((docs, size), np.inf)
    sig = np.zeros((docs, size), np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(upto))
    perm: np.ndarray | None = None
    for j in range(size):
        # Early stop: only documents with a place at j or more can still change.
        live = np.flatnonzero(~(best < j).all(axis=1) & (np.diff(upto) > 0)) if j else np.flatnonzero(np.diff(upto) > 0)
        if not len(live):
            break
        use = np.zeros(docs, bool)
        use[live] = True
        keep = use[doc]
        h, doc = h[keep], doc[keep]
        perm = np.tile(np.arange(size, dtype=np.uint8), (len(h), 1)) if perm is None else perm[keep]
        draw = mix64(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((draw >> np.uint64(40)) * np.uint64(size - j) >> np.uint64(24)).astype(np.int64)
        rows = np.arange(len(h))
        place = perm[rows, k]
        perm[rows, k] = perm[:, j]
        low = draw & np.uint64((1 << 32) - 1)
        cell = doc * size + place
        order = np.argsort(cell.astype(np.uint64) << np.uint64(32) | low, kind="stable")
        cell = cell[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        order, cell = order[first], cell[first]
        offer, won = j + low[order] / 2.0**32, h[order]
        less = offer < best.ravel()[cell]
        best.ravel()[cell[less]] = offer[less]
        sig.ravel()[cell[less]] = mix64(won[less] + np.uint64(1))
    return best, sig


def signatures(docs: DataFrame, k: int = SHINGLE, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """doc_id, h (of doc_id and text), n_shingles, set_a and set_b (of the whole set), bands, and four bits of each place as longs s0 .. s3."""
    schema = "doc_id long, h long, n_shingles long, set_a long, set_b long, bands array<long>, s0 long, s1 long, s2 long, s3 long"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, off = flat(batch.column(2))
            h, upto = shingle_sets(data, off, k)
            n = np.diff(upto)
            a, b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (h, mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
            sig = super_minhash(h, upto, size)
            band = np.stack([_fold(sig[:, i : i + rows], i) for i in range(0, size, rows)], axis=1)
            bits = [np.bitwise_or.reduce((sig >> np.uint64(8 + i) & np.uint64(1)) << np.arange(size, dtype=np.uint64), axis=1) for i in range(4)]
            signed = [x.view(np.int64) for x in (a[upto[1:]] - a[upto[:-1]], b[upto[1:]] - b[upto[:-1]])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, band.shape[1]), pa.int32()), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), *map(pa.array, signed), lists, *(pa.array(x.view(np.int64)) for x in bits)],
                names=["doc_id", "h", "n_shingles", "set_a", "set_b", "bands", "s0", "s1", "s2", "s3"],
            )

    return docs.select(row_key().alias("row"), text_bytes().alias("text")).select("row.*", "text").mapInArrow(lean(sign), schema)


def _fold(part: np.ndarray, band: int) -> np.ndarray:
    h = np.full(len(part), band + 1, np.uint64)
    for col in part.T:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + col)
    return h


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the ids wanted: (id, row), row being of a document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = flat(batch.column(1))
            h, upto = shingle_sets(data, off, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(h.view(np.int64)))], names=["id", "shingles"])

    texts = docs.select(row_key().alias("row"), text_bytes().alias("text"))
    # The same plan at every size: which ids are wanted grows with the corpus.
    return texts.join(ids.hint("merge"), "row").select("id", "text").mapInArrow(lean(sets), "id long, shingles array<long>")


def _similar(x: str, y: str, threshold: int) -> Column:
    same = F.size(F.array_intersect(x, y))
    return 100 * same >= threshold * (F.size(x) + F.size(y) - same)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: each node with the least of its group there."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def rows() -> pa.RecordBatch:
        kept = [(top(x), x) for x in list(up) if top(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 500_000:  # what is merged so far goes on; memory stays bounded
            yield rows()
            up.clear()
    yield rows()


#: Links (already merged by task) that one task can hold and finish alone.
ONE_TASK = 200_000


def groups(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of every linked node, component being the least id reachable."""
    links = stash(links.select("a", "b").mapInArrow(lean(_forest), "a long, b long"), "links")
    if links.count() <= one_task:
        return stash(links.coalesce(1).mapInArrow(lean(_forest), "a long, b long"), "links").select(F.col("b").alias("id"), F.col("a").alias("component"))
    while True:
        # Large star: each node's larger neighbours go to its least neighbour; small star: the others do.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = large.distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        new = stash(small, "links")
        # Stable: the same links as before.
        if new.count() == links.count() and new.join(links, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("b").alias("id"), F.col("a").alias("component"))
        links = new


def _alike(threshold: int, least: int) -> Column:
    """Whether sets n, s0 .. s3 and other_n, t0 .. t3 can be linked: by size, and by places that agree in four bits."""
    differ = F.lit(0).cast("long")
    for i in range(4):
        differ = differ.bitwiseOR(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}")))
    size = threshold * F.greatest("n", "other_n") <= 100 * F.least("n", "other_n")
    return size & (SIZE - F.bit_count(differ) >= least)


_SKETCH = ["n", "s0", "s1", "s2", "s3"]


def _other(row: str = "") -> list[Column]:
    return [F.col(f"{row}{x}").alias(y) for x, y in zip(_SKETCH, ["other_n", "t0", "t1", "t2", "t3"], strict=True)]


def _linked(classes: DataFrame, docs: DataFrame, k: int, threshold: int, least: int) -> DataFrame:
    """Confirmed links between classes that suffice to join whatever is linked."""
    members = classes.select("id", "row", F.col("n_shingles").alias("n"), *_SKETCH[1:], F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = stash(members.join(shared, "bucket"), "members")
    sets = stash(_sets(members.select("id", "row").distinct(), docs, k), "sets")
    members = members.drop("row")
    links, component = None, None
    for turn in range(2):
        rows = members.withColumn("component", F.col("id")) if component is None else members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        for _ in range(turn + 1):  # the first one of a bucket; then the first of those that are not with that one
            first = rows.groupBy("bucket").agg(F.min(F.struct("component", "id", *_SKETCH)).alias("first"))
            first = first.select("bucket", F.col("first.id").alias("a"), F.col("first.component").alias("c"), *_other("first."))
            rows = rows.drop("a", "c", "other_n", "t0", "t1", "t2", "t3").join(first, "bucket").where("component <> c")
        pairs = rows.where(_alike(threshold, least)).select("a", F.col("id").alias("b")).distinct()
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        found = stash(both.where(_similar("x", "y", threshold)).select("a", "b"), "links")
        links = found if links is None else links.union(found)
        component = groups(links)
    # What is still in another group than the bucket's largest meets all of the bucket. Pairs are
    # confirmed inside the join, which puts out links alone.
    rows = members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rows.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("all"), F.count("*").alias("parts"))
    salts = F.ceil((F.col("all") - F.col("most.count")) * F.col("all") / F.lit(PAIRS)).cast("long").alias("salts")
    rows = rows.join(sizes.where("parts > 1").select("bucket", F.col("most.component").alias("main"), salts), "bucket")
    rows = rows.join(classes.select("id", "bands"), "id").join(sets, "id")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("main", "salts")
    rest = rows.where("component <> main").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("id").alias("a"), F.col("component").alias("c"), F.col("shingles").alias("x"), F.col("bands").alias("other_bands"), *_other())
    # Signatures first; a pair counts in the first bucket that it shares.
    alike = (F.col("component") != F.col("c")) & _alike(threshold, least) & (F.get(F.array_intersect("bands", "other_bands"), F.lit(0)) == F.col("bucket"))
    near = rest.join(dealt, ["bucket", "salt"]).where(alike & _similar("x", "shingles", threshold))
    return links.union(near.select("a", F.col("id").alias("b")))


def _grouped(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, size: int = SIZE, rows: int = ROWS, least: int = LEAST) -> DataFrame:
    """doc_id, h, n_shingles, component_id of every row, and first: the least row of its group."""
    signed = stash(signatures(docs, k, size, rows), "signatures").withColumn("row", F.struct("doc_id", "h"))
    same, alike = ["n_shingles", "set_a", "set_b"], ["bands", *_SKETCH[1:]]  # equal sets have equal signatures
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in alike))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = groups(_linked(classes, docs, k, threshold, least))
    classes = classes.select(*same, "id", "row").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = classes.groupBy("component").agg(F.min("row").alias("first"))
    classes = classes.join(first, "component").select(*same, "first")
    out = signed.join(classes, same, "left").withColumn("first", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "row")))
    return out.select("doc_id", "h", "n_shingles", F.col("first.doc_id").alias("component_id"), "first")


def components(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _grouped(docs, **options).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each group, the one of the least doc_id, with all columns; of rows with equal doc_ids and texts one stays."""
    kept = _grouped(docs, **options).select(F.col("first").alias("row")).where("row is not null").distinct()
    rows = docs.select(row_key().alias("row"), F.struct("*").alias("whole"))
    nulls = docs.where(F.col("doc_id").isNull())
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("whole.*").unionByName(nulls)


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING) AS s FROM x),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - {SHINGLE - 1}, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN z AS y ON y.doc_id = a JOIN z ON z.doc_id = b WHERE 100 * c >= {THRESHOLD} * (y.n + z.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, coalesce(max(z.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, id = min(root) AS kept FROM r LEFT JOIN z ON z.doc_id = id GROUP BY id
"""
