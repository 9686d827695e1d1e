"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. Each mask is laid on every
token position where it fits and hashes the tokens at its ones; the tokens at its
zeros may differ. Every window that the verification accepts has a seed: however
three of 13 tokens differ, one of the six masks meets agreeing tokens only. A
shorter item of n tokens, d of which may differ, has its runs of n / (d + 1) tokens
as seeds, of which one agrees; so has the window itself if other masks, windows or
shares are given. Documents are searched for the lengths of run that the items
need. Hashes of benchmark and training texts are joined, hits are reduced to
diagonals (document, item, distance of the positions), and each diagonal is
verified: the best window of `window` aligned tokens (all of a shorter item) must
agree in at least `share` percent of its places.

Seeds of the benchmark, its items and the hits are each broadcast only if they are
counted and at most `broadcast_rows`; otherwise the same join is shuffled, by texts
and not by their tokens, which are larger. What is shuffled for a document before
are its hits, already distinct within the task that found them. Where one token is
said over and over, only the first places of the run are searched: the others see the
same tokens all around.

Defined cases: a null or empty text has no tokens and no hits; a very long text is
searched like any other, and read once more if it has hits; an item shorter than the
window is compared as a whole, with its own number of differing tokens; a null doc_id
or item_id is kept; repeated rows give the rows of one; empty tables give no rows;
other columns are ignored by overlaps() and kept by decontaminated(), whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stash

#: Ones are compared, zeros ignored. SQL has the first three, which leave 56 of the 286 ways to differ in three of 13 tokens without a seed; the others have those.
SQL_MASKS = ("1101010011", "1011001101", "1110000111")
MASKS = (*SQL_MASKS, "1110111", "11101101", "11011011")
WINDOW, SHARE, BROADCAST_ROWS = 13, 75, 1_000_000
TOKEN = r"[\p{L}\p{N}]+"


def _tokens() -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def _run(n: int, share: int) -> str:
    """The mask of which every match of n tokens has an agreeing place: n - ceil(share * n / 100) tokens may differ."""
    return "1" * max(1, n // (n + -share * n // 100 + 1))


def _deep(window: int, span: int) -> Column:
    """Whether any window around a seed at this position, or at the one before, has one token only."""
    at, size = F.col("at"), F.lit(2 * window + span - 1)
    inside = (at >= window) & (at + window + span <= F.size("tokens"))
    return inside & (F.get("tokens", at) == F.get("tokens", at + 1)) & (F.slice("tokens", at - window + 1, size) == F.slice("tokens", at - window + 2, size))


def _seeds(rows: DataFrame, keys: list[str], masks: dict[str, Column], window: int = 0) -> DataFrame:
    """keys, at, seed: the hash of every mask, for the rows that its condition holds for, at every position where it fits. window: of texts that are searched."""
    last = F.size("tokens") - min(map(len, masks))
    rows = rows.where(last >= 0).select(*keys, "tokens", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    if window:
        rows = rows.where(~_deep(window, max(map(len, masks))))
    seeds = [
        F.when(use & (F.col("at") <= F.size("tokens") - len(mask)), F.xxhash64(F.lit(m), *(F.get("tokens", F.col("at") + i) for i, c in enumerate(mask) if c == "1")))
        for m, (mask, use) in enumerate(masks.items())
    ]
    return rows.select(*keys, "at", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_same (agreeing tokens of the best window), n_window: a row for each document and item that overlap."""
    return _verified(docs, benchmark, masks, window, share, broadcast_rows).groupBy(F.col("row.doc_id").alias("doc_id"), "item_id").agg(F.max(F.struct("n_same", "n_window")).alias("best")).select("doc_id", "item_id", "best.*")


def _verified(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], window: int, share: int, broadcast_rows: int) -> DataFrame:
    items = benchmark.select("item_id", "text").distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", _tokens().alias("tokens"))
    n = F.size("tokens")
    lengths = [r.n for r in items.select(n.alias("n")).where((n > 0) & (n < window)).distinct().collect()]  # fewer than window
    known = (masks, window, share) == (MASKS, WINDOW, SHARE)
    use = {m: n >= window for m in (*masks, *([] if known else [_run(window, share)]))}
    for k in lengths:
        use[_run(k, share)] = use.get(_run(k, share), F.lit(False)) | (n == k)
    seeds = stash(_seeds(items, ["item"], use).withColumnRenamed("at", "item_at"), "seeds")
    seeds = F.broadcast(seeds) if seeds.count() <= broadcast_rows else seeds
    rows = docs.select(row_key().alias("row"), "text")
    hits = _seeds(rows.select("row", _tokens().alias("tokens")), ["row"], dict.fromkeys(use, F.lit(True)), window).join(seeds, "seed")
    hits = stash(hits.select("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    hits = F.broadcast(hits) if hits.count() <= broadcast_rows else hits
    items = stash(items.where(n > 0).select("item", "item_id", F.col("tokens").alias("other")), "items")
    items = F.broadcast(items) if items.count() <= broadcast_rows else items
    near = rows.join(hits, "row").select("row", "item", "shift", _tokens().alias("tokens")).join(items, "item")
    same = F.transform("other", lambda x, i: F.coalesce((x == F.get("tokens", i + F.col("shift"))).cast("int"), F.lit(0)))
    near = near.withColumn("n_window", F.least(F.lit(window), F.size("other"))).withColumn("same", same)
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("n_window") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("n_window")), F.lit(0), lambda a, x: a + x))
    near = near.select("row", "item_id", F.array_max(sums).cast("long").alias("n_same"), F.col("n_window").cast("long").alias("n_window"))
    return near.where(100 * F.col("n_same") >= share * F.col("n_window"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    found = stash(_verified(docs, benchmark, masks, window, share, broadcast_rows).select("row").distinct(), "found")
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    rows = docs.select(row_key().alias("row"), F.struct("*").alias("whole"))
    return rows.join(found, "row", "left_anti").select("whole.*")


def _sql_seed(m: int, mask: str) -> str:
    return f"concat_ws(' ', '{m}:', " + ", ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1") + ")"


_SEEDS = ", ".join(_sql_seed(m, mask) for m, mask in enumerate(SQL_MASKS))
ORACLE = rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM benchmark),
ds AS (SELECT id, i, unnest([{_SEEDS}]) AS s FROM (SELECT id, w, unnest(range(1, len(w) - {max(map(len, SQL_MASKS)) - 2})) AS i FROM d)),
bs AS (SELECT id, i, unnest([{_SEEDS}]) AS s FROM (SELECT id, w, unnest(range(1, len(w) - {max(map(len, SQL_MASKS)) - 2})) AS i FROM b)),
h AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (s)),
e AS (
  SELECT doc_id, item_id, shift, j, least({WINDOW}, len(b.w)) AS n_window, len(b.w) AS n,
    CASE WHEN j + shift >= 1 AND d.w[j + shift] = b.w[j] THEN 1 ELSE 0 END AS same
  FROM h JOIN d ON h.doc_id = d.id JOIN b ON h.item_id = b.id, unnest(range(1, len(b.w) + 1)) AS r(j)),
s AS (
  SELECT doc_id, item_id, n_window, j, n, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM e)
SELECT doc_id, item_id, max(k)::BIGINT AS n_same, max(n_window)::BIGINT AS n_window
FROM s WHERE j <= n - n_window + 1 GROUP BY doc_id, item_id HAVING 100 * max(k) >= {SHARE} * max(n_window)
"""
