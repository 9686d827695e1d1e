"""Quality rules: per-text counts, and lines that too many documents of a host share.

Only DataFrame functions are used. Lines are normalised (ASCII white space
collapsed, lower case), hashed with their host, and counted in distinct documents
(doc_ids) of that host. Lines in more than `max_docs` documents are removed, and a
document is rejected when it is depleted: fewer than `min_words` words are left, or
more than `max_lost` percent went. With `copies_once`, exact copies of a text on a
host count as one document, for corpora that are yet to be deduplicated: else all
copies of an often copied page would go, and none be left to keep.

Counting is by line hash and document, so a common line is summed before the shuffle;
a hot host or line is dealt by document first. Frequent lines are broadcast only if
there are at most `broadcast_rows` of them, and joined by shuffle otherwise.

Defined cases: a null or empty text has no words and fails the base rules; a very
long text is a row like any other; a null source is a host of its own; a row with a
null doc_id is a document of its own; repeated rows get one row each and are one
document; an empty table gives no rows; other columns are ignored by assess() and
kept by clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
MAX_DOCS, MIN_WORDS, MAX_LOST, BROADCAST_ROWS = 10, 50, 50, 500_000
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _line_key(line: Column, host: Column) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull(), F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def _row() -> Column:
    """Identity of a row: all that its verdict depends on. Only rows of one doc_id could be confused."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text", "source", F.col("source").isNull()).alias("h"))


def _measured(docs: DataFrame) -> DataFrame:
    """The base counts of every row, and its lines as (key, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), text.alias("text"), _row().alias("row"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    window = F.transform(
        F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.select(
        "doc_id", "host", "row",
        F.xxhash64("host", "text").alias("content"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(_line_key(x, F.col("host")).alias("key"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("words"))).alias("lines"),
        window.alias("windows"),
    )
    # Windows found twice stand side by side once sorted; most texts have none and skip the sort.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(twice, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed)
    alike = F.filter("placed", lambda x, k: F.coalesce(x.h == F.get("placed", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("placed", k + 1).h, F.lit(False)))
    rows = rows.withColumn("at", F.sort_array(F.transform(alike, lambda x: x.i)))
    own = F.transform("at", lambda p, k: F.coalesce(F.least(F.lit(3), F.get("at", k + 1) - p), F.lit(3)))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return rows.drop("windows", "placed", "at")


def _judged(docs: DataFrame, max_docs: int, min_words: int, max_lost: int, broadcast_rows: int, copies_once: bool, with_keys: bool) -> DataFrame:
    rows = stash(_measured(docs).withColumn("uid", F.monotonically_increasing_id()), "measured")
    keys = rows.select("uid", "doc_id", F.array_distinct(F.col("lines.key")).alias("keys"), "content")
    if copies_once:  # the first row of each content of a host stands for it
        keys = keys.join(keys.groupBy("content").agg(F.min("uid").alias("uid")).select("uid"), "uid", "left_semi")
        keys = keys.withColumn("doc_id", F.lit(None).cast("long"))
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("uid")))
    pairs = keys.select(document.alias("document"), F.explode("keys").alias("key")).distinct()
    often = stash(pairs.groupBy("key").count().where(F.col("count") > max_docs).select("key"), "often")
    often = F.broadcast(often) if often.count() <= broadcast_rows else often
    gone = rows.select("uid", F.explode("lines").alias("line")).select("uid", "line.key", "line.words").join(often, "key")
    sums = [F.sum("words").alias("lost_words"), F.count("*").alias("lost_lines")]
    gone = gone.groupBy("uid").agg(*sums, *([F.collect_set("key").alias("keys")] if with_keys else []))
    rows = rows.drop("lines", "content").join(gone, "uid", "left").fillna(0, ["lost_words", "lost_lines"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (left >= min_words) & (100 * F.col("lost_words") <= max_lost * F.col("n_words")))


def assess(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, max_lost: int = MAX_LOST, broadcast_rows: int = BROADCAST_ROWS, copies_once: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lost_words and lost_lines of every row."""
    rows = _judged(docs.select("doc_id", "text", "source"), max_docs, min_words, max_lost, broadcast_rows, copies_once, False)
    return rows.select("doc_id", *METRICS, "base_failed", "kept", "lost_words", "lost_lines")


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, max_lost: int = MAX_LOST, broadcast_rows: int = BROADCAST_ROWS, copies_once: bool = False) -> DataFrame:
    """The kept documents with all their columns, less the lines that are too common."""
    found = _judged(docs.select("doc_id", "text", "source"), max_docs, min_words, max_lost, broadcast_rows, copies_once, True).where("kept")
    found = found.groupBy("row").agg(F.first("keys").alias("keys"))  # repeated rows are judged alike
    rows = docs.select(_row().alias("row"), F.struct("*").alias("whole")).join(found, "row").select("keys", "whole")
    text, host = F.col("whole.text"), F.col("whole.source")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains("keys", _line_key(x, host)))), "\n")
    rows = rows.withColumn("text", F.when(F.col("keys").isNull(), text).otherwise(left))  # once, for what follows
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH w AS (
  SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (
  SELECT uid, i, row(words[i], words[i + 1], words[i + 2]) AS g
  FROM (SELECT uid, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
r AS (
  SELECT uid, count(DISTINCT p) AS n FROM (
    SELECT uid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM g) WHERE c > 1)
  GROUP BY uid),
l AS (
  SELECT uid, doc_id, source, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT uid, doc_id, source, unnest(lines) AS line FROM t)),
o AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
x AS (
  SELECT uid, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))::BIGINT AS lost_words, count(*) AS lost_lines
  FROM l JOIN o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY uid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lost_words, 0)::BIGINT AS lost_words, coalesce(lost_lines, 0)::BIGINT AS lost_lines
  FROM t LEFT JOIN r USING (uid) LEFT JOIN x USING (uid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - lost_words >= {MIN_WORDS} AND 100 * lost_words <= {MAX_LOST} * n_words AS kept, lost_words, lost_lines
FROM f
"""
