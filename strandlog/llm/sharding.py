"""Proportional stratified interleaving: every shard gets each source's share of rows.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional
rank is (rank - 1/2) / rows of the source; all rows are sorted by fractional rank
and cut into shards whose counts are at most one apart (law `rows`).

Neither ranking is one window over a source or over the table: hash order and
fractional rank are each cut into contiguous buckets, as many as the rows need, rows
are ranked in their bucket, and the counts of the buckets before are added. A source
that holds a third of all rows is thus dealt to all tasks. The number of buckets does
not change the result.

Defined cases: ties in the hash or in the fractional rank are broken by doc_id (null
first), checksum, size and source; a very long text is a row like any other; a null
source is a source of its own, apart from an empty one; a
null text has size `overhead` and checksum 0; a null doc_id is kept; repeated rows
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Buckets of the shuffled order of a source, and of the fractional ranks, at least; and rows of one bucket, about.
BUCKETS, BUCKET_ROWS = 1024, 100_000
SHARDS, SEED, OVERHEAD = 40, 20240229, 16


def _places(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Adds place (from 0 within keys) and total: rows ordered by bucket, then order."""
    counts = rows.groupBy(*keys, bucket).count()
    whole = Window.partitionBy(*keys)  # a line for each bucket, not for each row
    upto = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, bucket, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"), F.sum("count").over(whole).alias("total"))
    own = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = rows.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(before, [*keys, bucket]).withColumn("place", F.col("own") + F.col("before")).drop("own", "before")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))).alias("stratum"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    # The text is read once; what follows works on rows of some 40 bytes.
    rows = stash(rows, "sizes")
    buckets = max(buckets, rows.count() // BUCKET_ROWS)
    told = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"))
    rows = rows.withColumn("h", F.conv(F.substring(told, 1, 15), 16, 10).cast("long"))  # below 2 ** 60
    tie = ["h", "doc_id", "text_crc32", "size"]
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("h", 30) * buckets, 30).cast("int"))
    rows = _places(rows, ["stratum"], "bucket", tie).drop("bucket")
    rows = rows.withColumn("share", (F.col("place") + 0.5) / F.col("total")).drop("place", "total")
    rows = rows.withColumn("bucket", F.floor(F.col("share") * buckets).cast("int")).withColumn("all", F.lit(0))
    rows = _places(rows, ["all"], "bucket", ["share", *tie, "stratum"])
    shard = F.floor(F.expr(f"place * {shards} div total"))
    return rows.withColumn("shard", shard).select(
        "doc_id",
        F.expr("if(stratum like '0%', null, substring(stratum, 2))").alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
ORACLE = f"""
WITH z AS (SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
t AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
    xor(list_reduce([4294967295] || {_BYTES}, lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, z),
h AS (SELECT *, ('0x' || md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), text_crc32, size))[:15])::BIGINT AS h FROM t),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS share FROM h),
p AS (
  SELECT *, row_number() OVER (ORDER BY share, h, doc_id NULLS FIRST, text_crc32, size, source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM r),
s AS (SELECT *, place * {SHARDS} // n AS shard FROM p)
SELECT doc_id, source, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
  (place - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
