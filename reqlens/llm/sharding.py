"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are ranked in a seeded random order within their source. Row number r of a source with n rows has
the fractional rank (r - 1 + u) / n, where u in [0, 1) is a fixed hash of the source. All rows sorted by
fractional rank are cut into shards whose row counts differ by at most one, so every shard holds every
source in proportion.

Neither sort holds a source or the table in one task: rows fall into buckets by a prefix of their sort
key, counts by bucket give each bucket its offset, and only the rows of a bucket are numbered together.

Defined cases: a null source is a stratum of its own; a null or empty text counts 0 bytes (plus 8) and
crc32 0; a null id sorts as the text "null"; repeated rows are rows of their own; equal texts may lie in
different shards, since a group of copies can exceed a shard; an empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reqlens.llm.common import stored, table

N_SHARDS = 24
SEED = 42
ROWS_PER_BUCKET = 2000


def bucket_digits(n: int) -> int:
    """Hex digits of a bucket number: about ROWS_PER_BUCKET rows a bucket, 16^2 to 16^5 buckets."""
    return min(5, max(2, math.ceil(math.log(max(1, n) / ROWS_PER_BUCKET, 16)) if n > ROWS_PER_BUCKET else 2))


def stratified_shards(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("h"),
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("stratum"))
    total = rows.count()
    digits = bucket_digits(total)
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    # offset of each (stratum, bucket): a window over at most 16^digits counts of a stratum
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    of_stratum = Window.partitionBy("stratum")
    before = of_stratum.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("stratum", "bucket",
                                   F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                                   F.sum("n").over(of_stratum).alias("n_stratum")), "strata")
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.join(offsets, ["stratum", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(in_bucket))
    u = F.conv(F.substring(F.md5("stratum"), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    frac = (F.col("rank") - 1 + u) / F.col("n_stratum")
    ranked = stored(ranked.withColumn("frac", frac).withColumn(
        "part", F.least(F.floor(F.col("frac") * 16 ** digits), F.lit(16 ** digits - 1)))
        .select("doc_id", "source", "size", "text_crc32", "frac", "part", "h", "stratum"), "ranked")
    # offset of each slice of the fractional ranks: at most 16^digits counts in all
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    prior = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("part", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before")), "parts")
    in_part = Window.partitionBy("part").orderBy("frac", "stratum", "h", "doc_id", "text_crc32", "size")
    place = (F.col("before") + F.row_number().over(in_part) - 1).cast("long")
    n = F.lit(max(1, total)).cast("long")
    shard = F.expr(f"(place * {n_shards}) div {max(1, total)}")
    return (ranked.join(parts, "part").withColumn("place", place).withColumn("shard", shard.cast("int"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("place") - F.expr(f"(shard * {max(1, total)}L + {n_shards - 1}) div {n_shards}"))
                    .cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "source"))


def op9_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH r AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 8 AS size, text,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
             CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS rk, count(*) OVER (PARTITION BY stratum) AS n
      FROM r),
f AS (SELECT *, (rk - 1 + CAST(CAST('0x' || substr(md5(stratum), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0) / n
             AS frac FROM k),
g AS (SELECT *, row_number() OVER (ORDER BY frac, stratum, h) - 1 AS place, count(*) OVER () AS total FROM f),
s AS (SELECT *, CAST((place * {N_SHARDS}) // total AS INTEGER) AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc.c AS text_crc32, 'rows' AS law, shard,
       CAST(place - (CAST(shard AS BIGINT) * total + {N_SHARDS - 1}) // {N_SHARDS} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, source
FROM s JOIN crc USING (doc_id)
"""
