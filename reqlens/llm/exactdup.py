"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A text is cut after white space whose neighbours belong to a fixed class of characters, at least MIN_CHUNK and at
most MAX_CHUNK characters after the last cut, so cuts depend on nearby characters only, and texts that share a
passage share its chunks (texts without white space are cut at MAX_CHUNK). A chunk's identifier is a pair of 64-bit
hashes. Identifiers are verified: the distinct chunks are compared as a whole, each moved once, and if two different
ones share an identifier, all are renamed with other seeds and verified again. A text's recipe is the ordered list
of its identifiers. Texts are equal exactly where their recipes are, so from there on only recipes move, 16 bytes
for some 300 characters.

A group of equal texts may hold any share of the rows: it is counted in as many salted parts as there are shuffle
partitions, and rows meet their group's result by recipe and salt.

Defined cases: a null text counts as empty; the row with the largest doc_id stays, null being the smallest; of rows
that repeat it, exactly one stays; a group whose ids are all null has keep_id null and keeps one row; every row is
returned, repeated ones too; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import shuffle_partitions, stored, table

MIN_CHUNK = 192
MAX_CHUNK = 2048
#: Characters on both sides of the white space at a cut: visible ASCII whose code divides by this.
CUT_MODULUS = 4
MIN_SALTS = 64

Namer = Callable[[Column, int], list[Column]]


def chunk_pattern(shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> str:
    """The regular expression that matches one chunk after the other."""
    side = "[" + "".join(f"\\x{c:02x}" for c in range(33, 127) if c % CUT_MODULUS == 0) + "]"
    return rf"(?s).{{{shortest},{longest}}}?(?={side})(?<={side}\s)|.{{1,{longest}}}"


def chunks_of(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(shortest, longest)), F.lit(0))


def two_hashes(chunk: Column, attempt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * attempt + i), chunk) for i in range(2)]


def clashes(texts: DataFrame, namer: Namer, attempt: int, **sizes: int) -> DataFrame:
    """Identifiers that two different chunks share."""
    chunk = texts.select(F.explode(chunks_of(F.col("text"), **sizes)).alias("chunk"))
    a, b = namer(F.col("chunk"), attempt)
    distinct = chunk.select(a.alias("a"), b.alias("b"), "chunk").groupBy("a", "b", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("a", "b").agg(F.sum("one").alias("n")).filter("n > 1").select("a", "b")


def verified_attempt(texts: DataFrame, namer: Namer = two_hashes, **sizes: int) -> int:
    """The first number of seeds with which no two different chunks share an identifier."""
    return next(k for k in count() if clashes(texts, namer, k, **sizes).isEmpty())


def duplicate_groups(docs: DataFrame, namer: Namer = two_hashes, shortest: int = MIN_CHUNK,
                     longest: int = MAX_CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of ``docs``."""
    spark, sizes = docs.sparkSession, {"shortest": shortest, "longest": longest}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    attempt = verified_attempt(texts, namer, **sizes)
    salts = max(MIN_SALTS, shuffle_partitions(spark))
    recipe = F.flatten(F.transform(chunks_of(F.col("text"), **sizes), lambda c: F.array(*namer(c, attempt))))
    rows = stored(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), recipe.alias("recipe"),
                               F.monotonically_increasing_id().alias("rid"))
                  .withColumn("salt", (F.xxhash64("rid") % salts).cast("int")), "recipes")
    # the kept row has the largest doc_id; max_by skips null ids, so a group without ids keeps its last row
    salted = rows.groupBy("recipe", "salt").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("top"), F.max_by("rid", "doc_id").alias("top_rid"),
        F.max("rid").alias("last"))
    salted = stored(salted, "salted-groups")
    groups = stored(salted.groupBy("recipe").agg(
        F.sum("n").alias("group_size"), F.max("top").alias("keep_id"),
        F.coalesce(F.max_by("top_rid", "top"), F.max("last")).alias("keep_rid")), "groups")
    found = salted.select("recipe", "salt").join(groups, "recipe")
    return rows.join(found, ["recipe", "salt"]).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), (F.size("recipe") / 2).cast("int").alias("n_chunks"))


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""
