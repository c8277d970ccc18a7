"""Numbers of rows within groups in a given order, without a task that holds a group.

All rows are sorted by group and order across tasks and stored with their place in the sort. What a window then
reads is one row for each group in each sorted part, however large the groups are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm.common import stored


def sorted_parts(df: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """``df``, stored in the order of ``group`` and ``order``, with ``part`` (number of the sorted part) and ``row``
    (place in it). Rows that are equal in all of these are split between parts as well."""
    ids = F.monotonically_increasing_id()
    rows = stored(df.withColumn("tie", ids), "unsorted").orderBy(group, *order, "tie").drop("tie")
    rows = rows.withColumn("place", F.monotonically_increasing_id())  # part << 33 | row
    return stored(rows.withColumn("part", F.shiftright("place", 33)).withColumn(
        "row", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place"), "sorted")


def part_offsets(rows: DataFrame, group: str) -> DataFrame:
    """part, ``group``, shift, n for rows of sorted_parts: row + shift is the number of a row in its group, from 0,
    and n the size of the group."""
    seen = rows.groupBy("part", group).agg(F.count("*").alias("here"), F.min("row").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.select("part", group, (before - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"))


def numbered(df: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """``df`` with ``idx``, the number of a row in its group from 0, and ``n``, the size of the group. ``group``
    holds no nulls."""
    rows = sorted_parts(df, group, *order)
    return rows.join(part_offsets(rows, group), ["part", group]).withColumn(
        "idx", F.col("row") + F.col("shift")).drop("part", "row", "shift")
