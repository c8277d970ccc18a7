"""Bucketed rank and prefix sums: exact ranks without one window per group.

A window ``partitionBy(label)`` over 5 classes runs in 5 tasks, and a class
that holds most rows becomes one huge task.  Instead rows are put into
order-preserving buckets (a hex prefix of a uniform hash, or a score band),
bucket counts are aggregated into a small table (groups x buckets rows), a
window over that small table gives each bucket its offset, and the final
``row_number`` runs per (group, bucket): thousands of balanced tasks.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# A small table is broadcast only when its row count has a proven bound.
BROADCAST_ROW_BOUND = 1_000_000


def auto_hex_digits(n_rows: int | None, rows_per_bucket: int = 200_000) -> int:
    """Hex digits of the hash prefix so that a bucket holds ~rows_per_bucket."""
    if not n_rows:
        return 3
    need = max(1, n_rows // rows_per_bucket)
    return int(min(7, max(3, math.ceil(math.log(need, 16)))))


def hash_key(seed, *cols) -> Column:
    """Lower-case hex md5 of ``seed:c1:c2...`` — uniform, deterministic, and
    computed identically by most SQL engines."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")]
    return F.md5(F.concat(*parts))


def maybe_broadcast(df: DataFrame, row_bound: int) -> DataFrame:
    """Hint a broadcast only when the caller can prove the row bound."""
    return F.broadcast(df) if row_bound <= BROADCAST_ROW_BOUND else df


def bucketed_rank(df: DataFrame, group_cols: list[str], bucket: Column,
                  order_cols: list, out: str = "rank", n_buckets_bound: int = 4096,
                  n_groups_bound: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` within ``group_cols`` ordered by
    ``order_cols``; ``bucket`` must be a non-decreasing function of the order."""
    b = "_bkt"
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy(b) if group_cols else Window.orderBy(b)
    offsets = counts.select(
        *group_cols, b,
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    bound = n_buckets_bound * (n_groups_bound or 1) if (n_groups_bound or not group_cols) else 10 ** 9
    offsets = maybe_broadcast(offsets, bound)
    w2 = Window.partitionBy(*group_cols, b).orderBy(*order_cols)
    return (d.join(offsets, [*group_cols, b])
             .withColumn(out, (F.col("_off") + F.row_number().over(w2)).cast("long"))
             .drop(b, "_off"))


def bucketed_prefix_sum(df: DataFrame, group_cols: list[str], bucket: Column,
                        order_cols: list, sum_cols: list[str],
                        n_buckets_bound: int = 4096, n_groups_bound: int | None = None,
                        inclusive: bool = True) -> DataFrame:
    """Running sums of ``sum_cols`` within groups along ``order_cols`` (rows
    must be unique on group+order, e.g. after collapsing ties)."""
    b = "_bkt"
    d = df.withColumn(b, bucket)
    tot = d.groupBy(*group_cols, b).agg(*[F.sum(c).alias("_t_" + c) for c in sum_cols])
    w = Window.partitionBy(*group_cols).orderBy(b) if group_cols else Window.orderBy(b)
    offsets = tot.select(*group_cols, b, *[
        F.coalesce(F.sum("_t_" + c).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_o_" + c) for c in sum_cols])
    bound = n_buckets_bound * (n_groups_bound or 1) if (n_groups_bound or not group_cols) else 10 ** 9
    offsets = maybe_broadcast(offsets, bound)
    end = Window.currentRow if inclusive else -1
    w2 = Window.partitionBy(*group_cols, b).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    res = d.join(offsets, [*group_cols, b])
    for c in sum_cols:
        res = res.withColumn("cum_" + c, F.col("_o_" + c) + F.coalesce(F.sum(c).over(w2), F.lit(0)))
    return res.drop(b, *["_o_" + c for c in sum_cols])


def ordered_number(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): the 0-based number of every distinct value in ascending
    order.  The values are range-sorted by all tasks and stored with their
    partition-wise ids; only the partitions' row counts pass one window."""
    ids = cut_lineage(df.select(col).distinct().orderBy(col).select(
        col, F.monotonically_increasing_id().alias("_id")))  # id = partition << 33 | row
    d = ids.select(col, F.shiftright("_id", 33).alias("_part"),
                   F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return d.join(offsets, "_part").select(col, (F.col("_off") + F.col("_row")).alias(out))


def hex_bucket(hex_col: Column, digits: int = 3) -> Column:
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")
