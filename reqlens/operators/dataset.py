"""Labeled dataset operators: dedup, weak labels, masking, gold override,
exact stratified splits and folds (A1, P1–P7, X1–X3, U3)."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_expr, label_id_expr, mask_expr
from ..schema import (CV_FOLDS, DEFAULT_LEXICON, MASK_TOKEN, SEED, TEST_SIZE, VAL_SIZE, LabelSchema,
                      Lexicon)
from ..session import stored
from .rank import auto_hex_digits, bucketed_rank, hash_key, hex_bucket


def with_labels(df: DataFrame, text_col: str = "text", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add ``label`` (weak, rule based) and ``label_id``."""
    return (df.withColumn("label", label_expr(F.col(text_col), lexicon))
              .withColumn("label_id", label_id_expr(F.col("label"), lexicon.schema)))


def with_mask(df: DataFrame, text_col: str = "text", lexicon: Lexicon = DEFAULT_LEXICON,
              token: str = MASK_TOKEN, out: str | None = None) -> DataFrame:
    return df.withColumn(out or text_col, mask_expr(F.col(text_col), lexicon, token))


def pack_ord(*parts: tuple[str, int]) -> Column:
    """Pack ordering keys into one BIGINT: (col, bits) from most to least
    significant, so ``min`` hash-aggregates instead of a sort-based struct min.
    A key that does not fit its bits (the first: what the others leave of 63)
    raises an error, since two rows would otherwise share an ordinal."""
    out = None
    for i, (name, bits) in enumerate(parts):
        c = F.col(name).cast("long")
        room = 63 - sum(b for _, b in parts[1:]) if i == 0 else bits
        if room < 1:
            raise ValueError("the ordering keys need more than 63 bits")
        fits = (c >= 0) if room == 63 else (c >= 0) & (c < F.lit(1 << room))
        c = F.when(c.isNull() | fits, c).otherwise(F.raise_error(F.lit(f"{name} needs more than {room} bits")))
        out = c if out is None else F.shiftleft(out, bits) + c
    return out


def dedup_first(df: DataFrame, text_col: str = "text", ord_col: str = "ord") -> DataFrame:
    """Exact-text dedup keeping the first row by ``ord`` (unique).

    Texts are grouped by (md5, length) — a 16-byte key instead of the text —
    and the surviving ordinals semi-join the rows back: the long text column is
    shuffled once.  Partial aggregation collapses a hot text (many copies)
    before the shuffle."""
    keep = (df.groupBy(F.md5(F.col(text_col)).alias("_h"), F.length(F.col(text_col)).alias("_l"))
              .agg(F.min(ord_col).alias(ord_col)))
    return df.join(keep.select(ord_col), ord_col, "left_semi")


def dedup_first_by(df: DataFrame, order_cols: list[str], text_col: str = "text") -> DataFrame:
    """Exact-text dedup keeping the first row by the ordering columns, compared
    one after the other (unique together, none null).  The least key of a text
    is a struct of them, so no key has to fit a packed number; texts are grouped
    by (md5, length) as in ``dedup_first``."""
    first = df.groupBy(F.md5(F.col(text_col)).alias("_h"), F.length(F.col(text_col)).alias("_l")).agg(
        F.min(F.struct(*order_cols)).alias("_k"))
    return df.join(first.select("_k.*"), order_cols, "left_semi")


def apply_override(df: DataFrame, gold: DataFrame, text_col: str = "text",
                   schema: LabelSchema | None = None) -> DataFrame:
    """Gold labels (``text``, ``label``) replace weak labels by exact text;
    ``overridden`` = 1 where a gold label exists.  Gold rows are made unique
    per text first (smallest label wins a conflict) so no row is multiplied."""
    schema = schema or LabelSchema()
    g = gold.groupBy(F.col(text_col).alias("_gt")).agg(F.min("label").alias("_gl"))
    out = df.join(g, df[text_col] == g["_gt"], "left")
    return (out.withColumn("overridden", F.col("_gl").isNotNull().cast("int"))
               .withColumn("label", F.coalesce(F.col("_gl"), F.col("label")))
               .withColumn("label_id", label_id_expr(F.col("label"), schema))
               .drop("_gt", "_gl"))


def label_inconsistencies(df: DataFrame, schema: LabelSchema | None = None) -> DataFrame:
    """Rows whose ``label_id`` disagrees with the schema's id of ``label``."""
    expected = label_id_expr(F.col("label"), schema)
    return df.filter(~F.col("label_id").eqNullSafe(expected))


# --------------------------------------------------------------------------- #
# Exact stratified split
# --------------------------------------------------------------------------- #


@dataclass
class SplitPlan:
    stratified: bool
    n: int
    n_keep: int
    quotas: dict  # label -> rows kept (stratified only)


def plan_split(counts: dict, frac: float) -> SplitPlan:
    """Decide the split mode and per-class quotas from class counts (k rows).

    Held-out size = ceil(n·frac) (rounded to 9 dp first, so 0.1/0.8·100 gives
    13).  Stratify only if every class has ≥ 2 rows and both sides can hold
    one row per class (guard uses half-even rounding).  Kept side per class by
    largest remainder; ties go to the smaller class, then label order."""
    n = sum(counts.values())
    k = len(counts)
    n_test = math.ceil(round(n * frac, 9))
    n_keep = n - n_test
    guard_test = int(round(n * frac))
    strat = bool(counts) and min(counts.values()) >= 2 and guard_test >= k and (n - guard_test) >= k
    quotas = {}
    if strat:
        fl = {c: v * n_keep // n for c, v in counts.items()}
        fr = {c: v * n_keep % n for c, v in counts.items()}
        extra = n_keep - sum(fl.values())
        order = sorted(counts, key=lambda c: (-fr[c], counts[c], c))
        for i, c in enumerate(order):
            quotas[c] = fl[c] + (1 if i < extra else 0)
    return SplitPlan(strat, n, n_keep, quotas)


def _class_counts(df: DataFrame, label_col: str) -> dict:
    # k rows (one per class) — the only thing collected.
    return {r[0]: int(r[1]) for r in df.groupBy(label_col).count().collect()}


def _quota(plan: SplitPlan, label: Column) -> Column:
    if not plan.stratified:
        return F.lit(plan.n_keep)
    m = F.create_map(*[x for c, q in sorted(plan.quotas.items()) for x in (F.lit(c), F.lit(q))])
    return m[label]


def stratified_split(df: DataFrame, key_cols: list[str], label_col: str = "label",
                     test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                     seed: int = SEED, hex_digits: int | None = None) -> DataFrame:
    """Add ``split`` ∈ {train, val, test}: test = test_size of all rows, then
    val = val_size/(1-test_size) of the rest; each stage stratified when its
    guard allows.  Row order inside a class is md5(seed:key) — deterministic
    and independent of partitioning."""
    # read three times (class counts, bucket counts, ranked rows): stored once
    d = stored(df.withColumn("_h", hash_key(seed, *key_cols)), "hashed")
    order = ["_h", *key_cols]
    lab = F.col(label_col)
    counts1 = _class_counts(d, label_col)
    hex_digits = hex_digits or auto_hex_digits(sum(counts1.values()))
    plan1 = plan_split(counts1, test_size)
    grp1 = [label_col] if plan1.stratified else []
    # offsets table: at most (#classes × 16^digits) rows — a proven bound
    d = bucketed_rank(d, grp1, hex_bucket(F.col("_h"), hex_digits), order, "_r1",
                      n_buckets_bound=16 ** hex_digits, n_groups_bound=len(counts1) if grp1 else None)
    keep1 = F.col("_r1") <= _quota(plan1, lab)
    if plan1.stratified:
        counts2 = dict(plan1.quotas)
    else:
        counts2 = _class_counts(d.filter(keep1), label_col)
    plan2 = plan_split(counts2, val_size / (1.0 - test_size))
    if plan1.stratified and plan2.stratified:
        rank2 = F.col("_r1")  # kept rows are exactly ranks 1..q1 in the same order
    else:
        d = d.withColumn("_k1", keep1)
        grp2 = ["_k1", label_col] if plan2.stratified else ["_k1"]
        d = bucketed_rank(d, grp2, hex_bucket(F.col("_h"), hex_digits), order, "_r2",
                          n_buckets_bound=16 ** hex_digits, n_groups_bound=2 * len(counts1))
        rank2 = F.col("_r2")
    split = (F.when(~keep1, F.lit("test"))
              .when(rank2 <= _quota(plan2, lab), F.lit("train"))
              .otherwise(F.lit("val")))
    return d.withColumn("split", split).drop("_h", "_r1", "_r2", "_k1")


def n_folds_for(counts: dict, max_folds: int = CV_FOLDS) -> int:
    n_min = min(counts.values()) if counts else 0
    return max(2, min(max_folds, n_min)) if n_min >= 2 else 2


def kfold_assign(df: DataFrame, key_cols: list[str], label_id_col: str = "label_id",
                 k: int | None = None, seed: int = SEED, hex_digits: int | None = None) -> DataFrame:
    """Add ``fold`` = (global rank over (label_id, md5 key) − 1) mod k, which
    stratifies: per-class fold counts and fold sizes differ by at most one."""
    d = stored(df.withColumn("_h", hash_key(seed, *key_cols)), "hashed")
    counts = _class_counts(d, label_id_col)  # k rows
    hex_digits = hex_digits or auto_hex_digits(sum(counts.values()))
    if k is None:
        k = n_folds_for(counts)
    bucket = F.col(label_id_col).cast("long") * (16 ** hex_digits) + hex_bucket(F.col("_h"), hex_digits)
    # offsets table: at most (#classes × 16^digits) rows — a proven bound
    d = bucketed_rank(d, [], bucket, [label_id_col, "_h", *key_cols], "_r",
                      n_buckets_bound=(16 ** hex_digits) * max(1, len(counts)))
    return d.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def split_audit(split_df: DataFrame, key_cols: list[str], label_col: str = "label") -> DataFrame:
    """Rows per (split, label) and how many of them share a key with another
    split (must be 0: splits are disjoint)."""
    multi = (split_df.groupBy(*key_cols).agg(F.count_distinct("split").alias("_ns"))
                     .filter(F.col("_ns") > 1).select(*key_cols, F.lit(1).alias("_dup")))
    j = split_df.join(multi, key_cols, "left")
    return (j.groupBy("split", label_col)
             .agg(F.count(F.lit(1)).alias("cnt"), F.coalesce(F.sum("_dup"), F.lit(0)).cast("long").alias("overlap")))
