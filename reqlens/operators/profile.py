"""Class profiles and engineered-feature statistics.

Every statistic is one aggregate pass over the sentence table (partial
aggregation collapses each task's rows before the shuffle, so a class holding
most rows costs nothing extra); the per-class results have at most k rows and
are finished on those small tables.
"""
from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FEATURES, feature_columns
from ..schema import LabelSchema
from ..session import stored


def label_table(spark: SparkSession, schema: LabelSchema | None = None) -> DataFrame:
    """The k-row (label_id, label) table — a literal, so broadcast is safe."""
    schema = schema or LabelSchema()
    return F.broadcast(spark.createDataFrame(
        [(i, lab) for i, lab in enumerate(schema.labels)], "label_id int, label string"))


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in feature_columns(F.col(text_col)).items()])


def class_distribution(df: DataFrame, schema: LabelSchema | None = None) -> DataFrame:
    """Dense (label_id, label, cnt, share); absent classes count 0."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    dense = (label_table(df.sparkSession, schema).join(counts, "label", "left")
             .withColumn("cnt", F.coalesce(F.col("cnt"), F.lit(0)).cast("long")))
    total = F.sum("cnt").over(Window.partitionBy())  # k rows
    return dense.select("label_id", "label", "cnt",
                        F.round(F.try_divide(F.col("cnt"), total), 6).alias("share"))


def majority_baseline(df: DataFrame) -> DataFrame:
    """Accuracy of always predicting the most frequent class."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.agg(F.max("cnt").cast("long").alias("majority_cnt"),
                      F.sum("cnt").cast("long").alias("n"),
                      F.round(F.max("cnt") / F.sum("cnt"), 6).alias("accuracy"))


def class_weights(df: DataFrame, schema: LabelSchema | None = None) -> DataFrame:
    """Balanced weights n/(k·n_c) over the k *present* classes; absent → 1."""
    dense = class_distribution(df, schema)
    w = Window.partitionBy()
    n = F.sum("cnt").over(w)
    k = F.sum((F.col("cnt") > 0).cast("long")).over(w)
    weight = F.when(F.col("cnt") > 0, n / (k * F.col("cnt"))).otherwise(F.lit(1.0))
    return dense.select("label_id", "label", "cnt", F.round(weight, 6).alias("weight"))


def _long_means(df: DataFrame, schema: LabelSchema | None) -> DataFrame:
    means = df.groupBy("label").agg(*[F.avg(f).alias(f) for f in FEATURES])
    dense = label_table(df.sparkSession, schema).join(means, "label", "left")
    stack = "stack({}, {}) as (feature, mean)".format(
        len(FEATURES), ", ".join(f"'{f}', cast({f} as double)" for f in FEATURES))
    return dense.selectExpr("label_id", "label", stack)


def feature_means_by_class(feats: DataFrame, schema: LabelSchema | None = None) -> DataFrame:
    """(label_id, label, feature, mean) for all k classes; absent → null."""
    return _long_means(feats, schema).withColumn("mean", F.round("mean", 6))


def feature_zscore_by_class(feats: DataFrame, schema: LabelSchema | None = None) -> DataFrame:
    """z-score of each class mean across classes: population sd, sd 0 → 1;
    absent classes are ignored."""
    m = _long_means(feats, schema)  # ≤ k·10 rows
    w = Window.partitionBy("feature")
    mu = F.avg("mean").over(w)
    sd = F.stddev_pop("mean").over(w)
    z = (F.col("mean") - mu) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return m.select("label_id", "label", "feature", F.round("mean", 6).alias("mean"),
                    F.round(z, 6).alias("z"))


CORR_COLUMNS = FEATURES + ("label_id",)


def feature_corr(feats: DataFrame) -> DataFrame:
    """Pearson r of every pair of the 10 features and label_id in one pass;
    a constant column gives null instead of a division error."""
    pairs = list(itertools.combinations(CORR_COLUMNS, 2))
    aggs = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov__{a}__{b}")
            for a, b in pairs]
    aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"sd__{c}") for c in CORR_COLUMNS]
    one = feats.agg(*aggs)
    stack = "stack({}, {}) as (a, b, r)".format(len(pairs), ", ".join(
        f"'{a}', '{b}', try_divide(`cov__{a}__{b}`, `sd__{a}` * `sd__{b}`)" for a, b in pairs))
    return one.selectExpr(stack).withColumn("r", F.round("r", 6))


def label_corr_rank(feats: DataFrame) -> DataFrame:
    """|r| of each feature with label_id, 3 dp, strongest first."""
    c = feature_corr(feats).filter(F.col("b") == "label_id")
    return (c.select(F.col("a").alias("feature"), F.round(F.abs("r"), 3).alias("abs_r"))
             .orderBy(F.col("abs_r").desc_nulls_last(), "feature"))


def length_box_by_class(feats: DataFrame, col: str = "word_count") -> DataFrame:
    """Box-plot data per class: quartiles (linear), 1.5·IQR whiskers (most
    extreme values inside the fences) and the outlier count.  Rows are counted
    by class and value in one pass over the texts; both steps read the counts."""
    hist = stored(feats.groupBy("label", col).agg(F.count(F.lit(1)).alias("_n")), "lengths")
    q = (hist.groupBy("label")
             .agg(F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n")).alias("_q"))
             .select("label", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                     F.col("_q")[2].alias("q3")))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    v = F.col(col)
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    # q has one row per class: broadcast is bounded by the label schema.
    stats = (hist.join(F.broadcast(q), "label")
             .groupBy("label", "q1", "median", "q3")
             .agg(F.min(F.when(inside, v)).alias("whisker_lo"),
                  F.max(F.when(inside, v)).alias("whisker_hi"),
                  F.sum((~inside).cast("long") * F.col("_n")).alias("n_outliers"),
                  F.sum("_n").alias("n")))
    return stats.select("label", *[F.round(F.col(c).cast("double"), 6).alias(c)
                                   for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                        "n_outliers", "n")
