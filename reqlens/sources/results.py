"""Results store (S7, S8): one append-only tidy table of metrics, and the
result tables read back from it (Rp2, Rp4, Rp5).

Rows are (kind, model, class, metric, value) under a run: ``kind`` separates
evaluations, tuning and importance.  The table is partitioned by run; writing a
run again replaces that run only (dynamic partition overwrite), others stay.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("class", T.StringType(), True),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
])
COMPARED = {"accuracy": "accuracy", "macro_f1": "macro_f1_present", "weighted_f1": "weighted_f1"}


def _tidy(df: DataFrame, kind: str, model: str, cls, metric, value) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(model).alias("model"), cls.cast("string").alias("class"),
                     metric.cast("string").alias("metric"), value.cast("double").alias("value"))


def evaluation_rows(summary: DataFrame, per_class: DataFrame | None, model: str) -> DataFrame:
    """From ``evaluate.summary`` and ``evaluate.report`` of one model."""
    out = _tidy(summary, "evaluation", model, F.lit(None), F.col("metric"), F.col("value"))
    if per_class is not None:
        values = F.explode(F.map_from_arrays(
            F.array(*[F.lit(m) for m in ("precision", "recall", "f1", "support")]),
            F.array(*[F.col(m).cast("double") for m in ("precision", "recall", "f1", "support")])))
        long = per_class.select("class", values.alias("metric", "value"))
        out = out.unionByName(_tidy(long, "evaluation", model, F.col("class"), F.col("metric"), F.col("value")))
    return out


def tuning_rows(gain: DataFrame, model: str) -> DataFrame:
    """From ``select.tuning_gain``: a row per metric and stage."""
    stages = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in ("before", "after", "gain")]),
                                         F.array("before", "after", "gain")))
    return _tidy(gain.select("metric", stages.alias("stage", "value")), "tuning", model,
                 F.col("stage"), F.col("metric"), F.col("value"))


def importance_rows(weights: DataFrame, model: str) -> DataFrame:
    """From ``select.term_weights``: the term is the metric."""
    return _tidy(weights, "importance", model, F.col("class"), F.col("term"), F.col("weight"))


def write_results(rows: DataFrame, path: str, run: str) -> None:
    """Add the rows of a run, or replace them if the run was written before."""
    (rows.select(*RESULT_SCHEMA.names).withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def read_results(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField("run", T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    return df if run is None else df.filter(F.col("run") == run)


def comparison(results: DataFrame) -> DataFrame:
    """(run, model, accuracy, macro_f1, weighted_f1): one row per evaluation."""
    r = results.filter((F.col("kind") == "evaluation") & F.col("class").isNull())
    wide = r.groupBy("run", "model").pivot("metric", list(COMPARED.values())).agg(F.max("value"))
    return wide.select("run", "model", *[F.col(c).alias(name) for name, c in COMPARED.items()])


def per_class_table(results: DataFrame) -> DataFrame:
    """(run, model, class, precision, recall, f1, support)."""
    r = results.filter((F.col("kind") == "evaluation") & F.col("class").isNotNull())
    wide = r.groupBy("run", "model", "class").pivot("metric", ["precision", "recall", "f1", "support"]).agg(F.max("value"))
    return wide.withColumn("support", F.col("support").cast("long"))


def tuning_table(results: DataFrame) -> DataFrame:
    """(run, model, metric, before, after, gain)."""
    r = results.filter(F.col("kind") == "tuning")
    return r.groupBy("run", "model", "metric").pivot("class", ["before", "after", "gain"]).agg(F.max("value"))


def importance_table(results: DataFrame) -> DataFrame:
    """(run, model, class, rank, term, weight), the greatest weight first."""
    from pyspark.sql import Window
    w = Window.partitionBy("run", "model", "class").orderBy(F.col("value").desc(), "metric")  # n terms a class
    return results.filter(F.col("kind") == "importance").select(
        "run", "model", "class", F.row_number().over(w).alias("rank"), F.col("metric").alias("term"),
        F.col("value").alias("weight"))
