"""Readers and writers (S1–S9) with explicit schemas — no inference."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABELED_SCHEMA, METRICS_SCHEMA, RECORD_SCHEMA, TABLE_SCHEMAS


#: Nulls are written as \\N, so that an empty text stays one.
CSV_OPTIONS = {"header": "true", "escape": '"', "nullValue": "\\N", "lineSep": "\n"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = TABLE_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return spread(reader.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores (one large row
    group, one small file) would run all per-row text work in a few tasks;
    round-robin it once to the default parallelism.  Scans of big data have
    thousands of splits and are left alone."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def read_labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labeled split CSV (header, quoted commas, multi-line cells) with a
    stable row key ``rid`` = md5(text) (texts are unique after dedup)."""
    df = (spark.read.schema(LABELED_SCHEMA).option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    return df.withColumn("rid", F.md5("text"))


def read_splits_csv(spark: SparkSession, folder: str) -> DataFrame:
    """train/val/test CSVs of one folder as one DataFrame with ``split``."""
    parts = [read_labeled_csv(spark, f"{folder}/{s}.csv").withColumn("split", F.lit(s))
             for s in ("train", "val", "test")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """Sentence records written as a JSON array (one file) or JSON lines."""
    return spark.read.schema(RECORD_SCHEMA).option("multiLine", True).json(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One dataset, physically partitioned by split (partition pruning on read).
    CSV has a header, and quotes in texts are doubled, as ``read_splits`` expects."""
    w = df.write.mode("overwrite").partitionBy("split").format(fmt)
    (w.options(**CSV_OPTIONS, emptyValue='""') if fmt == "csv" else w).save(path)


def read_splits(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """What ``write_splits`` wrote; ``schema`` without ``split``, in the written order."""
    r = spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).format(fmt)
    return (r.options(**CSV_OPTIONS, emptyValue="", multiLine="true") if fmt == "csv" else r).load(path)


def write_records(df: DataFrame, path: str) -> None:
    """The pooled records, grouped by source within files of the size that the
    plan's partitions give, so a source is found by file statistics and many
    small sources share a file."""
    df.repartitionByRange("source").sortWithinPartitions("source").write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def metrics_frame(spark: SparkSession, model: str, summary: dict, per_class: list | None = None) -> DataFrame:
    """Tidy (model, class, metric, value) rows from a summary dict and
    optional per-class rows (class, metric, value)."""
    rows = [(model, None, k, float(v) if v is not None else None) for k, v in summary.items()]
    rows += [(model, c, m, float(v)) for c, m, v in (per_class or [])]
    return spark.createDataFrame(rows, METRICS_SCHEMA)


__all__ = ["read_table", "read_labeled_csv", "read_splits_csv", "read_records_json", "read_splits", "write_splits",
           "write_records", "write_metrics", "read_metrics", "metrics_frame", "T"]
