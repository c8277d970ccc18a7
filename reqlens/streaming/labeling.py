"""Structured Streaming: the sentence, label, mask and feature expressions are
stateless column expressions, so the batch plan runs unchanged on a stream.

``labeled_sentence_stream`` reads new parquet files of documents as they
arrive and emits labeled (and optionally masked) sentence records; sinks are
the caller's choice (``foreachBatch`` into a table for exactly-once output).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_expr
from ..operators.dataset import with_labels
from ..operators.extract import sentences
from ..schema import DEFAULT_LEXICON, TABLE_SCHEMAS, Lexicon


def document_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TABLE_SCHEMAS["documents"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def labeled_sentence_stream(docs: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
                            mask: bool = False) -> DataFrame:
    s = with_labels(sentences(docs, ["doc_id"]), lexicon=lexicon)
    if mask:
        s = s.withColumn("masked", mask_expr(F.col("text"), lexicon))
    return s


def run_available_now(stream: DataFrame, checkpoint: str, table_path: str):
    """Process everything available once (``Trigger.AvailableNow``) into a
    parquet table; the checkpoint makes restarts resume exactly once."""
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .option("path", table_path).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
