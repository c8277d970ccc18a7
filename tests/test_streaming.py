"""The stateless labeling plan runs unchanged on a stream."""
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from reqlens.operators.dataset import with_labels
from reqlens.operators.extract import sentences
from reqlens.streaming.labeling import document_stream, labeled_sentence_stream, run_available_now


def test_available_now_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="reqlens-stream-")
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    src.repartition(3).write.mode("overwrite").parquet(f"{d}/in")
    stream = labeled_sentence_stream(document_stream(spark, f"{d}/in", max_files_per_trigger=1), mask=True)
    run_available_now(stream, f"{d}/ckpt", f"{d}/out")
    got = spark.read.parquet(f"{d}/out")
    batch = with_labels(sentences(src, ["doc_id"]))
    assert got.count() == batch.count()
    assert got.select("doc_id", "sent_idx", "label").exceptAll(batch.select("doc_id", "sent_idx", "label")).count() == 0
    # the stock documents carry no modal cue, so masking leaves every sentence unchanged
    assert got.filter(F.col("masked") != F.col("text")).count() == 0
