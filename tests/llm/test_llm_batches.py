"""Texts go to Python in batches of bounded bytes."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqlens.llm import blocks, compression, neardup, packing, secrets
from reqlens.llm.wordbpe import word_tokenizer

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
RATIO = np.zeros((secrets.SIZE, secrets.SIZE))
OPERATORS = {"measured": compression.measured, "keep_quality": compression.keep_quality,
             "sketches": neardup._sketches, "store_blocks": lambda docs: blocks.store_blocks(docs.limit(1)),
             "train": lambda docs: secrets.train(docs.limit(1)), "scan": lambda docs: secrets.scan(docs, RATIO),
             "mask": lambda docs: secrets.mask(docs, RATIO),
             "encode": lambda docs: packing.encode(docs.limit(1), word_tokenizer())}


@pytest.fixture
def docs(spark):
    before = spark.conf.get(SETTING, None)
    spark.conf.unset(SETTING)
    yield spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(md5(string(id)), 128)").alias("text"))
    spark.conf.unset(SETTING)
    if before is not None:
        spark.conf.set(SETTING, before)


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_reach_python_in_batches_of_bounded_bytes(docs, name):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    OPERATORS[name](docs)
    got = docs.mapInArrow(sizes, "rows long, size long").collect()  # 16 MB in one partition
    assert sum(r["rows"] for r in got) == 4000
    assert max(r["size"] for r in got) <= 5 << 20


def test_a_size_of_the_session_stays(spark, docs):
    spark.conf.set(SETTING, "1m")
    secrets.mask(docs, RATIO)
    assert spark.conf.get(SETTING) == "1m"
