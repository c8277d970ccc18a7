"""Softmax computes its scores once per row."""
import math

import pytest
from pyspark.sql import functions as F

from reqlens.operators.models import softmax


def test_softmax_refers_to_its_scores_once(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([-1e3, 1e3, 1e3],), ([],), (None,), ([1.0, None],)], "marker array<double>")
    out = df.select(softmax(F.col("marker")).alias("p"))
    assert out._jdf.queryExecution().analyzed().expressions().mkString().count("marker") == 1
    got = [r["p"] for r in out.collect()]
    e = [math.exp(x - 3) for x in (1, 3, 2)]
    assert got[0] == pytest.approx([x / sum(e) for x in e], abs=1e-15)
    assert got[1:4] == [[0.0, 0.5, 0.5], [], None] and got[4] == [None, None]
