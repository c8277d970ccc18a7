"""N-grams are dealt out by their last tokens; accents are looked for behind one range."""
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from reqlens.functions.text import MAYBE_COMBINING, combining, combining_class, ngrams_expr, tokens_expr
from reqlens.operators.tfidf import TfidfParams, terms

TEXTS = ["one two three four", "one two", "one", "a . ;", "", None, "Été a ﬁne Straße x-ray", "one two three four"]


@pytest.mark.parametrize("ngram_range", [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)])
def test_terms_equal_the_arrays_of_ngrams(spark, ngram_range):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no key")], "k long, t string")
    want = df.select("k", tokens_expr(F.col("t")).alias("g")).select(
        "k", F.posexplode(ngrams_expr(F.col("g"), ngram_range)).alias("pos", "term"))
    got = terms(df, ["k"], "t", TfidfParams(ngram_range=ngram_range))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_terms_use_no_lambda(spark):
    df = spark.createDataFrame([(1, "one two")], "k long, t string")
    plan = terms(df, ["k"], "t", TfidfParams(ngram_range=(1, 2)))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "lambda" not in plan


def test_the_same_characters_are_dropped(spark):
    assert combining().startswith("[\\x{300}-\\x{10FFFF}](?<=")
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    others = [chr(c) for c in range(1, sys.maxunicode + 1, 7) if not 0xD800 <= c < 0xE000]
    texts = [(x + "a" + x + x + "b" + x + "́",) for x in marks + others] + [("",), (None,), ("plain",)]
    c = F.col("t")
    r = spark.createDataFrame(texts, "t string").repartition(8).select(
        F.regexp_replace(c, combining(), "").alias("got"),
        F.regexp_replace(c, MAYBE_COMBINING + combining_class(), "").alias("want"))
    assert r.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
