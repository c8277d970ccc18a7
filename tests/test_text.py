"""Hand-made edge rows (FIXTURES §3) for the text expressions."""
import pytest
from pyspark.sql import functions as F

from reqlens.functions.text import (feature_columns, label_expr, mask_expr, ngrams_expr, split_sentences,
                                    tokens_expr)
from reqlens.operators.extract import sentences


def _one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,label", [
    ("Refer to mandatory, optional, and prohibited commands", "OPTIONAL"),
    ("It should be set but must not change", "PROHIBITED"),
    ("maybe", "INFORMATIVE"), ("Marshall", "INFORMATIVE"), ("optionally", "INFORMATIVE"),
    ("may_1", "OPTIONAL"), ("may-be", "OPTIONAL"), ("émay", "OPTIONAL"),
    ("It can do this", "INFORMATIVE"), ("can optionally", "OPTIONAL"),
    ("The host SHALL NOT reset", "PROHIBITED"), ("It is required to wait", "MANDATORY"),
    ("This is recommended", "RECOMMENDED"), ("", "INFORMATIVE"),
])
def test_weak_label(spark, text, label):
    assert _one(spark, label_expr, text) == label


@pytest.mark.parametrize("text,masked", [
    ("may may MAY", "[MODAL] [MODAL] [MODAL]"),
    ("is required to", "[MODAL]"),
    ("The host shall not reset", "The host [MODAL] reset"),
    ("maybe Marshall", "maybe Marshall"),
    ("It can optionally do", "It [MODAL] do"),
])
def test_mask(spark, text, masked):
    assert _one(spark, mask_expr, text) == masked


def test_mask_idempotent_and_informative(spark):
    texts = ["The host shall not do it and it may not either", "It should, must, may."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(mask_expr(F.col("t")).alias("m"))
    twice = once.select(mask_expr(F.col("m")).alias("m"), label_expr(F.col("m")).alias("l"))
    assert [r["m"] for r in once.collect()] == [r["m"] for r in twice.collect()]
    assert {r["l"] for r in twice.collect()} == {"INFORMATIVE"}


def test_mask_custom_token(spark):
    assert _one(spark, lambda c: mask_expr(c, token=""), "it may go") == "it  go"


@pytest.mark.parametrize("text,parts", [
    ("See Fig. 5; or this", ["See Fig.", "5; or this"]),
    ("A: B. Éa. 1x", ["A:", "B. Éa.", "1x"]),
    ("  One.   Two;\tThree  ", ["One.", "Two;", "Three"]),
    ("", [""]),
])
def test_split_sentences(spark, text, parts):
    assert _one(spark, split_sentences, text) == parts


def test_protect_abbrev(spark):
    out = _one(spark, lambda c: split_sentences(c, protect_abbrev=True), "See Fig. 5 here. Next one")
    assert out == ["See Fig. 5 here.", "Next one"]
    # an abbreviation is a word of its own
    out = _one(spark, lambda c: split_sentences(c, protect_abbrev=True), "Check the revs. Next vs. Previous")
    assert out == ["Check the revs.", "Next vs. Previous"]


def test_fragment_filter(spark):
    docs = spark.createDataFrame([(1, "Fourteen char. " + "1" * 20 + ". This sentence is long enough.")],
                                 "doc_id long, text string")
    got = [(r["sent_idx"], r["text"]) for r in sentences(docs, ["doc_id"]).collect()]
    assert got == [(2, "This sentence is long enough.")]


def test_features(spark):
    df = spark.createDataFrame([("The DMA host  shall not refer to Section 5 of RAID 10.",)], "t string")
    r = df.select(*[c.alias(n) for n, c in feature_columns(F.col("t")).items()]).first()
    assert r["word_count"] == 12 and r["num_digits"] == 3 and r["num_acronyms"] == 2
    assert r["has_negation"] == 1 and r["has_ref"] == 1 and r["has_shall_must"] == 1
    assert r["has_should"] == 0 and r["has_may"] == 0
    assert abs(r["avg_word_len"] - 42 / 12) < 1e-12


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Été a ﬁne Straße x-ray",)], "t string")
    r = df.select(tokens_expr(F.col("t")).alias("k")).select(
        "k", ngrams_expr(F.col("k"), (1, 2)).alias("g")).first()
    assert r["k"] == ["ete", "fine", "straße", "ray"]
    assert r["g"] == ["ete", "fine", "straße", "ray", "ete fine", "fine straße", "straße ray"]
    empty = spark.createDataFrame([("a . ;",)], "t string").select(tokens_expr(F.col("t")).alias("k"))
    k = empty.select("k", ngrams_expr(F.col("k"), (1, 2)).alias("g")).first()
    assert k["k"] == [] and k["g"] == []
