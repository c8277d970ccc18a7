"""Features and labels look for a word's bytes before its pattern."""
from pyspark.sql import functions as F

from reqlens.functions.text import (FEATURE_WORDS, FEATURES, NOT_WORD_AFTER, NOT_WORD_BEFORE, _lit, class_pattern,
                                    feature_columns, label_expr, whitespace_class)
from reqlens.schema import MODALITY_RULES

ODD = ["", " ", "  a", "a  b", " a b ", "a b", "a\tb\n c", "a b 　c", "\u0085x", "\x1cx y", "ＮＯＴ not", "NOT", "knot",
       "not1", "ſhall do", "ſhould", "mUſt", "reſer", "optıonal", "OPTİONAL", "fıgure Kan", "can", "cannot", "éCAN", "CANé",
       "section 4٣", "١٢ 3", "ABc AB", "AB_ CD-EF", "ÉAB", "A B", "Required; shall not, may", "it shall\nnot", None]


def plain(c):
    """The features as patterns alone."""
    ws = whitespace_class()
    n = F.regexp_count(c, F.lit("[^" + ws[1:-1] + "]+")).cast("int")
    flags = {k: c.rlike("(?iu)" + NOT_WORD_BEFORE + "(?:" + "|".join(map(_lit, w)) + ")" + NOT_WORD_AFTER).cast("int")
             for k, w in FEATURE_WORDS.items()}
    return {"char_len": F.length(c), "word_count": n,
            "avg_word_len": F.length(F.regexp_replace(c, ws + "+", "")) / F.greatest(n, F.lit(1)),
            "num_digits": F.regexp_count(c, F.lit(r"\p{Nd}")),
            "num_acronyms": F.regexp_count(c, F.lit(NOT_WORD_BEFORE + "[A-Z]{2,}" + NOT_WORD_AFTER))} | flags


def test_features_and_labels_equal_their_patterns(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    c = F.col("t")
    want, got = plain(c), feature_columns(c)
    rule = None
    for name, phrases in MODALITY_RULES:
        hit = F.lower(c).rlike(class_pattern(phrases))
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    label = rule.otherwise("INFORMATIVE")
    r = df.select(c, *[want[f].alias("w_" + f) for f in FEATURES], *[got[f].alias("g_" + f) for f in FEATURES],
                  label.alias("w_label"), label_expr(c).alias("g_label")).collect()
    for x in r:
        for f in (*FEATURES, "label"):
            assert x["g_" + f] == x["w_" + f], (x["t"], f)


def test_word_patterns_run_behind_a_search_for_their_bytes(spark):
    df = spark.createDataFrame([("a",)], "t string").select(*[c.alias(n) for n, c in feature_columns(F.col("t")).items()])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "THEN 0 ELSE" in plan
