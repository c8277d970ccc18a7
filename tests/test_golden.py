"""Golden tests against the reference's checked-in data (read in place)."""
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import REF
from reqlens.operators import dataset as D
from reqlens.operators import extract as X
from reqlens.operators import profile as P
from reqlens.sources.tables import read_labeled_csv, read_splits_csv

pytestmark = pytest.mark.skipif(not os.path.isdir(REF), reason="reference data absent")
DS = f"{REF}/data/dataset"


@pytest.fixture(scope="module")
def labeled(spark):
    return read_labeled_csv(spark, f"{DS}/labeled.csv").persist()


def test_weak_labels_reproduce_all_rows(labeled):
    got = D.with_labels(labeled.withColumnRenamed("label", "gold").withColumnRenamed("label_id", "gold_id"))
    bad = got.filter((F.col("label") != F.col("gold")) | (F.col("label_id") != F.col("gold_id")))
    assert labeled.count() == 125 and bad.count() == 0


def test_class_distribution(labeled):
    with open(f"{DS}/label_stats.json") as fh:
        stats = json.load(fh)
    got = {r["label"]: r["cnt"] for r in P.class_distribution(labeled).collect()}
    assert got == {k: stats.get(k, 0) for k in got}
    maj = P.majority_baseline(labeled).first()
    assert maj["accuracy"] == round(87 / 125, 6)


def test_split_allocation_matches_published_counts():
    counts = {"INFORMATIVE": 87, "MANDATORY": 17, "OPTIONAL": 13, "PROHIBITED": 6, "RECOMMENDED": 2}
    p1 = D.plan_split(counts, 0.2)
    assert p1.stratified and p1.n_keep == 100
    test = {c: counts[c] - p1.quotas[c] for c in counts}
    p2 = D.plan_split(p1.quotas, 0.1 / 0.8)
    val = {c: p1.quotas[c] - p2.quotas[c] for c in counts}
    order = ["INFORMATIVE", "MANDATORY", "OPTIONAL", "PROHIBITED", "RECOMMENDED"]
    assert [p2.quotas[c] for c in order] == [60, 12, 9, 4, 2]
    assert [val[c] for c in order] == [9, 2, 1, 1, 0]
    assert [test[c] for c in order] == [18, 3, 3, 1, 0]


def test_split_of_labeled_rows(spark, labeled):
    sp = D.stratified_split(labeled, ["rid"], "label")
    got = {(r["split"], r["label"]): r["count"] for r in sp.groupBy("split", "label").count().collect()}
    assert got[("train", "INFORMATIVE")] == 60 and got[("test", "MANDATORY")] == 3
    assert sum(v for (s, _), v in got.items() if s == "val") == 13
    assert sp.select("rid").distinct().count() == 125


def test_given_splits_are_disjoint_and_complete(spark):
    d = read_splits_csv(spark, DS)
    audit = D.split_audit(d, ["rid"]).collect()
    assert sum(r["cnt"] for r in audit) == 125 and all(r["overlap"] == 0 for r in audit)


def test_markdown_to_records_matches_labeled(spark, labeled):
    paths = glob.glob(f"{REF}/data/parsed/*.md")
    md = spark.read.text(paths, wholetext=True).select(
        F.lit(os.path.basename(paths[0])).alias("source"), F.col("value").alias("markdown"))
    body = X.section_carry(X.md_blocks(md, ["source"]), ["source"])
    rec = X.records(body, ["source"], F.col("source"))
    rec = rec.withColumn("ord", D.pack_ord(("block_idx", 0), ("sent_idx", 20)))
    assert rec.count() == 146
    first = D.dedup_first(rec).orderBy("ord").select("text", "section").collect()
    want = labeled.select("text", "section").collect()
    assert [(r["text"], r["section"]) for r in first] == [(r["text"], r["section"]) for r in want]


@pytest.mark.parametrize("mask,expect", [(False, (0.88, 0.8595, 0.8811)), (True, (0.80, 0.7329, 0.7907))])
def test_baseline_logreg_metrics(spark, mask, expect):
    from reqlens.functions.text import mask_expr
    from reqlens.operators import select as S
    from reqlens.operators import tfidf as T
    d = read_splits_csv(spark, DS)
    if mask:
        d = d.withColumn("text", mask_expr(F.col("text")))
    r = S.fit_predict(d.filter(F.col("split") != "test"), d.filter(F.col("split") == "test"), ["rid"],
                      model="logreg", params=T.BASELINE)
    m = S.metrics(r.pred)
    assert r.vocab_size == (1260 if mask else 1272)
    got = (m["accuracy"], round(m["macro_f1_present"], 4), round(m["weighted_f1"], 4))
    assert got == expect


@pytest.mark.parametrize("point,expect", [
    ({"C": 1.0, "min_df": 1, "ngram": (1, 1), "sublinear": False}, (0.84, 0.6746, 0.8485)),
    ({"C": 1.0, "min_df": 2, "ngram": (1, 2), "sublinear": True}, (0.92, 0.9139, 0.9234))])
def test_tuning_points_of_the_linear_solver(spark, point, expect):
    from reqlens.operators import linear as L
    from reqlens.operators import select as S
    d = read_splits_csv(spark, DS)
    m = L.fit_linear(d.filter(F.col("split") != "test"), ["rid"], S.point_spec(0, point))
    got = S.metrics(m.predict(d.filter(F.col("split") == "test"), ["rid"]))
    assert (got["accuracy"], round(got["macro_f1_present"], 4), round(got["weighted_f1"], 4)) == expect


def test_top_terms_of_the_linear_solver(spark):
    from reqlens.operators import linear as L
    from reqlens.operators import tfidf as T
    from reqlens.schema import LABELS
    d = read_splits_csv(spark, DS).filter(F.col("split") != "test")
    m = L.fit_linear(d, ["rid"], L.Spec(params=T.IMPORTANCE))
    top = {r["class"]: (r["term"], r["weight"]) for r in m.term_weights(1, names=list(LABELS)).collect()}
    assert top["MANDATORY"] == ("shall", pytest.approx(1.04195, abs=1e-3))
    assert top["PROHIBITED"] == ("may", pytest.approx(1.06018, abs=1e-3))
