"""Edge rows for evaluation and properties of splits, folds, curves."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reqlens.operators import dataset as D
from reqlens.operators import evaluate as E
from reqlens.operators import extract as X
from reqlens.operators import profile as P
from reqlens.operators import tfidf as T
from reqlens.plans import catalog as C


def _pred(spark, pairs):
    return spark.createDataFrame(pairs, "y string, p string")


def test_macro_f1_present_vs_all(spark):
    # class c only predicted, class d absent from both
    pred = _pred(spark, [("a", "a"), ("a", "c"), ("b", "b"), ("b", "b")])
    s = {r["metric"]: r["value"] for r in E.summary(E.confusion(pred, ["a", "b", "c", "d"])).collect()}
    f1a, f1b = 2 * 1.0 * 0.5 / 1.5, 1.0
    assert s["macro_f1_present"] == round((f1a + f1b + 0.0) / 3, 6)
    assert s["macro_f1_all"] == round((f1a + f1b) / 4, 6)
    assert s["macro_f1_present"] >= s["macro_f1_all"]
    assert s["accuracy"] == 0.75


def test_confusion_dense(spark):
    conf = E.confusion(_pred(spark, [("a", "b")]), ["a", "b", "c"])
    assert conf.count() == 9 and conf.agg(F.sum("cnt")).first()[0] == 1


def _scores(spark, rows):
    return spark.createDataFrame(rows, "key long, y string, class string, score double")


def test_auc_ties_and_reversal(spark):
    tied = _scores(spark, [(i, "a" if i % 2 else "b", "a", 0.5) for i in range(10)])
    assert E.auc_ovr(tied).first()["auc"] == 0.5
    rows = [(i, "a" if i % 3 == 0 else "b", "a", (i * 37 % 101) / 101.0) for i in range(60)]
    a = E.auc_ovr(_scores(spark, rows)).first()["auc"]
    rev = E.auc_ovr(_scores(spark, [(k, y, c, 1.0 - s) for k, y, c, s in rows])).first()["auc"]
    assert abs(a + rev - 1.0) < 2e-6


def test_roc_endpoints(spark):
    rows = [(i, "a" if i < 4 else "b", "a", i / 10.0) for i in range(10)]
    roc = E.roc_curve(_scores(spark, rows)).orderBy(F.col("threshold").desc()).collect()
    assert roc[-1]["fpr"] == 1.0 and roc[-1]["tpr"] == 1.0 and len(roc) == 10
    pr = E.pr_curve(_scores(spark, rows)).filter(F.col("threshold").isNull()).first()
    assert (pr["precision"], pr["recall"]) == (1.0, 0.0)


def test_constant_feature_corr_and_zscore(spark):
    df = spark.createDataFrame([("x" * (5 + i), "MANDATORY" if i % 2 else "OPTIONAL", i % 2) for i in range(8)],
                               "text string, label string, label_id int")
    feats = P.with_features(df)
    corr = {(r["a"], r["b"]): r["r"] for r in P.feature_corr(feats).collect()}
    assert corr[("has_ref", "label_id")] is None
    z = {(r["label"], r["feature"]): r["z"] for r in P.feature_zscore_by_class(feats).collect()}
    assert z[("MANDATORY", "has_ref")] == 0.0 and z[("INFORMATIVE", "has_ref")] is None


def test_empty_text_zero_vector(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "a . ;")], "doc_id long, text string")
    m, w = T.fit_transform(docs, ["doc_id"], "text", T.TfidfParams())
    assert {r["doc_id"] for r in w.collect()} == {1}
    norms = w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).first()["n"]
    assert abs(norms - 1.0) < 1e-12


def test_section_carry_resets_per_document(spark):
    blocks = spark.createDataFrame([
        ("d1", 0, "text", "Intro text"), ("d1", 1, "section_header", "One"), ("d1", 2, "text", "Body"),
        ("d2", 0, "text", "Other doc"), ("d2", 1, "list_item", "Item"),
    ], "source string, block_idx long, block_type string, text string")
    got = {(r["source"], r["block_idx"]): r["section"] for r in X.section_carry(blocks, ["source"]).collect()}
    assert got == {("d1", 0): "(preamble)", ("d1", 2): "One", ("d2", 0): "(preamble)", ("d2", 1): "(preamble)"}


def test_carry_forward_across_chunks(spark):
    rows = [("d", i, "section_header" if i in (3, 9000) else "text", f"t{i}") for i in range(0, 12000, 3)]
    blocks = spark.createDataFrame(rows, "source string, block_idx long, block_type string, text string")
    got = {r["block_idx"]: r["section"] for r in X.section_carry(blocks, ["source"]).collect()}
    assert got[0] == "(preamble)" and got[6] == "t3" and got[8997] == "t3" and got[9003] == "t9000"
    assert got[11997] == "t9000"


def test_html_list_items(spark):
    pages = spark.createDataFrame([(1, "<html><body><h2>Title &amp; more</h2><ul><li>first &lt;x&gt;</li>"
                                       "<li>second</li></ul><p>para<b>bold</p><script>x</script></body></html>")],
                                  "page_id long, html string")
    got = [(r["block_type"], r["text"]) for r in X.html_blocks(pages, ["page_id"]).orderBy("block_idx").collect()]
    assert got == [("section_header", "Title & more"), ("list_item", "first <x>"), ("list_item", "second"),
                   ("text", "parabold")]


@pytest.fixture(scope="module")
def cued(spark):
    return C.cued(spark, SF_SMALL).persist()


def test_splits_disjoint_complete(cued):
    sp = D.stratified_split(cued, ["doc_id", "sent_idx"])
    assert sp.count() == cued.count()
    assert sp.select("doc_id", "sent_idx").distinct().count() == cued.count()
    n = cued.count()
    assert sp.filter("split = 'test'").count() == -(-n * 2 // 10)


def test_folds_balanced(cued):
    f = D.kfold_assign(cued, ["doc_id", "sent_idx"], k=5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    per = f.groupBy("label_id", "fold").count().groupBy("label_id").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in per)


def test_same_result_under_shuffle_partitions(spark, cued):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(tuple(r) for r in D.stratified_split(cued, ["doc_id", "sent_idx"])
                      .select("doc_id", "sent_idx", "split").collect())
    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cv_scores_and_selection_plumbing(spark):
    import os
    from conftest import REF
    from reqlens.operators import select as S
    from reqlens.sources.tables import read_splits_csv
    if not os.path.isdir(REF):
        pytest.skip("reference data absent")
    d = read_splits_csv(spark, f"{REF}/data/dataset")
    cv = S.cv_scores(d.filter("split = 'train'"), ["rid"], candidates=("nb",))
    rows = cv.collect()
    assert len(rows) == 2 and all(0.0 <= r["macro_f1"] <= 1.0 for r in rows)
    summ = S.cv_summary(cv)
    assert S.best_candidate(summ) == "nb"
    assert len(list(S.grid_points())) == 24
