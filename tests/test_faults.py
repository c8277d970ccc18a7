"""Class ids beyond the schema, equal weights, ordering keys that don't fit, file names with spaces, pooled files."""
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.errors import PySparkException

from reqlens.operators import dataset as D
from reqlens.operators import select as S
from reqlens.operators.rank import ordered_number
from reqlens.plans import pipeline


def test_metrics_count_classes_beyond_the_schema(spark):
    pred = spark.createDataFrame([(7, 7), (0, 0), (0, 7)], "y int, p int")
    assert S.metrics(pred)["accuracy"] == pytest.approx(2 / 3, abs=1e-6)


def test_confusion_refuses_classes_beyond_the_given_ones(spark):
    from reqlens.operators import evaluate as E
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("a", None)], "y string, p string")
    assert {(r["y"], r["p"]): r["cnt"] for r in E.confusion(pred, ["a", "b"]).collect()} == {
        ("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}
    with pytest.raises(PySparkException):
        E.confusion(pred, ["a"]).collect()


@pytest.mark.parametrize("smallest_abs", [False, True])
def test_term_weights_keep_all_ties(spark, smallest_abs):
    terms = [f"t{i:02d}" for i in range(60)]
    shuffled = np.random.default_rng(1).permutation(60)
    index = spark.createDataFrame([(terms[j], i) for i, j in enumerate(shuffled)], "term string, idx int")
    model = SimpleNamespace(coefficientMatrix=SimpleNamespace(toArray=lambda: np.full((2, 60), 0.25)))
    fit = SimpleNamespace(model=model, classes=[0, 1], term_index=index)
    got = S.term_weights(fit, n=8, smallest_abs=smallest_abs, names=["a", "b"]).collect()
    for c in "ab":
        assert [r["term"] for r in sorted(got, key=lambda r: r["rank"]) if r["class"] == c] == terms[:8]


def test_pack_ord_rejects_keys_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "doc long, at long")
    got = [r[0] for r in df.select(D.pack_ord(("doc", 40), ("at", 20))).collect()]
    assert got == [(1 << 20) + 5, (2 << 20) + 6]
    for doc, at in (((1 << 43) + 1, 0), (1, 1 << 20), (1, -1)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(doc, at)], "doc long, at long").select(D.pack_ord(("doc", 40), ("at", 20))).collect()


def test_source_is_the_plain_file_name(spark, tmp_path):
    (tmp_path / "b two.md").write_text("# Head\n\nThe device shall log every event.\n")
    got = pipeline.records_from_markdown(spark, [str(tmp_path / "b two.md")]).collect()
    assert [r["source"] for r in got] == ["b two.md"]


def test_files_are_pooled_in_the_order_of_their_paths(spark, tmp_path):
    same = "The device shall log every event."
    for folder, name, own in (("x", "b two.md", "The host may read the log at any time."),
                              ("y", "b two.md", "The host must not erase the log."),
                              ("x", "a.md", "Operators should review the log weekly.")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"# Head {folder}\n\n{own}\n\n{same}\n")
    rec = pipeline.records_from_markdown(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert rec.count() == 6 and {r["doc_ord"] for r in rec.collect()} == {0, 1, 2}
    ds = pipeline.build_dataset(rec, [("doc_ord", 0), ("block_idx", 20), ("sent_idx", 20)])
    got = [(r["text"], r["source"], r["section"]) for r in ds.orderBy("ord").collect()]
    assert got == [("Operators should review the log weekly.", "a.md", "Head x"), (same, "a.md", "Head x"),
                   ("The host may read the log at any time.", "b two.md", "Head x"),
                   ("The host must not erase the log.", "b two.md", "Head y")]


def test_ordered_numbers_cross_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("concat('k', lpad(id % 1000, 4, '0')) AS k")
    got = {r["k"]: r["n"] for r in ordered_number(rows, "k", "n").collect()}
    assert got == {f"k{i:04d}": i for i in range(1000)}


def test_cv_scores_only_forgive_folds_that_cannot_be_fitted(spark, monkeypatch):
    rows = [(i, "alpha beta" if i % 2 else "beta gamma", 0) for i in range(8)]
    train = spark.createDataFrame(rows, "id long, text string, label_id int")
    assert all(r["macro_f1"] != r["macro_f1"] for r in S.cv_scores(train, ["id"], ("logreg",), k=2).collect())

    def broken(*_, **__):
        raise RuntimeError("lost")
    monkeypatch.setattr(S, "fit_predict", broken)
    with pytest.raises(RuntimeError):
        S.cv_scores(train, ["id"], ("nb",), k=2)
