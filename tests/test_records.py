"""Pages and sections of structured documents, pooled records, stored results and splits."""
import pytest
from pyspark.sql import functions as F

from reqlens.operators import dataset as D
from reqlens.operators import evaluate as E
from reqlens.operators import extract as X
from reqlens.plans import pipeline as PL
from reqlens.sources import results as R
from reqlens.sources import tables as IO

MD = """intro before any header
<!-- page break -->

# One

- a) first item

| a | b |

<!-- page break -->

<!-- page break -->

1. noted sentence

Table 1: caption

## Two

closing words"""


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_sections_and_pages_are_carried_together(spark, chunk):
    df = spark.createDataFrame([(1, MD), (2, "no header"), (3, None)], "doc_id long, markdown string")
    blocks = X.md_blocks(df, ["doc_id"], page_break=X.PAGE_BREAK_MARK)
    got = [tuple(r) for r in X.provenance_carry(blocks, ["doc_id"], chunk=chunk).orderBy("doc_id", "block_idx").select(
        "doc_id", "block_type", "section", "page", "text").collect()]
    # the first marker shares a block with text, so it is text and starts no page
    assert got == [(1, "text", "(preamble)", 1, "intro before any header <!-- page break -->"),
                   (1, "list_item", "One", 1, "first item"), (1, "text", "One", 3, "noted sentence"),
                   (1, "text", "Two", 3, "closing words"), (2, "text", "(preamble)", 1, "no header")]


def test_first_page_of_a_provenance_array(spark):
    df = spark.createDataFrame([(1, [(3, "x"), (4, "y")]), (2, []), (3, None)],
                               "id long, prov array<struct<page_no: int, box: string>>")
    assert [r["p"] for r in df.orderBy("id").select(X.first_page(F.col("prov")).alias("p")).collect()] == [3, None, None]


def test_pooled_records_keep_the_first_of_equal_texts_beyond_packed_keys(spark):
    big = 2 ** 62
    schema = "doc long, block_idx long, sent_idx long, text string, page int, section string, block_type string, source string"

    def rec(doc, block, sent, text):
        return (doc, block, sent, text, None, "s", "text", "f")

    a = spark.createDataFrame([rec(big, 5, 0, "same"), rec(big, 2, 1, "same"), rec(7, 9, 9, "own")], schema)
    b = spark.createDataFrame([rec(0, 0, 0, "same"), rec(0, big, 1, "web"), rec(0, 3, 1, "web")], schema)
    keys = ["pool", "doc", "block_idx", "sent_idx"]
    got = {tuple(r) for r in D.dedup_first_by(PL.pooled_records([a, b]), keys).select(*keys, "text").collect()}
    assert got == {(0, big, 2, 1, "same"), (0, 7, 9, 9, "own"), (1, 0, 3, 1, "web")}


def test_results_are_appended_by_run_and_pivoted_back(spark, tmp_path):
    path = str(tmp_path / "results")
    pred = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B")], "y string, p string")
    conf = E.confusion(pred, ["A", "B"])
    R.write_results(R.evaluation_rows(E.summary(conf), E.report(conf), "nb"), path, "r1")
    gain = spark.createDataFrame([("accuracy", 0.5, 0.75, 0.25)], "metric string, before double, after double, gain double")
    weights = spark.createDataFrame([("A", 1, "shall", 2.0), ("A", 2, "must", 1.5)], "class string, rank int, term string, weight double")
    R.write_results(R.tuning_rows(gain, "logreg").unionByName(R.importance_rows(weights, "logreg")), path, "r2")
    R.write_results(R.evaluation_rows(E.summary(conf), None, "nb"), path, "r3")
    R.write_results(R.evaluation_rows(E.summary(conf), None, "svm"), path, "r3")  # replaces that run only
    res = R.read_results(spark, path)
    assert [tuple(r) for r in R.comparison(res).orderBy("run").collect()] == [
        ("r1", "nb", 0.666667, 0.666667, 0.666667), ("r3", "svm", 0.666667, 0.666667, 0.666667)]
    assert [tuple(r) for r in R.tuning_table(res).collect()] == [("r2", "logreg", "accuracy", 0.5, 0.75, 0.25)]
    assert [tuple(r) for r in R.importance_table(res).orderBy("rank").collect()] == [
        ("r2", "logreg", "A", 1, "shall", 2.0), ("r2", "logreg", "A", 2, "must", 1.5)]
    assert {(r["class"], r["support"]) for r in R.per_class_table(R.read_results(spark, path, "r1")).collect()} == {("A", 2), ("B", 1)}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_written_splits_read_back(spark, tmp_path, fmt):
    rows = [(1, 'He said "shall", twice', "train"), (2, "two\nlines, and a comma", "test"), (3, "", "train"), (4, None, "val"),
            (5, "back\\slash \\\" both", "val")]
    df = spark.createDataFrame(rows, "ord long, text string, split string")
    IO.write_splits(df, str(tmp_path / "s"), fmt)
    got = IO.read_splits(spark, str(tmp_path / "s"), df.drop("split").schema, fmt)
    assert sorted(tuple(r) for r in got.select("ord", "text", "split").collect()) == sorted(rows)


def test_records_are_pooled_without_a_folder_per_source(spark, tmp_path):
    rows = [(f"text {i}", None, "s", "text", f"file{i % 40}.md") for i in range(200)]
    df = spark.createDataFrame(rows, "text string, page int, section string, block_type string, source string")
    IO.write_records(df, str(tmp_path / "r"))
    assert not list((tmp_path / "r").glob("source=*")) and spark.read.parquet(str(tmp_path / "r")).count() == 200
