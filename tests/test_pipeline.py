"""Document discovery and the pipeline's records → dataset path."""
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import REF
from reqlens.operators.extract import discover_documents
from reqlens.plans import pipeline as PL


def test_discover_documents(spark):
    d = tempfile.mkdtemp(prefix="reqlens-raw-")
    for name in ("b.MD", "a.html", "notes.txt", "c.pdf"):
        with open(os.path.join(d, name), "w") as fh:
            fh.write("# T\n\nBody text here.\n")
    got = [(r["source"], r["doc_ord"]) for r in discover_documents(spark, d).orderBy("doc_ord").collect()]
    assert got == [("a.html", 0), ("b.MD", 1), ("c.pdf", 2)]
    empty = tempfile.mkdtemp(prefix="reqlens-empty-")
    with open(os.path.join(empty, "x.txt"), "w") as fh:
        fh.write("x")
    with pytest.raises(FileNotFoundError):
        discover_documents(spark, empty)


@pytest.mark.skipif(not os.path.isdir(REF), reason="reference data absent")
def test_markdown_records_to_dataset(spark):
    paths = glob.glob(f"{REF}/data/parsed/*.md")
    rec = PL.records_from_markdown(spark, paths)
    ds = PL.build_dataset(rec, [("block_idx", 0), ("sent_idx", 20)])
    counts = {r["split"]: r["count"] for r in ds.groupBy("split").count().collect()}
    assert counts == {"train": 87, "val": 13, "test": 25}
    assert ds.filter(F.col("section") == "(preamble)").count() == 0


def test_html_records(spark):
    pages = spark.createDataFrame([(1, "http://x/a", "<h1>Scope</h1><p>The host shall reset it. It may retry.</p>")],
                                  "page_id long, url string, html string")
    got = [(r["section"], r["text"]) for r in PL.records_from_html(pages).orderBy("sent_idx").collect()]
    # "It may retry." has 13 characters: dropped by the fragment filter
    assert got == [("Scope", "The host shall reset it.")]
