"""Blocks and records that two steps read are extracted once."""
import pytest

import __spark_entry__ as entry

TEXTS = [(1, "a", "# One.\nThe host shall go. It may not stop now.\n- first item that is long"), (2, "b", None), (3, "c", ""),
         (4, "a", "The host shall go. It may not stop now.\n1. Another paragraph of words here")]
PAGES = [(1, "u", "<h1>T</h1><p>The host shall go. It may not stop now.</p>"), (2, "v", None)]


@pytest.mark.parametrize("name", ["md_records", "pooled_records", "pooled_splits"])
def test_texts_are_not_read_by_the_second_step(spark, tmp_path, name):
    spark.createDataFrame(TEXTS, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    assert not [f for f in df.inputFiles() if str(tmp_path) in f]
    rows = df.collect()
    if name == "pooled_splits":
        assert {r["split"] for r in rows} <= {"train", "val", "test"} and rows
        return
    assert any(r["text"] == "It may not stop now." for r in rows)
    if name == "pooled_records":
        assert len({r["text"] for r in rows}) == len(rows)
