"""Box-plot data read the texts once."""
from reqlens.operators import profile as P


def test_length_box_reads_the_texts_once(spark, tmp_path):
    words = [("A", n) for n in (1, 2, 3, 4, 40)] + [("B", 7), ("B", 7), ("C", None), (None, 3)]
    spark.createDataFrame(words, "label string, word_count int").write.parquet(f"{tmp_path}/lengths")
    df = P.length_box_by_class(spark.read.parquet(f"{tmp_path}/lengths"))
    assert f"{tmp_path}/lengths" not in "".join(df.inputFiles())  # both steps read the counts
    got = {r["label"]: tuple(r)[1:] for r in df.collect()}
    assert got["A"] == (2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)
    assert got["B"] == (7.0, 7.0, 7.0, 7.0, 7.0, 0, 2)
    assert got["C"] == (None, None, None, None, None, None, 1) and set(got) == {"A", "B", "C"}
