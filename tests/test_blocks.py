"""Terms counted in place and rows in blocks, against row-by-row counts."""
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reqlens.operators import tfidf as T
from reqlens.operators import variants as V

ROWS = [(1, "aa bb aa"), (1, "bb cc"), (2, "cc dd cc dd"), (None, "aa zz"), (3, None), (4, ""), (5, "bb"), (2, "aa"),
        (6, "éé aa bb"), (7, "cc dd")]
P = T.TfidfParams(ngram_range=(1, 2), min_df=2, max_df=0.9, sublinear_tf=True)


def counts(rows=ROWS):
    out = {}
    for i, t in rows:
        w = (t or "").replace("é", "e").split()
        out.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    return {(i, term): n for i, c in out.items() for term, n in c.items()}


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_freq_moves_texts_only(spark):
    tf = T.term_freq(frame(spark), ["id"], "text", P)
    assert {(r["id"], r["term"]): r["tf"] for r in tf.collect()} == counts()
    assert "hashpartitioning(id" in plan(tf) and "term" not in "".join(
        x for x in plan(tf).splitlines() if "hashpartitioning" in x)


@pytest.mark.parametrize("chars", [1, 10, 8_000_000])
def test_tfidf_by_blocks(spark, monkeypatch, chars):
    monkeypatch.setattr(V, "BLOCK_CHARS", chars)
    model, got = T.fit_transform(frame(spark), ["id"], "text", P)
    assert "Window" not in plan(got)
    tf, n = counts(), len(ROWS)
    df = Counter(term for _, term in tf)
    idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in df.items() if 2 <= d <= 0.9 * n}
    want = {k: (1 + math.log(c)) * idf[k[1]] for k, c in tf.items() if k[1] in idf}
    norm = Counter()
    for (i, _), w in want.items():
        norm[i] += w * w
    assert {(r["id"], r["term"]): r["weight"] for r in got.collect()} == pytest.approx(
        {k: w / math.sqrt(norm[k[0]]) for k, w in want.items()})
    assert {r["term"]: r["idf"] for r in model.vocab.collect()} == pytest.approx(idf)


def test_naive_bayes_is_the_same_for_any_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"{'ab'[i % 2]}", i % 3, f"{'xx' if i % 2 else 'yy'} ww w{i % 5} w{i}") for i in range(30)]
                              + [(None, "a", 0, "xx yy"), (7, "b", 1, "xx w7"), (8, "a", 2, "")],
                              "id long, y string, fold int, text string")
    d = d.withColumn("_tr", V.variant_bits([F.col("fold") != i for i in range(3)]))
    seen = []
    for chars in (8_000_000, 7):
        monkeypatch.setattr(V, "BLOCK_CHARS", chars)
        nb = V.VariantNB(d, ["id"], "y", ["a", "b"], 3, also=("fold",))
        assert chars == 7 or nb.bags.select("block").distinct().count() <= 4
        rows = nb.score_own([0, 1, 2], "fold").collect()
        assert len(rows) == 33
        every = nb.score_all([0, 1]).collect()
        assert len(every) == 66
        part = V.VariantNB(d.withColumn("_own", F.when(F.col("id") == 4, 0)), ["id"], "y", ["a", "b"], 3, also=("_own",))
        assert {r["term"] for r in part.terms.filter("own").collect()} == {"yy", "ww", "w4", "yy ww", "ww w4", "w4 w4"}
        seen.append([sorted((str(r["id"]), r["y"], r["variant"], *[round(x, 9) for x in r["scores"]]) for r in x)
                     for x in (rows, every)])
        fitted = nb.fit([0])
        assert "tf_w" not in plan(fitted)
    assert seen[0] == seen[1]
    lone = [r for r in seen[0][0] if r[0] == "None"]
    assert lone[0][3:] == tuple(round(x, 9) for x in nb.prior(0))
