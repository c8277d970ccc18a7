"""Driver contract: entry() smoke, registry/oracle keys, and a sample of
queries against their DuckDB oracle on the smallest tables."""
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FAST = ["sentence_filter", "weak_label", "mask_modals", "class_distribution", "sentence_features",
        "feature_corr", "dedup_first", "stratified_split", "kfold_assign", "html_blocks", "section_carry",
        "md_records", "tfidf", "naive_bayes_scores", "roc_curve", "auc_ovr", "classification_summary"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label_id", "label", "cnt", "share"] and df.count() == 5


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 40


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else (round(v, 6) if isinstance(v, float) else v)
    return hashlib.md5("\n".join(sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings", "benchmark"):
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)
