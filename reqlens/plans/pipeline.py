"""End-to-end run (E1): documents → sentence records → weak labels → dedup →
splits → TF-IDF models → metrics tables, as one lineage with two
materialisation points (records and splits) in the shared checkpoint folder.

Options replace the reference's command-line flags: ``mask_modals``,
``candidates``, ``lexicon``; outputs are tidy tables written under ``out``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import extract as X
from ..operators import profile as P
from ..operators import select as S
from ..operators.rank import ordered_number
from ..schema import DEFAULT_LEXICON, Lexicon
from ..session import cut_lineage
from ..sources import tables as IO


def records_from_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Markdown files → sentence records (text, page, section, block_type,
    source) with ordering keys (doc_ord, block_idx, sent_idx); doc_ord numbers
    the files by path, so files of one name in two folders stay apart."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))
    md = (spark.read.text(paths, wholetext=True)
          .select(F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("source"),
                  F.col("value").alias("markdown"))
          .join(ordered_number(files, "path", "doc_ord"), "path"))
    body = X.section_carry(X.md_blocks(md, ["doc_ord", "source"]), ["doc_ord"])
    return X.records(body, ["doc_ord", "source"], F.col("source"))


def records_from_html(pages: DataFrame, key: str = "page_id", source: str = "url") -> DataFrame:
    body = X.section_carry(X.html_blocks(pages.select(key, source, "html"), [key, source]), [key])
    return X.records(body.withColumnRenamed(source, "source"), [key, "source"], F.col("source"))


def pooled_records(parts: list[DataFrame]) -> DataFrame:
    """Records of several collections (each with ``doc``, ``block_idx``,
    ``sent_idx``) as one table; ``pool`` is the collection's place in the list,
    so (pool, doc, block_idx, sent_idx) orders all records without packing."""
    cols = ["doc", "block_idx", "sent_idx", "text", "page", "section", "block_type", "source"]
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("pool"), *cols)
        out = p if out is None else out.unionByName(p)
    return out


def build_dataset(records: DataFrame, order_cols: list[tuple[str, int]],
                  lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Dedup (first occurrence by the packed ordering key) → labels → splits.
    The key must be unique: records of several documents need ``doc_ord`` first."""
    r = records.withColumn("ord", D.pack_ord(*order_cols))
    labeled = D.with_labels(D.dedup_first(r), lexicon=lexicon)
    return cut_lineage(D.stratified_split(labeled, ["ord"]))


def run(spark: SparkSession, records: DataFrame, order_cols: list[tuple[str, int]], out: str,
        mask_modals: bool = False, candidates=S.CANDIDATES, lexicon: Lexicon = DEFAULT_LEXICON) -> dict:
    splits = build_dataset(records, order_cols, lexicon)
    IO.write_splits(splits, f"{out}/dataset")
    P.class_distribution(splits).write.mode("overwrite").json(f"{out}/label_stats")
    res = S.baseline_run(splits, ["ord"], mask=mask_modals, candidates=candidates, lexicon=lexicon)
    tag = f"baseline_{res['selected']}" + ("_masked" if mask_modals else "")
    IO.write_metrics(IO.metrics_frame(spark, tag, res["metrics"]), f"{out}/metrics/{tag}")
    res["cv"].write.mode("overwrite").json(f"{out}/metrics/{tag}_cv")
    return {"tag": tag, **res}


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model."""
    model.write().overwrite().save(path)
