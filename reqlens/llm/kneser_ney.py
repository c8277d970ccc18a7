"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The symbols are the UTF-16 units of a text, so the model needs no vocabulary and an n-gram of ORDER units is
one long. Its counts come from all trusted documents (those with quality 1 in ``labels``) by partial counts
per task and one sum per n-gram; the counts of lower orders are continuation counts, and each order has the
three discounts of its counts of counts.

No task needs the model as a whole, and no text is shuffled. Each task writes its rows as block files into
the shared folder. A block asks once for the distinct n-grams it holds; the requests are joined with the
counts, sharded by n-gram, order by order; and each block gets back the probabilities of its own n-grams,
with which it scores its documents.

A document is rejected when its perplexity exceeds what its language allows: the limit is the QUANTILE of the
log-perplexities of trusted documents that the model has not been trained on (a third is held out), by language
and length class. SHORT over the square root of the text's length is taken off before and added to the limit, as
one number or name moves the mean of a short text. Of fewer than 1 / (1 - QUANTILE) documents it is the largest.

Defined cases: a null or empty text has no units, perplexity null, and is kept; a language without enough
held-out documents (or a null language) takes the limit of all languages; with fewer than MIN_HELD_OUT held-out documents
in all, the limit is what a uniform draw of the known units would cost, with the same term for short texts;
without any trusted document the model is uniform and all are kept; a null doc_id is scored like any other; rows that repeat a doc_id are
scored one by one, and a label of the id holds for all of them; a document with labels of both kinds is
trusted by any 1; an empty table gives no rows; filtering keeps all columns and other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.blocks import block_slices, by_block, store_blocks, without_rows
from reqlens.llm.common import stored, table

ORDER = 4
UNIT_BITS = 16
HELD_OUT = 3  # one trusted document in so many sets limits instead of training
QUANTILE = 0.995
SHORT = 0.5
MIN_HELD_OUT = 20
#: Length classes by the number of units: short texts vary more.
LENGTHS = (0, 64, 128, 256, 512, 1024, 4096)
SLICE_UNITS = 1 << 19


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each UTF-16 unit of the text, packed into a long; zeros stand before the text."""
    units = np.frombuffer(b"\0\0" * (ORDER - 1) + text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    n = len(units) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(UNIT_BITS)) | units[k:k + n]
    return out.view(np.int64)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE_UNITS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _suffix(g: Column, k: int) -> Column:
    """The last k - 1 units of a k-gram."""
    return g.bitwiseAND(F.lit((1 << (UNIT_BITS * (k - 1))) - 1))


def _context(g: Column) -> Column:
    return F.shiftrightunsigned(g, UNIT_BITS)


class KneserNey:
    """Counts by order: ``counts[k]`` has g, c for k-grams; contexts and discounts follow from them."""

    def __init__(self, top: DataFrame):
        self.counts = {ORDER: top}
        for k in range(ORDER, 1, -1):  # how many different units stand before a (k-1)-gram
            self.counts[k - 1] = stored(self.counts[k].groupBy(_suffix(F.col("g"), k).alias("g")).agg(
                F.count("*").alias("c")), f"kn{k - 1}")
        self.discounts = {k: self._discounts(df) for k, df in self.counts.items()}
        # the number of different units, unknown ones included
        self.n_units = self.counts[1].count() + 1

    @staticmethod
    def _discounts(counts: DataFrame) -> list[float]:
        row = counts.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).collect()[0]
        n = [row[f"n{i}"] for i in range(1, 5)]
        if not all(n):  # too few to estimate
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]

    def _terms(self, k: int) -> tuple[DataFrame, DataFrame]:
        """(g, discounted count) and (context, total, mass left to the lower order) of order k."""
        d1, d2, d3 = self.discounts[k]
        c = F.col("c")
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        df = self.counts[k]
        per_gram = df.select("g", (c - off).alias("left_over"))
        per_context = df.groupBy(_context(F.col("g")).alias("context")).agg(
            F.sum("c").alias("total"), F.sum(off).alias("mass"))
        return per_gram, per_context

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """g, logp for the distinct n-grams g of ``wanted``: sharded joins, lowest order first."""
        levels = {ORDER: wanted.select("g")}
        for k in range(ORDER, 1, -1):
            levels[k - 1] = levels[k].select(_suffix(F.col("g"), k).alias("g")).distinct()
        lower = None
        for k in range(1, ORDER + 1):
            per_gram, per_context = self._terms(k)
            df = levels[k].join(per_gram, "g", "left").withColumn("context", _context(F.col("g"))) \
                .join(per_context, "context", "left")
            if lower is None:
                df = df.withColumn("lower", F.lit(1.0 / self.n_units))
            else:
                df = df.withColumn("suffix", _suffix(F.col("g"), k)).join(lower, "suffix")
            p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(
                (F.coalesce("left_over", F.lit(0.0)) + F.col("mass") * F.col("lower")) / F.col("total"))
            if k == ORDER:
                return df.select("g", F.log(p).alias("logp"))
            lower = stored(df.select(F.col("g").alias("suffix"), p.alias("lower")), f"kn-p{k}")
        raise AssertionError


def _texts(b: pa.RecordBatch) -> list[str]:
    return [x or "" for x in b.column("text").to_pylist()]


def requests(folder: str, blocks: DataFrame, training: DataFrame) -> DataFrame:
    """block, g, c: the distinct n-grams of each block and their counts in the rows (block, row) to train on."""
    schema = pa.schema([("block", pa.string()), ("g", pa.int64()), ("c", pa.int64())])

    def ask(own: pa.Table, rows: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        total = pd.Series(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for first, b in block_slices(folder, own):
            texts, parts = _texts(b), [total]
            train = np.isin(np.arange(first, first + len(texts)), rows["row"].to_numpy())
            for chosen in (True, False):
                for part in _slices([t for t, x in zip(texts, train, strict=True) if t and x == chosen]):
                    g, c = np.unique(np.concatenate([grams(t) for t in part]), return_counts=True)
                    parts.append(pd.Series(c if chosen else np.zeros(len(g), np.int64), g))
            total = pd.concat(parts).groupby(level=0).sum()
        name = own["block"][0].as_py()
        return pa.table([pa.array([name] * len(total), pa.string()), pa.array(total.index.to_numpy(np.int64)),
                         pa.array(total.to_numpy(np.int64))], schema=schema)

    return by_block(blocks, training).applyInArrow(
        ask, "block string, g long, c long")


def log_perplexity(folder: str, blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """block, row, n_units, log_ppl of every stored row, from the log-probabilities (block, g, logp)."""
    schema = pa.schema([("block", pa.string()), ("row", pa.int64()), ("n_units", pa.int64()),
                        ("log_ppl", pa.float64())])

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        g = found["g"].to_numpy()
        order = np.argsort(g)
        index, logp = pd.Index(g[order]), found["logp"].to_numpy()[order]
        n, total = [], []
        for part in (x for _, b in block_slices(folder, own) for x in _slices(_texts(b))):
            size = np.array([len(x.encode("utf-16-le", "surrogatepass")) // 2 for x in part])
            one = np.zeros(len(part))
            if full := [x for x in part if x]:
                which = index.get_indexer(np.concatenate([grams(x) for x in full]))
                if (which < 0).any():
                    raise ValueError("an n-gram of the block has no answer")
                some = size[size > 0]
                one[size > 0] = np.add.reduceat(logp[which], np.cumsum(some) - some)
            n.append(size)
            total.append(one)
        n, total = (np.concatenate(x) if x else np.zeros(0) for x in (n, total))
        ppl = pa.array(np.where(n > 0, -total / np.maximum(n, 1), np.nan), from_pandas=True)
        name = own["block"][0].as_py()
        return pa.table([pa.array([name] * len(n), pa.string()), pa.array(np.arange(len(n))),
                         pa.array(n.astype(np.int64)), ppl], schema=schema)

    return by_block(blocks, answers).applyInArrow(
        score, "block string, row long, n_units long, log_ppl double")


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, at in enumerate(LENGTHS):
        out = F.when(n >= at, i).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame) -> tuple[str, DataFrame]:
    """(folder, scores): the folder of the block files of ``docs``, and block, row, doc_id, n_units, log_ppl,
    limit, kept of every row."""
    folder, places = store_blocks(docs, "lang")
    blocks = places.select("block").distinct()
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD_OUT)) == 0
    asked = stored(requests(folder, blocks, places.select("block", "row", "doc_id").join(
        trusted.where(~held), "doc_id").select("block", "row")), "requests")
    model = KneserNey(stored(asked.where("c > 0").groupBy("g").agg(F.sum("c").alias("c")), f"kn{ORDER}"))
    answers = asked.select("block", "g").join(stored(model.log_probs(asked.select("g").distinct()), "log-probs"), "g")
    scores = stored(log_perplexity(folder, blocks, answers).join(
        places.withColumn("lang", F.coalesce("lang", F.lit(""))), ["block", "row"]).withColumn(
        "length", _length_class(F.col("n_units"))), "perplexity")
    sample = scores.where("log_ppl IS NOT NULL").join(trusted.where(held), "doc_id", "left_semi")

    short = F.lit(SHORT) / F.sqrt(F.greatest("n_units", F.lit(1)))

    def quantiles(*by: str) -> DataFrame:
        q = F.percentile_approx(F.col("log_ppl") - short, QUANTILE, 10_000)
        out = sample.groupBy(*by).agg(q.alias("limit_" + "_".join(by)), F.count("*").alias("n"))
        return out.where(F.col("n") >= MIN_HELD_OUT).drop("n")

    everywhere = quantiles().collect()  # one row
    limits = scores.join(stored(quantiles("lang", "length"), "limits"), ["lang", "length"], "left") \
        .join(stored(quantiles("lang"), "limits"), "lang", "left") \
        .join(stored(quantiles("length"), "limits"), "length", "left")
    # a class of its own sets its limit; a thin one takes the wider of its language's and its length's
    limit = F.coalesce("limit_lang_length", F.greatest("limit_lang", "limit_length"),
                       F.lit(everywhere[0][0] if everywhere else math.log(model.n_units))) + short
    return folder, limits.select("block", "row", "doc_id", "n_units", "log_ppl", limit.alias("limit")).withColumn(
        "kept", F.coalesce(F.col("log_ppl") <= F.col("limit"), F.lit(True)))


def keep_trustworthy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, read from their block files."""
    folder, scores = classify(docs, labels)
    scores = stored(scores.select("block", "row", "kept"), "verdicts")
    return without_rows(folder, scores, scores.where(~F.col("kept")), docs.schema)


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.exp("log_ppl").alias("perplexity"), "kept", "n_units", "log_ppl", "limit")
