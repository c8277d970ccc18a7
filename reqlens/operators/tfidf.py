"""TF-IDF as long-form DataFrames (V1–V8).

Semantics: lower-case, strip accents (NFKD minus combining marks), tokens of
≥ 2 word characters, word n-grams over the token list, raw or sublinear
(1 + ln tf) term frequency, document-frequency pruning (int = count, float =
fraction of documents), smooth idf ln((1+n)/(1+df)) + 1, L2 row norm.
Spark's ``IDF`` omits the +1 and ``HashingTF`` collides, so this is built from
aggregates.

Plan shape: texts by key → terms counted in place, row by row → partial
/final aggregate by term (df) → join tf with the vocabulary on term (AQE turns
it into a broadcast when the *measured* vocabulary is small and splits a hot
term's partition otherwise) → window by doc for the norm.  The document count
is a scalar subquery, evaluated once.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams_expr, tokens_expr
from .rank import bucketed_rank, hex_bucket


@dataclass(frozen=True)
class TfidfParams:
    ngram_range: tuple = (1, 1)
    min_df: int | float = 1
    max_df: int | float = 1.0
    sublinear_tf: bool = False
    lowercase: bool = True
    strip_accents: bool = True


# Reference configurations.
BASELINE = TfidfParams(ngram_range=(1, 2), max_df=0.9, sublinear_tf=True)
DEFAULTS = TfidfParams()
IMPORTANCE = TfidfParams(ngram_range=(1, 2), sublinear_tf=True)


def _tokens(df: DataFrame, key_cols: list[str], text_col: str, p: TfidfParams) -> DataFrame:
    # tokens become a column of their own, so n-gram building reads it
    # instead of re-running the tokenizer per reference
    return df.select(*key_cols, tokens_expr(F.col(text_col), p.lowercase, p.strip_accents).alias("_tok"))


def terms(df: DataFrame, key_cols: list[str], text_col: str, p: TfidfParams) -> DataFrame:
    """(keys, pos, term): every n-gram occurrence."""
    # the last token of every n-gram is dealt out, by n; each row joins those before it, which is generated code,
    # whereas a lambda over the tokens is interpreted
    lo, hi = p.ngram_range
    size = F.size("_tok")
    counts = [size if n == 1 else F.greatest(size - (n - 1), F.lit(0)) for n in range(lo, hi + 1)]
    lasts = [F.col("_tok") if n == 1 else F.slice("_tok", n, c) for n, c in zip(range(lo, hi + 1), counts, strict=True)]
    g = _tokens(df, key_cols, text_col, p).select(*key_cols, "_tok", F.posexplode(F.concat(*lasts)).alias("pos", "_last"))
    first, branches = F.col("pos"), []
    for n, c in zip(range(lo, hi + 1), counts, strict=True):
        parts = [x for i in range(n - 1) for x in (F.get("_tok", first + i), F.lit(" "))]
        branches.append((first < c, F.concat(*parts, "_last")))
        first = first - c
    term = branches[-1][1]
    for of_n, gram in reversed(branches[:-1]):
        term = F.when(of_n, gram).otherwise(term)
    return g.select(*key_cols, "pos", term.alias("term"))


def term_freq(df: DataFrame, key_cols: list[str], text_col: str, p: TfidfParams) -> DataFrame:
    """(keys, term, tf, tf_w) with tf_w = tf or 1 + ln(tf)."""
    # a text moves once, to its key; its terms are counted in place, in the runs of its sorted n-grams
    texts = df.select(*key_cols, F.col(text_col).alias("_t")).repartition(*key_cols)
    tok = texts.groupBy(*key_cols).agg(F.collect_list("_t").alias("_t")).select(
        *key_cols, F.transform("_t", lambda t: tokens_expr(t, p.lowercase, p.strip_accents)).alias("_tok"))
    grams = F.flatten(F.transform("_tok", lambda k: ngrams_expr(k, p.ngram_range)))
    g = tok.select(*key_cols, F.sort_array(grams).alias("_g")).filter(F.size("_g") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_g") - 1),
                      lambda i: (i == 0) | (F.get("_g", i) != F.get("_g", i - 1)))
    g = g.select(*key_cols, "_g", starts.alias("_s"))
    runs = F.transform("_s", lambda a, j: F.struct(
        F.get("_g", a).alias("term"), (F.coalesce(F.get("_s", j + 1), F.size("_g")) - a).cast("long").alias("tf")))
    tf = g.select(*key_cols, F.inline(runs))
    w = (F.log(F.col("tf")) + 1.0) if p.sublinear_tf else F.col("tf").cast("double")
    return tf.withColumn("tf_w", w)


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _limit(v, n: Column) -> Column:
    return F.lit(v) if isinstance(v, int) else F.lit(float(v)) * n


@dataclass
class TfidfModel:
    params: TfidfParams
    vocab: DataFrame   # (term, df, idf)
    n_docs: Column     # scalar subquery

    def transform(self, df: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
        """(keys, term, weight): L2-normalised tf·idf over the fitted
        vocabulary; unknown terms drop; a document without known terms has no
        rows (zero vector)."""
        return self.transform_tf(term_freq(df, key_cols, text_col, self.params), key_cols)

    def transform_tf(self, tf: DataFrame, key_cols: list[str]) -> DataFrame:
        """Same, from an already computed term-frequency table."""
        j = tf.join(self.vocab.select("term", "idf"), "term")
        w = F.col("tf_w") * F.col("idf")
        norm = F.sqrt(F.sum(w * w).over(Window.partitionBy(*key_cols)))
        return j.select(*key_cols, "term", (w / norm).alias("weight"))

    def indexed_vocab(self, hex_digits: int = 3) -> DataFrame:
        """(term, idx): a dense 0-based feature index (order: md5 of the term,
        computed by the bucketed rank, so no single-task global sort)."""
        v = self.vocab.select("term").withColumn("_h", F.md5("term"))
        r = bucketed_rank(v, [], hex_bucket(F.col("_h"), hex_digits), ["_h", "term"], "idx",
                          n_buckets_bound=16 ** hex_digits)
        return r.select("term", (F.col("idx") - 1).cast("int").alias("idx"))


def fit(df: DataFrame, key_cols: list[str], text_col: str = "text",
        p: TfidfParams = DEFAULTS) -> TfidfModel:
    """Vocabulary, df and smooth idf from the training rows only."""
    n = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    return fit_tf(term_freq(df, key_cols, text_col, p), n, p)


def fit_tf(tf: DataFrame, n, p: TfidfParams = DEFAULTS) -> TfidfModel:
    """Fit from the training rows' term-frequency table and their count ``n``
    (a number or a scalar column)."""
    return fit_df(doc_freq(tf), F.lit(float(n)) if isinstance(n, (int, float)) else n, p)


def fit_df(d: DataFrame, n: Column, p: TfidfParams = DEFAULTS) -> TfidfModel:
    """Fit from the document frequencies (term, df) and the count ``n``."""
    keep = (F.col("df") <= _limit(p.max_df, n)) & (F.col("df") >= _limit(p.min_df, n))
    vocab = d.filter(keep).withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)
    return TfidfModel(p, vocab, n)


def fit_transform(df: DataFrame, key_cols: list[str], text_col: str = "text",
                  p: TfidfParams = DEFAULTS) -> tuple[TfidfModel, DataFrame]:
    """Fit on ``df`` and weight the same rows, by blocks of rows that number
    their own terms, so that (row, term) pairs never move."""
    from .variants import tfidf_weights
    return tfidf_weights(df, key_cols, text_col, p)


@F.udf(VectorUDT())
def _sparse(size, idx, vals):
    return SparseVector(size, idx or [], vals or [])


def to_vectors(weights: DataFrame, key_cols: list[str], term_index: DataFrame,
               size: int, docs: DataFrame, out: str = "features") -> DataFrame:
    """Sparse ML vectors per document (for Spark ML estimators).

    The (term, idx) index joins the long weights; each document's entries are
    collected (bounded by that document's distinct terms) and sorted, and one
    small UDF wraps them as a ``SparseVector``.  Documents without entries get
    the zero vector."""
    e = weights.join(term_index, "term").groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_e"))
    j = docs.join(e, key_cols, "left")
    return j.withColumn(out, _sparse(F.lit(size), F.col("_e.idx"), F.col("_e.weight"))).drop("_e")
