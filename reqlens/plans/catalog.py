"""Query catalogue: every operator of the survey as a named Spark query over
the stock tables, with its independent DuckDB oracle where one exists.

Each query reads whole tables (``{sf_dir}/{name}.parquet``) and returns a lazy
DataFrame; no row caps or id subsets.  Column names and types match the
oracle (counts BIGINT, label_id INT, floats rounded to 6 dp).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FEATURES, mask_expr
from ..operators import dataset as D
from ..operators import extract as X
from ..operators import profile as P
from ..schema import LABELS
from ..sources.tables import read_table
from . import oracle as O

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def cued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cued sentences of ``documents`` with weak labels."""
    return D.with_labels(X.cued_sentences(table(spark, sf_dir, "documents")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_features(cued(spark, sf_dir))


LABEL_VALUES = "(VALUES " + ", ".join(f"({i}, {O.q(l)})" for i, l in enumerate(LABELS)) + ") AS lt(label_id, label)"

# --------------------------------------------------------------------------- #
# Sentences
# --------------------------------------------------------------------------- #


@query("sentences", "WITH " + O.cte_sentences(False) + "\nSELECT doc_id, sent_idx, text FROM sent")
def q_sentences(spark, sf_dir):
    return X.sentences(table(spark, sf_dir, "documents"), ["doc_id"], fragment_filter=False)


@query("sentence_filter", "WITH " + O.cte_sentences(True) + "\nSELECT doc_id, sent_idx, text FROM sent")
def q_sentence_filter(spark, sf_dir):
    return X.sentences(table(spark, sf_dir, "documents"), ["doc_id"])


# --------------------------------------------------------------------------- #
# Labels and masks
# --------------------------------------------------------------------------- #


@query("weak_label", "WITH " + O.cte_cued() + "\nSELECT doc_id, sent_idx, label, label_id FROM labeled")
def q_weak_label(spark, sf_dir):
    return cued(spark, sf_dir).select("doc_id", "sent_idx", "label", "label_id")


@query("mask_modals", "WITH " + O.cte_cued() + f"\nSELECT doc_id, sent_idx, {O.mask_sql('text')} AS masked FROM cued")
def q_mask_modals(spark, sf_dir):
    c = X.cued_sentences(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "sent_idx", mask_expr(F.col("text")).alias("masked"))


GOLD_EVERY = 5  # gold rows: cue position divisible by 5 are relabeled OPTIONAL


@query("label_override", "WITH " + O.cte_cued() + f""", gold AS (
  SELECT text AS gt, min('OPTIONAL') AS gl FROM cued WHERE ((doc_id * 7 + sent_idx) % 25) % {GOLD_EVERY} = 0 GROUP BY text
), o AS (
  SELECT l.doc_id, l.sent_idx, coalesce(g.gl, l.label) AS label, CAST(g.gl IS NOT NULL AS INTEGER) AS overridden
  FROM labeled l LEFT JOIN gold g ON l.text = g.gt
)
SELECT doc_id, sent_idx, label, {O.label_id_sql()} AS label_id, overridden FROM o""")
def q_label_override(spark, sf_dir):
    c = cued(spark, sf_dir)
    gold = (c.filter(((F.col("doc_id") * 7 + F.col("sent_idx")) % 25) % GOLD_EVERY == 0)
             .select("text", F.lit("OPTIONAL").alias("label")))
    return D.apply_override(c, gold).select("doc_id", "sent_idx", "label", "label_id", "overridden")


@query("label_consistency", "WITH " + O.cte_cued() + """, shifted AS (
  SELECT doc_id, sent_idx, label, CASE WHEN doc_id % 10 = 0 THEN CAST((label_id + 1) % 5 AS INTEGER) ELSE label_id END AS label_id
  FROM labeled
)
SELECT doc_id, sent_idx, label, label_id FROM shifted WHERE label_id <> """ + O.label_id_sql())
def q_label_consistency(spark, sf_dir):
    c = cued(spark, sf_dir)
    # fault injection so the check has rows to report
    c = c.withColumn("label_id", F.when(F.col("doc_id") % 10 == 0, ((F.col("label_id") + 1) % 5).cast("int"))
                     .otherwise(F.col("label_id")))
    return D.label_inconsistencies(c).select("doc_id", "sent_idx", "label", "label_id")


# --------------------------------------------------------------------------- #
# Dedup (A1)
# --------------------------------------------------------------------------- #


@query("dedup_first", "WITH " + O.cte_cued() + """, r AS (
  SELECT doc_id, sent_idx, text, row_number() OVER (PARTITION BY text ORDER BY doc_id, sent_idx) AS rn FROM cued
)
SELECT doc_id, sent_idx, text FROM r WHERE rn = 1""")
def q_dedup_first(spark, sf_dir):
    c = X.cued_sentences(table(spark, sf_dir, "documents"))
    c = c.withColumn("ord", D.pack_ord(("doc_id", 0), ("sent_idx", 24)))
    return D.dedup_first(c).select("doc_id", "sent_idx", "text")


@query("dedup_documents", """SELECT doc_id, lang, n_chars FROM (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents
) WHERE rn = 1""")
def q_dedup_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))
    return D.dedup_first(d).select("doc_id", "lang", "n_chars")


# --------------------------------------------------------------------------- #
# Class profiles (A2–A10) and features
# --------------------------------------------------------------------------- #


@query("class_distribution", "WITH " + O.cte_cued() + f""", cnt AS (
  SELECT label, count(*) AS cnt FROM labeled GROUP BY label
), dense AS (
  SELECT lt.label_id, lt.label, CAST(coalesce(cnt.cnt, 0) AS BIGINT) AS cnt FROM {LABEL_VALUES} LEFT JOIN cnt ON lt.label = cnt.label
)
SELECT label_id, label, cnt, round(cnt / sum(cnt) OVER (), 6) AS share FROM dense""")
def q_class_distribution(spark, sf_dir):
    return P.class_distribution(cued(spark, sf_dir))


@query("majority_baseline", "WITH " + O.cte_cued() + """, cnt AS (
  SELECT label, count(*) AS cnt FROM labeled GROUP BY label
)
SELECT CAST(max(cnt) AS BIGINT) AS majority_cnt, CAST(sum(cnt) AS BIGINT) AS n, round(max(cnt) / sum(cnt), 6) AS accuracy FROM cnt""")
def q_majority_baseline(spark, sf_dir):
    return P.majority_baseline(cued(spark, sf_dir))


@query("class_weights", "WITH " + O.cte_cued() + f""", cnt AS (
  SELECT label, count(*) AS cnt FROM labeled GROUP BY label
), dense AS (
  SELECT lt.label_id, lt.label, CAST(coalesce(cnt.cnt, 0) AS BIGINT) AS cnt FROM {LABEL_VALUES} LEFT JOIN cnt ON lt.label = cnt.label
)
SELECT label_id, label, cnt,
       round(CASE WHEN cnt > 0 THEN (sum(cnt) OVER ()) / ((sum(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) OVER ()) * cnt) ELSE 1.0 END, 6) AS weight
FROM dense""")
def q_class_weights(spark, sf_dir):
    return P.class_weights(cued(spark, sf_dir))


def _feature_select() -> list:
    cols = []
    for f in FEATURES:
        c = F.col(f)
        cols.append(F.round(c, 6).alias(f) if f == "avg_word_len" else c.cast("long").alias(f))
    return cols


@query("sentence_features", "WITH " + O.cte_features() + "\nSELECT doc_id, sent_idx, " +
       ", ".join(O.FEATURE_NAMES) + " FROM feats")
def q_sentence_features(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", "sent_idx", *_feature_select())


def _means_sql(round_mean: bool) -> str:
    parts = []
    for f in O.FEATURE_NAMES:
        m = f"avg(CAST(f.{f} AS DOUBLE))"
        parts.append(f"SELECT lt.label_id, lt.label, '{f}' AS feature, {f'round({m}, 6)' if round_mean else m} AS mean "
                     f"FROM {LABEL_VALUES} LEFT JOIN feats f ON lt.label = f.label GROUP BY lt.label_id, lt.label")
    return "\nUNION ALL ".join(parts)


@query("feature_means_by_class", "WITH " + O.cte_features() + "\n" + _means_sql(True))
def q_feature_means_by_class(spark, sf_dir):
    return P.feature_means_by_class(features(spark, sf_dir))


@query("feature_zscore_by_class", "WITH " + O.cte_features() + ", m AS (\n" + _means_sql(False) + """
)
SELECT label_id, label, feature, round(mean, 6) AS mean,
       round((mean - avg(mean) OVER (PARTITION BY feature)) /
             CASE WHEN stddev_pop(mean) OVER (PARTITION BY feature) = 0 THEN 1 ELSE stddev_pop(mean) OVER (PARTITION BY feature) END, 6) AS z
FROM m""")
def q_feature_zscore_by_class(spark, sf_dir):
    return P.feature_zscore_by_class(features(spark, sf_dir))


def _corr_sql(only_label: bool) -> str:
    import itertools
    cols = list(O.FEATURE_NAMES) + ["label_id"]
    pairs = list(itertools.combinations(cols, 2))
    one = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS \"{a}__{b}\"" for a, b in pairs)
    rows = []
    for a, b in pairs:
        if only_label and b != "label_id":
            continue
        v = f"\"{a}__{b}\""
        r = f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"
        if only_label:
            rows.append(f"SELECT '{a}' AS feature, round(abs({r}), 3) AS abs_r FROM c")
        else:
            rows.append(f"SELECT '{a}' AS a, '{b}' AS b, round({r}, 6) AS r FROM c")
    return "WITH " + O.cte_features() + f", c AS (SELECT {one} FROM feats)\n" + "\nUNION ALL ".join(rows)


@query("feature_corr", _corr_sql(False))
def q_feature_corr(spark, sf_dir):
    return P.feature_corr(features(spark, sf_dir))


@query("label_corr_rank", _corr_sql(True))
def q_label_corr_rank(spark, sf_dir):
    return P.label_corr_rank(features(spark, sf_dir))


@query("length_box_by_class", "WITH " + O.cte_features() + """, qs AS (
  SELECT label, quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.5) AS median,
         quantile_cont(word_count, 0.75) AS q3 FROM feats GROUP BY label
), fz AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qs
)
SELECT fz.label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(CAST(min(CASE WHEN word_count BETWEEN lo AND hi THEN word_count END) AS DOUBLE), 6) AS whisker_lo,
       round(CAST(max(CASE WHEN word_count BETWEEN lo AND hi THEN word_count END) AS DOUBLE), 6) AS whisker_hi,
       CAST(sum(CASE WHEN word_count BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
       CAST(count(*) AS BIGINT) AS n
FROM feats JOIN fz ON feats.label = fz.label
GROUP BY fz.label, q1, median, q3""")
def q_length_box_by_class(spark, sf_dir):
    return P.length_box_by_class(features(spark, sf_dir))


# --------------------------------------------------------------------------- #
# Splits and folds
# --------------------------------------------------------------------------- #


def split_df(spark, sf_dir):
    return D.stratified_split(cued(spark, sf_dir), ["doc_id", "sent_idx"])


@query("stratified_split", "WITH " + O.cte_split() + "\nSELECT doc_id, sent_idx, label, split FROM splitted")
def q_stratified_split(spark, sf_dir):
    return split_df(spark, sf_dir).select("doc_id", "sent_idx", "label", "split")


@query("split_audit", "WITH " + O.cte_split() + """, multi AS (
  SELECT doc_id, sent_idx FROM splitted GROUP BY doc_id, sent_idx HAVING count(DISTINCT split) > 1
)
SELECT s.split, s.label, CAST(count(*) AS BIGINT) AS cnt, CAST(count(m.doc_id) AS BIGINT) AS overlap
FROM splitted s LEFT JOIN multi m ON s.doc_id = m.doc_id AND s.sent_idx = m.sent_idx
GROUP BY s.split, s.label""")
def q_split_audit(spark, sf_dir):
    return D.split_audit(split_df(spark, sf_dir), ["doc_id", "sent_idx"])


@query("kfold_assign", "WITH " + O.cte_cued() + f""", cnt AS (
  SELECT label_id, count(*) AS c FROM labeled GROUP BY label_id
), k AS (
  SELECT CASE WHEN min(c) >= 2 THEN greatest(2, least(5, min(c))) ELSE 2 END AS k FROM cnt
)
SELECT doc_id, sent_idx, label_id,
       CAST((row_number() OVER (ORDER BY label_id, {O.key_md5()}, doc_id, sent_idx) - 1) % (SELECT k FROM k) AS INTEGER) AS fold
FROM labeled""")
def q_kfold_assign(spark, sf_dir):
    return D.kfold_assign(cued(spark, sf_dir), ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "label_id", "fold")


# --------------------------------------------------------------------------- #
# Block extraction
# --------------------------------------------------------------------------- #


def html_blocks_df(spark, sf_dir):
    return X.html_blocks(table(spark, sf_dir, "pages"), ["page_id"])


@query("html_blocks", "WITH " + O.html_blocks_sql() + "\nSELECT page_id, block_idx, block_type, text FROM html_blocks")
def q_html_blocks(spark, sf_dir):
    return html_blocks_df(spark, sf_dir)


@query("section_carry", "WITH " + O.html_blocks_sql() + ", carried AS (\n" + O.carry_sql("html_blocks", "page_id") + """
)
SELECT page_id, block_idx, block_type, section, text FROM carried WHERE block_type IN ('text', 'paragraph', 'list_item')""")
def q_section_carry(spark, sf_dir):
    return X.section_carry(html_blocks_df(spark, sf_dir), ["page_id"]).select(
        "page_id", "block_idx", "block_type", "section", "text")


def md_body(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    md = docs.select("doc_id", "source", X.markdown_from_lines(F.col("source"), F.col("text")).alias("markdown"))
    # both levels of the carry read the blocks, and extraction is the costly part
    return X.section_carry(stored(X.md_blocks(md, ["doc_id", "source"]), "blocks"), ["doc_id"])


@query("md_blocks", "WITH " + O.md_blocks_sql() + ", carried AS (\n" + O.carry_sql("md_nonempty", "doc_id") + """
)
SELECT doc_id, block_idx, block_type, section, text FROM carried WHERE block_type IN ('text', 'paragraph', 'list_item')""")
def q_md_blocks(spark, sf_dir):
    return md_body(spark, sf_dir).select("doc_id", "block_idx", "block_type", "section", "text")


@query("md_records", "WITH " + O.md_blocks_sql() + ", carried AS (\n" + O.carry_sql("md_nonempty", "doc_id") + """
), body AS (
  SELECT c.*, d.source FROM carried c JOIN documents d ON c.doc_id = d.doc_id WHERE block_type IN ('text', 'paragraph', 'list_item')
), s_raw AS (
  SELECT doc_id, block_idx, block_type, section, source, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS sent_idx
  FROM (SELECT *, """ + O.SENT_SPLIT_SQL.format(t="text") + """ AS l FROM body)
)
SELECT text, CAST(NULL AS INTEGER) AS page, section, block_type, source, doc_id, block_idx, CAST(sent_idx AS BIGINT) AS sent_idx
FROM s_raw WHERE length(text) >= 15 AND regexp_matches(text, '[a-zA-Z]')""")
def q_md_records(spark, sf_dir):
    return X.records(md_body(spark, sf_dir), ["doc_id"], F.col("source"))


# --------------------------------------------------------------------------- #
# TF-IDF (V1–V8) over documents
# --------------------------------------------------------------------------- #
from ..operators import evaluate as E  # noqa: E402
from ..operators import models as M  # noqa: E402
from ..operators import tfidf as T  # noqa: E402
from ..operators import variants as V  # noqa: E402
from ..session import cut_lineage, stored  # noqa: E402

# Query configuration: bigrams, sublinear tf, min_df 2, max_df 0.9.
TFIDF_Q = T.TfidfParams(ngram_range=(1, 2), min_df=2, max_df=0.9, sublinear_tf=True)
TFIDF_SQL = O.tfidf_ctes("x", "documents", "documents", ["doc_id"], "text", 2, True, 2, 0.9)


@query("tokens", f"""SELECT doc_id, CAST(generate_subscripts(k, 1) - 1 AS BIGINT) AS pos, unnest(k) AS term
FROM (SELECT doc_id, {O.tokens_sql('text')} AS k FROM documents)""")
def q_tokens(spark, sf_dir):
    t = T.terms(table(spark, sf_dir, "documents"), ["doc_id"], "text", T.TfidfParams())
    return t.select("doc_id", F.col("pos").cast("long"), "term")


@query("ngrams", f"""SELECT doc_id, CAST(generate_subscripts(k, 1) - 1 AS BIGINT) AS pos, unnest(k) AS term
FROM (SELECT doc_id, {O.grams_sql('k', 2)} AS k FROM (SELECT doc_id, {O.tokens_sql('text')} AS k FROM documents))""")
def q_ngrams(spark, sf_dir):
    t = T.terms(table(spark, sf_dir, "documents"), ["doc_id"], "text", TFIDF_Q)
    return t.select("doc_id", F.col("pos").cast("long"), "term")


@query("term_freq", "WITH " + O.tf_ctes("x", "documents", ["doc_id"], "text", 2, True) +
       "\nSELECT doc_id, term, tf, round(tf_w, 6) AS tf_sub FROM xtf")
def q_term_freq(spark, sf_dir):
    tf = T.term_freq(table(spark, sf_dir, "documents"), ["doc_id"], "text", TFIDF_Q)
    return tf.select("doc_id", "term", "tf", F.round("tf_w", 6).alias("tf_sub"))


@query("doc_freq", "WITH " + O.tf_ctes("x", "documents", ["doc_id"], "text", 2, True) +
       "\nSELECT term, CAST(count(*) AS BIGINT) AS df FROM xtf GROUP BY term")
def q_doc_freq(spark, sf_dir):
    return T.doc_freq(T.term_freq(table(spark, sf_dir, "documents"), ["doc_id"], "text", TFIDF_Q))


@query("idf", "WITH " + TFIDF_SQL + "\nSELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM xvocab")
def q_idf(spark, sf_dir):
    m = T.fit(table(spark, sf_dir, "documents"), ["doc_id"], "text", TFIDF_Q)
    return m.vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf", "WITH " + TFIDF_SQL + "\nSELECT doc_id, term, round(weight, 6) AS weight FROM xw")
def q_tfidf(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    _, w = T.fit_transform(d, ["doc_id"], "text", TFIDF_Q)
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --------------------------------------------------------------------------- #
# Naive Bayes and softmax over documents, y = lang (M1, M4)
# --------------------------------------------------------------------------- #
DOC_SPLIT_SQL = O.split_ctes("d", "documents", "lang", "md5('5644:' || doc_id)", "doc_id") + \
    ", dtrain AS (SELECT * FROM dsplit WHERE split <> 'test')"
NB_DOCS_SQL = ("WITH " + DOC_SPLIT_SQL + ", " +
               O.tfidf_ctes("x", "dtrain", "documents", ["doc_id"], "text", 2, True, 1, 0.9) + ", " +
               O.nb_ctes("x", "dtrain", "documents", ["doc_id"], "lang", "lang"))


def nb_on_split(sp, keys, y_col, classes, scored):
    """NB on TF-IDF fitted on the train ∪ val rows of a split: scores of the
    rows for which ``scored`` holds, and the model.  One variant of ``VariantNB``: the texts
    are tokenised once, and a scored (row, term) pair meets idf and class
    log-probabilities in one join, norm and sums in one aggregate."""
    rows = sp.withColumn("_tr", V.variant_bits([F.col("split") != "test"])).withColumn("_own", F.when(scored, F.lit(0)))
    nb = V.VariantNB(rows, keys, y_col, classes, 1, params=T.BASELINE, also=("_own",))
    return nb.score_own([0], "_own"), nb


def nb_documents(spark, sf_dir):
    """Stratified split of documents by lang; TF-IDF + NB fitted on
    train ∪ val; every document scored.  Returns (scores df, classes)."""
    docs = table(spark, sf_dir, "documents")
    sp = cut_lineage(D.stratified_split(docs, ["doc_id"], "lang"))
    classes = V.present_classes(sp.filter(F.col("split") != "test"), "lang")
    return nb_on_split(sp, ["doc_id"], "lang", classes, F.lit(True))[0], classes


@query("naive_bayes_scores", NB_DOCS_SQL + "\nSELECT doc_id, cls AS class, round(score, 6) AS score FROM xscores")
def q_naive_bayes_scores(spark, sf_dir):
    sc, classes = nb_documents(spark, sf_dir)
    cls = F.array(*[F.lit(c) for c in classes])
    return sc.select("doc_id", F.posexplode("scores").alias("_i", "score")).select(
        "doc_id", F.element_at(cls, F.col("_i") + 1).alias("class"), F.round("score", 6).alias("score"))


@query("softmax_scores", NB_DOCS_SQL + """, sm AS (
  SELECT doc_id, cls, score - max(score) OVER (PARTITION BY doc_id) AS z FROM xscores
)
SELECT doc_id, cls AS class, round(exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id), 6) AS p FROM sm""")
def q_softmax_scores(spark, sf_dir):
    sc, classes = nb_documents(spark, sf_dir)
    cls = F.array(*[F.lit(c) for c in classes])
    return sc.select("doc_id", F.posexplode(M.softmax(F.col("scores"))).alias("_i", "p")).select(
        "doc_id", F.element_at(cls, F.col("_i") + 1).alias("class"), F.round("p", 6).alias("p"))


# --------------------------------------------------------------------------- #
# Evaluation on a deterministic imperfect predictor
# --------------------------------------------------------------------------- #
NOISY_SQL = """classes AS (
  SELECT DISTINCT lang AS cls FROM documents
), noisy AS (
  SELECT d.doc_id, d.lang AS y, c.cls AS class,
         round(0.3 * CAST(d.lang = c.cls AS INTEGER) + 0.7 * (CAST(('0x' || substr(md5(d.doc_id || ':' || c.cls), 1, 7)) AS BIGINT) / 268435456.0), 6) AS score
  FROM documents d CROSS JOIN classes c
), npred AS (
  SELECT doc_id, y, class AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS rn FROM noisy) WHERE rn = 1
)"""


def noisy_scores(spark, sf_dir):
    """score(doc, class) = 0.3·[lang = class] + 0.7·u(md5(doc:class)), 6 dp.
    Returns (doc_id, y, scores ARRAY, p) and the sorted class list."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("y"))
    classes = sorted(r[0] for r in d.select("y").distinct().collect())  # k rows

    def score(c):
        u = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":" + c))), 1, 7),
                   16, 10).cast("double") / 268435456.0
        return F.round(0.3 * (F.col("y") == F.lit(c)).cast("int") + 0.7 * u, 6)

    s = d.select("doc_id", "y", F.array(*[score(c) for c in classes]).alias("scores"))
    return M.predictions(s, classes), classes


@query("confusion_matrix", "WITH " + NOISY_SQL + ", " + O.eval_ctes("e", "npred", "classes") +
       "\nSELECT y, p, cnt FROM econf")
def q_confusion_matrix(spark, sf_dir):
    pred, classes = noisy_scores(spark, sf_dir)
    return E.confusion(pred, classes)


@query("per_class_report", "WITH " + NOISY_SQL + ", " + O.eval_ctes("e", "npred", "classes") + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM epcf""")
def q_per_class_report(spark, sf_dir):
    pred, classes = noisy_scores(spark, sf_dir)
    return E.report(E.confusion(pred, classes))


@query("classification_summary", "WITH " + NOISY_SQL + ", " + O.eval_ctes("e", "npred", "classes") +
       "\nSELECT metric, round(value, 6) AS value FROM esummary")
def q_classification_summary(spark, sf_dir):
    pred, classes = noisy_scores(spark, sf_dir)
    return E.summary(E.confusion(pred, classes))


CURVE_SQL = "WITH " + NOISY_SQL + ", " + O.curve_ctes("r", "noisy")


@query("roc_curve", CURVE_SQL + "\nSELECT class, score AS threshold, round(cn / nn, 6) AS fpr, round(cp / np, 6) AS tpr FROM rcum")
def q_roc_curve(spark, sf_dir):
    pred, classes = noisy_scores(spark, sf_dir)
    return E.roc_curve(E.long_scores(pred, ["doc_id"], classes))


@query("pr_curve", CURVE_SQL + """
SELECT class, score AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / np, 6) AS recall FROM rcum
UNION ALL SELECT class, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM rt""")
def q_pr_curve(spark, sf_dir):
    pred, classes = noisy_scores(spark, sf_dir)
    return E.pr_curve(E.long_scores(pred, ["doc_id"], classes))


@query("auc_ovr", CURVE_SQL + """
SELECT class, round(sum(neg * ((cp - pos) + pos / 2.0)) / (max(np) * max(nn)), 6) AS auc FROM rcum GROUP BY class""")
def q_auc_ovr(spark, sf_dir):
    pred, classes = noisy_scores(spark, sf_dir)
    return E.auc_ovr(E.long_scores(pred, ["doc_id"], classes))


# --------------------------------------------------------------------------- #
# NB on cued sentences, full vs masked text
# --------------------------------------------------------------------------- #
KEYS = ["doc_id", "sent_idx"]


def _nb_cued_sql(p: str, split_cte: str) -> str:
    return (f"{p}train AS (SELECT * FROM {split_cte} WHERE split <> 'test'), "
            f"{p}test AS (SELECT * FROM {split_cte} WHERE split = 'test'), " +
            O.tfidf_ctes(p, f"{p}train", split_cte, KEYS, "text", 2, True, 1, 0.9) + ", " +
            O.nb_ctes(p, f"{p}train", f"{p}test", KEYS, "label", "label_id") +
            f", {p}pred2 AS (SELECT t.label AS y, x.p FROM {p}pred x JOIN {p}test t ON x.doc_id = t.doc_id AND x.sent_idx = t.sent_idx), " +
            O.eval_ctes(p + "e", f"{p}pred2", "allcls"))


NB_CUED_SQL = ("WITH " + O.cte_cued() + ", " +
               O.split_ctes("c", "labeled", "label", O.key_md5(), "doc_id, sent_idx") +
               f", allcls AS (SELECT label AS cls FROM {LABEL_VALUES}), " + _nb_cued_sql("f", "csplit") +
               f", mcsplit AS (SELECT * REPLACE ({O.mask_sql('text')} AS text) FROM csplit), " +
               _nb_cued_sql("m", "mcsplit"))


def _metric_row(model: str, summary_cte: str) -> str:
    def m(name):
        return f"round(max(value) FILTER (WHERE metric = '{name}'), 6)"
    return (f"SELECT '{model}' AS model, {m('accuracy')} AS accuracy, {m('macro_f1_present')} AS macro_f1, "
            f"{m('weighted_f1')} AS weighted_f1 FROM {summary_cte}")


def nb_cued(spark, sf_dir, masked: bool, split=None):
    """Predictions for the test rows, and the model behind them."""
    sp = split if split is not None else cut_lineage(split_df(spark, sf_dir))
    if masked:
        sp = sp.withColumn("text", mask_expr(F.col("text")))
    classes = V.present_classes(sp.filter(F.col("split") != "test"), "label", list(LABELS))
    scores, nb = nb_on_split(sp, KEYS, "label", classes, F.col("split") == "test")
    return M.predictions(scores, classes), nb


def nb_cued_confusion(spark, sf_dir, masked: bool, split=None):
    """Confusion counts (k² rows), stored, so that the blocks and the model behind them can go."""
    pred, nb = nb_cued(spark, sf_dir, masked, split)
    conf = stored(E.confusion(pred, list(LABELS)), "confusion")
    nb.close()
    return conf


def _model_metrics(conf, model: str):
    s = E.summary(conf)
    wide = s.groupBy().pivot("metric", ["accuracy", "macro_f1_present", "weighted_f1"]).agg(F.first("value"))
    return wide.select(F.lit(model).alias("model"), "accuracy",
                       F.col("macro_f1_present").alias("macro_f1"), "weighted_f1")


@query("model_comparison", NB_CUED_SQL + "\n" + _metric_row("nb", "fesummary") + "\nUNION ALL " +
       _metric_row("nb_masked", "mesummary"))
def q_model_comparison(spark, sf_dir):
    sp = cut_lineage(split_df(spark, sf_dir))
    full = _model_metrics(nb_cued_confusion(spark, sf_dir, False, sp), "nb")
    masked = _model_metrics(nb_cued_confusion(spark, sf_dir, True, sp), "nb_masked")
    return full.unionByName(masked)


@query("ablation", NB_CUED_SQL + """
SELECT 'nb' AS model, round(f.value, 6) AS macro_f1_full, round(m.value, 6) AS macro_f1_masked,
       round(m.value - f.value, 6) AS delta
FROM fesummary f JOIN mesummary m ON f.metric = m.metric WHERE f.metric = 'macro_f1_present'""")
def q_ablation(spark, sf_dir):
    c = q_model_comparison(spark, sf_dir)
    f = c.filter(F.col("model") == "nb").select(F.col("macro_f1").alias("macro_f1_full"))
    m = c.filter(F.col("model") == "nb_masked").select(F.col("macro_f1").alias("macro_f1_masked"))
    return f.select(F.lit("nb").alias("model"), "macro_f1_full",
                    m.scalar().alias("macro_f1_masked")).withColumn(
        "delta", F.round(F.col("macro_f1_masked") - F.col("macro_f1_full"), 6))


@query("critical_miss", NB_CUED_SQL + """
SELECT y AS class, CAST(count(*) AS BIGINT) AS support, CAST(sum(CASE WHEN p = 'INFORMATIVE' THEN 1 ELSE 0 END) AS BIGINT) AS missed,
       round(sum(CASE WHEN p = 'INFORMATIVE' THEN 1 ELSE 0 END) / count(*), 6) AS miss_rate
FROM fpred2 WHERE y IN ('MANDATORY', 'PROHIBITED') GROUP BY y""")
def q_critical_miss(spark, sf_dir):
    return E.critical_miss(nb_cued(spark, sf_dir, False)[0])


# --------------------------------------------------------------------------- #
# Fitted models (M2, M7, W4, W5) — iterative solvers: rows-only checks; their
# optimality is a query of its own (``logreg_certificate``).
# --------------------------------------------------------------------------- #
from ..operators import linear as LIN  # noqa: E402
from ..operators import select as SEL  # noqa: E402

ROLES_KEYS = ["conv_id", "turn"]


def conversation_splits(spark, sf_dir):
    """conversations with y = role (class id by sorted role), split 70/10/20."""
    conv = table(spark, sf_dir, "conversations")
    roles = sorted(r[0] for r in conv.select("role").distinct().collect())  # k rows
    conv = conv.withColumn("label_id", (F.array_position(F.array(*[F.lit(x) for x in roles]),
                                                         F.col("role")) - 1).cast("int"))
    return cut_lineage(D.stratified_split(conv, ROLES_KEYS, "role")), roles


def _role_fit(spark, sf_dir, params=T.BASELINE):
    sp, roles = conversation_splits(spark, sf_dir)
    model = LIN.fit_linear(sp.filter(F.col("split") != "test"), ROLES_KEYS, LIN.Spec(params=params))
    return model, sp.filter(F.col("split") == "test"), roles


def role_predictions(model, test, roles):
    names = F.array(*[F.lit(x) for x in roles])
    return model.predict(test, ROLES_KEYS).select(
        *ROLES_KEYS, F.get(names, F.col("y")).alias("y"), F.get(names, F.col("p")).alias("p"),
        F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


@query("logreg_predictions")
def q_logreg_predictions(spark, sf_dir):
    return role_predictions(*_role_fit(spark, sf_dir))


@query("top_terms")
def q_top_terms(spark, sf_dir):
    model, _, roles = _role_fit(spark, sf_dir, T.IMPORTANCE)
    return model.term_weights(8, names=roles)


@query("bottom_terms")
def q_bottom_terms(spark, sf_dir):
    model, _, roles = _role_fit(spark, sf_dir, T.IMPORTANCE)
    return model.term_weights(8, smallest_abs=True, names=roles)


def embedding_run(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("label_id", F.col("label").cast("int"))
    sp = cut_lineage(D.stratified_split(e, ["vec_id"], "label_id"))
    return SEL.embedding_model(sp, ["vec_id"])


@query("embedding_model")
def q_embedding_model(spark, sf_dir):
    res = embedding_run(spark, sf_dir)
    return res["pred"].select("vec_id", "y", "p", F.lit(res["best_epoch"]).alias("best_epoch"))


@query("embedding_epochs")
def q_embedding_epochs(spark, sf_dir):
    """Loss and validation macro-F1 of every epoch, and which is restored."""
    res = embedding_run(spark, sf_dir)
    return res["states"].select("epoch", F.round("train_loss", 6).alias("train_loss"),
                                F.round("val_macro_f1", 6).alias("val_macro_f1"),
                                (F.col("epoch") == res["best_epoch"]).alias("best"))
