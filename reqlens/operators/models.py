"""Models (M1–M4, M7): multinomial Naive Bayes as aggregates, softmax and
arg-max as array expressions, and Spark ML estimators configured to optimise
the same objective as the reference's classifiers.

Every model emits the same shape, ``(keys, y, p, scores ARRAY<DOUBLE>)``, so
one evaluation path serves all of them.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tfidf import TfidfModel


def _bound(c: Column, f) -> Column:
    """``f`` of a value that is computed once per row, however often ``f`` and the lambdas in it refer to it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array column."""
    def shifted(s):
        return _bound(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m)))

    def shares(e):
        return _bound(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda tot: F.transform(e, lambda x: x / tot))

    return _bound(_bound(scores, shifted), shares)


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


# --------------------------------------------------------------------------- #
# Multinomial Naive Bayes (smoothing alpha, unsmoothed class prior)
# --------------------------------------------------------------------------- #


@dataclass
class NaiveBayesModel:
    classes: list          # class values in score order
    log_prob: DataFrame    # (term, lp_0 .. lp_{k-1})
    log_prior: list        # [Column] scalar subqueries

    def scores(self, weights: DataFrame, docs: DataFrame, key_cols: list[str]) -> DataFrame:
        """(keys, scores ARRAY<DOUBLE>) = Σ_t w·log p(t|c) + log prior(c).
        One join row per (doc, term) (the k log-probs ride along as columns);
        documents without known terms score the prior only."""
        k = len(self.classes)
        j = weights.join(self.log_prob, "term")
        sums = j.groupBy(*key_cols).agg(*[F.sum(F.col("weight") * F.col(f"lp_{i}")).alias(f"s_{i}")
                                          for i in range(k)])
        d = docs.select(*key_cols).join(sums, key_cols, "left")
        arr = F.array(*[F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) + self.log_prior[i] for i in range(k)])
        return d.select(*key_cols, arr.alias("scores"))


def nb_fit(weights: DataFrame, labels: DataFrame, key_cols: list[str], y_col: str,
           vocab: DataFrame, classes: list, alpha: float = 1.0) -> NaiveBayesModel:
    """Fit on long tf-idf ``weights`` (keys, term, weight) of training rows and
    their ``labels`` (keys, y).  ``classes`` are the class values present in
    training, in score order (a k-element list)."""
    k = len(classes)
    lab = labels.select(*key_cols, F.col(y_col).alias("_y"))
    fc = (weights.join(lab, key_cols).groupBy("term")
                 .pivot("_y", classes).agg(F.sum("weight")))
    # one row per vocabulary term, read twice (class totals, then log-probs)
    wide = stored(vocab.select("term").join(fc, "term", "left").select(
        "term", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"f_{i}") for i, c in enumerate(classes)]
    ), "class-terms")
    # k + 2 numbers (class totals, vocabulary size, class counts): collected once
    row = wide.agg(*[F.sum(f"f_{i}").alias(f"t_{i}") for i in range(k)],
                   F.count(F.lit(1)).alias("v")).first()
    v = float(row["v"])
    t = [float(row[f"t_{i}"] or 0.0) for i in range(k)]
    lp = wide.select("term", *[F.log((F.col(f"f_{i}") + alpha) / F.lit(t[i] + alpha * v)).alias(f"lp_{i}")
                               for i in range(k)])
    counts = {r[0]: int(r[1]) for r in lab.groupBy("_y").count().collect()}
    n = float(sum(counts.values()))
    prior = [F.lit(math.log(counts[c] / n)) for c in classes]
    return NaiveBayesModel(list(classes), lp, prior)


def predictions(scored: DataFrame, classes: list, truth: DataFrame | None = None,
                key_cols: list[str] | None = None, y_col: str = "y", round_dp: int | None = 6) -> DataFrame:
    """Add ``p`` (arg-max class value; scores rounded first so engines that
    sum in another order break ties alike) and, if given, the true ``y``."""
    cls = F.array(*[F.lit(c) for c in classes])
    s = F.col("scores")
    if round_dp is not None:
        s = F.transform(s, lambda x: F.round(x, round_dp))
    out = scored.withColumn("p", F.element_at(cls, argmax(s) + 1))
    if truth is not None:
        out = out.join(truth.select(*key_cols, F.col(y_col).alias("y")), key_cols)
    return out


# --------------------------------------------------------------------------- #
# Spark ML estimators with the reference objective
# --------------------------------------------------------------------------- #


def logreg(n_rows: int, C: float = 1.0, max_iter: int = 2000, tol: float = 1e-6,
           features: str = "features", label: str = "label_id", weight: str = "w") -> LogisticRegression:
    """Multinomial L2 logistic regression.  The library objective
    C·Σ w_i·loss_i + ½‖W‖² equals Spark's (1/Σw)·Σ w_i·loss_i + (λ/2)‖W‖² for
    λ = 1/(C·Σw); with balanced weights Σw = n.  Intercepts unpenalised, no
    standardisation."""
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight,
                              family="multinomial", regParam=1.0 / (C * n_rows), elasticNetParam=0.0,
                              standardization=False, maxIter=max_iter, tol=tol)


def linsvm(n_rows: int, C: float = 1.0, max_iter: int = 1000, features: str = "features",
           label: str = "label_id", weight: str = "w") -> OneVsRest:
    """One-vs-rest linear SVM (hinge loss; the reference library's default is
    squared hinge, so numbers are close, not equal)."""
    svc = LinearSVC(regParam=1.0 / (C * n_rows), maxIter=max_iter, standardization=False,
                    weightCol=weight)
    return OneVsRest(classifier=svc, featuresCol=features, labelCol=label, weightCol=weight)


def with_balanced_weights(df: DataFrame, label: str = "label_id", out: str = "w") -> DataFrame:
    """weight = n / (k_present · n_c) per row, from a k-row count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n = counts.agg(F.sum("_c").cast("double")).scalar()
    k = counts.agg(F.count(F.lit(1)).cast("double")).scalar()
    return df.join(F.broadcast(counts), label).withColumn(out, n / (k * F.col("_c"))).drop("_c")
