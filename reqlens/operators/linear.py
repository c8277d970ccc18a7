"""Linear classifiers on TF-IDF rows: multinomial logistic regression and the
one-vs-rest SVM with squared hinge (M2, M3, M5, M6, M8, V8, L2).

Every labelled row takes part in a fit.  ``termfit`` stores the rows by shards
of terms and fits on them: a fit of its own is shared by tasks that run
together, the fits of a sweep run side by side, those of one fold and feature
setting after each other along C, each starting from its neighbour.

Scoring joins (row, term) pairs with the model's term table, and the optimality
certificate recomputes the penalised gradient from those pairs.  No per-row
Python, no vectors.

Objectives, for row weights s, targets y and coefficients W (one column per
class; a single column for two classes):

* ``logreg``: C Σ s·cross-entropy + ½‖W‖², intercepts free; s balanced.
* ``linsvm``: C Σ s·max(0, 1 − y f)² + ½‖W‖², the intercept penalised like any
  other coefficient; in the column of class c its own rows have the balanced
  weight and all others 1, and with two classes both are balanced.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SEED
from ..session import drop, stored
from . import models as M
from . import termfit as TF
from . import tfidf as T
from .rank import bucketed_rank, hash_key, hex_bucket
from .termfit import NoFit

TOLERANCE = 1e-6  # of the gradient's largest entry, per training row
ENTRIES_AT_ONCE = 1 << 18
TASK_ENTRIES = 1_000_000  # (row, term) pairs that are worth a further task of a fit


@dataclass(frozen=True)
class Spec:
    """One fit: model, regularisation and features."""

    point: int = 0
    model: str = "logreg"
    C: float = 1.0
    params: T.TfidfParams = T.BASELINE

    @property
    def features(self) -> tuple:
        p = self.params
        return p.ngram_range, p.sublinear_tf, p.min_df, p.max_df


# --------------------------------------------------------------------------- #
# Sparse rows in memory and a solver for them, which termfit's is held against
# --------------------------------------------------------------------------- #


@dataclass
class Sparse:
    """Rows by their offsets, columns and values."""

    offsets: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.offsets))

    def _parts(self):
        """(segments, their sizes, columns, values) of ENTRIES_AT_ONCE entries,
        which stay in the cache; a larger row goes alone."""
        full, at = np.flatnonzero(self.offsets[1:] > self.offsets[:-1]), 0
        ends = self.offsets[full + 1]
        while at < len(full):
            lo = self.offsets[full[at]]
            to = max(at + 1, int(np.searchsorted(ends, lo + ENTRIES_AT_ONCE, "right")))
            own, part = full[at:to], slice(lo, ends[to - 1])
            yield own, self.offsets[own + 1] - self.offsets[own], self.cols[part].astype(np.intp), self.vals[part]
            at = to

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = np.zeros((w.shape[1], len(self))), np.ascontiguousarray(w.T)
        for own, sizes, cols, vals in self._parts():
            starts = np.cumsum(sizes) - sizes
            for c in range(len(w)):
                out[c, own] = np.add.reduceat(w[c].take(cols) * vals, starts)
        return np.ascontiguousarray(out.T)

    def transposed(self) -> Sparse:
        """The columns as rows, so that a product with them reads its entries in order."""
        order = np.argsort(self.cols, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Sparse(offsets, self.row_of[order], self.vals[order], len(self))

    def take(self, mask: np.ndarray) -> Sparse:
        sizes = np.diff(self.offsets)
        keep = np.repeat(mask, sizes)
        return Sparse(np.concatenate([[0], np.cumsum(sizes[mask])]), self.cols[keep], self.vals[keep], self.width)


@dataclass
class Folded:
    """Rows whose terms of a single row are folded into one column per row.

    A penalised fit only sees inner products of rows, so the terms that occur
    in one row alone can be turned into one column with their norm: the fit is
    the same, and ``unfold`` gives the terms' own coefficients back.  ``peak``
    and ``mass`` are the largest and the summed share of a term in its column,
    so that norms of a gradient are those over the terms.
    """

    x: Sparse
    column: np.ndarray  # of each term
    share: np.ndarray
    peak: np.ndarray
    mass: np.ndarray

    def unfold(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([w[self.column] * self.share[:, None], w[-1:]])

    def fold(self, w: np.ndarray) -> np.ndarray:
        out = [np.bincount(self.column, w[:-1, c] * self.share, self.x.width) for c in range(w.shape[1])]
        return np.concatenate([np.stack(out, axis=1), w[-1:]])


def folded(x: Sparse) -> Folded:
    df = np.bincount(x.cols, minlength=x.width)
    single = df == 1
    lone, row_of = single[x.cols], x.row_of
    norm = np.sqrt(np.bincount(row_of[lone], x.vals[lone] ** 2, len(x)))
    with_lone = norm > 0
    shared = np.flatnonzero(~single)
    shared = shared[np.argsort(-df[shared], kind="stable")]  # frequent ones side by side
    width = len(shared) + int(with_lone.sum())
    column, share = np.empty(x.width, np.int32), np.ones(x.width)
    column[shared] = np.arange(len(shared))
    of_row = np.cumsum(with_lone) - 1 + len(shared)
    column[x.cols[lone]] = of_row[row_of[lone]]
    share[x.cols[lone]] = x.vals[lone] / norm[row_of[lone]]
    peak, mass = np.ones(width), np.bincount(column, share, width)
    np.maximum.at(peak_of := np.zeros(width), column, share)
    peak[len(shared):] = peak_of[len(shared):]
    # each row: its shared terms, then its own column
    sizes = np.bincount(row_of[~lone], minlength=len(x))
    offsets = np.concatenate([[0], np.cumsum(sizes + with_lone)])
    cols, vals = np.empty(offsets[-1], np.int32), np.empty(offsets[-1])
    last = offsets[1:][with_lone] - 1
    inner = np.ones(offsets[-1], bool)
    inner[last] = False
    cols[inner], vals[inner] = column[x.cols[~lone]], x.vals[~lone]
    cols[last], vals[last] = of_row[with_lone], norm[with_lone]
    return Folded(Sparse(offsets, cols, vals, width), column, share, peak, mass)


def balanced(y: np.ndarray, k: int) -> np.ndarray:
    return len(y) / (k * np.bincount(y, minlength=k))


def objective(x: Sparse, y: np.ndarray, k: int, model: str, C: float) -> tuple[Callable, int, int]:
    """(value and gradient of flat coefficients, columns, coefficients in a
    column); the last row of a column is its intercept."""
    cols, height = (1 if k == 2 else k), x.width + 1
    s, by_column = balanced(y, k), x.transposed()
    sign = np.where(y[:, None] == (np.arange(k) if k > 2 else 1), 1.0, -1.0)
    row_weight = np.repeat(s[y][:, None], cols, axis=1)
    if model == "linsvm" and k > 2:
        row_weight = np.where(sign > 0, row_weight, 1.0)

    def run(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(height, cols)
        f = x.dot(w[:-1]) + w[-1]
        if model == "linsvm":
            slack = np.maximum(0.0, 1.0 - sign * f)
            loss, r = float((row_weight * slack * slack).sum()), -2.0 * row_weight * slack * sign
        elif k == 2:
            loss, r = float((row_weight * np.logaddexp(0.0, -sign * f)).sum()), -row_weight * sign / (1.0 + np.exp(sign * f))
        else:
            top = f.max(axis=1, keepdims=True)
            e = np.exp(f - top)
            total = e.sum(axis=1, keepdims=True)
            own = np.take_along_axis(f, y[:, None], axis=1)
            loss = float((s[y] * (np.log(total) + top - own)[:, 0]).sum())
            r = s[y][:, None] * (e / total - (sign > 0))
        penalised = w.copy()
        if model == "logreg":
            penalised[-1] = 0.0
        grad = np.concatenate([by_column.dot(r), r.sum(axis=0)[None]]) + penalised / C
        return loss + 0.5 / C * float((penalised * penalised).sum()), grad.ravel()

    return run, cols, height


def minimise(f: Callable, x: np.ndarray, tolerance: float, max_iter: int = 2000, memory: int = 10,
             peak: np.ndarray | float = 1.0, mass: np.ndarray | float = 1.0) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search.  An entry of ``x``
    may stand for several: ``peak`` and ``mass`` are its factors in the largest
    entry and in the sum of the gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if (np.abs(grad) * peak).max() <= tolerance:
            break
        d, kept = -grad, []
        for s, t, rho in reversed(pairs):
            a = rho * s.dot(d)
            d = d - a * t
            kept.append(a)
        if pairs:
            s, t, rho = pairs[-1]
            d = d / (rho * t.dot(t))
        for (s, t, rho), a in zip(pairs, reversed(kept), strict=True):
            d = d + (a - rho * t.dot(d)) * s
        slope = grad.dot(d)
        if slope >= 0:
            pairs, d, slope = [], -grad, -grad.dot(grad)
        step = 1.0 if pairs else min(1.0, 1.0 / (np.abs(grad) * mass).sum())
        while True:
            new = x + step * d
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, t = new - x, new_grad - grad
        if step < 1e-12:
            if not pairs:
                break
            pairs = []
            continue
        if s.dot(t) > 1e-12 * t.dot(t):
            pairs = [*pairs[-memory + 1:], (s, t, 1.0 / s.dot(t))]
        x, value, grad = new, new_value, new_grad
    return x


def fit_coefficients(x: Sparse | Folded, y: np.ndarray, spec: Spec, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (terms + 1, columns), the intercepts last."""
    k = int(y.max()) + 1
    if k < 2:
        raise NoFit("a linear model needs rows of two classes")
    d = x if isinstance(x, Folded) else folded(x)
    f, cols, height = objective(d.x, y, k, spec.model, spec.C)
    at = np.zeros(cols * height) if start is None else d.fold(start).ravel()
    peak, mass = (np.repeat(np.append(v, 1.0), cols) for v in (d.peak, d.mass))
    return d.unfold(minimise(f, at, TOLERANCE * len(y), peak=peak, mass=mass).reshape(height, cols))


# --------------------------------------------------------------------------- #
# Rows for fitting
# --------------------------------------------------------------------------- #


def first_rows(df: DataFrame, keys: list[str], limit: int | None, seed: int = SEED) -> DataFrame:
    """``df``, or its first ``limit`` rows in md5 order if a limit is asked for and it has more."""
    if limit is None or df.count() <= limit:
        return df
    h = df.withColumn("_h", hash_key(seed, *keys))
    return bucketed_rank(h, [], hex_bucket(F.col("_h")), ["_h", *keys], "_r").filter(F.col("_r") <= limit).drop("_h", "_r")


def fit_rows(df: DataFrame, keys: list[str], y_col: str = "label_id", text_col: str = "text",
             params: T.TfidfParams = T.BASELINE, also: tuple = (), limit: int | None = None) -> TF.Store:
    """Rows without a label are left out; texts without terms stay as empty rows."""
    d = first_rows(df.filter(F.col(y_col).isNotNull()).select(
        *keys, F.col(y_col).cast("int").alias("y"), *also, text_col), keys, limit)
    texts = stored(d, "fit-texts")
    data = TF.build(texts, keys, list(also), text_col, params)
    drop(texts)
    return data


# --------------------------------------------------------------------------- #
# Sweeps: many fits over folds and grid points
# --------------------------------------------------------------------------- #

CELLS = pa.schema([("point", pa.int32()), ("fold", pa.int32()), ("vocab_size", pa.int64()), ("y", pa.int32()),
                   ("p", pa.int32()), ("n", pa.int64())])
CELLS_SQL = "point int, fold int, vocab_size long, y int, p int, n long"


def _fitted(x: TF.Design, y: np.ndarray, train: np.ndarray, spec: Spec, start=None) -> tuple:
    """(predictions of all rows, coefficients and margins) of a fit on the rows ``train``."""
    classes = np.unique(y[train])
    if len(classes) < 2:
        raise NoFit("a linear model needs rows of two classes")
    local = np.searchsorted(classes, y).clip(0, len(classes) - 1)
    w, f = TF.fit(x, local, train, len(classes), spec.model, spec.C, TOLERANCE * int(train.sum()), start)
    return classes[f.argmax(axis=0) if len(classes) > 2 else (f[0] > 0).astype(int)], (w, f)


def _cells(point: int, fold: int, size: int, y: np.ndarray, p: np.ndarray) -> list[tuple]:
    cells, n = np.unique(np.stack([y, p], axis=1), axis=0, return_counts=True)
    return [(point, fold, size, int(a), int(b), int(c)) for (a, b), c in zip(cells, n, strict=True)]


def _cell_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(CELLS.names, r, strict=True)) for r in rows], schema=CELLS)


def sweep(data: TF.Store, specs: list[Spec], k: int) -> DataFrame:
    """(point, fold, vocab_size, y, p, n): the confusion counts of every spec on
    every fold (a column of ``data.rows``), fitted on the other folds; a fit
    that is not possible has one row with null y, p and n.

    A task has the fits of one fold, feature setting and model, along C.
    """
    chains = {}
    for s in sorted(specs, key=lambda s: s.C):
        chains.setdefault((s.features, s.model), []).append(s)
    chains, path, rows_path, n, shards = list(chains.values()), data.shards_path, data.rows_path, data.n, data.shards

    def run(i: int) -> pa.RecordBatch:
        fold, chain = divmod(i, len(chains))
        rows = TF.read_rows(rows_path, n, ["y", "fold"])
        y, held, out, start, x, size = rows["y"], rows["fold"] == fold, [], None, None, 0
        for spec in chains[chain]:
            try:
                if x is None:
                    x = TF.Design(TF.Shards(path, list(range(shards))), ~held, spec.params, TF.Alone())
                    size = x.size
                p, start = _fitted(x, y, ~held, spec, start)
                out += _cells(spec.point, fold, size, y[held], p[held])
            except NoFit:
                out.append((spec.point, fold, size, None, None, None))
        return _cell_rows(out)

    return TF.run_apart(data.rows.sparkSession, k * len(chains), run, CELLS_SQL)


def curve_sweep(data: TF.Store, spec: Spec, k: int, sizes: list[int]) -> DataFrame:
    """(point, fold, vocab_size, y, p, n) as ``sweep``, where point 2j is the
    model of the j-th size on its own training rows and 2j + 1 on the fold.  The
    rows have ``fold`` and ``ranks``, their place among each fold's training
    rows; a model is fitted on the rows up to its size."""
    path, rows_path, n, shards = data.shards_path, data.rows_path, data.n, data.shards

    def run(i: int) -> pa.RecordBatch:
        fold, j = divmod(i, len(sizes))
        rows = TF.read_rows(rows_path, n, ["y", "fold", "ranks"])
        y, test, out, size = rows["y"], rows["fold"] == fold, [], 0
        train = ~test & (rows["ranks"].reshape(n, -1)[:, fold] <= sizes[j])
        try:
            x = TF.Design(TF.Shards(path, list(range(shards))), train, spec.params, TF.Alone())
            size = x.size
            p, _ = _fitted(x, y, train, spec)
            for point, part in ((2 * j, train), (2 * j + 1, test)):
                out += _cells(point, fold, size, y[part], p[part])
        except NoFit:
            out = [(point, fold, size, None, None, None) for point in (2 * j, 2 * j + 1)]
        return _cell_rows(out)

    return TF.run_apart(data.rows.sparkSession, k * len(sizes), run, CELLS_SQL)


def fold_scores(counts: DataFrame) -> DataFrame:
    """(point, fold, vocab_size, macro_f1) of a sweep; NaN where no model could
    be fitted."""
    one = F.lit(1).cast("long")
    roles = F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("s"), (F.col("n") * 0).alias("r"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(one * 0).alias("t")),
        F.struct(F.col("p").alias("c"), (F.col("n") * 0).alias("s"), F.col("n").alias("r"), (F.col("n") * 0).alias("t"))))
    per = counts.select("point", "fold", "vocab_size", roles.alias("x")).groupBy(
        "point", "fold", "vocab_size", "x.c").agg(*[F.sum(f"x.{c}").alias(c) for c in "srt"])
    f1 = F.when(F.col("c").isNull(), F.lit(math.nan)).otherwise(2.0 * F.col("t") / (F.col("s") + F.col("r")))
    return per.groupBy("point", "fold", "vocab_size").agg(F.avg(f1).alias("macro_f1"))


def ranked_points(scores: DataFrame) -> DataFrame:
    """(point, cv_macro_f1, rank): mean over the folds, best first, the lower
    point first among equals, NaN last."""
    from pyspark.sql import Window
    s = scores.groupBy("point").agg(F.avg("macro_f1").alias("cv_macro_f1"))
    # one row per point: a grid has a few dozen
    w = Window.orderBy(F.nanvl("cv_macro_f1", F.lit(-1.0)).desc(), "point")
    return s.withColumn("rank", F.row_number().over(w))


# --------------------------------------------------------------------------- #
# One model: coefficients by term, scoring and certificate over all rows
# --------------------------------------------------------------------------- #


@dataclass
class LinearModel:
    """``terms``: term, idf, coef[column]; the rest are a few numbers."""

    terms: DataFrame
    intercept: list[float]
    classes: list[int]
    spec: Spec
    n_rows: int
    class_rows: list[int]

    @property
    def vocab_size(self) -> int:
        return self.terms.count()

    def _pairs(self, df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
        tf = T.term_freq(df.repartition(*keys), keys, text_col, self.spec.params)
        return tf.join(self.terms, "term").withColumn("z", F.col("tf_w") * F.col("idf"))

    def margins(self, df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
        """(keys, norm, margins): one margin per column, from one join on the
        term and one aggregate by row, which gives the norm as well."""
        cols = range(len(self.intercept))
        x = self._pairs(df, keys, text_col).groupBy(*keys).agg(
            F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"),
            *[F.sum(F.col("z") * F.get("coef", F.lit(c))).alias(f"m{c}") for c in cols])
        return df.select(*keys).join(x, keys, "left").select(*keys, "norm", F.array(*[
            F.coalesce(F.col(f"m{c}") / F.col("norm"), F.lit(0.0)) + F.lit(self.intercept[c]) for c in cols]).alias("margins"))

    def scores(self, df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
        """(keys, scores): probabilities (logreg) or the softmax of the margins."""
        m = self.margins(df, keys, text_col)
        return m.select(*keys, class_scores(F.col("margins"), self.spec.model, len(self.classes)).alias("scores"))

    def predict(self, df: DataFrame, keys: list[str], y_col: str = "label_id", text_col: str = "text") -> DataFrame:
        """(keys, scores, p, y) for rows whose label is known or not."""
        s = self.scores(df, keys, text_col)
        pred = M.predictions(s, self.classes, round_dp=None)
        return pred.join(df.select(*keys, F.col(y_col).cast("int").alias("y")), keys)

    def gradient(self, df: DataFrame, keys: list[str], y_col: str = "label_id", text_col: str = "text") -> DataFrame:
        """(column, term, gradient) of the penalised objective at these
        coefficients over the training rows ``df``; the intercept's term is
        null.  Recomputed from (row, term) pairs, apart from the solver."""
        k, cols, svm = len(self.classes), range(len(self.intercept)), self.spec.model == "linsvm"
        at = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(y_col).cast("int")) - 1
        rows = self.margins(df, keys, text_col).join(df.select(*keys, at.alias("_y")), keys)
        weight = F.get(F.array(*[F.lit(self.n_rows / (k * c)) for c in self.class_rows]), F.col("_y").cast("int"))
        e = M.softmax(F.col("margins"))

        def residual(c):
            own = F.col("_y") == F.lit(c if k > 2 else 1)
            m = F.get("margins", F.lit(c))
            sign = F.when(own, 1.0).otherwise(-1.0)
            if svm:
                s = F.when(own, weight).otherwise(F.lit(1.0)) if k > 2 else weight
                return -2.0 * s * F.greatest(F.lit(0.0), 1.0 - sign * m) * sign
            if k == 2:
                return -weight * sign / (1.0 + F.exp(sign * m))
            return weight * (F.get(e, F.lit(c)) - own.cast("double"))

        r = rows.select(*keys, "norm", F.array(*[residual(c) for c in cols]).alias("r"))
        inv = 1.0 / self.spec.C
        x = self._pairs(df, keys, text_col).select(*keys, "term", "z").join(r, keys)
        g = x.groupBy("term").agg(F.array(*[F.sum(F.col("z") / F.col("norm") * F.get("r", F.lit(c))) for c in cols]).alias("g"))
        by_term = self.terms.join(g, "term", "left").select("term", F.posexplode(F.array(*[
            F.coalesce(F.get("g", F.lit(c)), F.lit(0.0)) + F.get("coef", F.lit(c)) * inv for c in cols])).alias("column", "gradient"))
        bias = r.agg(F.array(*[F.sum(F.get("r", F.lit(c))) + F.lit(self.intercept[c] * inv if svm else 0.0)
                               for c in cols]).alias("g")).select(
            F.lit(None).cast("string").alias("term"), F.posexplode("g").alias("column", "gradient"))
        return by_term.unionByName(bias).select("column", "term", "gradient")

    def term_weights(self, n: int = 8, smallest_abs: bool = False, names: list | None = None) -> DataFrame:
        """(class, rank, term, weight): the n greatest weights of each class
        (ties by term), or the n smallest by absolute value.  Two classes share
        a column, whose negative is the first class's.  Each class is a sort
        with a limit, so no task holds all its terms."""
        k, out = len(self.classes), None
        for c, cls in enumerate(self.classes):
            w = F.get("coef", F.lit(c)) if k > 2 else F.get("coef", F.lit(0)) * (1.0 if c else -1.0)
            rows = self.terms.select("term", w.alias("weight"))
            order = [F.abs("weight").asc(), "term"] if smallest_abs else [F.col("weight").desc(), "term"]
            top = rows.orderBy(*order).limit(n).withColumn("class", F.lit(names[cls] if names else str(cls)))
            out = top if out is None else out.unionByName(top)
        from pyspark.sql import Window
        key = F.abs("weight").asc() if smallest_abs else F.col("weight").desc()
        rank = F.row_number().over(Window.partitionBy("class").orderBy(key, "term"))  # n rows a class
        return out.select("class", rank.alias("rank"), "term", F.round("weight", 6).alias("weight"))

    # -- S9: a manifest and a term table, loadable without the training rows
    def save(self, path: str) -> None:
        spark, p = self.terms.sparkSession, self.spec.params
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        manifest = [(self.spec.model, float(self.spec.C), *p.ngram_range, str(p.min_df), str(p.max_df), p.sublinear_tf,
                     p.lowercase, p.strip_accents, [float(x) for x in self.intercept], [int(c) for c in self.classes],
                     int(self.n_rows), [int(c) for c in self.class_rows])]
        spark.createDataFrame(manifest, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        m = spark.read.parquet(f"{path}/manifest").first()

        def limit(x):
            return float(x) if "." in x else int(x)

        p = T.TfidfParams((m["n_lo"], m["n_hi"]), limit(m["min_df"]), limit(m["max_df"]), m["sublinear"], m["lowercase"],
                          m["strip_accents"])
        return LinearModel(spark.read.parquet(f"{path}/terms"), list(m["intercept"]), list(m["classes"]),
                           Spec(0, m["model"], m["C"], p), m["n_rows"], list(m["class_rows"]))


MANIFEST_SCHEMA = ("model string, C double, n_lo int, n_hi int, min_df string, max_df string, sublinear boolean, "
                   "lowercase boolean, strip_accents boolean, intercept array<double>, classes array<int>, n_rows long, "
                   "class_rows array<long>")


def class_scores(margin: Column, model: str, k: int) -> Column:
    """Scores per class from margins per column.  Two classes share a column:
    its margin m stands for (−m, m), and the logistic probability of the
    second class is that of m itself."""
    if k > 2:
        return M.softmax(margin)
    m = F.get(margin, F.lit(0))
    if model == "logreg":
        p = 1.0 / (1.0 + F.exp(-m))
        return F.array(1.0 - p, p)
    return M.softmax(F.array(-m, m))


def fit_linear(df: DataFrame, keys: list[str], spec: Spec = Spec(), y_col: str = "label_id", text_col: str = "text",
               limit: int | None = None) -> LinearModel:
    """One model on all rows of ``df`` (the first ``limit`` if given), fitted by tasks that run together."""
    spark, data = df.sparkSession, fit_rows(df, keys, y_col, text_col, spec.params, limit=limit)
    counts = {int(r["y"]): int(r["count"]) for r in data.rows.groupBy("y").count().collect()}  # k rows
    classes = sorted(counts)
    if len(classes) < 2:
        raise NoFit("a linear model needs rows of two classes")
    tasks = min(spark.sparkContext.defaultParallelism, max(1, int(data.entries / TASK_ENTRIES)), data.shards)
    path, rows_path, n, shards = data.shards_path, data.rows_path, data.n, data.shards

    def run(group):
        y, everything = TF.read_rows(rows_path, n, ["y"])["y"], np.ones(n, bool)
        x = TF.Design(TF.Shards(path, list(range(group.rank, shards, group.ranks))), everything, spec.params, group)
        w = _fitted(x, y, everything, spec)[1][0]

        def batch(terms, idf, coef):
            flat = pa.ListArray.from_arrays(np.arange(0, coef.size + 1, coef.shape[1], dtype=np.int32), pa.array(coef.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(idf), flat], names=["term", "idf", "coef"])

        if group.rank == 0:
            yield batch([None], np.zeros(1), w[:, -1][None])
        for terms, idf, coef in x.coefficients(w):
            for at in range(0, len(terms), 1 << 16):
                yield batch(*(v[at:at + (1 << 16)] for v in (terms, idf, coef)))

    fitted = TF.run_together(spark, tasks, run, "term string, idf double, coef array<double>", f"{path}-exchange")
    intercept = list(fitted.filter("term IS NULL").first()["coef"])
    terms = fitted.filter("term IS NOT NULL")
    return LinearModel(terms, intercept, classes, spec, sum(counts.values()), [counts[c] for c in classes])
