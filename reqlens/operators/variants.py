"""Naive Bayes over many training sets in one pass.

A *variant* is a training set: the complement of a fold, or one of the nested
samples of a learning curve.  A row carries the variants that train on it as
the bits of one number, so the rows are tokenised once.  A term carries one
document frequency, one idf and k class log-probabilities per variant as
arrays, so the joins on the term and the aggregates serve all variants at once;
no loop refits the model.

Rows lie in blocks of about BLOCK_CHARS characters.  A block numbers its own
terms, and its rows keep numbers and counts: only a block's distinct terms are
joined with the vocabulary or a model, never the (row, term) pairs.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..schema import CURVE_FRACTIONS, SEED
from ..session import drop, stored
from . import dataset as D
from . import models as M
from . import tfidf as T
from .rank import bucketed_prefix_sum, hash_key, hex_bucket

MAX_VARIANTS = 62  # bits of a BIGINT
BLOCK_CHARS = 8_000_000  # of text, so a task holds some million (row, term) pairs at once
LEAST_BLOCK_CHARS = 250_000


def variant_bits(conditions: list[Column]) -> Column:
    """The variants whose condition holds, as bits."""
    if len(conditions) > MAX_VARIANTS:
        raise ValueError(f"at most {MAX_VARIANTS} variants")
    bits = F.lit(0).cast("long")
    for v, c in enumerate(conditions):
        bits = bits + F.when(c, F.lit(1 << v)).otherwise(F.lit(0)).cast("long")
    return bits


def _bit(v: int) -> Column:
    return F.shiftright("_tr", v).bitwiseAND(F.lit(1).cast("long"))


def _limit(limit: int | float, n: int) -> float:
    return limit if isinstance(limit, int) else limit * n


# --------------------------------------------------------------------------- #
# Blocks of rows (inside a task)
# --------------------------------------------------------------------------- #


def _group_ids(t: pa.Table, cols: list[str]) -> np.ndarray:
    """The number of each row's group of equal values, nulls being equal."""
    ids = np.zeros(len(t), np.int64)
    for c in cols:
        codes = pa.chunked_array([t[c].combine_chunks()]).dictionary_encode("encode").combine_chunks()
        codes = pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.unique(ids * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1].astype(np.int64)
    return ids


def _lists(col) -> tuple[np.ndarray, pa.Array]:
    """(row of each entry, entries) of a list column; a null list has none."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(a)), sizes), a.flatten()


def _list_array(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of ``values``, which are ordered by row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _matrix(col, width: int, dtype) -> np.ndarray:
    """Rows of ``width`` numbers each; null entries become NaN or 0."""
    flat = _lists(col)[1]
    return flat.fill_null(math.nan if dtype is float else 0).to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def _ngram_codes(row: np.ndarray, tokens: pa.Array, ngram_range: tuple) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every n-gram occurrence, and the term of each code."""
    lo, hi = ngram_range
    words = pc.dictionary_encode(tokens)
    word, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.cast(pa.string())
    code, term, at = word, names, np.arange(len(word))
    rows, codes, terms, n_terms = [], [], [], 0
    for n in range(1, hi + 1):
        if n > 1:  # the words that follow an (n - 1)-gram in its row
            stay = at + n - 1 < len(word)
            stay[stay] = row[at[stay] + n - 1] == row[at[stay]]
            at, code = at[stay], code[stay]
            pair, code = np.unique(code * max(1, len(names)) + word[at + n - 1], return_inverse=True)
            head, tail = pair // max(1, len(names)), pair % max(1, len(names))
            term = pc.binary_join_element_wise(term.take(pa.array(head)), names.take(pa.array(tail)), " ")
        if n >= lo:
            rows.append(row[at])
            codes.append(code + n_terms)
            terms.append(term)
            n_terms += len(term)
    return np.concatenate(rows), np.concatenate(codes), pa.concat_arrays(terms)


def _tf_weights(tf: pa.Array, sublinear: bool) -> np.ndarray:
    tf = tf.to_numpy(zero_copy_only=False).astype(float)
    return np.log(tf) + 1.0 if sublinear else tf


def _sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(float)  # whole numbers without values


def _entries(bags: pa.Table, terms: pa.Table, p: T.TfidfParams, keys: list[str] = ()) -> tuple[np.ndarray, ...]:
    """(bag, row of its term in ``terms``, tf weight) of the entries whose term
    is there, for bags with all of ``keys``."""
    if not len(bags) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bag, ids = _lists(bags["ids"])
    ids, tf, code = ids.to_numpy(zero_copy_only=False), _lists(bags["tf"])[1], terms["code"].to_numpy()
    place = np.full(max(int(ids.max(initial=0)), int(code.max())) + 1, -1)
    place[code] = np.arange(len(code))
    at = place[ids]
    use = at >= 0
    for c in keys:
        use &= bags[c].is_valid().to_numpy()[bag]
    return bag[use], at[use], _tf_weights(tf, p.sublinear_tf)[use]


def encode_blocks(rows: DataFrame, keys: list[str], per_row: list[str], text_col: str, p: T.TfidfParams,
                  n_variants: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """Store the rows (``per_row``: keys, _tr and more; text) of ``chars``
    characters in blocks: a bag per text with its terms' codes and counts, and
    the term of each code with the number of its texts in every variant, and
    ``owns``, the variants that rows with it have in the column that follows _y
    and _tr (if any), as bits.  A text moves once; equal keys share a block."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(chars / BLOCK_CHARS), min(cores, math.ceil(chars / LEAST_BLOCK_CHARS)), 1)
    # texts move, not their tokens, which take more room
    d = rows.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).repartition("block")
    tok = T._tokens(d, ["block", *per_row], text_col, p)
    fields = [tok.schema[c] for c in per_row]
    schema = ST.StructType([
        ST.StructField("block", ST.IntegerType()), *[ST.StructField(f.name, f.dataType) for f in fields],
        *[ST.StructField(c, t) for c, t in (
            ("copies", ST.IntegerType()), ("ids", ST.ArrayType(ST.IntegerType())), ("tf", ST.ArrayType(ST.IntegerType())),
            ("code", ST.IntegerType()), ("term", ST.StringType()), ("d", ST.ArrayType(ST.IntegerType())),
            ("owns", ST.LongType()))]])

    def run(t: pa.Table) -> pa.Table:
        # texts of equal keys, label and variants count as one
        group = _group_ids(t, per_row)
        first, copies = np.unique(group, return_index=True, return_counts=True)[1:]
        row, tokens = _lists(t["_tok"])
        row, code, term = _ngram_codes(row, tokens, p.ngram_range)
        width = max(1, len(term))
        pairs, tf = np.unique(group[row] * width + code, return_counts=True)
        bag, code = pairs // width, pairs % width
        kept = t.select(per_row).take(pa.array(first))
        bits = kept["_tr"].to_numpy()
        owns = np.zeros(len(term), np.int64)
        for c in per_row[per_row.index("_tr") + 1:][:1]:
            own = kept[c].fill_null(-1).to_numpy()[bag]
            for v in np.unique(own[own >= 0]):
                owns[np.unique(code[own == v])] |= 1 << int(v)
        n = np.stack([np.bincount(code[((bits >> v) & 1).astype(bool)[bag]], minlength=len(term))
                      for v in range(n_variants)], axis=1)
        block = t["block"][0].as_py()
        rows = pa.table({"block": pa.array(np.full(len(first), block, np.int32)), **{c: kept[c] for c in per_row},
                         "copies": pa.array(copies.astype(np.int32)), "ids": _list_array(bag, code, len(first)),
                         "tf": _list_array(bag, tf, len(first))})
        terms = pa.table({"block": pa.array(np.full(len(term), block, np.int32)),
                          "code": pa.array(np.arange(len(term), dtype=np.int32)), "term": term,
                          "d": _list_array(np.repeat(np.arange(len(term)), n_variants), n.ravel(), len(term)),
                          "owns": pa.array(owns)})
        both = pa.concat_tables([rows, terms], promote_options="default")
        return both.select([f.name for f in schema.fields])

    both = stored(tok.groupBy("block").applyInArrow(run, schema), "term-bags")
    # the terms' block has a name of its own: both sides of a cogroup come from one table
    return both.filter("copies IS NOT NULL").select("block", *per_row, "copies", "ids", "tf"), both.filter("code IS NOT NULL").select(F.col("block").alias("home"), "code", "term", "d", "owns", (F.col("owns") != 0).alias("own"))


def tfidf_weights(df: DataFrame, keys: list[str], text_col: str, p: T.TfidfParams) -> tuple[T.TfidfModel, DataFrame]:
    """The model fitted on ``df`` and (keys, term, weight) of its rows; a row's
    norm and weights come from its block."""
    rows = df.select(*keys, F.lit(1).cast("long").alias("_tr"), text_col)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text_col)).alias("chars")).first()
    bags, terms = encode_blocks(rows, keys, [*keys, "_tr"], text_col, p, 1, int(size["chars"] or 0))
    model = T.fit_df(terms.groupBy("term").agg(F.sum(F.get("d", F.lit(0))).alias("df")), F.lit(float(size["n"])), p)
    model.vocab = stored(model.vocab, "vocab")
    used = terms.select("home", "code", "term").join(model.vocab.select("term", "idf"), "term")
    schema = ST.StructType([*[ST.StructField(c, bags.schema[c].dataType) for c in keys],
                            ST.StructField("term", ST.StringType()), ST.StructField("weight", ST.DoubleType())])

    def run(bags: pa.Table, terms: pa.Table) -> pa.Table:
        bag, at, tf = _entries(bags, terms, p)
        w = tf * terms["idf"].to_numpy()[at] if len(at) else tf
        norm = np.sqrt(np.bincount(bag, w * w, len(bags)))
        out = {c: bags[c].take(pa.array(bag)) for c in keys}
        return pa.table(out | {"term": terms["term"].cast(pa.string()).take(pa.array(at)), "weight": pa.array(w / norm[bag])})

    return model, bags.groupBy("block").cogroup(used.groupBy("home")).applyInArrow(run, schema)


class VariantNB:
    """Multinomial NB on TF-IDF for the variants of ``rows`` (keys, y, _tr,
    text).  Rows without a label take no part."""

    def __init__(self, rows: DataFrame, keys: list[str], y_col: str, classes: list, n_variants: int,
                 text_col: str = "text", params: T.TfidfParams = T.BASELINE, alpha: float = 1.0, also: tuple = ()):
        self.keys, self.classes, self.n_variants, self.params, self.alpha = keys, classes, n_variants, params, alpha
        self.also, self.models = list(also), []
        self.rows = rows.filter(F.col(y_col).isNotNull()).select(*keys, F.col(y_col).alias("_y"), "_tr", *self.also, text_col)
        self.per_row = [*keys, "_y", "_tr", *self.also]
        counts = {r["_y"]: r for r in self.rows.groupBy("_y").agg(
            *[F.sum(_bit(v)).alias(f"n{v}") for v in range(n_variants)], F.sum(F.length(text_col)).alias("chars")).collect()}  # k rows
        self.count = [[int(counts[c][f"n{v}"]) if c in counts else 0 for c in classes] for v in range(n_variants)]
        chars = sum(int(r["chars"] or 0) for r in counts.values())
        self.bags, self.terms = encode_blocks(self.rows, keys, self.per_row, text_col, params, n_variants, chars)

    def prior(self, v: int) -> list[float]:
        n = sum(self.count[v])
        return [math.log(c / n) if c else -math.inf for c in self.count[v]]

    def fit(self, variants: list[int], own: bool = False) -> DataFrame:
        """term, idf[i], lp[i][c] for the i-th of ``variants``; null where the
        term is not in that variant's vocabulary.  If rows are scored by their
        ``own`` variant only, terms that are in no such row's vocabulary are
        left out: their weights count, but stay in their blocks as a sum."""
        p, k, m = self.params, len(self.classes), len(variants)
        df = self.terms.groupBy("term").agg(*[F.sum(F.get("d", F.lit(v))).alias(f"d{v}") for v in variants],
                                            F.bit_or("owns").alias("owns"))

        def idf(v):
            n, d = sum(self.count[v]), F.col(f"d{v}")
            keep = (d >= max(1, _limit(p.min_df, n))) & (d <= _limit(p.max_df, n))
            return F.when(keep, F.log(F.lit(n + 1.0) / (d + 1.0)) + 1.0)

        scored = F.lit(not own)
        for i, v in enumerate(variants if own else []):
            scored = scored | (F.get("idf", F.lit(i)).isNotNull() & (F.shiftright("owns", v).bitwiseAND(F.lit(1).cast("long")) == 1))
        vocab = stored(df.select("term", F.array(*[idf(v) for v in variants]).alias("idf"), "owns").filter(
            F.exists("idf", lambda x: x.isNotNull())).select("term", "idf", scored.alias("scored")), "variant-vocab")
        size = vocab.agg(*[F.count(F.get("idf", F.lit(i))).alias(f"s{i}") for i in range(m)]).first()
        used = self.terms.filter(F.exists("d", lambda x: x > 0)).select("home", "code", "term").join(vocab, "term")
        keys, classes = self.keys, self.classes

        def run(bags: pa.Table, terms: pa.Table) -> pa.Table:
            """Per term of a block, the sum of tf / norm in each variant and class."""
            names = ["term", *[f"f{i}_{j}" for i in range(m) for j in range(k)]]
            if not len(bags) or not len(terms):
                return pa.table({c: pa.array([], pa.string() if c == "term" else pa.float64()) for c in names})
            bag, at, tf = _entries(bags, terms, p, keys)  # a row without a key has no norm
            idf = _matrix(terms["idf"], m, float)
            bits, y = bags["_tr"].to_numpy(), bags["_y"].to_pylist()
            group = _group_ids(bags, keys)
            y = np.array([classes.index(c) if c in classes else -1 for c in y], np.int64)
            out = {}
            for i, v in enumerate(variants):
                z = np.nan_to_num(tf * idf[at, i])
                norm = np.sqrt(np.bincount(group[bag], z * z, len(group)))[group][bag]
                mine = (((bits >> v) & 1) == 1)[bag] & (norm > 0)
                for j in range(k):
                    s = mine & (y[bag] == j)
                    out[f"f{i}_{j}"] = _sum_by(at[s], tf[s] / norm[s], len(terms))
            seen, scored = np.bincount(at, minlength=len(terms)) > 0, terms["scored"].to_numpy(zero_copy_only=False)
            t = pa.table({"term": terms["term"].cast(pa.string()), **{c: pa.array(x) for c, x in out.items()}}).select(names)
            # the others' weighted sums, as one row without a term
            rest = {c: [float((x * np.nan_to_num(idf[:, int(c[1:c.index("_")])]))[~scored].sum())] for c, x in out.items()}
            rest = pa.table({"term": pa.array([None], pa.string()), **rest}).select(names)
            return pa.concat_tables([t.filter(pa.array(seen & scored)), rest])

        cells = [f"f{i}_{j}" for i in range(m) for j in range(k)]
        part = self.bags.filter("_tr <> 0").groupBy("block").cogroup(used.groupBy("home")).applyInArrow(
            run, "term string, " + ", ".join(f"{c} double" for c in cells))
        sums = part.groupBy("term").agg(*[F.sum(c).alias(c) for c in cells])
        weighted = [(F.col(f"f{i}_{j}") * F.when(F.col("term").isNull(), 1.0).otherwise(
            F.get("idf", F.lit(i)))).alias(f"f{i}_{j}") for i in range(m) for j in range(k)]
        known = sums.join(vocab.filter("scored").select("term", "idf"), "term", "left")
        wide = stored(known.select("term", "idf", *weighted), "variant-terms")
        tot = wide.agg(*[F.sum(c).alias(f"t{c[1:]}") for c in cells]).first()

        def log_probs(i):
            den = [(tot[f"t{i}_{j}"] or 0.0) + self.alpha * size[f"s{i}"] for j in range(k)]
            lp = F.array(*[F.log((F.coalesce(F.col(f"f{i}_{j}"), F.lit(0.0)) + self.alpha) / F.lit(den[j]))
                           if den[j] > 0 else F.lit(0.0) for j in range(k)])
            return F.when(F.get("idf", F.lit(i)).isNotNull(), lp)

        model = stored(wide.filter("term IS NOT NULL").select("term", "idf", F.array(*[log_probs(i) for i in range(m)]).alias("lp")), "variant-model")
        drop(vocab)
        drop(wide)
        self.models.append(model)
        return model

    def forget(self) -> None:
        """Delete the models, once what they scored is stored."""
        while self.models:
            drop(self.models.pop())

    def close(self) -> None:
        """Delete models and blocks, once what they scored is stored."""
        self.forget()
        drop(self.bags)

    def _sums(self, bags: DataFrame, variants: list[int], own: str | None = None) -> DataFrame:
        """(y, per row, q<i>, s<i>_<j>) of every row of ``bags``, copies too: the
        squared norm and class sums under the i-th variant, or the one that
        column ``own`` gives (as q0, s0_<j>); null without a known term."""
        k, m, keys, per_row = len(self.classes), len(variants), self.keys, self.per_row
        p = self.params
        model = self.fit(variants, own is not None)
        needed = self.terms.filter("own") if own else self.terms
        used = needed.select("home", "code", "term").join(model, "term").select(
            "home", "code", "idf", F.flatten(F.transform("lp", lambda x: F.coalesce(
                x, F.array(*[F.lit(0.0)] * k)))).alias("lp"))
        width = 1 if own else m
        cells = [c for i in range(width) for c in (f"q{i}", *[f"s{i}_{j}" for j in range(k)])]
        schema = ST.StructType([*[ST.StructField(c, bags.schema[c].dataType) for c in per_row],
                                *[ST.StructField(c, ST.DoubleType()) for c in cells]])

        def run(bags: pa.Table, terms: pa.Table) -> pa.Table:
            bag, at, tf = _entries(bags, terms, p, keys)
            group = _group_ids(bags, keys)
            idf = _matrix(terms["idf"], m, float) if len(terms) else np.zeros((0, m))
            lp = _matrix(terms["lp"], m * k, float) if len(terms) else np.zeros((0, m * k))
            out = {}
            for i in range(width):
                which = bags[own].to_numpy().astype(np.int64)[bag] if own else i
                z = tf * idf[at, which]
                known = ~np.isnan(z)
                g, a, z = group[bag[known]], at[known], z[known]
                w = which[known] if own else i
                found = np.bincount(g, minlength=len(group)) > 0
                per = {f"q{i}": _sum_by(g, z * z, len(group))}
                per |= {f"s{i}_{j}": _sum_by(g, z * lp[a, w * k + j], len(group)) for j in range(k)}
                out |= {c: pa.array(x[group], mask=~found[group]) for c, x in per.items()}
            t = pa.table({**{c: bags[c] for c in per_row}, **out}).select([*per_row, *cells])
            return t.take(pa.array(np.repeat(np.arange(len(bags)), bags["copies"].to_numpy())))

        return bags.groupBy("block").cogroup(used.groupBy("home")).applyInArrow(run, schema)

    def _scored(self, q: str, s: str, prior: list[list[float]], i: Column) -> Column:
        priors = F.get(F.array(*[F.array(*[F.lit(x) for x in p]) for p in prior]), i)
        return F.array(*[F.coalesce(F.col(f"{s}{j}") / F.sqrt(q), F.lit(0.0)) + F.get(priors, F.lit(j))
                         for j in range(len(self.classes))])

    def score_own(self, variants: list[int], own: str) -> DataFrame:
        """(keys, y, variant, scores): each row under the variant that its
        column ``own`` gives (one of ``also``); rows without one are left out."""
        d = self._sums(self.bags.filter(F.col(own).isNotNull()), variants, own)
        scores = self._scored("q0", "s0_", [self.prior(v) for v in variants], F.col(own))
        return d.select(*self.keys, F.col("_y").alias("y"), F.col(own).alias("variant"), *self._rest(own),
                        scores.alias("scores"))

    def _rest(self, own: str | None = None) -> list[str]:
        return [c for c in self.also if c != own]

    def score_all(self, variants: list[int]) -> DataFrame:
        """(keys, y, _tr, variant, scores): each row under every variant."""
        d = self._sums(self.bags, variants)
        each = [F.struct(F.lit(v).alias("variant"), self._scored(
            f"q{i}", f"s{i}_", [self.prior(v)], F.lit(0)).alias("scores")) for i, v in enumerate(variants)]
        return d.select(*self.keys, F.col("_y").alias("y"), "_tr", *self._rest(), F.explode(F.array(*each)).alias("e")).select(
            *self.keys, "y", "_tr", *self._rest(), "e.variant", "e.scores")


def macro_f1_by(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, macro_f1): macro-F1 over the classes present in y or p, for each
    group of a (by, y, p) table."""
    cells = pred.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    roles = F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("s"), zero.alias("r"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("t")),
        F.struct(F.col("p").alias("c"), zero.alias("s"), F.col("n").alias("r"), zero.alias("t"))))
    per = cells.select(*by, roles.alias("x")).groupBy(*by, "x.c").agg(
        F.sum("x.s").alias("s"), F.sum("x.r").alias("r"), F.sum("x.t").alias("t"))
    f1 = 2.0 * F.col("t") / (F.col("s") + F.col("r"))
    return per.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def present_classes(rows: DataFrame, y_col: str, order: list | None = None) -> list:
    """Class values in score order (k values)."""
    seen = {r[0] for r in rows.select(y_col).distinct().collect() if r[0] is not None}
    return [c for c in order if c in seen] if order else sorted(seen)


def nb_cv_on_folds(folds: DataFrame, keys: list[str], y_col: str, classes: list, k: int, text_col: str = "text",
                   params: T.TfidfParams = T.BASELINE) -> DataFrame:
    """(candidate, fold, macro_f1): k-fold CV of Naive Bayes on rows with their
    ``fold``; the vocabulary, idf and class sums of every fold's complement
    come from one pass."""
    f = folds.withColumn("_tr", variant_bits([F.col("fold") != i for i in range(k)]))
    nb = VariantNB(f, keys, y_col, classes, k, text_col, params, also=("fold",))
    pred = M.predictions(nb.score_own(list(range(k)), "fold"), classes)
    scores = stored(macro_f1_by(pred, ["variant"]), "cv-scores")  # a row per fold
    nb.close()
    return scores.select(
        F.lit("nb").alias("candidate"), F.col("variant").alias("fold"), F.round("macro_f1", 6).alias("macro_f1"))


def nested_ranks(folds: DataFrame, keys: list[str], k: int, seed: int = SEED, hex_digits: int = 3) -> DataFrame:
    """Add ``_rank_i`` for each fold i: the 1-based place of a row in md5 order
    among the rows outside fold i (the training rows of i), from one running
    count per fold."""
    d = folds.withColumn("_h", hash_key(seed, *keys))
    for i in range(k):
        d = d.withColumn(f"_f{i}", (F.col("fold") == i).cast("long"))
    cols = [f"_f{i}" for i in range(k)]
    d = bucketed_prefix_sum(d, [], hex_bucket(F.col("_h"), hex_digits), ["_h", *keys], cols, n_buckets_bound=16 ** hex_digits)
    every = sum((F.col("cum_" + c) for c in cols[1:]), F.col("cum_" + cols[0]))
    for i, c in enumerate(cols):
        d = d.withColumn(f"_rank_{i}", every - F.col("cum_" + c))
    return d.drop("_h", *cols, *["cum_" + c for c in cols])


def nb_learning_curve(train: DataFrame, keys: list[str], y_col: str, classes: list, text_col: str = "text",
                      params: T.TfidfParams = T.IMPORTANCE, fractions=CURVE_FRACTIONS, k: int | None = None,
                      seed: int = SEED, fold_col: str = "label_id") -> DataFrame:
    """(size, fold, train_macro_f1, test_macro_f1): Naive Bayes trained on
    nested samples of each fold's training rows.  The sizes are fractions of
    the smallest training set, so all folds share them; a sample is the first
    rows in md5 order."""
    if k is None:
        k = D.n_folds_for({r[0]: int(r[1]) for r in train.groupBy(fold_col).count().collect()})
    f = stored(D.kfold_assign(train, keys, fold_col, k=k, seed=seed).select(*keys, y_col, "fold", text_col), "folds")
    n = {r["fold"]: int(r["count"]) for r in f.groupBy("fold").count().collect()}
    smallest = sum(n.values()) - max(n.values())
    sizes = [int(round(x * smallest, 9)) for x in fractions]
    ranked = nested_ranks(f, keys, k, seed)
    bits = variant_bits([(F.col("fold") != i) & (F.col(f"_rank_{i}") <= s) for i in range(k) for s in sizes])
    rows = stored(ranked.withColumn("_tr", bits).select(*keys, y_col, "fold", "_tr", text_col), "nested")
    drop(f)
    nb = VariantNB(rows, keys, y_col, classes, k * len(sizes), text_col, params, also=("fold",))
    drop(rows)
    out = None
    for i in range(k):  # each pass: the sizes of one fold
        ids = list(range(i * len(sizes), (i + 1) * len(sizes)))
        s = nb.score_all(ids)
        own = F.expr("shiftright(_tr, variant)").bitwiseAND(F.lit(1).cast("long")) == 1
        s = s.withColumn("part", F.when(F.col("fold") == i, "test").when(own, "train")).filter("part IS NOT NULL")
        m = stored(macro_f1_by(M.predictions(s, classes), ["variant", "part"]), "curve-scores")  # a few rows
        nb.forget()
        out = m if out is None else out.unionByName(m)
    nb.close()
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.col("variant") % len(sizes) + 1).cast("int"))
    score = {p: F.round(F.max(F.when(F.col("part") == p, F.col("macro_f1"))), 6).alias(f"{p}_macro_f1")
             for p in ("train", "test")}
    return (out.withColumn("fold", F.expr(f"variant div {len(sizes)}").cast("int")).withColumn("size", size.cast("long"))
            .groupBy("size", "fold").agg(score["train"], score["test"]))


def curve_summary(curve: DataFrame) -> DataFrame:
    """(size, train_mean, train_sd, test_mean, test_sd) over the folds."""
    return curve.groupBy("size").agg(*[
        F.round(f(f"{p}_macro_f1"), 6).alias(f"{p}_{name}")
        for p in ("train", "test") for name, f in (("mean", F.avg), ("sd", F.stddev_pop))])
