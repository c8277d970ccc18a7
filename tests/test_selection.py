"""Cross-validation, grid search, learning curves and linear models against
small dense or row-by-row versions."""
import hashlib
import inspect
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqlens.operators import dataset as D
from reqlens.operators import epochs as EP
from reqlens.operators import linear as L
from reqlens.operators import select as S
from reqlens.operators import termfit as TF
from reqlens.operators import tfidf as T
from reqlens.operators import variants as V

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def corpus(n, k, seed=1, noise=0.3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        y = min(rnd.randrange(k + 2), k - 1)
        own = WORDS[2 * y: 2 * y + 3]
        words = [rnd.choice(WORDS if rnd.random() < noise else own) for _ in range(rnd.randint(1, 9))]
        out.append((i, y, " ".join(words)))
    out[0] = (0, out[0][1], "")
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label_id int, text string").repartition(3)


def grams(text, params):
    w = text.split()
    lo, hi = params.ngram_range
    return Counter(" ".join(w[i:i + g]) for g in range(lo, hi + 1) for i in range(len(w) - g + 1))


class Dense:
    """TF-IDF as a dense matrix, fitted on ``train``."""

    def __init__(self, train, params):
        self.params = params
        counts = [grams(t, params) for t in train]
        df = Counter(w for c in counts for w in c)
        n = len(train)

        def limit(x):
            return x if isinstance(x, int) else x * n

        self.terms = sorted(w for w, d in df.items() if max(1, limit(params.min_df)) <= d <= limit(params.max_df))
        self.idf = np.array([math.log((n + 1) / (df[w] + 1)) + 1 for w in self.terms])

    def __call__(self, texts):
        out = np.zeros((len(texts), len(self.terms)))
        for i, t in enumerate(texts):
            c = grams(t, self.params)
            for j, w in enumerate(self.terms):
                out[i, j] = (1 + math.log(c[w]) if self.params.sublinear_tf else c[w]) if c[w] else 0.0
        out *= self.idf
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def dense_nb(xtr, ytr, x):
    classes = sorted(set(ytr))
    f = np.array([xtr[np.array(ytr) == c].sum(axis=0) for c in classes])
    lp = np.log((f + 1) / (f.sum(axis=1, keepdims=True) + xtr.shape[1]))
    s = np.round(x @ lp.T + np.log([ytr.count(c) / len(ytr) for c in classes]), 6)
    return [classes[i] for i in s.argmax(axis=1)]


def f1(y, p):
    out = []
    for c in set(y) | set(p):
        t = sum(a == b == c for a, b in zip(y, p, strict=True))
        out.append(2 * t / (y.count(c) + p.count(c)))
    return sum(out) / len(out)


def dense_linear(x, y, model, C, k):
    """Plain gradient descent with a shrinking step to a small gradient."""
    n = len(y)
    y = np.array(y)
    cols = 1 if k == 2 else k
    sign = np.where(y[:, None] == (np.arange(k) if k > 2 else 1), 1.0, -1.0)
    s = (n / (k * np.bincount(y, minlength=k)))[y][:, None]
    sw = np.where(sign > 0, s, 1.0) if model == "linsvm" and k > 2 else np.repeat(s, cols, axis=1)
    xb = np.hstack([x, np.ones((n, 1))])
    w = np.zeros((xb.shape[1], cols))

    def value(w):
        f, free = xb @ w, w.copy()
        if model == "logreg":
            free[-1] = 0
        if model == "linsvm":
            h = np.maximum(0, 1 - sign * f)
            return (sw * h * h).sum() + (free ** 2).sum() / (2 * C), xb.T @ (-2 * sw * h * sign) + free / C
        if k == 2:
            return (sw * np.logaddexp(0, -sign * f)).sum() + (free ** 2).sum() / (2 * C), \
                xb.T @ (-sw * sign / (1 + np.exp(sign * f))) + free / C
        e = np.exp(f - f.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return -(s[:, 0] * np.log(p[np.arange(n), y])).sum() + (free ** 2).sum() / (2 * C), xb.T @ (s * (p - (sign > 0))) + free / C

    step = 1.0
    for _ in range(20000):
        v, g = value(w)
        if np.abs(g).max() < 1e-7:
            break
        while value(w - step * g)[0] > v - step / 2 * (g * g).sum() and step > 1e-12:
            step /= 2
        w = w - step * g
        step *= 1.5
    return w


def folds_of(spark, rows, k):
    f = D.kfold_assign(frame(spark, rows), ["id"], "label_id", k=k)
    return {r["id"]: r["fold"] for r in f.collect()}


def test_nb_cv_equals_refitting_every_fold(spark):
    rows, k = corpus(70, 4), 3
    fold = folds_of(spark, rows, k)
    got = {r["fold"]: r["macro_f1"] for r in S.model_selection(
        frame(spark, rows), ["id"], "label_id", [0, 1, 2, 3], k=k, candidates=("nb",)).collect()}
    for i in range(k):
        tr = [r for r in rows if fold[r[0]] != i]
        te = [r for r in rows if fold[r[0]] == i]
        x = Dense([r[2] for r in tr], T.BASELINE)
        p = dense_nb(x([r[2] for r in tr]), [r[1] for r in tr], x([r[2] for r in te]))
        assert got[i] == pytest.approx(f1([r[1] for r in te], p), abs=2e-6)


def test_rows_scored_by_their_own_variant_need_no_terms_of_a_single_row(spark):
    rows, k = [(i, y, f"{t} only{i}") for i, y, t in corpus(60, 3, seed=7)], 3
    f = D.kfold_assign(frame(spark, rows), ["id"], "label_id", k=k).withColumn(
        "_tr", V.variant_bits([F.col("fold") != i for i in range(k)]))
    nb = V.VariantNB(f, ["id"], "label_id", [0, 1, 2], k, also=("fold",))
    own = {r["id"]: r for r in nb.score_own(list(range(k)), "fold").collect()}
    every = {(r["id"], r["variant"]): r for r in nb.score_all(list(range(k))).collect()}
    few, all_terms = ({r["term"] for r in m.select("term").collect()} for m in nb.models)
    assert not any(t.startswith("only") for t in few) and few < all_terms and len(own) == len(rows)
    for i, r in own.items():
        assert r["scores"] == pytest.approx(every[(i, r["variant"])]["scores"])
    nb.close()
    assert not nb.models


def test_learning_curve_uses_nested_samples_of_common_sizes(spark):
    rows, k = corpus(61, 3, seed=4), 3
    fold = folds_of(spark, rows, k)
    got = {(r["size"], r["fold"]): (r["train_macro_f1"], r["test_macro_f1"]) for r in V.nb_learning_curve(
        frame(spark, rows), ["id"], "label_id", [0, 1, 2], params=T.IMPORTANCE, fractions=(0.3, 0.65, 1.0), k=k).collect()}
    smallest = min(sum(f != i for f in fold.values()) for i in range(k))
    sizes = [int(round(x * smallest, 9)) for x in (0.3, 0.65, 1.0)]
    assert set(got) == {(s, i) for s in sizes for i in range(k)}
    for i in range(k):
        order = sorted((r for r in rows if fold[r[0]] != i), key=lambda r: hashlib.md5(f"5644:{r[0]}".encode()).hexdigest())
        te = [r for r in rows if fold[r[0]] == i]
        for s in sizes:
            tr = order[:s]
            x = Dense([r[2] for r in tr], T.IMPORTANCE)
            a = x([r[2] for r in tr])
            want = [f1([r[1] for r in part], dense_nb(a, [r[1] for r in tr], x([r[2] for r in part]))) for part in (tr, te)]
            assert got[(s, i)] == pytest.approx(tuple(want), abs=2e-6)


@pytest.mark.parametrize("model,k", [("logreg", 3), ("logreg", 2), ("linsvm", 3), ("linsvm", 2)])
def test_linear_model_equals_a_dense_solution(spark, model, k):
    rows = corpus(60, k, seed=k)
    params = T.TfidfParams(ngram_range=(1, 2), min_df=2, max_df=0.9, sublinear_tf=True)
    m = L.fit_linear(frame(spark, rows), ["id"], L.Spec(0, model, 2.0, params))
    x = Dense([r[2] for r in rows], params)
    w = dense_linear(x([r[2] for r in rows]), [r[1] for r in rows], model, 2.0, k)
    terms = {r["term"]: r for r in m.terms.collect()}
    assert sorted(terms) == x.terms and m.vocab_size == len(x.terms)
    for j, t in enumerate(x.terms):
        assert terms[t]["idf"] == pytest.approx(x.idf[j]) and terms[t]["coef"] == pytest.approx(w[j].tolist(), abs=1e-3)
    assert m.intercept == pytest.approx(w[-1].tolist(), abs=1e-3)
    g = m.gradient(frame(spark, rows), ["id"]).collect()
    assert len(g) == (len(x.terms) + 1) * len(m.intercept)
    assert max(abs(r["gradient"]) for r in g) <= 10 * L.TOLERANCE * len(rows)
    # other coefficients are no stationary point
    moved = L.LinearModel(m.terms, [m.intercept[0] + 0.1, *m.intercept[1:]], m.classes, m.spec, m.n_rows, m.class_rows)
    assert max(abs(r["gradient"]) for r in moved.gradient(frame(spark, rows), ["id"]).collect()) > 0.1
    # scores of unseen texts, one of them without a known term
    new = [(100 + i, 0, t) for i, t in enumerate(["alpha beta", "unknown", "", "gamma gamma delta"])]
    f = x([t for *_, t in new]) @ w[:-1] + w[-1]
    f = np.hstack([-f, f]) if k == 2 else f
    if model == "logreg" and k == 2:
        want = 1 / (1 + np.exp(-f))
    else:
        want = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
    got = {r["id"]: r for r in m.predict(frame(spark, new), ["id"]).collect()}
    for i, row in enumerate(want):
        assert got[100 + i]["scores"] == pytest.approx(row.tolist(), abs=1e-3) and got[100 + i]["p"] == int(row.argmax())


@pytest.mark.parametrize("model", ["logreg", "linsvm"])
def test_saved_model_scores_alike(spark, tmp_path, model):
    rows = corpus(40, 3, seed=8)
    m = L.fit_linear(frame(spark, rows), ["id"], L.Spec(0, model))
    m.save(str(tmp_path / "m"))
    back = L.LinearModel.load(spark, str(tmp_path / "m"))
    assert (back.intercept, back.classes, back.spec, back.n_rows, back.class_rows) == (
        m.intercept, m.classes, m.spec, m.n_rows, m.class_rows)
    a, b = ({r["id"]: (r["p"], r["scores"]) for r in x.predict(frame(spark, rows), ["id"]).collect()} for x in (m, back))
    assert a == b


def test_grid_search_ranks_points_and_states_the_gain(spark):
    rows = corpus(60, 3, seed=6)
    train, test = frame(spark, rows[:45]), frame(spark, rows[45:])
    got = S.grid_search(train, test, ["id"], k=2)
    table = {r["grid_idx"]: r for r in got["table"].collect()}
    assert sorted(table) == list(range(24)) and got["best"]["rank"] == 1
    by_rank = sorted(table.values(), key=lambda r: r["rank"])
    assert [r["cv_macro_f1"] for r in by_rank] == sorted((r["cv_macro_f1"] for r in by_rank), reverse=True)
    gain = {r["metric"]: r for r in got["gain"].collect()}
    assert gain["accuracy"]["before"] == got["before"]["accuracy"]
    assert gain["macro_f1"]["gain"] == pytest.approx(got["after"]["macro_f1_present"] - got["before"]["macro_f1_present"])
    fold = folds_of(spark, rows[:45], 2)
    points = dict(S.grid_points())
    for r in got["scores"].collect():
        pt = points[r["point"]]
        spec = S.point_spec(0, pt)
        tr = [x for x in rows[:45] if fold[x[0]] != r["fold"]]
        te = [x for x in rows[:45] if fold[x[0]] == r["fold"]]
        x = Dense([t for *_, t in tr], spec.params)
        assert r["vocab_size"] == len(x.terms)
        if r["point"] in (0, 11, 23):
            w = dense_linear(x([t for *_, t in tr]), [y for _, y, _ in tr], "logreg", spec.C, 3)
            p = (x([t for *_, t in te]) @ w[:-1] + w[-1]).argmax(axis=1).tolist()
            assert r["macro_f1"] == pytest.approx(f1([y for _, y, _ in te], p), abs=0.03)


def test_points_without_terms_and_folds_of_one_class_score_nan(spark):
    rare = [(i, 0, f"word{i}") for i in range(12)] + [(100 + i, 1, f"other{i}") for i in range(12)]
    s, k = S.grid_scores(frame(spark, rare), ["id"], k=2)
    table = {r["grid_idx"]: r for r in S.grid_table(s).collect()}
    points = dict(S.grid_points())
    for i, r in table.items():
        empty = points[i]["min_df"] == 2
        assert math.isnan(r["cv_macro_f1"]) == empty and (r["rank"] > 12) == empty
    single = [(i, 0, "alpha beta") for i in range(8)]
    got = S.model_selection(frame(spark, single), ["id"], "label_id", [0], k=2).collect()
    assert {r["candidate"]: math.isnan(r["macro_f1"]) for r in got} == {"nb": False, "logreg": True, "linsvm": True}


def test_linear_learning_curve_equals_dense_fits(spark):
    rows, k = corpus(48, 3, seed=12), 2
    fold = folds_of(spark, rows, k)
    got = {(r["size"], r["fold"]): r for r in S.learning_curve(
        frame(spark, rows), ["id"], fracs=(0.5, 1.0), k=k).collect()}
    smallest = min(sum(f != i for f in fold.values()) for i in range(k))
    assert set(got) == {(int(round(x * smallest, 9)), i) for x in (0.5, 1.0) for i in range(k)}
    for (size, i), r in got.items():
        order = sorted((x for x in rows if fold[x[0]] != i), key=lambda x: hashlib.md5(f"5644:{x[0]}".encode()).hexdigest())
        tr, te = order[:size], [x for x in rows if fold[x[0]] == i]
        x = Dense([t for *_, t in tr], T.IMPORTANCE)
        w = dense_linear(x([t for *_, t in tr]), [y for _, y, _ in tr], "logreg", 1.0, 3)
        for part, name in ((tr, "train"), (te, "test")):
            p = (x([t for *_, t in part]) @ w[:-1] + w[-1]).argmax(axis=1).tolist()
            assert r[f"{name}_macro_f1"] == pytest.approx(f1([y for _, y, _ in part], p), abs=0.03)


def test_learning_curve_of_degenerate_samples_goes_on(spark):
    rows = [(i, 0, "alpha beta") for i in range(9)] + [(20 + i, 1, "gamma") for i in range(2)]
    got = S.learning_curve(frame(spark, rows), ["id"]).collect()
    assert len(got) == 10 and any(math.isnan(r["test_macro_f1"]) for r in got)
    assert any(r["test_macro_f1"] > 0 for r in got)


def test_top_and_bottom_terms_of_a_linear_model(spark):
    rows = corpus(60, 3, seed=2)
    m = L.fit_linear(frame(spark, rows), ["id"], L.Spec(params=T.IMPORTANCE))
    coef = {r["term"]: r["coef"] for r in m.terms.collect()}
    for smallest in (False, True):
        got = m.term_weights(4, smallest, ["a", "b", "c"]).collect()
        for c, name in enumerate("abc"):
            want = sorted(coef, key=lambda t: (abs(coef[t][c]) if smallest else -coef[t][c], t))[:4]
            assert [r["term"] for r in sorted(got, key=lambda r: r["rank"]) if r["class"] == name] == want


def test_first_rows_bound_a_fit_and_nothing_else(spark):
    rows = corpus(50, 3, seed=9)
    df = frame(spark, rows)
    assert L.first_rows(df, ["id"], 20).count() == 20 and L.first_rows(df, ["id"], 50).count() == 50
    m = L.fit_linear(df, ["id"], limit=20)
    assert m.n_rows == 20 and m.predict(df, ["id"]).count() == 50


def test_fits_read_all_rows_unless_fewer_are_asked_for(spark):
    for f in (L.fit_linear, L.fit_rows, S.grid_scores, S.grid_search, S.model_selection, S.learning_curve,
              S.embedding_model, EP.train_epochs):
        assert inspect.signature(f).parameters["limit"].default is None, f.__name__
    df = frame(spark, corpus(30, 3, seed=9))
    assert L.first_rows(df, ["id"], None) is df and L.fit_linear(df, ["id"]).n_rows == 30


@pytest.mark.parametrize("model,k", [("logreg", 3), ("linsvm", 3), ("linsvm", 2)])
def test_a_fit_shared_by_tasks_equals_one_in_a_task(spark, monkeypatch, model, k):
    rows, tasks, run = corpus(80, k, seed=3), [], TF.run_together
    monkeypatch.setattr(TF, "run_together", lambda spark, n, *a: tasks.append(n) or run(spark, n, *a))
    one = L.fit_linear(frame(spark, rows), ["id"], L.Spec(model=model))
    monkeypatch.setattr(TF, "SHARD_ENTRIES", 40)
    monkeypatch.setattr(L, "TASK_ENTRIES", 40)
    many = L.fit_linear(frame(spark, rows), ["id"], L.Spec(model=model))
    assert tasks == [1, 4]
    a, b = ({r["term"]: (r["idf"], r["coef"]) for r in m.terms.collect()} for m in (one, many))
    assert set(a) == set(b) and many.intercept == pytest.approx(one.intercept, abs=1e-4)
    for t, (idf, coef) in a.items():
        assert b[t][0] == pytest.approx(idf) and b[t][1] == pytest.approx(coef, abs=1e-4)


def test_shards_are_kept_or_read_at_each_pass(spark, monkeypatch):
    rows = corpus(50, 3, seed=4)
    monkeypatch.setattr(TF, "SHARD_ENTRIES", 40)
    data = L.fit_rows(frame(spark, rows), ["id"])
    assert data.shards > 2
    train = TF.read_rows(data.rows_path, data.n, ["y"])["y"] != 1
    params = T.TfidfParams(ngram_range=(1, 2), min_df=1, sublinear_tf=True)
    rnd, got = np.random.default_rng(1), []
    for kept in (0, 1500, 1 << 20):
        monkeypatch.setattr(TF, "CACHED_BYTES", kept)
        shards = TF.Shards(data.shards_path, list(range(data.shards)))
        assert bool(shards.later) == (kept < 1 << 20) and bool(shards.kept) == (kept > 0)
        x = TF.Design(shards, train, params, TF.Alone())
        w, r = rnd.random((2, x.height)), rnd.random((2, data.n))
        assert (x.dot(w) * r).sum() == pytest.approx((w * x.back(r)).sum())
        y = np.arange(data.n) % 3
        best, f = TF.fit(x, y, train, 3, "linsvm", 1.0, 1e-6)
        assert np.allclose(x.dot(best), f)
        coef = {t: (i, *c) for terms, idf, cs in x.coefficients(best) for t, i, c in zip(terms, idf, cs, strict=True)}
        assert len(coef) == x.size
        got.append(coef)
    assert all(set(g) == set(got[0]) for g in got)
    assert all(g[t] == pytest.approx(got[0][t], abs=1e-5) for g in got for t in g)


def test_rows_that_share_a_key_have_the_terms_of_all_its_texts_and_those_without_a_key_none(spark):
    rows = [(1, 0, "alpha beta beta"), (1, 1, "gamma"), (None, 0, "delta"), (2, 1, None), (3, None, "eps")]
    data = L.fit_rows(spark.createDataFrame(rows, "id long, label_id int, text string"), ["id"])
    shards = TF.Shards(data.shards_path, [0])
    (s,), (terms,) = shards, shards.terms()
    ys = TF.read_rows(data.rows_path, data.n, ["y"])["y"]
    assert data.n == 4 and sorted(ys.tolist()) == [0, 0, 1, 1]
    assert {t: (int(n), set(s.tf[a:b].tolist()), sorted(ys[s.rid[a:b]].tolist()))
            for t, n, a, b in zip(terms, s.sizes, s.ends[:-1], s.ends[1:], strict=True)} == {
        "alpha": (2, {1}, [0, 1]), "beta": (2, {2}, [0, 1]), "gamma": (2, {1}, [0, 1]),
        "alpha beta": (2, {1}, [0, 1]), "beta beta": (2, {1}, [0, 1])}


# ---------------------------------------------------------------- epochs

def vectors(spark, n=90, k=3, seed=5):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rnd.integers(k))
        rows.append((i, y, [float(v) for v in rnd.normal(size=4) + 2.0 * np.eye(k, 4)[y]]))
    rows += [(1000, None, [0.0] * 4), (1001, 1, None)]
    return rows, spark.createDataFrame(rows, "id long, label_id int, embedding array<float>").repartition(3)


def test_resumed_epochs_equal_an_uninterrupted_run(spark):
    _, df = vectors(spark)
    train, val = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    whole = EP.train_epochs(train, val, ["id"], [0, 1, 2], 5).orderBy("epoch").collect()
    half = EP.train_epochs(train, val, ["id"], [0, 1, 2], 2)
    rest = EP.train_epochs(train, val, ["id"], [0, 1, 2], 5, after=half).orderBy("epoch").collect()
    assert [tuple(r) for r in rest] == [tuple(r) for r in whole] and [r["epoch"] for r in whole] == [1, 2, 3, 4, 5]
    assert whole[-1]["train_loss"] < whole[0]["train_loss"] and whole[0]["step"] * 5 == whole[-1]["step"]


def test_best_epoch_is_restored_and_scores_all_vectors(spark):
    rows, df = vectors(spark)
    states = EP.train_epochs(df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), ["id"], [0, 1, 2], 6)
    best = EP.best_epoch(states)
    scores = {r["epoch"]: r["val_macro_f1"] for r in states.collect()}
    assert scores[best["epoch"]] == max(scores.values())
    assert best["epoch"] == min(e for e, s in scores.items() if s == max(scores.values()))
    got = {r["id"]: r for r in EP.predict_vectors(df, ["id"], best, [0, 1, 2]).collect()}
    w = np.array(best["weights"]).reshape(5, 3)
    for i, y, v in rows:
        if v is None:
            assert i not in got
            continue
        f = np.append(v, 1.0) @ w
        assert got[i]["y"] == y and got[i]["p"] == int(f.argmax())
        assert got[i]["scores"] == pytest.approx((np.exp(f) / np.exp(f).sum()).tolist(), abs=1e-5)
    assert sum(r["p"] == r["y"] for r in got.values() if r["y"] is not None) > 0.8 * len(rows)


def test_vectors_are_read_batch_by_batch_as_numbers():
    b = pa.record_batch({"key": ["a", "b", "c"], "y": [0, 1, 2], "part": pa.array([0, 1, 0], pa.int32()),
                         "x": pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.float32()))})
    names, y, own, x = EP._vectors(iter([b.slice(0, 1), b.slice(1, 0), b.slice(1)]))
    assert (names, y.tolist(), own.tolist()) == (["a", "b", "c"], [0, 1, 2], [True, False, True])
    assert x.dtype == np.float32 and x.tolist() == [[1, 2], [3, 4], [5, 6]]
    assert EP._vectors(iter([]))[0] == []
    uneven = pa.record_batch({**{c: b[c] for c in ("key", "y", "part")}, "x": pa.array([[1], [3, 4], [5, 6, 7]], pa.list_(pa.float32()))})
    with pytest.raises(ValueError, match="unequal"):
        EP._vectors(iter([uneven]))


def sparse_rows(seed=3):
    rnd = np.random.default_rng(seed)
    counts = [np.sort(rnd.choice(90, rnd.integers(0, 9), replace=False)) for _ in range(30)]
    counts[3], counts[-1] = counts[3][:0], counts[-1][:0]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    cols = np.concatenate(counts).astype(np.int32)
    return L.Sparse(offsets, cols, rnd.random(len(cols)) + 0.1, 90), np.arange(30) % 3


def test_sparse_products_in_parts(monkeypatch):
    x, _ = sparse_rows()
    dense = np.zeros((30, 90))
    dense[x.row_of, x.cols] = x.vals
    w, r = np.arange(180.0).reshape(90, 2), np.arange(60.0).reshape(30, 2)
    for at_once in (1, 5, 1 << 18):
        monkeypatch.setattr(L, "ENTRIES_AT_ONCE", at_once)
        assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.transposed().dot(r), dense.T @ r)


@pytest.mark.parametrize("model", ["logreg", "linsvm"])
def test_terms_of_one_row_are_folded_without_a_change(model):
    x, y = sparse_rows()
    df = np.bincount(x.cols, minlength=90)
    d = L.folded(x)
    assert d.x.width < 90 and (df == 1).sum() > 3
    f, cols, height = L.objective(x, y, 3, model, 1.0)
    g, _, folded_height = L.objective(d.x, y, 3, model, 1.0)
    w = np.random.default_rng(5).random((folded_height, cols))
    (a, ga), (b, gb) = f(d.unfold(w).ravel()), g(w.ravel())
    assert a == pytest.approx(b) and np.allclose(d.fold(d.unfold(w)), w)
    ga, gb = np.abs(ga.reshape(height, cols)), np.abs(gb.reshape(folded_height, cols))
    assert ga.max() == pytest.approx(max((gb[:-1] * d.peak[:, None]).max(), gb[-1].max()))
    assert ga.sum() == pytest.approx((gb[:-1] * d.mass[:, None]).sum() + gb[-1].sum())
    best = L.fit_coefficients(x, y, L.Spec(model=model))
    assert np.abs(f(best.ravel())[1]).max() <= L.TOLERANCE * len(y)
