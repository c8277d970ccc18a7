"""Mini-batch softmax regression on vectors, epoch by epoch (M7, L3).

One run passes over the training vectors again and again in batches, with
AdamW steps and class weights.  After each epoch its whole state — weights,
moments, step — is a row with the epoch's loss and validation macro-F1, so the
best epoch can be restored and a stored run can go on where it stopped: the
order of an epoch's batches depends on the seed, the epoch and the row keys
only.

Training passes over all labelled vectors in one task, since a step follows the
one before; scoring is a column expression over all rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SEED
from ..session import stored
from .linear import first_rows
from .models import argmax, softmax

STATE_SQL = ("epoch int, step long, weights array<double>, first array<double>, second array<double>, "
             "train_loss double, val_macro_f1 double")
STATE = pa.schema([("epoch", pa.int32()), ("step", pa.int64()), ("weights", pa.list_(pa.float64())),
                   ("first", pa.list_(pa.float64())), ("second", pa.list_(pa.float64())),
                   ("train_loss", pa.float64()), ("val_macro_f1", pa.float64())])

SCORED_AT_ONCE = 1 << 14  # vectors


@dataclass(frozen=True)
class Training:
    batch: int = 16
    rate: float = 0.01
    decay: float = 0.01
    seed: int = SEED
    class_weighting: bool = True


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    """Over the classes present in y or p; 0 without rows."""
    out = [2.0 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in np.union1d(y, p)]
    return float(np.mean(out)) if out else 0.0


def epoch_order(keys: list[str], epoch: int, seed: int) -> np.ndarray:
    return np.argsort(np.array([hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest() for k in keys]), kind="stable")


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _vectors(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(keys, classes, whether in training, vectors) of the batches; no vector is a Python object."""
    names, y, own, x = [], [], [], [np.zeros((0, 0))]
    for b in batches:
        if not b.num_rows:
            continue
        names += b["key"].to_pylist()
        y.append(b["y"].to_numpy())
        own.append(b["part"].to_numpy() == 0)
        flat = b["x"].flatten()
        if (b["x"].value_lengths().to_numpy() * b.num_rows != len(flat)).any():
            raise ValueError("vectors of unequal length")
        x.append(flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
    return (names, *(np.concatenate(v) for v in (y, own, x[1:]))) if names else ([], np.array([]), np.array([], bool), x[0])


def _one_epoch(x: np.ndarray, y: np.ndarray, s: np.ndarray, order: np.ndarray, k: int, state: tuple, how: Training) -> tuple:
    w, first, second, step = state
    loss = 0.0
    for at in range(0, len(order), how.batch):
        b = order[at:at + how.batch]
        rows = _with_one(x[b])
        f = rows @ w
        e = np.exp(f - f.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        weight = s[y[b]]
        loss += float(-(weight * np.log(p[np.arange(len(b)), y[b]])).sum())
        p[np.arange(len(b)), y[b]] -= 1.0
        g = rows.T @ (weight[:, None] * p) / weight.sum()
        step += 1
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        shrunk = w.copy()
        shrunk[:-1] *= 1 - how.rate * how.decay  # the intercept isn't shrunk
        w = shrunk - how.rate * move
    return (w, first, second, step), loss / max(1e-300, float(s[y[order]].sum()))


def train_epochs(train: DataFrame, val: DataFrame, keys: list[str], classes: list, epochs: int,
                 vec_col: str = "embedding", label_col: str = "label_id", how: Training = Training(),
                 after: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The states of epochs 1 … ``epochs``, one row each, stored.  ``after``
    holds the states of an earlier run of the same rows; its last epoch is
    continued and its rows are kept.  Rows without a label or a vector take no
    part."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in keys])

    def part(df, i):
        single = dict(df.dtypes)[vec_col] == "array<float>"  # half the memory, the same numbers
        vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
        d = df.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
        return first_rows(d, keys, limit).select(key.alias("key"), F.col(label_col).cast("long").alias("y"),
                                                  vec.alias("x"), F.lit(i).alias("part"))

    old = after.orderBy(F.col("epoch").desc()).first() if after is not None else None  # a state: classes x width numbers
    done = int(old["epoch"]) if old else 0
    k = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y, own, x = _vectors(batches)
        if not names:
            return
        y = np.searchsorted(classes, y)
        names = [key for key, mine in zip(names, own.tolist(), strict=True) if mine]
        n_class = np.bincount(y[own], minlength=k)
        s = own.sum() / (max(1, (n_class > 0).sum()) * np.maximum(n_class, 1)) if how.class_weighting else np.ones(k)
        shape = (x.shape[1] + 1, k)
        state = tuple(np.zeros(shape) for _ in range(3)) + (0,)
        if old:
            state = tuple(np.array(old[c]).reshape(shape) for c in ("weights", "first", "second")) + (old["step"],)
        out, mine, other = [], np.flatnonzero(own), np.flatnonzero(~own)
        for epoch in range(done + 1, epochs + 1):
            state, loss = _one_epoch(x, y, s, mine[epoch_order(names, epoch, how.seed)], k, state, how)
            parts = np.split(other, range(SCORED_AT_ONCE, len(other), SCORED_AT_ONCE))
            p = [(_with_one(x[rows]) @ state[0]).argmax(axis=1) for rows in parts]
            out.append((epoch, state[3], *(a.ravel().tolist() for a in state[:3]), loss, macro_f1(y[other], np.concatenate(p))))
        yield pa.RecordBatch.from_pylist([dict(zip(STATE.names, r, strict=True)) for r in out], schema=STATE)

    # one task passes over the vectors in order of their keys; Spark sorts them
    rows = part(train, 0).unionByName(part(val, 1)).repartition(1).sortWithinPartitions("key", "part")
    new = rows.mapInArrow(run, STATE_SQL)
    return stored(new if after is None else after.unionByName(new), "epochs")


def best_epoch(states: DataFrame):
    """The state with the highest validation macro-F1, the first among equals."""
    return states.orderBy(F.col("val_macro_f1").desc(), "epoch").first()


def vector_scores(vec: Column, state, n_classes: int) -> Column:
    """Class probabilities of a vector under a state, as a column expression."""
    w = np.array(state["weights"]).reshape(-1, n_classes)

    def margin(c):
        pairs = F.zip_with(vec.cast("array<double>"), F.array(*[F.lit(float(v)) for v in w[:-1, c]]), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(float(w[-1, c])), lambda acc, z: acc + z)

    return softmax(F.array(*[margin(c) for c in range(n_classes)]))


def predict_vectors(df: DataFrame, keys: list[str], state, classes: list, vec_col: str = "embedding",
                    label_col: str = "label_id") -> DataFrame:
    """(keys, y, p, scores) of all rows with a vector."""
    names = F.array(*[F.lit(int(c)) for c in classes])
    d = df.filter(F.col(vec_col).isNotNull()).select(
        *keys, F.col(label_col).cast("int").alias("y"), vector_scores(F.col(vec_col), state, len(classes)).alias("scores"))
    return d.withColumn("p", F.get(names, argmax(F.col("scores")))).select(*keys, "y", "p", "scores")
