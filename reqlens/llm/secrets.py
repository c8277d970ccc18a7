"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters of candidate runs are trained on labelled samples taken from all
texts: random strings are what the fixed patterns match (the value after a key word, access keys, long hex
strings), ordinary identifiers are all other runs. A run of at least MIN_RUN characters outside the fixed
matches is a secret when its log-likelihood ratio reaches MIN_RATIO and MIN_RATIO_PER_CHAR per character.

The counts are at most 2 x 68 x 68 numbers, summed by Spark over all texts before they reach the driver.

Defined cases: a null or empty text has no spans; without any fixed match the random model is uniform;
rows are independent, so ids may be null or repeat; an empty table gives no rows; masking keeps all columns
and recounts ``n_chars`` where it is present.
"""
from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import arrow_rows, mapped, stored, table

KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 16
MIN_RATIO = 14.0
MIN_RATIO_PER_CHAR = 0.7
SMOOTHING = 0.5

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SIZE = len(ALPHABET) + 1  # 0: any other character, so the bounds of a run
_CODE = np.zeros(256, np.uint16)
_CODE[list(ALPHABET.encode())] = np.arange(1, SIZE)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
# a run of which a part would be long enough is long enough itself, so the lengths can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns' matches, each kind's leftmost and non-overlapping."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _values(text: str, spans: list[Span]) -> list[str]:
    """The random parts of the matches."""
    return [_ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b] for a, b, kind in spans]


def _blank(text: str, spans: list[Span]) -> str:
    """The text with the spans replaced by spaces."""
    at, out = 0, []
    for a, b, _ in spans:
        out += [text[at:max(a, at)], " " * (b - max(a, at))]
        at = max(at, b)
    return "".join(out) + text[at:]


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(f" {text} ".encode("latin-1", "replace").replace(b"?", b" "), np.uint8)]


def transitions(text: str) -> np.ndarray:
    """Counts of each pair of neighbouring characters, SIZE x SIZE, flat; pairs of two others are left out."""
    codes = _codes(text).astype(np.int64)
    counts = np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)
    counts[0] = 0
    return counts


def train(docs: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of each transition, from all texts of ``docs``."""
    schema = pa.schema([("random", pa.bool_()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {True: np.zeros(SIZE * SIZE, np.int64), False: np.zeros(SIZE * SIZE, np.int64)}
        for b in batches:
            for t in b.column(0):
                if text := t.as_py():
                    if spans := base_spans(text):
                        total[True] += transitions(" ".join(_values(text, spans)))
                        text = _blank(text, spans)
                    total[False] += transitions(text)
        yield arrow_rows(schema, [(kind, int(c), int(n[c])) for kind, n in total.items() for c in np.flatnonzero(n)])

    cells = mapped(docs.select("text"), count, "random boolean, cell int, n long")
    counts = np.zeros((2, SIZE * SIZE))
    for r in stored(cells.groupBy("random", "cell").agg(F.sum("n").alias("n")), "transitions").collect():
        counts[int(r["random"]), r["cell"]] = r["n"]
    smooth = counts.reshape(2, SIZE, SIZE) + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def markov_spans(text: str, base: list[Span], ratio: np.ndarray) -> list[Span]:
    """Runs outside the base spans that look random rather than ordinary."""
    out = []
    for m in _RUN.finditer(_blank(text, base) if base else text):
        codes = _codes(m[0])
        total = ratio[codes[:-1], codes[1:]].sum()
        if total >= MIN_RATIO and total >= MIN_RATIO_PER_CHAR * len(m[0]):
            out.append((*m.span(), "markov"))
    return out


def find(text: str | None, ratio: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and kind."""
    base = base_spans(text or "")
    return base, sorted(base + markov_spans(text or "", base, ratio), key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                        ("n_markov", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, spans = find(t.as_py(), ratio)
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                rows.append((doc_id, *n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]))
            yield arrow_rows(schema, rows)

    return mapped(
        docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def mask(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    at = docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, changed = b.column(at).to_pylist(), False
            for i, text in enumerate(texts):
                spans = find(text, ratio)[1]
                if not spans:
                    continue
                changed, done, out = True, 0, []
                for a, e, kind in spans:
                    if a >= done:
                        out += [text[done:a], f"[{kind}]"]
                    done = max(done, e)
                texts[i] = "".join(out) + text[done:]
            if changed:
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if n_at is not None:
                    n = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n_at).type)
                    b = b.set_column(n_at, b.schema.field(n_at), n)
            yield b

    return mapped(docs, run, docs.schema)


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
