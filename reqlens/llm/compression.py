"""Quality rules with compression bands.

Each text is compressed by zstandard as a whole and in fixed chunks. A whole text whose compressed share
of its bytes falls below the band of its length class repeats itself; above it, it is noise. The same
holds for its chunks: a text is rejected when more than MAX_BAD_CHUNKS of them lie outside their band.

The bands are learned from the texts of documents labelled as trusted that pass the base rules: by length class,
the share that all but a few of them exceed and the one that all but a few stay under (TAIL at either end), and the
same for their chunks. All such texts count, as histograms of bounded size. A class with few of them has the fixed
band of BANDS or CHUNK_BAND.

The base rules count words, word characters, symbols, repeated lines and words in repeated 3-word windows;
texts of under MIN_WORDS words, or mostly in repeated windows, fail them.

Defined cases: without trusted documents all bands are the fixed ones; labels of null or unknown ids name no text,
and repeated ones name theirs once; a null or empty text has no words, so it fails; the last chunk takes a rest of under half a
chunk; rows are independent, so ids may be null or repeat; an empty table gives no rows; filtering keeps
all columns, whatever their names.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import arrow_rows, mapped, stored, table

LEVEL = 3
CHUNK_BYTES = 2048
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_BAD_CHUNKS = 0.3
CHUNK_BAND = (0.15, 0.72)
#: From so many bytes on: least and greatest compressed share. Short texts hardly compress, long ones well;
#: random base64 stays above 0.75, lines that repeat fall below 0.1.
BANDS = ((0, 0.20, float("inf")), (256, 0.20, 0.80), (1024, 0.18, 0.72), (4096, 0.15, 0.68), (16384, 0.12, 0.65))
SYMBOLS = "#*$%&|<>"
#: Share of trusted texts beyond either limit, trusted texts that a learned band needs, and histogram steps of a share.
TAIL = 0.002
LEAST_TRUSTED = 50
STEPS, MOST_STEPS = 1000, 2000


class Bands(NamedTuple):
    """(least bytes, low, high) by length class, and (low, high) of a chunk."""

    whole: tuple[tuple[int, float, float], ...] = BANDS
    chunk: tuple[float, float] = CHUNK_BAND

    def of(self, size: int) -> int:
        """The length class of a text of so many bytes."""
        return bisect.bisect_right(self.whole, size, key=lambda b: b[0]) - 1


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    whole_share: float
    n_chunks: int
    n_bad_chunks: int


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more, first windows included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    order = np.argsort(code := pair[:-1] * len(number) + ids[2:], kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    starts = order[np.append(same, False) | np.insert(same, 0, False)]
    for k in range(3):
        again[starts + k] = True
    return int(again.sum())


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    n = max(1, (len(data) + size // 2) // size)
    return [data[i * size:(i + 1) * size if i < n - 1 else None] for i in range(n)]


class Measure(NamedTuple):
    """What the bands don't decide: the counts of the base rules, and the compressed shares."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    n_bytes: int
    whole_share: float
    chunk_shares: list[float]


def measure(text: str | None, compress) -> Measure:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_repeat = repeat_words(words)
    return Measure(len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)),
                   len(lines) - len(set(lines)), n_repeat,
                   len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words),
                   len(data), len(compress(data)) / max(1, len(data)), chunk_shares(data, compress))


def decide(m: Measure, bands: Bands = Bands()) -> Verdict:
    _, low, high = bands.whole[bands.of(m.n_bytes)]
    bad = sum(not bands.chunk[0] <= x <= bands.chunk[1] for x in m.chunk_shares)
    inside = low <= m.whole_share <= high and bad <= MAX_BAD_CHUNKS * len(m.chunk_shares)
    return Verdict(*m[:6], not m.base_failed and inside, m.whole_share, len(m.chunk_shares), bad)


def judge(text: str | None, compress, bands: Bands = Bands()) -> Verdict:
    return decide(measure(text, compress), bands)


def chunk_shares(data: bytes, compress) -> list[float]:
    """The compressed share of each chunk; a text of less than one has none."""
    return [len(compress(c)) / len(c) for c in chunks(data)] if len(data) >= CHUNK_BYTES else []


def limits(histogram: dict[int, int], otherwise: tuple[float, float], tail: float = TAIL) -> tuple[float, float]:
    """The shares between which all but ``tail`` of a histogram's counts lie at either end."""
    n = sum(histogram.values())
    if n < LEAST_TRUSTED:
        return otherwise
    out = []
    for steps in (sorted(histogram), sorted(histogram, reverse=True)):
        beyond = 0
        for step in steps:
            beyond += histogram[step]
            if beyond > tail * n:
                out.append(step)
                break
    return out[0] / STEPS, (out[1] + 1) / STEPS


def arrow_fields(kind: type) -> tuple[pa.Schema, str]:
    """doc_id and the fields of a named tuple, as an Arrow schema and as SQL."""
    kinds = {"int": (pa.int64(), "long"), "bool": (pa.bool_(), "boolean"), "float": (pa.float64(), "double"),
             "list[float]": (pa.list_(pa.float64()), "array<double>")}
    fields = [(k, kinds[getattr(v, "__forward_arg__", v)]) for k, v in kind.__annotations__.items()]
    return (pa.schema([("doc_id", pa.int64()), *((k, a) for k, (a, _) in fields)]),
            "doc_id long, " + ", ".join(f"{k} {s}" for k, (_, s) in fields))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of ``Measure`` for every document."""
    schema, sql = arrow_fields(Measure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            yield arrow_rows(schema, [(i, *measure(t.as_py(), compress))
                                      for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)])

    return mapped(docs.select("doc_id", "text"), run, sql)


def learned_bands(measures: DataFrame, labels: DataFrame) -> Bands:
    """Bands from the ``measured`` documents that ``labels`` gives quality 1; only shares meet the labels, no text.
    What reaches the driver is a count for each length class (or chunks) and step of a share: at most MOST_STEPS
    numbers for each."""
    trusted = measures.where("NOT base_failed").select("doc_id", "n_bytes", "whole_share", "chunk_shares").join(
        labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    kind = F.lit(0)
    for i, (least, *_) in enumerate(BANDS):
        kind = F.when(F.col("n_bytes") >= least, F.lit(i)).otherwise(kind)

    def step(share):
        return F.least(F.floor(share * STEPS), F.lit(MOST_STEPS)).cast("int")

    steps = F.concat(F.array(F.struct(kind.alias("kind"), step(F.col("whole_share")).alias("step"))),
                     F.transform("chunk_shares", lambda x: F.struct(F.lit(-1).alias("kind"), step(x).alias("step"))))
    counts: dict[int, dict[int, int]] = {}
    for r in trusted.select(F.inline(steps)).groupBy("kind", "step").count().collect():
        counts.setdefault(r["kind"], {})[r["step"]] = r["count"]
    return Bands(tuple((least, *limits(counts.get(i, {}), (low, high))) for i, (least, low, high) in enumerate(BANDS)),
                 limits(counts.get(-1, {}), CHUNK_BAND))


def verdicts(measures: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and the fields of ``Verdict`` for every ``measured`` document."""
    schema, sql = arrow_fields(Verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield arrow_rows(schema, [(i, *decide(Measure(*m), bands)) for i, *m in rows])

    return measures.mapInArrow(run, sql)


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and the fields of ``Verdict`` for every document."""
    return verdicts(measured(docs), bands)


def keep_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text is kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), compress, bands).kept for t in b.column(at)], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = stored(measured(table(spark, sf_dir, "documents")), "measures")
    return verdicts(measures, learned_bands(measures, table(spark, sf_dir, "labels")))
