"""Packing documents into sequences by lexical retrieval.

Every document becomes its ids and an end id. Whole windows of SEQUENCE ids are sequences of their own as
they are; what is left of each document, a fragment shorter than a window, is dealt to a shard by a hash.
Each shard keeps an inverted index of its fragments with BM25 weights, whose document frequencies and mean
length come from all fragments of the corpus. The longest unused fragment is the seed of a sequence: all its
ids are looked up, and its best unused neighbours, as many as it takes, fill the window in order of their
scores. Where no neighbour fits any more, the best one that is left is cut: its head fills the window to
the last id and its rest stays in the index. A seed without neighbours takes the longest fragments. So only
the last sequence of a shard can be padded.

The vocabulary bounds the document frequencies that reach the driver and the tasks; a shard holds about
SHARD_IDS ids, however long the corpus, and the texts are encoded once.

Defined cases: a null or empty text is a document of the end id alone; a null doc_id is packed like any
other; rows that repeat an id or a text are documents of their own; an empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import mapped, release, stored, table
from reqlens.llm.wordbpe import END_ID, encoder, word_tokenizer

SEQUENCE = 2048
SHARD_IDS = 1 << 20
QUERY_TERMS = None  # all distinct ids of a seed are looked up
STEP = 64  # neighbours are sorted in steps that grow from this many
DENSE = 8  # ids in more than one of so many fragments of a shard are kept as rows over all of them
K1, B = 1.2, 0.75

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64())])
_PIECES_SQL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
               "offset long")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Index:
    """BM25 postings of the fragments of one shard."""

    def __init__(self, fragments: list[np.ndarray], idf: np.ndarray, mean: float):
        self.idf = idf
        n = np.array([len(f) for f in fragments])
        pairs = np.concatenate([f.astype(np.int64) * len(fragments) + i for i, f in enumerate(fragments)])
        pairs, tf = np.unique(pairs, return_counts=True)  # by id, then fragment
        term, self.fragment = np.divmod(pairs, len(fragments))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.fragment] / mean))
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))
        df = np.diff(self.starts)
        hot = np.flatnonzero(df * DENSE > len(fragments))
        self.row = np.full(len(idf), -1)
        self.row[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), len(fragments)))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], self.fragment[often]] = self.weight[often]
        by_fragment = np.argsort(self.fragment, kind="stable")
        self.terms = term[by_fragment]
        self.term_starts = np.searchsorted(self.fragment[by_fragment], np.arange(len(fragments) + 1))

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The score of each unused fragment for all terms of the seed."""
        terms = self.terms[self.term_starts[seed]:self.term_starts[seed + 1]]
        hot = self.row[terms] >= 0
        score = self.dense[self.row[terms[hot]]].sum(axis=0)
        starts = self.starts[terms[~hot]]
        n = self.starts[terms[~hot] + 1] - starts
        at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
        score += np.bincount(self.fragment[at], self.weight[at], len(unused))
        score[~unused] = 0
        return score

    def nearest(self, seed: int, unused: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
        """The unused fragments that share a term with the seed, best first, in growing steps; before each, those
        that are no longer wanted are left out."""
        score, k = self.scores(seed, unused), STEP
        found = np.flatnonzero(score)
        while len(found := found[wanted(found)]):
            s = score[found]
            least = np.partition(s, -k)[-k] if k < len(s) else 0
            best, found = found[s >= least], found[s < least]
            yield best[np.lexsort((best, -score[best]))]
            k *= 4

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused fragments that share a term with the seed, best first."""
        steps = self.nearest(seed, unused, lambda f: np.ones(len(f), bool))
        return np.concatenate([np.zeros(0, np.int64), *steps])


def pack(fragments: list[np.ndarray], idf: np.ndarray, mean: float, size: int = SEQUENCE,
         ) -> list[list[tuple[int, int, int]]]:
    """Sequences of (fragment, first id, end) that hold each id of the fragments once."""
    n = np.array([len(f) for f in fragments], np.int64)
    first = np.zeros(len(n), np.int64)
    unused = n > 0
    index = Index(fragments, idf, mean)
    longest = np.argsort(-n, kind="stable")
    at, out, room, too_long = 0, [], 0, -1

    def next_longest() -> int:
        nonlocal at
        while at < len(longest) and not unused[longest[at]]:
            at += 1
        return int(longest[at]) if at < len(longest) else -1

    def wanted(f: np.ndarray) -> np.ndarray:
        """What may still fit, or be the best that doesn't."""
        return (too_long < 0) | (n[f] - first[f] <= room)

    while (seed := next_longest()) >= 0:
        unused[seed] = False
        row, room = [(seed, int(first[seed]), int(n[seed]))], size - int(n[seed] - first[seed])
        too_long = -1
        for near in index.nearest(seed, unused, wanted) if room else ():
            for f, left in zip(near.tolist(), (n[near] - first[near]).tolist(), strict=True):
                if left <= room:
                    unused[f] = False
                    row.append((f, int(first[f]), int(n[f])))
                    room -= left
                elif too_long < 0:
                    too_long = f
                if not room:
                    break
            if not room:
                break
        while room:
            f, too_long = too_long if too_long >= 0 else next_longest(), -1
            if f < 0:
                break
            end = min(int(n[f]), int(first[f]) + room)
            row.append((f, int(first[f]), end))
            room -= end - int(first[f])
            first[f] = end
            unused[f] = end < n[f]
        out.append(row)
    return out


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """doc_id, n_tokens, crcs (of the whole windows), tail (the ids of the fragment) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.binary()),
                        ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n, crcs, tails = [], [], []
            for ids in enc.documents(b.column(1), end_id):
                whole = len(ids) // size * size
                n.append(len(ids))
                crcs.append(np.array([crc32(ids[i:i + size]) for i in range(0, whole, size)], "<u4").tobytes())
                tails.append(ids[whole:].astype("<u4" if enc.vocab_size > 1 << 16 else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.binary()),
                                              pa.array(tails, pa.binary())], schema=schema)

    return stored(mapped(
        docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, crcs binary, tail binary"), "tails")


def statistics(tails: DataFrame, dtype: str, vocab: int) -> tuple[np.ndarray, float, int]:
    """(idf by id, mean length of a fragment, ids in all fragments); one count per id reaches the driver."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocab, np.int64)
        for b in batches:
            for tail in b.column(0).to_pylist():
                df[np.unique(np.frombuffer(tail, dtype))] += 1
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(df[ids])], schema=schema)

    df = np.zeros(vocab)
    counts = tails.select("tail").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # at most one row per id of the vocabulary
        df[r["id"]] = r["n"]
    n, size = tails.agg(F.count_if(F.length("tail") > 0), F.sum(F.length("tail"))).collect()[0]
    size = (size or 0) // np.dtype(dtype).itemsize
    return np.log(1 + (n - df + 0.5) / (df + 0.5)), size / max(1, n), size


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SEQUENCE,
                   shard_ids: int = SHARD_IDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    vocab = encoder(tokenizer).vocab_size
    dtype = "<u4" if vocab > 1 << 16 else "<u2"
    tails = encode(docs, tokenizer, end_id, size)
    idf, mean, total = statistics(tails, dtype, vocab)
    n_shards = max(1, math.ceil(total / shard_ids))
    # the row number only spreads rows that share an id; the stored table gives it again on every try
    shard = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_shards))

    def run(t: pa.Table) -> pa.Table:
        release()
        t = t.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        doc_id, n, base = t["doc_id"].to_pylist(), t["n_tokens"].to_pylist(), t["shard"][0].as_py() << 32
        rows, k = [], 0
        for d, m, crcs in zip(doc_id, n, t["crcs"].to_pylist(), strict=True):
            for i, crc in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                rows.append((d, i * size, size, crc, m, base + k, 0))
                k += 1
        fragments = [np.frombuffer(x, dtype) for x in t["tail"].to_pylist()]
        if any(map(len, fragments)):
            for sequence in pack(fragments, idf, mean, size):
                offset = 0
                for f, a, e in sequence:
                    rows.append((doc_id[f], n[f] // size * size + a, e - a, crc32(fragments[f][a:e]), n[f],
                                 base + k, offset))
                    offset += e - a
                k += 1
        return pa.table([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), _PIECES, strict=True)],
                        schema=_PIECES)

    return tails.withColumn("shard", shard).groupBy("shard").applyInArrow(run, _PIECES_SQL)


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())
