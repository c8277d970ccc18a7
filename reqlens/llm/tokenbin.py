"""Token ids in binary files, bit-packed at a fixed width.

Each id takes the fewest bits that hold the vocabulary. A file is a header, packed blocks of BLOCK_IDS ids
(the last may be shorter), and a footer with the byte offset of every block, the documents' ids and their
cumulative lengths. Any range of ids is read by seeking to its blocks; a block is unpacked by numpy in one
step. Documents lie in ascending order of doc_id over the files and within each.

    header   magic "FWBP", version, bits, block ids, 0                              (5 x u32)
    blocks   ids, least significant bit first, each block padded to whole bytes
    footer   block offsets (u64, one more than blocks), document ids (i64), null flags (u8), ends (u64)
    tail     footer offset, number of blocks, number of documents (3 x u64)

Defined cases: a null or empty text is a document with the end id alone; a null doc_id comes first; rows
that repeat a doc_id are documents of their own, in the order of their texts; an empty table writes no
file; other columns are not read.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reqlens.llm.common import (
    TaskFile,
    arrow_rows,
    open_file,
    shuffle_partitions,
    stored,
    table,
    work_dir,
)
from reqlens.llm.wordbpe import END_ID, encoder, word_tokenizer

MAGIC = b"FWBP"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 26


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, least significant bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    one = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = one
    return np.packbits(full.ravel(), bitorder="little").view("<u4")


class Writer:
    """Packs documents one after the other; keeps one block of ids in memory, besides the footer."""

    def __init__(self, write, bits: int, block_ids: int = BLOCK_IDS):
        self.write, self.bits, self.block_ids = write, bits, block_ids
        write(MAGIC + struct.pack("<4I", 1, bits, block_ids, 0))
        self.at, self.offsets, self.left, self.n_left = 20, [20], [], 0
        self.docs, self.ends, self.total = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.total += len(ids)
        self.ends.append(self.total)
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.block_ids:
            held = np.concatenate(self.left)
            whole = len(held) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(held[i:i + self.block_ids])
            self.left, self.n_left = [held[whole:]], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.n_left:
            self._block(np.concatenate(self.left))
        self.write(np.array(self.offsets, "<u8").tobytes())
        self.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.write(np.array([d is None for d in self.docs], "u1").tobytes())
        self.write(np.array(self.ends, "<u8").tobytes())
        self.write(struct.pack("<3Q", self.at, len(self.offsets) - 1, len(self.docs)))


class Reader:
    """Random access to a file: ``ids(a, b)`` reads the blocks that hold that range only."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        magic, version, self.bits, self.block_ids, _ = struct.unpack("<4s4I", f.read(20))
        if magic != MAGIC or version != 1:
            raise ValueError("not a packed id file")
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 24)
        footer, n_blocks, n_docs = struct.unpack("<3Q", f.read(24))
        f.seek(footer)
        self.offsets = np.frombuffer(f.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        docs, null = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(n_docs), "u1")
        self.docs = [None if x else int(d) for d, x in zip(docs, null, strict=True)]
        self.ends = np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def ids(self, start: int, end: int) -> np.ndarray:
        if not 0 <= start <= end <= len(self):
            raise IndexError((start, end))
        if start == end:
            return np.zeros(0, "<u4")
        a, b = start // self.block_ids, (end - 1) // self.block_ids
        self.f.seek(int(self.offsets[a]))
        data = self.f.read(int(self.offsets[b + 1] - self.offsets[a]))
        n, out = len(self), []
        for k in range(a, b + 1):
            part = data[self.offsets[k] - self.offsets[a]:self.offsets[k + 1] - self.offsets[a]]
            out.append(unpack(part, min(self.block_ids, n - k * self.block_ids), self.bits))
        return np.concatenate(out)[start - a * self.block_ids:end - a * self.block_ids]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids) in order, read about ``ids_at_once`` ids at a time."""
        i, starts = 0, np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.ends, starts[i] + ids_at_once, "right")))
            held = self.ids(int(starts[i]), int(self.ends[j - 1]))
            for k in range(i, j):
                yield self.docs[k], int(starts[k]), held[starts[k] - starts[i]:self.ends[k] - starts[i]]
            i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
                      block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` into files in ``folder``; (file, part, k, docs, ids, before) of each file, where
    ``before`` counts the ids of all files before it."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id") \
        .sortWithinPartitions("doc_id", "text")
    made = pa.schema([("file", pa.string()), ("part", pa.int64()), ("k", pa.int64()), ("docs", pa.int64()),
                      ("ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, k, f = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        for b in batches:
            texts = enc.documents(b.column(1), end_id)
            for doc_id, ids in zip(b.column(0).to_pylist(), texts, strict=True):
                if f is None:
                    f = TaskFile(folder, f"ids-{part:06d}-{k:04d}", ".bin")
                    w = Writer(f.write, bits_for(enc.vocab_size), block_ids)
                w.add(doc_id, ids)
                if w.total >= file_ids:
                    w.close()
                    yield arrow_rows(made, [(f.commit(), part, k, len(w.docs), w.total)])
                    f, k = None, k + 1
        if f is not None:
            w.close()
            yield arrow_rows(made, [(f.commit(), part, k, len(w.docs), w.total)])

    files = stored(ordered.mapInArrow(write, "file string, part long, k long, docs long, ids long"), "token-files")
    # one row per file of up to 2^26 ids: a small table, numbered in one task
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_file(folder, name) as f:
                    rows = [(doc_id, before + start, len(ids), zlib.crc32(ids))
                            for doc_id, start, ids in Reader(f).documents()]
                for i in range(0, len(rows), 10_000):
                    yield arrow_rows(schema, rows[i:i + 10_000])

    spread = files.select("file", "before").repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_fixed_width_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "ids")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, word_tokenizer())
    return read_token_files(files, folder)
