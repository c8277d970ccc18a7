"""Rows kept as block files in the shared folder, so that later steps can go back to some or all of them
without shuffling their texts. A place is a block file's name and a row in it."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reqlens.llm.common import TaskFile, mapped, open_file, release, shuffle_partitions, stored, work_dir

SLICE_BYTES = 1 << 22
BLOCK_BYTES = 1 << 25
BLOCKS_PER_TASK = 16


def store_blocks(docs: DataFrame, *also: str) -> tuple[str, DataFrame]:
    """Write the rows of ``docs``, all columns, as compressed block files of about BLOCK_BYTES of text into a
    new shared folder; (folder, places), where places has block, row, doc_id and the columns ``also``."""
    folder = work_dir(docs.sparkSession, "blocks")
    text = docs.columns.index("text")
    fields = docs.select("doc_id", *also).schema
    at = [docs.columns.index(c) for c in fields.names]
    out = StructType().add("block", "string").add("row", "long")
    for f in fields:
        out = out.add(f.name, f.dataType)
    schema = to_arrow_schema(out)

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.coalesce(pc.binary_length(b.column(text)), pa.scalar(0, pa.int32()))
        size = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = [*np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1, b.num_rows]
        for start, end in zip([0, *ends], ends, strict=False):
            yield b.slice(start, end - start)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, f = TaskContext.get().partitionId(), 0, None
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for b in (x for whole in batches if whole.num_rows for x in cut(whole)):
            if f is None:
                f, rows, size = TaskFile(folder, f"block-{part:06d}-{k:04d}", ".arrow"), 0, 0
                ipc = pa.ipc.new_stream(f.stream, b.schema, options=options)
            ipc.write_batch(b)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([f.name] * n, pa.string()), pa.array(np.arange(rows, rows + n)),
                                              *(b.column(i) for i in at)], schema=schema)
            rows, size = rows + n, size + (pc.sum(pc.binary_length(b.column(text))).as_py() or 0)
            if size >= BLOCK_BYTES:
                ipc.close()
                f.commit()
                f, k = None, k + 1
        if f is not None:
            ipc.close()
            f.commit()

    return folder, stored(mapped(docs, write, out), "places")


def block_slices(folder: str, blocks: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, rows) of each slice of a block, so that a task never holds a block's texts as a whole."""
    first = 0
    with open_file(folder, blocks["block"][0].as_py()) as f:
        for b in pa.ipc.open_stream(f):
            yield first, b
            first += b.num_rows
    release()


def by_block(blocks: DataFrame, rows: DataFrame):
    """The cogroup of the blocks and the rows by ``block``. The number of partitions is stated, since the few
    bytes of a place stand for a whole file: two for each block up to the session's number, of which many are
    empty, and no more than about BLOCKS_PER_TASK blocks in one beyond it."""
    k = blocks.count()
    n = max(1, min(2 * k, shuffle_partitions(blocks.sparkSession)), k // BLOCKS_PER_TASK)
    others = rows.withColumnRenamed("block", "of")
    return blocks.repartition(n, "block").groupBy("block").cogroup(others.repartition(n, "of").groupBy("of"))


def without_rows(folder: str, places: DataFrame, gone: DataFrame, schema: StructType) -> DataFrame:
    """All stored rows but those at the places ``gone``."""
    def keep(own: pa.Table, out: pa.Table) -> pa.Table:
        out = out["row"].to_numpy()
        return pa.Table.from_batches([b.filter(pa.array(~np.isin(np.arange(first, first + b.num_rows), out)))
                                      for first, b in block_slices(folder, own)])

    return by_block(places.select("block").distinct(), gone.select("block", "row")).applyInArrow(keep, schema)


def packed_texts_of(folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, z (the text, compressed; null: empty) of the places (block, row, doc_id) ``wanted``."""
    schema = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def fetch(own: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        row, ids, z = rows["row"].to_numpy(), [], []
        press = zstandard.ZstdCompressor(level=3).compress
        for first, b in block_slices(folder, own):
            mine = np.flatnonzero((row >= first) & (row < first + b.num_rows))
            text = b.column("text").take(pa.array(row[mine] - first))
            z += [press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in text]
            ids.append(mine)
        return pa.table([rows["doc_id"].take(pa.array(np.concatenate(ids))).cast(pa.int64()),
                         pa.array(z, pa.binary())], schema=schema)

    return by_block(wanted.select("block").distinct(), wanted.select("block", "row", "doc_id")).applyInArrow(
        fetch, "doc_id long, z binary")
