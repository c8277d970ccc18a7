"""SentencePiece encoding with the original byte span of every piece, and decoding.

``Normaliser`` rewrites a text as the model's normaliser does: at each place the longest prefix found in
the compiled character map (a double-array trie) is replaced, white space is collapsed and escaped as the
model asks, and for every normalised byte the offset of the source byte it came from is kept. Pieces are
laid over the normalised text, so their bounds in it give their spans in the source.

``PieceEncoder`` gives the library's ids. A model without a character map whose pieces hold the space mark
only at their start and no line feed never joins what a space or a line feed parts; its texts are encoded
chunk by chunk, and each distinct chunk once per Python worker. All other models and texts with the space
mark itself are encoded as a whole. ``tests/llm`` holds ids, spans and normalised texts against the library.

Defined cases: a null or empty text has no ids and decodes to the empty text; a byte piece spans the byte
it stands for; the dummy prefix has an empty span; rows are independent, so repeated rows and ids give
repeated results; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reqlens.llm.common import arrow_rows, remembered, table

MARK = "▁"
_CHUNKS = re.compile(r" *[^ \n]+| +|\n")


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message."""
    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i
    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i:i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i:i + n], i + n
        yield tag >> 3, value


class Normaliser:
    """From the normaliser's part of a model: map (field 2), dummy prefix (3), collapse (4), escape (5)."""

    def __init__(self, spec: bytes, suffix: bool = False):
        f = {2: b"", 3: 1, 4: 1, 5: 1} | dict(proto_fields(spec))
        self.prefix, self.collapse, self.escape, self.suffix = bool(f[3]), bool(f[4]), bool(f[5]), suffix
        self.trie, self.texts = np.zeros(0, "<u4"), b""
        if f[2]:
            n = struct.unpack("<I", f[2][:4])[0]
            self.trie, self.texts = np.frombuffer(f[2][4:4 + n], "<u4").tolist(), f[2][4 + n:]

    def _longest(self, data: bytes, i: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest prefix of ``data[i:]`` in the map."""
        units, best = self.trie, None
        at = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for j in range(i, len(data)):
            at ^= data[j]
            unit = units[at]
            if unit & 0x800000FF != data[j]:
                break
            at ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = units[at] & 0x7FFFFFFF
                best = (self.texts[start:self.texts.index(b"\0", start)], j + 1 - i)
        return best

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The map applied, and the source offset of each byte."""
        if not len(self.trie):
            return data, np.arange(len(data))
        out, source, i = [], [], 0
        while i < len(data):
            new, n = self._longest(data, i) or (b"", 0)
            if not n:
                n = 1 if data[i] < 128 else 2 if data[i] < 224 else 3 if data[i] < 240 else 4
                new = data[i:i + n]
                source += range(i, i + len(new))
            else:
                source += [i] * len(new)
            out.append(new)
            i += n
        return b"".join(out), np.array(source, np.int64)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source offset of each and of the end."""
        data = text.encode("utf-8")
        size = len(data)
        data, source = self._mapped(data)
        raw = np.frombuffer(data, np.uint8)
        space = raw == 32
        if self.collapse:  # the first space of a run stays, none in front
            keep = ~space | np.concatenate([[False], ~space[:-1]])
            raw, source, space = raw[keep], source[keep], space[keep]
        if self.prefix and len(raw) and not self.suffix:
            raw, space, source = (np.insert(a, 0, x) for a, x in ((raw, 32), (space, True), (source, source[0])))
        if self.escape and space.any():
            times = np.where(space, 3, 1)
            first = np.cumsum(times) - times
            source, raw = np.repeat(source, times), np.repeat(raw, times)
            for k, byte in enumerate(MARK.encode()):
                raw[first[space] + k] = byte
        mark = MARK.encode() if self.escape else b" "
        data = raw.tobytes()
        if self.collapse:  # none at the end, however it was written
            while data.endswith(mark):
                data = data[:-len(mark)]
        if self.prefix and len(data) and self.suffix:
            data += mark
        source = np.concatenate([source[:len(data)], np.full(max(0, len(data) - len(source)), size)])
        return data, np.append(source, size)


class PieceEncoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.sp = SentencePieceProcessor(model_file=path)
        parts = dict(proto_fields(self.sp.serialized_model_proto()))
        self.normaliser = Normaliser(parts.get(3, b""), bool(dict(proto_fields(parts.get(2, b""))).get(24)))
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.sizes = np.array([1 if self.sp.is_byte(i) else len(p.encode()) for i, p in enumerate(names)])
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        norm = self.normaliser
        shown = [p for i, p in enumerate(names) if not (self.sp.is_byte(i) or self.sp.is_control(i)
                                                        or self.sp.is_unknown(i))]
        self.by_chunk = (not len(norm.trie) and norm.prefix and norm.escape and not norm.collapse and not norm.suffix
                         and all(MARK not in p.lstrip(MARK) and "\n" not in p for p in shown))
        self.cache = "pieces of chunks", path
        self.mark, self.line = self.sp.piece_to_id(MARK), self.sp.encode("\n")

    def _chunk(self, c: str) -> tuple[bytes, str]:
        if c == " ":
            ids = [self.mark]
        elif c[0] == " ":
            ids = self.sp.encode(c[1:])
        else:  # what follows a line feed has no prefix
            ids = self.sp.encode(c)[1:] if c == "\n" else self.sp.encode("\n" + c)[len(self.line):]
        return np.array(ids, self.dtype).tobytes(), ",".join(map(str, ids))

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and as decimal numbers joined by commas."""
        if not text or not self.by_chunk or MARK in text:
            ids = self.sp.encode(text) if text else []
            return np.array(ids, self.dtype), ",".join(map(str, ids))
        known, parts = remembered(self.cache), _CHUNKS.findall(" " + text)
        for c in parts:
            if c not in known:
                known[c] = self._chunk(c)
        found = [known[c] for c in parts]
        return np.frombuffer(b"".join([a for a, _ in found]), self.dtype), ",".join([b for _, b in found])

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(pieces, 2): first byte and end of each piece in the text's UTF-8 bytes."""
        normal, source = self.normaliser(text)
        ends = np.cumsum(self.sizes[ids])
        if len(ids) and ends[-1] != len(normal):  # an unknown piece: the library knows its length
            pieces = self.sp.encode(text, return_type="proto").pieces
            return np.array([(p.begin, p.end) for p in pieces])
        bounds = source[np.concatenate([[0], ends])] if len(ids) else np.zeros(1, np.int64)
        return np.stack([bounds[:-1], bounds[1:]], axis=1)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends (array<int>) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())),
                        ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                ids, _ = enc.encode(text)
                spans = enc.spans(text, ids)
                rows.append((doc_id, ids.tolist(), spans[:, 0].tolist(), spans[:, 1].tolist()))
            yield arrow_rows(schema, rows)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes, spans_crc32 of every document; the spans
    (first byte and end of each piece as little-endian 32-bit integers) are summed up where they are made."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("span_bytes", pa.int64()), ("spans_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                ids, decimal = enc.encode(text)
                spans = enc.spans(text, ids)
                rows.append((doc_id, len(ids), hashlib.sha256(decimal.encode()).hexdigest(),
                             hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest(),
                             int((spans[:, 1] - spans[:, 0]).sum()), zlib.crc32(spans.astype("<i4").tobytes())))
            yield arrow_rows(schema, rows)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_crc32 long")


def op8_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), piece_model())
