"""Encoding whole texts with a ``tokenizers`` file, word by word.

The tokenizer lower-cases, drops white space and never joins what white space parts, so a text's ids are
the ids of its words in a row. Words repeat, and so do the pieces that the pre-tokenizer cuts lower-cased
words into. Texts are taken in runs of about RUN_BYTES: Arrow splits them, numbers the different words of
the run, cuts plain Latin words into pieces and numbers those; pieces that are not remembered are encoded in
one call of the file's own model. Words that are not plain go one by one through the library's whole chain.
``tests/llm`` holds the result against the library on whole texts.

Defined cases: a null text is empty and has no ids but the end id; a word of any length is encoded whole,
and a piece longer than LONGEST_REMEMBERED bytes is not remembered.
"""
from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces that a worker remembers at most, and what an entry takes besides its texts.
PIECE_BYTES, ENTRY_BYTES = 1 << 26, 200
LONGEST_REMEMBERED = 1 << 10
#: Pieces that are encoded in one call.
LEARNT = 1 << 13
#: Bytes of texts whose words are numbered together, but for a single longer text.
RUN_BYTES = 1 << 23

END_ID = 1
#: Words of printable ASCII and Latin-1 letters: neither the normaliser nor Unicode classes matter beyond lower().
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
_PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered:
    """Results by key within ``limit`` bytes. When half of them is used, what was found or added since the last
    time is kept and the rest forgotten, so frequent keys stay."""

    def __init__(self, limit: int):
        self.limit, self.used, self.now, self.before = limit // 2, 0, {}, {}

    def missing(self, keys: Iterable) -> list:
        """Those of the keys that are not remembered; the others are kept for now."""
        out = []
        for key in keys:
            if key not in self.now:
                value = self.before.get(key)
                if value is None:
                    out.append(key)
                else:
                    self.add(key, value)
        return out

    def add(self, key, value) -> None:
        self.now[key] = value
        self.used += len(key) + len(value) + ENTRY_BYTES

    def forget(self) -> None:
        """To be called when no result of ``missing`` is awaited any more."""
        if self.used > self.limit:
            self.before = {k: v for k, v in self.now.items() if len(k) + len(v) <= LONGEST_REMEMBERED}
            self.now, self.used = {}, 0


def _joined(items: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The items from each end to the next as one."""
    at = np.frombuffer(items.buffers()[1], np.int64, len(items) + 1) if len(items) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1,
                                            [None, pa.py_buffer(at[ends]), items.buffers()[2] or pa.py_buffer(b"")])


class WordEncoder:
    """ids of texts as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.pieces = Remembered(PIECE_BYTES)
        # the file's model on pieces that are cut already, one in each line
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = Split("\n", "removed")
        suffix = self.tokenizer.model.end_of_word_suffix
        #: whether an id ends a piece, by id
        self.ends = np.zeros(self.vocab_size, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if len(ids) > 64 else array(self.dtype.char, ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        ids = np.array(self.lines.encode_batch_fast(["\n".join(shown)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):  # ids that don't show where pieces end
            for piece, line in zip(pieces, shown, strict=True):
                self.pieces.add(piece, self._bytes([t.id for t in self.tokenizer.model.tokenize(line)]))
            return
        data, at = ids.tobytes(), 0
        for piece, end in zip(pieces, (ends * self.dtype.itemsize).tolist(), strict=True):
            self.pieces.add(piece, data[at:end])
            at = end

    def _plain(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of different plain words."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), _PIECES, "\\1 ")
        cut = pc.split_pattern(pc.ascii_rtrim_whitespace(spaced), " ")
        coded = cut.values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = self.pieces.missing(pieces)
        for at in range(0, len(new), LEARNT):  # the library takes some hundred bytes for each id of a call
            self._learn(new[at:at + LEARNT])
        ids = pa.array([self.pieces.now[p] for p in pieces], pa.large_binary())
        self.pieces.forget()
        return _joined(ids.take(coded.indices), np.asarray(cut.offsets))

    def _words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of different words."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
        others = words.filter(pc.invert(plain)).to_pylist()
        ids = pa.array([self._bytes(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in others],
                       pa.large_binary())
        known, is_plain = self._plain(words.filter(plain)), np.asarray(plain)
        at = np.where(is_plain, np.cumsum(is_plain) - 1, len(known) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([known, ids]).take(pa.array(at))

    def _run(self, texts: pa.LargeStringArray) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        ids = self._words(coded.dictionary).take(coded.indices)
        return _joined(ids, np.asarray(split.offsets)).to_pylist()

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: empty) without special tokens."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends, at = np.cumsum(np.asarray(pc.binary_length(texts))), 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
            yield from self._run(pa.concat_arrays([texts[at:end]]))
            at = end

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) without special tokens."""
        return next(self.encode_all(pa.array([text], pa.large_string())))

    def documents(self, texts: pa.Array, end_id: int = END_ID) -> Iterator[np.ndarray]:
        """The ids of each text and the end id."""
        end = np.array([end_id], self.dtype).tobytes()
        for ids in self.encode_all(texts):
            yield np.frombuffer(ids + end, self.dtype)

    def document(self, text: str | None, end_id: int = END_ID) -> np.ndarray:
        """The ids of a text and the end id."""
        return next(self.documents(pa.array([text], pa.large_string()), end_id))


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, which has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
