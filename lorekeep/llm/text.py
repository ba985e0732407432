"""Vectorised text kernels that run inside Spark tasks on Arrow batches.

Words are maximal runs of characters other than ASCII punctuation, space and
controls; A-Z count as a-z. UTF-8 keeps every byte of a non-ASCII character
above 0x7F, so words can be found on bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: For each byte: a space, or the byte with A-Z lower-cased.
FOLD = bytes(
    32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c
    for c in range(256)
)
#: Text bytes that one vectorised step handles at a time (one longer text is handled alone).
STEP_BYTES = 2_000_000

_M1, _M2, _GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_PRIME, _SHINGLE_PRIME = 0x9DDFEA08EB382D69, 0xC6A4A7935BD1E995
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(_GOLD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as lower-cased UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        for key, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """The words of several texts: raw bytes, where each word starts and ends, its text, and its 64-bit hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.n_texts = len(offsets) - 1
        folded = np.frombuffer(FOLD, dtype=np.uint8)[raw]
        is_word = folded != 32
        before = np.empty_like(is_word)
        before[:1] = False
        before[1:] = is_word[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(raw)]
        before[cuts] = False  # a new text starts a new word
        self.start = np.flatnonzero(is_word & ~before)
        after = np.empty_like(is_word)
        after[-1:] = False
        after[:-1] = is_word[1:]
        after[cuts[cuts > 0] - 1] = False
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.bytes = folded
        self.text = np.searchsorted(offsets[1:], self.start, side="right")
        self.count = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def _sums(self) -> np.ndarray:
        up, _ = _powers(len(self.bytes) + 1)
        byte_value = mix(np.arange(256, dtype=np.uint64))
        return np.concatenate(([np.uint64(0)], np.cumsum(byte_value[self.bytes] * up[: len(self.bytes)])))

    def hashes(self, *lengths: int) -> list[np.ndarray]:
        """Hashes of all words (length 0) or of their first so many bytes, whole characters only."""
        sums = self._sums()
        _, down = _powers(len(self.bytes) + 1)
        out = []
        for length in lengths:
            end = self.end if not length else np.minimum(self.end, self.start + length)
            if length:
                for _ in range(3):  # back to the start of a character that the cut would split
                    inside = (end < self.end) & ((self.bytes[np.minimum(end, len(self.bytes) - 1)] & 0xC0) == 0x80)
                    end = np.where(inside, end - 1, end)
            out.append(mix((sums[end] - sums[self.start]) * down[self.start] + np.uint64(length)))
        return out

    def shingles(self, word_hash: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every run of so many words; a shorter text is one run of all its words."""
        powers = [np.uint64(pow(_SHINGLE_PRIME, k, 1 << 64)) for k in range(size)]
        n = len(word_hash)
        if n >= size:
            total = np.zeros(n - size + 1, dtype=np.uint64)
            for k, p in enumerate(powers):
                total += word_hash[k : n - size + 1 + k] * p
            inside = self.text[: n - size + 1] == self.text[size - 1 :]
            found, text = mix(total[inside]), self.text[: n - size + 1][inside]
        else:
            found, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((self.count > 0) & (self.count < size))
        if len(short):
            extra = []
            for t in short:
                h = word_hash[self.first[t] : self.first[t + 1]]
                extra.append((h * np.array(powers[: len(h)], dtype=np.uint64)).sum(dtype=np.uint64))
            found = np.concatenate((found, mix(np.array(extra, dtype=np.uint64))))
            text = np.concatenate((text, short))
        return found, text


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, times) of the distinct values of each text, in order."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most STEP_BYTES of text each, or one row, with the text's bytes and offsets."""
    for batch in batches:
        raw, offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def lists(rows: np.ndarray, values: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.ListArray:
    """A list column from values and the sorted row of each."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
