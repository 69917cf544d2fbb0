"""Vectorised text primitives shared by the corpus operators.

Everything here works on a slice of an Arrow string column seen as one byte
buffer with row offsets, so that words, shingles and byte windows of many
documents are computed by a few numpy passes.  Slices are kept to a quarter of a
megabyte (``pieces``), so memory does not follow the batch size Spark chose;
only a single longer text makes a longer slice.

Nulls count as empty texts.  All hashes are 64-bit and depend on the bytes
alone, so equal texts hash alike in any task, executor or run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18

#: Bytes from which a span is hashed by itself instead of in step with the others.
LONG_SPAN = 192
_FEW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

_byte = np.arange(256)
#: Words are runs of anything but blank, tab, newline, VT, FF and CR.
BLANK_WORD = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Words are runs of ASCII letters and digits' successors: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position on as one number (zeros beyond the end); ``>``: numbers that sort as the bytes do."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), f"{order}u8", padded.data, 0, (1,))


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices of about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (first is 0) of a string or binary array; null rows are empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    found = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return found, offsets - first


class Words:
    """Words of a slice: byte spans ``start``/``end``, and per row ``bounds[i]:bounds[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = is_word[self.data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        cuts = offsets[(offsets < n)]
        begins = inside & ~before
        begins[cuts] = inside[cuts]
        ends = before & ~inside
        ends[cuts] |= before[cuts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time through a mixing step that no text structure cancels."""
    view = eights(data) if view is None else view
    left = (end - start).astype(np.int64)
    h = mix(left.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(left > LONG_SPAN).tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes()))
    todo = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
    at, left = start[todo].astype(np.int64), left[todo]
    while len(todo):
        h[todo] = mix((h[todo] ^ (view[at] & _FEW[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of k consecutive words (len(words)-k+1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0xD1342543DE82EF95)
        h += words[i : i + n]
    return mix(h)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each row; a shorter, not empty row is one shingle."""
    hashes = words.hashes()
    grams = gram_hashes(hashes, k)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(gram_hashes(hashes[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
