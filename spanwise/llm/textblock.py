"""Words, lines and hashes of a block of documents, as NumPy arrays over their UTF-8 bytes.

Tasks read Arrow batches; a block is a slice of a batch with a bounded number of text bytes (one
longer text is a block of its own), so a task's memory does not follow the batch. Hashes are
polynomials modulo 2**64 (Rabin-Karp): prefix sums make the hash of any span one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: The odd multipliers of the byte and the word polynomials, and of the finaliser.
BYTE_BASE, WORD_BASE, WORD_BASE_2, BYTE_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: For words of letters only: every ASCII byte that is no letter stands between words.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process and grown by doubling."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.ones(size, np.uint64)
        if size > 1:
            known[1:] = base
            np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each pair."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(inverse(base), len(values) + 1)[starts])


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most `limit` text bytes, or of one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(_offsets(batch.column(text))))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def all_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from blocks(batch, text, limit)


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(1, kind)
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]


class Block:
    """Words and lines of the texts of an Arrow string array; null counts as the empty text.

    blank: which bytes stand between words; fold: lower ASCII and Latin-1 letters first."""

    def __init__(self, texts: pa.Array, blank: np.ndarray = _IS_BLANK, fold: bool = False):
        texts = texts.fill_null("")
        offsets = _offsets(texts).astype(np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.n = len(texts)
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.doc_at = offsets - offsets[0]
        if fold and len(self.bytes):
            low = _LOWER[self.bytes]
            tail = low[1:]
            tail[(low[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
            self.bytes = low
        blank = blank[self.bytes]
        self.blank = blank
        size = len(self.bytes)
        edge = np.zeros(size + 1, bool)  # a document starts (or the block ends) here
        edge[self.doc_at] = True
        before = np.ones(size + 1, bool)
        before[1:] = blank
        solid = np.zeros(size + 1, bool)
        solid[:size] = ~blank
        self.starts = np.flatnonzero(solid & (before | edge))
        self.ends = np.flatnonzero((~solid | edge) & ~before)
        self.word_at = np.searchsorted(self.starts, self.doc_at)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def word_hashes(self, base: int = BYTE_BASE) -> np.ndarray:
        values = self.bytes.astype(np.uint64) + np.uint64(1)
        return span_hashes(values, self.starts, self.ends, base)

    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every \\n-split line."""
        at = np.flatnonzero(self.bytes == 10)
        starts = np.sort(np.concatenate([self.doc_at[:-1], at + 1]))
        ends = np.sort(np.concatenate([self.doc_at[1:], at]))
        lines = np.diff(np.searchsorted(at, self.doc_at)) + 1
        return starts, ends, np.repeat(np.arange(self.n), lines)

    def windows(self, hashes: np.ndarray, k: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of k words inside one document, and the window's hash."""
        count = len(hashes)
        if count < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.word_at[1:], np.diff(self.word_at))
        starts = np.arange(count)
        starts = starts[starts + k <= last]
        return starts, span_hashes(hashes, starts, starts + k, base)


def per_doc(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of marks between the document borders `at`."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
