"""Hashes of word n-grams, all of a block at once, as NumPy arrays over their UTF-8 bytes.

A gram is a span of Gapless.bytes: its words with one space between. Hash functions advance through all
spans side by side, shortest first, so that the spans still open are a slice; spans over LONG bytes go to
the libraries' functions, which give the same values."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

from .textblock import Block

LONG = 256
#: Fixed values of XXH64, and the reversed polynomial of CRC-32.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
CRC_POLYNOMIAL = 0xEDB88320

#: A-Z to a-z, every other byte as it is.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & 1, np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    return table


CRC_TABLE = _crc_table()


class Gapless:
    """The words of a block, each followed by one space at most: bytes, starts and ends of words, and the
    number of words before each document (word_at)."""

    def __init__(self, block: Block, lower: bool = True):
        size = len(block.bytes)
        data = LOWERED[block.bytes] if lower else block.bytes.copy()
        keep = ~block.blank
        after = block.ends[block.ends < size]
        after = after[block.blank[after]]
        keep[after] = True
        data[after] = 32
        before = np.zeros(size + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        self.bytes = data[keep]
        self.starts, self.ends, self.word_at = before[block.starts], before[block.ends], block.word_at

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of n words inside one document, and the document."""
        count = np.diff(self.word_at)
        doc = np.repeat(np.arange(len(count)), count)
        first = np.flatnonzero(np.arange(len(self.starts)) + n <= self.word_at[1:][doc]) if len(doc) else np.zeros(0, np.int64)
        return first, doc[first]


def _by_size(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the spans over LONG bytes; those of the others by size, and their sizes."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    cut = int(np.searchsorted(size[order], LONG, side="right"))
    return order[cut:], order[:cut], size[order[:cut]]


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of each pair, as uint32."""
    out = np.zeros(len(starts), np.uint32)
    long, order, size = _by_size(starts, ends)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    state, at = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order]
    for step in range(int(size[-1]) if len(size) else 0):
        open_ = slice(int(np.searchsorted(size, step, side="right")), None)
        now = state[open_]
        state[open_] = CRC_TABLE[(now ^ data[at[open_] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = ~state
    return out


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotated(state + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] of each pair."""
    out = np.zeros(len(starts), np.uint64)
    long, order, size = _by_size(starts, ends)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    zero = np.uint64(0)
    with np.errstate(over="ignore"):
        root = np.uint64(seed)
        state = np.full(len(order), root + P5, np.uint64)
        at, left = starts[order], size.copy()
        wide = int(np.searchsorted(size, 32))
        if wide < len(order):
            lanes = [np.full(len(order) - wide, x, np.uint64) for x in (root + P1 + P2, root + P2, root, root - P1)]
            place, stripes = at[wide:], size[wide:] // 32
            for step in range(int(stripes[-1])):
                open_ = slice(int(np.searchsorted(stripes, step, side="right")), None)
                for k in range(4):
                    lanes[k][open_] = _round(lanes[k][open_], eight[place[open_] + 32 * step + 8 * k])
            whole = sum((_rotated(x, by) for x, by in zip(lanes[1:], (7, 12, 18), strict=True)), _rotated(lanes[0], 1))
            for x in lanes:
                whole = (whole ^ _round(zero, x)) * P1 + P4
            state[wide:] = whole
            at[wide:] += 32 * stripes
            left[wide:] -= 32 * stripes
        state += size.astype(np.uint64)
        while len(some := np.flatnonzero(left >= 8)):
            state[some] = _rotated(state[some] ^ _round(zero, eight[at[some]]), 27) * P1 + P4
            at[some] += 8
            left[some] -= 8
        if len(some := np.flatnonzero(left >= 4)):
            state[some] = _rotated(state[some] ^ four[at[some]].astype(np.uint64) * P1, 23) * P2 + P3
            at[some] += 4
            left[some] -= 4
        while len(some := np.flatnonzero(left)):
            state[some] = _rotated(state[some] ^ data[at[some]].astype(np.uint64) * P5, 11) * P1
            at[some] += 1
            left[some] -= 1
        state = (state ^ (state >> np.uint64(33))) * P2
        state = (state ^ (state >> np.uint64(29))) * P3
        out[order] = state ^ (state >> np.uint64(32))
    return out


def slices(count: int, size: int = 1 << 17) -> Iterator[slice]:
    for at in range(0, count, size):
        yield slice(at, min(count, at + size))
