"""Media columns: lossless WebP (VP8L), decoded to pixel arrays, and a writer for payload images.

decode() reads the whole format: prefix codes in simple and full form, groups of codes by an entropy
image, back-references with two-dimensional distances, the colour cache, and the inverses of the
predictor, cross-colour, subtract-green and palette transforms (packed palettes too).

Most of a stream is usually one prefix code: one group of codes, no cache, and constant red, blue and
alpha (grey or palette images). Then symbols are decoded in bulk: the code is looked up at every bit
position at once, jumps of four symbols are composed by gathers, and a walk over these jumps marks the
positions where symbols start, up to the next back-reference. Everything else takes the plain loop.

encode() stores bytes as a grey image of 64 samples a row (wider beyond 1 MB): subtract-green makes red
and blue constant; with at most 16 different samples a palette packs several into a pixel. Lines that
occurred before, and runs of zeros, become back-references; the rest gets optimal prefix codes.

Defined results: null bytes give null pixels; what is not a whole lossless WebP gives null pixels and a
message; null texts are stored as 64 zero bytes, as empty ones; repeated rows are each converted; long
payloads are one file too, of up to 2**28 samples, written by CHUNK samples and read by WINDOW bytes, so that
a task needs some forty bytes of memory for each of a text (a longer text is an error); an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches
from .textblock import all_blocks

# Fixed values of the format.
SIGNATURE, GREENS, LENGTHS, DISTANCES, LONGEST = 0x2F, 256, 24, 40, 4096
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR, BLACK = 0x1E35A7BD, 0xFF000000
PREDICT, CROSS, SUBTRACT, PALETTE = range(4)
#: Near pixels by distance code: nearest first, of equal ones the higher row first, then the right one.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Malformed(ValueError):
    """Not a whole lossless WebP."""


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise Malformed("the stream ends early")
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in reading order (first bit lowest) of the canonical prefix code."""
    codes = np.zeros(len(lengths), np.int64)
    code = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    before = 0
    for s in order[lengths[order] > 0].tolist():
        n = int(lengths[s])
        code <<= n - before
        before = n
        codes[s] = int(format(code, f"0{n}b")[::-1], 2)
        code += 1
    return codes


class Code:
    """A prefix code as a table over its longest length; a single symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise Malformed("a prefix code without symbols")
        self.single = int(used[0]) if len(used) == 1 else None
        self.width = 0 if self.single is not None else int(lengths.max())
        self.symbols = np.zeros(1 << self.width, np.int32)
        self.sizes = np.zeros(1 << self.width, np.int32)
        if self.single is not None:
            self.symbols[0] = self.single
            return
        if int((1 << (self.width - lengths[used])).sum()) != 1 << self.width:
            raise Malformed("a prefix code that is not complete")
        codes = canonical(lengths)
        for s in used.tolist():
            self.symbols[codes[s] :: 1 << lengths[s]] = s
            self.sizes[codes[s] :: 1 << lengths[s]] = lengths[s]
        self.pairs = None

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self.pairs is None:
            self.pairs = (self.symbols.tolist(), self.sizes.tolist())
        entry = bits.peek(self.width)
        bits.at += self.pairs[1][entry]
        if bits.at > bits.end:
            raise Malformed("the stream ends early")
        return self.pairs[0][entry]


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise Malformed("a symbol outside its alphabet")
        lengths[symbols] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        token = code.read(bits)
        if token < 16:
            lengths[at] = token
            last = token or last
            at += 1
            continue
        value, times = {16: (last, 3), 17: (0, 3), 18: (0, 11)}[token]
        times += bits.read({16: 2, 17: 3, 18: 7}[token])
        if at + times > alphabet:
            raise Malformed("too many code lengths")
        lengths[at : at + times] = value
        at += times
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Bytes of a stream whose bit positions are looked up together: each takes some 200 bytes of memory.
WINDOW = 1 << 18


class _Walk:
    """Bulk decoding of one code from any bit position of a window of a stream, which begins where the stream is read."""

    def __init__(self, bits: Bits, code: Code):
        at = bits.at >> 3
        data = np.frombuffer(bits.data, np.uint8)[at : at + WINDOW + 4]
        n = len(data)
        # Symbols that start behind the window are left to the next one; behind the last window there are none.
        self.limit = 8 * WINDOW if at + n < len(bits.data) else 8 * n + 1
        wide = np.zeros(n + 4, np.uint32)
        wide[:n] = data
        window = wide[:-2] | wide[1:-1] << np.uint32(8)
        window = window[:-1] | wide[2:-1] << np.uint32(16)
        entries = (window[:n, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << code.width) - 1)).ravel()
        self.base, self.last = 8 * at, 8 * n
        self.symbols = code.symbols.astype(np.int16).take(entries)
        steps = np.where(code.symbols < GREENS, code.sizes, 0).astype(np.int32).take(entries)
        steps[self.limit :] = 0
        to = np.arange(len(steps), dtype=np.int32)
        to += steps
        np.minimum(to, len(to) - 1, out=to)
        self.next = to
        self.next4 = to.take(to)
        self.next4 = self.next4.take(self.next4)
        self.jumps = memoryview(self.next4)
        self.steps = steps

    def covers(self, at: int) -> bool:
        return at - self.base < self.limit

    def literals(self, at: int, most: int) -> tuple[np.ndarray, int]:
        """Literals from bit `at` on, up to `most` or the next other symbol; the bit after them."""
        i, jumps, places = at - self.base, self.jumps, []
        for _ in range(-(-most // 4)):
            places.append(i)
            j = jumps[i]
            if j == i:
                break
            i = j
        spread = np.empty((len(places), 4), np.int32)
        spread[:, 0] = places
        for k in range(3):
            spread[:, k + 1] = self.next.take(spread[:, k])
        flat = spread.ravel()[:most]
        stop = np.flatnonzero(self.steps.take(flat) == 0) if len(flat) else flat
        if len(stop):
            flat = flat[: stop[0]]
        if not len(flat):
            return np.zeros(0, np.int16), at
        last = int(flat[-1])
        end = last + int(self.steps[last])
        if end > self.last:
            raise Malformed("the stream ends early")
        return self.symbols.take(flat), self.base + end


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, ARGB in 32 bits."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Malformed("a colour cache of more than 11 bits")
    groups, group_bits, of = 1, 0, None
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = (width + (1 << group_bits) - 1) >> group_bits
        down = (height + (1 << group_bits) - 1) >> group_bits
        of = (_pixels(bits, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(down, across)
        groups = int(of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (GREENS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_size and all(c.single is not None for c in codes[0][1:4]) and codes[0][0].single is None:
        return _simple_pixels(bits, codes[0], width, total)
    out: list[int] = []
    cache = [0] * cache_size
    shift = 32 - cache_bits
    group = codes[0]
    while len(out) < total:
        if of is not None:
            y, x = divmod(len(out), width)
            group = codes[int(of[y >> group_bits, x >> group_bits])]
        s = group[0].read(bits)
        if s < GREENS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < GREENS + LENGTHS:
            length = _value(bits, s - GREENS)
            back = _distance(_value(bits, group[4].read(bits)), width)
            if back > len(out) or len(out) + length > total:
                raise Malformed("a back-reference outside the image")
            start = len(out) - back
            new = [out[start + k % back] for k in range(length)]
        else:
            new = [cache[s - GREENS - LENGTHS]]
        out += new
        if cache_size:
            for argb in new:
                cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
    return np.array(out, np.uint32)


def _simple_pixels(bits: Bits, group: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels whose green alone varies: literals in bulk, back-references one by one."""
    rest = np.uint32(group[3].single << 24 | group[1].single << 16 | group[2].single)
    green = np.empty(total, np.uint8)
    at, walk = 0, _Walk(bits, group[0])
    while at < total:
        if not walk.covers(bits.at):
            walk = _Walk(bits, group[0])
        found, bits.at = walk.literals(bits.at, total - at)
        green[at : at + len(found)] = found
        at += len(found)
        if at == total:
            break
        if not walk.covers(bits.at):
            continue
        s = group[0].read(bits)
        if s < GREENS:
            raise Malformed("the stream ends early")
        length = _value(bits, s - GREENS)
        back = _distance(_value(bits, group[4].read(bits)), width)
        if back > at or at + length > total:
            raise Malformed("a back-reference outside the image")
        own = green[at - back : min(at, at - back + length)]
        green[at : at + length] = np.resize(own, length)
        at += length
    return green.astype(np.uint32) << np.uint32(8) | rest


def _bytes(argb: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)


def _predict(mode: int, left: list[int], up: list[int], up_left: list[int], up_right: list[int]) -> list[int]:
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode in (1, 2, 3, 4):
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, up_right), up)
    if mode in (6, 7, 8, 9):
        return mean(*((left, up_left), (left, up), (up_left, up), (up, up_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, up_left), mean(up, up_right))
    if mode == 11:
        to_left = sum(abs(u - ul) for u, ul in zip(up, up_left, strict=True))
        to_up = sum(abs(x - ul) for x, ul in zip(left, up_left, strict=True))
        return left if to_left < to_up else up
    if mode == 12:
        return [clamp(x + u - ul) for x, u, ul in zip(left, up, up_left, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - ul) / 2)) for m, ul in zip(mean(left, up), up_left, strict=True)]
    return [0, 0, 0, 255]


def _undo_predict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    rows = _bytes(argb).astype(int).tolist()
    for y in range(height):
        for x in range(width):
            if not y:
                guess = rows[0][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = rows[y - 1][0]
            else:
                above = rows[y - 1]
                # Past the right edge comes the first pixel of the row itself.
                up_right = above[x + 1] if x + 1 < width else rows[y][0]
                guess = _predict(int(modes[y >> bits, x >> bits]), rows[y][x - 1], above[x], above[x - 1], up_right)
            rows[y][x] = [(p + g) & 255 for p, g in zip(rows[y][x], guess, strict=True)]
    return np.array(rows, np.uint8).reshape(height, width, 4).view(np.uint32)[..., 0]


def _undo_cross(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    f = _bytes(factors).view(np.int8).astype(np.int32).repeat(1 << bits, 0).repeat(1 << bits, 1)[:height, :width]
    p = _bytes(argb).copy()
    signed = lambda c: c.view(np.int8).astype(np.int32)
    green = signed(np.ascontiguousarray(p[..., 1]))
    red = (p[..., 2] + (f[..., 0] * green >> 5)).astype(np.uint8)
    blue = (p[..., 0] + (f[..., 1] * green >> 5) + (f[..., 2] * signed(red) >> 5)).astype(np.uint8)
    p[..., 2], p[..., 0] = red, blue
    return p.view(np.uint32)[..., 0]


def _undo_palette(argb: np.ndarray, table: np.ndarray, pack: int, width: int) -> np.ndarray:
    green = _bytes(argb)[..., 1]
    size = 8 >> pack
    if pack:
        parts = [green >> (size * k) & ((1 << size) - 1) for k in range(1 << pack)]
        green = np.stack(parts, axis=-1).reshape(len(green), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[green]


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP: height x width x (red, green, blue, alpha), 8 bits each."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Malformed("not a WebP file")
    at, body = 12, None
    while at + 8 <= len(data) and body is None:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if body is None or not body or body[0] != SIGNATURE:
        raise Malformed("no lossless image in it")
    bits = Bits(body)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Malformed("an unknown version")
    now, steps, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Malformed("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICT, CROSS):
            size = bits.read(3) + 2
            across, down = (now + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            tiles = _pixels(bits, across, down, False).reshape(down, across)
            steps.append((kind, tiles >> np.uint32(8) & np.uint32(15) if kind == PREDICT else tiles, size, now))
        elif kind == PALETTE:
            count = bits.read(8) + 1
            table = np.cumsum(_bytes(_pixels(bits, count, 1, False)), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            steps.append((kind, table, pack, now))
            now = (now + (1 << pack) - 1) >> pack
        else:
            steps.append((kind, None, 0, now))
    argb = _pixels(bits, now, height, True).reshape(height, now)
    for kind, extra, size, wide in reversed(steps):
        if kind == PREDICT:
            argb = _undo_predict(argb, extra, size)
        elif kind == CROSS:
            argb = _undo_cross(argb, extra, size)
        elif kind == PALETTE:
            argb = _undo_palette(argb, extra, size, wide)
        else:
            p = _bytes(argb).copy()
            p[..., 0] += p[..., 1]
            p[..., 2] += p[..., 1]
            argb = p.view(np.uint32)[..., 0]
    return _bytes(argb)[..., [2, 1, 0, 3]]


# Writing.


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def optimal(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Huffman code lengths of at most `longest` bits; counts are halved until they fit."""
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (both := a[2] + b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], both))
        if max(depth.values()) <= longest:
            return depth
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


def _tokens(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (token, extra value, extra bits), with runs of zeros."""
    out, i = [], 0
    while i < len(lengths):
        run = i
        while run < len(lengths) and not lengths[run]:
            run += 1
        zeros = run - i
        while zeros >= 11:
            n = min(zeros, 138)
            out.append((18, n - 11, 7))
            zeros -= n
        if zeros >= 3:
            out.append((17, zeros - 3, 3))
            zeros = 0
        out += [(0, 0, 0)] * zeros
        i = run
        if i < len(lengths):
            out.append((lengths[i], 0, 0))
            i += 1
    return out


def put_code(w: Writer, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Write the optimal code for counts; (codes, lengths) by symbol."""
    counts = counts or {0: 1}
    top = max(counts)
    lengths = np.zeros(top + 1, np.int64)
    if len(counts) <= 2 and top < 256:
        symbols = sorted(counts)
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.put(int(wide), 1)
        w.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
            lengths[symbols] = 1
        return canonical(lengths), lengths
    if len(counts) == 1:
        counts = counts | {0: 1}
    for s, n in optimal(counts, 15).items():
        lengths[s] = n
    tokens = _tokens(lengths.tolist())
    use: dict[int, int] = {}
    for t, _, _ in tokens:
        use[t] = use.get(t, 0) + 1
    if len(use) == 1:
        use = use | {next(t for t in (1, 2) if t not in use): 1}
    own = np.zeros(19, np.int64)
    for s, n in optimal(use, 7).items():
        own[s] = n
    last = max(i for i, s in enumerate(LENGTH_ORDER) if own[s])
    w.put(0, 1)
    w.put(max(0, last - 3), 4)
    for i in range(max(4, last + 1)):
        w.put(int(own[LENGTH_ORDER[i]]), 3)
    w.put(1, 1)  # only so many tokens follow; the other symbols have none
    size = max(1, ((len(tokens) - 2).bit_length() + 1) // 2) if len(tokens) > 2 else 1
    w.put(size - 1, 3)
    w.put(max(0, len(tokens) - 2), 2 * size)
    if len(tokens) < 2:
        tokens = tokens + [(0, 0, 0)]
    codes = canonical(own)
    for t, value, n in tokens:
        w.put(int(codes[t]), int(own[t]))
        w.put(value, n)
    return canonical(lengths), lengths


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code of a length or distance, its extra value and extra bits."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    half = v >> (high - 1) & 1
    return 2 * high + half, v & ((1 << (high - 1)) - 1), high - 1


def copies(data: bytes, least: int = 24) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that occurred before and of runs of zeros, in order."""
    out: list[tuple[int, int, int]] = []
    end = len(data.rstrip(b"\0"))
    seen: dict[bytes, int] = {}
    at = 0
    for line in data[:end].split(b"\n"):
        size = len(line)
        if size >= least:
            known = seen.get(line)
            if known is None:
                seen[line] = at
            else:
                n = size + (at + size < end and data[known + size : known + size + 1] == b"\n")
                if out and out[-1][0] + out[-1][1] == at and out[-1][2] == at - known:
                    out[-1] = (out[-1][0], out[-1][1] + n, out[-1][2])
                else:
                    out.append((at, n, at - known))
        at += size + 1
    if len(data) - end >= 8:
        out.append((end + 1, len(data) - end - 1, 1))
    return [(p + k, min(LONGEST, n - k), d) for p, n, d in out for k in range(0, n, LONGEST)]


def _stream(w: Writer, green: np.ndarray, refs: list[tuple[int, int, int]], alpha: int) -> bytes:
    """The entropy-coded main image after what w holds, as bytes."""
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of codes
    literal = np.ones(len(green), bool)
    coded = []
    for p, n, d in refs:
        literal[p : p + n] = False
        coded.append((p, _prefix(n), _prefix(d + len(NEAR))))
    counts = np.bincount(green[literal], minlength=256)
    greens = {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    distances: dict[int, int] = {}
    for _, (a, _, _), (b, _, _) in coded:
        greens[GREENS + a] = greens.get(GREENS + a, 0) + 1
        distances[b] = distances.get(b, 0) + 1
    codes, sizes = put_code(w, greens)
    put_code(w, {0: 1})
    put_code(w, {0: 1})
    put_code(w, {alpha: 1})
    far_codes, far_sizes = put_code(w, distances)
    out = bytearray((w.value & ((1 << (w.size & ~31)) - 1)).to_bytes((w.size & ~31) >> 3, "little"))
    w.value, w.size = w.value >> (w.size & ~31), w.size & 31
    ref = 0
    for first in range(0, len(green), CHUNK):
        own = literal[first : first + CHUNK]
        kept = green[first : first + CHUNK][own]
        values, lengths = codes[kept], sizes[kept]
        if ref < len(coded) and coded[ref][0] < first + CHUNK:
            places = np.cumsum(own)
            at, more, more_n = [], [], []
            while ref < len(coded) and coded[ref][0] < first + CHUNK:
                p, (a, av, an), (b, bv, bn) = coded[ref]
                here = int(places[p - first - 1]) if p > first else 0
                at += [here] * 4
                more += [int(codes[GREENS + a]), av, int(far_codes[b]), bv]
                more_n += [int(sizes[GREENS + a]), an, int(far_sizes[b]), bn]
                ref += 1
            values, lengths = np.insert(values, at, more), np.insert(lengths, at, more_n)
        out += _packed(w, values, lengths)
    return bytes(out + w.value.to_bytes((w.size + 7) >> 3, "little"))


#: Samples whose codes are put together at a time.
CHUNK = 1 << 18


def _packed(w: Writer, values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Whole bytes of what w holds (up to 31 bits) and values of these lengths behind it; the rest stays in w."""
    bit = np.cumsum(lengths)
    start = bit - lengths + w.size
    total = w.size + (int(bit[-1]) if len(bit) else 0)
    word, shift = start >> 5, start & 31
    shifted = values << shift
    count = (total + 31 >> 5) + 2
    low = np.bincount(word, weights=shifted & 0xFFFFFFFF, minlength=count)
    low[1:] += np.bincount(word, weights=shifted >> 32, minlength=count)[:-1]
    whole = low.astype(np.uint64)
    whole[0] |= np.uint64(w.value)
    body = whole.astype("<u4").tobytes()
    w.size = total & 7
    w.value = body[total >> 3] & ((1 << w.size) - 1)
    return body[: total >> 3]


def encode(payload: bytes) -> bytes:
    """A lossless WebP whose grey samples, row by row, are the payload (and zeros up to a whole row)."""
    width = 64 * max(1, -(-len(payload) // (64 * 16384)))
    if width > 16384:
        raise ValueError("more than 2**28 samples")
    height = max(1, -(-len(payload) // width))
    data = payload.ljust(width * height, b"\0")
    samples = np.frombuffer(data, np.uint8)
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    table = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(table) <= 16:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(table) - 1, 8)
        _put_table(w, table)
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
        size = 8 >> pack
        index = np.searchsorted(table, samples).reshape(-1, 1 << pack)
        green = (index << (size * np.arange(1 << pack))).sum(axis=1).astype(np.uint8)
        refs = copies(green.tobytes())
    else:
        w.put(1, 1)
        w.put(SUBTRACT, 2)
        green, refs = samples, copies(data)
    w.put(0, 1)
    body = _stream(w, green, refs, 255)
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _put_table(w: Writer, table: np.ndarray) -> None:
    """A palette of opaque greys, each as its difference from the one before."""
    deltas = np.diff(table, prepend=0).tolist()
    w.put(0, 1)
    counts: dict[int, int] = {}
    for d in deltas:
        counts[d] = counts.get(d, 0) + 1
    grey = [put_code(w, counts) for _ in range(3)]
    alpha = put_code(w, {255: 1, 0: 1} if len(deltas) > 1 else {255: 1})
    put_code(w, {})
    for i, d in enumerate(deltas):
        for codes, sizes in grey:
            w.put(int(codes[d]), int(sizes[d]))
        a = 0 if i else 255
        w.put(int(alpha[0][a]), int(alpha[1][a]))


# Columns.


def with_pixels(df: DataFrame, column: str) -> tuple[DataFrame, dict[str, str]]:
    """df with width, height, pixels (RGBA bytes, row by row) and error of the WebP in a binary column; the new names."""
    names = {c: fresh(df, c) for c in ("width", "height", "pixels", "error")}
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches, column):
            rows = []
            for data in part.column(column).to_pylist():
                try:
                    pixels = decode(data) if data is not None else None
                    rows.append((None, None, None, None) if pixels is None else (pixels.shape[1], pixels.shape[0], pixels.tobytes(), None))
                except Malformed as e:
                    rows.append((None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names.values()])

    kinds = (T.IntegerType(), T.IntegerType(), T.BinaryType(), T.StringType())
    shape = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names.values(), kinds, strict=True))])
    return df.mapInArrow(run, shape), names


def stored(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df with the WebP that stores its text's bytes (and zeros up to a positive multiple of 64), and its column."""
    name = fresh(df, "media")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches, text):
            media = [encode(payload_of(t)) for t in part.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])), name


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def feature(rows: int, columns: int, counts: np.ndarray) -> str:
    """Rows, mean, deviation and entropy of samples, from how often each value occurs."""
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean * mean)))
    some = p[p > 0]
    return f"{rows}x{columns} mean={mean:.4f} dev={deviation:.4f} entropy={abs(float(some @ np.log2(some))):.4f}"


SHAPE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as WebP, read back, and what was read: sizes, digests, features."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            rows = []
            for raw in part.column("text").cast(pa.binary()).to_pylist():
                payload = payload_of(raw)
                media = encode(payload)
                pixels = decode(media)
                samples = np.ascontiguousarray(pixels[..., 0])
                back = samples.tobytes()[: len(payload)]
                told = feature(*samples.shape, np.bincount(samples.ravel(), minlength=256))
                rows.append((len(raw or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), told))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=[c.split()[0] for c in SHAPE.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SHAPE)
