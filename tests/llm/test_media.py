import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm import media_webp as m

from .data import corpus, frame


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.integers(1, 6))
def test_round_trip(data, times):
    payload = m.payload_of(data * times)
    pixels = m.decode(m.encode(payload))
    assert pixels[..., 0].tobytes()[: len(payload)] == payload
    assert (pixels[..., 0] == pixels[..., 2]).all() and (pixels[..., 3] == 255).all()


def test_near_pixels_by_distance():
    assert len(m.NEAR) == 120 and m.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]


# A writer of streams that use what encode() does not: transforms, caches, code groups, four live channels.


def put_all(w, argb, width, cache_bits=0, groups=None, group_bits=2):
    """Entropy-coded main image: literals, cache hits and copies of the pixel above or before."""
    cache, symbols = {}, []
    i = 0
    while i < len(argb):
        n = 0
        while i >= width and i + n < len(argb) and n < 9 and argb[i + n] == argb[i + n - width]:
            n += 1
        slot = (m.CACHE_FACTOR * int(argb[i]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if n >= 3 and groups is None:
            symbols.append(("copy", i, n))
        elif cache_bits and cache.get(slot) == int(argb[i]):
            symbols.append(("hit", i, slot))
            n = 1
        else:
            symbols.append(("pixel", i, int(argb[i])))
            n = 1
        for k in range(n):
            if cache_bits:
                cache[(m.CACHE_FACTOR * int(argb[i + k]) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(argb[i + k])
        i += n
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    count = 1
    of = lambda i: 0
    if groups is not None:
        w.put(1, 1)
        w.put(group_bits - 2, 3)
        put_sub(w, [int(g) << 8 for g in groups.ravel()])
        count = int(groups.max()) + 1
        of = lambda i: int(groups[i // width >> group_bits, i % width >> group_bits])
    else:
        w.put(0, 1)
    counts = [[{} for _ in range(5)] for _ in range(count)]
    add = lambda d, s: d.__setitem__(s, d.get(s, 0) + 1)
    for kind, i, v in symbols:
        c = counts[of(i)]
        if kind == "pixel":
            for d, shift in zip(c, (8, 16, 0, 24)):
                add(d, v >> shift & 255)
        elif kind == "hit":
            add(c[0], 280 + v)
        else:
            add(c[0], 256 + m._prefix(v)[0])
            add(c[4], m._prefix(1)[0])
    codes = [[m.put_code(w, d) for d in c] for c in counts]
    for kind, i, v in symbols:
        c = codes[of(i)]
        put = lambda pair, s: w.put(int(pair[0][s]), int(pair[1][s]))
        if kind == "pixel":
            for pair, shift in zip(c, (8, 16, 0, 24)):
                put(pair, v >> shift & 255)
        elif kind == "hit":
            put(c[0], 280 + v)
        else:
            prefix, extra, n = m._prefix(v)
            put(c[0], 256 + prefix)
            w.put(extra, n)
            put(c[4], 0)  # distance code 1: the pixel above


def put_sub(w, argb):
    w.put(0, 1)
    counts = [{} for _ in range(4)]
    for v in argb:
        for d, shift in zip(counts, (8, 16, 0, 24)):
            d[v >> shift & 255] = d.get(v >> shift & 255, 0) + 1
    codes = [m.put_code(w, d) for d in counts] + [m.put_code(w, {})]
    for v in argb:
        for pair, shift in zip(codes, (8, 16, 0, 24)):
            w.put(int(pair[0][v >> shift & 255]), int(pair[1][v >> shift & 255]))


def head(width, height):
    w = m.Writer()
    for value, n in ((m.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def file_of(w):
    body = w.value.to_bytes(w.size // 8 + 1, "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def picture(width, height, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    p[height // 2 :] = p[: height - height // 2]
    p[:, ::3] = p[:, :1]
    return p


def as_argb(p):
    p = p.astype(np.uint32)
    return (p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]).astype(np.uint32)


@pytest.mark.parametrize("cache_bits", [0, 4])
@pytest.mark.parametrize("grouped", [False, True])
def test_caches_copies_and_groups(cache_bits, grouped):
    p = picture(13, 11)
    w = head(13, 11)
    w.put(0, 1)
    groups = np.random.default_rng(3).integers(0, 3, (3, 4)) if grouped else None
    put_all(w, as_argb(p).ravel(), 13, cache_bits, groups)
    assert (m.decode(file_of(w)) == p).all()


def forward_predict(p, modes, bits):
    out = p.copy()
    height, width = p.shape[:2]
    rows = p[..., [2, 1, 0, 3]].astype(int).tolist()
    for y in range(height):
        for x in range(width):
            if not y:
                guess = rows[0][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = rows[y - 1][0]
            else:
                right = rows[y - 1][x + 1] if x + 1 < width else rows[y][0]
                guess = m._predict(int(modes[y >> bits, x >> bits]), rows[y][x - 1], rows[y - 1][x], rows[y - 1][x - 1], right)
            out[y, x] = [(a - b) & 255 for a, b in zip(p[y, x].astype(int), [guess[2], guess[1], guess[0], guess[3]])]
    return out


def test_predictor_modes():
    p = picture(16, 16, 2)
    modes = np.arange(16).reshape(4, 4) % 14
    w = head(16, 16)
    w.put(1, 1)
    w.put(m.PREDICT, 2)
    w.put(0, 3)
    put_sub(w, [int(v) << 8 for v in modes.ravel()])
    w.put(0, 1)
    put_all(w, as_argb(forward_predict(p, modes, 2)).ravel(), 16)
    assert (m.decode(file_of(w)) == p).all()
    # Known values of the arithmetic.
    assert m._predict(12, [250, 0, 9, 1], [10, 3, 9, 1], [0, 9, 9, 1], [0] * 4) == [255, 0, 9, 1]
    assert m._predict(11, [10, 0, 0, 0], [20, 0, 0, 0], [19, 0, 0, 0], [0] * 4) == [10, 0, 0, 0]
    assert m._predict(13, [10] * 4, [21] * 4, [20] * 4, [0] * 4) == [13] * 4


def test_cross_colour_and_subtract_green():
    p = picture(9, 7, 4)
    bits, factors = 2, np.array([[0x00F31405, 0x00107FEE, 0x00800280], [0x00000000, 0x00FF01FF, 0x007F8001]], np.uint32)
    signed = lambda v: int(v) - 256 if v > 127 else int(v)
    q = p.copy()
    for y in range(7):
        for x in range(9):
            f = int(factors[y >> bits, x >> bits])
            r, g, b, _ = map(int, p[y, x])
            to_red, to_blue, red_blue = signed(f & 255), signed(f >> 8 & 255), signed(f >> 16 & 255)
            q[y, x, 0] = (r - (to_red * signed(g) >> 5)) & 255
            q[y, x, 2] = (b - (to_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5)) & 255
    q[..., 0] -= q[..., 1]
    q[..., 2] -= q[..., 1]
    w = head(9, 7)
    w.put(1, 1)
    w.put(m.CROSS, 2)
    w.put(bits - 2, 3)
    put_sub(w, [int(v) for v in factors.ravel()])
    w.put(1, 1)
    w.put(m.SUBTRACT, 2)
    w.put(0, 1)
    put_all(w, as_argb(q).ravel(), 9, 3)
    assert (m.decode(file_of(w)) == p).all()


@pytest.mark.parametrize("colours", [2, 4, 16, 40])
def test_packed_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    index = rng.integers(0, colours, (6, 13))
    pack = {2: 3, 4: 2, 16: 1, 40: 0}[colours]
    wide = -(-13 // (1 << pack))
    padded = np.zeros((6, wide << pack), int)
    padded[:, :13] = index
    green = (padded.reshape(6, wide, 1 << pack) << ((8 >> pack) * np.arange(1 << pack))).sum(-1)
    w = head(13, 6)
    w.put(1, 1)
    w.put(m.PALETTE, 2)
    w.put(colours - 1, 8)
    put_sub(w, as_argb(np.diff(table.astype(int), axis=0, prepend=0).astype(np.uint8)).tolist())
    w.put(0, 1)
    put_all(w, (green << 8 | 0xFF000000).ravel().astype(np.uint32), wide)
    assert (m.decode(file_of(w)) == table[index]).all()


def test_malformed_files():
    good = m.encode(m.payload_of(b"some text that is long enough to have codes " * 9))
    for bad in (b"", b"RIFFxxxxWEBP", good[:60], good[:-20], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(m.Malformed):
            m.decode(bad)


def test_columns(spark):
    rows = corpus()
    docs = frame(spark).withColumn("media", F.lit(1))
    media, name = m.stored(docs)
    assert name != "media"
    back, names = m.with_pixels(media.withColumn("width", F.lit(0)), name)
    for r in back.collect():
        samples = np.frombuffer(r[names["pixels"]], np.uint8).reshape(-1, 4)[:, 0].tobytes()
        assert samples.rstrip(b"\0") == (r.text or "").encode().rstrip(b"\0") and r[names["error"]] is None
    import hashlib
    import zlib

    got = {r.doc_id: r for r in m.digests(frame(spark)).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    bad = spark.createDataFrame([(b"junk",), (None,)], "b binary")
    out, names = m.with_pixels(bad, "b")
    assert sorted((r.pixels is None, r.error is None) for r in out.collect()) == [(True, False), (True, True)]
    assert m.digests(frame(spark, empty=True)).count() == 0


def test_windows_and_chunks(monkeypatch):
    """Streams that are written and read in many small pieces are the ones written and read in one."""
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(60)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 60, n)) for n in (1, 40, 900, 3000)]
    line = b"a line that comes again and again and again"
    texts += [b"\n".join([line, t[:300], line, line]) * 3 for t in texts] + [bytes(rng.integers(0, 256, 5000).astype(np.uint8)), b"ab" * 3000]
    whole = [m.encode(m.payload_of(t)) for t in texts]
    for window, chunk in ((5, 64), (64, 7), (1000, 1000), (1 << 18, 1)):
        monkeypatch.setattr(m, "WINDOW", window)
        monkeypatch.setattr(m, "CHUNK", chunk)
        for t, data in zip(texts, whole):
            assert m.encode(m.payload_of(t)) == data
            assert m.decode(data)[..., 0].tobytes().startswith(m.payload_of(t))
    monkeypatch.setattr(m, "WINDOW", 64)
    for bad in (whole[3][:-20], whole[3][:20] + b"\x00" + whole[3][21:]):
        with pytest.raises(m.Malformed):
            m.decode(bad)


def test_long_payloads_are_one_file(spark):
    import tracemalloc

    long = "0123456789abcde\n" * (1 << 17) + "".join(chr(97 + i * i % 23) for i in range(100_000)) + "é"
    rows = [(1, long, None, None, None), (2, None, None, None, None)]
    got = {r.doc_id: r for r in m.digests(frame(spark, rows)).collect()}
    raw = long.encode()
    payload = m.payload_of(raw)
    data = m.encode(payload)
    assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") + 8 == len(data)
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert got[1].tail_crc32 == zlib.crc32(payload[-64:]) and (got[1].media_bytes, got[1].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert got[1].feature.startswith(f"{-(-len(payload) // 192)}x192 ") and got[2].payload_bytes == 64
    media, name = m.stored(frame(spark, rows))
    back, names = m.with_pixels(media, name)
    r = back.where("doc_id = 1").first()
    assert r[names["width"]] == 192 and bytes(r[names["pixels"]])[::4][: len(payload)] == payload

    rng = np.random.default_rng(3)
    ten = m.payload_of(b"".join(bytes(rng.integers(32, 123, n).astype(np.uint8)) + b"\n" for n in rng.integers(1, 200, 100_000)))
    tracemalloc.start()
    assert m.decode(m.encode(ten))[..., 0].tobytes().startswith(ten)
    assert tracemalloc.get_traced_memory()[1] < 45 * len(ten) + (128 << 20)
    tracemalloc.stop()
