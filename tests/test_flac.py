"""FLAC streams written here, bit by bit, and read back."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pytest

from weft.sources import readers
from weft.sources.flac import FlacError, crc8, crc16, decode_flac, whole_samples


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        value &= (1 << n) - 1
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def data(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def rice(w, values, order, size, parts, k, escape):
    w.put(k > 14, 2)
    width = 5 if k > 14 else 4
    w.put(parts, 4)
    at = 0
    for p in range(1 << parts):
        own = values[at : at + (size >> parts) - (order if p == 0 else 0)]
        at += len(own)
        if escape and p % 2:
            n = max([1, *(int(v).bit_length() + 1 for v in np.abs(own))])
            w.put((1 << width) - 1, width)
            w.put(n, 5)
            for v in own:
                w.put(int(v), n)
            continue
        w.put(k, width)
        for v in own:
            folded = int(v) * 2 if v >= 0 else -int(v) * 2 - 1
            w.bits += [0] * (folded >> k) + [1]
            w.put(folded, k)


def subframe(w, x, depth, kind, parts=0, k=3, escape=False, wasted=0, factors=(), shift=0):
    w.put(0, 1)
    w.put({"constant": 0, "verbatim": 1}.get(kind, (31 + len(factors)) if kind == "linear" else 8 + (kind if isinstance(kind, int) else 0)), 6)
    w.put(bool(wasted), 1)
    if wasted:
        w.put(1, wasted)
        x, depth = x >> wasted, depth - wasted
    if kind == "constant":
        w.put(int(x[0]), depth)
    elif kind == "verbatim":
        for v in x:
            w.put(int(v), depth)
    else:
        order = len(factors) if kind == "linear" else kind
        for v in x[:order]:
            w.put(int(v), depth)
        if kind == "linear":
            w.put(9, 4)
            w.put(shift, 5)
            for f in factors:
                w.put(f, 10)
            residual = [int(x[i]) - (sum(int(f) * int(x[i - 1 - j]) for j, f in enumerate(factors)) >> shift) for i in range(order, len(x))]
        else:
            residual = np.diff(x, order)
        rice(w, np.array(residual, np.int64), order, len(x), parts, k, escape)


def frame(number, blocks, depth, layout, options):
    size = len(blocks[0])
    w = Writer()
    w.put(0x3FFE, 14)
    w.put(0, 2)
    w.put(7, 4)
    w.put(13, 4)
    w.put(layout, 4)
    w.put({8: 1, 16: 4, 24: 6}[depth], 3)
    w.put(0, 1)
    for b in chr(number).encode():
        w.put(b, 8)
    w.put(size - 1, 16)
    w.put(16000, 16)
    w.put(crc8(w.data()), 8)
    if layout >= 8:
        left, right = blocks
        blocks = {8: (left, left - right), 9: (left - right, right), 10: ((left + right) >> 1, left - right)}[layout]
    for c, x in enumerate(blocks):
        subframe(w, x, depth + (c == {8: 1, 9: 0, 10: 1}.get(layout)), **options)
    data = w.data()
    return data + struct.pack(">H", crc16(data))


def stream(x, depth=16, size=64, layout=None, rate=16000, known=True, **options):
    """x: samples by channels; options as of subframe."""
    options.setdefault("kind", 2)
    layout = x.shape[1] - 1 if layout is None else layout
    frames = b"".join(frame(n, [x[a : a + size, c] for c in range(x.shape[1])], depth, layout, options) for n, a in enumerate(range(0, len(x), size)))
    raw = x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : depth // 8].tobytes()
    packed = rate << 44 | (x.shape[1] - 1) << 41 | (depth - 1) << 36 | (len(x) if known else 0)
    info = struct.pack(">HH", size, size) + bytes(6) + packed.to_bytes(8, "big") + (hashlib.md5(raw).digest() if known else bytes(16))
    comment = b"\x84" + (5).to_bytes(3, "big") + b"hello"
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + comment + frames


def wave(n, channels=1, depth=16, seed=0):
    draw = np.random.default_rng(seed)
    t = np.arange(n)[:, None] + 3 * np.arange(channels)
    top = 1 << (depth - 2)
    return (np.sin(t / 9) * top * 0.6 + draw.integers(-top // 99 - 1, top // 99 + 1, (n, channels))).astype(np.int64)


@pytest.mark.parametrize("options", [
    {"kind": "verbatim"}, *({"kind": k, "k": 6} for k in range(5)), {"kind": 1, "parts": 3, "k": 5}, {"kind": 2, "parts": 2, "escape": True}, {"kind": 2, "k": 16},
    {"kind": "linear", "factors": (500, -300, 40), "shift": 8, "k": 7}, {"kind": "linear", "factors": tuple(range(-16, 16)), "shift": 5, "k": 8, "parts": 1},
])
@pytest.mark.parametrize(("channels", "layout", "depth"), [(1, None, 16), (2, 8, 16), (2, 9, 8), (2, 10, 24), (3, None, 16)])
def test_samples_come_back_whole(options, channels, layout, depth):
    x = wave(256, channels, depth)
    got, rate, own = whole_samples(stream(x, depth, layout=layout, **options))
    assert (rate, own) == (16000, depth) and np.array_equal(got, x)


def test_wasted_bits_constants_and_odd_ends():
    x = (wave(150) >> 3) << 3
    assert np.array_equal(whole_samples(stream(x, kind=2, wasted=3))[0], x)
    assert np.array_equal(whole_samples(stream(x, kind=2, wasted=3, known=False))[0], x)
    flat = np.full((70, 2), -5)
    assert np.array_equal(whole_samples(stream(flat, kind="constant", known=False))[0], flat)
    values, rate = decode_flac(stream(x), seconds=0.005)
    assert rate == 16000 and values.shape == (80,) and np.allclose(values, x[:80, 0] / 32768)


def test_damage_is_told():
    data = stream(wave(200))
    for broken in (b"", b"RIFF", data[:20], data[:-1], data[:60] + bytes([data[60] ^ 4]) + data[61:], data[:-9] + bytes([data[-9] ^ 1]) + data[-8:]):
        with pytest.raises(FlacError):
            whole_samples(broken)
    wrong = bytearray(data)
    wrong[30] ^= 1  # the MD5
    with pytest.raises(FlacError, match="MD5"):
        whole_samples(bytes(wrong))


def test_rates_of_sines():
    t = np.arange(4410) / 44100
    got = readers.resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32), 44100, 16000)
    want = np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert len(got) == 1600 and np.abs(got[60:-60] - want[60:-60]).max() < 2e-3
    up = readers.resampled(np.sin(2 * np.pi * 440 * np.arange(800) / 8000).astype(np.float32), 8000, 16000)
    assert len(up) == 1600 and np.abs(up[60:-60] - want[60:-60]).max() < 2e-3
    high = readers.resampled(np.sin(2 * np.pi * 15000 * t).astype(np.float32), 44100, 16000)
    assert np.abs(high[60:-60]).max() < 0.01  # above the new bound
    assert len(readers.resampled(np.zeros(0, np.float32), 8000, 16000)) == 0


def test_speech_clips_with_their_texts(spark, tmp_path):
    (tmp_path / "1" / "2").mkdir(parents=True)
    here = tmp_path / "1" / "2"
    x = wave(1600, 2)
    (here / "1-2-0000.flac").write_bytes(stream(x, size=160, layout=10))
    (here / "1-2-0001.flac").write_bytes(stream(wave(4000), size=400))
    (here / "1-2-0002.flac").write_bytes(b"broken")
    (here / "1-2-0003.flac").write_bytes(stream(wave(320), size=160, rate=8000))
    (here / "1-2-0004.flac").write_bytes(stream(wave(160), size=160))
    (here / "1-2.trans.txt").write_text("1-2-0000 FIRST WORDS\n1-2-0001 TOO LONG\n1-2-0002 BROKEN\n1-2-0003 SLOW ONE\n1-2-0004\n1-2-0009 NO CLIP\n")
    read = {r.uid: r for r in readers.load(spark, "flac", str(tmp_path), most_seconds=0.2).collect()}
    assert sorted(read) == ["1-2-0000", "1-2-0002", "1-2-0003", "1-2-0004"]
    assert read["1-2-0002"].samples is None and "FLAC" in read["1-2-0002"].problem
    assert np.allclose(read["1-2-0000"].samples, x.mean(1) / 32768, atol=1e-6) and read["1-2-0000"].seconds == 0.1
    assert len(read["1-2-0003"].samples) == 640 and read["1-2-0003"].rate == 16000
    clips = readers.load(spark, "speech", str(tmp_path), most_seconds=0.2).collect()
    assert {r.uid: r.text for r in clips} == {"1-2-0000": "FIRST WORDS", "1-2-0003": "SLOW ONE"}
