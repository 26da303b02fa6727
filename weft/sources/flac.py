"""FLAC: frames of predicted samples with Rice-coded residuals, read into numpy arrays.

Bits are unpacked once for each frame. The ends of unary parts are looked up in an array of the
next set bit, so a residual costs one step; remainders, warm-up samples and fixed predictors are
array operations, and only linear prediction runs sample by sample.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Block sizes and sample rates by their codes.
_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_LEFT_SIDE, _SIDE_RIGHT, _MID_SIDE = 8, 9, 10


class FlacError(ValueError):
    """Bytes that are no FLAC stream, or a damaged one."""


class _TooShort(FlacError):
    """The bits end within a frame."""


def _crc_table(polynomial: int, width: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ polynomial if value & top else value << 1) & mask
        out.append(value)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = _CRC8[value ^ b]
    return value


def crc16(data: bytes) -> int:
    value = 0
    for b in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC16[(value >> 8) ^ b]
    return value


class Bits:
    """Big-endian numbers from bytes, at any bit."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        self._next: list[int] | None = None

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise _TooShort("the stream ends within a frame")
        part = self.bits[self.at : self.at + n]
        self.at += n
        return int("".join(map(str, part.tolist())), 2) if n else 0

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def many(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n bits at the places."""
        if n == 0:
            return np.zeros(len(starts), np.int64)
        if len(starts) and int(starts.max()) + n > len(self.bits):
            raise _TooShort("the stream ends within a frame")
        out = np.zeros(len(starts), np.int64)
        for k in range(n):
            out = (out << 1) | self.bits[starts + k]
        return out

    def run(self, count: int, n: int) -> np.ndarray:
        """`count` signed numbers of n bits, one after another."""
        out = self.many(self.at + n * np.arange(count), n)
        self.at += n * count
        return np.where(out >> (n - 1) == 1, out - (1 << n), out) if n else out

    def unary(self) -> int:
        """Zeros before the next one."""
        begun = self.at
        self.at = self.ones()[begun] + 1 if begun < len(self.bits) else len(self.bits) + 1
        if self.at > len(self.bits):
            raise _TooShort("the stream ends within a frame")
        return self.at - 1 - begun

    def ones(self) -> list[int]:
        """For each bit the place of the next set bit, itself included."""
        if self._next is None:
            places = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
            self._next = np.minimum.accumulate(places[::-1])[::-1].tolist()
        return self._next

    def rice(self, count: int, k: int) -> np.ndarray:
        """`count` numbers: zeros up to a one, then k bits; the lowest bit is the sign."""
        following, at, ends, end = self.ones(), self.at, [], len(self.bits)
        for _ in range(count):
            one = following[at] if at < end else end
            ends.append(one)
            at = one + 1 + k
        if at > end:
            raise _TooShort("the stream ends within a frame")
        stops = np.array(ends, np.int64)
        starts = np.concatenate([[self.at], stops[:-1] + 1 + k])[: len(stops)]
        folded = ((stops - starts) << k) | self.many(stops + 1, k)
        self.at = at
        return (folded >> 1) ^ -(folded & 1)


def _residual(bits: Bits, size: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise FlacError("a reserved coding of residuals")
    width = 5 if method else 4
    parts = bits.take(4)
    if size >> parts << parts != size or size >> parts < order:
        raise FlacError("partitions do not divide the block")
    out = []
    for p in range(1 << parts):
        count = (size >> parts) - (order if p == 0 else 0)
        k = bits.take(width)
        out.append(bits.run(count, bits.take(5)) if k == (1 << width) - 1 else bits.rice(count, k))
    return np.concatenate(out)


def _fixed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undoes differences of the warm-up's order: each is a running sum from its last known value."""
    known = [warm]
    for _ in range(len(warm)):
        known.append(np.diff(known[-1]))
    out = residual
    for k in range(len(warm), 0, -1):
        out = np.cumsum(np.concatenate([known[k - 1][-1:], out]))[1:]
    return np.concatenate([warm, out])


def _linear(warm: np.ndarray, factors: np.ndarray, shift: int, residual: np.ndarray) -> np.ndarray:
    order = len(warm)
    out = np.concatenate([warm, residual]).astype(np.int64)
    back = factors[::-1].astype(np.int64)
    for i in range(order, len(out)):
        out[i] += int(out[i - order : i] @ back) >> shift
    return out


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise FlacError("padding before a subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        out = bits.run(size, depth)
    elif 8 <= kind <= 12:
        warm = bits.run(kind - 8, depth)
        out = _fixed(warm, _residual(bits, size, kind - 8))
    elif kind >= 32:
        order = kind - 31
        warm = bits.run(order, depth)
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise FlacError("a reserved predictor")
        factors = bits.run(order, precision)
        out = _linear(warm, factors, shift, _residual(bits, size, order))
    else:
        raise FlacError(f"a reserved subframe {kind}")
    return out << wasted


def _number(data: bytes, at: int) -> int:
    """The end of a number coded like a character of UTF-8."""
    first = data[at]
    if first < 0x80:
        return at + 1
    length = 0
    while first & (0x80 >> length):
        length += 1
    return at + length


def _subframes(data: bytes, at: int, size: int, depths: list[int]) -> tuple[Bits, list[np.ndarray]]:
    """Samples of each channel; bits are taken of as much as verbatim samples need, and of all if that ends too soon."""
    near = at + sum(depths) * size // 8 + 64
    for end in (near, len(data)):
        bits = Bits(data[at:end])
        try:
            return bits, [_subframe(bits, size, depth) for depth in depths]
        except _TooShort:
            if end >= len(data):
                raise
    raise _TooShort("the stream ends within a frame")


def _frame(data: bytes, at: int, depth: int, rate: int) -> tuple[np.ndarray, int]:
    """Samples (frames by channels) of the frame that begins there, and where the next begins."""
    if len(data) - at < 6 or data[at] != 0xFF or data[at + 1] >> 1 != 0x7C:
        raise FlacError("no frame where one should begin")
    size_code, rate_code, layout, depth_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    end = _number(data, at + 4)
    size = _SIZES.get(size_code)
    if size_code in (6, 7):
        size = int.from_bytes(data[end : end + size_code - 5], "big") + 1
        end += size_code - 5
    end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if size is None or rate_code == 15 or layout > _MID_SIDE or (depth_code and depth_code not in _BITS):
        raise FlacError("a reserved frame header")
    if end >= len(data) or crc8(data[at:end]) != data[end]:
        raise FlacError("a damaged frame header")
    depth = _BITS.get(depth_code, depth)
    channels = layout + 1 if layout < _LEFT_SIDE else 2
    side = {_LEFT_SIDE: 1, _SIDE_RIGHT: 0, _MID_SIDE: 1}.get(layout)
    bits, parts = _subframes(data, end + 1, size, [depth + (c == side) for c in range(channels)])
    if layout == _LEFT_SIDE:
        parts[1] = parts[0] - parts[1]
    elif layout == _SIDE_RIGHT:
        parts[0] = parts[0] + parts[1]
    elif layout == _MID_SIDE:
        middle, difference = (parts[0] << 1) | (parts[1] & 1), parts[1]
        parts = [(middle + difference) >> 1, (middle - difference) >> 1]
    stop = end + 1 + -(-bits.at // 8)
    if crc16(data[at:stop]) != int.from_bytes(data[stop : stop + 2], "big") or stop + 2 > len(data):
        raise FlacError("a damaged frame")
    return np.stack(parts, axis=1), stop + 2


def whole_samples(data: bytes, seconds: float | None = None) -> tuple[np.ndarray, int, int]:
    """Samples (frames by channels, whole numbers), rate and bits of a sample; frames behind
    `seconds` are not decoded. The stream's MD5, where it has one, is held against whole streams."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(data):
            raise FlacError("the stream ends within its head")
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        raise FlacError("no description of the stream")
    packed = int.from_bytes(info[10:18], "big")
    rate, depth, total = packed >> 44, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    channels = (packed >> 41 & 7) + 1
    most = None if seconds is None else int(seconds * rate)
    blocks, n = [], 0
    while at < len(data) and (most is None or n < most) and not (total and n >= total):
        block, at = _frame(data, at, depth, rate)
        blocks.append(block)
        n += len(block)
    out = np.concatenate(blocks) if blocks else np.zeros((0, channels), np.int64)
    if total:
        out = out[:total]
    if info[18:34] != bytes(16) and len(out) == total:
        width = -(-depth // 8)
        raw = out.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
        if hashlib.md5(raw).digest() != info[18:34]:
            raise FlacError("samples do not have the stream's MD5")
    return (out if most is None else out[:most]), rate, depth


def decode_flac(data: bytes, seconds: float | None = None) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 (frames, or frames by channels) and the rate."""
    samples, rate, depth = whole_samples(data, seconds)
    values = (samples / float(1 << (depth - 1))).astype(np.float32)
    return (values[:, 0] if values.shape[1] == 1 else values), rate
