"""Pictures and sound as numpy arrays: PNG, log-mel pages, crops, tiles, comparisons."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

GREY = 128
SAMPLE_RATE, N_FFT, HOP, N_MELS = 16_000, 400, 160, 80


def png(pixels: np.ndarray, level: int = 1) -> bytes:
    """A grey picture (height, width) of bytes as PNG."""
    height, width = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.hstack([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


#: Samples of a pixel by the colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows (height, 1 + bytes), each stored as differences by the filter of its first byte."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("an unknown row filter")
    above = np.zeros(out.shape[1], np.uint8)
    for k, kind in enumerate(kinds.tolist()):
        row = out[k]
        if kind == 1:  # left: a running sum of each byte of the pixels
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:  # above
            row += above
        elif kind in (3, 4):
            now, up, left, corner = row.tolist(), above.tolist(), [0] * step, [0] * step
            for i in range(len(now)):
                j, b = i % step, up[i]
                a, c = left[j], corner[j]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = left[j] = (now[i] + guess) & 255
                corner[j] = b
            row[:] = now
        above = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG, (height, width) or with colours as a third axis: grey, grey and alpha, RGB, RGBA,
    or a palette's RGB; all bit depths, of 16 bits the upper eight. Interlaced ones are refused."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 33:
        raise ValueError("no PNG")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if interlaced or colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("an interlaced PNG, or one of no known kind")
    at, body, palette = 8, [], b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        elif kind == b"PLTE":
            palette = data[at + 8 : at + 8 + size]
        at += size + 12
    samples = _SAMPLES[colour]
    length = -(-width * samples * depth // 8)
    raw = zlib.decompress(b"".join(body))
    if len(raw) < height * (length + 1):
        raise ValueError("a PNG that ends too soon")
    flat = _unfiltered(np.frombuffer(raw, np.uint8)[: height * (length + 1)].reshape(height, length + 1), max(1, samples * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1)[:, : width * depth].reshape(height, width, depth)
        flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        if colour == 0:
            flat = (flat.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[flat]
    return flat if samples == 1 else flat.reshape(height, width, samples)


def grey(pixels: np.ndarray) -> np.ndarray:
    """(height, width) of pixels of any kind; colours by their weights for brightness, alpha is left out."""
    if pixels.ndim == 2:
        return pixels
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    r, g, b = (pixels[:, :, c].astype(int) for c in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def blank(pixels: np.ndarray) -> np.ndarray:
    return np.full_like(pixels, GREY)


def fill_rects(pixels: np.ndarray, rects: list[tuple[int, int, int, int]], value: int = 0) -> np.ndarray:
    """Half-open rectangles (x0, y0, x1, y1) filled; empty ones change nothing."""
    out = pixels.copy()
    for x0, y0, x1, y1 in rects:
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = value
    return out


def compare(a: np.ndarray, b: np.ndarray, ink: int = 128) -> dict[str, float]:
    """Equal at all, share of equal pixels, mean and largest difference, overlap of ink."""
    d = np.abs(a.astype(int) - b.astype(int))
    x, y = a < ink, b < ink
    return {"equal": bool((d == 0).all()), "equal_share": float((d == 0).mean()), "mean_diff": float(d.mean()), "max_diff": float(d.max()), "ink_iou": float((x & y).sum() / (x | y).sum()) if (x | y).any() else 1.0}


def ink_share(pixels: np.ndarray, ink: int = 128) -> float:
    return float((pixels < ink).mean())


def tiles(pixels: np.ndarray, size: int | None = None, pad: int = 255) -> list[np.ndarray]:
    """Tiles from left to right; the last is padded to its full square."""
    height, width = pixels.shape
    size = size or height
    out = []
    for x in range(0, width, size):
        part = pixels[:, x : x + size]
        if part.shape[1] < size:
            part = np.pad(part, ((0, max(0, size - height)), (0, size - part.shape[1])), constant_values=pad)
        out.append(part)
    return out


def patches(pixels: np.ndarray, side: int, merge: int = 1) -> np.ndarray:
    """(patches, side * side) in reading order; merge > 1 takes merge x merge neighbours as one."""
    side *= merge
    h, w = pixels.shape[0] // side * side, pixels.shape[1] // side * side
    return pixels[:h, :w].reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side * side)


def occupancy(pixels: np.ndarray, side: int, page_ms: float, sound_ms: float) -> dict[str, float]:
    """How much of a page without blank paper is used, by cells of side x side pixels.

    active: cells darker in the mean than the page's silence (the first percentile of darkness) by
    0.02, 0.05 and 0.10; structured: cells that vary by more than one level; over_sound: cells whose
    time overlaps the part of the page that is no padding."""
    cells = patches(1 - pixels.astype(float) / 255, side)
    across = pixels.shape[1] // side
    floor = float(np.percentile(1 - pixels.astype(float) / 255, 1))
    mean, spread = cells.mean(1), cells.std(1)
    heard = min(across, int(np.ceil(sound_ms / (page_ms / across)))) if sound_ms > 0 else 0
    over = (np.arange(len(cells)) % across < heard).mean()
    return {"cells": len(cells), "floor": floor, **{f"active_{m}": float((mean > floor + m / 100).mean()) for m in (2, 5, 10)}, "structured": float((spread > 1 / 255).mean()), "over_sound": float(over)}


@lru_cache(maxsize=32)
def _lanczos(old: int, width: int) -> np.ndarray:
    """Weights (new pixels, old pixels) of a resampled row."""
    scale = max(old / width, 1.0)
    centre = (np.arange(width) + 0.5) * old / width - 0.5
    x = (np.arange(old)[None, :] - centre[:, None]) / scale
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return weights / weights.sum(1, keepdims=True)


def resize_width(pixels: np.ndarray, width: int) -> np.ndarray:
    """Lanczos resampling (window 3) along rows; the same width gives the picture itself."""
    old = pixels.shape[1]
    if width == old:
        return pixels
    return np.clip(np.rint(pixels.astype(float) @ _lanczos(old, width).T), 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos resampling both ways, rows first; the same size gives the picture itself."""
    return resize_width(resize_width(pixels, width).T, height).T


def mono(samples: np.ndarray) -> np.ndarray:
    """One channel of float32; of two axes the shorter is that of channels, equal ones are refused."""
    samples = np.asarray(samples, np.float32)
    if samples.ndim == 1:
        return samples
    if samples.ndim != 2 or samples.shape[0] == samples.shape[1]:
        raise ValueError(f"which axis of {samples.shape} is that of channels?")
    return samples.mean(int(np.argmin(samples.shape)))


def resample(samples: np.ndarray, rate: int, target: int = SAMPLE_RATE) -> np.ndarray:
    if rate == target:
        return samples
    n = int(round(len(samples) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(samples)), samples).astype(np.float32)


def centre(samples: np.ndarray, n: int) -> np.ndarray:
    """The middle n samples, or the samples with silence on both sides."""
    if len(samples) >= n:
        start = (len(samples) - n) // 2
        return samples[start : start + n]
    gap = n - len(samples)
    return np.pad(samples, (gap // 2, gap - gap // 2))


@lru_cache(maxsize=4)
def mel_matrix(rate: int = SAMPLE_RATE, n_fft: int = N_FFT, bands: int = N_MELS) -> np.ndarray:
    """Triangles of equal area on the mel scale that is linear below 1 kHz."""
    step, knee, log_step = 200 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, 1e-9) / knee) / log_step)
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp(log_step * (m - knee / step)))
    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), bands + 2))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up, down = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, rate: int = SAMPLE_RATE, hop: int = HOP) -> np.ndarray:
    """Log-mel values in [0, 1], (bands, frames): power in dB / 10, at most 8 below the largest."""
    if not len(samples):
        raise ValueError("no samples")
    padded = np.pad(samples, N_FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    values = np.log10(np.maximum(mel_matrix(rate) @ power.T, 1e-10))[:, : max(1, len(samples) // hop)]
    values = np.maximum(values, values.max() - 8)
    return np.clip(((values + 4) / 4 + 1) / 2, 0, 1)


def log_mel_pages(samples: np.ndarray, seconds: float = 10.0, most: int | None = None, rate: int = SAMPLE_RATE) -> list[np.ndarray]:
    """Pages of a fixed length, dark where it is loud; the last is filled with silence, and
    all share one largest value."""
    size = int(round(seconds * rate))
    n = max(1, -(-len(samples) // size))
    if most is not None and n > most:
        raise ValueError(f"{n} pages, at most {most}")
    values = log_mel(np.pad(samples, (0, n * size - len(samples))), rate)
    pixels = np.rint(255 * (1 - values)).astype(np.uint8)
    frames = size // HOP
    return [pixels[:, k * frames : (k + 1) * frames] for k in range(n)]


def from_pixels(pixels: np.ndarray) -> np.ndarray:
    """log_mel values of a page's pixels."""
    return 1 - pixels.astype(float) / 255


def joined_clips(clips: list[np.ndarray], gap: int) -> np.ndarray:
    """Clips of peak 1 with silence between."""
    parts: list[np.ndarray] = []
    for c in clips:
        peak = np.abs(c).max() if len(c) else 0
        parts += [np.zeros(gap, np.float32)] * bool(parts) + [(c / peak if peak else c).astype(np.float32)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def fidelity(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """MSE, MAE, correlation and signal-to-noise ratio in dB of b against a."""
    a, b = np.asarray(a, float).ravel(), np.asarray(b, float).ravel()
    noise = ((a - b) ** 2).mean()
    both = a.std() > 0 and b.std() > 0
    return {"mse": float(noise), "mae": float(np.abs(a - b).mean()), "corr": float(np.corrcoef(a, b)[0, 1]) if both else float("nan"), "snr_db": float(10 * np.log10((a**2).mean() / noise)) if noise > 0 and a.any() else float("inf")}
