"""From log-mel pages back to sound, signals to measure that with, and what resizing loses."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from weft.functions import media
from weft.functions.media import HOP, N_FFT, N_MELS, SAMPLE_RATE


@lru_cache(maxsize=8)
def window(n_fft: int = N_FFT) -> np.ndarray:
    out = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    out.flags.writeable = False  # shared by all calls
    return out


def _added(frames: np.ndarray, hop: int) -> np.ndarray:
    """Frames added up where they stand, hop after hop: each is cut into pieces of a hop, so that a
    frame's k-th pieces are one block of the sum. A sample's terms are added in the order of frames."""
    n, size = frames.shape
    pieces = -(-size // hop)
    out = np.zeros((n + pieces, hop))
    for k in reversed(range(pieces)):
        part = frames[:, k * hop : (k + 1) * hop]
        out[k : k + n, : part.shape[1]] += part
    return out.reshape(-1)[: (n - 1) * hop + size]


@lru_cache(maxsize=8)
def _overlap(frames: int, n_fft: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the windows' squares at each sample, at least 1e-8, and where it is more."""
    weight = _added(np.broadcast_to(window(n_fft) ** 2, (frames, n_fft)), hop)
    return np.maximum(weight, 1e-8), weight > 1e-8


def stft(samples: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """(frequencies, frames) of frames centred on every hop-th sample, silence at both ends."""
    padded = np.zeros(len(samples) + 2 * (n_fft // 2))
    padded[n_fft // 2 : n_fft // 2 + len(samples)] = samples
    step = padded.itemsize
    frames = np.ndarray(((len(padded) - n_fft) // hop + 1, n_fft), float, padded, 0, (hop * step, step))  # overlapping views
    return np.fft.rfft(frames * window(n_fft), axis=1).T


def istft(spectrum: np.ndarray, n: int, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """The n samples whose frames come nearest to the spectrum: frames are added up and divided by the windows' squares."""
    frames = np.fft.irfft(spectrum.T, n_fft, axis=1) * window(n_fft)
    weight, seen = _overlap(len(frames), n_fft, hop)
    out = np.where(seen, _added(frames, hop) / weight, 0)[n_fft // 2 : n_fft // 2 + n]
    return np.pad(out, (0, max(0, n - len(out)))) if len(out) < n else out


@lru_cache(maxsize=4)
def _inverse_mel(rate: int, n_fft: int, bands: int) -> np.ndarray:
    return np.linalg.pinv(media.mel_matrix(rate, n_fft, bands))


def power_of_mel(mel: np.ndarray, rate: int = SAMPLE_RATE, n_fft: int = N_FFT, steps: int = 30) -> np.ndarray:
    """A power spectrum, nowhere negative, with nearly these mel bands: the least-squares one, then
    multiplicative steps towards the bands. Frames that repeat, as silence does, are worked out once."""
    bands = media.mel_matrix(rate, n_fft, len(mel))
    first: dict[bytes, int] = {}
    of = [first.setdefault(frame.tobytes(), len(first)) for frame in np.ascontiguousarray(mel.T)]
    mel = mel[:, np.unique(of, return_index=True)[1]]
    out = np.maximum(_inverse_mel(rate, n_fft, len(mel)) @ mel, 1e-12)
    wanted = bands.T @ mel
    for _ in range(steps):
        near = bands.T @ (bands @ out)
        np.maximum(near, 1e-20, out=near)
        out *= np.divide(wanted, near, out=near)
    return out[:, of]


@lru_cache(maxsize=4)
def _drawn_phases(shape: tuple[int, int], seed: int) -> np.ndarray:
    return np.exp(2j * np.pi * np.random.default_rng(seed).random(shape))


def sound_of_power(power: np.ndarray, n: int, rounds: int = 64, n_fft: int = N_FFT, hop: int = HOP, seed: int = 0) -> np.ndarray:
    """n samples with about this power spectrum: phases drawn at first, then taken from the sound
    that the spectrum with these phases gives, round after round (with momentum)."""
    size = np.sqrt(power)
    spectrum = size * _drawn_phases(size.shape, seed)
    before = None
    for _ in range(rounds):
        now = stft(istft(spectrum, n, n_fft, hop), n_fft, hop)[:, : size.shape[1]]
        ahead = now if before is None else now + 0.99 / 1.99 * (now - before)
        before = now
        spectrum = ahead * (size / np.maximum(np.abs(ahead), 1e-12))
    return istft(spectrum, n, n_fft, hop)


def mel_of_page(pixels: np.ndarray, frames: int, bands: int = N_MELS) -> np.ndarray:
    """Mel power of a page's pixels, which may be stretched either way or have colours: brought
    to (bands, frames) first."""
    repaired = media.resize(media.grey(pixels), bands, frames)
    values = media.from_pixels(repaired)
    return np.maximum(10.0 ** (4 * (2 * values - 1) - 4), 1e-10)


def sound_of_page(pixels: np.ndarray, seconds: float, rate: int = SAMPLE_RATE, rounds: int = 64) -> np.ndarray:
    """Sound of a page of so many seconds, but for its loudness, which a page does not hold."""
    n = int(round(seconds * rate))
    mel = mel_of_page(pixels, max(1, n // HOP))
    power = power_of_mel(mel, rate)
    return sound_of_power(np.hstack([power, power[:, -1:]]), n, rounds)


def test_signals(seconds: float = 1.0, rate: int = SAMPLE_RATE) -> dict[str, np.ndarray]:
    """Signals of peak 0.5: a rising tone, a vowel's formants over a voice, and formants that move."""
    t = np.arange(int(seconds * rate)) / rate
    tone = np.sin(2 * np.pi * (100 * t + 3900 * t**2 / (2 * seconds)))
    voice = 2 * np.pi * 100 * t + 10 * np.sin(2 * np.pi * 5 * t)
    vowel = sum(np.sin(2 * np.pi * f * t + voice) for f in (700, 1200, 2600)) * np.exp(-np.arange(len(t)) * 1e-4)
    turns = lambda f: 2 * np.pi * np.cumsum(f) / rate
    pitch = turns(100 + 50 * np.sin(4 * np.pi * t))
    moving = 0.3 * np.sin(pitch) + 0.3 * np.sin(turns(400 + 400 * t / seconds) + pitch) + 0.2 * np.sin(turns(1500 - 500 * t / seconds) + pitch)
    return {name: (0.5 * x / np.abs(x).max()).astype(np.float32) for name, x in (("rising", tone), ("vowel", vowel), ("moving", moving))}


def _residual(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    a, b = np.asarray(a, float) / 255, np.asarray(b, float) / 255
    rmse, sd = float(np.sqrt(((a - b) ** 2).mean())), float(a.std())
    return {"rmse": rmse, "sd": sd, "rmse_over_sd": rmse / sd if sd else float("nan")}


def round_trip(pixels: np.ndarray, height: int, width: int) -> dict[str, float]:
    """What is lost of a page that is resized and resized back; an upper bound on the first of both."""
    seen = media.resize(pixels, height, width)
    return _residual(pixels, media.resize(seen, *pixels.shape))


def stretch_equivalence(pixels: np.ndarray, height: int, narrow: int, wide: int) -> dict[str, float]:
    """How far a page drawn wide is from one drawn narrow and stretched."""
    direct = media.resize(pixels, height, wide)
    return _residual(direct, media.resize(media.resize(pixels, height, narrow), height, wide))


def hop_redundancy(samples: np.ndarray, hop: int = HOP, rate: int = SAMPLE_RATE) -> dict[str, float]:
    """How well frames at half the hop follow from those at the hop, by straight lines between them:
    the residual, beside the step between neighbouring frames and the spread of all."""
    coarse, fine = media.log_mel(samples, rate, hop), media.log_mel(samples, rate, hop // 2)
    n = min(fine.shape[1], 2 * coarse.shape[1])
    fine = fine[:, :n]
    guess = np.stack([np.interp(np.arange(n), 2.0 * np.arange(coarse.shape[1]), row) for row in coarse])
    rms = lambda x: float(np.sqrt((x**2).mean())) if x.size else 0.0
    residual, step, sd = rms(fine - guess), rms(np.diff(fine, axis=1)), float(fine.std())
    return {"residual": residual, "step": step, "sd": sd, "residual_over_sd": residual / sd if sd else float("nan"), "residual_over_step": residual / step if step else float("nan")}
