"""Signal functions on arrays of samples (inventory Q): Arrow batches, numpy inside."""

from __future__ import annotations

import io
import math
import struct
import wave
from functools import lru_cache
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(64)
def _response(sections: tuple) -> np.ndarray:
    """Impulse response of a cascade of sections, as long as it is above double precision."""
    radius = max(abs(np.roots(a)).max() for _, a in sections)
    y = np.zeros(int(np.ceil(np.log(1e-18) / np.log(radius))) + 16)
    y[0] = 1.0
    for (b0, b1, b2), (_, a1, a2) in sections:
        z1 = z2 = 0.0
        for i, v in enumerate(y.tolist()):
            out = b0 * v + z1
            z1, z2 = b1 * v - a1 * out + z2, b2 * v - a2 * out
            y[i] = out
    return y


def _filtered(x: np.ndarray, sections: list) -> np.ndarray:
    """``x`` through the sections: convolution with their response by blocks, in the frequency domain."""
    h = _response(tuple(sections))
    size = 1 << int(np.ceil(np.log2(4 * len(h))))
    step, spectrum = size - len(h) + 1, np.fft.rfft(h, size)
    y = np.zeros(len(x) + size)
    for at in range(0, len(x), step):
        y[at : at + size] += np.fft.irfft(np.fft.rfft(x[at : at + step], size) * spectrum, size)
    return y[: len(x)]


def _sections(cutoff: float, rate: int, order: int) -> list[tuple[tuple, tuple]]:
    """Butterworth high-pass sections by the bilinear transform."""
    w = np.tan(np.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * k + 1) / (2 * order)))
        n = 1 / (1 + w / q + w * w)
        out.append(((n, -2 * n, n), (1.0, 2 * (w * w - 1) * n, (1 - w / q + w * w) * n)))
    return out


def highpass_array(x: np.ndarray, rate: int, cutoff: float = 80.0, order: int = 4) -> np.ndarray:
    """Zero-phase high-pass (Q1): each section forward and backward over oddly extended samples."""
    if len(x) < 2:
        return x.astype(np.float64)
    pad = min(len(x) - 1, 3 * rate // 20)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])).astype(np.float64)
    for _ in range(2):
        y = _filtered(y, _sections(cutoff, rate, order))[::-1]
    return y[pad : pad + len(x)]


def _shelf(rate: int) -> list[tuple[tuple, tuple]]:
    """The two K-weighting sections at any sample rate, from their analogue prototypes."""
    k, vh, q = np.tan(np.pi * 1681.974450955533 / rate), 10 ** (3.999843853973347 / 20), 0.7071752369554196
    vb, n = vh**0.4996667741545416, 1 + k / q + k * k
    first = (((vh + vb * k / q + k * k) / n, 2 * (k * k - vh) / n, (vh - vb * k / q + k * k) / n), (1.0, 2 * (k * k - 1) / n, (1 - k / q + k * k) / n))
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    n = 1 + k / q + k * k
    return [first, ((1.0, -2.0, 1.0), (1.0, 2 * (k * k - 1) / n, (1 - k / q + k * k) / n))]


def loudness(x: np.ndarray, rate: int) -> float:
    """Integrated loudness with absolute and relative gates (Q2); minus infinity when nothing passes."""
    y = _filtered(x.astype(np.float64), _shelf(rate))
    size, hop = int(0.4 * rate), int(0.1 * rate)
    if len(y) < size:
        return float("-inf")
    upto = np.concatenate(([0.0], np.cumsum(y * y)))
    start = np.arange(0, len(y) - size + 1, hop)
    power = (upto[start + size] - upto[start]) / size
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-20))
    kept = power[level > -70]
    if not len(kept):
        return float("-inf")
    gate = -0.691 + 10 * np.log10(kept.mean()) - 10
    return float(-0.691 + 10 * np.log10(power[(level > -70) & (level > gate)].mean()))


def normalised_array(x: np.ndarray, rate: int, target: float = -16.0) -> np.ndarray:
    """Scaled to the target loudness; silence passes as it is."""
    level = loudness(x, rate)
    return x.astype(np.float64) * 10 ** ((target - level) / 20) if np.isfinite(level) else x.astype(np.float64)


def _mapped(samples: Column | str, f) -> Column:
    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else f(np.asarray(x, np.float64)))

    return run(samples)


def highpass(samples: Column | str, rate: int, cutoff: float = 80.0, order: int = 4) -> Column:
    return _mapped(samples, lambda x: highpass_array(x, rate, cutoff, order))


def normalise_loudness(samples: Column | str, rate: int, target: float = -16.0) -> Column:
    return _mapped(samples, lambda x: normalised_array(x, rate, target))


def prepare(samples: Column | str, rate: int) -> Column:
    """High-pass, then loudness (Q3); samples are read at ``rate`` and mono (A1)."""
    return _mapped(samples, lambda x: normalised_array(highpass_array(x, rate), rate))


def centroid_variance(samples: Column | str, rate: int, size: int = 2048, hop: int = 512) -> Column:
    """Variance of the spectral centroid, in Hz squared, over frames of ``size`` samples (Q5); null without a whole frame."""

    def one(x: np.ndarray) -> float | None:
        if len(x) < size:
            return None
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
        power = np.abs(np.fft.rfft(frames, axis=1))
        centroid = power @ np.fft.rfftfreq(size, 1 / rate) / np.maximum(power.sum(1), 1e-12)
        return float(centroid.var())

    @F.pandas_udf("double")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else one(np.asarray(x, np.float64))).astype(float)

    return run(samples)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encode_wav(samples: Column | str, rate: int) -> Column:
    """Each row's samples as a 16-bit mono WAV (B6, B11); null stays null."""

    @F.pandas_udf("binary")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else wav_bytes(np.asarray(x, np.float64), rate))

    return run(samples)


#: Zero crossings of the resampling filter on each side, its cut-off as a share of the lower Nyquist rate, and places filtered at once.
CROSSINGS, ROLL_OFF, PLACES = 48, 0.94, 1 << 14


class Wav:
    """A WAV file's format and frames: 8-, 16-, 24- or 32-bit whole numbers, 32- or 64-bit floats."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
            raise ValueError("no WAV file")
        at, kind, self.data = 12, None, b""
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"fmt ":
                kind, self.channels, self.rate, _, self.width, bits = struct.unpack_from("<HHIIHH", data, at + 8)
                kind = struct.unpack_from("<H", data, at + 32)[0] if kind == 0xFFFE else kind
            elif name == b"data":
                self.data = memoryview(data)[at + 8 : at + 8 + size]  # a stream's size may be more than there is
                break
            at += 8 + size + size % 2
        if kind is None or (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
            raise ValueError("no WAV of whole or floating numbers")
        self.kind, self.bits, self.frames = kind, bits, len(self.data) // self.width

    def mono(self, lo: int, hi: int) -> np.ndarray:
        """The channels' mean of frames lo to hi, in [-1, 1]; beyond the ends silence."""
        a, b = min(max(lo, 0), self.frames), min(max(hi, 0), self.frames)
        raw = np.frombuffer(self.data[a * self.width : b * self.width], np.uint8)
        if self.kind == 3:
            x = raw.view(f"<f{self.bits // 8}").astype(np.float64)
        elif self.bits == 8:
            x = (raw.astype(np.float64) - 128) / 128
        elif self.bits == 24:
            x = np.pad(raw.reshape(-1, 3), ((0, 0), (1, 0))).reshape(-1).view("<i4") / 2**31
        else:
            x = raw.view(f"<i{self.bits // 8}") / 2.0 ** (self.bits - 1)
        return np.pad(x.reshape(-1, self.channels).mean(1) if len(x) else np.empty(0), (a - lo if b > a or lo < 0 else 0, 0))


@lru_cache(16)
def _phases(own: int, rate: int) -> tuple[np.ndarray, int, int, int]:
    """([phase, tap], up, down, taps on the left) of a windowed-sinc filter between the rates, below the lower one's Nyquist rate."""
    g = math.gcd(own, rate)
    up, down = rate // g, own // g
    cut = min(1.0, rate / own) * ROLL_OFF
    half = math.ceil(CROSSINGS / cut)
    u = np.arange(up)[:, None] / up - np.arange(-half, half + 2)[None, :]
    window = np.where(np.abs(u) <= half, np.cos(np.pi * u / (2 * half)) ** 2, 0.0)
    taps = cut * np.sinc(cut * u) * window
    return taps / taps.sum(1, keepdims=True), up, down, half


def resampled(wav: Wav, rate: int, begin: int, end: int) -> np.ndarray:
    """Mono samples begin to end of the file at ``rate``, band-limited: each is a filtered sum of the file's samples around its place, so
    pieces equal the whole."""
    if wav.rate == rate:
        return wav.mono(begin, min(end, wav.frames))
    taps, up, down, half = _phases(wav.rate, rate)
    out = np.empty(max(0, end - begin))
    for at in range(begin, end, PLACES):
        k = np.arange(at, min(end, at + PLACES))
        base, phase = k * down // up, k * down % up
        lo = int(base[0]) - half
        x = wav.mono(lo, int(base[-1]) + half + 2)
        x = np.pad(x, (0, int(base[-1]) + half + 2 - lo - len(x)))
        windows = np.lib.stride_tricks.sliding_window_view(x, taps.shape[1])
        out[k - begin] = np.einsum("kt,kt->k", windows[base - half - lo], taps[phase])
    return out


def wav_pieces(data: bytes, rate: int, step: int, lead: int = 0):
    """(first sample, samples before it, samples) of pieces of ``step`` mono samples of a WAV at ``rate`` (A1).

    Only a piece's own frames are decoded; ``lead`` samples of the piece before go in front, so that filters have no seams."""
    wav = Wav(data)
    total = -(-wav.frames * rate // wav.rate)
    for start in range(0, max(1, total), step):
        begin = max(0, start - lead)
        yield start, start - begin, resampled(wav, rate, begin, min(total, start + step))


def read_wav(data: bytes, rate: int) -> np.ndarray:
    """All mono samples of a WAV at ``rate``."""
    return np.concatenate([x for _, _, x in wav_pieces(data, rate, 1 << 22)])
