"""Element-wise and windowed transforms of numeric arrays within a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD_INT, PAD_FLOAT = -32768, 0.0


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row; inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def padded(x: Column, length: Column, value) -> Column:
    """Filled up to ``length`` with ``value``; longer arrays stay as they are."""
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(length - F.size(x), F.lit(0))))


def collate(df: DataFrame, batch: list[str], x: str, value) -> DataFrame:
    """Pads ``x`` to the longest of its batch and adds ``x_lengths``; the name must be free."""
    if f"{x}_lengths" in df.columns:
        raise ValueError(f"the column {x}_lengths is reserved")
    most = F.max(F.size(x)).over(Window.partitionBy(*batch))
    return df.withColumn(f"{x}_lengths", F.size(x)).withColumn("__most", most).withColumn(x, padded(F.col(x), F.col("__most"), value)).drop("__most")


def pad_mask(length: Column, most: Column) -> Column:
    """True at padded places."""
    return F.when(most > 0, F.transform(F.sequence(F.lit(0), most - 1), lambda i: i >= length)).otherwise(F.array().cast("array<boolean>"))


def filled_beyond(x: Column, length: Column, value) -> Column:
    return F.transform(x, lambda v, i: F.when(i >= length, F.lit(value)).otherwise(v))


def span_mask(x: Column, start: Column, width: Column, value=0.0) -> Column:
    """``value`` in place of the elements of [start, start + width)."""
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < start + width), F.lit(value)).otherwise(v))


def seeded_spans(df: DataFrame, x: str, key: str, n: int, widest: int, seed: int, value=0.0) -> DataFrame:
    """n masked spans of pseudo-random place and width below ``widest``, the same for the same key and seed."""
    for k in range(n):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(f"{seed}|{k}"))), 1, 12), 16, 10).cast("bigint")
        width = F.pmod(h, F.lit(widest))
        start = F.pmod(F.floor(h / widest), F.greatest(F.size(x) - width, F.lit(1)))
        at = df.withColumn("__span", F.struct(start.alias("s"), width.alias("w")))
        # One element of an exploded single span: a stored value, computed once a row.
        at = at.withColumn("__span", F.explode(F.array("__span")))
        df = at.withColumn(x, span_mask(F.col(x), F.col("__span.s"), F.col("__span.w"), value)).drop("__span")
    return df


def gain_db(x: Column, db: Column) -> Column:
    return F.transform(x, lambda v: v * F.pow(F.lit(10.0), db / 20))


def peak_normalised(x: Column, target: float = 1.0) -> Column:
    """Scaled so that the largest magnitude is ``target``; all-zero arrays stay."""
    scaled = lambda peak: F.when(peak > 0, F.transform(x, lambda v: v * target / peak)).otherwise(x)
    return let(F.array_max(F.transform(x, lambda v: F.abs(v))), scaled)


def with_noise(x: Column, noise: Column, snr_db: Column) -> Column:
    """Adds noise, repeated to the length, at a signal-to-noise ratio."""
    n = F.size(noise)

    def mix(fitted: Column) -> Column:
        scale = F.sqrt(dot(x, x) / (dot(fitted, fitted) + 1e-20) * F.pow(F.lit(10.0), -snr_db / 10))
        return let(scale, lambda k: F.zip_with(x, fitted, lambda a, b: a + b * k))

    return let(F.transform(x, lambda v, i: F.get(noise, F.pmod(i, n))), mix)


def reflected(x: Column, length: Column) -> Column:
    """Continued by reflection at the edges, or cut, to ``length``."""
    n = F.size(x)
    period = F.greatest(2 * (n - 1), F.lit(1))
    return F.when((n > 0) & (length > 0), F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(x, F.least(i % period, period - i % period))))


def mixed(x: Column, y: Column, gain: float) -> Column:
    """x plus y at a gain, y reflected or cut to x's length."""
    return F.zip_with(x, reflected(y, F.size(x)), lambda a, b: a + gain * b)


def si_snr(ref: Column, est: Column) -> Column:
    """Scale-invariant signal-to-noise ratio in dB of mean-free signals."""
    n = F.size(ref)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, q: s + q) / n
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda e: e - m))
    sums = lambda p: F.struct(dot(p["r"], p["r"]).alias("rr"), dot(p["e"], p["e"]).alias("ee"), dot(p["r"], p["e"]).alias("re"))

    def ratio(d: Column) -> Column:
        alpha = d["re"] / (d["rr"] + 1e-20)
        target = alpha * alpha * d["rr"]
        # Rounding may bring the noise of an exact multiple below zero.
        noise = F.greatest(d["ee"] - 2 * alpha * d["re"] + target, F.lit(0.0))
        return 10 * F.log10((target + 1e-20) / (noise + 1e-20))

    return let(let(F.struct(centred(ref).alias("r"), centred(est).alias("e")), sums), ratio)


#: The twelve semitones from C.
NOTES = "C C# D D# E F F# G G# A A# B".split()


def semitone(f: Column) -> Column:
    """Note name of a frequency, e.g. A_4; ``Sil`` for 0 and below."""
    h = F.bround(12 * F.log2(f / (440 * 2**-4.75))).cast("int")
    names = F.array(*[F.lit(n) for n in NOTES])
    return F.when(f > 0, F.concat(F.element_at(names, F.pmod(h, F.lit(12)) + 1), F.lit("_"), F.floor(h / 12).cast("string"))).when(f.isNotNull(), "Sil")


def quantised(duration: Column, beats_per_second: Column) -> Column:
    """A note's length in beats to an eighth, at least a sixteenth."""
    q = F.floor(8 * duration * beats_per_second + 0.5) / 8
    return F.greatest(q, F.lit(1 / 16))


def _arrays(df: DataFrame, key: str, x: str, function) -> DataFrame:
    """(key, x) with ``function`` (ndarray to ndarray) applied to each array in Arrow batches; null stays null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[x] = [None if v is None else np.asarray(function(np.asarray(v, dtype=float))).ravel().tolist() for v in b[x]]
            yield b

    return df.select(key, x).mapInPandas(run, f"{key} {kind}, {x} array<double>")


def _stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    pad = n_fft // 2
    y = np.pad(x, pad, mode="reflect") if len(x) > pad else np.pad(x, pad)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    n = 1 + (len(y) - n_fft) // hop
    return np.stack([np.fft.rfft(win * y[i * hop : i * hop + n_fft]) for i in range(n)])


def mel_filters(fs: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters, equally wide on the mel scale (2595 log10(1 + f / 700))."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(fs / 2), n_mels + 2) / 2595) - 1)
    freqs = np.linspace(0, fs / 2, n_fft // 2 + 1)
    up = (freqs - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
    down = (edges[2:, None] - freqs) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
    return np.maximum(0, np.minimum(up, down))


def spectrogram(df: DataFrame, key: str, x: str, n_fft: int, hop: int) -> DataFrame:
    """(key, x): magnitudes, frame after frame (n_fft // 2 + 1 values each)."""
    return _arrays(df, key, x, lambda v: np.abs(_stft(v, n_fft, hop)))


def log_mel(df: DataFrame, key: str, x: str, fs: int, n_fft: int, hop: int, n_mels: int, eps: float = 1e-10) -> DataFrame:
    filters = mel_filters(fs, n_fft, n_mels)
    return _arrays(df, key, x, lambda v: np.log10(np.maximum(eps, np.abs(_stft(v, n_fft, hop)) @ filters.T)))


def inverse_stft(df: DataFrame, key: str, x: str, n_fft: int, hop: int) -> DataFrame:
    """(key, x): the signal through the transform and back (overlap-add), for round trips."""

    def there_and_back(v: np.ndarray) -> np.ndarray:
        s = _stft(v, n_fft, hop)
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        out, norm = np.zeros(n_fft + hop * (len(s) - 1)), np.zeros(n_fft + hop * (len(s) - 1))
        for i, f in enumerate(s):
            out[i * hop : i * hop + n_fft] += win * np.fft.irfft(f, n_fft)
            norm[i * hop : i * hop + n_fft] += win**2
        out = out / np.maximum(norm, 1e-12)
        return out[n_fft // 2 : n_fft // 2 + len(v)]

    return _arrays(df, key, x, there_and_back)


def speed_perturbed(df: DataFrame, key: str, x: str, factor: float) -> DataFrame:
    """(key, x): resampled by linear interpolation to 1 / factor of the length."""
    return _arrays(df, key, x, lambda v: np.interp(np.arange(0, len(v) - 1 + 1e-9, factor), np.arange(len(v)), v) if len(v) else v)


def convolved(df: DataFrame, key: str, x: str, impulse: list[float]) -> DataFrame:
    """(key, x): convolution with a room's impulse response, cut to the length and kept at its power."""
    h = np.asarray(impulse, dtype=float)

    def run(v: np.ndarray) -> np.ndarray:
        if not len(v):
            return v
        y = np.convolve(v, h)[: len(v)]
        power, after = (v**2).mean(), (y**2).mean()
        return y * np.sqrt(power / max(after, 1e-10))

    return _arrays(df, key, x, run)


def cubic_resized(v: np.ndarray, length: int) -> np.ndarray:
    """Rows of an array resized to ``length`` by the cubic convolution kernel (a = -0.5).

    Where the array shrinks the kernel is widened, so that every row counts; weights beyond
    the ends are left out and the rest made to sum to one.
    """
    n = len(v)
    if length == n or not n:
        return v.astype(float)
    scale = n / length
    wide = max(scale, 1.0)
    centre = (np.arange(length) + 0.5) * scale
    d = np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / wide
    k = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
    return (k / k.sum(axis=1, keepdims=True)) @ v


def time_warped(df: DataFrame, key: str, x: str, window: int, seed: int) -> DataFrame:
    """(key, x): a pseudo-random centre moved by less than ``window``, both sides resized by cubic convolution.

    Arrays of up to twice the window stay as they are.
    """

    def run(v: np.ndarray) -> np.ndarray:
        n = len(v)
        if n <= 2 * window:
            return v
        rng = np.random.default_rng(seed + int(abs(v).sum() * 1000) % 2**31)
        centre = int(rng.integers(window, n - window))
        moved = int(np.clip(centre + rng.integers(-window + 1, window), 1, n - 1))
        return np.concatenate([cubic_resized(v[:centre], moved), cubic_resized(v[centre:], n - moved)])

    return _arrays(df, key, x, run)


def bands_dropped(x: Column, key: str, n_bands: int, lower: float, upper: float, seed: int) -> Column:
    """Frames (time x bands) without pseudo-random bands, the same for the same key and seed.

    A band stays where a normal number exceeds a ratio drawn evenly from [lower, upper).
    """
    from voxloom.sources.binary import seeded_uniform

    u, v, one = seeded_uniform(key, n_bands, seed), seeded_uniform(key, n_bands, seed + 1), seeded_uniform(key, 1, seed + 2)
    normal = F.zip_with(u, v, lambda a, b: F.sqrt(-2 * F.log(a + 2.0**-17)) * F.cos(b * 2 * np.pi))
    ratio = lower + F.get(one, 0) * (upper - lower)
    return let(F.struct(normal.alias("n"), ratio.alias("r")), lambda m: F.transform(x, lambda frame: F.zip_with(frame, m["n"], lambda a, b: F.when(b > m["r"], a).otherwise(0.0))))


def stoi(ref: np.ndarray, est: np.ndarray, fs: int = 10_000) -> float:
    """Short-time objective intelligibility of an estimate, both sampled at 10 kHz; NaN where too little is loud.

    Frames of 256 more than 40 dB below the loudest of the reference are left out; third-octave
    bands from 150 Hz are compared over 30 frames, the estimate clipped at -15 dB.
    """
    if fs != 10_000:
        raise ValueError("signals must be sampled at 10 kHz")
    n, hop, bands, span = 256, 128, 15, 30
    window = np.hanning(n + 2)[1:-1]
    m = min(len(ref), len(est))
    if m < n:
        return float("nan")
    at = np.arange(0, m - n + 1, hop)[:, None] + np.arange(n)
    x, y = ref[at] * window, est[at] * window
    level = 20 * np.log10(np.linalg.norm(x, axis=1) + 1e-20)
    loud = level > level.max() - 40

    def joined(frames: np.ndarray) -> np.ndarray:
        out = np.zeros((len(frames) - 1) * hop + n)
        for i, f in enumerate(frames):
            out[i * hop : i * hop + n] += f
        return out

    if not loud.any():
        return float("nan")
    x, y = joined(x[loud]), joined(y[loud])
    at = np.arange(0, len(x) - n + 1, hop)[:, None] + np.arange(n)
    freqs = np.arange(n + 1) * fs / (2 * n)
    middle = 150 * 2 ** (np.arange(bands) / 3)
    nearest = lambda f: np.abs(freqs[None, :] - f[:, None]).argmin(axis=1)
    low, high = nearest(middle * 2 ** (-1 / 6)), nearest(middle * 2 ** (1 / 6))
    pick = (np.arange(n + 1) >= low[:, None]) & (np.arange(n + 1) < high[:, None])
    spec = lambda v: np.sqrt(pick @ (np.abs(np.fft.rfft(v[at] * window, 2 * n)) ** 2).T)
    x, y = spec(x), spec(y)
    if x.shape[1] < span:
        return float("nan")
    total, parts = 0.0, 0
    for k in range(span, x.shape[1] + 1):
        a, b = x[:, k - span : k], y[:, k - span : k]
        b = b * (np.linalg.norm(a, axis=1, keepdims=True) / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-20))
        b = np.minimum(b, a * (1 + 10 ** (15 / 20)))
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        corr = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-20)
        total, parts = total + corr.sum(), parts + bands
    return float(total / parts)


def stoi_scores(df: DataFrame, key: str, ref: str, est: str) -> DataFrame:
    """(key, stoi) of pairs of signals at 10 kHz; null where it is not defined."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [None if r is None or e is None else stoi(np.asarray(r, dtype=float), np.asarray(e, dtype=float)) for r, e in zip(b["__r"], b["__e"])]
            yield pd.DataFrame({key: b["__k"], "stoi": v})

    out = df.select(F.col(key).alias("__k"), F.col(ref).alias("__r"), F.col(est).alias("__e")).mapInPandas(run, f"{key} {kind}, stoi double")
    return out.withColumn("stoi", F.when(~F.isnan("stoi"), F.col("stoi")))
