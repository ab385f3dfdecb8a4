"""Array functions on waveforms, as higher-order expressions where they are not recurrences over samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def sd_of(x: Column) -> Column:
    """Population deviation of an array."""
    return F.get(F.transform(F.array(mean_of(x)), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(x))), 0)


def zscore(x: Column) -> Column:
    """Mean 0 and deviation 1; zeros where the deviation is 0."""
    scaled = F.transform(F.array(F.struct(mean_of(x).alias("m"), sd_of(x).alias("s"))), lambda p: F.transform(x, lambda v: F.when(p["s"] > 0, (v - p["m"]) / p["s"]).otherwise(F.lit(0.0))))
    return F.get(scaled, 0)


def resample(x: Column, m: int) -> Column:
    """Linear interpolation at m evenly spaced places from the first to the last sample."""
    def at(k: Column) -> Column:
        place = k * (F.size(x) - 1) / F.lit(float(m - 1))
        low = F.floor(place).cast("int")
        return F.get(x, low) + (place - low) * (F.get(x, F.least(low + 1, F.size(x) - 1)) - F.get(x, low))

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at)


def pad(x: Column, multiple: int) -> Column:
    """Zeros at the end up to a multiple of a length."""
    return F.concat(x, F.array_repeat(F.lit(0.0), F.pmod(-F.size(x), F.lit(multiple)).cast("int")))


def tiles(n: int, patch: int, step: float) -> list[int]:
    """Starts of evenly spaced tiles at most `step` of a patch apart that cover n samples."""
    if n <= patch:
        return [0]
    count = int(np.ceil((n - patch) / (patch * step))) + 1
    return [int(round((n - patch) / (count - 1) * k)) for k in range(count)]


def gaussian(patch: int) -> list[float]:
    """Tile weights: a bell of an eighth of the patch, at most 10, nowhere 0."""
    at = np.arange(patch) - (patch - 1) / 2
    return [float(w) for w in 10 * np.exp(-0.5 * (at / (patch / 8)) ** 2).clip(1e-6)]


def overlap_add(rows: DataFrame, starts: list[int], weights: list[float], change: Callable[[Column], Column] | None = None) -> DataFrame:
    """Cut the array column x of each record into tiles and put them together again by weighted means of each sample; `change`
    gives what is added to a tile's values, by its start."""
    patch = len(weights)
    w = F.array(*map(F.lit, weights))
    cut = rows.select("record", "x", F.explode(F.array(*map(F.lit, starts))).alias("s"))
    cut = cut.select("record", "s", F.posexplode(F.slice("x", F.col("s") + 1, patch)).alias("k", "v"))
    if change:
        cut = cut.withColumn("v", F.col("v") + change(F.col("s")))
    weight = F.get(w, F.col("k"))
    return cut.groupBy("record", (F.col("s") + F.col("k")).alias("i")).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("y"))


def detrend(x: Column) -> Column:
    """Less the line from the first to the last sample."""
    return F.transform(x, lambda v, i: v - (F.get(x, 0) + i * (F.element_at(x, -1) - F.get(x, 0)) / (F.size(x) - 1)))


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(x))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def shift(x: Column, k: int) -> Column:
    """Moved right by k samples (left for a negative k), zeros moved in, of the same length."""
    zeros = F.array_repeat(F.lit(0.0), abs(k))
    return F.concat(zeros, F.slice(x, F.lit(1), F.size(x) - k)) if k >= 0 else F.concat(F.slice(x, F.lit(1 - k), F.size(x)), zeros)


def convolve(x: Column, kernel: list[float]) -> Column:
    """Full convolution: out[i + j] += x[i] * kernel[j]."""
    m = len(kernel)
    term = lambda k, j: F.when((k - j >= 0) & (k - j < F.size(x)), F.get(x, k - j) * F.lit(kernel[j])).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.size(x) + m - 2), lambda k: sum((term(k, j) for j in range(1, m)), term(k, 0)))


def snr_db(fore: Column, back: Column) -> Column:
    """Ten times the decimal log of the quotient of mean squares."""
    power = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x)
    return 10 * F.log10(power(fore) / power(back))


def bald(chances: Column) -> Column:
    """Entropy of the mean less the mean entropy of one class's chances."""
    h = lambda p: -p * F.log(p)
    return h(mean_of(chances)) - mean_of(F.transform(chances, h))


def butterworth(order: int, cut: float, fs: float, high: bool = False) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) of a low- or high-pass by the bilinear transform; even orders."""
    k = np.tan(np.pi * cut / fs)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * np.sin(np.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        b = (norm, -2 * norm, norm) if high else (k * k * norm, 2 * k * k * norm, k * k * norm)
        out.append((*b, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm))
    return out


def run_sections(x: np.ndarray, sections: list[tuple[float, ...]], zero_phase: bool) -> np.ndarray:
    """A cascade of sections over the last axis, forwards, and backwards too for zero phase."""
    y = x.astype(float)
    for _ in range(2 if zero_phase else 1):
        for b0, b1, b2, a1, a2 in sections:
            z1 = z2 = np.zeros(y.shape[:-1])
            out = np.empty_like(y)
            for i in range(y.shape[-1]):  # a recurrence: one step for all signals of the batch
                v = y[..., i]
                out[..., i] = b0 * v + z1
                z1, z2 = b1 * v - a1 * out[..., i] + z2, b2 * v - a2 * out[..., i]
            y = out
        if zero_phase:
            y = y[..., ::-1]
    return y


def filtered(sections: list[tuple[float, ...]], zero_phase: bool = True):
    """An Arrow UDF that filters waveforms of one length a batch at a time, others one by one."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        sizes = {len(v) for v in x}
        if len(sizes) == 1 and sizes != {0}:
            return pd.Series(list(run_sections(np.stack(x.to_list()), sections, zero_phase)))
        return x.map(lambda v: run_sections(np.asarray(v, float), sections, zero_phase) if len(v) else v)

    return run


def dtw_distance(x: np.ndarray, y: np.ndarray, band: int = 20) -> float:
    """Dynamic time warping cost within a band around the diagonal."""
    n, m = len(x), len(y)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = abs(x[i - 1] - y[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return float(cost[n, m])


def dtw_distances(x: np.ndarray, y: np.ndarray, band: int = 20) -> np.ndarray:
    """`dtw_distance` of each row of x to that row of y: one step for an antidiagonal of all pairs, the same sums."""
    (pairs, n), m = x.shape, y.shape[1]
    if not n or not m:
        return np.full(pairs, 0.0 if n == m else np.inf)
    back = y[:, ::-1]
    before, last, now = (np.full((pairs, n + 1), np.inf) for _ in range(3))
    before[:, 0] = 0
    for d in range(2, n + m + 1):
        low, high = max(1, d - m, -((band - d) // 2)), min(n, d - 1, (d + band) // 2)
        now.fill(np.inf)
        if low <= high:
            least = np.minimum(np.minimum(last[:, low - 1 : high], last[:, low : high + 1]), before[:, low - 1 : high])
            now[:, low : high + 1] = np.abs(x[:, low - 1 : high] - back[:, m - d + low : m - d + high + 1]) + least
        before, last, now = last, now, before
    return last[:, n]


def dtw_of_pairs(xs: list[np.ndarray], ys: list[np.ndarray], band: int = 20) -> np.ndarray:
    """`dtw_distance` of each pair, pairs of equal lengths together and so many at a time that memory stays bounded."""
    out, alike = np.empty(len(xs)), {}
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        alike.setdefault((len(x), len(y)), []).append(k)
    for ks in alike.values():
        for some in (ks[k : k + 512] for k in range(0, len(ks), 512)):
            out[some] = dtw_distances(np.stack([xs[k] for k in some]), np.stack([ys[k] for k in some]), band)
    return out
