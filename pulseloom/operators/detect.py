"""Peak detection and clustering: recurrences over samples or members, one record at a time in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.waveform import butterworth, dtw_of_pairs, run_sections


def adaptive_peaks(x: np.ndarray, fs: float, low: float = 8.0, high: float = 25.0) -> list[int]:
    """Peaks of the band-passed, squared derivative above a threshold that follows signal and noise peaks."""
    if len(x) < 8:
        return []
    band = run_sections(run_sections(x, butterworth(2, min(high, 0.45 * fs), fs), True), butterworth(2, min(low, 0.2 * fs), fs, high=True), True)
    energy = np.convolve(np.gradient(band) ** 2, np.ones(max(1, int(0.15 * fs))) / max(1, int(0.15 * fs)), "same")
    tops = np.flatnonzero((energy[1:-1] > energy[:-2]) & (energy[1:-1] >= energy[2:])) + 1
    signal, noise = float(energy.max()) * 0.5, float(np.median(energy))
    out: list[int] = []
    for t in tops:
        v = float(energy[t])
        if v > noise + 0.25 * (signal - noise):
            signal += 0.125 * (v - signal)
            if out and t - out[-1] < 0.2 * fs:  # refractory: the higher of two close peaks stays
                if v > energy[out[-1]]:
                    out[-1] = int(t)
                continue
            out.append(int(t))
        else:
            noise += 0.125 * (v - noise)
    return out


def detect(waves: DataFrame, fs: float) -> DataFrame:
    """(record, peaks) of waveforms (record, x array)."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"record": frame["record"], "peaks": [adaptive_peaks(np.asarray(x, float), fs) for x in frame["x"]]})

    return waves.select("record", "x").mapInPandas(run, "record long, peaks array<int>")


def polarity(x: np.ndarray) -> str:
    """Flat, positive, negative or biphasic, by the extremes."""
    high, low = float(np.max(x)), float(np.min(x))
    if high - low < 0.02:
        return "flat"
    return "positive" if high > -2 * low else "negative" if -low > 2 * high else "biphasic"


class Leaders:
    """Online leader clustering: the most similar cluster used lately, else an older one, else a new one; templates follow.

    Its state is a template and a place of last use for each cluster, whatever the number of rows."""

    def __init__(self, least: float = 0.3, recent: int = 15, rate: float = 0.125):
        self.least, self.recent, self.rate, self.seen = least, recent, rate, 0
        self.templates: list[np.ndarray] = []
        self.used: list[int] = []

    def add(self, x: np.ndarray) -> int:
        lately = [self.seen - u <= self.recent for u in self.used]
        best = None
        for pool in ([c for c, now in enumerate(lately) if now], [c for c, now in enumerate(lately) if not now]):
            if pool:
                scores = 1 / (1 + dtw_of_pairs([x] * len(pool), [self.templates[c] for c in pool]) / len(x) / (np.std(x) + 1e-9))
                k = int(scores.argmax())
                if scores[k] > self.least:
                    best = pool[k]
                    break
        if best is None:
            best = len(self.templates)
            self.templates.append(x.copy())
            self.used.append(self.seen)
        else:
            self.templates[best] += self.rate * (x - self.templates[best])
            self.used[best] = self.seen
        self.seen += 1
        return best


def leaders(rows: list[np.ndarray], least: float = 0.3, recent: int = 15, rate: float = 0.125) -> list[int]:
    """The clusters of rows in order."""
    fold = Leaders(least, recent, rate)
    return [fold.add(x) for x in rows]


def cluster_members(waves: DataFrame, group: str) -> DataFrame:
    """(group, record, cluster): leader clustering of all waveforms of each group in order of record, read as they come."""

    def run(frames):
        key, fold = None, None
        for frame in frames:
            out = []
            for g, x in zip(frame[group], frame["x"], strict=True):
                g = None if pd.isna(g) else g
                if fold is None or g != key:
                    key, fold = g, Leaders()
                out.append(fold.add(np.asarray(x, float)))
            yield pd.DataFrame({group: frame[group], "record": frame["record"], "cluster": out})

    rows = waves.select(group, "record", "x").repartition(group).sortWithinPartitions(group, "record", "x")
    return rows.mapInPandas(run, f"{group} long, record long, cluster int")


def complete_linkage(distance: np.ndarray, limit: float = 0.3) -> list[int]:
    """Cluster numbers when the closest two clusters, by their farthest members, are joined until none is under the limit."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        far = [(max(distance[i][j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        best = min(far)
        if best[0] >= limit:
            break
        groups[best[1]] += groups.pop(best[2])
    out = [0] * len(distance)
    for k, g in enumerate(sorted(map(sorted, groups))):
        for i in g:
            out[i] = k
    return out
