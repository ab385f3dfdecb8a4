"""All rhythm rules of a recording, in order, as one ordered pass over its waves.

Every rule sees the labels that the rules before it wrote, the last writer winning, so the rules of a record cannot be told
apart into independent plans; a record's waves (some 10^5 beats a day) go to one task in one shuffle and come back as labelled
intervals. Records are independent of each other.

A recording is one table `waves`, in seconds: rows with `wave` = 'beat' (all columns) and 'p' (onset, offset, unmatched,
snr_db, noise, which tells whether noise touches the stretch from the wave before). What a beat lacks is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plugins import toggles

#: Label and whether it is a main one, which counts as the beats' diagnosis.
MAIN = ("AFIB", "SVT", "EAR", "AVB_TYPE2", "WENCKEBACH", "SUDDEN_BRADY", "NOISE", "NSR", "AVB_TYPE1", "IVR", "AIVR", "VT", "BIGEMINY", "TRIGEMINY", "QUADRIGEMINY", "JUNCTIONAL")
SUB = ("TACHYCARDIA", "BRADYCARDIA", "IVB", "PAC", "PVC")

_NUMBERS = ("r", "onset", "offset", "width", "pr", "rr", "rr_raw", "rr_smooth", "snr", "p_onset", "p_height", "t_offset", "p_cluster")
_FLAGS = ("abnormal", "junctional", "double_p", "p_inverted", "noise", "afib")
SCHEMA = "record long, seq int, level string, name string, first long, last long"


def runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """[start, end) of the runs of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _slide(x: np.ndarray, k: int, pick: Callable) -> np.ndarray:
    """Extremes over [i - k // 2, i + k // 2 - 1], clipped at the ends."""
    half = k // 2
    fill = 0 if pick is np.max else 1
    wide = np.concatenate([np.full(half, fill), x.astype(np.int8), np.full(half, fill)])
    return pick(np.lib.stride_tricks.sliding_window_view(wide, 2 * half), axis=1)[: len(x)]


def opening(x: np.ndarray, k: int) -> np.ndarray:
    return _slide(_slide(x, k, np.min), k, np.max)


def closing(x: np.ndarray, k: int) -> np.ndarray:
    return _slide(_slide(x, k, np.max), k, np.min)


def _padded(f: Callable[[np.ndarray, int], np.ndarray], x: np.ndarray, k: int) -> np.ndarray:
    """With one unset sample at either end while the filter runs."""
    return f(np.pad(x.astype(np.int8), 1), k)[1:-1]


def junctional_flag(abnormal: Column, width: Column, afib: Column, snr: Column, onset: Column, p_onset: Column, pratio: Column) -> Column:
    """Whether a beat came without a P wave of its own: none, one after it or within 75 ms before it, or one out of proportion;
    never in fibrillation, in noise or for a wide abnormal beat."""
    vetoed = (abnormal & (width > 0.12)) | afib | (snr < 20)
    return ~vetoed & (p_onset.isNull() | (onset - p_onset < 0.075) | (pratio > 50))


class Recording:
    def __init__(self, waves: pd.DataFrame):
        beats = waves[waves["wave"] == "beat"].sort_values("r", kind="stable")
        p = waves[waves["wave"] == "p"].sort_values("onset", kind="stable")
        for name in _NUMBERS:
            setattr(self, name, beats[name].to_numpy(float))
        for name in _FLAGS:
            setattr(self, name, beats[name].eq(True).to_numpy(bool))
        self.n = len(beats)
        self.main = np.full(self.n, "", dtype=object)
        self.has_p = ~np.isnan(self.p_onset)
        self.p, self.p_snr = p["onset"].to_numpy(float), p["snr_db"].to_numpy(float)
        self.dangling, self.p_noise = p["unmatched"].eq(True).to_numpy(bool), p["noise"].eq(True).to_numpy(bool)
        # The beat before each P wave, and how many P waves follow each beat before the next.
        self.gap = np.searchsorted(self.r, self.p, "left") - 1
        self.between = np.bincount(self.gap[self.gap >= 0], minlength=self.n)
        self.out: list[tuple[str, int, int]] = []

    def write(self, name: str, first: int, last: int) -> None:
        self.out.append((name, first, last))
        if name in MAIN:
            self.main[first : last + 1] = name

    def rate(self, first: int, last: int) -> float:
        """Beats a minute from one beat to another."""
        return 60 * (last - first) / (self.r[last] - self.r[first])

    def initial_rate(self) -> float | None:
        """By the median interval between normal beats outside fibrillation; where there is none, over two to four beats."""
        share = 1
        for step in range(1, 5):
            share *= step
            found: list[float] = []
            for s in range(step):
                at = np.arange(step + s, self.n, step)
                ok = ~(self.afib[at] | self.abnormal[at] | self.abnormal[at - step])
                found += (self.r[at] - self.r[at - step])[ok].tolist()
                if len(found) > 2:
                    break
            if found:
                return 60 * share / float(np.median(found))
        return None

    def string(self, *marks: tuple[str, np.ndarray]) -> str:
        out = np.full(self.n, "N")
        for mark, where in marks:
            out[where] = mark
        return "".join(out)

    def clear(self, first: int, last: int) -> bool:
        return not self.noise[first : last + 1].any()


def noise(rec: Recording) -> None:
    for a, b in runs(rec.noise & ~rec.afib):
        rec.write("NOISE", a, b - 1)


def fibrillation(rec: Recording) -> None:
    for a, b in runs(rec.afib):
        rec.write("AFIB", a, b - 1)


def _repaired(rec: Recording) -> str:
    return rec.string(("V", rec.abnormal)).replace("VVVNVVV", "V" * 7).replace("VVVNNVVV", "V" * 8)


def ventricular(rec: Recording) -> None:
    """Runs of abnormal beats, by rate, width and steadiness; not where wandering or long PR intervals tell of a block."""
    for m in re.finditer("V{3,}", _repaired(rec)):
        a, b = m.span()
        gaps, known = np.diff(rec.r[a:b]), rec.pr[a:b][~np.isnan(rec.pr[a:b])]
        if gaps.max() > 3 or len(known) and (known.std() > 0.1 or np.median(known) > 0.5):
            continue
        rate, width = rec.rate(a, b - 1), rec.width[a:b].mean()
        if rate < 100 and width >= 0.12:
            rec.write("AIVR" if gaps.max() > 1.6 * gaps.min() and gaps.min() <= 0.6 else "IVR", a, b - 1)
        elif rate > 100 and (width * rate / 60 >= 0.25 or rate > 140 and width >= 0.12):
            rec.write("VT", a, b - 1)
        elif rate > 100 and width <= 0.12:
            rec.write("SVT", a, b - 1)


def _alternating(name: str, normal: int) -> Callable[[Recording], None]:
    """At least three times so many normal beats and an abnormal one, from either."""
    pattern = re.compile(f"({'N' * normal}V){{3,}}|(V{'N' * normal}){{3,}}")

    def rule(rec: Recording) -> None:
        for m in pattern.finditer(_repaired(rec)):
            rec.write(name, m.start(), m.end() - 1)

    return rule


def junctional(rec: Recording) -> None:
    beats = rec.string(("V", rec.abnormal), ("J", rec.junctional)).replace("JJJVJJJ", "J" * 7).replace("JJJNJJJ", "J" * 7)
    for m in re.finditer("J{3,}", beats):
        if rec.rate(m.start(), m.end() - 1) < 100:
            rec.write("JUNCTIONAL", m.start(), m.end() - 1)


def tachycardia(rec: Recording) -> None:
    """Stretches above 100 a minute, told apart by their P waves and how close these follow the T waves.

    The published rule looks at rates from the second beat on and takes the places for those of beats, which shifts a stretch
    by one; results depend on it and it is kept.
    """
    if rec.n < 5:
        return
    smooth = rec.rr_smooth[1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        fast = (rec.main[1:] != "AFIB") & (smooth > 0) & (60 / smooth > 100)
    for a, b in runs(closing(opening(fast, 5), 2)):
        if b - a < 3 or np.isnan(rec.rr[a : b - 1]).all():
            continue
        at = np.arange(max(a, 1), b - 1)
        rest = rec.p_onset[at] - rec.t_offset[at - 1]
        rest = rest[~np.isnan(rest)]
        if len(rest) / (b - a) >= 0.5:
            rec.write("SVT" if rest.mean() <= 0.05 else "TACHYCARDIA", a, b - 1)
        else:
            rec.write("SVT" if rec.afib[a : b + 1].mean() < 0.25 else "AFIB", a, b - 1)


def _neighbours(rec: Recording, k: int) -> tuple[float, float]:
    """Time from the P wave of the beat before, or else the last P wave, to a dangling one, and on to the next."""
    j, onset = rec.gap[k], rec.p[k]
    earlier, later = rec.p[rec.p < onset], rec.p[rec.p > onset]
    before = rec.p_onset[j] if rec.has_p[j] else earlier[-1] if len(earlier) else np.nan
    return onset - before, later[0] - onset if len(later) else np.nan


def blocked(rec: Recording) -> None:
    """Second-degree block: P waves without a beat, in step with the others, after a steady PR interval."""
    marked = np.zeros(rec.n, bool)

    def mark(j: int) -> bool:
        if (rec.main[j] == "" or marked[j] and rec.main[j] == "") and rec.main[j + 1] == "" and not marked[j + 1]:
            marked[j : j + 2] = True
            return True
        return False

    loose = rec.dangling & (rec.gap >= 0) & (rec.gap < rec.n - 1)
    same = np.concatenate([[False], (rec.gap[1:] == rec.gap[:-1]) & ~rec.p_noise[1:] & loose[:-1]]) if len(rec.p) else loose
    starts = np.flatnonzero(loose & ~same)
    for start in starts:  # several in one gap
        end = start + 1
        while end < len(rec.p) and loose[end] and same[end]:
            end += 1
        j = rec.gap[start]
        if end - start < 2 or not (rec.has_p[j] and rec.has_p[j + 1]):
            continue
        steps = np.diff(np.append(rec.p[start:end], rec.p_onset[j + 1]))
        steady = np.abs(np.diff(steps)).max() <= 0.25 * steps.mean()
        if steady and abs(rec.rr_raw[j + 1] - np.median(steps) * (end - start + 1)) <= 0.1 * rec.rr_raw[j + 1] and mark(j):
            rec.dangling[start:end] = False
    for k in np.flatnonzero(rec.dangling & (rec.gap >= 0) & (rec.gap < rec.n - 1)):  # one in a gap, before the next beat's own
        j = rec.gap[k]
        before, after = _neighbours(rec, k)
        whole = rec.rr_raw[j + 1]
        if rec.between[j] != 2 or not rec.clear(j, j + 1) or rec.p_snr[k] < -6 or np.isnan(rec.pr[j] + rec.pr[j + 1]):
            continue
        in_step = abs(whole - 2 * (rec.p_onset[j + 1] - rec.p[k])) <= 0.2 * whole and not abs(before - after) > 0.2 * before
        if in_step and rec.pr[j] - rec.pr[j + 1] <= 0.03 and mark(j):
            rec.dangling[k] = False
    for a, b in runs(marked):
        rec.write("AVB_TYPE2", a, b - 1)


def sudden_bradycardia(rec: Recording) -> None:
    """Stretches under 45 a minute whose P waves go their own way: PR intervals that wander, or another rate."""
    if rec.n < 5:
        return
    with np.errstate(invalid="ignore", divide="ignore"):
        slow = (rec.rr_raw > 0) & (60 / rec.rr_raw < 45) & (rec.main == "")
    for a, b in runs(opening(slow, 4)):
        a = max(0, a - 1)
        p = rec.p[(rec.p >= rec.r[a]) & (rec.p <= rec.r[b - 1])]
        pr = rec.pr[a:b][~np.isnan(rec.pr[a:b])]
        if len(p) < 3 or b - a < 2 or not len(pr):
            continue
        low, high = np.percentile(pr, [25, 75])
        pr = pr[(pr >= low - 1.5 * (high - low)) & (pr <= high + 1.5 * (high - low))]
        if pr.std() < 0.1 or (pr > 0.3).sum() < 2:
            continue
        beat = np.nanmedian(rec.rr_raw[a:b])
        if abs(beat - np.median(np.diff(p))) > 0.1 * beat or np.median(pr) > 0.3:
            rec.write("SUDDEN_BRADY", a, b - 1)


def wenckebach(rec: Recording) -> None:
    """PR intervals that grow from beat to beat until a P wave stays without one."""
    marked = np.zeros(rec.n, bool)
    for k in np.flatnonzero(rec.dangling & (rec.gap >= 0) & (rec.gap < rec.n - 1)):
        j = rec.gap[k]
        before, after = _neighbours(rec, k)
        last, following = rec.pr[j], rec.pr[j + 1] if rec.pr[j + 1] < 0.5 else np.nan
        rr, whole = rec.rr_raw[j], rec.rr_raw[j + 1]
        if np.isnan(last) or last - following <= 0.03 or abs(before - after) > 0.2 * before:
            continue
        if not (abs(2 * rr - whole) < 0.25 * whole or abs(rr - whole) < 0.1 * whole) or not rec.clear(j, j + 1) or rec.p_snr[k] < -6:
            continue
        first = j  # back to where the growth began
        while first > 0 and rec.has_p[first - 1] and rec.pr[first - 1] < rec.pr[first] and rec.pr[first - 1] <= 0.5 and not rec.junctional[first - 1] and rec.between[first - 1] <= 1:
            first -= 1
        onsets = np.sort(np.concatenate([rec.p_onset[first : j + 1], [rec.p[k]], rec.p_onset[j + 1 : j + 2] if following == following else []]))
        steps = np.diff(onsets)
        grown = rec.pr[first : j + 1]
        if len(grown) < 2 or (np.abs(np.diff(steps)) > 0.25 * np.median(steps)).any() or abs(following - last) > 0.3:
            continue
        if np.isnan(following) and ((grown > 0.5).any() or grown[0] > 0.3 or rec.abnormal[first : j + 1].any()):
            continue
        if marked[j] or rec.main[j] == "" or rec.main[j] == "SUDDEN_BRADY" and len(grown) > 2:
            marked[first : j + 2] = True
    for a, b in runs(marked):
        rec.write("WENCKEBACH", a, b - 1)


def ectopic(rec: Recording) -> None:
    """Three or more inverted P waves; or streaks of P waves of a group other than the tallest, where some have no group.

    The published rule leaves the second part out if all P waves have a group, which is kept.
    """
    if rec.n < 5:
        return
    inverted = rec.has_p & rec.p_inverted & ~rec.junctional & ~np.isin(rec.main, ("SUDDEN_BRADY", "SVT"))
    for a, b in runs(_padded(closing, inverted, 3)):
        if b - a >= 3:
            rec.write("EAR", a, b - 1)
    grouped = ~np.isnan(rec.p_cluster)
    if grouped[rec.has_p].all():
        return
    streaks = {g: list(runs(_padded(opening, (rec.p_cluster == g) & (rec.main == ""), 6))) for g in np.unique(rec.p_cluster[grouped])}
    streaks = {g: s for g, s in streaks.items() if s}
    if len(streaks) > 1:
        tallest = max(streaks, key=lambda g: np.nanmax(rec.p_height[rec.p_cluster == g]))
        for g, found in streaks.items():
            for a, b in found if g != tallest else ():
                rec.write("EAR", a, b - 1)


def sinus(rec: Recording) -> None:
    """Stretches where four of five beats follow a P wave; what is left without one and noisy is noise."""
    if rec.n < 5:
        return
    good = rec.has_p & ~rec.junctional & ~rec.double_p & (rec.main == "") & (rec.pr < 0.5)
    box = np.convolve(np.pad(good.astype(int), 2, constant_values=1), np.ones(5), "valid")
    for a, b in runs(box >= 4):
        known = rec.pr[a:b][~np.isnan(rec.pr[a:b])]
        if b - a < 2 or not len(known):
            continue
        rate = rec.initial_rate() or rec.rate(a, b - 1)
        spread, mean = known.std(), round(float(known.mean()), 2)
        if rate < 50:
            rec.write("BRADYCARDIA", a, b - 1)
        if rec.width[a:b].mean() >= 0.14:
            rec.write("IVB", a, b - 1)
        if mean < 0.2:
            rec.write("NSR", a, b - 1)
        elif spread < 0.1 and mean < 0.5:
            rec.write("AVB_TYPE1", a, b - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        murky = (rec.snr < 20) & (rec.main == "") & ~rec.has_p & (60 / rec.rr_smooth < 100) & ~np.isnan(rec.rr)
    for a, b in runs(closing(opening(np.pad(murky.astype(np.int8), 1), 2), 3)[1:-1]):
        rec.write("NOISE", a, b - 1)


def premature(rec: Recording) -> None:
    """Beats that come earlier than the weighted last three intervals let expect by 1.6449 deviations of the last six, the
    normal law's bound for a chance of 0.05, and by a microsecond at least: PVC if abnormal, else PAC."""
    for k in range(3, rec.n):
        past = rec.rr_raw[max(0, k - 6) : k]
        expected = (3 * past[-1] + 2 * past[-2] + past[-3]) / 6
        if expected - rec.rr_raw[k] > max(1.6449 * past.std(), 1e-6):
            rec.write("PVC" if rec.abnormal[k] else "PAC", k, k)


#: (rule, its switch, what it does), in the order of the rules.
RULES: tuple[tuple[str, str, Callable[[Recording], None]], ...] = (
    ("noise", "NOISE", noise),
    ("fibrillation", "AFIB", fibrillation),
    ("ventricular", "VT", ventricular),
    ("bigeminy", "BIGEMINY", _alternating("BIGEMINY", 1)),
    ("trigeminy", "TRIGEMINY", _alternating("TRIGEMINY", 2)),
    ("quadrigeminy", "TRIGEMINY", _alternating("QUADRIGEMINY", 3)),
    ("junctional", "JUNCTIONAL", junctional),
    ("tachycardia", "SVT", tachycardia),
    ("blocked", "AVB", blocked),
    ("sudden_bradycardia", "CHB", sudden_bradycardia),
    ("wenckebach", "WENCKEBACH", wenckebach),
    ("ectopic", "EAR", ectopic),
    ("sinus", "NSR", sinus),
    ("premature", "PVC", premature),
)
SWITCHES = {switch: True for _, switch, _ in RULES}


def diagnose(waves: DataFrame, chosen: dict[str, bool] | None = None) -> DataFrame:
    """(record, seq, level, name, first, last) of all rules that are switched on, in the order written; `first` and `last` are
    beats. Null flags count as unset; a record without beats has no labels."""
    on = toggles(SWITCHES, chosen or {})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rec = Recording(frame)
        if rec.n:
            for _, switch, rule in RULES:
                if on[switch]:
                    rule(rec)
        rows = [(k, "main" if name in MAIN else "sub", name, a, b) for k, (name, a, b) in enumerate(rec.out)]
        out = pd.DataFrame(rows, columns=["seq", "level", "name", "first", "last"])
        out.insert(0, "record", frame["record"].iloc[0])
        return out

    return waves.groupBy("record").applyInPandas(run, SCHEMA)
