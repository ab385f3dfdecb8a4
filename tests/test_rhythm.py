"""Each rhythm rule on a recording made for it."""

import numpy as np
import pandas as pd
import pytest

from pulseloom.operators import rhythm, waves


def recording(times, p=0.16, **columns):
    """Waves of beats at some times with a P wave `p` seconds before each (None: none), and what else is given."""
    n, times = len(times), np.array(times, float)
    rr = np.diff(times, prepend=2 * times[0] - times[1])
    pr = np.broadcast_to(np.array([np.nan if p is None else p] if np.isscalar(p) or p is None else p, float), (n,)).copy()
    beats = {
        "wave": "beat", "record": 1, "r": times, "onset": times - 0.04, "offset": times + 0.06, "width": 0.1, "abnormal": False, "junctional": False, "double_p": False, "pr": pr,
        "rr": rr, "rr_raw": rr, "rr_smooth": rr, "snr": 40.0, "p_onset": times - pr, "p_inverted": False, "p_height": 1.0, "t_offset": times + 0.3, "p_cluster": 0.0, "noise": False,
        "afib": False, "unmatched": False, "snr_db": 0.0,
    }
    extra = columns.pop("dangling", [])
    frame = pd.DataFrame({**beats, **columns})
    onsets = sorted([x for x in frame["p_onset"] if x == x] + list(extra))
    waves = pd.DataFrame({"wave": "p", "record": 1, "onset": onsets, "offset": np.array(onsets) + 0.08, "unmatched": [x in extra for x in onsets], "snr_db": 0.0, "noise": False})
    whole = pd.concat([frame, waves], ignore_index=True)
    flags = ["abnormal", "junctional", "double_p", "p_inverted", "noise", "afib", "unmatched"]
    return whole.assign(**{c: whole[c].eq(True) for c in flags})


def labels(waves, *rules):
    rec = rhythm.Recording(waves)
    for name, _, rule in rhythm.RULES:
        if not rules or name in rules:
            rule(rec)
    return rec.out


def flags(text, mark="V"):
    return np.array([c == mark for c in text])


STEADY = np.arange(20) * 0.8


def test_morphology_has_the_shifted_frames():
    x = np.zeros(20, int)
    x[4] = 1
    assert np.flatnonzero(rhythm.closing(x, 3)).tolist() == [5]
    x = np.zeros(20, int)
    x[8:15] = 1
    assert np.flatnonzero(rhythm.opening(x, 5)).tolist() == list(range(9, 16))
    assert list(rhythm.runs(np.array([0, 1, 1, 0, 1], bool))) == [(1, 3), (4, 5)]


def test_sinus_rhythm_and_its_kin():
    assert labels(recording(STEADY)) == [("NSR", 0, 19)]
    assert labels(recording(STEADY, p=0.3)) == [("AVB_TYPE1", 0, 19)]
    assert labels(recording(STEADY * 2)) == [("BRADYCARDIA", 0, 19), ("NSR", 0, 19)]
    assert labels(recording(STEADY, width=0.15)) == [("IVB", 0, 19), ("NSR", 0, 19)]
    assert labels(recording(STEADY, p=None, snr=10.0)) == [("NOISE", 2, 19)]  # the shifted frames again
    assert labels(recording(STEADY[:4])) == []


@pytest.mark.parametrize(
    ("gap", "width", "want"),
    [(0.8, 0.14, "IVR"), (0.5, 0.14, "VT"), (0.4, 0.14, "VT"), (0.5, 0.1, "SVT")],
)
def test_ventricular_runs(gap, width, want):
    kinds = flags("NNNVVVVVVNNN")
    assert labels(recording(np.arange(12) * gap, abnormal=kinds, width=width), "ventricular") == [(want, 3, 8)]
    assert labels(recording(np.arange(12) * gap, abnormal=kinds, width=width, p=0.6), "ventricular") == []


def test_uneven_ventricular_runs():
    times = np.cumsum([0, 0.8, 0.8, 0.8, 0.5, 0.9, 0.9, 0.9, 0.8, 0.8])
    assert labels(recording(times, abnormal=flags("NNNVVVVVNN"), width=0.14), "ventricular") == [("AIVR", 3, 7)]
    assert labels(recording(times + 1.2 * (np.arange(10) > 4) * 2, abnormal=flags("NNNVVVVVNN"), width=0.14), "ventricular") == []


def test_patterns_repair_and_switch(spark):
    assert labels(recording(STEADY[:10], abnormal=flags("NNVNVNVNNN")), "bigeminy") == [("BIGEMINY", 1, 6)]
    assert labels(recording(STEADY[:9], abnormal=flags("NNVNNVNNV")), "trigeminy") == [("TRIGEMINY", 0, 8)]
    assert labels(recording(STEADY[:12], abnormal=flags("NNNVNNNVNNNV")), "quadrigeminy") == [("QUADRIGEMINY", 0, 11)]
    assert labels(recording(STEADY[:8], abnormal=flags("VVVNNVVV"), width=0.14), "ventricular") == [("IVR", 0, 7)]
    waves = spark.createDataFrame(recording(STEADY[:12], abnormal=flags("NNNVNNNVNNNV")))
    name = lambda chosen: {r["name"] for r in rhythm.diagnose(waves, chosen).collect()}
    assert "QUADRIGEMINY" in name({}) and "QUADRIGEMINY" not in name({"TRIGEMINY": False})


def test_junctional_and_fast_rhythms():
    assert labels(recording(STEADY, p=None, junctional=True), "junctional") == [("JUNCTIONAL", 0, 19)]
    assert labels(recording(STEADY / 2, p=None, junctional=True), "junctional") == []
    fast = STEADY / 2
    assert labels(recording(fast, p=0.1, t_offset=fast + 0.1), "tachycardia")[0][0] == "TACHYCARDIA"
    assert labels(recording(fast, p=0.1, t_offset=fast + 0.28), "tachycardia")[0][0] == "SVT"
    assert labels(recording(fast, p=None), "tachycardia")[0][0] == "SVT"
    assert labels(recording(fast, p=None, afib=np.arange(20) % 2 == 0), "tachycardia")[0][0] == "AFIB"


def test_a_dropped_beat_is_a_block():
    times = np.concatenate([np.arange(8) * 0.8, np.arange(9, 16) * 0.8])
    waves = recording(times, dangling=[8 * 0.8 - 0.16])
    assert labels(waves, "blocked") == [("AVB_TYPE2", 7, 8)]
    assert labels(waves, "blocked", "wenckebach") == [("AVB_TYPE2", 7, 8)]  # the wave is taken
    times = np.concatenate([np.arange(8) * 0.8, np.arange(10, 16) * 0.8])
    assert labels(recording(times, dangling=[8 * 0.8 - 0.16, 9 * 0.8 - 0.16]), "blocked") == [("AVB_TYPE2", 7, 8)]
    assert labels(recording(times, dangling=[8 * 0.8 - 0.16, 9 * 0.8 - 0.5]), "blocked") == []


def test_growing_intervals_before_a_dropped_beat():
    p_times = np.arange(12) * 0.8
    pr = np.array([0.16, 0.16, 0.16, 0.2, 0.25, 0.3, 0, 0.16, 0.16, 0.16, 0.16, 0.16])
    beat = np.arange(12) != 6
    waves = recording((p_times + pr)[beat], p=pr[beat], dangling=[p_times[6]])
    assert labels(waves, "wenckebach") == [("WENCKEBACH", 2, 6)]
    assert labels(waves, "blocked") == []


def test_slow_beats_with_wandering_intervals():
    times = np.concatenate([np.arange(5) * 0.8, 3.2 + np.arange(1, 9) * 1.6])
    pr = np.where(np.arange(13) < 5, 0.16, np.tile([0.1, 0.45, 0.7], 5)[:13])
    assert [x[0] for x in labels(recording(times, p=pr), "sudden_bradycardia")] == ["SUDDEN_BRADY"]
    assert labels(recording(times), "sudden_bradycardia") == []


def test_ectopic_rhythms():
    inverted = np.isin(np.arange(20), [5, 6, 8, 9])
    assert [x[0] for x in labels(recording(STEADY, p_inverted=inverted), "ectopic")] == ["EAR"]
    group = np.where(np.arange(20) < 10, 0.0, 1.0)
    height = np.where(group == 0, 2.0, 1.0)
    assert labels(recording(STEADY, p_cluster=group, p_height=height), "ectopic") == []  # all have a group
    group[0] = np.nan
    assert [x[0] for x in labels(recording(STEADY, p_cluster=group, p_height=height), "ectopic")] == ["EAR"]


def test_later_rules_see_earlier_labels():
    out = labels(recording(STEADY, afib=np.arange(20) < 8, noise=np.arange(20) > 15))
    assert out[0] == ("NOISE", 16, 19) and out[1] == ("AFIB", 0, 7)
    assert ("NSR", 0, 19) not in out and any(name == "NSR" and a >= 6 and b <= 17 for name, a, b in out)


def test_premature_beats_and_initial_rate():
    times = STEADY.copy()
    times[10] -= 0.3
    assert ("PAC", 10, 10) in labels(recording(times), "premature")
    assert ("PVC", 10, 10) in labels(recording(times, abnormal=np.arange(20) == 10), "premature")
    rec = rhythm.Recording(recording(STEADY))
    assert rec.initial_rate() == pytest.approx(75)
    rec = rhythm.Recording(recording(STEADY, abnormal=np.arange(20) % 2 == 0))
    assert rec.initial_rate() == pytest.approx(75)
    assert rhythm.Recording(recording(STEADY, abnormal=True)).initial_rate() is None


def test_records_are_independent_and_may_be_empty(spark):
    one, two = recording(STEADY), recording(STEADY, p=0.3)
    two["record"] = 2
    only_p = one[one["wave"] == "p"].assign(record=3)
    waves = spark.createDataFrame(pd.concat([one, two, only_p], ignore_index=True))
    got = sorted(tuple(r) for r in rhythm.diagnose(waves).collect())
    assert got == [(1, 0, "main", "NSR", 0, 19), (2, 0, "main", "AVB_TYPE1", 0, 19)]


def fibrillation_by_walking(mask, noise, doubt, beats, abnormal, has_p, fs):
    """The same steps, sample by sample."""
    m = [bool(x) for x in mask]
    kinds = "".join("V" if x else "N" for x in abnormal)
    for unit in ("V", "NV", "NNV"):
        k = 0
        while k < len(kinds):
            n = 0
            while kinds.startswith(unit, k + n * len(unit)):
                n += 1
            if n >= 3:
                for j in range(beats[k], beats[k + n * len(unit) - 1] + 1):
                    m[j] = False
                k += n * len(unit)
            else:
                k += 1
    if len(beats) >= 5:
        most = [sum(has_p[max(0, i - 2) : i + 3]) / len(has_p[max(0, i - 2) : i + 3]) > 0.5 for i in range(len(beats))]
        for i in range(len(beats)):
            if most[i]:
                last = i
                while last + 1 < len(beats) and most[last + 1]:
                    last += 1
                for j in range(beats[i], beats[last] + 1):
                    m[j] = False
    m = [x and not y for x, y in zip(m, noise, strict=True)]

    def frame(x, f):
        half = fs // 2
        return [f(x[max(0, i - half) : i + half]) for i in range(len(x))]

    def islands(x):
        out, start = [], None
        for i, v in enumerate([*x, False]):
            if v and start is None:
                start = i
            if not v and start is not None:
                out.append((start, i))
                start = None
        return out

    m = frame(frame(m, any), all)
    for a, b in islands(m):
        if sum(a <= x <= b for x in beats) < 3:
            m[a:b] = [False] * (b - a)
    m = frame(frame(frame(frame(m, all), any), any), all)
    for a, b in islands(m):
        if b - a < 3 * fs and sum(np.log(doubt[k] + 0.0001) for k in range(a, b)) / (b - a) >= -5:
            m[a:b] = [False] * (b - a)
    return m


@pytest.mark.parametrize("seed", range(30))
def test_fibrillation_against_a_walk(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 160))
    mask, noise = np.repeat(rng.random(n) < 0.7, 3)[:n], rng.random(n) < 0.02
    doubt, beats = rng.random(n) ** 4 / 50, np.flatnonzero(rng.random(n) < 0.4)
    abnormal, has_p = rng.random(len(beats)) < 0.4, rng.random(len(beats)) < 0.4
    got = waves.corrected_fibrillation(mask, noise, doubt, beats, abnormal, has_p, 4)
    assert got.tolist() == fibrillation_by_walking(mask, noise, doubt, beats, abnormal, has_p, 4)


def test_the_peak_of_a_wave():
    x = np.concatenate([np.zeros(10), [0.1, 0.4, 2.0, 0.3, -0.5, 0], np.zeros(10)])
    assert waves.r_peak(x, 10, 16) == 12
    assert waves.r_peak(-x, 10, 16) == 12
    assert 0 <= waves.r_peak(np.arange(20.0), 5, 15) - 5 < 10
