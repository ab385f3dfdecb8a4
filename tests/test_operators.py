import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import patterns, stats, waveform
from pulseloom.operators import detect, evaluate, joins, regions, sequence
from pulseloom.sources import recordings
from pulseloom.streaming import streams


def series(spark, values, name="m", record=1):
    return spark.createDataFrame([(record, i, float(v)) for i, v in enumerate(values)], f"record long, i long, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_regions_and_their_two_end_conventions(spark):
    rows = series(spark, [0, 1, 1, 0, 1])
    spans = lambda **k: sorted((r.start, r.end) for r in regions.regions(rows, F.col("m") == 1, **k).collect())
    assert spans() == [(1, 3), (4, 5)]
    assert spans(closed=True) == [(1, 3), (4, 4)]


def test_shifted_morphology(spark):
    assert [i for i, v in enumerate(column(regions.closing_shifted(series(spark, [0, 0, 0, 0, 1, 0, 0, 0]), "m", 3), "closed")) if v] == [5]
    ones = [float(8 <= i <= 14) for i in range(24)]
    assert [i for i, v in enumerate(column(regions.opening_shifted(series(spark, ones), "m", 5), "opened")) if v] == list(range(9, 16))


def test_smoothing_in_place(spark):
    got = column(sequence.smooth_in_place(series(spark, [1, 4, 2, 8, 3], "rr"), "rr"), "smooth")
    assert got == pytest.approx([1, 2.3333, 4.1111, 5.0370, 3], abs=1e-4)
    assert column(sequence.smooth_in_place(series(spark, [7], "rr"), "rr"), "smooth") == [7]


def beats(spark, letters):
    return spark.createDataFrame([(1, i, float(i), k) for i, k in enumerate(letters)], "record long, i long, t double, kind string")


def test_patterns_with_positions(spark):
    strings = patterns.beat_string(beats(spark, "NNVNVNVNNN"))
    found = patterns.find_all(strings, "BIGEMINY", patterns.PATTERNS["BIGEMINY"]).collect()
    assert [(r.first, r.last) for r in found] == [(1, 6)]
    repaired = patterns.repaired(patterns.beat_string(beats(spark, "VVVNVVV")))
    assert [(r.first, r.last) for r in patterns.find_all(repaired, "V", "V{3,}").collect()] == [(0, 6)]


def test_patterns_against_finditer(spark):
    import re

    rng = random.Random(4)
    strings = ["".join(rng.choices("NV", k=rng.randrange(40))) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(strings)), "record long, beats string")
    for name, p in patterns.PATTERNS.items():
        got = sorted((r.record, r.first, r.last) for r in patterns.find_all(rows, name, p).collect())
        assert got == sorted((k, m.start(), m.end() - 1) for k, s in enumerate(strings) for m in re.finditer(p, s))


def test_rmssd(spark):
    assert stats.rmssd(series(spark, [1, 2, 4], "x"), "x").first().rmssd == pytest.approx(math.sqrt(2.5))
    assert stats.rmssd(series(spark, [1], "x"), "x").first().rmssd == 0


def points(spark, values):
    return spark.createDataFrame([(1, float(v)) for v in values], "record long, t double")


def test_match_counts(spark):
    r = joins.match_counts(points(spark, [110, 500]), points(spark, [100, 300]), 30.0).first()
    assert (r.tp, r.fn, r.fp) == (1, 1, 1)
    edge = joins.match_counts(points(spark, [100]), points(spark, [130]), 30.0).first()
    assert (edge.tp, edge.fn, edge.fp) == (0, 1, 0)


def test_tolerance_joins_against_all_pairs(spark):
    rng = random.Random(1)
    a, b = [rng.uniform(0, 300) for _ in range(60)], [rng.uniform(0, 300) for _ in range(60)]
    got = {r.t: r.t2 for r in joins.nearest(points(spark, a), points(spark, b), 5.0).collect()}
    assert got == {x: min((y for y in b if abs(x - y) < 5), key=lambda y: abs(x - y), default=None) for x in a}
    got = {r.t: r.t2 for r in joins.last_before(points(spark, a), points(spark, b)).collect()}
    assert got == {x: max((y for y in b if y < x), default=None) for x in a}
    got = {r.t: r.t2 for r in joins.first_after(points(spark, a), points(spark, b), 5.0).collect()}
    assert got == {x: y if (y := min((y for y in b if y > x), default=None)) is not None and y - x < 5 else None for x in a}


def test_clip_and_last_writer(spark):
    label = spark.createDataFrame([(1, "A", 50, 150)], "record long, name string, start long, end long")
    segment = spark.createDataFrame([(1, 0, 100, 200)], "record long, seg long, s0 long, s1 long")
    r = joins.clip(label, segment).first()
    assert (r.start, r.end) == (0, 50)
    labels = spark.createDataFrame([(1, "NSR", 1, 0, 100), (1, "AVB", 2, 50, 80)], "record long, name string, seq long, first long, last long")
    marks = spark.createDataFrame([(1, 40), (1, 60)], "record long, i long")
    assert [r.diagnosis for r in joins.label_beats(marks, labels).orderBy("i").collect()] == ["NSR", "AVB"]


def test_rates(spark):
    rows = spark.createDataFrame([(2, 2, 1, 5)], "tp long, fp long, fn long, tn long")
    r = rows.select(*[v.alias(k) for k, v in evaluate.rates(*map(F.col, ("tp", "fp", "fn", "tn"))).items()]).first()
    assert r.npv == pytest.approx(5 / 7) and r.npv_true == pytest.approx(5 / 6) and r.f1 == pytest.approx(4 / 7)


def test_bootstrap_holds_the_mean(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("y"))
    r = evaluate.bootstrap_mean(rows, "y").first()
    assert r.low < 4.5 < r.high and r.mean == pytest.approx(4.5, abs=0.05)


def test_waveform_functions(spark):
    x = np.sin(np.arange(64) / 5)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    at = lambda c: df.select(c.alias("v")).first().v
    assert at(waveform.resample(F.col("x"), 50)) == pytest.approx(np.interp(np.linspace(0, 63, 50), np.arange(64), x))
    assert at(waveform.convolve(F.col("x"), [1.0, 2.0, 3.0])) == pytest.approx(np.convolve(x, [1, 2, 3]))
    assert at(waveform.zscore(F.col("x"))) == pytest.approx((x - x.mean()) / x.std())
    assert at(waveform.zscore(F.transform("x", lambda v: F.lit(3.0)))) == [0.0] * 64
    assert at(waveform.shift(F.col("x"), 2))[:3] == [0, 0, x[0]] and at(waveform.shift(F.col("x"), -2))[-3:] == [x[63], 0, 0]
    assert len(at(waveform.pad(F.col("x"), 48))) == 96


def test_butterworth_passes_low_and_stops_high():
    t = np.arange(2000) / 250
    gain = lambda f: np.std(waveform.run_sections(np.sin(2 * np.pi * f * t), waveform.butterworth(4, 30, 250), False)[500:]) / np.std(np.sin(2 * np.pi * f * t)[500:])
    assert gain(2) == pytest.approx(1, abs=0.01) and gain(30) == pytest.approx(2**-0.5, abs=0.01) and gain(90) < 0.01


def test_detector_finds_beats():
    fs, x = 250, np.zeros(2500)
    for t in range(125, 2500, 250):
        x[t - 5 : t + 6] += np.hanning(11)
    found = detect.adaptive_peaks(x + 0.01 * np.random.default_rng(0).standard_normal(len(x)), fs)
    assert len(found) == 10 and all(abs(a - b) <= 12 for a, b in zip(found, range(125, 2500, 250), strict=True))


def test_clusterings():
    a, b = np.sin(np.arange(40) / 4), np.sign(np.sin(np.arange(40) / 2))
    assert detect.leaders([a, b, a + 0.01, b, a], least=0.8) == [0, 1, 0, 1, 0]
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert detect.complete_linkage(d) == [0, 0, 1]
    assert detect.polarity(np.array([0, 0.5, -0.1])) == "positive" and detect.polarity(np.array([0.001, 0])) == "flat"


def test_header_and_signal(spark, tmp_path):
    (tmp_path / "r1.hea").write_text("r1 2 200 6\nr1.dat 16+24 1000(0)/mV 16 0 0 0 0 II\nr1.dat 16+24 500(10)/mV 16 0 0 0 0 V1\n")
    raw = np.array([[1000, 10], [2000, 510], [0, -490], [-32768, 10], [500, 10], [0, 10]], "<i2")
    (tmp_path / "r1.dat").write_bytes(b"\0" * 24 + raw.tobytes())
    head = recordings.headers(spark, f"{tmp_path}/*.hea").first()
    assert (head.record, head.n_signals, head.fs, head.n_samples) == ("r1", 2, 200.0, 6)
    got = {r.lead: r.sig for r in recordings.signals(spark, str(tmp_path)).collect()}
    assert got["V1"] == [0, 1, -1, 0, 0, 0] and got["II"][:3] == [1, 2, 0] and got["II"][3] is None
    part = {r.lead: r.sig for r in recordings.signals(spark, str(tmp_path), middle_seconds=0.01).collect()}
    assert part["V1"] == [1, -1] or part["V1"] == [-1, 0]


def test_annotations_episodes_and_indexes(spark, tmp_path):
    words = [(1 << 10) | 100, (28 << 10) | 50, (63 << 10) | 5, *np.frombuffer(b"(AFIB\0", "<u2").tolist(), 59 << 10, 1, 4, (5 << 10) | 0, 0]
    (tmp_path / "a.atr").write_bytes(np.array(words, "<u2").tobytes())
    got = [(r.record, r.sample, r.symbol, r.note) for r in recordings.annotations(spark, f"{tmp_path}/*.atr").collect()]
    assert got == [("a", 100, "N", ""), ("a", 150, "+", "(AFIB"), ("a", 150 + 65540, "V", "")]
    (tmp_path / "e.json").write_text('{"ECG_ID": "x", "episodes": [{"onset": 1, "rhythm_name": "NSR", "offset": 9}]}')
    r = recordings.episodes(spark, f"{tmp_path}/e.json").first()
    assert (r.record, r.name, r.onset, r.offset) == ("x", "NSR", 1, 9)
    (tmp_path / "s.csv").write_text("A,b,Atrial, afib ,AF\nA,c\n")
    assert sorted(r.synonym for r in recordings.synonyms(spark, f"{tmp_path}/s.csv").collect()) == ["af", "afib", "atrial"]
    (tmp_path / "RECORDS").write_text("x/a1\n\nx/a2\n")
    assert sorted(r.record for r in recordings.record_index(spark, f"{tmp_path}/RECORDS").collect()) == ["a1", "a2"]
    (tmp_path / "ref.csv").write_text("A1,N\nA2,~\n")
    assert {r.record: r.label for r in recordings.reference_labels(spark, f"{tmp_path}/ref.csv").collect()} == {"A1": "N", "A2": "~"}


def test_streams_give_what_batches_give(spark, tmp_path):
    schema = "record long, ts timestamp, kind string"
    rows = spark.range(400).select((F.col("id") % 7).alias("record"), F.timestamp_seconds(F.col("id") * 613).alias("ts"), F.when(F.col("id") % 3 == 0, "V").otherwise("N").alias("kind"))
    far = spark.createDataFrame([(99,)], "record long").select("record", F.timestamp_seconds(F.lit(10**8)).alias("ts"), F.lit("N").alias("kind"))
    for k in range(4):  # in order of time, and one late row that moves the watermark past all others
        rows.where(f"ts >= timestamp_seconds({k} * 61300) AND ts < timestamp_seconds({k + 1} * 61300)").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    far.coalesce(1).write.parquet(str(tmp_path / "in/4"))
    stored = spark.read.schema(schema).parquet(f"{tmp_path}/in/*")
    for name, operator in (("tumble", streams.tumbling), ("slide", streams.sliding), ("sessions", streams.sessions)):
        stream = operator(streams.replay(spark, f"{tmp_path}/in/*", schema))
        got = streams.run_to_table(stream, name, str(tmp_path / name)).where("record < 99")
        want = operator(stored).where("record < 99")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()


def test_stateful_fold_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, float(t)) for t in (0, 3, 5, 9, 10, 16)], "record long, t double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.refractory(streams.replay(spark, str(tmp_path / "in"), "record long, t double"), 5.0)
    assert [r.t for r in streams.run_to_table(stream, "kept", str(tmp_path / "c")).orderBy("t").collect()] == [0, 5, 10, 16]


def test_sink_replaces_a_batch_run_again(spark, tmp_path):
    write = streams.idempotent_sink(str(tmp_path))
    for _ in range(2):
        write(spark.range(5), 0)
    write(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 8


def test_disjoint_intervals(spark):
    rng = random.Random(6)
    rows = [(i, a, a + rng.choice([0.1, 1.0, 8.0])) for i, a in enumerate(rng.uniform(0, 300) for _ in range(200))]
    want = {i for i, a, b in rows if all(j == i or c > b or d < a for j, c, d in rows)}
    got = {r.k for r in joins.disjoint(spark.createDataFrame(rows, "k long, low double, high double"), "k", "low", "high").collect()}
    assert got == want and want
    assert joins.disjoint(spark.createDataFrame([(1, 2.0, 3.0)], "k long, low double, high double"), "k", "low", "high").count() == 1


def test_a_record_in_two_files(spark, tmp_path):
    (tmp_path / "m.hea").write_text("m 3 100 4\na.dat 16 100(0)/mV 16 0 0 0 0 I\na.dat 16 100(0)/mV 16 0 0 0 0 II\nb.dat 16 50(5)/mV 16 0 0 0 0 V1\n")
    (tmp_path / "a.dat").write_bytes(np.array([[100, 200], [0, 0], [300, 400], [1, 2]], "<i2").tobytes())
    (tmp_path / "b.dat").write_bytes(np.array([5, 55, 105, -45], "<i2").tobytes())
    got = {r.lead: r.sig for r in recordings.signals(spark, str(tmp_path)).collect()}
    assert got == {"I": [1, 0, 3, 0.01], "II": [2, 0, 4, 0.02], "V1": [0, 1, 2, -1]}
    got = {r.lead: r.sig for r in recordings.signals(spark, str(tmp_path), middle_seconds=0.02).collect()}
    assert got == {"I": [0, 3], "II": [0, 4], "V1": [1, 2]}
    assert recordings.read_range(f"file:{tmp_path}/b.dat", 2, 2) == (55).to_bytes(2, "little")
