"""Registered queries without a SQL twin against folds in plain Python, on all rows of small tables."""

import random

import numpy as np
import pytest

from pulseloom.functions import waveform
from pulseloom.plans import catalog


def tables(spark, path, **rows):
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def waves(n, size, seed, labels=2):
    rng = random.Random(seed)
    shapes = [[4.0 * k + rng.choice((-1.0, 1.0)) * rng.random() for _ in range(size)] for k in range(4)]
    return [(i, [v + rng.uniform(-0.1, 0.1) for v in rng.choices(shapes, (40, 20, 10, 2))[0]], rng.randrange(labels)) for i in range(n)]


WAVES = "vec_id long, embedding array<float>, label int"


def warp(x, y, band=20):
    cost = {(0, 0): 0.0}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            if abs(i - j) <= band:
                cost[i, j] = abs(x[i - 1] - y[j - 1]) + min(cost.get(k, float("inf")) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return cost.get((len(x), len(y)), float("inf"))


def lead(rows):
    """Clusters of one label's waveforms, in order."""
    templates, used, out = [], [], []
    for k, x in enumerate(rows):
        like = [1 / (1 + warp(x, t) / len(x) / (np.std(x) + 1e-9)) for t in templates]
        fit = [c for c in range(len(like)) if like[c] > 0.3 and k - used[c] <= 15] or [c for c in range(len(like)) if like[c] > 0.3]
        if fit:
            c = max(fit, key=lambda c: like[c])
            templates[c] = [t + 0.125 * (v - t) for t, v in zip(templates[c], x, strict=True)]
        else:
            c = len(templates)
            templates.append(x)
            used.append(k)
        used[c] = k
        out.append(c)
    return out


def test_leader_clusters_hold_every_waveform(spark, tmp_path):
    rows = waves(260, 12, 1)
    sf = tables(spark, tmp_path, embeddings=(WAVES, random.Random(0).sample(rows, len(rows))))
    want = set()
    for label in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == label]
        want |= {(label, r[0], c) for r, c in zip(mine, lead([np.float32(r[1]).astype(float).tolist() for r in mine]), strict=True)}
    got = [tuple(r) for r in catalog.QUERIES["leader_clusters"](spark, sf).collect()]
    assert len(got) == len(rows) and set(got) == want and len({c for _, _, c in want}) > 2


@pytest.mark.parametrize("n, m, band", [(64, 64, 20), (64, 64, 8), (30, 10, 20), (50, 10, 20), (7, 5, 0), (1, 1, 20), (0, 0, 20), (0, 2, 20)])
def test_warping_of_many_pairs_at_once(n, m, band):
    rng = np.random.default_rng(n + m)
    x, y = rng.normal(size=(3, n)), rng.normal(size=(3, m))
    assert waveform.dtw_distances(x, y, band).tolist() == [warp(a, b, band) for a, b in zip(x.tolist(), y.tolist(), strict=True)]


def test_warped_distance_of_every_waveform(spark, tmp_path):
    rows = waves(130, 40, 2) + [(k, [0.5] * 9 + [float(k % 3)] * 3, 0) for k in (130, 131)]
    sf = tables(spark, tmp_path, embeddings=(WAVES, rows))
    wide = [np.float32(r[1]).astype(float).tolist() for r in rows]
    got = {r.record: r.d for r in catalog.QUERIES["warped_distance"](spark, sf).collect()}
    assert sorted(got) == list(range(131))
    assert got == pytest.approx({k: warp(wide[k], wide[k + 1]) for k in range(131)}, abs=1e-4)


def test_prominence_reaches_past_ten_beats_and_stops_at_a_higher_one(spark):
    from pulseloom.operators import sequence

    rng = random.Random(3)
    records = {k: [float(rng.randrange(80, 130)) for _ in range(n)] for k, n in ((1, 300), (2, 40), (3, 1), (4, 2))}
    records[5] = [0.0] + [90.0] * 14 + [120.0] + [95.0] * 14 + [10.0, 130.0, 5.0]
    rows = spark.createDataFrame([(k, i, v) for k, vs in records.items() for i, v in enumerate(vs)], "record long, i long, v double")
    want = {}
    for k, vs in records.items():
        for i in range(1, len(vs) - 1):
            if vs[i] > max(vs[i - 1], vs[i + 1], 100):
                sides = [next((s[: n + 1] for n in range(len(s)) if n + 1 == len(s) or s[n + 1] > vs[i]), s) for s in (vs[i::-1], vs[i:])]
                want[k, i] = vs[i] - max(map(min, sides))
    got = {(r.record, r.i): r.prominence for r in sequence.peak_prominence(rows, "v", 100.0).collect()}
    assert got == want and want[5, 15] == 110.0


def test_all_pairs_of_a_group_over_blocks_and_gaps(spark):
    from pulseloom.operators import joins

    rows = [(3 * i - 40, x, label) for i, x, label in waves(60, 6, 4, labels=3)]
    frame = spark.createDataFrame(rows, "record long, x array<double>, label int")
    want = {(a[0], b[0]): float(np.sqrt(np.mean((np.array(a[1]) - b[1]) ** 2))) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2]}
    for block in (5, 1000):
        got = [tuple(r) for r in joins.all_pairs_rmse(frame, "label", block).collect()]
        assert len(got) == len(want) and {(a, b): d for a, b, d in got} == pytest.approx(want)
    assert joins.all_pairs_rmse(frame.limit(0), "label").count() == 0


def test_threshold_grid_at_scores_on_thresholds(spark):
    from pulseloom.operators import evaluate

    rows = [(k % 3 == 0, k / 100) for k in range(101)] + [(k % 2 == 0, k / 1000) for k in range(0, 1000, 7)]
    frame = spark.createDataFrame(rows, "y boolean, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    got = [(r.threshold, r.balanced) for r in evaluate.threshold_grid(frame, "y", "s").orderBy("threshold").collect()]
    assert len(got) == 99
    assert dict(got) == pytest.approx({k / 100: (sum(s > k / 100 for s in pos) / len(pos) + sum(s <= k / 100 for s in neg) / len(neg)) / 2 for k in range(1, 100)})
    best = evaluate.best_threshold(frame, "y", "s").first()
    assert best.balanced == pytest.approx(max(b for _, b in got))
