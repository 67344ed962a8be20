"""Filterbanks against a direct transform, long recordings in parts; speaker subsets against plain decoding."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import spectrum as P


def direct(sound):
    """Each frame by the definition: cosines and sines of every bin, triangle by triangle."""
    mel = lambda hz: 1127.0 * math.log(1 + hz / 700.0)
    low, high = mel(20.0), mel(8000.0)
    step = (high - low) / 81
    out = []
    for at in range(0, len(sound) - 399, 160):
        x = np.array(sound[at : at + 400]) * 32768
        x = x - x.mean()
        y = np.array([x[i] - 0.97 * x[max(i - 1, 0)] for i in range(400)])
        y *= np.array([(0.5 - 0.5 * math.cos(2 * math.pi * i / 399)) ** 0.85 for i in range(400)])
        angles = 2 * np.pi * np.outer(np.arange(256), np.arange(400)) / 512
        power = (np.cos(angles) @ y) ** 2 + (np.sin(angles) @ y) ** 2
        row = []
        for band in range(80):
            left = low + band * step
            weights = [max(0.0, min((mel(31.25 * k) - left) / step, (left + 2 * step - mel(31.25 * k)) / step)) for k in range(256)]
            row.append(math.log(max(float(np.dot(weights, power)), 2.0**-23)))
        out.append(row)
    return np.array(out)


def test_filterbanks_are_the_definition_however_the_recording_is_cut(spark):
    rng = np.random.default_rng(5)
    recordings = {1: (0.3 * np.sin(np.arange(2900) * 0.17) + 0.05 * rng.standard_normal(2900)).tolist(), 2: rng.uniform(-1, 1, 400).tolist(), 3: [0.0] * 399, 4: [0.0] * 900}
    for size in (400, 477, 5000):
        rows = [(key, at, sound[at : at + size]) for key, sound in recordings.items() for at in range(0, len(sound), size)]
        parts = spark.createDataFrame(rows, "key int, n long, samples array<double>").repartition(5)
        found = {(r.key, r.frame): r.mel for r in P.filterbank(parts, ["key"], normalise=False).collect()}
        want = {(key, i): row for key, sound in recordings.items() for i, row in enumerate(direct(sound))}
        assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-3) for k in want)
    even = {(r.key, r.frame): r.mel for r in P.filterbank(parts, ["key"]).collect()}
    goal = direct(recordings[1])
    assert np.allclose([even[1, i] for i in range(len(goal))], goal - goal.mean(axis=0), atol=1e-3)
    assert P.filterbank(parts.limit(0), ["key"]).count() == 0


def test_subsets_of_speakers():
    assert P.powerset(7) == [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2)]
    assert P.powerset(2) == [(), (0,)] and P.powerset(4) == [(), (0,), (1,), (0, 1)] and P.powerset(12) is None
    with pytest.raises(ValueError):
        P.marginals("x", 12)


def test_turns_out_of_classes(spark):
    rng, rows = random.Random(2), []
    for w in range(12):
        frames, c = [], 0
        while len(frames) < 50:
            c = rng.randrange(7)
            frames += [[float(i == c) + rng.random() * 0.1 for i in range(7)] for _ in range(rng.randint(1, 12))]
        rows.append((w, w * 5000, 10_000, frames[:50]))
    rows += [(90, 0, 10_000, []), (91, 0, 10_000, [[1.0] * 7] * 50)]  # no frames; of equal classes the last
    want = []
    for w, start, length, frames in rows:
        for speaker in range(3):
            spans = []
            for f, row in enumerate(frames):
                best = max(range(7), key=lambda c: (row[c], c))
                if speaker in P.powerset(7)[best]:
                    a, b = start + round(f * length / 50), start + round((f + 1) * length / 50)
                    if spans and a - spans[-1][1] <= 200:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
            want += [(w, speaker, a, b) for a, b in spans if b - a >= 200]
    windows = spark.createDataFrame(rows, "w int, start_ms long, window_ms long, logits array<array<double>>")
    assert sorted(map(tuple, P.tracks(windows, ["w"], 7).collect())) == sorted(want)
    soft = windows.where("w = 0").select(P.marginals(F.get("logits", F.lit(0)), 7).alias("p")).first().p
    e = np.exp(rows[0][3][0])
    assert np.allclose(soft, [sum(e[c] for c, of in enumerate(P.powerset(7)) if s in of) / e.sum() for s in range(3)])
