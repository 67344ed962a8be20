"""Grouping over meetings against the plain loop, whatever the block; people who merge and learn."""

import random

import numpy as np

from skein.operators import people as P
from skein.operators import read_models as R


def plain(rows, bar=P.LINK):
    groups, out = [], {}
    for order, ident, meeting, v in sorted(rows, key=lambda r: r[:2]):
        if not v:
            continue
        best = None
        for g, (total, met) in enumerate(groups):
            if meeting not in met and len(total) == len(v):
                score = round(float(total @ np.array(v) / (np.linalg.norm(total) * np.linalg.norm(v))), 9)
                if score >= bar and (best is None or score > best[1]):
                    best = (g, score)
        if best:
            total, met = groups[best[0]]
            groups[best[0]] = (total + np.array(v), met | {meeting})
        else:
            groups.append((np.array(v), {meeting}))
        out[ident] = best[0] if best else len(groups) - 1
    return out


def test_voices_are_grouped_as_one_after_another(spark):
    rng = np.random.default_rng(6)
    axes, rows = rng.standard_normal((7, 6)), []
    for i in range(120):
        v = axes[rng.integers(7)] + 0.6 * rng.standard_normal(6)
        rows.append((int(rng.integers(30)), i, int(rng.integers(25)), v.tolist()))
    rows += [(3, 500, 1, None), (3, 501, 1, []), (4, 502, None, [1.0, 0.0]), (5, 503, 99, [1.0, 0.1])]
    prints = spark.createDataFrame(rows, "o int, id int, meeting int, embedding array<double>").repartition(4)
    want = plain(rows)
    assert len(set(want.values())) > 9
    for block in (17, 1000):
        found = {r.id: r.group for r in P.voice_groups(prints, "id", "o", "meeting", block=block).collect()}
        assert found == want
    assert P.voice_groups(prints.limit(0), "id", "o", "meeting").count() == 0


def test_groups_worth_a_name(spark):
    rows = [(i, i, i % 5, [1.0, 0.01 * i, 0.0], 100 + i) for i in range(5)] + [(10 + i, 10 + i, i, [0.0, 0.0, 1.0], 7) for i in range(4)] + [(20, 20, 0, [0.0, 1.0, 0.0], 900)]
    prints = spark.createDataFrame(rows, "o int, id int, meeting int, embedding array<double>, ms long")
    groups = P.voice_groups(prints, "id", "o", "meeting")
    known = R.centroids(spark.createDataFrame([(1, [0.0, 0.1, 1.0])], "person int, embedding array<double>"), ["person"])
    assert [tuple(r) for r in P.suggested(prints, groups, known, "id", "meeting", "ms").collect()] == [(0, 5, 510, 4)]


def test_people_merge_learn_and_forget(spark):
    rng = random.Random(1)
    near = lambda axis: [float(i == axis) + rng.uniform(-0.05, 0.05) for i in range(4)]
    rows = [(i, i % 3, near(i % 3), 50 - i, "mic" if i % 2 else "system") for i in range(30)] + [(90, 0, [1.0], 0, "mic")]
    schema = "id int, person int, embedding array<double>, age int, condition string"
    samples = spark.createDataFrame(rows, schema)
    merges = spark.createDataFrame([(1, 0), (2, 1)], "gone int, into int")
    assert {r.id: r.person for r in P.merged(samples, merges).collect()} == {r[0]: 0 for r in rows}
    new = spark.createDataFrame([(29, 2, near(2), 0, "mic"), (30, 7, near(3), 0, "mic")], schema)
    kept, centres = P.learned(samples, new, spark.createDataFrame([(1, 7)], "gone int, into int"), "id", "age", "condition", keep=8)
    held = {}
    for r in kept.collect():
        held.setdefault(r.person, set()).add(r.id)
    assert set(held) == {0, 2, 7} and all(len(ids) <= 8 for ids in held.values()) and 90 not in held[0] and 30 in held[7] | {30}
    assert {r.person for r in centres.collect()} == {0, 2, 7}
    vectors = {r.id: np.array(r.embedding) for r in kept.collect()}
    total = sum(vectors[i] for i in held[0])
    assert np.allclose([r.x for r in centres.where("person = 0").orderBy("i").collect()], total / np.linalg.norm(total))
