"""Labels of windows, known people, and lines among voices: against plain versions and cases with known answers."""

import random

import numpy as np

from skein.operators import attribution as A
from skein.operators import read_models as R


def test_labels_carry_on(spark):
    rng, rows, want = random.Random(4), [], []
    for key in (1, 2):
        before, last = {}, None
        for w in sorted(rng.sample(range(60), 40)):
            now = {}
            for local in range(3):
                label, active, on = rng.choice([None, None, 7, 8]), rng.random() < 0.9, rng.choice([None, 0, 1, 2])
                rows.append((key, w, local, label, active, on))
                now[local] = label if label is not None else before.get(on) if active and last == w - 1 else None
                want.append((key, w, local, now[local]))
            before, last = now, w
    rng.shuffle(rows)
    found = A.window_labels(spark.createDataFrame(rows, "key int, w long, local long, label long, active boolean, continues long"), ["key"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert A.window_labels(spark.createDataFrame([], "key int, w long, local long, label long, active boolean, continues long"), ["key"]).count() == 0


def test_known_people_make_groups_that_never_meet(spark):
    rng = np.random.default_rng(3)
    axes = np.eye(8)
    near = lambda axis, noise: (axes[axis] + noise * rng.standard_normal(8)).tolist()
    rows, truth = [], {}
    for meeting in (0, 1):
        for who in range(4):  # two known people, two strangers
            for i in range(12):
                # in the second meeting person 1 is there for a moment only
                rows.append((meeting, len(rows), near(who, 0.03), 100 if meeting == 1 and who == 1 else 1000))
                truth[len(rows) - 1] = who
    known = R.centroids(spark.createDataFrame([(p, axes[p].tolist()) for p in (0, 1, 5)], "person int, embedding array<double>"), ["person"])
    prints = spark.createDataFrame(rows, "meeting int, id int, embedding array<double>, weight int")
    fixed = {r.id: r.person for r in A.seeds(prints, known, ["meeting"], "id").collect()}
    assert fixed == {i: who for i, who in truth.items() if who == 0 or who == 1 and i < 48}
    found = A.guided(prints, known, ["meeting"], "id").collect()
    assert sorted(r.id for r in found) == sorted(truth)
    groups = {}
    for r in found:
        assert (r.person is None) != (r.cluster is None)
        groups.setdefault((r.meeting, r.person, r.cluster), set()).add(truth[r.id])
    assert all(of == {person} for (_, person, _), of in groups.items() if person is not None)  # a released moment may go to any stranger
    assert {(m, p) for m, p, _ in groups if p is not None} == {(0, 0), (0, 1), (1, 0)}
    assert A.guided(prints.limit(0), known, ["meeting"], "id").count() == 0


def test_what_is_left_of_a_known_voice_joins_it(spark):
    unit = lambda x: [x, (1 - x * x) ** 0.5, 0.0]
    rows = [(0, i, unit(0.95), 1000) for i in range(5)] + [(0, 10 + i, unit(0.7), 1000) for i in range(5)] + [(0, 20 + i, [0.0, 0.0, 1.0], 1000) for i in range(5)]
    known = R.centroids(spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "person int, embedding array<double>"), ["person"])
    found = A.guided(spark.createDataFrame(rows, "meeting int, id int, embedding array<double>, weight int"), known, ["meeting"], "id").collect()
    assert {r.id // 10: r.person for r in found} == {0: 9, 1: 9, 2: None}


def test_lines_are_cut_where_the_voice_changes():
    text = "Prendo l'aereo e vengo in Italia. Ah ok va bene allora ci vediamo."
    sure, turns = {0: 0.9, 1: 0.9}, [(0, 0, 4000), (1, 4000, 8000)]
    assert A.split_line((0, 8000), text, 0.8, turns, sure) == [(0, 4000, 0, "Prendo l'aereo e vengo in Italia."), (4000, 8000, 1, "Ah ok va bene allora ci vediamo.")]
    whole = [
        ((0, 8000), "one voice talking here", 0.9, [(0, 0, 10_000)], sure),
        ((0, 2900), text, 0.9, [(0, 0, 1450), (1, 1450, 2900)], sure),  # too short
        ((0, 8000), text, 0.2, turns, sure),  # unsure words
        ((0, 8000), text, 0.9, turns, {0: 0.9, 1: 0.4}),  # unsure voice
        ((0, 8000), text, 0.9, [(0, 0, 2000), (1, 4000, 7500)], sure),  # too little of it is anybody's
        ((0, 8000), text, 0.9, [(0, 0, 6500), (1, 6500, 8000)], sure),  # under a quarter
        ((0, 8000), "a" * 60, 0.9, turns, sure),  # no place to cut
        ((0, 8000), "", 0.9, turns, sure), ((0, 8000), None, None, turns, sure), ((0, 8000), text, 0.9, [], sure),
    ]
    assert [A.split_line(*w) for w in whole] == [[]] * len(whole)
    # an interjection too short to stand alone stays with the voice around it
    assert A.split_line((223_072, 229_632), "No, io domani sera prendo l'aereo e vengo. Ah, ok. E domani la stacco prima", 0.8, [(0, 223_072, 226_500), (0, 227_800, 229_632), (1, 226_500, 227_800)], sure) == []
    # a contested part is the one's who holds the part before
    assert A.stretches((0, 100), [(1, 0, 60), (0, 40, 100), (2, 200, 300)]) == [[0, 40, 1], [40, 60, 1], [60, 100, 0]]
    assert A.stretches((0, 100), [(1, 20, 60), (0, 20, 100)]) == [[20, 60, 0], [60, 100, 0]]


def test_pieces_tile_their_line():
    rng = random.Random(8)
    cut = 0
    for _ in range(400):
        line = (1000, 1000 + rng.randint(3000, 20_000))
        turns, at = [], line[0] - 500
        while at < line[1] + 500:
            n = rng.randint(200, 6000)
            turns.append((rng.randrange(3), at, at + n + rng.randint(-100, 400)))
            at += n
        text = " ".join(rng.choice(["uno", "due.", "tre,", "quattro"]) for _ in range(rng.randint(4, 60)))
        found = A.split_line(line, text, 0.9, turns, {0: 0.9, 1: 0.8, 2: 0.7})
        if found:
            cut += 1
            assert found[0][0] == line[0] and found[-1][1] == line[1] and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(found, found[1:]))
            assert " ".join(p[3] for p in found) == text and all(len(p[3].split()) >= 2 for p in found)
    assert cut > 50


def test_lines_go_to_voices(spark):
    text = "Prendo l'aereo e vengo in Italia. Ah ok va bene allora ci vediamo."
    lines = [
        (1, 0, 0, 8000, "system", text, 0.9), (1, 1, 9000, 9900, "system", "ja", 0.9), (1, 2, 12_300, 12_900, "system", "near", None), (1, 3, 20_000, 21_000, "system", "nobody", 0.9),
        (1, 4, 0, 500, "mic", "mine", 0.9), (2, 0, 0, 500, "system", None, 0.9),
    ]
    turns = [(1, 3, 0, 4000, 0.9), (1, 7, 4000, 8000, 0.9), (1, 5, 9000, 9300, 0.9), (1, 7, 9300, 12_000, 0.9), (1, 8, 30_000, 31_000, 0.9), (1, 8, 31_000, 31_000, 0.9)]
    found = A.attributed(spark.createDataFrame(lines, "m int, id int, s long, e long, channel string, text string, confidence double"), spark.createDataFrame(turns, "m int, track int, s long, e long, confidence double"), ["m"], "id")
    got = sorted((r.m, r.id, r.piece, r.s, r.e, r.track, r.speaker) for r in found.fillna(-1, "track").fillna("", "speaker").collect())
    assert got == [
        (1, 0, 0, 0, 4000, 3, "1"), (1, 0, 1, 4000, 8000, 7, "2"), (1, 1, 0, 9000, 9900, 7, "2"), (1, 2, 0, 12_300, 12_900, 7, "2"), (1, 3, 0, 20_000, 21_000, -1, ""), (1, 4, 0, 0, 500, -1, "self"), (2, 0, 0, 0, 500, -1, ""),
    ]
