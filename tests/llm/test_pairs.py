"""op1, op4 and op9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import cases, prose
from pyspark.sql import functions as F

from skein.llm import decontaminate, near_dup, substring_dup
from skein.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, size, percent=80):
    """(key, n, component, kept) by comparing all pairs."""
    sets, root = [shingle_set(t, size) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    named = [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]
    return sorted(((k, len(s), c, k is not None and k == c) for (k, _), s, c in zip(rows, sets, named)), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    found = sorted(map(tuple, near_dup.near_duplicates(docs, size=size).collect()), key=str)
    assert found == brute([r[:2] for r in cases()], size)


def test_near_duplicates_of_many_near_copies(spark, monkeypatch):
    """A group whose pairs lie around the threshold, with a leader for every list."""
    words = prose(9, 60).split()
    rows = [(i, " ".join(w if (i * 7 + k * k * (i % 5 + 1)) % 29 > 3 else f"w{i}x{k}" for k, w in enumerate(words))) for i in range(60)]
    monkeypatch.setattr(near_dup, "LONG", 1)
    monkeypatch.setattr(near_dup, "SEATS", 7)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 2)


def skewed():
    """Hundreds of near copies of two texts that have a passage in common, around the threshold, cut ones among them, and others with the passage."""
    rng, line, rows = random.Random(17), prose(30, 40), []
    for base in (f"{prose(31, 60)} {line}", f"{line} {prose(32, 50)}"):
        words = base.split()
        for i in range(160):
            rate = rng.choice((0.01, 0.03, 0.06, 0.1))
            text = [rng.choice(("ka", "lo", "mi", f"w{i}")) if rng.random() < rate else w for w in words]
            rows.append(" ".join(text[: rng.randint(60, len(text))] if i % 4 == 0 else text))
    rows += [f"{prose(100 + i, rng.randint(5, 60))} {line} {prose(300 + i, rng.randint(5, 60))}" for i in range(80)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_a_skewed_corpus(spark, size):
    """Recall is 1: the rows are those of brute force."""
    rows = skewed()
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, size)


def test_one_link_spares_the_pairs_of_a_class_with_a_component(spark, monkeypatch):
    """Classes near every member of a component, and some near none of it: what is compared grows with the classes, not with their pairs."""
    sets = [(i, np.array([*range(100), 1000 + i], np.uint64).tobytes()) for i in range(70)]
    sets += [(i, np.array([*range(60), *range(1000 * i, 1000 * i + 41)], np.uint64).tobytes()) for i in range(70, 73)]
    sets = spark.createDataFrame(sets, "id long, whole binary")
    pairs = [(a, b, 0, b, 0.9 if b < 70 else 0.8) for a in range(40) for b in range(40, 73)]
    pairs = spark.createDataFrame(pairs, "a long, b long, la long, lb long, hope double")
    labels = spark.createDataFrame([(i, 0 if i < 40 else i) for i in range(73)], "id long, label long")
    compared, verified = [], near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda p, *rest: compared.extend((r.a, r.b) for r in p.collect()) or verified(p, *rest))
    left, labels, links = near_dup._narrowed(pairs, labels, sets, 80)
    assert dict(map(tuple, labels.collect())) == {i: 0 if i < 70 else i for i in range(73)}
    assert len(compared) <= 2 * 73 and links.count() >= 30
    # all pairs that are neither compared nor linked are left
    assert {(r.a, r.b) for r in left.collect()} == {(a, b) for a in range(40) for b in (70, 71, 72)} - set(compared)


def test_near_duplicates_of_nothing(nothing):
    assert near_dup.near_duplicates(nothing).count() == 0


def test_shared_at_least_is_a_bound():
    assert near_dup.shared_at_least(32, 80) == 13
    assert near_dup.shared_at_least(4, 100) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (201, 200), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_repeated_passages(spark):
    passage = prose(11, 70)
    rows = [(3, f"Here {passage} There"), (1, f"Once upon {passage} a time"), (2, prose(12, 90)), (4, None), (None, ""), (5, "short. short. short.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dup.removals(docs, kind="sentence").collect()
    assert [(r.doc_id, r.kept_key) for r in got] == [(3, 1)]
    cut = dict(rows)[3][got[0].start : got[0].end]
    assert cut in passage and got[0].n_words == len(cut.split()) >= 50
    kept = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in substring_dup.cleaned(docs).collect()}
    assert kept[3] == ("Here . There", [(5, len(rows[0][1]) - 7)])  # words alone go, not the mark after them
    assert kept[1] == (dict(rows)[1], []) and kept[4] == (None, [])


def plain_units(text, mark):
    """(start, end, words) of the parts of a text between marks, by hand."""
    out, at = [], 0
    for part in re.split(f"({mark})", text or ""):
        words = re.findall(r"[^\s.!?]+", part)
        if words:
            start = at + len(part) - len(part.lstrip())
            out.append((start, start + len(part.strip()), [w.lower() for w in words]))
        at += len(part)
    return out


def plain_removals(rows, least, mark="\n"):
    """Runs of repeated lines, without the operator's own code."""
    first, spans = {}, []
    split = [(key, plain_units(text, mark)) for key, text in rows]
    for key, i, (start, _, words) in sorted(((k, i, u) for i, (k, us) in enumerate(split) for u in us), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][0])):
        first.setdefault(tuple(words), (i, start))
    for i, (key, us) in enumerate(split):
        run = []
        for u in [*us, None]:
            if u and first[tuple(u[2])] != (i, u[0]):
                run.append(u)
            else:
                if run and sum(len(x[2]) for x in run) >= least:
                    spans.append((key, run[0][0], run[-1][1], sum(len(x[2]) for x in run)))
                run = []
    return sorted(map(str, spans))


@pytest.mark.parametrize("least", [0, 20])
def test_repeated_lines_against_brute_force(docs, spark, least):
    # which of two equal rows keeps its text is left open
    found = substring_dup.removals(docs, least=least).select("doc_id", "start", "end", "n_words").collect()
    assert sorted(map(str, map(tuple, found))) == plain_removals([r[:2] for r in cases()], least)
    lines = [prose(400 + i, 12) for i in range(8)]
    rows = [(i, "\n".join([lines[(i * 3 + j * j) % 8].upper() if j % 2 else f"  {lines[(i + j) % 8]} " for j in range(5)] + [f"own {i}", ""])) for i in range(12)]
    found = substring_dup.removals(spark.createDataFrame(rows, "doc_id long, text string"), least=least).select("doc_id", "start", "end", "n_words").collect()
    assert sorted(map(str, map(tuple, found))) == plain_removals(rows, least) != []


def test_rows_of_one_key_are_cut_by_themselves(spark):
    passage = prose(14, 60)
    rows = [(1, passage, 7), (2, f"a\n{passage}", 8), (2, f"longer b\n{passage}\nc", 9)]
    found = substring_dup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, _row int")).collect()
    assert sorted((r.doc_id, r.text, r._row) for r in found) == [(1, passage, 7), (2, "a\n", 8), (2, "longer b\n\nc", 9)]


def test_repeated_passages_of_nothing(nothing):
    assert substring_dup.removals(nothing).count() == 0


def test_letters_that_grow_in_lower_case(spark):
    """They leave other sentences, and offsets, as they are."""
    passage = " ".join(w.capitalize() for w in prose(13, 70).split())
    rows = [(1, f"Start. {passage} End."), (2, f"\u0130zmir \u0130. {passage} Fin.")]
    found = substring_dup.removals(spark.createDataFrame(rows, "doc_id long, text string"), kind="sentence").collect()
    assert [(r.doc_id, rows[1][1][r.start : r.end].strip(), r.n_words) for r in found] == [(2, passage, 70)]
    assert [u[3] for u in substring_dup.units("X \u0130 Y")] == [u[3] for u in substring_dup.units("x i\u0307 y")]


def word_spans(text):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\s.!?]+", text or "")]


def test_passages_without_whole_units(spark):
    """Pasted within sentences, of sentences that come to few words, or one long sentence: all words of each passage go, and no others."""
    long, short = prose(21, 52).replace(".", ","), " ".join(prose(22, 60).replace(".", "").split()[:45])
    cut = short.replace(" ", ". ", 1)[::-1].replace(" ", " .", 1)[::-1]
    rows = [(1, f"Alpha beta {long} gamma delta. Then."), (2, f"{prose(23, 30)} epsilon {long.upper()} zeta"), (3, f"eta {cut} theta"), (4, f"iota\n{cut} kappa"), (5, prose(24, 80)), (6, None), (None, "")]
    found = substring_dup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: (dict(rows)[r.doc_id][r.start : r.end].lower().strip(".,"), r.n_words, r.kept_key) for r in found}
    assert got == {2: (long.strip(".,"), 52, 1), 4: (cut.lower(), 45, 3)} and len(found) == 2


def test_passages_against_brute_force(docs, spark):
    """Every word of a stretch of 40 words that lies whole in the document that first holds its parts goes; every word that goes lies in a repeated unit or stretch of 20."""
    rng, pool = random.Random(5), [prose(s, 60) for s in range(30, 36)]
    rows = []
    for i in range(60):
        words = rng.choice(pool).split()
        a = rng.randrange(20)
        rows.append((i, f"{prose(100 + i, 25)} {' '.join(words[a : a + rng.randrange(20, 60)])} {prose(200 + i, 25)}"))
    found = substring_dup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {(r.doc_id, k) for r in found for k, (s, e, _) in enumerate(word_spans(dict(rows)[r.doc_id])) if r.start <= s and e <= r.end}
    first, must, may = {}, set(), set()
    for i, text in rows:
        words = [w for *_, w in word_spans(text)]
        mine = [first.setdefault(tuple(words[k : k + 20]), (i, k)) for k in range(len(words) - 19)]
        may |= {(i, k + j) for k, (row, at) in enumerate(mine) if (row, at) != (i, k) for j in range(20)}
        for k in range(len(words) - 39):
            row, at = mine[k]
            if row != i and mine[k : k + 21] == [(row, at + j) for j in range(21)]:
                must |= {(i, k + j) for j in range(40)}
    units = {(r.doc_id, k) for r in substring_dup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect() for k, (s, e, _) in enumerate(word_spans(dict(rows)[r.doc_id])) if r.start <= s and e <= r.end}
    assert must and must <= gone and gone <= may | units
    assert sum(r.n_words for r in found) == len(gone)
    assert substring_dup.repeats(docs).count() > 0


def test_passages_of_nothing(nothing):
    assert substring_dup.repeats(nothing).count() == 0


ITEMS = [(1, prose(1, 200)[:400]), (2, "one two"), (2, "one two"), (3, None), (4, "..."), (None, "one"), (5, prose(8, 30)), (6, "Sorum")]


def brute_hits(text, items, span=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        w = split(item)
        for k in range(max(1, len(w) - span + 1)) if w and name is not None else ():
            window = w[k : k + span]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("room", [decontaminate.BLOCK_BYTES, 700])
def test_decontamination(spark, docs, room):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.hits(docs, benchmark, room=room)
    assert {"kept", "SCORE"} <= set(found.columns)
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]))) for r in found.collect())
    assert got == sorted(str((k, *brute_hits(t, ITEMS))) for k, t, *_ in cases())


@pytest.mark.parametrize("room", [decontaminate.BLOCK_BYTES, 30])
def test_benchmark_rows_without_id_hit(spark, tmp_path, room):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five two three")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "one two"), (None, None), (9, "two three")], "item_id long, text string")
    found = decontaminate.hits(docs, benchmark, room=room, unnamed=True).collect()
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in found) == [(1, 3, ["9"]), (2, 0, []), (3, 2, ["9"])]
    benchmark.where("item_id is null").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in decontaminate.op9_decontaminate(spark, str(tmp_path)).collect()}
    assert rows[1] == (3, 2, 0, hashlib.sha256(b"").hexdigest(), True) and not rows[3][-1]
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == [2, 3]


def test_decontamination_without_benchmark_or_documents(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(docs, empty).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.hits(nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_item_digest_of_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "one two"), (9, "two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = decontaminate.op9_decontaminate(spark, str(tmp_path)).first()
    assert tuple(row) == (1, 3, 3, 2, hashlib.sha256(b"10,9").hexdigest(), True)


def test_excerpts_of_one_text(spark):
    """Fragments of one long text: lists of all members, many components, against brute force, with few pairs made."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    rows = []
    for i in range(260):
        n = rng.randint(60, 500)
        a = rng.randrange(len(base) - n)
        rows.append((i, " ".join(base[a : a + n])))
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=2)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: find(i) for i in range(len(rows))}
    assert 1 < len({find(i) for i in range(len(rows))}) < len(rows)


def test_floor_of_units_and_stretches_are_apart(spark):
    """With no floor for units repeated lines go, however short, and single words stay."""
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"v{rng.randrange(300)}" for _ in range(12)) for _ in range(20)) for _ in range(4)]
    texts += ["one two\nthree\nalone here", "three\nfour\none two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring_dup.repeats(docs, least=0).collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in found) == [(5, "one two"), (5, "three")]
    cut = {r.doc_id: r.text for r in substring_dup.cleaned(docs, least=0).collect()}
    assert [cut[i] for i in range(5)] == texts[:5] and cut[5].split() == ["four"]


def test_sets_of_classes_take_one_python_step_a_stage(spark, monkeypatch):
    texts = [prose(i, 60) for i in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1] + " more"), (None, texts[2]), (None, texts[2] + " more"), (None, texts[0]), (5, texts[2] + " or less"), (5, texts[2] + " or less"), (6, None)]
    steps, settle = [], near_dup.settle

    def seen(df):
        steps.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return settle(df)

    monkeypatch.setattr(near_dup, "settle", seen)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted([("1", "1")] * 3 + [("None", "5")] * 2 + [("None", "1")] + [("5", "5")] * 2 + [("6", "6")])
    assert max(steps) == 1  # two would keep two workers a core


def test_components_of_stars_take_no_round(spark, monkeypatch):
    steps, settle = [], components.__globals__["settle"]
    monkeypatch.setitem(components.__globals__, "settle", lambda df: steps.append(1) or settle(df))
    edges = spark.createDataFrame([(0, 3), (4, 0), (9, 7), (7, 8), (2, 2), (0, 3)], "a long, b long")
    assert dict(map(tuple, components(edges).collect())) == {0: 0, 3: 0, 4: 0, 7: 7, 8: 7, 9: 7}
    assert len(steps) == 1  # rounds settle two tables each


def test_sets_are_made_once_and_go_once_to_leaders(spark, monkeypatch):
    """Two groups of near copies and single pairs: long lists and short ones."""
    rows = [(g * 40 + i, " ".join(f"w{i}" if k == i % 60 else w for k, w in enumerate(prose(50 + g, 60).split()))) for g in range(2) for i in range(40)]
    rows += [(100 + 2 * i + j, prose(70 + i, 40) + " more" * j) for i in range(4) for j in range(2)]
    calls = []
    for name in ("_sets", "_led"):
        monkeypatch.setattr(near_dup, name, lambda *a, f=getattr(near_dup, name), n=name, **b: calls.append(n) or f(*a, **b))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 2)
    assert calls == ["_sets", "_led"]


def test_what_is_left_of_sets_meets_once_and_a_row_stays_a_row(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}" if k in (i % 60, i // 2) else w for k, w in enumerate(prose(60, 60).split()))) for i in range(60)]
    plans, settle = [], near_dup.settle

    def seen(df):
        plans.append((df._jdf.queryExecution().optimizedPlan().toString(), out := settle(df)))
        return out

    monkeypatch.setattr(near_dup, "settle", seen)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 2)
    assert sum("explode(rest" in plan for plan, _ in plans) == 1
    led = [out for _, out in plans if "rest" in out.columns]
    entries = [out for _, out in plans if "follow" in out.columns]
    assert len(led) == 1 and all(e.count() <= led[0].select(F.sum(F.size("rest") + 1)).first()[0] for e in entries)
