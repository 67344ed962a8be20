"""Odd inputs on which queries once parted from their SQL."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.operators import intervals, people, vocabulary
from skein.plans import registry

from test_oracles import rows


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over given tables is its SQL over them; its rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, frame in tables.items():
            frame.to_parquet(tmp_path / f"{table}.parquet", coerce_timestamps="us")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path / table}.parquet')")
        got = rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas())
        assert got == rows(con.execute(registry.ORACLE_SQL[name]).df())
        return got[1]

    return run


def events(*given):
    """Events of (user, type, start in minutes, value: minutes)."""
    table = pd.DataFrame([(i, pd.Timestamp("2024-01-04") + pd.Timedelta(minutes=at), u, kind, float(value)) for i, (u, kind, at, value) in enumerate(given)], columns=["event_id", "ts", "user_id", "event_type", "value"])
    return table.astype({"ts": "datetime64[us]"})


def test_spans_are_cut_alike_in_whatever_order_they_are_read(spark):
    spans = spark.createDataFrame([(k, 100 * i, 100 * i + 90) for k in range(4) for i in range(60)] + [(None, 0, 50), (1, 0, 90)], "key int, s long, e long")
    holes = spark.createDataFrame([(k, 100 * i + 10 * k, 100 * i + 50) for k in range(4) for i in range(0, 60, 2)], "key int, s long, e long")

    def mixed(frames):
        for frame in frames:
            yield frame.sample(frac=1)  # another order at each reading

    def left(rows):
        return sorted(map(str, intervals.subtract(rows, holes, ["key"]).collect()))

    assert left(spans.coalesce(1).mapInPandas(mixed, spans.schema)) == left(spans)
    assert len(left(spans)) == 4 * 30 + 30 * 7 + 3  # whole ones, pieces (one of key 0, two of others), the null key's and a second equal one's


def test_a_setting_that_nobody_stored_has_its_default(same):
    owners = [7, 8, 9, 10]
    keys = [o + 400 * k for o in owners for k in range(12) if (o, k) not in ((9, 0), (10, 0), (10, 1))]
    found = same("b14_settings", part=pd.DataFrame({"p_partkey": keys, "p_size": [1 if k % 2 else 5 for k in keys]}))
    assert len(found) == 4


def test_a_union_keeps_spans_of_no_width(same):
    found = same("f1_union", events=events((1, "view", 0, 0), (1, "error", 60, 3), (1, "view", 62, 0), (1, "view", 100, 0), (1, "view", 100, 0), (1, "click", 200, 0), (2, "error", 5, 0), (2, "view", 5, 1), (2, "view", 7, 0)))
    assert len(found) == 4


#: Points inside, at the bounds of and far from spans and points, on both sides of each pair, over bucket bounds.
POINTS = [(u, kind, at, value) for u, kind, other in ((1, "view", "click"), (2, "click", "view"), (3, "purchase", "error"), (4, "error", "signup"), (5, "view", "purchase")) for kind, at, value in (
    (kind, 350, 20), (other, 355, 0), (kind, 500, 0), (other, 490, 30), (kind, 600, 10), (other, 600, 0), (other, 610, 0), (kind, 700, 0), (other, 700, 0), (kind, 900, 5), (other, 3000, 0), (kind, 3055, 0), (kind, 3061, 0), ("signup", 495, 9),
)]


@pytest.mark.parametrize("name,least", [("i5_most_overlap", 4), ("i6_nearest", 4), ("i7_untouched", 1), ("i8_covered", 2), ("i16_alone", 3), ("i12_holes", 1), ("d15_unread", 1), ("f1_union", 4), ("i3_subtract", 1), ("i10_elementary", 9)])
def test_points_count_as_in_the_sql(same, name, least):
    assert len(same(name, events=events(*POINTS))) >= least


@pytest.mark.parametrize("name,least", [("n9_tails", 2), ("n10_claims", 4), ("n11_repaired", 300), ("n12_reverted", 4)])
def test_letters_of_two_bytes_are_two_edits(same, name, least):
    lines = ["Wir heißen Grünstraßen, sagt er."] * 40 + ["nur Worte ohne Belang, " * 60] * 256
    odd = ["so grunstrasen hier", "so grunstraen hier", "so grunstrayen hier", "so grunstraßne hier", "so grunstraß en hier", "so grunst raen hier", "sagt Ergrunstraßen dort", "sagt Ergrunstraen dort", "sagt Ergrunstraen dort", "so grunstrañen hier", "so grunstraðen hier"]
    text = lines + odd
    assert len(same(name, conversations=pd.DataFrame({"conv_id": range(len(text)), "turn": 0, "text": text}))) >= least


def plain_runs(parts, least):
    """Each short run, shortest and earliest first, into its longer neighbour, by looking at all of them each time."""
    runs = [list(p) for p in parts]
    while True:
        for i in range(len(runs) - 1, 0, -1):
            if runs[i][2] == runs[i - 1][2]:
                runs[i - 1][1] = runs[i][1]
                del runs[i]
        short = [(e - s, i) for i, (s, e, _) in enumerate(runs) if e - s < least]
        if not short or len(runs) == 1:
            break
        i = min(short)[1]
        j = max((j for j in (i - 1, i + 1) if 0 <= j < len(runs)), key=lambda j: (runs[j][1] - runs[j][0], -j))
        runs[min(i, j)] = [runs[min(i, j)][0], runs[max(i, j)][1], runs[j][2]]
        del runs[max(i, j)]
    for one, other in zip(runs, runs[1:]):
        one[1] = other[0]
    return [tuple(r) for r in runs]


def test_runs_collapse_as_one_by_one(spark):
    rng = random.Random(8)
    given = {}
    for key in range(150):
        at, parts = 0, []
        for _ in range(rng.randint(1, 30)):
            at += rng.choice([0, 0, 0, 2])
            size = rng.choice([1, 2, 3, 3, 9, 12, 30])
            parts.append((at, at + size, rng.choice("abc")))
            at += size
        given[key] = parts
    rows = spark.createDataFrame([(k if k else None, *p) for k, parts in given.items() for p in parts], "key int, s long, e long, owner string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go over the bounds of batches
    try:
        found = intervals.collapse_runs(rows, ["key"], least=10).orderBy("key", "s").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r)[1:] for r in found] == [r for parts in given.values() for r in plain_runs(parts, 10)]


def test_a_long_line_of_short_runs_is_not_quadratic():
    runs = [[i, i + 1, "ab"[i % 2]] for i in range(20_000)]
    began = time.process_time()
    assert intervals._collapsed(runs, 1500) and time.process_time() - began < 5


def test_prints_without_order_come_first_in_any_block(spark):
    axes = [[float(i == k) for i in range(8)] for k in range(8)]
    rows = [(None if i < 25 else i // 3, i, i // 4 if i % 5 else i % 7, axes[i % 8]) for i in range(80)]
    prints = spark.createDataFrame(rows, "o int, id int, meeting int, embedding array<double>").repartition(3)
    found = [{r.id: r.group for r in people.voice_groups(prints, "id", "o", "meeting", block=n).collect()} for n in (9, 1000)]
    assert found[0] == found[1] and len(found[0]) == 80
    assert all(found[0][i] == i for i in range(8))


def test_a_block_of_unlike_prints_is_walked_once():
    prints = [(i // 10, v) for i, v in enumerate(np.random.default_rng(1).standard_normal((6_000, 64)))]
    began = time.process_time()
    labels, moved = people.walk(prints, people._Block([v for _, v in prints], 0.64).alike(), [[] for _ in prints], {}, 0, 0.64)
    assert len(moved) == max(labels) + 1 > 5_000 and time.process_time() - began < 30


def test_a_long_line_is_repaired_in_one_pass(spark):
    words = [f"parola{i % 7}" for i in range(10_000)]
    words[77], words[5_000] = "obsidera", "obsidara"
    lines = spark.createDataFrame([(1, " ".join(words) + "."), (2, "niente")], "id int, text string")
    terms, nothing = spark.createDataFrame([("Obsidara", 0)], "term string, place int"), spark.createDataFrame([], "word string")
    began = time.time()
    found = vocabulary.repaired(lines, terms, nothing).orderBy("id").collect()
    assert time.time() - began < 30
    words[77] = words[5_000] = "Obsidara"
    assert [r.repaired for r in found] == [" ".join(words) + ".", "niente"] and [len(r.changes) for r in found] == [2, 0]
