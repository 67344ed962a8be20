"""Order-dependent operators, text, sources and sinks on small cases worked out by hand."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import intervals, read_models, search, signal, vectors
from skein.plans import recap
from skein.sinks import documents
from skein.sources import replies, wav
from skein.streaming.fold import fold, fold_stream
from skein.streaming.machines import AdaptiveLag, Detection, LanguageVote, LoudnessGate, MeetingDetector, OpenSpeech, VoiceSessions


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_runs_absorb_short_parts(spark):
    parts = spark.createDataFrame([(1, 0, 5000, "a"), (1, 5000, 6000, "b"), (1, 6000, 9000, "a"), (1, 9500, 12000, "b")], "key int, s long, e long, owner string")
    found = intervals.collapse_runs(parts, ["key"]).orderBy("s").collect()
    assert [(r.s, r.e, r.owner) for r in found] == [(0, 9500, "a"), (9500, 12000, "b")]


def test_packs_stay_open_up_to_their_length(spark):
    rows = spark.createDataFrame([(1, 0, 10_000), (1, 12_000, 28_000), (1, 29_000, 30_000), (2, 0, 90_000)], "key int, s long, e long")
    found = intervals.packs(rows, ["key"]).orderBy("key", "s").collect()
    assert [r.pack for r in found] == [0, 0, 1, 0]


def test_overlapping_spans_meet_once_over_bucket_bounds(spark):
    a = spark.createDataFrame([(1, 0, 100, "x"), (1, 95, 95, "zero")], "key int, s long, e long, track string")
    b = spark.createDataFrame([(1, 50, 250, "y"), (1, 100, 120, "touching"), (None, 0, 9, "null")], "key int, s long, e long, track string")
    for width in (7, 30, 1000):
        assert [(r.track, r.track_b) for r in intervals.overlapping(a, b, ["key"], width=width).collect()] == [("x", "y")]
    assert {r.track_b for r in intervals.overlapping(a, b, ["key"], reach=0, width=9).collect()} == {"y"}
    assert {r.track_b for r in intervals.overlapping(a, b, ["key"], reach=5, width=9).collect()} == {"y", "touching"}


VOICE = VoiceSessions(window=32, needs=3, pre=64, pad=64, tail=96, least=200, most=1024, jump=500, search=320, pause=64, overlap=64)


def windows(*runs):
    out, t = [], 0
    for p, n in runs:
        out += [(1, t + 32 * i, p) for i in range(n)]
        t += 32 * n
    return out


def sessions(spark, rows, machine=VOICE, schema="key int, t long, p double"):
    return [tuple(r)[1:] for r in fold(spark.createDataFrame(rows, schema), ["key"], ["t"], machine).collect()]


def test_voice_sessions_open_pad_and_close(spark):
    # ten voiced windows from 160 on, with two before and two after; two windows are no speech
    assert sessions(spark, windows((0.1, 5), (0.5, 10), (0.1, 8), (0.5, 2), (0.1, 9))) == [(96, 544, 320, False)]
    # above the lower threshold goes on, and what the close left over is the next look-behind
    assert sessions(spark, windows((0.5, 3), (0.25, 5), (0.1, 3), (0.5, 7), (0.1, 5))) == [(0, 320, 256, False), (320, 640, 224, False)]
    # a short one is held open until it is long enough; there is nothing to hold out for at the end
    assert sessions(spark, windows((0.5, 3), (0.1, 20))) == [(0, 224, 96, False)]
    assert sessions(spark, windows((0.5, 3))) == [(0, 96, 96, False)]
    # a jump closes and forgets
    assert sessions(spark, [*windows((0.5, 9)), (1, 5000, 0.5), (1, 5032, 0.5)]) == [(0, 288, 288, False)]


def test_a_session_that_grows_too_long_goes_on_in_another(spark):
    # no pause: cut at its length, the rest starts two windows earlier
    assert sessions(spark, windows((0.9, 40))) == [(0, 1024, 1024, True), (960, 1280, 320, False)]
    # in the middle of the longest pause near the end, and nothing is split
    assert sessions(spark, windows((0.9, 24), (0.1, 2), (0.9, 14))) == [(0, 800, 768, False), (800, 1280, 448, False)]
    # a pause before the last 320 ms doesn't count
    assert sessions(spark, windows((0.9, 10), (0.1, 2), (0.9, 26)))[0] == (0, 1024, 960, True)
    # of equal pauses the later one
    assert sessions(spark, windows((0.9, 23), (0.1, 2), (0.9, 3), (0.1, 2), (0.9, 10)))[0] == (0, 928, 832, False)
    # the quietest stretch if it is quiet enough, flagged
    loud = lambda quiet: [(1, 32 * i, 0.9, quiet if 26 <= i < 28 else 1.0) for i in range(40)]
    schema = "key int, t long, p double, level double"
    assert sessions(spark, loud(0.01), schema=schema) == [(0, 864, 864, True), (800, 1280, 480, False)]
    assert sessions(spark, loud(0.5), schema=schema)[0] == (0, 1024, 1024, True)


def test_pieces_of_a_monologue_cover_it(spark):
    import random

    for seed in range(6):
        rng = random.Random(seed)
        runs = [(0.1, 9)] + [(rng.choice([0.9, 0.9, 0.1]), rng.randint(1, 30)) for _ in range(30)]
        rows = windows(*runs)
        found = sessions(spark, rows)
        opened = {t for t in range(0, 32 * len(rows), 32) if any(a <= t < b for a, b, *_ in found)}
        run = 0
        for i, (_, t, p) in enumerate(rows):  # three voiced windows in a row are always in a session
            run = run + 1 if p > 0.5 else 0
            assert run < 3 or {t - 64, t - 32, t} <= opened
        for (a, b, _, split), (c, d, *_) in zip(found, found[1:]):
            assert b - a <= 1024 and (c >= b or split and c >= b - 64)


def test_looks_leave_the_session_open(spark):
    rows = windows((0.1, 3), (0.9, 40), (0.1, 9))
    looks = sessions(spark, rows, OpenSpeech(VOICE, every=128, longest=256))
    assert looks[0] == (32, 32, 192, 96) and looks[1] == (32, 64, 320, 224)
    starts = [a for a, *_ in looks]
    assert sorted(set(starts)) == [32, *[a for a, *_ in sessions(spark, rows)[1:]]] and all(d - c <= 256 for _, c, d, _ in looks)


def test_a_floor_follows_the_quiet_and_not_the_loud(spark):
    rows = [(1, 32 * i, 0.002 if i < 100 else 0.3 if i < 130 else 0.004) for i in range(400)]
    found = sessions(spark, rows, LoudnessGate(), "key int, t long, level double")
    floor, active = 0.0015, False
    for (_, t, level), got in zip(rows, found):
        active = level > (max(floor * 2.5, 0.005) if active else max(floor * 4, 0.01))
        floor = floor if active else min(max(floor * 0.95 + level * 0.05, 1e-5), 0.05)
        assert got == (t, level, pytest.approx(floor), active)
    assert sessions(spark, rows, Detection(sessions=VOICE), "key int, t long, level double") == [(3136, 4160, 960, True), (4096, 4320, 64, False)]


STREAMS = {
    "looks": (OpenSpeech(VOICE, every=96, longest=128), "key int, t long, p double", [(k, t, p) for k in (1, 2) for _, t, p in windows((0.1, 3), (0.6, 14), (0.1, 9), (0.7, 50), (0.2, 9))]),
    "gate": (LoudnessGate(), "key int, t long, level double", [(k, t, p / 50) for k in (1, 2) for _, t, p in windows((0.1, 3), (0.6, 14), (0.1, 9), (0.7, 50), (0.2, 9))]),
    "detection": (Detection(sessions=VOICE), "key int, t long, level double", [(k, t, p / 9) for k in (1, 2) for _, t, p in windows((0.01, 30), (0.6, 14), (0.01, 9), (0.7, 50), (0.01, 9))]),
    "voice": (VOICE, "key int, t long, p double", [(k, t, p) for k in (1, 2) for _, t, p in windows((0.1, 3), (0.6, 14), (0.1, 9), (0.7, 50), (0.2, 9))]),
    "votes": (LanguageVote(), "key int, t long, language string, confidence double, speech_ms long", [(k, i, "it" if i % 5 == k else None if i % 7 == 6 else "en", 0.8, 2500) for k in (1, 2) for i in range(20)]),
    "meetings": (MeetingDetector(), "key int, t long, app boolean, browser boolean, mic boolean", [(1, i, i < 20, False, i % 9 < 7) for i in range(60)]),
    "lag": (AdaptiveLag(), "key int, t long, lag_ms long, reset boolean", [(1, i * 40_000, 100 + i * i, i == 6) for i in range(10)]),
}


@pytest.mark.parametrize("name", STREAMS)
def test_a_stream_gives_what_the_batch_gives(spark, tmp_path, name):
    machine, schema, rows = STREAMS[name]
    table = spark.createDataFrame(rows, schema)
    batch = fold(table, ["key"], ["t"], machine)
    for i, part in enumerate((table.where("t % 3 >= 0").where(f"t < {sorted(r[1] for r in rows)[len(rows) // 2]}"), table.where(f"t >= {sorted(r[1] for r in rows)[len(rows) // 2]}"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    made = []
    query = fold_stream(source, ["key"], "t", machine, 3_600_000).writeStream.foreachBatch(lambda df, _: made.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = [tuple(r) for r in batch.collect()]
    got = [tuple(r) for r in made]
    assert set(got) <= set(expected)
    # only what was still open at the end, the last of each key, is not out yet
    last = {k: max(r for r in expected if r[0] == k) for k in {r[0] for r in expected}}
    assert len(got) == len(set(got)) and set(expected) - set(got) <= set(last.values())


def test_detector_needs_app_and_microphone(spark):
    rows = [(1, i, i >= 3, False, i >= 5) for i in range(10)] + [(1, i, False, False, False) for i in range(10, 40)]
    found = fold(spark.createDataFrame(rows, "key int, t long, app boolean, browser boolean, mic boolean"), ["key"], ["t"], MeetingDetector()).collect()
    assert [(r.t, r.change) for r in found] == [(6, "start"), (33, "end")]


def test_aliases_stop_at_a_ring_and_at_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, alias_of long")
    found = {r.id: r.root for r in read_models.resolve_aliases(rows).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: None, 5: 5, 6: 6}


def test_text_functions(spark):
    assert one(spark, T.fold(F.lit("Sull'Àngolo!"))) == "sullangolo"
    assert one(spark, T.sounds(F.lit("nongula"))) == one(spark, T.sounds(F.lit("mankora"))).replace("r", "l")
    assert one(spark, T.words(F.lit("l'attenzione, è 3.14 -x-"))) == ["l'attenzione", "è", "3.14", "x"]
    assert one(spark, T.is_repetitive(F.lit("so so so what"))) and not one(spark, T.is_repetitive(F.lit("so so so")))
    assert one(spark, T.is_repetitive(F.lit("a b, A b a B c"))) and not one(spark, T.is_repetitive(F.lit("one two three four")))
    assert one(spark, T.strip_overlap(F.lit("the end of it all"), F.lit("this is The end, of"))) == "it all"
    assert one(spark, T.strip_overlap(F.lit("the end"), F.lit("it is the end"))) == "the end"
    assert one(spark, T.strip_noise(F.lit(" [MUSIC] la (silence)"))) == "la"
    assert one(spark, T.redact(F.lit("at /home/me/x Token: abc def"))) == "at ~/x Token: <redacted>"
    assert one(spark, T.file_stem(F.lit("  Año/nuevo? "), F.lit("2026-01-05").cast("date"))) == "2026-01-05 A-o-nuevo"
    assert one(spark, T.format_timestamp(F.lit(3_725_000))) == "1:02:05" and one(spark, T.format_timestamp(F.lit(-5))) == "0:00"
    assert T.alignment("abc", "acb") == 1 and T.alignment("", "ab") == 2 and T.alignment("kitten", "sitting") == 3
    text = "a\n" * 5 + "x" * 25 + "\nend"
    assert "".join(p for _, p in T.pieces(text, 10)) == text and max(len(p) for _, p in T.pieces(text, 10)) <= 10
    assert one(spark, F.size(T.chunked(F.lit(None).cast("string"), 10))) == 0


def test_search_needs_all_terms_and_folds_accents(spark):
    rows = spark.createDataFrame([(1, "Così è il caffè"), (2, "il tè"), (3, "日本語の会議です"), (4, None)], "id long, text string")
    ids = lambda q: {r.id for r in search.search(rows, q, ["id"]).collect()}
    assert ids("il CAFFE") == {1} and ids("il") == {1, 2} and ids("il nothing") == set() and ids("  ") == set()
    assert ids("日本語") == {3} and ids("日本") == set()
    html = rows.where("id = 2").select(search.highlighted(F.lit("a <b> tè & more"), ["tè"]).alias("h")).first().h
    assert html == "a &lt;b&gt; <mark>tè</mark> &amp; more"


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centre = np.eye(3, 16) * 4
    rows = [(1, i, [float(x) for x in centre[i % 3] + rng.normal(size=16) * 0.3], 2_000.0) for i in range(30)]
    table = spark.createDataFrame(rows, "meeting int, id long, embedding array<double>, weight double")
    found = {r.id: r.cluster for r in vectors.cluster(table, ["meeting"], "id").collect()}
    assert all(found[i] == found[i % 3] for i in range(30)) and len(set(found.values())) == 3
    near = vectors.nearest(table, table.where("id < 2"), "id", "embedding", 3).collect()
    assert {(r.query, r.id % 3) for r in near} == {(0, 0), (1, 1)} and len(near) == 6
    v = np.array([r[2] for r in rows])
    likeness = (v[0] @ v.T) / np.linalg.norm(v, axis=1) / np.linalg.norm(v[0])
    assert math.isclose(max(r.similarity for r in near if r.query == 0), sorted(likeness)[-2], rel_tol=1e-9)
    odd = spark.createDataFrame([(1, i, [1.0, 0.1 * (i % 3)] if i < 9 else [-1.0, 1.0]) for i in range(10)], "person int, id long, embedding array<double>")
    assert [r.id for r in vectors.outliers(odd, ["person"], "id").collect()] == [9]
    labelled = table.withColumn("label", F.col("id") % 3)
    assert vectors.silhouette(labelled, ["meeting"]).first().silhouette > 0.9


def voices(seed, groups, each, ms, noise=0.25):
    rng = np.random.default_rng(seed)
    centre = np.linalg.qr(rng.normal(size=(24, 24)))[0][:groups] * 4
    return vectors.Voices.of([centre[i % groups] + rng.normal(size=24) * noise for i in range(groups * each)], [ms] * groups * each)


@pytest.mark.parametrize("groups", [1, 2, 3, 5, 7])
def test_speaker_counts(groups):
    """The automatic count finds the speakers; a fixed one gives as many as asked for, or the most there are."""
    found = voices(groups, groups, 12, 4_000)
    truth = np.arange(len(found.ms)) % groups
    same = lambda a, b: len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))
    assert same(found.cut(), truth) and same(found.fixed(groups), truth)
    assert groups == 1 or same(found.automatic(), truth)
    assert found.fixed(1).max() == 0 and found.fixed(groups + 3).max() + 1 >= groups


def test_pools_move_and_give_the_same_speakers():
    found = voices(3, 4, 200, 1_000)
    assert found.pooled and found.leaves().max() + 1 < 800
    assert vectors._numbered(found.cut()).tolist() == (np.arange(800) % 4).tolist()


def test_fragments_are_absorbed_but_for_coherent_voices():
    base = voices(6, 2, 20, 30_000)
    stray = np.vstack([base.vectors, vectors._unit(np.ones((2, 24)))])
    few = vectors.Voices(stray, np.array([*base.ms, 400, 400]))
    assert few.cut().max() + 1 == 2  # under three seconds: a fragment
    some = vectors.Voices(stray, np.array([*base.ms, 2_500, 2_500]))
    labels = np.array([*(np.arange(40) % 2), 2, 2])
    assert some.absorbed(labels, 12_000).max() + 1 == 3  # five seconds of one voice that agrees with itself
    assert some.absorbed(labels, 3_000).max() + 1 == 3 and few.absorbed(labels, 3_000).max() + 1 == 2


def test_choice_between_counts():
    row = lambda count, silhouette, refused=None, off=0.0, gap=0.6: {"count": count, "silhouette": silhouette, "refused": refused, "off": off, "gap": gap}
    assert vectors.choose([row(1, 0), row(2, 0.5), row(3, 0.505, off=0.2)])["count"] == 2
    assert vectors.choose([row(2, 0.5), row(3, 0.505)])["count"] == 3
    assert vectors.choose([row(2, -0.2), row(3, 0.1, "one voice", gap=0.45)])["count"] == 3
    assert vectors.choose([row(2, -0.2), row(3, 0.1, "one voice", gap=0.3)])["count"] == 2
    assert vectors.choose([row(2, 0.3, "fused"), row(3, 0.2, "many")])["count"] == 2


def test_evictions_keep_the_different_the_recent_and_the_last_of_a_condition():
    v = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])
    age, kind = np.array([0, 5, 9, 1, 2]), np.array(["mic"] * 4 + ["system"])
    assert vectors.evicted(v, age, kind, keep=4) == [1]  # nearly the same as a newer one
    assert vectors.evicted(v, age, kind, keep=3) == [1, 2]  # then the oldest
    assert 4 not in vectors.evicted(v, age, kind, keep=1)  # the last one of its kind
    assert vectors.evicted(v[[0, 4]], age[:2], kind[[0, 4]], keep=1) == []


def test_nearest_breaks_ties_by_key_and_leaves_nulls_out(spark):
    rows = [(i, [1.0, 0.0]) for i in (9, 3, 7, 2, 8, 4)] + [(1, [1.0, 0.0]), (5, None), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    found = vectors.nearest(table, table.where("id = 1 or id = 5"), "id", "embedding", 3).collect()
    assert [(r.query, r.id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 2), (1, 3), (1, 4)]


def test_assignment_is_the_best_over_all_permutations():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for _ in range(20):
        shared = rng.integers(0, 9, (4, 4)) * rng.integers(0, 2, (4, 4))
        picks = vectors.assignment(shared)
        assert sum(shared[i, j] for i, j in enumerate(picks) if j is not None) == max(sum(shared[i, p] for i, p in enumerate(perm)) for perm in permutations(range(4)))
        assert all(j is None or shared[i, j] > 0 for i, j in enumerate(picks))
    wide = rng.integers(1, 99, (30, 40))
    assert sorted(set(vectors.assignment(wide))) == sorted(vectors.assignment(wide)) and vectors.assignment(np.zeros((2, 0))) == [None, None]


def test_signal(spark):
    assert one(spark, signal.envelope(F.array(*[F.lit(float(x)) for x in (3, 4, 0, 0, 6)]), 2, 2)) == pytest.approx([math.sqrt(12.5), 0.0])
    assert one(spark, signal.mix(F.array(F.lit(0.9), F.lit(-0.1)), F.array(F.lit(0.9)))) == pytest.approx([1.0, -0.1 / 1.8])
    wave_form = np.sin(np.arange(200) / 3) * np.hanning(200)
    assert signal.likeness(np.concatenate([np.zeros(7), wave_form]), wave_form, 7) == pytest.approx(1.0)
    assert signal.likeness(wave_form[:10], wave_form[:10], 0) == 0.0


def test_recordings(spark, tmp_path):
    for name, seconds in (("mic-0", 1.0), ("mic-1", 0.5), ("mic-3", 2.0), ("system-0", 0.25)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(np.sin(np.arange(int(16_000 * seconds)) / 9)))
    (tmp_path / "mic-2.wav").write_bytes(b"RIFF")
    chunks = wav.read_chunks(spark, str(tmp_path))
    found = {(r.channel, r.seq): (r.t_start_ms, r.t_end_ms) for r in wav.recovered(chunks).collect()}
    assert found == {("mic", 0): (0, 1000), ("mic", 1): (1000, 1500), ("system", 0): (0, 250)}
    journal = spark.createDataFrame([("mic", 0, 0, 990)], "channel string, seq long, t_start_ms long, t_end_ms long")
    lost = {(r.channel, r.seq): (r.t_start_ms, r.t_end_ms) for r in wav.missing_from_journal(wav.recovered(chunks), journal).collect()}
    assert lost == {("mic", 1): (990, 1490), ("system", 0): (0, 250)}
    assert wav.decode(wav.encode(np.array([0.5, -2.0])))[0] == pytest.approx([0.5, -1.0], abs=1e-3)


def test_replies(spark):
    body = '{"response":"a"}\nnoise\n{"response":"b"}\n{"done":true}\n{"response":"late"}\n'
    assert one(spark, replies.reply(replies.ndjson(F.lit(body)))).text == "ab"
    assert one(spark, replies.reply(replies.ndjson(F.lit('{"error":"full"}')))).error == "full"
    sse = ": keep\r\n\r\ndata: {\"x\":1}\r\ndata: 2\r\n\r\ndata: [DONE]\n\n"
    assert one(spark, replies.events(F.lit(sse))) == ['{"x":1}\n2']


def test_recap_and_export(spark):
    rows = [(1, 0, 0, "Hello there", 0.9, True), (1, 1, 61_000, "Maybe Bob", 0.2, True), (1, 2, 70_000, "draft", 0.9, False)]
    lines = spark.createDataFrame(rows, "meeting_id int, turn long, t_start_ms long, text string, confidence double, is_final boolean")
    texts = recap.transcripts(lines, F.lit("Ann"))
    assert texts.first().asDict() == {"meeting_id": 1, "text": "Ann: Hello there\nAnn: Maybe Bob", "confident": "Ann: Hello there\nAnn", "unsure": "Maybe Bob"}
    assert recap.recaps(texts, 8_000).first().content == "Ann: Hello there (31)"
    long = spark.createDataFrame([(1, "line\n" * 900)], "meeting_id int, text string")
    assert recap.recaps(long, 2_500).first().chunks == 5
    reply = spark.createDataFrame([(1, 'Sure: {"items":[{"description":"call","owner":"Bob","due":null},{"description":" "}]}', None), (2, "no", "none")], "meeting_id int, r string, again string")
    items = recap.tasks(reply, "r", "again")
    assert [(r.description, r.owner) for r in items.collect()] == [("call", "Bob")]
    assert recap.grounded(items, texts).first().owner is None
    done = items.withColumn("done", F.lit(True))
    whole = documents.markdown(spark.createDataFrame([(1, " ")], "meeting_id int, title string"), recap.recaps(texts, 8_000), done, documents.lines(lines, F.lit("Ann")))
    assert whole.first().value == "# Meeting\n\n## Recap\n\nAnn: Hello there (31)\n\n## Tasks\n\n- [x] call (Bob)\n\n## Transcript\n\n[0:00] **Ann:** Hello there\n\n[1:01] **Ann:** Maybe Bob\n"


def test_queries_of_lines_read_every_row(spark, tmp_path):
    from skein.plans import texts

    lines = ["plain", "PASSWORD: x", "authorization=y", "at /home/me/x", "token z", None]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, r, "the") for i, r in enumerate(["user", "assistant", None])], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    shown = ["plain", "PASSWORD: <redacted>", "authorization=<redacted>", "at ~/x", "token <redacted>", None]
    found = {r.doc_id: r.md5 for r in texts.n28_redact(spark, str(tmp_path)).collect()}
    assert found == {i: x and hashlib.md5(x.encode()).hexdigest() for i, x in enumerate(shown)}
    assert sorted(r.conv_id for r in texts.n4_highlight(spark, str(tmp_path)).collect()) == [0, 1, 2]
