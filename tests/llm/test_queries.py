"""The registered queries over tables on disk, against plain Python: zlib, the tokenizers library, and brute force."""

import random
import zlib

import numpy as np
import pytest
from conftest_llm import DOCUMENTS, cases, prose
from pyspark.sql import functions as F

from skein.llm import language, licenses, packing, quality, token_files
from skein.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with clashing extra columns, labels, and a benchmark."""
    at = str(tmp_path_factory.mktemp("tables"))
    more = [(1000 + i, prose(500 + i, 20 + i % 50) if i % 2 else " ".join(["###", "$$$", "!"] * (5 + i % 9)), "aa" if i % 2 else "bb", "src", 1) for i in range(120)]
    rows = [(*r, 0.5, ["x"], "y") for r in [*cases(), *more]]
    spark.createDataFrame(rows, DOCUMENTS + ", score double, items array<string>, _bad string").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], i % 2, 0) for i, r in enumerate(more, 1)] + [(None, 1, 0), (5, None, None), (1001, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def crc(key, number):
    return zlib.crc32(b"" if key is None else str(key).encode()) % number


def encoded(name, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_is_the_library(spark, folder):
    at, rows = folder
    found = token_files.op3_token_files(spark, at).collect()
    start, want = 0, []
    for key, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1] or ""), x[1] or "")):
        ids = encoded("byte_bpe_50k.json", text, 2)
        want.append((key, start, len(ids), checksum(ids)))
        start += len(ids)
    assert sorted(map(str, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found))) == sorted(map(str, want))


def test_op5_says_what_it_holds_out(spark, folder):
    at, rows = folder
    found = quality.op5_quality(spark, at).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(r[0]) for r in rows)
    for r in found:
        assert r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    good = [r.predicted == (r.doc_id + 1) % 2 for r in found if r.doc_id is not None and r.doc_id >= 1000 and r.held_out and r.doc_id != 1001]
    assert np.mean(good) > 0.9


def test_op6_says_what_it_holds_out(spark, folder):
    at, rows = folder
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 2}
    found = language.op6_language(spark, at).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(r[0]) for r in rows)
    learned = {r[2] for r in rows if r[2] and r[1] is not None and crc(r[0], 5) != 0}
    for r in found:
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        if r.doc_id in texts:
            letters = any(map(str.isalpha, texts[r.doc_id] or ""))
            assert r.lang_pred in learned if letters else r.lang_pred == "und"


def test_more_languages_than_any_cap(spark):
    rows = [(i, f"{chr(0x4E00 + i // 2)}{chr(0x5E00 + i // 2)} {chr(0x4E00 + i // 2)}", f"l{i // 2}") for i in range(600)]
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert {lang for _, lang in found} == {r[2] for r in rows}


def test_op8_packs_every_piece_of_the_library(spark, folder):
    at, rows = folder
    found = packing.op8_packing(spark, at).collect()
    want = []
    for key, text, *_ in rows:
        ids = encoded("word_bpe_49k.json", text, 1)
        want += [(key, p, a, len(ids[a : a + 4096]), checksum(ids[a : a + 4096])) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found))) == sorted(map(str, want))
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        ends = [0]
        for offset, length in sorted(spans):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_groups_share_what_they_leave_unfilled(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randint(300, 2200), i, i) for i in range(400)]
    found = spark.createDataFrame(rows, "key long, piece int, start long, length long, ids_crc32 long, slot long")
    alone, bound = packing.packed(found, group=400), -(-sum(r[3] for r in rows) // 4096)
    dealt = packing.packed(found, group=40).collect()
    assert sorted(r.key for r in dealt) == list(range(400))
    held = {}
    for r in dealt:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= 4096 and len(held) <= bound + 3
    assert alone.select("sequence_id").distinct().count() <= bound + 1


def contained(text, goal, size=5):
    """The largest share of the template's shingles in a stretch of five quarters of its length, by hand."""
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in t).split()
    cut = lambda w: [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    held, doc = set(cut(words(goal))), cut(words(text))
    width = -(-len(held) * 5 // 4)
    return max((len(set(doc[i : i + width]) & held) for i in range(max(1, len(doc)))), default=0) / len(held)


def test_licenses_against_brute_force(spark):
    """Of edited templates among other words, those that hold 80 in 100 of the shingles are found, and no others."""
    rng, rows, want, must = random.Random(8), [], set(), set()
    for name, text in licenses.TEMPLATES.items():
        for rate in (0, 0.01, 0.02, 0.04, 0.08):
            words = [f"w{rng.randrange(99)}" if rng.random() < rate else w for w in text.split()]
            doc = f"{prose(rng.randrange(10**6), 60)} {' '.join(words)} {prose(rng.randrange(10**6), 40)}"
            rows.append((len(rows), doc))
            share = {other: contained(doc, goal) for other, goal in licenses.TEMPLATES.items()}
            want |= {(len(rows) - 1, other) for other, x in share.items() if x >= 0.8}
            if share[name] == max(share.values()) >= 0.8:
                must.add((len(rows) - 1, name))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, prose(1, 30_000) + licenses.TEMPLATES["ISC"])]
    want.add((rows[-1][0], "ISC"))
    must.add((rows[-1][0], "ISC"))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, m.license) for r in found for m in r.licenses}
    assert got <= want and len(must & got) >= 0.99 * len(must) > 40
    assert licenses.scan(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), {}).first().licenses == []
