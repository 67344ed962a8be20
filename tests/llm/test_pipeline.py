"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

import corpus_pipeline
from conftest_llm import DOCUMENTS, prose
from test_pairs import brute, brute_hits
from test_rows import brute_spans

from skein.llm import language

ITEMS = [(1, prose(70, 40)), (2, None)]


def corpus():
    base = [(i, prose(i, 60 + i), "aa", "src0", 1) for i in range(30)]
    german = [(100 + i, " ".join(f"sch{'ung' * (i % 3)}ü{'eit' * (k % 4)}" for k in range(30 + i)), "bb", "src1", 1) for i in range(30)]
    more = [
        (200, base[3][1], "aa", "s", 1), (201, base[4][1].replace("sorum", "x", 1), "aa", "s", 1), (202, f"{prose(71, 30)} {prose(70, 40)} {prose(72, 30)}", "aa", "s", 1),
        (203, f"{prose(73, 50)} token = 'abcdef0123456789'", "aa", None, 1), (204, "12345 !!!", None, "s", 1), (205, None, "aa", "s", 1), (206, "", "aa", "s", 1), (207, prose(74, 9_000), "aa", "s", 1),
    ]
    return [*base, *german, *more]


def test_stages_keep_what_the_plain_versions_keep(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCUMENTS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left, n = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows, 0
    model = language.train(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs, n = spark.read.parquet(f"{tmp_path}/{n}"), n + 1
        if name == "language ID":
            left = [r for r in left if not model.predict(r[1])[2]]
            assert not {204, 205, 206} & {r[0] for r in left} and len(left) >= 60
        elif name == "MinHash near-dedup":
            kept = {k for k, _, _, keep in brute([r[:2] for r in left], 5) if keep}
            left = [r for r in left if r[0] in kept]
            assert 200 not in kept
        elif name == "benchmark decontamination":
            left = [r for r in left if not brute_hits(r[1], ITEMS)[1]]
            assert 202 not in {r[0] for r in left}
        else:
            left = [r for r in left if not brute_spans(r[1])]
            assert 203 not in {r[0] for r in left}
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(left, key=str), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in left}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_stages_leave_the_documents_columns_alone(spark, tmp_path):
    """Columns named as the operators', nulls in any column, repeated rows and an empty table."""
    extra = ", score double, items array<string>, _blob string, blob int, spans string, lang_pred string, n_words int"
    own = (0.25, ["mine"], "b", 7, "s", "l", None)
    rows = [(*r, *own) for r in [*corpus(), (None, prose(80, 50), None, None, None), (300, prose(81, 50), "aa", "s", 1), (300, prose(81, 50), "aa", "s", 1)]]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOCUMENTS + extra).repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        kept = sorted(map(str, map(tuple, out.collect())))
        assert set(kept) <= set(map(str, rows)) and sum(k.startswith("(300,") for k in kept) == 2 and any(k.startswith("(None,") for k in kept)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
