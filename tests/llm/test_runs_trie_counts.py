"""op11 to op13 against plain versions that follow the definitions word by word, and against the tokenizers library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest_llm import DOCUMENTS, cases, prose
from pyspark.sql import functions as F

from skein.llm import periodic_runs, prefix_trie, token_counts
from skein.llm.common import tokenizer_path

NAME = "word_bpe_49k.json"


def brute_runs(words, least=6, periods=4):
    """Every stretch whose words q apart are equal, made as long as it goes, if q is its smallest period."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            part = words[i : k + q]
            if k > i and len(part) >= max(least, periods * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = max(k, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for start, n, q in runs for i in range(start + q, start + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_are_those_of_the_definition(letters):
    rng = random.Random(letters)
    for _ in range(400):
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 36))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else w for i, w in enumerate(words)] + [rng.randrange(letters) for _ in range(rng.randint(0, 4))]
        runs = brute_runs(words)
        assert periodic_runs.word_runs(words) == runs
        assert sorted(periodic_runs.lyndon_runs(words, 2, 2), key=lambda r: (r[0], r[2])) == brute_runs(words, 2, 2)
        assert periodic_runs.collapse(words, runs) == brute_collapse(words, runs)


def test_runs_of_fibonacci_and_long_periods():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    assert sorted(periodic_runs.lyndon_runs([ord(c) for c in b[:300]], 2, 2), key=lambda r: (r[0], r[2])) == brute_runs(list(b[:300]), 2, 2)
    words = [i * i % 401 for i in range(200)] * 5
    assert periodic_runs.word_runs(words) == brute_runs(words)[:1] != []
    assert periodic_runs.word_runs([0] * 50_000) == [(0, 50_000, 1)]


def test_op11_is_the_definition(spark, tmp_path):
    more = [(2000 + i, " ".join(random.Random(i).choice(["a", "b"]) for _ in range(60)), "en", "s", 1) for i in range(60)]
    more += [(3003, "a b " * 8 + "z " + "c " * 9 + "d", None, None, None), (3000, "x y z\n" * 400 + "tail", None, None, None), (3001, "\xa0 \x1c " * 9, None, None, None), (3002, prose(7, 9000) + " deux mots" * 30, None, None, None)]
    rows = [(*r, "runs?", 1, "c") for r in [*cases(), *more]]
    spark.createDataFrame(rows, DOCUMENTS + ", runs string, Length int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text, *_ in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(b"" if key is None else str(key).encode()), len((text or "").encode().split())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 400 else periodic_runs.word_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        want.append((key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(b" ".join(brute_collapse(words, runs)))))
    found = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert any(w[1] > 1 for w in want)


def test_runs_beside_other_columns_and_of_nothing(spark, nothing):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", "x"), (1, "a b a b a b a b c", "x"), (2, None, None)], "doc_id long, text string, RUNS string")
    found = periodic_runs.find_runs(docs).collect()
    assert sorted((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in found if r.text) == [(1, "a b a b a b a b c", [(0, 8, 2)], "a b c")] * 2
    assert [(r.runs, r.collapsed) for r in found if r.doc_id == 2] == [([], "")]
    assert periodic_runs.find_runs(nothing).count() == 0


def brute_trie(rows):
    """Each prefix's figures, from the lists of rebuilt turns."""
    turns = {}
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())} {role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    original = {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(original.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, of in members.items():
        inside = [u for u in members if u[: len(node)] == node]
        children = [u for u in inside if len(u) == len(node) + 1]
        leaves = [u for u in inside if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in inside)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in inside if u)
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng, rows = random.Random(5), []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            rows.append((c * 3 % 71, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "é" * 9]) if t < 9 else f"text {rng.randrange(4)}"))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(300) for t in range(3)]  # a hot group of copies
    rows += [(2000, t, "user", f"long {t}") for t in range(400)] + [(2001, 1, "a", "x"), (2001, 1, "a", "w"), (2001, None, "b", "y"), (2001, 1, "a", "x")]
    return [*rows, (-7, 0, "a", "x"), (-5, 0, "a", "y"), (-5, 1, "a", "z"), (None, 0, "user", "x"), (None, None, None, None)]


def test_trie_is_the_definition(spark):
    rows = [(*r, 7, "x") for r in conversations()]
    found = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, NODE string").repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_trie(conversations()), key=str)


def test_trie_is_its_sql(spark, tmp_path):
    spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(prefix_trie.ORACLE_SQL["op12_prefix_trie"]).df()
    found = prefix_trie.op12_prefix_trie(spark, str(tmp_path)).toPandas()
    key = ["conv_id", "depth"]
    pd.testing.assert_frame_equal(found.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True)[found.columns], check_dtype=False)


def test_trie_cuts_long_lists_of_members_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    found = prefix_trie.trie(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_trie(conversations()), key=str)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(NAME))


def of_library(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


ODD = [
    "internationalization Hello, World's don't I'll we've they're 'rex 'r 'l l've 've 'lll", "1,2.a1 $$$ a,### ÀÉ. word$$$ it,&&& x.'' y'!s", "étude x̂y 각 が", "ﬁ ǅ ß İstanbul ΣΑΣ",
    "\x00 \x1c a\x85b c\xa0d e", "a<|endoftext|>b <|startoftext|> !<|endoftext|>' <|ENDOFTEXT|> <|endof", "👩‍👩‍👧 x 日本語のテスト", "a" * 90 + " bananabanana" * 3, "''' ''s '''s 's's't're 'V'E O'Re'LL", " \n ", "",
]


def test_every_prefix_costs_what_the_library_gives_it(library):
    count, rng = token_counts.PrefixCounter(tokenizer_path(NAME)), random.Random(6)
    pieces = ["'", "s", "t", "r", "e", "v", "l", "m", "S", " ", "!", ",", "1", "é", "é", "́", "が", "ß", "İ", "<|endoftext|>", "<|", "ᄀ", "ᅡ", "ᆨ", "\n", "\x1c", "½", "Ω", "ͅ", "å"]
    made = ["".join(rng.choice("abcdehilnorst'") for _ in range(rng.randint(1, 24))) for _ in range(200)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for text in [*ODD, *made, prose(3, 150)]:
        counts = np.cumsum(np.frombuffer(count.prefixes(text), np.int8), dtype=int).tolist()
        assert counts == [of_library(library, text[:i]) for i in range(1, len(text) + 1)], text[:60]
    assert count.counts([*ODD, *made]) == [of_library(library, t) for t in [*ODD, *made]]


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS", 20)
    monkeypatch.setattr(token_counts, "PAIRS", 20)
    monkeypatch.setattr(token_counts, "BLOCK", 100)
    count, texts = token_counts.PrefixCounter(tokenizer_path(NAME)), [prose(i, 400) for i in range(4)]
    for text in texts:
        assert sum(count.counts(list(token_counts._blocks(text)))) == of_library(library, text)
        assert "".join(token_counts._blocks(text)) == text


def test_op13_is_the_library(spark, tmp_path, library):
    rows = [(*r, "n", 1.0) for r in [*cases(), *[(5000 + i, t, None, None, None) for i, t in enumerate(ODD)], (6000, prose(8, 400_000), "en", "s", 1)]]
    spark.createDataFrame(rows, DOCUMENTS + ", N_TOKENS string, over_limit double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(key, len((text or "").encode()), of_library(library, text or "")) for key, text, *_ in rows]
    found = token_counts.op13_token_counts(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((*w, w[2] > 2048)) for w in want)


def test_stored_prefixes_answer_budgets(spark, nothing, library):
    texts = [*ODD, prose(9, 300), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = token_counts.count_tokens(docs, tokenizer_path(NAME))
    for budget in (0, 1, 7, 100):
        for r in token_counts.truncated(counted, budget).collect():
            text = texts[r.doc_id]
            if text is None:
                assert r.text is None and r.n_tokens == 0
                continue
            assert of_library(library, r.text) <= budget and text.startswith(r.text)
            assert not any(of_library(library, text[:i]) <= budget for i in range(len(r.text) + 1, min(len(text), len(r.text) + 200) + 1))
    asked = counted.withColumn("at", token_counts.tokens_at("prefixes", F.lit(5)))
    assert {r.doc_id: r.at for r in asked.where("doc_id < 11").collect()} == {i: of_library(library, t[:5]) for i, t in enumerate(ODD)}
    assert token_counts.count_tokens(nothing, tokenizer_path(NAME)).count() == 0
