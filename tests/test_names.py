"""Vocabulary repair and its undo: sentences with known answers, and repaired lines that go back."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import vocabulary as V

EVERYDAY = "angolo avvocato bianco casa cosa costi lampada lingua mattina meeting nostri risposta verde voglia whatever include mention exclude".split()


@pytest.fixture(scope="module")
def fix(spark):
    everyday = spark.createDataFrame([(w,) for w in EVERYDAY], "word string")

    def run(terms, lines):
        listed = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int")
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(lines)], "id int, text string, repairs string")
        found = V.repaired(docs, listed, everyday).withColumn("back", V.reverted("repaired", "changes")).orderBy("id").collect()
        return [(r.repaired, [tuple(c) for c in r.changes], r.back) for r in found]

    return run


def test_names_come_back_and_go_back(fix):
    terms = ["Langola", "langola", "  ", None, "!!", "Obsidara", "Ostri", "Feedharbour", "Vogliacasa", "VMC", "Voglia Mutui Casa", "Casa", "Meeting"]
    table = {
        "Allora, sull'angolo è quello che usiamo.": "Allora, Langola è quello che usiamo.",
        "Allora, lana gola è quello che usiamo.": "Allora, Langola è quello che usiamo.",
        "Allora, Nongula è quello che usiamo.": "Allora, Langola è quello che usiamo.",
        "  Quindi: «Nongulo» — con obsidera, no?  ": "  Quindi: «Langola» — con Obsidara, no?  ",
        "Siamo passati da Anastri": "Siamo passati da Ostri",
        "poi feed harbor per i post": "poi Feedharbour per i post",
        "quelli di vogli casa": "quelli di Vogliacasa",
        "il contratto vmc di ieri": "il contratto VMC di ieri",
        "e poi voglia mutui casa.": "e poi Voglia Mutui Casa.",
        "il meeting di oggi": "il Meeting di oggi",
        "usiamo obsidraa per i dati": "usiamo Obsidara per i dati",
        "Nongula, Nongulo, sempre Nongula.": "Nongula, Langola, sempre Langola.",
        "Langola, cioè Nongula": "Langola, cioè Langola",
    }
    found = fix(terms, list(table))
    assert [r[0] for r in found] == list(table.values())
    ambiguous = list(table).index("Langola, cioè Nongula")  # one of the two was said
    assert [r[2] for r in found] == [None if i == ambiguous else line for i, line in enumerate(table)]
    assert found[3][1] == [("Nongulo", "Langola"), ("obsidera", "Obsidara")]


def test_ordinary_words_stay(fix):
    lines = [
        "Allora, Ingola e Langura restano.", "Un angolo tranquillo, direi.", "Domani lancerà il nuovo listino.", "Ho comprato della lana gialla.", "Guarda l'angolo della stanza.", "La gola fa male.",
        "Langola è pronto", "Non ho voglia. Casa mia è lontana.", "che voglia, casa mia", "Non ho voglia\nCasa mia è lontana.", "hanno langolato la pratica", "una dozzina di ostriche", "I nostri clienti", "DMC oppure VNC",
        "il BMC è voglio lui casa", "il meating di oggi", "", "...", None,
    ]
    found = fix(["Langola", "Ostri", "Vogliacasa", "VMC", "Meeting"], lines)
    assert [(r[0], r[1]) for r in found] == [(line, []) for line in lines]
    assert fix([], ["Nongula"]) == [("Nongula", [], None)]


def test_a_list_keeps_its_first_terms(spark):
    nothing = spark.createDataFrame([], "word string")
    terms = spark.createDataFrame([(f"Word{i:03}", i) for i in range(V.TERMS + 50)], "term string, place int")
    kept = V.glossary(terms, nothing).collect()
    assert sorted(r.term for r in kept) == [f"Word{i:03}" for i in range(V.TERMS)]


def test_undo_refuses_what_it_cannot_tell(spark):
    rows = [
        ("i Langolas sono due", [("Nongula", "Langola")], None),
        ("«Langola», diceva", [("Nongula", "Langola")], "«Nongula», diceva"),
        ("Langola, cioè Langola.", [("Nongula", "Langola")], None),
        ("Langola, cioè Langola.", [("Nongula", "Langola"), ("Nongulo", "Langola")], "Nongula, cioè Nongulo."),
        ("tutt'altra frase", [("Nongula", "Langola")], None),
        ("niente da fare", [], None),
        ("Langola e a.b+c, poi Langola", [("x$1", "Langola"), ("\\E(", "a.b+c"), ("", "Langola")], "x$1 e \\E(, poi "),
        ("x", [("y", "")], None),
        (None, [("y", "x")], None),
    ]
    found = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(rows)], "id int, text string, changes array<struct<was string, now string>>")
    got = found.select("id", V.reverted("text", "changes").alias("back")).orderBy("id").collect()
    assert [r.back for r in got] == [want for *_, want in rows]


def test_repairs_of_random_lines_go_back(fix):
    rng = random.Random(2)
    terms = ["Langola", "Feedharbour", "Obsidara", "Voglia Mutui Casa"]
    lines = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            term = rng.choice(terms)
            at = rng.randrange(1, len(term))
            words.append(rng.choice([term[:at] + term[at + 1 :], term[:at] + "x" + term[at:], term.lower(), "parola", "sull'" + term[1:], "«" + term[:at] + "e" + term[at + 1 :] + "»"]))
        lines.append(rng.choice(["", "  "]) + rng.choice([" ", ", ", " — "]).join(words) + rng.choice(["", ".", "\n"]))
    found = fix(terms, lines)
    assert sum(bool(r[1]) for r in found) > 100
    for line, (now, changes, back) in zip(lines, found):
        assert (now == line) == (not changes) and back in (line, None)
        if changes and all(now.count(c[1]) == sum(c[1] == d[1] for d in changes) for c in changes):
            assert back == line


@pytest.mark.parametrize("term,word,near", [("langola", "sullangolo", True), ("ostri", "anastri", True), ("langola", "pentola", False), ("milano", "milanese", False), ("ostri", "ostruito", False), ("ostri", "ostri", True), ("a", "", False)])
def test_tails(spark, term, word, near):
    rows = spark.createDataFrame([(term, word)], "t string, w string")
    assert rows.select(V.tail_distance(F.col("t"), F.col("w")).alias("near")).first().near is near


def test_letters_between_swapped_ones_count_as_the_edits_they_are(fix):
    found = fix(["Aninginsh"], ["dann aningin hees noch", "dann aningin hessu noch"])
    assert found[0] == ("dann Aninginsh noch", [("aningin hees", "Aninginsh")], "dann aningin hees noch")  # three edits, four with swaps of neighbours only
    assert found[1][1] == []


def test_edits_are_those_of_the_sql():
    import duckdb

    from skein.functions import text as T

    rng = random.Random(5)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 8))), "".join(rng.choices("abc", k=rng.randint(0, 8)))) for _ in range(300)]
    con = duckdb.connect()
    assert [T.damerau(a, b) for a, b in pairs] == [con.execute("SELECT damerau_levenshtein(?, ?)", p).fetchone()[0] for p in pairs]
    assert any(T.damerau(a, b) < T.alignment(a, b) for a, b in pairs)
