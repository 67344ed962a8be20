"""Text functions as column expressions, and the few alignments that need Python as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Letters with accents, and the letters they fold to.
ACCENTED = "àáâäãåèéêëìíîïòóôöõùúûüçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucn"
#: Letters that sound alike, by the letter of their class. All other letters count as a; h is silent.
SOUNDS = {"b": "bvpfw", "d": "dt", "g": "cgkqx", "s": "sz", "n": "mn", "l": "lr"}
#: Lines that a recogniser makes up in silence.
COURTESY = (
    "grazie", "grazie a voi", "grazie a te", "grazie a tutti", "grazie a lei", "grazie mille", "grazie di tutto", "grazie per l'attenzione", "buongiorno", "buonasera", "buonanotte",
    "ciao ciao", "arrivederci", "alla prossima", "a presto", "wow", "thank you", "thanks", "thank you very much", "thanks for watching", "thank you for watching", "goodbye", "bye bye",
    "see you next time", "merci", "merci beaucoup", "au revoir", "a bientot", "à bientôt", "sottotitoli", "sottotitoli e revisione",
)
#: Phrases of subtitling credits.
WATERMARKS = (
    "amara.org", "sottotitoli e revisione", "sottotitoli creati", "sottotitoli a cura", "sous-titrage", "sous-titres réalisés", "subtitles by", "subtitled by", "untertitel von", "untertitelung im auftrag",
)
#: Marks for what is not speech.
NOISE = ("[BLANK_AUDIO]", "[ Silence ]", "[silence]", "(silence)", "[MUSIC]", "[Music]", "(music)", "[ Pause ]", "[INAUDIBLE]", "[ Inaudible ]")
#: Keys after which the rest of a line is masked.
SENSITIVE = ("key", "token", "secret", "password", "authorization", "bearer")


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold(word: str | Column) -> Column:
    """Lower case without accents, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(col(word)), ACCENTED, PLAIN), r"[^\p{L}\p{N}]", "")


def words(text: str | Column) -> Column:
    """Runs of letters, digits and inner marks, trimmed to letters and digits."""
    return F.regexp_extract_all(col(text), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}'’._-]*[\p{L}\p{N}])?"), F.lit(0))


def word_spans(text: str | Column) -> Column:
    """(start, end) of each of the ``words``, in characters, the end exclusive."""
    gapped = r"([^\p{L}\p{N}]*)([\p{L}\p{N}](?:[\p{L}\p{N}'’._-]*[\p{L}\p{N}])?)"
    gaps, found = (F.transform(F.regexp_extract_all(col(text), F.lit(gapped), F.lit(i)), lambda w: F.length(w)) for i in (1, 2))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start int, end int>>)").alias("spans"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(acc["spans"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"))).alias("spans"))
    return F.aggregate(F.zip_with(gaps, found, lambda g, w: F.struct(g.alias("gap"), w.alias("size"))), start, step, lambda acc: acc["spans"])


def sounds(folded: str | Column) -> Column:
    """Classes of like sound, silent letters dropped, runs made one."""
    alike = "".join(SOUNDS.values())
    heard = F.regexp_replace(F.translate(col(folded), "h", ""), rf"[\p{{L}}&&[^{alike}]]", "a")
    for letter, members in SOUNDS.items():
        heard = F.translate(heard, members, letter * len(members))
    return F.regexp_replace(heard, r"(.)\1+", "$1")


def skeleton(folded: str | Column) -> Column:
    """The consonants of the sounds."""
    return F.translate(sounds(folded), "a", "")


def bare_words(text: str | Column) -> Column:
    """Lower-case words between white space, without marks at either end; a word of marks alone is empty."""
    return F.transform(F.split(F.trim(col(text)), r"\s+"), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def normalized(text: str | Column) -> Column:
    """The bare words with one space between."""
    return F.array_join(F.array_remove(bare_words(text), ""), " ")


def is_phantom(text: str | Column, voiced_ms: str | Column, least: int = 200) -> Column:
    """A stock line or a phrase of subtitling credits over next to no voice."""
    plain = normalized(text)
    marked = plain.isin(*COURTESY)
    for mark in WATERMARKS:
        marked = marked | F.contains(plain, F.lit(mark))
    return marked & (col(voiced_ms) < least)


def is_repetitive(text: str | Column, longest: int = 6) -> Column:
    """Whether a phrase of 1 to ``longest`` words stands three times in a row; four words at least."""
    found = F.array_remove(bare_words(text), "")

    def loops(w: Column) -> Column:
        out = F.lit(False)
        for n in range(1, longest + 1):
            starts = F.sequence(F.lit(1), F.greatest(F.size(w) - 3 * n + 1, F.lit(1)))
            out = out | ((F.size(w) >= 3 * n) & F.exists(starts, _thrice(w, n)))
        return (F.size(w) >= 4) & out

    return F.get(F.transform(F.array(found), loops), F.lit(0))


def _thrice(w: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: (F.slice(w, i, n) == F.slice(w, i + n, n)) & (F.slice(w, i, n) == F.slice(w, i + 2 * n, n))


def strip_overlap(text: str | Column, carried: str | Column, least: int = 2, most: int = 6) -> Column:
    """``text`` without the longest start of 2 to 6 words that ends ``carried``, unless nothing would be left."""
    raw, own, before = F.split(F.trim(col(text)), r"\s+"), bare_words(text), bare_words(carried)
    out = col(text)
    for n in range(least, most + 1):
        fits = (F.size(own) > n) & (F.size(before) >= n) & (F.slice(own, 1, n) == F.slice(before, F.size(before) - n + 1, n))
        out = F.when(fits, F.array_join(F.slice(raw, n + 1, F.size(raw)), " ")).otherwise(out)
    return out


def strip_noise(text: str | Column) -> Column:
    out = col(text)
    for mark in NOISE:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return F.trim(out)


def is_empty(text: str | Column) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(r"[\p{L}\p{N}]")


def json_object(reply: str | Column, schema: str) -> Column:
    """What stands from the first brace to the last, read by ``schema``; null if that doesn't begin with a whole object."""
    found = F.regexp_extract(col(reply), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, schema))


def format_timestamp(ms: str | Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; negative counts as 0."""
    s = F.floor(F.greatest(col(ms), F.lit(0)) / 1000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def format_duration(ms: str | Column) -> Column:
    """``h hr m min``; null for nothing."""
    minutes = F.floor(col(ms) / 60_000)
    h, m = F.floor(minutes / 60), minutes % 60
    return F.when(col(ms) <= 0, None).when(h > 0, F.format_string("%d hr %d min", h, m)).otherwise(F.format_string("%d min", m))


def file_stem(title: str | Column, date: Column, most: int = 60) -> Column:
    """The date and the title, in ASCII letters, digits, blanks, hyphens and underscores; without a title, Meeting."""
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(col(title), "[^A-Za-z0-9 _-]", "-")), "^-+|-+$", ""))
    return F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), F.trim(F.substring(F.when(plain == "", "Meeting").otherwise(plain), 1, most)))


def contains_word(text: str | Column, word: str) -> Column:
    """``word`` stands in the text with no letter or digit at either side, case aside."""
    escaped = "".join(c if c.isalnum() else f"\\{c}" for c in word.lower())
    return F.lower(col(text)).rlike(rf"(?<![\p{{L}}\p{{N}}]){escaped}(?![\p{{L}}\p{{N}}])")


def redact(line: str | Column, home: str = "/home/me") -> Column:
    """The home folder as ~, and all after a sensitive key masked."""
    keys = "|".join(SENSITIVE)
    masked = F.regexp_replace(col(line), rf"(?i)({keys})([=: ]*+)[^\r\n]+", "$1$2<redacted>")
    return F.replace(masked, F.lit(home), F.lit("~"))


def alignment(a: str, b: str) -> int:
    """Optimal string alignment: a swap of neighbours costs one."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], older[j - 2] + 1)
    return row[-1]


@F.pandas_udf(IntegerType())
def distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """:func:`alignment` of two columns."""
    for a, b in pairs:
        yield pd.Series([alignment(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def damerau(a: str, b: str) -> int:
    """Edits where a swap costs one even if letters stand, or come, between the two: never more than :func:`alignment`."""
    far = len(a) + len(b)
    rows, seen = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]], {}
    for i, x in enumerate(a, 1):
        row, same = [far, i], 0
        for j, y in enumerate(b, 1):
            k = seen.get(y, 0)
            swapped = rows[k][same] + i - k + j - same - 1
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swapped))
            if x == y:
                same = j
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


@F.pandas_udf(IntegerType())
def damerau_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """:func:`damerau` of two columns."""
    for a, b in pairs:
        yield pd.Series([damerau(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def octets(text: str | Column) -> Column:
    """One character for each byte of the text in UTF-8: edits between two such strings are counted in bytes."""
    return F.decode(F.encode(col(text), "UTF-8"), "ISO-8859-1")


PIECE = StructType([StructField("n", LongType()), StructField("text", StringType())])


def pieces(text: str | None, most: int) -> list[tuple[int, str]]:
    """Lines gathered up to ``most`` characters; a longer line is cut. Joined, they are the text."""
    out, held = [], ""
    for line in (text or "").splitlines(keepends=True):
        if held and len(held) + len(line) > most:
            out.append(held)
            held = ""
        held += line
        while len(held) > most:
            out.append(held[:most])
            held = held[most:]
    if held:
        out.append(held)
    return list(enumerate(out))


def chunked(text: str | Column, most: int) -> Column:
    """An array of (n, text): :func:`pieces` of a column."""

    @F.pandas_udf(ArrayType(PIECE))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"n": n, "text": x} for n, x in pieces(t, most)])

    return run(col(text))
