"""Periodic runs of words: maximal repetitions found through Lyndon arrays.

A run is a stretch of words that repeats with a smallest period q and cannot be made longer on either
side. Every run has, in the order of words or in its reverse, a first Lyndon root that is the longest
Lyndon word at its place; so two Lyndon arrays (one for each order) name a start and a period for
every run, and extending those to both sides gives all runs. Nothing is needed of words but that they
can be compared: no suffix array or tree, no fingerprints.

Lyndon arrays come from next smaller suffixes, from right to left. A suffix is compared with a
candidate; what the candidate matched with its own next smaller suffix tells how far the next
comparison is known, and the last matched stretch of every distance is kept, so a stretch that once
matched at a distance is jumped over and not read again. Each Lyndon word is compared with its right
neighbour up to the shorter one's length and then along a kept stretch.

Runs asked for have four periods at least, so each word of theirs comes four times between two words
that come less often. Texts fall apart at such words; this changes no run.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import annotate, documents, fresh, whole_text

#: Words a run has at least, and periods. With fewer periods than FOURFOLD the cut at rare words would lose runs.
LEAST = 6
FOURFOLD = 4
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def next_smaller(s: list[int], sign: int) -> tuple[list[int], list[int]]:
    """For each suffix of ``s`` the start of the next smaller suffix (or the end), and how far both agree.

    A suffix is smaller than one it begins. ``sign`` -1 reverses the order of letters.
    """
    n = len(s)
    after, agree = [n] * n, [0] * n
    begin, end = [n + 1] * (n + 1), [0] * (n + 1)  # by distance: the right half of the stretch that last matched
    for i in range(n - 1, -1, -1):
        j, same = i + 1, 0
        while j < n:
            d, x = j - i, j + same
            first, last = begin[d], end[d]
            while x < n and s[x] == s[x - d]:
                if first <= x < last:
                    x = last
                else:
                    x += 1
            if x > j:
                begin[d], end[d] = j, x
            same = x - j
            if x == n or (s[x] < s[x - d] if sign > 0 else s[x] > s[x - d]):
                break
            held, j = agree[j], after[j]
            while same < held:  # the next candidate differs from suffix i where this one did
                held, j = agree[j], after[j]
            if same > held:
                same = held
                break
        after[i], agree[i] = j, same
    return after, agree


def lyndon_runs(s: list[int], periods: int = FOURFOLD, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``s`` of ``least`` letters and ``periods`` (2 at least) periods."""
    found = set()
    for sign in (1, -1):
        after, agree = next_smaller(s, sign)
        for i, (j, same) in enumerate(zip(after, agree)):
            q = j - i
            if same < (periods - 2) * q:
                continue
            left = 0
            while left < q and left < i and s[i - 1 - left] == s[i - 1 - left + q]:
                left += 1
            if left < q and j + same - i + left >= max(least, periods * q):
                found.add((i - left, j + same - i + left, q))
    return found


def _stretches(words: list, at: int, times: int, least: int) -> Iterator[tuple[int, list]]:
    """Stretches of ``words`` in which every word comes ``times`` times, and their starts."""
    todo = [(at, words)]
    while todo:
        at, words = todo.pop()
        if len(words) < least:
            continue
        often = {w for w, n in Counter(words).items() if n >= times}
        if len(words) == sum(map(often.__contains__, words)):
            yield at, words
            continue
        for good, part in groupby(words, often.__contains__):
            part = list(part)
            if good:
                todo.append((at, part))
            at += len(part)


def word_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` of ``least`` words and four periods, by start and period."""
    found = []
    for at, part in _stretches(words, 0, FOURFOLD, least):
        rank = {w: i for i, w in enumerate(sorted(set(part)))}
        found += [(at + a, n, q) for a, n, q in lyndon_runs([rank[w] for w in part], least=least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run has after its first period."""
    kept, at = [], 0
    for a, b in sorted((start + q, start + n) for start, n, q in runs):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    return kept + words[at:]


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed``.

    ``collapsed`` has the words joined by one space, without those that a run has after its first
    period. A null, empty or blank text has no words, no runs and an empty collapsed text. Repeated rows
    are treated alike; of runs that share a start the smaller period comes first. An empty table stays
    empty. A text of any length is one row of a task's memory, its words some ten times its size.
    Columns named as those given here give way.
    """
    adds = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    (raw,) = fresh(docs, "_raw")

    def start():
        def one(value: bytes | None) -> tuple:
            words = value.split() if value else []  # bytes split at space and tab to carriage return alone
            runs = word_runs(words, least)
            return [dict(zip(RUN.names, r)) for r in runs], b" ".join(collapse(words, runs) if runs else words).decode()

        return one

    names = docs.columns if keep is None else keep
    return annotate(docs.withColumn(raw, F.col(text).cast(BinaryType())), raw, adds, start, keep=names)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by its checksum goes round in a part of its own words from some place on.

    A null doc_id counts as the empty string.
    """
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(number / 10)
    words = F.filter(F.split(whole_text(), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def around(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(words, lambda _, i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))

    # a one-element array binds the words, so that they are split once a row
    rebuilt = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(around(w), " ")).otherwise(""))[0]
    return docs.select("doc_id", F.when(number % 10 == 0, rebuilt).otherwise(whole_text()).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' runs and what is left when each is collapsed to its first period."""
    found = find_runs(repeated(documents(spark, sf_dir)), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", best).select("*", "best.length", (-F.col("best.before")).alias("start"), (-F.col("best.finer")).alias("period"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
