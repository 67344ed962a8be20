"""Substring dedup by hashing lines, keeping the earliest occurrence.

A text falls into units: lines (or paragraphs, or sentences). Units are normalised (case, white space,
marks of sentences) and hashed to 64 bits. Over all documents each digest's earliest unit, by key, row
and place, stays; other units of that digest go if they stand in a run of such units of enough words.

A passage that is pasted within a line shares no unit. So stretches of 20 words are hashed too, a
few chosen by their content (winnowing: the least hash of each 21 neighbours), such that every
stretch of 40 words has one and equal stretches have the same. A chosen stretch with an earlier
occurrence goes; so do the words around the outer ones of a chain of them, as far as they equal those
around their first occurrence. Offsets are those of the original text, in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import documents, settle, slices, without
from .near_dup import sieve

#: Words of a run of repeated units from which on it is removed, and of a stretch.
LEAST = 20
#: Neighbouring stretches of LEAST words of which one is chosen: repeats of LEAST + NEAR - 1 = 40 words cannot be missed.
NEAR = 21
#: What ends a unit of each kind.
BREAKS = {"line": r"\n", "paragraph": r"\n[^\S\n]*\n", "sentence": r"[.!?\n]"}
_WORD = re.compile(r"[^\s.!?]+")


def units(text: str, kind: str = "line") -> Iterator[tuple[int, int, int, int]]:
    """(start, end, words, digest) of each unit with a word, without white space around it; a sentence ends after its marks."""
    starts = [0, *(m.end() for m in re.finditer(BREAKS[kind], text))]
    for start, after in zip(starts, [*starts[1:], len(text)]):
        part = text[start:after]
        words = [w.lower() for w in _WORD.findall(part)]  # lower case may be longer
        if words:
            start += len(part) - len(part.lstrip())
            while text[after - 1].isspace() or kind == "sentence" and after < len(text) and text[after] in ".!?":
                after += -1 if text[after - 1].isspace() else 1
            yield start, after, len(words), xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "replace"))


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (one number for each row of ``docs``) and text."""
    return docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))


def hashed(rows: DataFrame, kind: str = "line") -> DataFrame:
    """A row for each unit: key, row, unit, word (the place of its first), start, end, words, digest."""
    ints = [StructField(n, IntegerType()) for n in ("unit", "word", "start", "end", "words")]
    schema = StructType([*rows.schema.fields[:2], *ints, StructField("digest", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                out, at = [], []
                for k, value in enumerate(part.column(2).to_pylist()):
                    word = 0
                    for i, u in enumerate(units(value, kind) if value else ()):
                        out.append((i, word, *u))
                        at.append(k)
                        word += u[2]
                if out:
                    *places, digest = zip(*out)
                    arrays = [*[pa.array(c, pa.int32()) for c in places], pa.array(np.array(digest, np.uint64).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns[:2]), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


class _Words(dict):
    """Word to the hash of its lower case; keeps the first ``room``."""

    def __init__(self, room: int = 200_000):
        self._room = room

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace"))
        if len(self) < self._room:
            self[word] = found
        return found


def stretches(words: list[str], memo: _Words, least: int) -> np.ndarray:
    """The digest of each stretch of ``least`` words, by its first word."""
    n = len(words) - least + 1
    if n < 1:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j, by in enumerate(np.random.default_rng(4).integers(1 << 62, size=least, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        out += each[j : j + n] * by
    out = (out ^ out >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def chosen(digests: np.ndarray, near: int = NEAR) -> np.ndarray:
    """The places of the first least digest of each ``near`` neighbours, of all if they are fewer."""
    if not len(digests):
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(digests, min(near, len(digests)))
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def _anchors(rows: DataFrame, least: int) -> DataFrame:
    """key, row, word and digest of each chosen stretch."""
    kind = StructType([*rows.schema.fields[:2], StructField("word", IntegerType()), StructField("digest", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                found = [stretches(_WORD.findall(v), memo, least) if v else np.empty(0, np.uint64) for v in part.column(2).to_pylist()]
                places = [chosen(f) for f in found]
                at = np.repeat(np.arange(len(found)), [len(p) for p in places])
                if len(at):
                    digest = np.concatenate([f[p] for f, p in zip(found, places)]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns[:2]), pa.array(np.concatenate(places), pa.int32()), pa.array(digest)], names=kind.names)

    return rows.mapInArrow(run, kind)


def _ends(rows: DataFrame, least: int) -> DataFrame:
    """row, word, back, starts, ahead and ends for each place in ``places`` (word numbers): hashes and offsets of up to NEAR words before the place, nearest first, and from it on."""
    lists = [StructField(n, ArrayType(kind)) for n, kind in (("back", LongType()), ("starts", IntegerType()), ("ahead", LongType()), ("ends", IntegerType()))]
    schema = StructType([rows.schema["row"], StructField("word", IntegerType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                out, at = [], []
                for k, (value, places) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    found = list(_WORD.finditer(value))
                    for p in places:
                        # starts[i] is where i words before the place start, ends[i] where i words from it on end
                        before, after = found[max(0, p - NEAR) : p][::-1], found[p : p + NEAR]
                        starts = [found[p].start() if p < len(found) else len(value), *(m.start() for m in before)]
                        ends = [found[p - 1].end() if p else 0, *(m.end() for m in after)]
                        out.append((p, *([memo[m.group()] - (1 << 63) for m in side] for side in (before, after)), starts, ends))
                        at.append(k)
                if out:
                    word, back, ahead, starts, ends = zip(*out)
                    arrays = [pa.array(c, t) for c, t in zip((word, back, starts, ahead, ends), (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def _equal(one: str, two: str) -> Column:
    """How many leading elements of two arrays are equal."""
    n = F.least(F.size(one), F.size(two))
    same = F.zip_with(F.slice(one, F.lit(1), n), F.slice(two, F.lit(1), n), lambda x, y: x == y)
    stop = F.array_position(same, F.lit(False)).cast("int")
    return F.when(stop == 0, n).otherwise(stop - 1)


def _passages(rows: DataFrame, least: int) -> DataFrame:
    """Passages with an earlier occurrence, by chains of chosen stretches: key, row, word, after, start, end and first."""
    anchors = settle(_anchors(rows, least))
    twice = settle(anchors.groupBy("digest").count().where("count > 1").select("digest"))
    again = settle(anchors.where(sieve(twice, "digest", F.col("digest"))).join(twice, "digest"))
    # written, so that the join below may split a digest of many stretches
    firsts = settle(again.groupBy("digest").agg(F.min(F.struct(F.col("key").isNotNull().alias("keyed"), "key", "row", "word")).alias("first")))
    later = again.join(firsts, "digest").where((F.col("row") != F.col("first.row")) | (F.col("word") >= F.col("first.word") + least))
    order = Window.partitionBy("row").orderBy("word")
    opens = F.coalesce(F.col("word") > F.lag("word").over(order) + least, F.lit(True)).cast("int")
    chains = later.withColumn("opens", opens).withColumn("chain", F.sum("opens").over(order))
    chains = chains.groupBy("row", "chain").agg(
        F.first("key").alias("key"), F.min("word").alias("word"), (F.max("word") + least).alias("after"),
        F.min_by("first", "word").alias("first"), F.max_by("first", "word").alias("last"),
    )
    chains = settle(chains.select("row", "key", "word", "after", F.col("first.row").alias("row0"), F.col("first.key").alias("key0"), F.col("first.word").alias("word0"), F.col("last.row").alias("row1"), (F.col("last.word") + least).alias("after1"), (F.col("after") - least - F.col("last.word")).alias("away")))
    places = [chains.select(F.col(r).alias("row"), F.col(w).alias("word")) for r, w in (("row", "word"), ("row", "after"), ("row0", "word0"), ("row1", "after1"))]
    asked = places[0].unionByName(places[1]).unionByName(places[2]).unionByName(places[3]).distinct().groupBy("row").agg(F.collect_list("word").alias("places"))
    asked = settle(asked)
    ends = settle(_ends(rows.select("row", "text").where(sieve(asked, "row", F.col("row"))).join(asked, "row"), least))
    for row, word, hashes, offsets, side in (("row", "word", "back", "starts", "own"), ("row0", "word0", "back", "starts", "other"), ("row", "after", "ahead", "ends", "own_"), ("row1", "after1", "ahead", "ends", "other_")):
        chains = chains.join(ends.select(F.col("row").alias(row), F.col("word").alias(word), F.col(hashes).alias(side), F.col(offsets).alias(f"at_{side}")), [row, word])
    # within one row the kept occurrence stays whole
    room = lambda r, gap: F.when(F.col("row") == F.col(r), F.greatest(F.lit(0), gap - least)).otherwise(F.lit(NEAR))
    chains = chains.withColumn("b", F.least(_equal("own", "other"), room("row0", F.col("word") - F.col("word0")))).withColumn("a", F.least(_equal("own_", "other_"), room("row1", F.col("away"))))
    first = F.struct(F.col("key0").alias("key"), F.col("row0").alias("row"), F.get("at_other", F.col("b")).alias("start"))
    return chains.select("key", "row", (F.col("word") - F.col("b")).cast("int").alias("word"), (F.col("after") + F.col("a")).cast("int").alias("after"), F.get("at_own", F.col("b")).alias("start"), F.get("at_own_", F.col("a")).alias("end"), first.alias("first"))


def _later(found: DataFrame) -> DataFrame:
    """Rows of ``found`` whose digest occurs earlier, by key, row and start; with ``first``, where."""
    place = F.struct(F.col("key").isNotNull().alias("keyed"), "key", "row", "start", "end")
    firsts = settle(found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first"))
    repeated = found.where(sieve(firsts, "digest", F.col("digest"))).join(firsts, "digest")
    return repeated.where((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))


def _runs(rows: DataFrame, least: int, kind: str) -> DataFrame:
    """Runs of repeated units: key, row, word, start, end, n_words and first (of the first unit)."""
    repeated = _later(settle(hashed(rows, kind)))
    run = F.col("unit") - F.row_number().over(Window.partitionBy("row").orderBy("unit"))
    spans = repeated.withColumn("run", run).groupBy("row", "run").agg(
        F.first("key").alias("key"), F.min("word").alias("word"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min_by("first", "unit").alias("first"),
    )
    return spans.where(F.col("n_words") >= least).drop("run")


def _named(spans: DataFrame, key: str) -> DataFrame:
    return spans.select(F.col("key").alias(key), "row", "start", "end", "n_words", F.col("first.key").alias("kept_key"), F.col("first.start").alias("kept_start"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, kind: str = "line") -> DataFrame:
    """By units alone, a row for each removed span: key, row, start, end, n_words, kept_key and kept_start (of its first unit).

    ``least`` words are the least of a run of repeated units that goes; with 0 every repeated unit does.
    Null and empty texts have no units; null keys rank first. Of repeated rows one keeps its text. Texts
    of any length are read in parts of bounded size. Other columns are ignored; an empty table gives
    an empty result.
    """
    return _named(_runs(numbered(docs, key, text), least, kind), key)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, kind: str = "line", stretch: int = LEAST) -> DataFrame:
    """As :func:`removals`, by units and by stretches of words: spans that touch are one, with the kept place of its first part.

    ``stretch`` is the words of a stretch, whatever ``least`` asks of units. A stretch goes unless it overlaps its own first occurrence.
    """
    return _named(_repeats(settle(numbered(docs, key, text)), least, kind, stretch), key)


def _repeats(rows: DataFrame, least: int, kind: str, stretch: int) -> DataFrame:
    parts = _passages(rows, stretch)
    runs = _runs(rows, least, kind)
    parts = parts.unionByName(runs.select("key", "row", "word", (F.col("word") + F.col("n_words")).cast("int").alias("after"), "start", "end", F.struct("first.key", "first.row", "first.start").alias("first")))
    order = Window.partitionBy("row").orderBy("word", "after")
    opens = F.col("word") > F.coalesce(F.max("after").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    parts = parts.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("row", "run").agg(
        F.first("key").alias("key"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("after") - F.min("word")).cast("long").alias("n_words"), F.min_by("first", F.struct("word", "after")).alias("first"),
    )


def cut(text: Column, spans: Column) -> Column:
    """``text`` without ``spans`` (array of structs with start and end, ascending)."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s.out, F.substring(text, s.at + 1, x["start"] - s.at)).alias("out"))
    return F.aggregate(spans, state, step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, F.length(text) - s.at)))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, kind: str = "line", stretch: int = LEAST) -> DataFrame:
    """``docs`` with all :func:`repeats` cut from the text, and ``removed``, their original offsets (start, end).

    Rows that repeat a key are cut each by its own spans. A column named removed gives way, a null text
    stays null, an empty table empty.
    """
    numbers = "_row"
    while numbers in (c.lower() for c in docs.columns):
        numbers += "_"
    whole = settle(without(docs, ["removed"]).withColumn(numbers, F.monotonically_increasing_id()))
    spans = _repeats(settle(whole.select(F.col(f"`{key}`").alias("key"), F.col(numbers).alias("row"), F.col(f"`{text}`").alias("text"))), least, kind, stretch)
    each = spans.groupBy(F.col("row").alias(numbers)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = whole.join(each, numbers, "left").drop(numbers)
    joined = joined.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")))
    return joined.withColumn(text, cut(F.col(f"`{text}`"), F.col("removed")))


def op4_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that repeat earlier text, of 20 words or more."""
    found = repeats(documents(spark, sf_dir))
    return found.select("doc_id", "start", "end", "n_words", F.col("kept_key").alias("kept_doc_id"), "kept_start")


QUERIES = {"op4_substring_dup": op4_substring_dup}
