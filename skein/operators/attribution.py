"""Who said which line: voices of windows carried on, known people recognised first, lines cut where the voice changes.

Tracks are tables of turns: the meeting's key, ``track`` (a number), ``s`` and ``e``. A line meets the
turns it overlaps by key and time bucket (``intervals.overlapping``), so a long meeting spreads over tasks;
what one task holds whole is one line with its turns, or the local voices of one window.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..streaming.fold import fold
from . import intervals as I
from . import read_models as R
from . import vectors as L

#: How a line may be cut (shares, ms, confidences, drift of a cut in the text, words of a piece) and how far a voice may be from a line.
SHARE, PIECE_MS, LINE_MS, COVERED, TURN_SURE, TEXT_SURE, DRIFT, PIECE_WORDS, REACH_MS = 0.25, 1_500, 3_000, 0.75, 0.5, 0.3, 0.25, 2, 400
#: Fixed value: speech that recognises somebody in a meeting, at least.
GUIDED_MS = 3_000
#: Marks that end a sentence or a clause, and closing marks that may stand after them.
SENTENCE, CLAUSE, CLOSING = ".!?…;", ",:—–", "\"'»”’)]"


@dataclass(frozen=True)
class WindowLabels:
    """Labels of the local voices of overlapping windows. Rows: ``w`` (window number), ``local``, ``label`` (of its print, or null), ``active``, ``continues`` (its local in the window before, or null).

    A voice without a print that is active has the label of the one it continues, if that has one; it is
    thus the first label of its chain. State: the labels of one window.
    """

    output: str = "w long, local long, label long"

    def start(self) -> dict[str, Any]:
        return {"w": None, "now": {}, "before": {}}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        w, local = int(row["w"]), int(row["local"])
        if s["w"] != w:
            s.update(before=s["now"] if s["w"] == w - 1 else {}, now={}, w=w)
        label = row["label"]
        label = None if label is None or label != label else int(label)
        on = row["continues"]
        if label is None and row["active"] and on is not None and on == on:
            label = s["before"].get(str(int(on)))
        s["now"][str(local)] = label
        return s, [(w, local, label)]

    def finish(self, s: dict) -> list[tuple]:
        return []


def window_labels(windows: DataFrame, key: list[str]) -> DataFrame:
    """Key, w, local, label: :class:`WindowLabels` over each key's windows in order. Of repeated (w, local) the last counts."""
    return fold(windows.select(*key, "w", "local", "label", "active", "continues"), key, ["w", "local"], WindowLabels())


def seeds(rows: DataFrame, known: DataFrame, key: list[str], ident: str, person: str = "person", vector: str = "embedding", weight: str = "weight") -> DataFrame:
    """Key, ident, person: prints that are unmistakably a known person's, of people with GUIDED_MS of such speech in the key.

    ``known`` has person, i and x, the people's centres; ``ident`` names a print over all keys. Weights below 0 count as 0.
    """
    strong = R.top_two(L.best_two(rows, known, ident, vector, person), [ident], person, "score").where("verdict = 'strong'")
    held = rows.select(*key, ident, F.greatest(F.col(weight), F.lit(0)).alias("_w")).join(strong.select(ident, person), ident)
    speech = held.groupBy(*key, person).agg(F.sum("_w").alias("_ms")).where(F.col("_ms") >= GUIDED_MS)
    return held.join(speech, [*key, person]).select(*key, ident, person)


def guided(rows: DataFrame, known: DataFrame, key: list[str], ident: str, person: str = "person", vector: str = "embedding", weight: str = "weight") -> DataFrame:
    """Key, ident, person, cluster: known people's prints make groups of their own, the others are clustered by themselves.

    A cluster whose centre is a person's by the ordinary bar and margin joins that person's group, if the
    key has one. ``person`` or ``cluster`` is null; groups of two people never meet. A key with
    nobody known is clustered as without. No prints, no rows.
    """
    fixed = seeds(rows, known, key, ident, person, vector, weight)
    rest = rows.join(fixed.select(ident), ident, "left_anti")
    free = L.cluster(rest.select(*key, ident, vector, weight), key, ident, vector, weight, count="auto")
    voice = F.sha2(F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in (*key, "cluster")]), 256)
    named = free.withColumn("_voice", voice)
    centres = R.centroids(named.join(rest.select(ident, vector), ident), ["_voice"], vector)
    centres = centres.groupBy("_voice").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("_v"))
    linked = R.top_two(L.best_two(centres, known, "_voice", "_v", person), ["_voice"], person, "score").where("verdict in ('strong', 'link')")
    groups = fixed.select(*key, person).distinct()
    taken = named.select(*key, "_voice").distinct().join(linked.select("_voice", person), "_voice").join(groups, [*key, person]).select("_voice", person)
    out = named.join(taken, "_voice", "left").select(*key, ident, person, F.when(F.col(person).isNull(), F.col("cluster")).alias("cluster"))
    return fixed.select(*key, ident, person, F.lit(None).cast("int").alias("cluster")).unionByName(out)


def stretches(line: tuple[int, int], turns: list[tuple[int, int, int]]) -> list[list[int]]:
    """[start, end, track] of each part of the line that a turn (track, start, end) holds, cut at all their ends.

    A contested part belongs to the owner of the part before, else to the first track.
    """
    edges = sorted({*line, *(x for _, a, b in turns for x in (a, b) if line[0] < x < line[1])})
    out: list[list[int]] = []
    for a, b in zip(edges, edges[1:]):
        of = {track for track, s, e in turns if s < b and a < e and s < e}
        if of:
            out.append([a, b, out[-1][2] if out and out[-1][2] in of else min(of)])
    return out


def _fused(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b, track in runs:
        if out and out[-1][2] == track:
            out[-1][1] = b
        else:
            out.append([a, b, track])
    return out


def tiled(parts: list[list[int]], line: tuple[int, int]) -> list[list[int]]:
    """Neighbouring parts of one track as one; the shortest below PIECE_MS go to the longer neighbour; together they cover the line."""
    runs = _fused(parts)
    while len(runs) > 1:
        size, at = min((b - a, i) for i, (a, b, _) in enumerate(runs))
        if size >= PIECE_MS:
            break
        beside = [i for i in (at - 1, at + 1) if 0 <= i < len(runs)]
        host = max(beside, key=lambda i: (runs[i][1] - runs[i][0], -i))
        runs[host][0], runs[host][1] = min(runs[host][0], runs[at][0]), max(runs[host][1], runs[at][1])
        runs = _fused(runs[:at] + runs[at + 1 :])
    if runs:
        runs[0][0], runs[-1][1] = line
    for one, two in zip(runs, runs[1:]):
        one[1] = two[0] = min(one[1], two[0])
    return [r for r in runs if r[1] > r[0]]


def cut_text(text: str, weights: list[int]) -> list[str] | None:
    """The text in pieces in proportion to ``weights``, each cut at the best boundary near its place; none where there is no honest one."""
    text = text.strip()
    size, total = len(text), sum(weights)
    if len(text.split()) < PIECE_WORDS * len(weights) or total <= 0:
        return None
    places: list[tuple[int, int]] = []  # (rank, characters before the cut)
    for i in range(1, size):
        if text[i - 1].isspace() and not text[i].isspace():
            mark = text[:i].rstrip().rstrip(CLOSING)[-1:]
            places.append((0 if mark and mark in SENTENCE else 1 if mark and mark in CLAUSE else 2, i))
    room, cuts, run = -int(-size * DRIFT // 1), [0], 0
    for w in weights[:-1]:
        run += w
        goal = int(run / total * size + 0.5)
        near = [(rank, abs(goal - i), i) for rank, i in places if i > cuts[-1] and abs(goal - i) <= room]
        if not near:
            return None
        cuts.append(min(near)[2])
    pieces = [text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], size])]
    return pieces if all(len(p.split()) >= PIECE_WORDS for p in pieces) else None


def split_line(line: tuple[int, int], text: str | None, sure: float | None, turns: list[tuple[int, int, int]], confidence: dict[int, float]) -> list[tuple[int, int, int, str]]:
    """(start, end, track, text) of the pieces of a line that two voices or more hold; empty if it stays whole."""
    size = line[1] - line[0]
    if size < LINE_MS or not (text or "").strip() or sure is not None and sure == sure and sure < TEXT_SURE:
        return []
    parts = stretches(line, turns)
    if sum(b - a for a, b, _ in parts) < COVERED * size:
        return []
    runs = tiled([list(p) for p in parts], line)
    held: dict[int, int] = {}
    for a, b, track in parts:
        held[track] = held.get(track, 0) + b - a
    voices = {r[2] for r in runs}
    if len(runs) < 2 or len(voices) < 2 or any(held[v] < max(PIECE_MS, SHARE * size) or confidence.get(v, 0.0) < TURN_SURE for v in voices):
        return []
    pieces = cut_text(text, [b - a for a, b, _ in runs])
    return [(*run, piece) for run, piece in zip(runs, pieces)] if pieces else []


PIECES = ArrayType(StructType([*[StructField(n, LongType()) for n in ("s", "e", "track")], StructField("text", StringType())]))


@F.pandas_udf(PIECES)
def _pieces(s: pd.Series, e: pd.Series, text: pd.Series, sure: pd.Series, turns: pd.Series) -> pd.Series:
    out = []
    for a, b, words, known, of in zip(s, e, text, sure, turns):
        of = [] if of is None else list(of)
        held = [(int(t["track"]), int(t["s"]), int(t["e"])) for t in of]
        found = split_line((int(a), int(b)), words, known, held, {int(t["track"]): t["confidence"] for t in of if t["confidence"] is not None})
        out.append([dict(zip(("s", "e", "track", "text"), p)) for p in found])
    return pd.Series(out)


def split_lines(lines: DataFrame, tracks: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Key, ident and ``pieces`` (s, e, track, text; none if the line stays whole) of each line (s, e, text, confidence) that turns overlap.

    ``tracks`` have a ``confidence`` each; a null counts as 0, a line's null as enough. Empty lines and turns are left out.
    """
    met = I.overlapping(lines.select(*key, ident, "s", "e"), tracks.select(*key, "track", "s", "e", "confidence"), key)
    turns = met.groupBy(*key, ident).agg(F.array_sort(F.collect_set(F.struct(F.col("track_b").alias("track"), F.col("s_b").alias("s"), F.col("e_b").alias("e"), F.col("confidence_b").alias("confidence")))).alias("turns"))
    return lines.join(turns, [*key, ident]).select(*key, ident, _pieces("s", "e", "text", "confidence", "turns").alias("pieces"))


def attributed(lines: DataFrame, tracks: DataFrame, key: list[str], ident: str, separated: str = "system", own: str | None = "mic") -> DataFrame:
    """A row for each line or piece of one: key, ident, piece (from 0), s, e, text, track, speaker.

    Lines of the ``separated`` channel that two voices hold are cut; others go whole to the track that shares most time with
    them, else to the nearest within REACH_MS, else to nobody. Lines of channel ``own`` are the user's ("self"). A track's
    speaker is its place among those of its key that own a line, from 1. Without tracks only the user has lines.
    """
    theirs = lines.where(F.col("channel") == separated)
    spans = tracks.select(*key, "track", "s", "e")
    most = I.most_overlap(theirs.select(*key, ident, "s", "e"), spans, key, [ident]).drop("shared_ms")
    near = I.nearest(theirs.select(*key, ident, "s", "e"), spans, key, [ident], REACH_MS).select(*key, ident, F.col("track").alias("_near"))
    cut = split_lines(theirs, tracks, key, ident).where(F.size("pieces") > 0)
    whole = F.array(F.struct(F.col("s"), F.col("e"), F.coalesce("track", "_near").alias("track"), F.col("text")))
    rows = theirs.select(*key, ident, F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "text").join(most.withColumn("track", F.col("track").cast("long")), [*key, ident], "left")
    rows = rows.join(near.withColumn("_near", F.col("_near").cast("long")), [*key, ident], "left").join(cut, [*key, ident], "left")
    rows = rows.select(*key, ident, F.posexplode(F.coalesce("pieces", whole.cast(PIECES))).alias("piece", "p")).select(*key, ident, "piece", "p.*")
    names = rows.where("track is not null").groupBy(*key, "track").agg(F.count("*").alias("_lines"))
    names = names.select(*key, "track", F.row_number().over(Window.partitionBy(*key).orderBy("track")).cast("string").alias("speaker"))
    out = rows.join(names, [*key, "track"], "left").select(*key, ident, "piece", "s", "e", "text", "track", "speaker")
    if own is None:
        return out
    mine = lines.where(F.col("channel") == own).select(*key, ident, F.lit(0).alias("piece"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "text", F.lit(None).cast("long").alias("track"), F.lit("self").alias("speaker"))
    return out.unionByName(mine)
