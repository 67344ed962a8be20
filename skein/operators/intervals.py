"""Algebra of half-open spans ``(s, e)`` in milliseconds, by key.

Every function takes tables with the key columns, ``s`` and ``e``. Joins on overlap go by key and time
bucket, each pair meeting in one bucket only, so a long key spreads over buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.fold import fold

#: Width of a time bucket of overlap joins.
BUCKET_MS = 6 * 3_600_000


def length(s: str | Column = "s", e: str | Column = "e") -> Column:
    """Milliseconds of a span, never negative."""
    s, e = (F.col(c) if isinstance(c, str) else c for c in (s, e))
    return F.greatest(e - s, F.lit(0).cast("long"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Milliseconds that two spans share."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0).cast("long"))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Milliseconds between two spans; 0 if they touch or overlap."""
    return F.greatest(F.greatest(s1, s2) - F.least(e1, e2), F.lit(0).cast("long"))


def merge(spans: DataFrame, key: list[str], max_gap: int = 0, points: bool = False) -> DataFrame:
    """Spans of a key fused where the next starts at most ``max_gap`` after the furthest end so far.

    Spans of no width count with ``points`` only.
    """
    order = Window.partitionBy(*key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("s") - reach > max_gap), 1).otherwise(0)
    islands = spans.where("e >= s" if points else "e > s").select(*key, "s", "e", opens.alias("_opens")).withColumn("_island", F.sum("_opens").over(order))
    return islands.groupBy(*key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def union(*tables: DataFrame, key: list[str], max_gap: int = 0, points: bool = False) -> DataFrame:
    """All spans of several tables, merged; those of no width too with ``points``."""
    rows = tables[0].select(*key, "s", "e")
    for other in tables[1:]:
        rows = rows.unionByName(other.select(*key, "s", "e"))
    return merge(rows, key, max_gap, points)


def overlapping(a: DataFrame, b: DataFrame, key: list[str], reach: int = 0, width: int = BUCKET_MS, points: bool = False) -> DataFrame:
    """Pairs of spans of a key that overlap (``reach`` 0) or lie at most ``reach`` apart.

    Columns of ``a`` as they are; those of ``b`` but the key with the suffix ``_b``. Null keys pair with nothing.
    Spans of no width pair with ``points`` only; without ``reach`` a point overlaps what it lies inside of.
    """
    real = "e >= s" if points else "e > s"
    first = F.floor((F.col("s") - reach) / width)
    one = a.where(real).withColumn("_low", first).withColumn("_bucket", F.explode(F.sequence(first, F.floor((F.col("e") + reach) / width))))
    two = b.where(real).select(*key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in key])
    low = F.floor(F.col("s_b") / width)
    two = two.withColumn("_low_b", low).withColumn("_bucket", F.explode(F.sequence(low, F.floor(F.col("e_b") / width))))
    pairs = one.join(two, [*key, "_bucket"]).where(F.col("_bucket") == F.greatest("_low", "_low_b"))
    near = (F.col("s_b") < F.col("e")) & (F.col("s") < F.col("e_b")) if not reach else (F.col("s_b") - F.col("e") <= reach) & (F.col("s") - F.col("e_b") <= reach)
    return pairs.where(near).drop("_bucket", "_low", "_low_b")


def subtract(spans: DataFrame, holes: DataFrame, key: list[str]) -> DataFrame:
    """What is left of each span without the holes of its key; empty pieces go. Other columns of ``spans`` stay."""
    own, span = spans.where("e > s"), [*key, "s", "e"]
    # equal spans have equal pieces, so a span is its key and bounds: row numbers differ from one reading of a shuffle to the next
    each = own.select(*span).distinct()
    cut = overlapping(each, merge(holes, key), key)
    ends = each.withColumns({"_to": F.col("e"), "_from": F.col("e")})
    marks = cut.select(*span, F.greatest("s", "s_b").alias("_to"), F.least("e", "e_b").alias("_from")).unionByName(ends)
    before = Window.partitionBy(*span).orderBy("_to", "_from").rowsBetween(Window.unboundedPreceding, -1)
    pieces = marks.select(*[F.col(c).alias(f"_of_{c}") for c in span], F.coalesce(F.max("_from").over(before), F.col("s")).alias("_s"), F.col("_to").alias("_e")).where("_e > _s")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in span])
    kept = [c for c in spans.columns if c not in ("s", "e")]
    return own.join(pieces, same).select(*kept, F.col("_s").alias("s"), F.col("_e").alias("e"))


def drop_short(spans: DataFrame, least: int) -> DataFrame:
    return spans.where(length() >= least)


def most_overlap(spans: DataFrame, tracks: DataFrame, key: list[str], ident: list[str], track: str = "track") -> DataFrame:
    """For each span the track that shares most time with it, first in order on ties; spans that no track touches are absent.

    A point inside a span shares 0 ms with it.
    """
    shared = overlapping(spans, tracks, key, points=True).groupBy(*key, *ident, F.col(f"{track}_b").alias(track))
    shared = shared.agg(F.sum(overlap(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b"))).alias("shared_ms"))
    best = F.min(F.struct((-F.col("shared_ms")).alias("n"), F.col(track).alias("t")))
    return shared.groupBy(*key, *ident).agg(best.alias("_best")).select(*key, *ident, F.col("_best.t").alias(track), (-F.col("_best.n")).alias("shared_ms"))


def nearest(spans: DataFrame, tracks: DataFrame, key: list[str], ident: list[str], tolerance: int = 400, track: str = "track") -> DataFrame:
    """For each span, or point, the track nearest in time, either side, within ``tolerance``; first in order on ties."""
    pairs = overlapping(spans, tracks, key, reach=tolerance, points=True)
    best = F.min(F.struct(gap(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b")).alias("gap_ms"), F.col(f"{track}_b").alias("t")))
    return pairs.groupBy(*key, *ident).agg(best.alias("_best")).select(*key, *ident, F.col("_best.t").alias(track), "_best.gap_ms")


def untouched(spans: DataFrame, others: DataFrame, key: list[str], max_gap: int = 1000) -> DataFrame:
    """Spans merged over gaps under ``max_gap`` that no other span of the key overlaps, nor a point inside."""
    merged, span = merge(spans, key, max_gap - 1), [*key, "s", "e"]
    hit = overlapping(merged, others.select(*span), key, points=True).select(*span).distinct()
    return merged.join(hit, span, "left_anti")


def covered(spans: DataFrame, weighted: DataFrame, key: list[str], ident: list[str], weight: str = "weight") -> DataFrame:
    """For each span the time of the weighted spans inside it times their weight, rounded, at most its length; 0 for a point inside one."""
    pairs = overlapping(spans, weighted, key, points=True)
    part = overlap(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b")) * F.col(f"{weight}_b")
    total = pairs.groupBy(*key, *ident, "s", "e").agg(F.round(F.sum(part)).cast("long").alias("_ms"))
    return total.select(*key, *ident, F.least("_ms", length()).alias("covered_ms"))


def shared_time(spans: DataFrame, key: list[str], track: str = "track") -> DataFrame:
    """For each pair of tracks of a key, the milliseconds that both hold; each track merged first."""
    own = merge(spans, [*key, track])
    pairs = overlapping(own, own, key).where(F.col(track) < F.col(f"{track}_b"))
    return pairs.groupBy(*key, track, f"{track}_b").agg(F.sum(overlap(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b"))).alias("shared_ms"))


def elementary(spans: DataFrame, key: list[str], track: str = "track") -> DataFrame:
    """The key's time cut at every boundary, each part with its owner.

    The owner is the sole claimant; of a contested part the owner before, or the first claimant if there
    was none. Time that nobody claims is absent.
    """
    points = spans.select(*key, F.col("s").alias("p")).union(spans.select(*key, F.col("e"))).distinct()
    following = F.lead("p").over(Window.partitionBy(*key).orderBy("p"))
    parts = points.select(*key, F.col("p").alias("s"), following.alias("e")).where("e is not null")
    claims = overlapping(parts, spans, key).groupBy(*key, "s", "e").agg(F.countDistinct(f"{track}_b").alias("claimants"), F.min(f"{track}_b").alias("_first"))
    sole = F.when(F.col("claimants") == 1, F.col("_first"))
    before = F.last(sole, ignorenulls=True).over(Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    return claims.withColumn("owner", F.coalesce(sole, before, F.col("_first"))).drop("_first")


def collapse_runs(parts: DataFrame, key: list[str], least: int = 1500, owner: str = "owner") -> DataFrame:
    """Neighbours of one owner fused; parts under ``least`` join the longer neighbour, the earlier on ties. No gaps stay.

    Parts come in order of their key; a task holds the runs of one key.
    """
    kind, width = parts.select(*key, "s", "e", owner).schema, len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, runs = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for now, s, e, name in zip(zip(*columns[:width]), *columns[width:]):
                if now != held:
                    out += [(*held, *r) for r in _collapsed(runs, least)] if runs else []
                    held, runs = now, []
                if runs and runs[-1][2] == name:
                    runs[-1][1] = e
                else:
                    runs.append([s, e, name])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), batch.schema.types)], names=kind.names)
            types = batch.schema.types
        if runs:
            out = [(*held, *r) for r in _collapsed(runs, least)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=kind.names)

    return parts.select(*kind.names).repartition(*key).sortWithinPartitions(*key, "s").mapInArrow(run, kind)


def _collapsed(runs: list[list], least: int) -> list[list]:
    """``runs`` (s, e, owner; in order, no neighbours alike) without those under ``least``, shortest and earliest first.

    Runs that join stay at the place of the earlier one, so places keep the order; the heap may hold runs as they were.
    """
    if len(runs) > 1:
        last = len(runs) - 1
        before, after, alive = list(range(-1, last)), [*range(1, last + 1), -1], [True] * (last + 1)
        heap = [(e - s, i) for i, (s, e, _) in enumerate(runs) if e - s < least]
        heapify(heap)

        def fuse(i: int, j: int, name: object) -> None:
            """Run ``j`` goes into ``i``, the one before it."""
            runs[i], alive[j] = [runs[i][0], runs[j][1], name], False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i

        while heap:
            size, i = heappop(heap)
            if not alive[i] or runs[i][1] - runs[i][0] != size:
                continue
            left, right = before[i], after[i]
            if left < 0 and right < 0:
                break
            if right < 0 or left >= 0 and runs[left][1] - runs[left][0] >= runs[right][1] - runs[right][0]:
                fuse(left, i, runs[left][2])
                i = left
            else:
                fuse(i, right, runs[right][2])
            for one, other in ((i, after[i]), (before[i], i)):
                if one >= 0 and other >= 0 and runs[one][2] == runs[other][2]:
                    fuse(one, other, runs[one][2])
                    i = one
            if runs[i][1] - runs[i][0] < least:
                heappush(heap, (runs[i][1] - runs[i][0], i))
        runs = [r for r, stays in zip(runs, alive) if stays]
    for one, other in zip(runs, runs[1:]):
        one[1] = other[0]
    return runs


def holes(audio: DataFrame, read: DataFrame, suppressed: DataFrame, key: list[str], floor: int, limit: int, least: int = 250) -> DataFrame:
    """Stretches of recorded audio within [floor, limit] that were neither read nor suppressed, of ``least`` ms or more."""
    inside = clip(merge(audio, key), floor, limit)
    return drop_short(subtract(inside, union(read, suppressed, key=key), key), least)


def clip(spans: DataFrame, floor: int, limit: int) -> DataFrame:
    return spans.withColumns({"s": F.greatest("s", F.lit(floor)), "e": F.least("e", F.lit(limit))}).where("e > s")


def tidy(lines: DataFrame, floor: int, limit: int, least: int = 200) -> DataFrame:
    """Lines inside a window: clamped, rows of no width given ``least``, and what is shorter than that dropped."""
    inside = lines.withColumns({"s": F.least(F.greatest("s", F.lit(floor)), F.lit(limit)), "e": F.least(F.greatest("e", F.lit(floor)), F.lit(limit))})
    whole = F.when(F.col("e") <= F.col("s"), F.least(F.col("s") + least, F.lit(limit))).otherwise(F.col("e"))
    return inside.withColumn("e", whole).where(F.col("e") - F.col("s") >= least)


def packs(spans: DataFrame, key: list[str], longest: int = 28_000) -> DataFrame:
    """Spans of a key in order, gathered into packs: a pack stays open while it would span at most ``longest``."""
    return fold(spans.select(*key, "s", "e"), key, ["s", "e"], Packs(longest))


class Packs:
    """Numbers spans that come in order by pack; holds the number and start of the open one."""

    output = "s long, e long, pack long"

    def __init__(self, longest: int):
        self.longest = longest

    def start(self) -> list:
        return [-1, None]

    def step(self, state: list, row: dict) -> tuple[list, list[tuple]]:
        number, opened = state
        if opened is None or row["e"] - opened > self.longest:
            number, opened = number + 1, int(row["s"])
        return [number, opened], [(row["s"], row["e"], number)]

    def finish(self, state: list) -> list[tuple]:
        return []


def alone(spans: DataFrame, key: list[str], track: str = "track", least: int = 1000) -> DataFrame:
    """For each track the time in which it holds no other's span, if ``least`` or more."""
    own = merge(spans, [*key, track])
    pairs = overlapping(own, own, key).where(F.col(track) != F.col(f"{track}_b"))
    inside = pairs.select(*key, track, F.greatest("s", "s_b").alias("s"), F.least("e", "e_b").alias("e"))
    left = subtract(own, inside, [*key, track])
    return left.groupBy(*key, track).agg(F.sum(length()).alias("alone_ms")).where(F.col("alone_ms") >= least)


def placed(segments: DataFrame, busy: DataFrame, key: list[str], ident: list[str], length_ms: int = 6_000, step: int = 250) -> DataFrame:
    """For each segment the window of ``length_ms`` inside it that shares least time with others' spans: window_s, window_e.

    Windows lie ``step`` apart; ties go to the one nearest the segment's middle, then the earlier. A
    shorter segment is its own window.
    """
    last = F.greatest(F.col("e") - length_ms, F.col("s"))
    tries = segments.where("e > s").withColumn("window_s", F.explode(F.sequence(F.col("s"), last, F.lit(step).cast("long"))))
    tries = tries.withColumn("window_e", F.least(F.col("window_s") + length_ms, F.col("e")))
    shift = F.abs(F.col("window_s") + F.col("window_e") - F.col("s") - F.col("e"))
    tries = tries.select(*key, *ident, shift.alias("shift"), F.col("window_s").alias("s"), F.col("window_e").alias("e"))
    hit = overlapping(tries, merge(busy, key), key).groupBy(*key, *ident, "s").agg(F.sum(overlap(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b"))).alias("ms"))
    scored = tries.join(hit, [*key, *ident, "s"], "left").withColumn("ms", F.coalesce("ms", F.lit(0)))
    best = F.min(F.struct("ms", "shift", "s", "e")).alias("b")
    return scored.groupBy(*key, *ident).agg(best).select(*key, *ident, F.col("b.s").alias("window_s"), F.col("b.e").alias("window_e"))
