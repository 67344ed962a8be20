"""Vectors of voices: similarity, search in blocks of queries, clustering of one meeting's voices, curation of a person's samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Bytes of a block of queries that goes to all tasks.
BLOCK_BYTES = 32 << 20


def normalise(vector: str | Column) -> Column:
    """The unit vector; one of no length stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: str | Column, b: str | Column) -> Column:
    """The inner product; -1 for vectors of different lengths."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(-1.0))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 less the inner product of unit vectors, within 0 and 2."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, room: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine, itself left out: query, key, similarity and rank.

    Of rows equally near the smaller key ranks first. Rows and queries without a vector or key are
    left out. Queries go out in blocks of a stated size; each task keeps ``k`` rows a query, and
    those meet by query.
    """
    rows, queries = (x.where(F.col(key).isNotNull() & F.col(vector).isNotNull()) for x in (rows, queries))
    spark, name = rows.sparkSession, rows.schema[key]
    kind = StructType([StructField("query", name.dataType), StructField(key, name.dataType), StructField("similarity", DoubleType())])
    width = queries.agg(F.max(F.size(vector))).first()[0] or 1
    number = max(1, -(-queries.count() * width * 8 // room))
    found = None
    for b in range(number):
        block = queries.where(F.pmod(F.xxhash64(key), F.lit(number)) == b).select(key, vector).toPandas()
        matrix = np.array([np.asarray(v, "f8") for v in block[vector]]).reshape(len(block), -1)
        shared = spark.sparkContext.broadcast((block[key].to_numpy(), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)))

        def run(frames, shared=shared):
            names, goal = shared.value
            best: list[pd.DataFrame] = []
            for frame in frames:
                frame = frame.sort_values(key)  # ties then go by key, as the sort below is stable
                own = np.array([np.asarray(v, "f8") for v in frame[vector]]).reshape(len(frame), -1)
                if not len(own) or not len(goal):
                    continue
                score = goal @ (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).T
                keys = frame[key].to_numpy()
                score[names[:, None] == keys[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                part = pd.DataFrame({"query": np.repeat(names, top.shape[1]), key: keys[top].ravel(), "similarity": np.take_along_axis(score, top, 1).ravel()})
                best = [pd.concat([*best, part[part["similarity"] > -np.inf]]).sort_values(["similarity", key], ascending=[False, True]).groupby("query").head(k)]
            yield from best

        part = rows.select(key, vector).mapInPandas(run, kind)
        found = part if found is None else found.unionByName(part)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("n"), key))), 1, k)
    ranked = found.groupBy("query").agg(top.alias("_top")).select("query", F.posexplode("_top").alias("rank", "_r"))
    return ranked.select("query", F.col(f"_r.{key}").alias(key), (-F.col("_r.n")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def best_two(rows: DataFrame, centres: DataFrame, key: str, vector: str, label: str, digits: int = 6, room: int = BLOCK_BYTES) -> DataFrame:
    """(key, label, score): for each row the two centres (label, i, x) of the highest cosine, rounded, the first label of equal ones; two for each block of centres.

    Centres go out in blocks of a stated size, usually one; the rows stay where they are. Rows without vector or of another length have no score.
    """
    spark = rows.sparkSession
    whole = centres.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("v"))
    width = whole.agg(F.max(F.size("v"))).first()[0] or 1
    number = max(1, -(-whole.count() * width * 8 // room))
    kind = StructType([rows.schema[key], whole.schema[label], StructField("score", DoubleType())])
    found = None
    for b in range(number):
        block = whole.where(F.pmod(F.xxhash64(label), F.lit(number)) == b).where(F.size("v") == width).toPandas().sort_values(label)
        shared = spark.sparkContext.broadcast((block[label].to_numpy(), np.array(block["v"].tolist(), "f8").reshape(-1, width)))

        def run(frames, shared=shared):
            names, goal = shared.value
            for frame in frames:
                frame = frame[[v is not None and len(v) == width for v in frame[vector]]]
                if not len(frame) or not len(goal):
                    continue
                score = np.round(_unit(np.array([np.asarray(v, "f8") for v in frame[vector]])) @ goal.T, digits)
                top = np.argsort(-score, axis=1, kind="stable")[:, :2]
                yield pd.DataFrame({key: np.repeat(frame[key].to_numpy(), top.shape[1]), label: names[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})

        part = rows.select(key, vector).mapInPandas(run, kind)
        found = part if found is None else found.unionByName(part)
    return found


def silhouette(rows: DataFrame, key: list[str], label: str = "label", vector: str = "embedding", weight: str = "weight") -> DataFrame:
    """Each key's weighted centroid silhouette: own centroid without the row against the nearest other; a row alone scores 0."""
    from pyspark.sql import Window

    parts = rows.withColumn("_id", F.monotonically_increasing_id()).select(*key, label, weight, "_id", F.posexplode(normalise(vector)).alias("i", "x"))
    sums = parts.groupBy(*key, label, "i").agg(F.sum(F.col("x") * F.col(weight)).alias("t"))
    centres = sums.groupBy(*key, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda p: p.t).alias("centre"))
    sizes = rows.groupBy(*key, label).agg(F.count("*").alias("members"))
    centres = centres.join(sizes, [*key, label]).select(*key, F.col(label).alias("_l"), "centre", "members")
    own = rows.withColumns({"_id": F.monotonically_increasing_id(), "_v": normalise(vector)}).join(centres, key)
    less = F.zip_with("centre", "_v", lambda c, x: c - x * F.col(weight))
    distance = cosine_distance(F.col("_v"), normalise(F.when(F.col(label) == F.col("_l"), less).otherwise(F.col("centre"))))
    scored = own.groupBy(*key, "_id", label, weight).agg(
        F.max(F.when(F.col(label) == F.col("_l"), distance)).alias("a"), F.min(F.when(F.col(label) != F.col("_l"), distance)).alias("b"), F.max(F.when(F.col(label) == F.col("_l"), F.col("members"))).alias("members"),
    )
    score = F.when((F.col("members") == 1) | F.col("b").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return scored.groupBy(*key).agg((F.sum(score * F.col(weight)) / F.sum(weight)).alias("silhouette"))


#: The distance at which voices part, the most speakers of a meeting, and cuts that are tried for each.
THRESHOLD, SPEAKERS, CUTS = 0.58, 12, 3
#: Voices above which they are pooled first, at this part of the threshold.
POOL_ABOVE, POOL_PART = 600, 3
#: What is less than a speaker (by share of the speech, within bounds), and the spread of one that is spared.
FRAGMENT_SHARE, FRAGMENT_LEAST_MS, FRAGMENT_MOST_MS, COHERENT = 0.01, 3_000, 30_000, 0.35
#: The least gap between two speakers (a softer one where nothing fits), the distance at which none are fused, margins between counts.
SPLIT, SOFT_SPLIT, FUSE, MARGIN, TIE = 0.50, 0.42, 0.75, 0.05, 0.01


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Voices:
    """One meeting's voices: unit vectors and their milliseconds of speech."""

    vectors: np.ndarray
    ms: np.ndarray

    @classmethod
    def of(cls, vectors: list, ms: list) -> Voices:
        return cls(_unit(np.array([np.asarray(v, "f8") for v in vectors])), np.asarray(ms, "i8"))

    def __post_init__(self):
        self.weight = np.maximum(self.ms, 1).astype("f8")
        self.pooled = len(self.vectors) > POOL_ABOVE

    def sums(self, labels: np.ndarray) -> np.ndarray:
        out = np.zeros((labels.max() + 1, self.vectors.shape[1]))
        np.add.at(out, labels, self.vectors * self.weight[:, None])
        return out

    def mass(self, labels: np.ndarray) -> np.ndarray:
        return np.bincount(labels, np.maximum(self.ms, 0), labels.max() + 1)

    def leaves(self, threshold: float = THRESHOLD) -> np.ndarray:
        """A label for each voice by itself, or for pools, whose centres move as voices join the nearest one."""
        if not self.pooled:
            return np.arange(len(self.vectors))
        sums, centres, pool = np.zeros_like(self.vectors), np.zeros_like(self.vectors), np.zeros(len(self.vectors), int)
        number = 0
        for i, v in enumerate(self.vectors):
            far = 1 - centres[:number] @ v
            at = int(far.argmin()) if number else 0
            if not number or far[at] >= threshold / POOL_PART:
                at, number = number, number + 1
            pool[i] = at
            sums[at] += v * self.weight[i]
            centres[at] = _unit(sums[at])
        return pool

    def merges(self, labels: np.ndarray) -> list[tuple[int, int, float]]:
        """By centroid linkage down to one group: (kept, merged, distance), the nearest pair first, the first in order on ties."""
        sums, out = self.sums(labels), []
        centres = _unit(sums)
        far = 1 - centres @ centres.T
        np.fill_diagonal(far, np.inf)
        alive = np.ones(len(sums), bool)
        for _ in range(len(sums) - 1):
            i, j = sorted(divmod(int(far.argmin()), len(sums)))
            out.append((i, j, float(far[i, j])))
            sums[i] += sums[j]
            alive[j] = False
            centres[i] = _unit(sums[i])
            row = np.where(alive, 1 - centres @ centres[i], np.inf)
            row[i] = np.inf
            far[j, :] = far[:, j] = np.inf
            far[i, :] = far[:, i] = row
        return out

    def after(self, labels: np.ndarray, merges: list[tuple[int, int, float]]) -> np.ndarray:
        """``labels`` after these merges, numbered by first voice."""
        into = np.arange(labels.max() + 1)
        for i, j, _ in reversed(merges):  # what a group goes into later is known by then
            into[j] = into[i]
        return _numbered(into[labels])

    def absorbed(self, labels: np.ndarray, least_ms: float) -> np.ndarray:
        """Groups under ``least_ms`` go to the nearest one, the smallest first; a coherent voice of some length is spared above the least bar."""
        sparing = least_ms > FRAGMENT_LEAST_MS and not self.pooled
        while labels.max() > 0:
            mass, centres = self.mass(labels), _unit(self.sums(labels))
            spread = np.bincount(labels, 1 - (self.vectors * centres[labels]).sum(axis=1)) / np.bincount(labels)
            small = (mass < least_ms) & ~(sparing & (mass >= FRAGMENT_LEAST_MS) & (spread <= COHERENT))
            if not small.any():
                break
            gone = int(np.where(small, mass, np.inf).argmin())
            far = 1 - centres @ centres[gone]
            far[gone] = np.inf
            labels = _numbered(np.where(labels == gone, int(far.argmin()), labels))
        return labels

    def gap(self, labels: np.ndarray) -> float:
        """The distance of the nearest two groups; 0 for one."""
        centres = _unit(self.sums(labels))
        far = 1 - centres @ centres.T + np.eye(len(centres)) * 4
        return float(far.min()) if len(centres) > 1 else 0.0

    def silhouette(self, labels: np.ndarray) -> float:
        """Weighted by speech: own centre without the voice against the nearest other; a voice alone scores 0."""
        sums = self.sums(labels)
        if len(sums) < 2:
            return 0.0
        far = np.clip(1 - self.vectors @ _unit(sums).T, 0, 2)
        rows = np.arange(len(labels))
        alone = np.bincount(labels)[labels] == 1
        own = np.clip(1 - (self.vectors * _unit(sums[labels] - self.vectors * self.weight[:, None])).sum(axis=1), 0, 2)
        far[rows, labels] = np.inf
        other = far.min(axis=1)
        score = np.where(alone | (np.maximum(own, other) <= 0), 0.0, (other - own) / np.maximum(np.maximum(own, other), 1e-12))
        return float((score * self.weight).sum() / self.weight.sum())

    def cut(self, threshold: float = THRESHOLD, most: int = SPEAKERS) -> np.ndarray:
        """Merged while two groups are nearer than ``threshold`` or there are too many; then fragments go."""
        labels = self.leaves(threshold)
        merges, left = self.merges(labels), labels.max() + 1
        number = 0
        while number < len(merges) and (merges[number][2] < threshold or left - number > most):
            number += 1
        return self.absorbed(self.after(labels, merges[:number]), FRAGMENT_LEAST_MS)

    def tried(self, least_ms: float):
        """(merges taken, labels) for each cut down to one group, fragments gone."""
        labels = self.leaves()
        merges = self.merges(labels)
        for keep in range(1, min(SPEAKERS * CUTS, len(merges) + 1) + 1):
            number = len(merges) + 1 - keep
            yield merges, number, self.absorbed(self.after(labels, merges[:number]), least_ms)

    def fixed(self, count: int) -> np.ndarray:
        """As near to ``count`` groups as a cut comes without more; of those the one of the best silhouette."""
        asked = min(max(count, 1), SPEAKERS)
        found = [(labels.max() + 1, self.silhouette(labels), -k, labels) for k, (_, _, labels) in enumerate(self.tried(FRAGMENT_LEAST_MS)) if labels.max() < asked]
        return max(found, key=lambda x: x[:3])[3]

    def automatic(self) -> np.ndarray:
        """The cut whose count of speakers fits best: see :func:`choose`."""
        bar = min(max(int(self.ms.clip(0).sum() * FRAGMENT_SHARE), FRAGMENT_LEAST_MS), FRAGMENT_MOST_MS)
        best: dict[int, dict] = {}
        forced = None
        for merges, number, labels in self.tried(bar):
            forced = self._forced(merges, bar) if forced is None else forced
            count, keep, gap = int(labels.max()) + 1, len(merges) + 1 - number, self.gap(labels)
            why = "many" if count > SPEAKERS else "one voice" if count > 1 and gap < SPLIT else "fused" if keep < forced and count < SPEAKERS else None
            near = max(merges[number - 1][2] - THRESHOLD if number else 0.0, THRESHOLD - merges[number][2] if number < len(merges) else 0.0, 0.0)
            row = {"count": count, "silhouette": self.silhouette(labels), "gap": gap, "refused": why, "off": near, "labels": labels}
            held = best.get(count)
            if held is None or (row["refused"] is None, row["silhouette"]) > (held["refused"] is None, held["silhouette"]):
                best[count] = row
        return choose([best[c] for c in sorted(best)])["labels"]

    def _forced(self, merges: list[tuple[int, int, float]], bar: float) -> int:
        """Groups that must be left so that no two speakers are fused across too large a distance."""
        mass = self.mass(self.leaves())
        for n, (i, j, d) in enumerate(merges):
            if d >= FUSE and mass[i] >= bar and mass[j] >= bar:
                return len(merges) + 1 - n
            mass[i] += mass[j]
        return 0


def choose(rows: list[dict]) -> dict:
    """Of cuts by count: the best silhouette of those not refused; near ties by how near the cut is to the usual distance, then by more speakers.

    Where even the best is below 0, a cut refused for its gap alone may stand if it is clearly better.
    """
    allowed = [r for r in rows if r["refused"] is None]
    top = max((r["silhouette"] for r in allowed), default=0.0)
    if allowed and top < 0:
        better = [r for r in rows if r["refused"] == "one voice" and r["gap"] >= SOFT_SPLIT and r["silhouette"] >= top + MARGIN]
        if better:
            return max(better, key=lambda r: r["silhouette"])
    ranked = allowed or rows
    top = max(r["silhouette"] for r in ranked)
    return min((r for r in ranked if top - r["silhouette"] < TIE), key=lambda r: (r["off"], -r["count"]))


def _numbered(labels: np.ndarray) -> np.ndarray:
    """Labels numbered by first appearance."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


#: Voices of one meeting, at most: a meeting is one group, and its distances a square.
MEETING = 5_000


def cluster(rows: DataFrame, key: list[str], ident: str, vector: str = "embedding", weight: str = "weight", threshold: float = THRESHOLD, most: int = SPEAKERS, count: str | int | None = None) -> DataFrame:
    """``cluster`` of each row within its key: by the threshold, by the best count ("auto") or by a given one.

    A key is one meeting, whose voices one task holds; more than MEETING of them are refused, not cut.
    Vectors of different lengths cannot be compared: all are one speaker then.
    """
    kind = StructType([*[rows.schema[k] for k in (*key, ident)], StructField("cluster", IntegerType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MEETING:
            raise ValueError(f"a meeting of {len(frame)} voices; at most {MEETING}")
        frame = frame.sort_values(ident, ignore_index=True)
        if len({len(v) for v in frame[vector]}) > 1:
            return frame.assign(cluster=0)[kind.names]
        voices = Voices.of(frame[vector], frame[weight])
        labels = voices.cut(threshold, most) if count is None else voices.automatic() if count == "auto" else voices.fixed(count)
        return frame.assign(cluster=_numbered(labels))[kind.names]

    return rows.groupBy(*key).applyInPandas(run, kind)


def outliers(rows: DataFrame, key: list[str], ident: str, vector: str = "embedding", least: int = 8, below: float = 0.25, bar: float = 0.64) -> DataFrame:
    """Samples of a person that don't belong: the worst by likeness to the others' centroid goes while it is far below their median.

    A person keeps few samples, which one task holds; more than MEETING are refused.
    """
    kind = rows.select(*key, ident).schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MEETING:
            raise ValueError(f"a person of {len(frame)} samples; at most {MEETING}")
        frame = frame.sort_values(ident, ignore_index=True)
        v = np.array([np.asarray(x, "f8") for x in frame[vector]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        left, gone = list(range(len(v))), []
        while len(left) >= least:
            total = v[left].sum(axis=0)
            rest = total - v[left]
            like = (rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12) * v[left]).sum(axis=1)
            worst = int(like.argmin())
            if like[worst] >= np.median(like) - below or like[worst] >= bar:
                break
            gone.append(left.pop(worst))
        return frame.iloc[sorted(gone)][kind.names]

    return rows.groupBy(*key).applyInPandas(run, kind)


#: Samples that a person keeps, the distance that counts as wholly different, and the weights of difference and recency.
KEEP, DIFFERENT, BY_SPREAD, BY_RECENCY = 24, 0.50, 0.6, 0.4


def evicted(vectors: np.ndarray, age: np.ndarray, condition: np.ndarray, keep: int = KEEP) -> list[int]:
    """Places of the samples to give up, in order, until ``keep`` are left: those nearest to another and oldest first.

    The last sample of a condition stays while there are others; of equal scores the older goes, then the first.
    """
    v, live, gone = _unit(vectors), list(range(len(vectors))), []
    oldest = max(int(age.max(initial=0)), 1)
    far = 1 - v @ v.T
    np.fill_diagonal(far, np.inf)
    while len(live) > keep:
        at = np.array(live)
        near = far[np.ix_(at, at)].min(axis=1)
        spread = np.where(np.isfinite(near), np.clip(near / DIFFERENT, 0, 1), 1.0)
        score = BY_SPREAD * spread + BY_RECENCY * (1 - np.clip(age[at] / oldest, 0, 1))
        kinds, inverse, number = np.unique(condition[at], return_inverse=True, return_counts=True)
        free = (number[inverse] > 1) | (len(kinds) == 1)
        if not free.any():
            break
        worst = min(np.flatnonzero(free), key=lambda k: (score[k], -age[at[k]], k))
        gone.append(live.pop(int(worst)))
    return gone


def evictions(rows: DataFrame, key: list[str], ident: str, age: str, condition: str, vector: str = "embedding", keep: int = KEEP) -> DataFrame:
    """The samples of each key that go, with ``turn``, the order in which they do. A person keeps few samples, which one task holds; more than MEETING are refused."""
    kind = StructType([*[rows.schema[k] for k in (*key, ident)], StructField("turn", IntegerType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MEETING:
            raise ValueError(f"a person of {len(frame)} samples; at most {MEETING}")
        frame = frame.sort_values(ident, ignore_index=True)
        gone = evicted(np.array([np.asarray(x, "f8") for x in frame[vector]]), frame[age].to_numpy("i8"), frame[condition].to_numpy(), keep)
        return frame.iloc[gone].assign(turn=range(1, len(gone) + 1))[kind.names]

    return rows.groupBy(*key).applyInPandas(run, kind)


def assignment(shared: np.ndarray) -> list[int | None]:
    """For each row the column that makes the total shared time largest, each column once; nothing shared is never matched.

    Shortest augmenting paths over reduced costs, so cubic in the number of tracks; of equal totals, any.
    """
    rows, columns = shared.shape
    if not rows or not columns:
        return [None] * rows
    # a spare column of no cost for each row, so that a row may stay alone
    cost = np.hstack([-np.maximum(shared, 0).astype("f8"), np.zeros((rows, rows))])
    width = columns + rows
    u, v, owner = np.zeros(rows), np.zeros(width), np.full(width, -1)
    for row in range(rows):
        best, before, done = np.full(width, np.inf), np.full(width, -1), np.zeros(width, bool)
        at, column = row, -1
        while True:
            slack = cost[at] - u[at] - v
            closer = ~done & (slack < best)
            best[closer], before[closer] = slack[closer], column
            column_next = int(np.where(done, np.inf, best).argmin())
            step = best[column_next]
            u[row] += step
            u[owner[done]] += step
            v[done] -= step
            best[~done] -= step
            done[column_next], column = True, column_next
            if owner[column] < 0:
                break
            at = owner[column]
        while column >= 0:
            previous = before[column]
            owner[column] = row if previous < 0 else owner[previous]
            column = previous
    picks: list[int | None] = [None] * rows
    for j in range(columns):
        if owner[j] >= 0 and shared[owner[j], j] > 0:
            picks[owner[j]] = j
    return picks


def matched(shared: DataFrame, key: list[str], row: str, column: str, value: str) -> DataFrame:
    """``row`` and ``column`` of the best assignment of each key, from a table of shared times."""
    kind = shared.select(*key, row, column).schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index=row, columns=column, values=value, aggfunc="sum", fill_value=0).sort_index()
        picks = assignment(table.to_numpy())
        pairs = [(table.index[i], table.columns[j]) for i, j in enumerate(picks) if j is not None]
        out = pd.DataFrame(pairs, columns=[row, column])
        return out.assign(**{k: frame[k].iloc[0] for k in key})[kind.names]

    return shared.groupBy(*key).applyInPandas(run, kind)
