"""Voices over meetings: prints grouped one after another, and people who learn, merge and forget samples.

Greedy grouping depends on order, so it goes by blocks of prints in order. A block is scored against all
groups where they lie; what could take one of its prints comes to one task, which walks the block in order with
the groups that move under way. Groups that move are written beside what they were, and only the latest of
each counts; of their meetings those stay that go on after the block. So no task holds more than a block and the
groups near it, and a lost executor costs a block. Where few voices are alike all pairs are scored: the
work is quadratic, spread over tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from . import read_models as R
from . import vectors as L

#: Likeness that links two voices, and meetings of a group that is worth a name.
LINK, APPEARANCES = 0.64, 3
#: Prints of a block, about, and bytes of their vectors.
BLOCK, BYTES = 16_000, 16 << 20
#: Digits of a score, and how far a score by short numbers may lie below the bar.
DIGITS, MARGIN = 9, 1e-3


def _folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder; only on a local master without one a temporary folder is used. It goes when the session ends."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context._jsc.sc().getCheckpointDir().get()}/skein-{uuid.uuid4().hex}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return files.makeQualified(path).toString()


def _written(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from a folder."""
    path = f"{_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Changed:
    """The groups of a block whose centre is no longer that of one print, by length of vector, scored at once."""

    def __init__(self) -> None:
        self.of: dict[int, list] = {}
        self.at: dict[int, int] = {}

    def put(self, g: int, total: np.ndarray) -> None:
        names, rows = self.of.setdefault(len(total), [[], np.empty((16, len(total)))])
        if g not in self.at:
            self.at[g] = len(names)
            names.append(g)
            if len(names) > len(rows):
                rows = self.of[len(total)][1] = np.concatenate([rows, np.empty_like(rows)])
        rows[self.at[g]] = total / max(np.linalg.norm(total), 1e-12)

    def like(self, v: np.ndarray, bar: float) -> list[tuple[float, int]]:
        names, rows = self.of.get(len(v), ([], None))
        if not names:
            return []
        scores = np.round(rows[: len(names)] @ v / max(np.linalg.norm(v), 1e-12), DIGITS)
        return [(-float(scores[k]), names[k]) for k in np.flatnonzero(scores >= bar)]


def walk(prints: list[tuple[object, np.ndarray]], alike: list[list[tuple[int, float]]], hits: list[list[tuple[int, float]]], groups: dict[int, tuple[np.ndarray, set]], following: int, bar: float) -> tuple[list[int], dict[int, tuple[np.ndarray, set]]]:
    """The group of each print (meeting, vector) in order, and the groups that changed or are new, numbered from ``following`` on.

    ``hits`` are each print's groups above the bar as they were before, ``alike`` its earlier prints above it: the centre
    of a new group is its print's vector. Those that change are scored anew.
    """
    moved: dict[int, tuple[np.ndarray, set]] = {}
    alone: dict[int, int] = {}  # print to the new group that has no other
    first: dict[int, int] = {}
    changed, out = _Changed(), []
    for i, ((meeting, v), near, of) in enumerate(zip(prints, alike, hits)):
        best = [(-score, g) for g, score in of if g not in moved]
        best += [(-score, alone[j]) for j, score in near if j in alone and prints[j][0] != meeting]
        best += [(score, g) for score, g in changed.like(v, bar) if meeting not in moved[g][1]]
        if best:
            g = min(best)[1]
            total, met = moved.get(g) or groups[g]
            moved[g] = (total + v, met | {meeting})
            changed.put(g, total + v)
            alone.pop(first.get(g, -1), None)
        else:
            g = following
            following += 1
            moved[g], alone[i], first[g] = (v, {meeting}), g, i
        out.append(g)
    return out, moved


class _Block:
    """Prints of a block by length of vector, and what is like them: sought by short numbers, then held to the bar by exact ones."""

    def __init__(self, vectors: list[np.ndarray], bar: float):
        sizes: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            sizes.setdefault(len(v), []).append(i)
        self.bar, self.of = bar, {}
        for n, at in sizes.items():
            unit = np.array([vectors[i] / max(np.linalg.norm(vectors[i]), 1e-12) for i in at])
            self.of[n] = (at, unit, np.ascontiguousarray(unit.T.astype(np.float32)))

    def like(self, rows: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(row, print, score) of all pairs above the bar, by rows."""
        if rows.shape[1] not in self.of:
            return
        at, unit, short = self.of[rows.shape[1]]
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            r, k = np.nonzero(part.astype(np.float32) @ short >= self.bar - MARGIN)
            scores = np.round(np.einsum("ij,ij->i", part[r], unit[k]), DIGITS)
            for x, y, s in zip(r.tolist(), k.tolist(), scores.tolist()):
                if s >= self.bar:
                    yield start + x, at[y], s

    def alike(self) -> list[list[tuple[int, float]]]:
        """Each print's earlier ones above the bar."""
        found: list[list[tuple[int, float]]] = [[] for _ in range(sum(len(at) for at, *_ in self.of.values()))]
        for at, unit, _ in self.of.values():
            for x, j, s in self.like(unit):
                if j < at[x]:
                    found[at[x]].append((j, s))
        return found


def _near(shared: Broadcast, bar: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The groups that are like a print of the block and have none of its meeting, with those prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or _Block([v for *_, v in shared.value], bar)
            totals, hits = batch.column("total"), {}
            ends = totals.offsets.to_numpy()
            sizes, values = np.diff(ends), totals.values.to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for x, i, s in block.like(values[ends[:-1][rows][:, None] + np.arange(n)]):
                    hits.setdefault(int(rows[x]), []).append((i, s))
            kept = []
            for row in sorted(hits):
                met = set(batch.column("met")[row].as_py())
                free = [(i, s) for i, s in hits[row] if shared.value[i][1] not in met]
                if free:
                    kept.append((row, [i for i, _ in free], [s for _, s in free]))
            if kept:
                part = batch.take(pa.array([row for row, *_ in kept]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([at for _, at, _ in kept], pa.list_(pa.int32())), pa.array([s for *_, s in kept], pa.list_(pa.float64()))], names=names)

    return run


def _block_walk(shared: Broadcast, number: int, following: int, bar: float, made: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The walk of a block from the groups near it, as rows of its prints and of the groups that changed, with their meetings that go on."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        hits: list[list[tuple[int, float]]] = [[] for _ in shared.value]
        near, until = {}, {meeting: last for _, meeting, last, _ in shared.value}
        for g, total, seen, ends, at, scores in frame.dropna(subset=["group"])[["group", "total", "met", "until", "at", "score"]].itertuples(index=False, name=None):
            near[int(g)] = (np.asarray(total), set(seen))
            until |= dict(zip(seen, map(int, ends)))
            for i, s in zip(at, scores):
                hits[i].append((int(g), s))
        alike = _Block([v for *_, v in shared.value], bar).alike()
        labels, moved = walk([(m, v) for _, m, _, v in shared.value], alike, hits, near, following, bar)
        rows = [(name, g, None, None, None, None, True) for (name, *_), g in zip(shared.value, labels)]
        for g, (total, seen) in moved.items():
            open_ = [m for m in seen if until[m] > number]  # no print of the others will come
            rows.append((None, g, number, total.tolist(), open_, [until[m] for m in open_], False))
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(made, zip(*rows))})

    return step


def voice_groups(rows: DataFrame, ident: str, order: str, meeting: str, vector: str = "embedding", bar: float = LINK, block: int = BLOCK) -> DataFrame:
    """ident and ``group`` (a number, in order of their first prints) of each print.

    In order (then of ``ident``, which is unique), a print joins the group whose centre is most like it, by ``bar``
    at least, the first of equal ones; never one that has a print of its meeting. The centre is the
    direction of the members' sum. Rows without vector are left out; vectors of another length never meet.
    The block size, which is about the prints of a block, changes nothing but the work of one task. No rows, no groups.
    """
    spark = rows.sparkSession
    prints = _written(rows.where(F.size(vector) > 0).select(F.col(order).alias("o"), F.col(ident).alias("id"), F.col(meeting).alias("meeting"), F.col(vector).cast("array<double>").alias("v")))
    number, longest = prints.agg(F.count("*"), F.max(F.size("v"))).first()
    if not number:
        return prints.select(F.col("id").alias(ident), F.lit(0).cast("long").alias("group"))
    count = -(-number // max(1, min(block, BYTES // (8 * longest))))
    ranged = _written(prints.repartitionByRange(count, "o", "id").withColumn("_block", F.spark_partition_id()))
    ends = ranged.groupBy(F.col("meeting").alias("_meeting")).agg(F.max("_block").alias("last"))
    path = _folder(spark)
    # a block is a folder of its own, so that it is read without the others
    ranged.join(ends, F.col("meeting").eqNullSafe(F.col("_meeting"))).drop("_meeting").repartition("_block").write.partitionBy("_block").parquet(f"{path}/prints")
    blocks = spark.read.parquet(f"{path}/prints")
    state = StructType([StructField("group", LongType()), StructField("version", IntegerType()), StructField("total", ArrayType(DoubleType())), StructField("met", ArrayType(prints.schema["meeting"].dataType)), StructField("until", ArrayType(IntegerType()))])
    hit = StructType([*state, StructField("at", ArrayType(IntegerType())), StructField("score", ArrayType(DoubleType()))])
    made = StructType([StructField("id", prints.schema["id"].dataType), *state, StructField("is_print", BooleanType())])
    start = spark.createDataFrame([(None,) * len(hit)], hit)  # so that the walk has a row to start from
    done, following = [], 0
    for k in range(count):
        part = blocks.where(F.col("_block") == k).orderBy("o", "id").select("id", "meeting", "last", "v").collect()  # a block
        if not part:
            continue
        shared = spark.sparkContext.broadcast([(r.id, r.meeting, r["last"], np.array(r.v)) for r in part])
        near = start
        if done:
            groups = spark.read.schema(made).parquet(*done).where("not is_print").select(*state.names)
            latest = groups.groupBy("group").agg(F.max("version").alias("version"))
            near = groups.mapInArrow(_near(shared, bar, hit.names), hit).join(latest, ["group", "version"]).select(*hit.names).unionByName(start)
        done.append(f"{path}/block-{k}")
        near.withColumn("_block", F.lit("")).groupBy("_block").applyInPandas(_block_walk(shared, k, following, bar, made.names), made).write.parquet(done[-1])
        following = max(following, 1 + spark.read.schema(made).parquet(done[-1]).agg(F.max("group")).first()[0])
        shared.unpersist()
    return spark.read.schema(made).parquet(*done).where("is_print").select(F.col("id").alias(ident), "group")


def suggested(rows: DataFrame, groups: DataFrame, known: DataFrame, ident: str, meeting: str, spoken: str, vector: str = "embedding") -> DataFrame:
    """Groups of APPEARANCES meetings that are nobody's: group, appearances, speaking_ms, and the print that speaks most to stand for it.

    ``known`` has person, i and x, the centres of the people; a group whose centre is like one of them is known.
    """
    whole = rows.join(groups, ident)
    held = whole.groupBy("group").agg(F.count_distinct(meeting).alias("appearances"), F.sum(spoken).alias("speaking_ms"), F.max_by(ident, F.struct(spoken, ident)).alias(ident)).where(F.col("appearances") >= APPEARANCES)
    centres = R.centroids(whole.join(held.select("group"), "group"), ["group"], vector)
    centres = centres.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("_v"))
    like = L.best_two(centres, known, "group", "_v", "person").where(F.col("score") >= LINK).select("group").distinct()
    return held.join(like, "group", "left_anti").select("group", "appearances", "speaking_ms", ident)


def merged(samples: DataFrame, merges: DataFrame, person: str = "person") -> DataFrame:
    """``samples`` with those of merged people re-pointed: ``merges`` (gone, into) one step each; who is merged into somebody merged goes on with them."""
    steps = R.resolve_aliases(samples.select(F.col(person).alias("id")).unionByName(merges.select(F.col("into").alias("id"))).distinct().join(merges.select(F.col("gone").alias("id"), F.col("into").alias("alias_of")), "id", "left"))
    return samples.join(steps.select(F.col("id").alias(person), "root"), person, "left").withColumn(person, F.coalesce("root", person)).drop("root")


def curated(samples: DataFrame, ident: str, age: str, condition: str, person: str = "person", vector: str = "embedding", keep: int = L.KEEP) -> DataFrame:
    """The samples that people keep: of the usual length of vector, no outliers, and of the rest the most different and recent ``keep``."""
    sized = samples.withColumn("_n", F.size(vector))
    usual = sized.groupBy(person).agg(F.mode("_n", True).alias("_usual"))
    held = sized.join(usual, person).where("_n = _usual").drop("_n", "_usual")
    held = held.join(L.outliers(held, [person], ident, vector).select(ident), ident, "left_anti")
    return held.join(L.evictions(held, [person], ident, age, condition, vector, keep).select(ident), ident, "left_anti")


def learned(samples: DataFrame, new: DataFrame, merges: DataFrame | None, ident: str, age: str, condition: str, person: str = "person", vector: str = "embedding", keep: int = L.KEEP) -> tuple[DataFrame, DataFrame]:
    """The samples after ``new`` ones (a known ident is replaced) and ``merges``, curated, and the people's new centres (person, i, x): one plan for all."""
    rows = samples.join(new.select(ident), ident, "left_anti").unionByName(new.select(*samples.columns))
    rows = rows if merges is None else merged(rows, merges, person)
    kept = curated(rows, ident, age, condition, person, vector, keep)
    return kept, R.centroids(kept, [person], vector)
