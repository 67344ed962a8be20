"""Best-fit packing of documents into token sequences, by bin completion.

Documents are tokenised where they lie; only lengths and checksums travel. Pieces are dealt at random
into groups of a bounded number, so a group's sizes are spread as the whole table's, and each group
is packed by itself. The sequences that a group leaves unfilled, its worst down to a sequence's worth
of free room, are opened again and packed with those of other groups, until they are one group. In a
group, best-fit decreasing is the first
incumbent. If the waste bound (total size over capacity) leaves room for fewer sequences, the pieces
of the worst-filled sequences, with others up to a bounded lot, go through a branch and bound over
bin completions: the largest piece opens a sequence, the fillings around it are tried by rising
waste, and a branch ends when its waste leaves no better result. Lots follow while the effort lasts
and the sequences are more than the bound.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import documents, settle, slices, tokenizer_path
from .tokens import encoder

CAPACITY = 4096
END = 1
#: Pieces in a group, about.
GROUP = 10_000
#: Sizes that the branch and bound of one group looks at, all in all.
EFFORT = 1_000_000
#: A sequence is packed again if more than this fraction of it is free.
OPEN = 16
#: Pieces in a lot, about, and the lots that an effort is meant to last for.
LOT, LOTS = 60, 10


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: places into ``sizes``, by sequence. A bit set has the free room of open sequences."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = rooms >> sizes[i]
        if fits:
            room = (fits & -fits).bit_length() - 1 + sizes[i]
            k = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        if room:
            free.setdefault(room, []).append(k)
            rooms |= 1 << room
    return bins


def completions(room: int, counts: Counter, effort: int = EFFORT, width: int = 64) -> tuple[list[tuple[int, ...]], int]:
    """Fillings of ``room`` from sizes in ``counts``, by rising waste, and the effort spent.

    One filling dominates another if its pieces hold the other's, packed into them; of the first
    4 * ``width`` the dominated are left out. Fillings that no further piece fits are enumerated,
    large pieces first, as far as the effort goes.
    """
    sizes = sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True)
    found, stack, spent = set(), [(0, room, ())], 0
    while stack and spent < effort:
        first, left, chosen = stack.pop()
        spent += 1 + len(sizes)
        used = Counter(chosen)
        fits = [i for i, s in enumerate(sizes) if s <= left and used[s] < counts[s]]
        if not fits:
            found.add(chosen)
        stack += [(i, left - sizes[i], (*chosen, sizes[i])) for i in reversed(fits) if i >= first]
    ranked = sorted(found, key=lambda c: (room - sum(c), len(c), c))
    head = ranked[: 4 * width]
    return [c for i, c in enumerate(head) if not any(_dominates(d, c) for d in head[:i])] + ranked[4 * width :], spent


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` pack into those of ``a``, largest first."""
    if sum(a) < sum(b) or a == b:
        return False
    rooms = sorted(a)
    for s in b:
        k = next((i for i, x in enumerate(rooms) if x >= s), None)
        if k is None:
            return False
        rooms[k] -= s
        rooms.sort()
    return True


def search(sizes: list[int], most: int, capacity: int, effort: int) -> tuple[list[list[int]] | None, int]:
    """Fewer than ``most`` sequences of ``sizes``, as few as the effort finds (None if none), and the effort spent."""
    best, bound, left = None, -(-sum(sizes) // capacity), effort

    def node(counts: Counter, rest: int, used: int, chain):
        """What a sequence opened by the largest piece may hold, as the nodes after it."""
        nonlocal left
        largest = max(counts)
        around = counts - Counter([largest])
        options, spent = completions(capacity - largest, around, min(left, effort // 20))
        left -= spent + len(counts)
        for option in options:
            yield around - Counter(option), rest - largest - sum(option), used + 1, ((largest, *option), chain)

    stack = [iter([(Counter(sizes), sum(sizes), 0, None)])]
    while stack and left > 0 and most > bound:
        at = next(stack[-1], None)
        if at is None:
            stack.pop()
            continue
        left -= 1
        _, rest, used, chain = at
        if used + -(-rest // capacity) >= most:
            continue
        if rest:
            stack.append(node(*at))
            continue
        most, best = used, []
        while chain:
            filling, chain = chain
            best.append(list(filling))
    return best, effort - left


def pack(sizes: list[int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[list[int]]:
    """Places into ``sizes``, by sequence; as few sequences as the effort finds, the best fit at worst."""
    bins = best_fit(sizes, capacity)
    bound, left, rng = -(-sum(sizes) // capacity), effort, np.random.default_rng(8)
    whole, tries = len(sizes) <= LOT, 0
    while len(bins) > bound and left > 0:
        if not tries:  # the sequences are new
            free = [capacity - sum(sizes[i] for i in b) for b in bins]
            order = sorted(range(len(bins)), key=lambda k: -free[k])
            core = int(np.searchsorted(np.cumsum([free[k] for k in order]), capacity)) + 1  # their free room is a sequence
        others = order[core:] if not tries or whole else (order[core + i] for i in rng.permutation(len(bins) - core))
        lot, held = order[:core], sum(len(bins[k]) for k in order[:core])
        for k in others:
            if held >= LOT and not whole:
                break
            if whole or tries or free[k]:  # full sequences stay at first
                lot.append(k)
                held += len(bins[k])
        found, spent = search([sizes[i] for k in lot for i in bins[k]], len(lot), capacity, left if whole else max(1, min(left, effort // LOTS)))
        left, tries = left - max(1, spent), 0 if found else tries + 1
        if found:
            places: dict[int, list[int]] = {}
            for k in lot:
                for i in bins[k]:
                    places.setdefault(sizes[i], []).append(i)
            taken = set(lot)
            bins = [b for k, b in enumerate(bins) if k not in taken] + [[places[s].pop() for s in b] for b in found]
        elif whole:
            break
    return bins


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, spaced: bool = False, key: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """A row for each piece of each document: key, piece, start, length, ids_crc32, and ``slot``, its row's number in the task.

    A null text is empty: its document is the end id alone. Only documents over ``capacity`` are cut.
    Rows that repeat a key are documents of their own; other columns are ignored; an empty table gives no piece.
    A text of any length is encoded whole, one at a time, and cut by its ids.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    numbers = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()), ("slot", LongType())]
    kind = StructType([StructField("key", rows.schema["key"].dataType), *[StructField(n, t) for n, t in numbers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slot = encoder(tokenizer, spaced, special), 0
        code = "<u2" if encode.width == 2 else "<u4"
        for batch in batches:
            for part in slices(batch, 1):
                out, at = [], []
                for k, value in enumerate(part.column(1).to_pylist()):
                    packed = np.frombuffer(encode.packed(value or "", end), code).astype("<u4")
                    for p, a in enumerate(range(0, len(packed), capacity)):
                        ids = packed[a : a + capacity]
                        out.append((p, a, len(ids), zlib.crc32(ids.tobytes()), slot))
                        at.append(k)
                    slot += 1
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *[pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out))]], names=kind.names)

    return rows.mapInArrow(run, kind)


def packed(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP, effort: int = EFFORT) -> DataFrame:
    """``found`` (from :func:`pieces`, settled) with ``sequence_id`` and ``offset``; an empty table stays empty.

    ``group`` pieces are packed at once, about, with an ``effort`` of so many sizes looked at; both bound
    a task, and larger ones search further. Pieces of equal size are alike; which of them goes where follows their
    order in the task. Rows that repeat a key are pieces like any others, columns
    of other names are left out.
    """
    columns = [f.name for f in found.schema if f.name != "slot"]
    kind = StructType([*found.schema, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("open", BooleanType())])
    left, level, count, done = found, 0, found.count(), None
    while True:
        number = max(1, -(-count // group))
        # rows of one document or many copies spread as well: the slot tells them apart
        dealt = left.withColumn("group", F.pmod(F.xxhash64("key", "piece", "slot", "ids_crc32"), F.lit(number)))
        out = dealt.groupBy("group").applyInPandas(_packer(kind.names, capacity, effort, level, number == 1), kind)
        if number > 1:
            out = settle(out)
        part = out.where(~F.col("open")).select(*columns, "sequence_id", "offset")
        done = part if done is None else done.unionByName(part)
        left, level, count = out.where("open").select(*columns, "slot"), level + 1, 0 if number == 1 else out.where("open").count()
        if not count:
            return done


def _packer(names: list[str], capacity: int, effort: int, level: int, last: bool):
    """Packs a group; ``open`` marks the rows of sequences to be packed again, none if it is the ``last``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "slot", "piece"], ascending=False, ignore_index=True)
        sizes = rows["length"].tolist()
        sequence, offset, opened = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8"), np.zeros(len(sizes), bool)
        bins = pack(sizes, capacity, effort)
        free = [capacity - sum(sizes[i] for i in b) for b in bins]
        room, held = 0, 0
        for k in sorted(range(len(bins)), key=lambda k: -free[k]):
            held += len(bins[k])  # a group keeps half of its pieces, so that the levels end
            opened[bins[k]] = not last and free[k] * OPEN > capacity and room < capacity and held * 2 <= len(sizes)
            room += free[k]
            sequence[bins[k]] = (level << 56) + (int(rows["group"].iloc[0]) << 24) + k
            offset[bins[k]] = np.cumsum([0, *(sizes[i] for i in bins[k][:-1])])
        return rows.assign(sequence_id=sequence, offset=offset, open=opened)[names]

    return run


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed(settle(pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), END, special=True))).withColumnRenamed("key", "doc_id")


QUERIES = {"op8_packing": op8_packing}
