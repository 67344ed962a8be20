"""Benchmark decontamination: a prefix-filtered set join of benchmark windows against whole documents.

An item gives windows of ``span`` consecutive words (a shorter item one window of all its words). A
window must occur whole, so of its words, ordered by their count over all documents, the prefix is
the rarest one alone: a document word joins the windows that have it as their prefix. The prefix's
place in the window bounds where the window would lie in the document (positional bound), the
document must be long enough for it (length bound), and the words there are compared exactly.

The windows travel to the documents in blocks of a stated size, one at a time, so neither what is
broadcast nor what the driver holds grows with the benchmark; a benchmark of one block, the usual
case, takes no shuffle of documents. Further blocks cost a pass each, whose hits are written before
the next block is read, and joined on the document's digest in the end.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import annotate, documents, kept, pa_types, settle, without

SPAN = 10
#: Bytes of windows in a block; as a dictionary in a task they take some ten times that.
BLOCK_BYTES = 8 << 20
#: A-Z to a-z; ASCII but letters and digits to space; other bytes (of non-ASCII characters) stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def windows(benchmark: DataFrame, span: int = SPAN, item: str = "item_id", text: str = "text", unnamed: bool = False) -> DataFrame:
    """Distinct (item, window): windows as their words with a space between. Items without word have none, those without id only if ``unnamed``."""
    kind = StructType().add("item", StringType()).add("window", StringType())
    kinds = pa_types(kind)

    def run(batches):
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(value)
                rows += [(name, b" ".join(found[i : i + span]).decode()) for i in range(max(1, len(found) - span + 1)) if found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=kind.names)

    source = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    if not unnamed:
        source = source.where("item is not null")
    return source.mapInArrow(run, kind).distinct()


def _number(pairs: DataFrame, room: int) -> int:
    """Of blocks of some ``room`` bytes each."""
    size = pairs.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    return max(1, -(-size // room))


def _block(pairs: DataFrame, k: int, number: int):
    """The broadcast of {window: items} of block ``k``; every pair is in one block."""
    held = defaultdict(list)
    for item, window in pairs.where(F.pmod(F.xxhash64("item", "window"), F.lit(number)) == k).toLocalIterator():
        held[tuple(window.encode().split())].append(item)
    return pairs.sparkSession.sparkContext.broadcast(pickle.dumps(dict(held)))


def _counts(docs: DataFrame, block, text: str) -> dict[bytes, int]:
    """The count over all documents of each word of the block's windows."""
    kind = StructType().add("word", StringType()).add("n", LongType())

    def run(batches):
        wanted, n = {w for window in pickle.loads(block.value) for w in window}, Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                n.update(filter(wanted.__contains__, words(value)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=kind.names)

    return {w.encode(): n for w, n in docs.select(text).mapInArrow(run, kind).groupBy("word").agg(F.sum("n")).toLocalIterator()}


def _finder(name: str, block, counts) -> Callable:
    """Started in a task: this Python worker's finder for the block of this name."""
    return kept(f"finder {name}", lambda: _built(block, counts))


def _built(block, counts):
    """From a text to (words, merged hit spans as a flat list, items)."""
    held, rare = pickle.loads(block.value), pickle.loads(counts.value)
    shapes = defaultdict(set)  # prefix word: (its place in the window, the window's length)
    for window in held:
        place = min(range(len(window)), key=lambda i: (rare.get(window[i], 0), window[i]))
        shapes[window[place]].add((place, len(window)))
    shapes = {w: sorted(x) for w, x in shapes.items()}

    def find(text):
        found = words(text)
        n, spans, items = len(found), [], set()
        if shapes.keys() & set(found):
            for at, word in enumerate(found):
                for place, length in shapes.get(word, ()):
                    if 0 <= at - place <= n - length and (hit := tuple(found[at - place : at - place + length])) in held:
                        spans.append((at - place, at - place + length))
                        items.update(i for i in held[hit] if i is not None)
        return n, merged(spans), sorted(items)

    return find


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans over ``spans``, flat: start, end, start, end ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, text: str = "text", keep: list[str] | None = None, room: int = BLOCK_BYTES, unnamed: bool = False) -> DataFrame:
    """Each document with ``n_words``, ``hit_spans`` (word places, flat, end exclusive), ``n_hit`` and ``items``.

    A null or empty text has no words and no hits; an empty benchmark hits nothing. Repeated rows
    stay rows, each with the same finding. Columns of the names given here give way to them;
    others in ``keep`` (all) stay. A text of any length is cut into words whole, one text at a time. If ``unnamed``, benchmark rows without id hit as well; they are not in ``items``.
    """
    spark = docs.sparkSession
    adds = StructType().add("n_words", LongType()).add("hit_spans", ArrayType(LongType())).add("items", ArrayType(StringType()))
    keep = docs.columns if keep is None else keep
    pairs = settle(windows(benchmark, span, unnamed=unnamed))
    number = _number(pairs, room)

    def finder(k: int) -> tuple:
        block = _block(pairs, k, number)
        return uuid.uuid4().hex, block, spark.sparkContext.broadcast(pickle.dumps(_counts(docs, block, text)))

    if number == 1:
        only = finder(0)
        found = annotate(docs, text, adds, lambda: _finder(*only), keep)
    else:
        found = _over_blocks(docs, text, adds, map(finder, range(number)), keep)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get("hit_spans", i + 1) - F.get("hit_spans", i))
    return without(found, ["n_hit"]).withColumn("n_hit", F.when(F.size("hit_spans") > 0, n_hit).otherwise(F.lit(0).cast("long")))


def _over_blocks(docs: DataFrame, text: str, adds: StructType, blocks: Iterator, keep: list[str]) -> DataFrame:
    """The blocks' findings in one, joined to the documents by the digest of the text."""
    named = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    named = named.withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))
    union = None
    for one in blocks:
        part = annotate(named.select("_digest", "_text"), "_text", adds, lambda one=one: _finder(*one), ["_digest"])
        part = settle(part.where(F.size("hit_spans") > 0))
        union = part if union is None else union.unionByName(part)
        for shared in one[1:]:
            shared.destroy()
    pairs = F.transform(F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2)), lambda i: F.struct(F.get("hit_spans", i).alias("a"), F.get("hit_spans", i + 1).alias("b")))
    grouped = union.groupBy("_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    one = StructType().add("hit_spans", ArrayType(LongType()))
    grouped = settle(annotate(grouped, "_spans", one, lambda: lambda spans: (merged([(s["a"], s["b"]) for s in spans]),), ["_digest", "items"]))
    count = annotate(named, "_text", StructType().add("n_words", LongType()), lambda: lambda value: (len(words(value)),), None)
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    kept = [c for c in keep if c.lower() not in {n.lower() for n in (*adds.names, "n_hit")}]
    joined = count.join(grouped, "_digest", "left")
    return joined.select(*[F.col("_doc").getField(c).alias(c) for c in kept], "n_words", empty("hit_spans", "array<long>"), empty("items", "array<string>"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    found = hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"], unnamed=True)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op9_decontaminate": op9_decontaminate}
