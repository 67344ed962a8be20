"""MinHash near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed; its sketch the ``k`` smallest hashes. Texts of
equal sets form a class, and work goes on between classes. Two sets of the wanted similarity share,
but for a stated chance, at least ``m`` retained values, so they share one of the ``k - m + 1``
rarest that each retains: only those go into inverted lists. Candidates from the lists pass the
union-sketch estimate (the share of the union's bottom k that both retain) and then an exact
comparison of the whole sets of both texts.

A value of many classes makes a list only together with another one: near sets share two of one more.
Lists that are long all the same, of many near copies or of a common passage, don't give all their
pairs. Each names a leader, first the class that shares values with most others, then the one whose sketch is
nearest to that one's (near copies are farther from each other than from what they were copied from). Members
are compared with their leaders alone. What is near
a leader is linked. Any other pair of the list still needs shingles in common outside the leader's
set, as exact counts tell, so what is left of the sets meets by a prefix filter: its rarest shingles
make new lists, and a pair counts where enough shingles follow in both. If these lists would make many pairs,
all their members first meet one each, which links most of what is near; then the pairs of different
components meet, but for those within the component that most members of a list have. Of these pairs too each class
first has the one compared that its counts favour, as long as that links enough to halve them: a class next to a large component is
near many of its members or none, and one link spares the others. No pair is lost on the way: pairs
whose counts allow a link within the leader's set alone are compared as well, in one more list of each leader.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import annotate, documents, kept, settle, slices
from .components import components

K = 32
#: The chance that a pair at the threshold shares too few retained values, at most.
MISS = 1e-6
#: Members from which on a list is led.
LONG = 12
#: Pairs for each member from which on all members of a list first meet one of them. All pairs left meet in either case.
CROWDED = 8
#: Pairs for each member, or for each likeliest pair, from which on the likeliest are compared before the others.
FEW = 2
#: Columns of 64 bits each that tell where a set lacks shingles of its leader's.
GAPS = ("gap0", "gap1", "gap2", "gap3")
#: Stands for the shingle in a leader's list of those that may be near within its set.
INSIDE = 0
#: Members that meet one copy of their leader's set.
SEATS = 256
#: Bits of the sieve that spares documents nobody asks for their shuffle.
SIEVE = 1 << 20
LIST = ["leader", "shingle"]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct hashed shingles of ``size`` words, ascending; all words as one if there are fewer, none without words."""
    found = text.encode("utf-8", "replace").translate(_FOLD).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(size, len(words))
    n = len(words) - size + 1
    run = words[:n]
    for i in range(1, size):
        run = _mix(run) + words[i : i + n]
    return np.unique(_mix(run))


def shared_at_least(k: int, percent: int, miss: float = MISS) -> int:
    """Retained values of a union's bottom ``k`` that both sets of this similarity hold, but for the chance ``miss``."""
    p, below = percent / 100, 0.0
    for x in range(k + 1):
        below += comb(k, x) * p**x * (1 - p) ** (k - x)
        if below > miss:
            return x
    return k


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, key: str, text: str, size: int, k: int) -> DataFrame:
    """key, mark (a hash of the text), n (set size), digest (of the set; null if empty) and sketch for each row."""
    adds = StructType().add("n", LongType()).add("digest", BinaryType()).add("sketch", ArrayType(LongType()))

    def one(value: str | None):
        found = shingles(value, size)
        kept = (found[:k] ^ np.uint64(1 << 63)).view(np.int64)  # signed order is that of the hashes
        return len(found), _digest(found) if len(found) else None, kept.tolist()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("mark", _mark("text"))
    return annotate(rows, "text", adds, lambda: kept(f"sketches {size} {k}", lambda: one), ["key", "mark"])


def _lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """key, id, n, score: each class under the rarest of its retained values that others retain too; score is how often others do.

    Near classes share one of their ``room`` rarest values, and two of one more; a value of many classes
    is a key only together with each that follows it.
    """
    entries = classes.select("id", "n", F.explode("sketch").alias("value"))
    counts = entries.groupBy("value").count().where("count > 1")
    whole = k * percent // 100  # up to this size, both sets of a pair are retained whole
    least = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(shared_at_least(k, percent)))
    kept = F.least(F.col("n"), F.lit(k))
    shared = entries.join(counts, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "value"))).alias("shared"))
    # the values that no other class retains are the rarest and stand first
    room = ((kept - least + 1) - (kept - F.size("shared"))).cast("int")
    score = F.aggregate("shared", F.lit(0).cast("long"), lambda n, s: n + s["count"])
    ranked = shared.select("id", "n", score.alias("score"), room.alias("room"), F.slice("shared", F.lit(1), F.greatest(F.lit(0), room + 1)).alias("first")).where("room > 0")

    def keys(s: Column, i: Column) -> Column:
        following = F.slice("first", i + 2, F.size("first"))
        both = F.transform(following, lambda w: F.xxhash64(s["value"], w["value"]))
        return F.when(i >= F.col("room"), F.array().cast("array<long>")).when(s["count"] > LONG, both).otherwise(F.array(s["value"]))

    return ranked.select(F.explode(F.flatten(F.transform("first", keys))).alias("key"), "id", "n", "score")


def _least(total: Column, percent: int) -> Column:
    """Shingles that two sets of ``total`` shingles together share at least if they are near."""
    return F.ceil(total * percent / (100 + percent))


def _near_enough(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimated(pairs: DataFrame, short: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose union sketch allows the similarity; exact where both sets are retained whole."""
    both = pairs.join(short.select(F.col("id").alias("a"), F.col("short").alias("sa")), "a")
    both = both.join(short.select(F.col("id").alias("b"), F.col("short").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    agree = F.size(F.array_intersect(F.array_intersect(union, "sa"), "sb"))
    least = F.least(F.lit(shared_at_least(k, percent)), F.ceil(F.size(union) * percent / 100))
    return both.where(agree >= least).drop("sa", "sb")


def sieve(wanted: DataFrame, name: str, key: Column) -> Column:
    """Whether ``key`` falls in a slot of a key in column ``name`` of ``wanted``: bits of a fixed number, true for all wanted keys."""
    words = SIEVE // 64
    slot = F.pmod(F.xxhash64(name), F.lit(SIEVE))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.col("slot") / words).cast("int"))
    held = [0] * words
    for word, bits in wanted.select(slot.alias("slot")).groupBy((F.col("slot") % words).alias("word")).agg(F.bit_or(bit)).collect():
        held[word] = bits
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    return F.getbit(F.get(F.lit(np.array(held, np.int64)), (at % words).cast("int")), F.floor(at / words).cast("int")) == 1


def _sets(docs: DataFrame, key: str, text: str, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id and whole set (ascending hashes, packed) of each class in ``wanted``, from the class's first document.

    Texts meet their classes by key and hash, and then become sets: fewer bytes to move, and one Python
    step in a stage, so that an executor holds no second worker a core.
    """
    firsts = settle(classes.join(wanted, "id").select("id", "first", "mark", "digest"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(sieve(firsts, "first", F.col("key"))).withColumn("_mark", _mark("text"))
    found = rows.join(firsts, (F.col("_mark") == F.col("mark")) & F.col("key").eqNullSafe(F.col("first"))).select("id", "digest", "text")
    kind = StructType([found.schema["id"], StructField("whole", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows of one id are in one task, but for a broadcast join, where a second set only costs time
        for batch in batches:
            for part in slices(batch, 2):
                ids, sets = [], []
                for one, digest, value in zip(*(c.to_pylist() for c in part.columns)):
                    if one not in seen:
                        hashes = shingles(value, size)
                        if _digest(hashes) == digest:
                            seen.add(one)
                            ids.append(one)
                            sets.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=kind.names)

    return settle(found.mapInArrow(run, kind))


def _mark(text: str) -> Column:
    """Tells the texts of one key apart, so that rows that share it, or have none, don't all meet."""
    return F.xxhash64(text)


def _hashes(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.uint64)


def _held(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the hashes ``one`` are in ``other``; both ascend."""
    if not len(other):
        return np.zeros(len(one), bool)
    return other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs' labels (a, b) where the whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("whole").alias("one")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("whole").alias("two")), "b")
    both = both.select(F.col("la").alias("a"), F.col("lb").alias("b"), "one", "two")
    kind = both.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = _hashes(one), _hashes(two)
                near.append(int(_held(one, two).sum()) * (100 + percent) >= percent * (len(one) + len(two)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, kind)


def _led(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (leader, id, n) with shared (shingles in common with the leader), alike (the similarity), near, GAPS (a bit, by its hash,
    for each shingle that only the leader has), rest (the shingles outside the leader's set) and
    floor: what any near partner among the members must share with id at least.

    A near partner y of x has n(y) >= max(least n of all members, percent of n(x)). Leaders' sets go to the
    members, so that what Python reads is dealt out by the members, however many a leader has.
    """
    cells = settle(pairs.groupBy("leader").agg(F.min("n").alias("low"), F.ceil(F.count("*") / SEATS).alias("seats")))
    heads = cells.join(sets.withColumnRenamed("id", "leader"), "leader").select("leader", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seats") - 1)).alias("seat"), F.col("whole").alias("lead"))
    seated = pairs.join(cells.select("leader", "seats"), "leader").withColumn("seat", F.pmod(F.xxhash64("id"), F.col("seats"))).drop("seats")
    both = seated.join(heads, ["leader", "seat"]).drop("seat").join(sets, "id").select("leader", "id", "n", "low", "whole", "lead")
    kind = StructType([*both.schema.fields[:4], StructField("shared", LongType()), StructField("alike", DoubleType()), StructField("near", BooleanType()), *[StructField(n, LongType()) for n in GAPS], StructField("rest", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, lead in zip(batch.column(4), batch.column(5)):
                one, lead = _hashes(one), _hashes(lead)
                held = _held(one, lead)
                shared = int(held.sum())
                both = len(one) + len(lead)
                bits = np.zeros(64 * len(GAPS), bool)
                bits[lead[~_held(lead, one)] >> np.uint64(20) & np.uint64(len(bits) - 1)] = True
                rows.append((shared, shared / (both - shared), shared * (100 + percent) >= percent * both, np.packbits(bits).view(np.int64), one[~held].view(np.int64)))
            if rows:
                shared, alike, near, gaps, left = zip(*rows)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, left)]), pa.int32()), pa.array(np.concatenate(left)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64()), pa.array(alike, pa.float64()), pa.array(near, pa.bool_()), *map(pa.array, np.array(gaps).T.copy()), lists], names=kind.names)

    smallest = F.greatest("low", F.ceil(F.col("n") * percent / 100))
    return both.mapInArrow(run, kind).withColumn("floor", _least(F.col("n") + smallest, percent)).drop("low")


def _mixed(entries: DataFrame) -> DataFrame:
    """The lists of ``entries`` that have several labels: ``LIST``, the label that most members have (most), and how many pairs lists with it make."""
    counts = entries.groupBy(*LIST, "label").count()
    held = counts.groupBy(*LIST).agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    return settle(held.select(*LIST, F.col("top.label").alias("most"), "all", ((F.col("all") - F.col("top.count")) * F.col("all")).alias("made")))


def _apart(entries: DataFrame, percent: int, mixed: DataFrame, stars: bool) -> DataFrame:
    """(a, b), their labels (la, lb) and hope: pairs of ``entries`` of one list, of different labels and similar sizes, that share enough as far as their counts tell.

    hope is the share of both sets that these counts allow.

    Left out are pairs of two near the leader, and those that meet at another leader, home to both.
    With ``stars`` only the pairs with one member of each list. Else all pairs, none of them within the
    label that most members of a list have: each has one member at least of another label.
    """
    rest = [c for c in entries.columns if c not in LIST]
    left = entries.select(*LIST, *[F.col(c).alias(c + "a") for c in rest]).join(mixed.select(*LIST, "most"), LIST)
    if stars:
        right = entries.groupBy(*LIST).agg(F.min_by(F.struct(*rest), F.struct("id")).alias("s")).select(*LIST, *[F.col(f"s.{c}").alias(c + "b") for c in rest])
        met = left.join(right, LIST)
    else:
        right = entries.select(*LIST, *[F.col(c).alias(c + "b") for c in rest])
        met = left.where("labela <> most").join(right, LIST).where("labelb = most or ida < idb")
    both = met.where("labela <> labelb and not (neara and nearb) and (homea <> homeb or homea = leader)")
    fits = F.least("followa", "followb") >= _least(F.col("na") + F.col("nb"), percent) - _within()
    ends = [F.struct(F.col("id" + side).alias("id"), F.col("label" + side).alias("label")) for side in "ab"]
    found = both.where(_near_enough(F.col("na"), F.col("nb"), percent) & fits).select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"), ((F.least("followa", "followb") + _within()) / (F.col("na") + F.col("nb"))).alias("hope"))
    return found.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).agg(F.max("hope").alias("hope"))


def _within() -> Column:
    """What a and b share within the leader's set at most: what one has of it, less gaps of the other where it has none."""
    own = lambda x, y: F.col("shared" + x) - sum((F.bit_count(F.col(g + y).bitwiseAND(F.bitwise_not(g + x))) for g in GAPS), F.lit(0))
    return F.least(own("a", "b"), own("b", "a"))


def _entries(led: DataFrame, members: DataFrame) -> DataFrame:
    """A leader's ``members`` under each shingle in which a near pair may first agree, with how many follow it.

    A near pair shares at least q = least(n(a) + n(b)) - within of what is left of both sets without the
    leader's (``led`` has it), in which shingles are ranked by their count under the leader. At the first
    they share, q - 1 or more follow in both. If q may be 0, both are under INSIDE as well, where none need follow.
    """
    columns = ["id", "n", "shared", "near", "label", "home", *GAPS, "follow"]
    shingles_ = led.select("leader", "id", F.explode("rest").alias("shingle"))
    counts = shingles_.groupBy("leader", "shingle").count().where("count > 1")
    ranked = shingles_.join(counts, LIST).groupBy("leader", "id").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("ranked"))
    rows = ranked.join(members, ["leader", "id"]).withColumn("w", F.size("ranked"))
    first = (F.col("w") - F.greatest(F.lit(1), F.col("floor") - F.col("shared")) + 1).cast("int")
    rows = rows.withColumn("ranked", F.slice("ranked", F.lit(1), F.greatest(F.lit(0), first)))
    outside = rows.select("*", F.posexplode("ranked").alias("place", "s")).withColumn("shingle", F.col("s.shingle")).withColumn("follow", F.col("w") - F.col("place"))
    inside = members.where(F.col("shared") >= F.col("floor")).withColumn("shingle", F.lit(INSIDE).cast("long")).withColumn("follow", F.lit(0))
    return outside.select(*LIST, *columns).unionByName(inside.select(*LIST, *columns))


def _leaders(long: DataFrame) -> DataFrame:
    """key and leader: of the classes under a key the one that shares its values with most others."""
    return long.groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("leader"))


def _moved(tried: DataFrame, short: DataFrame) -> DataFrame:
    """leader, id, n of ``tried``, each leader replaced by the member whose sketch is nearest to its own, if any shares half of it; the old one is a member then."""
    heads = tried.select("leader").distinct().join(short.select(F.col("id").alias("leader"), F.col("n").alias("m"), F.col("short").alias("lead")), "leader")
    met = tried.join(short.select("id", "short"), "id").join(heads, "leader").withColumn("agree", F.size(F.array_intersect("short", "lead")))
    nearest = met.where(2 * F.col("agree") >= F.greatest(F.size("short"), F.size("lead"))).groupBy("leader").agg(F.max_by("id", F.struct("agree", "score", -F.col("id"))).alias("better"))
    moved = tried.select("leader", "id", "n").unionByName(heads.select("leader", F.col("leader").alias("id"), F.col("m").alias("n")))
    moved = moved.join(nearest, "leader", "left").withColumn("leader", F.coalesce("better", "leader"))
    return moved.where("id <> leader").select("leader", "id", "n").distinct()


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, label) after the labels that ``edges`` (a, b) link became one each."""
    return _rooted(labels, "label", components(edges)).select("id", "label")


def _rooted(rows: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of its label in column ``name``."""
    return rows.join(roots.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("root", name)).drop("root")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each class the one with most hope."""
    best = [pairs.groupBy(one).agg(F.max_by(F.struct("a", "b", "la", "lb"), F.struct("hope", other)).alias("p")).select("p.*") for one, other in ("ab", "ba")]
    return best[0].unionByName(best[1]).distinct()


def _narrowed(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The likeliest of ``pairs`` are compared: the other pairs whose labels still differ, ``labels`` after that, and the links (a, b) found.

    Goes on as long as each class has several pairs left and the last round spared half of them.
    """
    pairs = settle(pairs)
    n, links = pairs.count(), pairs.select("a", "b").limit(0)
    while True:
        likely = settle(_likeliest(pairs))
        if n <= FEW * likely.count():
            return pairs, labels, links
        found = settle(_verified(likely, sets, percent))
        links, roots = links.unionByName(found), components(found)
        labels = settle(_rooted(labels, "label", roots).select("id", "label"))
        left = pairs.join(likely.select("a", "b"), ["a", "b"], "left_anti")
        pairs = settle(_rooted(_rooted(left, "la", roots), "lb", roots).where("la <> lb"))
        before, n = n, pairs.count()
        if 2 * n > before:
            return pairs, labels, links


def _ids(*columns: DataFrame) -> DataFrame:
    found = columns[0].toDF("id")
    for other in columns[1:]:
        found = found.unionByName(other.toDF("id"))
    return found.distinct()


def _linked(docs: DataFrame, key: str, text: str, classes: DataFrame, size: int, percent: int, k: int) -> DataFrame:
    """(id, label) for the classes that have lists: classes of one label are linked."""
    lists = settle(_lists(classes, k, percent))
    counts = lists.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    live = settle(lists.join(counts, "key"))
    long = live.where(F.col("c") > LONG)
    labels = live.select("id").distinct().withColumn("label", F.col("id"))
    short = classes.select("id", "n", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("short"))
    one, two = (live.where(F.col("c") <= LONG).select("key", F.col("id").alias(side), F.col("n").alias("n" + side)) for side in "ab")
    pairs = one.join(two, "key").where("a < b").where(_near_enough(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()
    pairs = settle(_estimated(pairs, short, k, percent))
    tried = settle(long.join(_leaders(long), "key").where("id <> leader").select("leader", "id", "n", "score").distinct())
    sets = _sets(docs, key, text, classes, _ids(*(pairs.select(c) for c in "ab"), *(tried.select(c) for c in ("leader", "id"))), size)
    if tried.isEmpty():
        return _relabelled(labels, _verified(_named(pairs, labels), sets, percent))
    led = settle(_led(settle(_moved(tried, short)), sets, percent))
    near = led.where("near").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    own = led.select("id", "leader", "alike", "near").unionByName(led.select(F.col("leader").alias("id"), "leader", F.lit(2.0).alias("alike"), F.lit(True).alias("near")).distinct())
    own = settle(own.groupBy("id").agg(F.max_by("leader", F.struct("alike", "leader")).alias("home"), F.coalesce(F.min(F.when(F.col("near"), F.col("leader"))), "id").alias("label")))
    entries = settle(_entries(led, led.drop("rest").join(own, "id")))
    mixed = _mixed(entries)
    made = mixed.agg(F.sum("made").alias("pairs"), F.sum("all").alias("members")).first()
    if (made.pairs or 0) > CROWDED * (made.members or 0):
        stars = settle(_estimated(_apart(entries, percent, mixed, stars=True).select("a", "b"), short, k, percent))
        labels = named = settle(_relabelled(labels, near.unionByName(_verified(_named(stars, labels), sets, percent))))
        near = near.limit(0)
        entries = settle(entries.drop("label").join(labels, "id"))
        mixed = _mixed(entries)
    else:
        named = labels.select("id").join(own.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    met = _apart(entries, percent, mixed, stars=False)
    if (made.pairs or 0) > FEW * (made.members or 0):
        met, named, links = _narrowed(met, named, sets, percent)
        near = near.unionByName(links)
    pairs = pairs.unionByName(_estimated(met.select("a", "b"), short, k, percent)).distinct()
    return _relabelled(labels, near.unionByName(_verified(_named(pairs, named), sets, percent)))


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of different labels, with these, la and lb."""
    for side in "ab":
        pairs = pairs.join(labels.select(F.col("id").alias(side), F.col("label").alias("l" + side)), side)
    return pairs.where("la <> lb")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """key, n_shingles, component_id and kept for each row of ``docs``.

    Rows are linked if their sets have at least ``percent`` of their union in common; component_id is the
    smallest key among the rows that links reach. A row without words (or null) has an empty set and
    is linked with nothing. A null key never names a component: such a row is not kept, and without
    a keyed row in reach its component is null. Rows that repeat a key are all kept if it is their
    component's. Texts of any length are hashed one at a time, and their sets compared whole. Other
    columns are ignored; an empty table gives an empty result. With ``k`` above 100 / ``percent`` of
    the largest set sets are retained whole, and no pair can be missed by chance.
    """
    rows = settle(sketches(docs, key, text, size, k))
    least = F.min(F.struct(F.col("key").isNull(), "key", "mark"))  # nulls last
    classes = rows.where("digest is not null").groupBy("digest").agg(least.alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = settle(classes.select("digest", F.col("least.key").alias("first"), F.col("least.mark").alias("mark"), "n", "sketch").withColumn("id", F.monotonically_increasing_id()))
    labels = _linked(docs, key, text, classes, size, percent, k)
    rooted = classes.select("id", "digest", "first").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rooted = settle(rooted)
    ends = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    named = rooted.join(ends, "label").select("digest", "component_id")
    found = rows.select("key", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return found.select("key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept")).withColumnRenamed("key", key)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents by their pairs of words, at a similarity of 0.8."""
    return near_duplicates(documents(spark, sf_dir), size=2)


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
