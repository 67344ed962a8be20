"""The trie of conversation prefixes, and what keeping each shared prefix once would save.

A node is a distinct sequence of first turns; the conversations that begin with it are its members, and
the smallest member owns it. Members grow fewer along a path, so what a conversation owns is a suffix of
its path, from one depth on. That depth alone, kept for each conversation, says which of its turns are
copies: the turns above it. A node's saved tokens are then the copied turns of all members below it,
occurrences minus owned ones, and its leaves and children are flags of its members; all are plain sums
of one grouping by node, with partial sums before the shuffle, so a node that every conversation has
(the root) is no hot group.

Texts don't move: a turn is its SHA-256 digest and length before anything is shuffled, and a node is the
digest of its parent's digest and its last turn's. Conversations stream through their task sorted, a few
digests at a time. A node's list of ended members is sorted by ranges of (node, member), so a hot node's
list is cut over tasks into pieces of bounded size, which are hashed in order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pa_types, settle, small_batches

#: Turns that a conversation can take over from the first one of its group, and the group's size.
SHARED, GROUP = 8, 5
ROOT = hashlib.sha256(b"").digest()
#: Bytes of a piece of a list of members.
PIECE = 1 << 16
PATHS = "conv_id long, depth long, node binary, parent binary, tokens long, last boolean"


def _streamed(df: DataFrame, schema: str, make) -> DataFrame:
    """``df`` through ``make()``, a generator function from an iterator of row tuples to row tuples, one for each task."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    types = pa_types(kind)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, room = [], 0
        for row in make(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            out.append(row)
            room += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if room > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=kind.names)
                out, room = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=kind.names)

    return df.mapInArrow(run, kind)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, rank, turn digest, length in bytes) sorted so that each group's first conversation leads its group.

    Turns are in order of ``turn``, null first; equal ones in order of the turn's digest. Rows without
    a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lead"), "conv_id", "turn", turn.alias("digest"), F.octet_length(text).cast("long").alias("tokens")
    )
    return rows.repartition("lead").sortWithinPartitions("lead", F.col("conv_id") != F.col("lead"), "conv_id", F.col("turn").asc_nulls_first(), "digest").drop("turn")


def paths(conversations: DataFrame) -> DataFrame:
    """A row for each node on each rebuilt conversation's path: conv_id, depth, node, parent, tokens of the last turn, last.

    ``node`` is a digest, ``parent`` is null at the root, ``last`` says that the conversation ends there.
    """

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        lead = conv = held = None
        first: list[tuple] = []  # the first turns of the group's first conversation
        for group, key, digest, tokens in rows:
            if group != lead:
                lead, first = group, []
            if key != conv:
                if held:
                    yield (*held, True)
                conv, place, head = key, 0, zlib.crc32(str(key).encode()) % (SHARED + 1)
                held = (key, 0, ROOT, None, 0)
                for turn, size in first[:head] if key != lead else ():
                    yield (*held, False)
                    held = (key, held[1] + 1, hashlib.sha256(held[2] + turn).digest(), held[2], size)
            if key == lead and place < SHARED:
                first.append((digest, tokens))
            if key == lead or place >= head:
                yield (*held, False)
                held = (key, held[1] + 1, hashlib.sha256(held[2] + digest).digest(), held[2], tokens)
            place += 1
        if held:
            yield (*held, True)

    return _streamed(rebuilt(conversations), PATHS, walk)


def _ends(found: DataFrame) -> DataFrame:
    """node and the SHA-256 of its ended members' ids, in order, joined by commas."""
    ended = found.where("last").select("node", "conv_id")
    dealt = ended.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        node, ids, size, start = None, [], 0, 0
        for name, key in rows:
            if name != node or size > PIECE:
                if ids:
                    yield node, start, ",".join(ids)
                node, ids, size, start = name, [], 0, key
            ids.append(str(key))
            size += len(ids[-1]) + 1
        if ids:
            yield node, start, ",".join(ids)

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        node = state = None
        for name, _, piece in rows:
            if name != node:
                if state:
                    yield node, state.hexdigest()
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if state:
            yield node, state.hexdigest()

    cut = _streamed(dealt, "node binary, start long, piece string", pieces)
    return _streamed(cut.repartition("node").sortWithinPartitions("node", "start"), "node binary, ends_sha256 string", hashed)


def _owners(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """``of`` with ``above``, the owner of its node ``parent``.

    Parents with more than a thousandth of all rows are at most a thousand: those go by broadcast, the others by a shuffle.
    """
    many = of.count() // 1000
    hot = settle(of.groupBy("parent").count().where(F.col("count") > many).join(nodes, F.col("parent") == F.col("node")).select("parent", F.col("owner").alias("above")))
    met = of.join(F.broadcast(hot), "parent", "left")
    rest = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("above_"))
    other = met.where("above is null").join(rest, "parent", "left").withColumn("above", F.col("above_")).drop("above_")
    return met.where("above is not null").unionByName(other)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations, the empty one included.

    Columns: conv_id (smallest member; with depth it names the node), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (UTF-8 bytes stand for tokens), ends_sha256. Null roles and texts
    are empty. Rows without conv_id are left out; repeated rows are turns of their own. No
    conversation, no node. A text of any length is hashed where it lies. A conversation of any length
    streams through one task; other columns are ignored, whatever their names.
    """
    found = settle(paths(conversations))
    nodes = settle(found.groupBy("node").agg(F.min(F.struct("conv_id", "depth", "parent")).alias("top"), F.min("last").alias("leaf")).select("node", F.col("top.conv_id").alias("owner"), "top.depth", "top.parent", "leaf"))
    # what each conversation owns: from which depth, below whose node, and whether a leaf
    owned = nodes.groupBy("owner").agg(F.min(F.struct("depth", "parent")).alias("top"), F.max("leaf").alias("leaf"))
    owned = settle(owned.select(F.col("owner").alias("conv_id"), F.col("top.depth").alias("since"), "top.parent", "leaf"))
    marks = _owners(owned, nodes.select("node", "owner")).drop("parent")

    own: Column = F.coalesce(F.col("depth") >= F.col("since"), F.lit(False))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = found.join(marks, "conv_id", "left").withColumn("own", own)
    marked = marked.withColumn("copied", F.sum(F.when(F.col("own"), 0).otherwise(F.col("tokens"))).over(below))
    child = ~F.col("last") & F.coalesce(F.col("depth") + 1 >= F.col("since"), F.lit(False))
    first = F.struct("conv_id", "depth", F.when(F.col("depth") > F.col("since"), F.col("conv_id")).otherwise(F.col("above")).alias("parent"))
    summed = marked.groupBy("node").agg(
        F.min(first).alias("top"), F.count(F.lit(1)).alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.coalesce(F.col("leaf"), F.lit(False)).cast("long")).alias("n_leaves"), F.sum("copied").alias("saved_tokens"),
    )
    out = summed.join(_ends(found), "node", "left")
    return out.select(
        "top.conv_id", "top.depth", F.col("top.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ' ' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: list_concat([ascii(c)], list_transform(range(8), lambda b: -1)))), lambda x: CASE WHEN x < 0 THEN 1000::UBIGINT ELSE x::UBIGINT END)),
    lambda crc, x: CASE WHEN x < 1000 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384::UBIGINT * (crc & 1)) END), 4294967295::UBIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT h.conv_id, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, 1000 + t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS tokens,
    list(sha256(strlen(role)::VARCHAR || ' ' || role || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), members AS (
  SELECT conv_id, 0::BIGINT AS depth, 0::BIGINT AS tokens, []::VARCHAR[] AS path FROM heads UNION ALL SELECT * FROM steps
), lengths AS (
  SELECT conv_id, max(depth) AS n FROM members GROUP BY conv_id
), nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(tokens) AS tokens, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = any_value(depth) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY path
), children AS (
  SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT u.path[:d] AS path, sum(u.leaf::INT) AS n_leaves, sum((u.n_convs - 1) * u.tokens) AS saved_tokens
  FROM nodes u, range(u.depth + 1) AS r(d) GROUP BY 1
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b USING (path) LEFT JOIN children c USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[:v.depth - 1]
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL = {"op12_prefix_trie": _SQL}
