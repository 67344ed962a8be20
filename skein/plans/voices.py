"""Queries of attribution: labels of windows, known people first, and whose line is whose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import people as Q
from ..operators import read_models as R
from ..operators import spectrum as P
from ..sources.tables import SEGMENTS, read, segments


def l12_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as unnamed prints of meetings of ten, grouped one after another."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).alias("meeting"), "embedding")
    return Q.voice_groups(rows, "vec_id", "vec_id", "meeting")


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as people's samples, a person for each label and 1,000 ids, and odd labels merged into the one before."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", (F.floor(F.col("vec_id") / 1000) * 100 + F.col("label")).alias("person"), "embedding", (F.col("vec_id") % 50).alias("age"), F.when(F.col("vec_id") % 7 == 0, "mic").otherwise("system").alias("condition"))
    gone = rows.select(F.col("person").alias("gone")).where("gone % 2 = 1").distinct()
    return rows, gone.withColumn("into", F.col("gone") - 1)


def l15_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that are left after every third came as news, odd people were merged, and all were curated."""
    rows, merges = _samples(spark, sf_dir)
    kept, _ = Q.learned(rows.where("vec_id % 3 <> 0"), rows.where("vec_id % 3 = 0"), merges, "vec_id", "age", "condition")
    return kept.select("person", "vec_id")


def l16_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each person after the merge, and the first number of the new centre."""
    rows = Q.merged(*_samples(spark, sf_dir))
    centres = R.centroids(rows, ["person"]).where("i = 0").select("person", F.round("x", 6).alias("x"))
    return rows.groupBy("person").agg(F.count("*").alias("samples")).join(centres, "person")


def l17_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as windows of three local voices, some with a print, most continuing another one."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("local"), "l_suppkey", "l_quantity").where("local < 3")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key"), F.floor(F.col("o_orderkey") / 4).alias("w"))
    rows = items.join(orders, "l_orderkey").groupBy("key", "w", "local").agg(F.min(F.struct("l_orderkey", "l_suppkey", "l_quantity")).alias("x"))
    q = F.col("x.l_quantity").cast("long")
    rows = rows.select("key", F.dense_rank().over(A.Window.partitionBy("key").orderBy("w")).cast("long").alias("w"), F.col("local").cast("long").alias("local"), F.when(q % 3 == 0, F.col("x.l_suppkey")).alias("label"), (q % 7 != 0).alias("active"), F.when(q % 5 != 0, q % 3).alias("continues"))
    return A.window_labels(rows, ["key"])


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as prints of meetings of 200, and the centres of the even labels as known people."""
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("meeting"), "vec_id", "embedding", (F.col("vec_id") % 5 * 1000 + 500).alias("weight"))
    return rows, R.centroids(read(spark, sf_dir, "embeddings").where("label % 2 = 0").withColumnRenamed("label", "person"), ["person"])


def l10_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.seeds(*_known(spark, sf_dir), ["meeting"], "vec_id")


def l10_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prints: the known person, or the cluster among strangers."""
    return A.guided(*_known(spark, sf_dir), ["meeting"], "vec_id")


def _voices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines, and turns of three voices beneath them: each line is one voice's, or in every fourth turn two voices', and some are nobody's."""
    lines = segments(spark, sf_dir).select("meeting_id", "turn", F.col("t_start_ms").alias("s"), F.col("t_end_ms").alias("e"), "channel", "text", "confidence")
    half = (F.col("s") + (F.col("e") - F.col("s")) * 6 / 10).cast("long")
    first = lines.where("turn % 6 <> 5").select("meeting_id", (F.col("turn") % 3).alias("track"), F.col("s") - 100, F.when(F.col("turn") % 4 == 1, half).otherwise(F.col("e")))
    second = lines.where("turn % 4 = 1").select("meeting_id", ((F.col("turn") + 1) % 3).alias("track"), half, F.col("e") + 50)
    turns = first.toDF("meeting_id", "track", "s", "e").unionByName(second.toDF("meeting_id", "track", "s", "e"))
    return lines, turns.withColumn("confidence", 0.6 + F.col("track") * 0.1)


def l18_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line or piece of one and whose it is."""
    found = A.attributed(*_voices(spark, sf_dir), ["meeting_id"], "turn")
    return found.select("meeting_id", "turn", "piece", "s", "e", F.md5("text").alias("md5"), "track", "speaker")


def n18_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are cut where the voice changes, on whichever channel."""
    lines, turns = _voices(spark, sf_dir)
    found = A.split_lines(lines, turns, ["meeting_id"], "turn").where(F.size("pieces") > 0)
    return found.select("meeting_id", "turn", F.posexplode("pieces").alias("piece", "p")).select("meeting_id", "turn", "piece", "p.s", "p.e", "p.track", F.md5("p.text").alias("md5"))


def m5_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label as one recording in parts of eight: energies of the first, middle and last band."""
    place = F.row_number().over(A.Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = read(spark, sf_dir, "embeddings").select("label", "vec_id", place.alias("i"), "embedding")
    parts = rows.groupBy("label", F.floor(F.col("i") / 8).alias("part")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "embedding"))), lambda x: x["embedding"])).alias("samples"))
    size = F.max(F.size("samples")).over(A.Window.partitionBy("label"))
    found = P.filterbank(parts.withColumn("n", F.col("part") * size), ["label"])
    return found.select("label", "frame", *[F.round(F.get("mel", F.lit(i)), 3).alias(f"band{i}") for i in (0, 40, 79)])


def m6_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as windows of frames of seven classes: turns of three speakers."""
    frames = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 7).cast("int") - 1), lambda i: F.slice("embedding", i * 7 + 1, 7))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", frames.alias("logits"), (F.col("vec_id") * 5000).alias("start_ms"), F.lit(3000).alias("window_ms"))
    return P.tracks(rows, ["vec_id"], 7)


_QUERIES = (m5_filterbank, m6_tracks, l10_guided, l10_seeds, l12_groups, l15_learned, l16_merged, l17_labels, l18_attributed, n18_split)
QUERIES = {f.__name__: f for f in _QUERIES}

ORACLE_SQL = {
    "l16_merged": """WITH p AS (SELECT vec_id, vec_id // 1000 * 100 + label AS was, embedding FROM embeddings), m AS (SELECT vec_id, was - was % 2 AS person, embedding FROM p),
c AS (SELECT person, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM m), s AS (SELECT person, i, sum(v) AS x FROM c GROUP BY ALL),
u AS (SELECT person, i, x / sqrt(sum(x * x) OVER (PARTITION BY person)) AS x FROM s)
SELECT person, samples, round(x, 6) AS x FROM u JOIN (SELECT person, count(*) AS samples FROM m GROUP BY person) USING (person) WHERE i = 0""",
    "m6_tracks": """WITH w AS (SELECT vec_id, embedding AS v, len(embedding) // 7 AS n, unnest(range(len(embedding) // 7)) AS f FROM embeddings), r AS (SELECT vec_id, n, f, v[f * 7 + 1:f * 7 + 7] AS row FROM w),
b AS (SELECT vec_id, n, f, unnest([[]::INT[], [0], [1], [2], [0, 1], [0, 2], [1, 2]][8 - list_position(list_reverse(row), list_max(row))]) AS local FROM r),
g AS (SELECT *, f - row_number() OVER (PARTITION BY vec_id, local ORDER BY f) AS run FROM b),
s AS (SELECT vec_id, local, vec_id * 5000 + round(min(f) * (3000 / any_value(n)))::BIGINT AS s, vec_id * 5000 + round((max(f) + 1) * (3000 / any_value(n)))::BIGINT AS e FROM g GROUP BY vec_id, local, run),
o AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY vec_id, local ORDER BY s) <= 200 THEN 0 ELSE 1 END AS opens FROM s),
i AS (SELECT *, sum(opens) OVER (PARTITION BY vec_id, local ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT vec_id, local, min(s) AS s, max(e) AS e FROM i GROUP BY vec_id, local, island HAVING max(e) - min(s) >= 200""",
    "l17_labels": """WITH RECURSIVE i AS (SELECT o_custkey AS key, o_orderkey // 4 AS w, l_linenumber - 1 AS local, min((l_orderkey, l_suppkey, l_quantity)) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 3 GROUP BY ALL),
r AS (SELECT key, dense_rank() OVER (PARTITION BY key ORDER BY w) AS w, local::BIGINT AS local, x[2] AS supp, x[3]::BIGINT AS q FROM i),
v AS (SELECT key, w, local, CASE WHEN q % 3 = 0 THEN supp END AS label, q % 7 <> 0 AS active, CASE WHEN q % 5 <> 0 THEN q % 3 END AS continues FROM r),
f AS (SELECT key, w, local, label FROM v WHERE label IS NOT NULL
  UNION ALL SELECT v.key, v.w, v.local, f.label FROM f JOIN v ON v.key = f.key AND v.w = f.w + 1 AND v.continues = f.local WHERE v.label IS NULL AND v.active)
SELECT v.key, v.w, v.local, f.label FROM v LEFT JOIN f USING (key, w, local)""",
    "l10_seeds": """WITH coords AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
sums AS (SELECT label AS person, i, sum(v) AS x FROM coords WHERE label % 2 = 0 GROUP BY ALL), centres AS (SELECT person, i, x / sqrt(sum(x * x) OVER (PARTITION BY person)) AS x FROM sums),
norms AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM coords GROUP BY vec_id),
scores AS (SELECT vec_id, person, round(sum(v * x) / any_value(norm), 6) AS score FROM coords JOIN centres USING (i) JOIN norms USING (vec_id) GROUP BY vec_id, person),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, person) AS r FROM scores),
top AS (SELECT vec_id, max(person) FILTER (r = 1) AS person, max(score) FILTER (r = 1) AS best, greatest(coalesce(max(score) FILTER (r = 2), 0), 0) AS second FROM ranked GROUP BY vec_id),
strong AS (SELECT vec_id // 200 AS meeting, vec_id, person, vec_id % 5 * 1000 + 500 AS ms FROM top WHERE best >= 0.78 AND best - second >= 0.12)
SELECT meeting, vec_id, person FROM strong QUALIFY sum(ms) OVER (PARTITION BY meeting, person) >= 3000""",
}
