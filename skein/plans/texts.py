"""Queries of text functions, search, vectors and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import read_models as R
from ..operators import search as S
from ..operators import signal as M
from ..operators import vectors as L
from ..sources.tables import SEGMENTS, read, segments

QUERY = "the and"


def n3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best lines for two words, by BM25."""
    rows = read(spark, sf_dir, "conversations")
    found = S.search(rows, QUERY, ["conv_id", "turn"])
    return R.page(found.select("conv_id", "turn", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "conv_id", "turn"), R.LIST_ROWS)


def n3_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each term, and how often; summed in the scan's tasks before terms move."""
    rows = read(spark, sf_dir, "documents").select(S.tokens("text").alias("t"))
    each = lambda words, df: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(df).alias("df")))
    words = rows.select(F.explode(F.concat(each(F.array_distinct("t"), 1), each(F.col("t"), 0))).alias("w"))
    return words.groupBy("w.term").agg(F.sum("w.df").alias("df"), F.sum(1 - F.col("w.df")).alias("cf"))


def n4_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.highlighted(F.col("text"), ["the", "de"]).alias("html"))


def n5_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each folded word stands in the conversations."""
    word = F.explode(T.words("text"))
    return read(spark, sf_dir, "conversations").select(word.alias("w")).select(T.fold("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def n6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word of each line of the conversations stands."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.posexplode(T.word_spans("text")).alias("n", "w"))
    return rows.select("conv_id", "turn", "n", "w.start", "w.end", F.md5(F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))).alias("md5"))


def n7_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", T.sounds(T.fold("p_name")).alias("sounds"), T.skeleton(T.fold("p_name")).alias("skeleton"))


def n8_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the nation names that share their first letter."""
    names = read(spark, sf_dir, "part").select(F.upper("p_name").alias("a")).distinct()
    nations = read(spark, sf_dir, "nation").select(F.upper("n_name").alias("b"))
    return names.join(nations, F.substring("a", 1, 1) == F.substring("b", 1, 1)).select("a", "b", T.distance("a", "b").alias("distance"))


def n14_phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.lit("Grazie, a voi!"), F.lit(" Thanks. "), F.lit("Subtitles by the amara.org community"), F.lit("thank you all"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(lines, (F.col("p_partkey") % 4).cast("int")).alias("line"), (F.col("p_size") * 10).alias("voiced_ms"))
    return rows.select("p_partkey", T.is_phantom("line", "voiced_ms").alias("phantom"))


def n15_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_repetitive("text").alias("loops"))


def n16_strip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at their tenth word, the second piece taken with three words too many."""
    rows = segments(spark, sf_dir).withColumn("w", F.split(F.trim("text"), r"\s+")).where("size(w) > 13")
    rows = rows.select("meeting_id", "turn", F.array_join(F.slice("w", 1, 10), " ").alias("head"), F.array_join(F.expr("slice(w, 8, size(w))"), " ").alias("tail"))
    return rows.select("meeting_id", "turn", T.strip_overlap("tail", "head").alias("line"))


def n19_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of lines of up to 2000 characters."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunked("text", 2000)).alias("c"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("c.text")).alias("chars"), F.max(F.length("c.text")).alias("longest"))


def n22_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.when(F.col("event_id") % 10 == 0, "{ Here: ").otherwise("Here: "), "props", F.lit(" done."))
    return read(spark, sf_dir, "events").select("event_id", T.json_object(reply, "k int")["k"].alias("k"))


def n25_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("ms", (F.col("t_end_ms") - 20_000) * 17)
    return rows.select("meeting_id", "turn", T.format_timestamp("ms").alias("at"), T.format_duration("ms").alias("duration"))


def n26_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return rows.select("page_id", T.file_stem("title", F.lit("2026-01-05").cast("date")).alias("stem"))


def n27_contains_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.contains_word("text", "The").alias("the"), T.contains_word("text", "4.0").alias("four"))


def n28_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact("text")).alias("md5"))


def d13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.centroids(read(spark, sf_dir, "embeddings"), ["label"])
    return found.select("label", "i", F.round("x", 6).alias("x"))


def e5_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the centroid of each label: best label, runner-up and verdict."""
    rows = read(spark, sf_dir, "embeddings")
    best = R.top_two(L.best_two(rows, R.centroids(rows, ["label"]), "vec_id", "embedding", "label"), ["vec_id"], "label", "score")
    return best.select("vec_id", "label", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), "verdict")


def l2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to every vector whose id is divisible by 100."""
    rows = read(spark, sf_dir, "embeddings")
    found = L.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the voices of meetings of 200, each of some seconds."""
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("meeting"), "vec_id", "embedding", (F.col("vec_id") % 5 * 1000 + 500).alias("weight"))


def l4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cluster(_meetings(spark, sf_dir), ["meeting"], "vec_id")


def l5_auto_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many speakers as fit each meeting best."""
    return L.cluster(_meetings(spark, sf_dir), ["meeting"], "vec_id", count="auto")


def l6_fixed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four speakers in each meeting, or as many as its voices give."""
    return L.cluster(_meetings(spark, sf_dir), ["meeting"], "vec_id", count=4)


def l7_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("meeting"), "label", "embedding", (F.col("vec_id") % 3 + 1).alias("weight"))
    return L.silhouette(rows, ["meeting"]).select("meeting", F.round("silhouette", 6).alias("silhouette"))


def l13_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as the samples of people, a person for each 1,000 ids."""
    rows = read(spark, sf_dir, "embeddings").withColumn("person", F.floor(F.col("vec_id") / 1000))
    return L.outliers(rows, ["label", "person"], "vec_id", below=0.05, bar=0.9)


def l1_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", L.normalise("embedding").alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


def l14_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors by 1,000 ids as the samples of people; the oldest and most alike beyond 24 go."""
    rows = read(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 1000).alias("person"), "vec_id", "embedding", (F.col("vec_id") % 50).alias("age"), F.when(F.col("vec_id") % 7 == 0, "mic").otherwise("system").alias("condition"))
    return L.evictions(rows, ["label", "person"], "vec_id", "age", "condition")


def m8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector mixed with itself backwards, four times as loud."""
    loud = F.transform("embedding", lambda x: x.cast("double") * 4)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", M.mix(loud, F.reverse(loud)).alias("v"))
    return rows.select("vec_id", F.round(F.array_max(F.transform("v", F.abs)), 6).alias("peak"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def n17_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a noise mark before them, some of nothing else: without marks, and whether anything is left."""
    marked = F.concat(F.lit(T.NOISE[0]), F.when(F.col("turn") % 3 == 0, F.lit(" ... ")).otherwise(F.col("text")))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_noise(marked).alias("line"))
    return rows.select("conv_id", "turn", F.md5("line").alias("md5"), T.is_empty("line").alias("empty"))


def m1_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(M.envelope(F.transform("embedding", lambda x: x.cast("double")), 16, 8)).alias("i", "rms"))
    return rows.select("vec_id", "i", F.round("rms", 7).alias("rms"))


def m4_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as two channels in turn, mixed down and brought from 16 to 24 samples."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", M.resample(M.downmix(F.transform("embedding", lambda x: x.cast("double")), 2), 16, 24).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def _voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as audio of one sample a millisecond, with two spans of speech."""
    at = F.pmod("vec_id", F.lit(8)).cast("long")
    spans = F.array(F.struct(at.alias("s"), (at + 10).alias("e")), F.struct(F.lit(30).cast("long").alias("s"), (at * 5 + 25).alias("e")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), spans.alias("spans"))


def m7_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = _voiced(spark, sf_dir).select("vec_id", M.select_speech("v", F.lit(0), "spans", 24, per_ms=1).alias("v"))
    return speech.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def m10_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as clips, without the quiet ones."""
    rows = _voiced(spark, sf_dir).select("vec_id", "v", F.posexplode("spans").alias("pick", "span"))
    clips = M.clips(rows, "v", "span", per_ms=1, least=0.35)
    return clips.select("vec_id", "pick", F.size("clip").alias("n"))


def m2_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a channel against itself three hops late."""
    late = F.concat(F.array_repeat(F.lit(0.0).cast("float"), 3), "embedding")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", late.alias("mic"), "embedding")
    best = rows.withColumn("b", M.best_lag("mic", "embedding", -8, 8))
    return best.select("vec_id", F.round("b.correlation", 6).alias("correlation"), "b.lag_hops")


_QUERIES = (
    n3_search, n3_postings, n4_highlight, n5_fold, n6_spans, n7_sounds, n8_distance, n14_phantoms, n15_loops, n16_strip_overlap, n19_chunks, n22_json, n25_formats, n26_file_names, n27_contains_word, n28_redact,
    d13_centroids, e5_top_two, l2_nearest, l4_clusters, l5_auto_count, l6_fixed_count, l7_silhouette, l13_outliers, m1_envelope, m2_best_lag, m4_resampled, m7_selected, m10_clips, l1_unit, l14_evictions, m8_mixed, n17_noise,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_FOLDED = f"translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')"
_COORDS = "coords AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_CENTRES = "sums AS (SELECT label, i, sum(v) AS x FROM coords GROUP BY ALL), centres AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM sums)"
_QUIET = "text"
for _mark in T.NOISE:
    _QUIET = "replace({}, '{}', '')".format(_QUIET, _mark.replace("'", "''"))
_BARE = "list_transform(regexp_split_to_array(trim({}), '\\s+'), lambda w: regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
_LOOPS = " OR ".join(f"len(list_filter(range(1, len(w) - {3 * n} + 2), lambda i: w[i:i + {n - 1}] = w[i + {n}:i + {2 * n - 1}] AND w[i:i + {n - 1}] = w[i + {2 * n}:i + {3 * n - 1}])) > 0" for n in range(1, 7))
_STRIPPED = " ".join(f"WHEN len(own) > {n} AND own[1:{n}] = before[{11 - n}:10] THEN array_to_string(raw[{n + 1}:], ' ')" for n in range(6, 1, -1))
_STOCK = ", ".join("'" + x.replace("'", "''") + "'" for x in T.COURTESY)
ORACLE_SQL = {
    "n6_spans": """WITH l AS (SELECT conv_id, turn, regexp_extract_all(text, '([^\\p{L}\\p{N}]*)([\\p{L}\\p{N}](?:[\\p{L}\\p{N}''’._-]*[\\p{L}\\p{N}])?)', 1) AS g, regexp_extract_all(text, '([^\\p{L}\\p{N}]*)([\\p{L}\\p{N}](?:[\\p{L}\\p{N}''’._-]*[\\p{L}\\p{N}])?)', 2) AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(g) AS g, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS n FROM l)
SELECT conv_id, turn, n::INT AS n, md5(w) AS md5, (sum(length(g) + length(w)) OVER o - length(w))::INT AS start, (sum(length(g) + length(w)) OVER o)::INT AS "end" FROM e WINDOW o AS (PARTITION BY conv_id, turn ORDER BY n)""",
    "n3_search": f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+') AS t FROM conversations), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
p AS (SELECT conv_id, turn, len(t) AS dl, unnest(['the', 'and']) AS term, t FROM t), h AS (SELECT *, len(list_filter(t, lambda x: x = term)) AS tf FROM p WHERE list_contains(t, term)),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT conv_id, turn, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM h JOIN d USING (term), s GROUP BY conv_id, turn HAVING count(*) = 2 ORDER BY score DESC, conv_id, turn LIMIT 50""",
    "n3_postings": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "n5_fold": f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}](?:[\\p{{L}}\\p{{N}}''’._-]*[\\p{{L}}\\p{{N}}])?')) AS text FROM conversations)
SELECT regexp_replace({_FOLDED}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word, count(*) AS n FROM w GROUP BY ALL""",
    "n14_phantoms": f"""WITH l AS (SELECT p_partkey, ['grazie a voi', 'thanks', 'subtitles by the amara.org community', 'thank you all'][p_partkey % 4 + 1] AS line, p_size * 10 AS voiced FROM part)
SELECT p_partkey, (line IN ({_STOCK}) OR line LIKE '%subtitles by%') AND voiced < 200 AS phantom FROM l""",
    "l1_unit": f"WITH {_COORDS}, n AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS x FROM coords) SELECT vec_id, round(max(x) FILTER (i = 0), 6) AS first, round(sum(x * x), 6) AS square FROM n GROUP BY vec_id",
    "m8_mixed": """WITH t AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * 4 + embedding[len(embedding) + 1 - i]::DOUBLE * 4) AS v FROM embeddings),
p AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM t) SELECT vec_id, round(least(peak, 1), 6) AS peak, round(CASE WHEN peak > 1 THEN v[1] / peak ELSE v[1] END, 6) AS first FROM p""",
    "n17_noise": f"""WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '...' ELSE trim({_QUIET}) END AS line FROM conversations) SELECT conv_id, turn, md5(line) AS md5, NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS empty FROM l""",
    "m4_resampled": """WITH d AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda i: (embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2) AS v FROM embeddings),
r AS (SELECT vec_id, v, unnest(range(0, greatest(round(len(v) * 1.5), 1)::BIGINT)) AS k FROM d), p AS (SELECT vec_id, floor(k / 1.5)::BIGINT AS lo, k / 1.5 - floor(k / 1.5) AS f, v FROM r)
SELECT vec_id, count(*)::INT AS n, round(sum(v[lo + 1] + (coalesce(v[lo + 2], v[lo + 1]) - v[lo + 1]) * f), 5) AS total FROM p GROUP BY vec_id""",
    "m7_selected": """WITH p AS (SELECT vec_id, (CASE WHEN vec_id % 8 * 5 + 25 > 30 THEN embedding[vec_id % 8 + 1:vec_id % 8 + 10] || embedding[31:vec_id % 8 * 5 + 25] ELSE embedding[vec_id % 8 + 1:vec_id % 8 + 10] END)[1:24] AS v FROM embeddings)
SELECT vec_id, len(v)::INT AS n, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 5) AS total FROM p""",
    "m10_clips": """WITH p AS (SELECT vec_id, 0 AS pick, embedding[vec_id % 8 + 1:vec_id % 8 + 10] AS v FROM embeddings UNION ALL SELECT vec_id, 1, CASE WHEN vec_id % 8 * 5 + 25 > 30 THEN embedding[31:vec_id % 8 * 5 + 25] ELSE [] END FROM embeddings)
SELECT vec_id, pick::INT AS pick, len(v)::INT AS n FROM p WHERE list_max(list_transform(v, lambda x: abs(x::DOUBLE))) >= 0.35""",
    "n15_loops": f"WITH t AS (SELECT conv_id, turn, list_filter({_BARE.format('text')}, lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, len(w) >= 4 AND ({_LOOPS}) AS loops FROM t",
    "n16_strip_overlap": f"""WITH {SEGMENTS}, w AS (SELECT meeting_id, turn, regexp_split_to_array(trim(text), '\\s+') AS w, {_BARE.format('text')} AS b FROM segments),
p AS (SELECT meeting_id, turn, w[8:] AS raw, b[8:] AS own, b[1:10] AS before FROM w WHERE len(w) > 13)
SELECT meeting_id, turn, CASE {_STRIPPED} ELSE array_to_string(raw, ' ') END AS line FROM p""",
    "n28_redact": f"SELECT doc_id, md5(replace(regexp_replace(text, '(?i)({'|'.join(T.SENSITIVE)})([=: ]*)[^\\r\\n=: ][^\\r\\n]*', '\\1\\2<redacted>', 'g'), '/home/me', '~')) AS md5 FROM documents",
    "l7_silhouette": f"""WITH {_COORDS}, m AS (SELECT vec_id, vec_id % 5 AS meeting, label, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS x, vec_id % 3 + 1 AS w FROM coords),
s AS (SELECT meeting, label, i, sum(x * w) AS t FROM m GROUP BY ALL), n AS (SELECT meeting, label, count(DISTINCT vec_id) AS members FROM m GROUP BY ALL),
d AS (SELECT m.meeting, vec_id, m.label, s.label AS other, any_value(w) AS w, 1 - sum(x * (t - CASE WHEN s.label = m.label THEN x * w ELSE 0 END)) / greatest(sqrt(sum((t - CASE WHEN s.label = m.label THEN x * w ELSE 0 END) ** 2)), 1e-12) AS far
  FROM m JOIN s ON s.meeting = m.meeting AND s.i = m.i GROUP BY ALL),
p AS (SELECT meeting, vec_id, label, any_value(w) AS w, max(least(greatest(far, 0), 2)) FILTER (other = label) AS a, min(least(greatest(far, 0), 2)) FILTER (other <> label) AS b FROM d GROUP BY ALL)
SELECT meeting, round(sum(CASE WHEN members = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END * w) / sum(w), 6) AS silhouette FROM p JOIN n USING (meeting, label) GROUP BY meeting""",
    "n22_json": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract(props, '$.k')::INT END AS k FROM events",
    "n25_formats": f"""WITH {SEGMENTS}, m AS (SELECT meeting_id, turn, (t_end_ms - 20000) * 17 AS ms, greatest((t_end_ms - 20000) * 17, 0) // 1000 AS s FROM segments)
SELECT meeting_id, turn, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS at,
  CASE WHEN ms <= 0 THEN NULL WHEN ms >= 3600000 THEN printf('%d hr %d min', ms // 3600000, ms // 60000 % 60) ELSE printf('%d min', ms // 60000) END AS duration FROM m""",
    "n26_file_names": """WITH t AS (SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[^A-Za-z0-9 _-]', '-', 'g')), '^-+|-+$', '', 'g')) AS t FROM pages)
SELECT page_id, '2026-01-05 ' || trim(left(CASE WHEN t = '' THEN 'Meeting' ELSE t END, 60)) AS stem FROM t""",
    "n27_contains_word": "SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the($|[^\\p{L}\\p{N}])') AS the, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])4\\.0($|[^\\p{L}\\p{N}])') AS four FROM documents",
    "d13_centroids": f"WITH {_COORDS}, {_CENTRES} SELECT label, i::INT AS i, round(x, 6) AS x FROM centres",
    "e5_top_two": f"""WITH {_COORDS}, {_CENTRES}, norms AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM coords GROUP BY vec_id),
scores AS (SELECT vec_id, c.label, round(sum(v * x) / any_value(norm), 6) AS score FROM coords JOIN centres c USING (i) JOIN norms USING (vec_id) GROUP BY vec_id, c.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM scores),
top AS (SELECT vec_id, max(label) FILTER (r = 1) AS label, max(score) FILTER (r = 1) AS best, greatest(coalesce(max(score) FILTER (r = 2), 0), 0) AS second FROM ranked GROUP BY vec_id)
SELECT vec_id, label, round(best, 6) AS best, round(second, 6) AS second, CASE WHEN best - second < 0.12 THEN 'none' WHEN best >= 0.78 THEN 'strong' WHEN best >= 0.64 THEN 'link' WHEN best >= 0.52 THEN 'suggest' ELSE 'none' END AS verdict FROM top""",
    "l2_nearest": f"""WITH {_COORDS}, norms AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM coords GROUP BY vec_id), q AS (SELECT * FROM coords WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query, c.vec_id, sum(q.v * c.v) AS dot FROM q JOIN coords c USING (i) WHERE q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query, s.vec_id, round(dot / (a.norm * b.norm), 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY dot / (a.norm * b.norm) DESC, s.vec_id)::INT AS rank
FROM s JOIN norms a ON a.vec_id = query JOIN norms b ON b.vec_id = s.vec_id QUALIFY rank <= 5""",
    "m1_envelope": """WITH w AS (SELECT vec_id, embedding, unnest(range(0, (len(embedding) - 16) // 8 + 1)) AS i FROM embeddings)
SELECT vec_id, i::INT AS i, round(sqrt(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 16], lambda x: x::DOUBLE * x)) / 16), 7) AS rms FROM w""",
}
