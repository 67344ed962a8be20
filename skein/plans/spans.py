"""Queries of the interval algebra over the events as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import vectors as L
from ..sources.tables import SPANS, spans

DAY = 86_400_000
BEGIN = 1_704_067_200_000  # 2024-01-01
GAP = 600_000


def _track(rows: DataFrame, *names: str) -> DataFrame:
    return rows.where(F.col("track").isin(*names))


def i2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge(spans(spark, sf_dir), ["key"], GAP)


def i3_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return I.subtract(_track(rows, "view"), _track(rows, "click", "error"), ["key"]).select("event_id", "key", "s", "e")


def i4_long_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drop_short(I.merge(spans(spark, sf_dir), ["key"]), 3_600_000)


def i5_most_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return I.most_overlap(_track(rows, "view"), rows.where("track <> 'view'"), ["key"], ["event_id"])


def i6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return I.nearest(_track(rows, "purchase"), rows.where("track <> 'purchase'"), ["key"], ["event_id"], tolerance=3_600_000)


def i7_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return I.untouched(_track(rows, "error"), rows.where("track <> 'error'"), ["key"], max_gap=GAP)


def i8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    weighted = _track(rows, "view").withColumn("weight", F.pmod("event_id", F.lit(8)) / 4)
    return I.covered(_track(rows, "click"), weighted, ["key"], ["event_id"])


def i9_shared_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.shared_time(spans(spark, sf_dir), ["key"])


def i10_elementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.elementary(spans(spark, sf_dir), ["key"])


def i11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.elementary(spans(spark, sf_dir), ["key"]).withColumn("day", F.floor(F.col("s") / DAY))
    return I.collapse_runs(lines, ["key", "day"], least=900_000)


def i12_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return I.holes(_track(rows, "view", "click"), _track(rows, "purchase"), _track(rows, "error"), ["key"], BEGIN + 2 * DAY, BEGIN + 20 * DAY)


def i13_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.tidy(spans(spark, sf_dir).select("event_id", "key", "s", "e"), BEGIN + 5 * DAY, BEGIN + 10 * DAY, 60_000)
    return rows


def i14_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.packs(spans(spark, sf_dir), ["key"], 12 * 3_600_000)
    return found.groupBy("key", "pack").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def i16_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.alone(spans(spark, sf_dir), ["key"])


def e4_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return I.placed(_track(rows, "view").where("e - s >= 3600000"), rows.where("track <> 'view'"), ["key"], ["event_id"], 1_800_000, 300_000)


def l11_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a user matched with the same user's tracks by shared time, each once."""
    return L.matched(I.shared_time(spans(spark, sf_dir), ["key"]), ["key"], "track", "track_b", "shared_ms")


def h3_island_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that each user is active in, over islands."""
    return I.merge(spans(spark, sf_dir), ["key"], GAP).groupBy("key").agg(F.count("*").alias("islands"), F.sum(I.length()).alias("active_ms"), F.max(I.length()).alias("longest_ms"))


QUERIES = {f.__name__: f for f in (i2_merge, i3_subtract, i4_long_islands, i5_most_overlap, i6_nearest, i7_untouched, i8_covered, i9_shared_time, i10_elementary, i11_runs, i12_holes, i13_tidy, i14_packs, i16_alone, e4_placement, l11_assignment, h3_island_of_each)}


def _merged(name: str, source: str, key: str, max_gap: int = 0) -> str:
    return f"""{name} AS (
  SELECT {key}, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {max_gap} THEN 0 ELSE 1 END AS opens
      FROM ({source}) WHERE e > s)) GROUP BY {key}, island)"""


_SHARED = "least(a.e, b.e) - greatest(a.s, b.s)"


def _pieces(spans_sql: str, holes: str) -> str:
    """Pieces of the spans between merged holes: each hole end (or the start) to the next hole start (or the end)."""
    return f"""SELECT id, key, f AS s, t AS e FROM (
    SELECT a.id, a.key, a.s AS f, coalesce((SELECT min(h.s) FROM {holes} h WHERE h.key = a.key AND h.s >= a.s AND h.s < a.e), a.e) AS t FROM ({spans_sql}) a
      WHERE NOT EXISTS (SELECT 1 FROM {holes} h WHERE h.key = a.key AND h.s <= a.s AND h.e > a.s)
    UNION ALL
    SELECT a.id, a.key, b.e, coalesce((SELECT min(h.s) FROM {holes} h WHERE h.key = a.key AND h.s >= b.e AND h.s < a.e), a.e) FROM ({spans_sql}) a JOIN {holes} b ON a.key = b.key AND b.e > a.s AND b.e < a.e
  ) WHERE t > f"""


_VIEWS = "SELECT event_id AS id, * FROM spans WHERE track = 'view' AND e > s"
ORACLE_SQL = {
    "i2_merge": f"WITH {SPANS}, {_merged('m', 'SELECT * FROM spans', 'key', GAP)} SELECT * FROM m",
    "i3_subtract": f"WITH {SPANS}, {_merged('holes', "SELECT * FROM spans WHERE track IN ('click', 'error')", 'key')} SELECT id AS event_id, key, s, e FROM ({_pieces(_VIEWS, 'holes')})",
    "i4_long_islands": f"WITH {SPANS}, {_merged('m', 'SELECT * FROM spans', 'key')} SELECT * FROM m WHERE e - s >= 3600000",
    "i5_most_overlap": f"""WITH {SPANS}, shared AS (
  SELECT a.key, a.event_id, b.track, sum({_SHARED})::BIGINT AS shared_ms FROM spans a JOIN spans b ON a.key = b.key AND a.s < b.e AND b.s < a.e
  WHERE a.track = 'view' AND b.track <> 'view' GROUP BY ALL)
SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY key, event_id ORDER BY shared_ms DESC, track) = 1""",
    "i6_nearest": f"""WITH {SPANS} SELECT a.key, a.event_id, b.track, greatest(0, greatest(a.s, b.s) - least(a.e, b.e)) AS gap_ms
FROM spans a JOIN spans b ON a.key = b.key AND b.s - a.e <= 3600000 AND a.s - b.e <= 3600000 WHERE a.track = 'purchase' AND b.track <> 'purchase'
QUALIFY row_number() OVER (PARTITION BY a.key, a.event_id ORDER BY greatest(0, greatest(a.s, b.s) - least(a.e, b.e)), b.track) = 1""",
    "i7_untouched": f"WITH {SPANS}, {_merged('m', "SELECT * FROM spans WHERE track = 'error'", 'key', GAP - 1)} SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.key = a.key AND b.track <> 'error' AND a.s < b.e AND b.s < a.e)",
    "i8_covered": f"""WITH {SPANS} SELECT a.key, a.event_id, least(round(sum(({_SHARED}) * ((b.event_id % 8) / 4.0::DOUBLE)))::BIGINT, any_value(a.e - a.s)) AS covered_ms
FROM spans a JOIN spans b ON a.key = b.key AND a.s < b.e AND b.s < a.e WHERE a.track = 'click' AND b.track = 'view' GROUP BY a.key, a.event_id""",
    "i9_shared_time": f"WITH {SPANS}, {_merged('m', 'SELECT * FROM spans', 'key, track')} SELECT a.key, a.track, b.track AS track_b, sum({_SHARED})::BIGINT AS shared_ms FROM m a JOIN m b ON a.key = b.key AND a.track < b.track AND a.s < b.e AND b.s < a.e GROUP BY ALL",
    "i10_elementary": f"""WITH {SPANS}, points AS (SELECT key, s AS p FROM spans UNION SELECT key, e FROM spans),
parts AS (SELECT key, p AS s, lead(p) OVER (PARTITION BY key ORDER BY p) AS e FROM points QUALIFY e IS NOT NULL),
claims AS (SELECT a.key, a.s, a.e, count(DISTINCT b.track) AS claimants, min(b.track) AS first FROM parts a JOIN spans b ON a.key = b.key AND a.s < b.e AND b.s < a.e GROUP BY ALL)
SELECT key, s, e, claimants, coalesce(CASE WHEN claimants = 1 THEN first END,
  last_value(CASE WHEN claimants = 1 THEN first END IGNORE NULLS) OVER (PARTITION BY key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first) AS owner FROM claims""",
    "i12_holes": f"""WITH {SPANS}, {_merged('audio', "SELECT * FROM spans WHERE track IN ('view', 'click')", 'key')}, {_merged('done', "SELECT * FROM spans WHERE track IN ('purchase', 'error')", 'key')},
clipped AS (SELECT row_number() OVER () AS id, key, greatest(s, {BEGIN + 2 * DAY}) AS s, least(e, {BEGIN + 20 * DAY}) AS e FROM audio WHERE least(e, {BEGIN + 20 * DAY}) > greatest(s, {BEGIN + 2 * DAY}))
SELECT key, s, e FROM ({_pieces('SELECT * FROM clipped', 'done')}) WHERE e - s >= 250""",
    "i13_tidy": f"""WITH {SPANS}, c AS (SELECT event_id, key, least(greatest(s, {BEGIN + 5 * DAY}), {BEGIN + 10 * DAY}) AS s, least(greatest(e, {BEGIN + 5 * DAY}), {BEGIN + 10 * DAY}) AS e FROM spans),
w AS (SELECT event_id, key, s, CASE WHEN e <= s THEN least(s + 60000, {BEGIN + 10 * DAY}) ELSE e END AS e FROM c) SELECT * FROM w WHERE e - s >= 60000""",
    "i16_alone": f"""WITH {SPANS}, {_merged('m', 'SELECT * FROM spans', 'key, track')}, ids AS (SELECT *, row_number() OVER () AS id FROM m),
points AS (SELECT id, a.key, a.track, a.s AS f, a.e AS t FROM ids a),
cuts AS (SELECT a.id, a.key, a.track, unnest(list_sort(list_distinct(list_concat([a.s, a.e], coalesce((SELECT list(p) FROM (SELECT b.s AS p FROM m b WHERE b.key = a.key AND b.track <> a.track AND b.s > a.s AND b.s < a.e
  UNION SELECT b.e FROM m b WHERE b.key = a.key AND b.track <> a.track AND b.e > a.s AND b.e < a.e)), []))))) AS p FROM ids a),
parts AS (SELECT id, key, track, p AS s, lead(p) OVER (PARTITION BY id ORDER BY p) AS e FROM cuts)
SELECT key, track, sum(e - s)::BIGINT AS alone_ms FROM parts a WHERE e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m b WHERE b.key = a.key AND b.track <> a.track AND b.s < a.e AND a.s < b.e)
GROUP BY key, track HAVING sum(e - s) >= 1000""",
    "e4_placement": f"""WITH {SPANS}, {_merged('busy', "SELECT * FROM spans WHERE track <> 'view'", 'key')}, v AS (SELECT * FROM spans WHERE track = 'view' AND e - s >= 3600000),
w AS (SELECT event_id, key, s, e, unnest(range(s, e - 1800000 + 1, 300000)) AS ws FROM v),
o AS (SELECT w.event_id, w.key, ws, any_value(abs(2 * ws + 1800000 - w.s - w.e)) AS shift, coalesce(sum(least(ws + 1800000, b.e) - greatest(ws, b.s)) FILTER (b.key IS NOT NULL), 0) AS ms
  FROM w LEFT JOIN busy b ON b.key = w.key AND b.s < ws + 1800000 AND ws < b.e GROUP BY ALL)
SELECT key, event_id, ws AS window_s, ws + 1800000 AS window_e FROM o QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ms, shift, ws) = 1""",
    "h3_island_of_each": f"WITH {SPANS}, {_merged('m', 'SELECT * FROM spans', 'key', GAP)} SELECT key, count(*) AS islands, sum(e - s)::BIGINT AS active_ms, max(e - s) AS longest_ms FROM m GROUP BY key",
}
