"""Queries of the stateful operators, over the events in order; tests hold them against the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import SEGMENTS, read, segments, spans
from ..streaming import windows as W
from ..streaming.fold import fold
from ..operators import signal as M
from ..streaming.machines import AdaptiveLag, Detection, LanguageVote, LoudnessGate, MeetingDetector, OpenSpeech, VoiceSessions


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", "value"), "event_id")


def j3_voice_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speech windows: sessions of a user with at most a day between events."""
    rows = _ordered(spark, sf_dir).select("key", F.col("s").alias("t"), F.least(F.col("value") / 60, F.lit(1.0)).alias("p"), "event_id")
    day = 86_400_000
    machine = VoiceSessions(window=60_000, needs=2, pre=600_000, pad=600_000, tail=day // 2, least=3_600_000, most=5 * day, jump=day, search=1_200_000, pause=120_000, overlap=300_000)
    return fold(rows, ["key"], ["t", "event_id"], machine)


#: Short sessions, so that a user's few dozen events are cut and closed.
_SHORT = VoiceSessions(needs=2, pre=64, pad=64, tail=96, least=128, most=512, search=320, pause=64, overlap=96)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as windows of 32 ms one after another: key, t, p, level."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = (F.row_number().over(order) - 1) * 32
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), t.cast("long").alias("t"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), (F.col("value") / 2000).alias("level"))


def j4_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are cut at pauses, at quiet stretches, or at their length."""
    return fold(_windows(spark, sf_dir), ["key"], ["t"], _SHORT)


def j6_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was open at each look, every 128 ms."""
    return fold(_windows(spark, sf_dir), ["key"], ["t"], OpenSpeech(_SHORT, every=128, longest=256))


def j29_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of each label's vectors as one recording: levels of windows of 16 values, the gate, sessions."""
    order = Window.partitionBy("label").orderBy("vec_id")
    at = (F.row_number().over(order) - 1).cast("long")
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), at.alias("n"), F.transform("embedding", lambda x: x * F.when(at % 40 < 25, 1.0).otherwise(0.01)).alias("samples"))
    levels = rows.select("key", "n", F.posexplode(M.envelope("samples", 16, 16)).alias("i", "level"), F.size("samples").alias("size"))
    return fold(levels.select("key", (32 * (F.col("n") * F.floor(F.col("size") / 16) + F.col("i"))).cast("long").alias("t"), "level"), ["key"], ["t"], Detection())


def h7_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving floor under each user's levels, and what is above it."""
    found = fold(_windows(spark, sf_dir).select("key", "t", "level"), ["key"], ["t"], LoudnessGate())
    return found.select("key", "t", F.round("floor", 9).alias("floor"), "active")


def j12_adaptive_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(spark, sf_dir).where("track <> 'error'").select("key", F.col("s").alias("t"), F.round("value").cast("long").alias("lag_ms"), (F.col("track") == "signup").alias("reset"), "event_id")
    return fold(rows, ["key"], ["t", "event_id"], AdaptiveLag(within=5 * 86_400_000))


def j15_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(spark, sf_dir).select("key", F.col("s").alias("t"), F.col("track").isin("view", "click").alias("app"), (F.col("track") == "purchase").alias("browser"), (F.col("value") > 20).alias("mic"), "event_id")
    return fold(rows, ["key"], ["t", "event_id"], MeetingDetector(quiet=2, absent=3))


def j17_language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("meeting_id", F.col("t_start_ms").alias("t"), "language", "confidence", (F.col("t_end_ms") - F.col("t_start_ms")).alias("speech_ms"))
    return fold(rows, ["meeting_id"], ["t"], LanguageVote())


def j24_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.chunks(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], width="1 day")
    return found.select("event_type", F.col("chunk.start").cast("timestamp_ntz").alias("start"), "frames")


def j3_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], quiet="6 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def j9_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    floor = rows.where("turn = 2").select("meeting_id", F.col("t_start_ms").alias("floor"))
    live, disk = W.split_at(rows, floor, ["meeting_id"])
    return live.select("meeting_id", "turn", F.lit("live").alias("side")).unionByName(disk.select("meeting_id", "turn", F.lit("disk").alias("side")))


def j20_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    partials = events.where("event_type <> 'purchase'").select(F.floor(F.col("event_id") / 4).alias("line"), F.when(F.col("value") > 30, F.col("props")).otherwise("").alias("text"), F.col("event_id").alias("seq"))
    finals = events.where("event_type = 'purchase'").groupBy(F.floor(F.col("event_id") / 4).alias("line")).agg(F.max_by("props", "event_id").alias("text"))
    return W.reconciled(partials, finals, ["line"])


QUERIES = {f.__name__: f for f in (h7_floor, j3_voice_sessions, j3_session_windows, j4_cuts, j6_open, j9_split, j12_adaptive_lag, j15_detector, j17_language_vote, j20_reconciled, j24_chunks, j29_detected)}

ORACLE_SQL = {
    "h7_floor": """WITH RECURSIVE w AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value / 2000 AS level FROM events),
f AS (SELECT key, 0::BIGINT AS n, 0.0015::DOUBLE AS floor, FALSE AS active FROM w WHERE n = 1
  UNION ALL SELECT key, n, CASE WHEN now THEN floor ELSE least(greatest(floor * 0.95 + level * 0.05, 1e-5), 0.05) END, now
  FROM (SELECT f.key, w.n, f.floor, w.level, CASE WHEN f.active THEN w.level > greatest(f.floor * 2.5, 0.005) ELSE w.level > greatest(f.floor * 4, 0.01) END AS now FROM f JOIN w ON w.key = f.key AND w.n = f.n + 1))
SELECT key, (n - 1) * 32 AS t, round(floor, 9) AS floor, active FROM f WHERE n > 0""",
    "j24_chunks": "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS frames FROM events GROUP BY ALL",
    "j3_session_windows": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o), n AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""",
    "j9_split": f"WITH {SEGMENTS} SELECT a.meeting_id, a.turn, CASE WHEN a.t_start_ms >= coalesce(f.t_start_ms, 0) THEN 'live' ELSE 'disk' END AS side FROM segments a LEFT JOIN segments f ON f.meeting_id = a.meeting_id AND f.turn = 2",
    "j20_reconciled": """WITH p AS (SELECT event_id // 4 AS line, CASE WHEN value > 30 THEN props ELSE '' END AS text, event_id AS seq FROM events WHERE event_type <> 'purchase'),
n AS (SELECT line, arg_max(text, seq) AS text FROM p GROUP BY line), f AS (SELECT event_id // 4 AS line, arg_max(props, event_id) AS text FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT line, text, true AS is_final FROM f UNION ALL SELECT line, text, false FROM n WHERE text <> '' AND line NOT IN (SELECT line FROM f)""",
}
