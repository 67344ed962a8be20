"""The driver's tables in the roles of the engine's, and the same views as DuckDB SQL.

``SEGMENTS``: a conversation is a meeting, its turns are lines of speech on a clock of 40 ms a character.
``SPANS``: an event is a span of its user, of ``value`` minutes, on the track of its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MS_PER_CHAR, PAUSE_MS = 40, 200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, turn, speaker_id, channel, t_start_ms, t_end_ms, text, language, confidence, is_final."""
    size = F.length("text").cast("long")
    start = F.sum(size * MS_PER_CHAR + PAUSE_MS).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(start, F.lit(0).cast("long"))
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), "turn",
        (F.col("conv_id") * 10 + F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)).alias("speaker_id"),
        F.when(F.col("role") == "user", "mic").otherwise("system").alias("channel"),
        start.alias("t_start_ms"), (start + size * MS_PER_CHAR).alias("t_end_ms"), "text",
        F.when(F.col("turn") % 5 == 0, F.lit(None)).when(F.col("turn") % 5 == 4, "it").otherwise("en").alias("language"),
        (F.pmod(size * 37, F.lit(100)) / 100.0).alias("confidence"), (F.col("turn") % 7 != 6).alias("is_final"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, key, track, s, e: milliseconds since the epoch."""
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")  # the column has no time zone
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("track"), start.alias("s"), (start + F.round(F.col("value") * 1000).cast("long") * 60).alias("e"))


SEGMENTS = f"""
segments AS (
  SELECT conv_id AS meeting_id, turn, conv_id * 10 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker_id,
    CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS channel, s AS t_start_ms, s + length(text) * {MS_PER_CHAR} AS t_end_ms, text,
    CASE turn % 5 WHEN 0 THEN NULL WHEN 4 THEN 'it' ELSE 'en' END AS language, (length(text) * 37 % 100) / 100.0::DOUBLE AS confidence, turn % 7 <> 6 AS is_final
  FROM (SELECT *, coalesce(sum(length(text) * {MS_PER_CHAR} + {PAUSE_MS}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations)
)"""
SPANS = """
spans AS (
  SELECT event_id, user_id AS key, event_type AS track, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + round(value * 1000)::BIGINT * 60 AS e FROM events
)"""
