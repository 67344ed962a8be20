"""Operators that Structured Streaming has built in: watermarked windows, duplicates, late rows, newest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(frames: DataFrame, key: list[str], ts: str = "ts", width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling chunks of frames by key, emitted once the watermark has passed them."""
    return frames.withWatermark(ts, late).groupBy(*key, F.window(ts, width).alias("chunk")).agg(F.count("*").alias("frames"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def sessions(rows: DataFrame, key: list[str], ts: str = "ts", quiet: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of a key that end after ``quiet``."""
    return rows.withWatermark(ts, late).groupBy(*key, F.session_window(ts, quiet).alias("session")).agg(F.count("*").alias("n"))


def once(rows: DataFrame, ident: list[str], ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Each id once, however often it is sent within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(ident)


def split_at(rows: DataFrame, floor: DataFrame, key: list[str], start: str = "t_start_ms") -> tuple[DataFrame, DataFrame]:
    """(live, catch-up): rows from each key's floor on are live, those before belong to the pass over stored audio; none is in both."""
    placed = rows.join(floor.select(*key, F.col("floor").alias("_floor")), key, "left").withColumn("_floor", F.coalesce("_floor", F.lit(0)))
    return placed.where(F.col(start) >= F.col("_floor")).drop("_floor"), placed.where(F.col(start) < F.col("_floor")).drop("_floor")


def reconciled(partials: DataFrame, finals: DataFrame, key: list[str]) -> DataFrame:
    """The lines on view: a final one supersedes its partials, an empty newest partial takes its line away."""
    newest = partials.groupBy(*key).agg(F.max_by("text", "seq").alias("text")).withColumn("is_final", F.lit(False))
    shown = newest.where("text is not null and text <> ''").join(finals.select(*key), key, "left_anti")
    return finals.select(*key, "text", F.lit(True).alias("is_final")).unionByName(shown)
