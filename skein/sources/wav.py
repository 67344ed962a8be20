"""Recorded audio: PCM files as rows of samples, and the journal of what was recorded."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

RATE = 16_000
CHUNK = StructType([StructField("samples", ArrayType(FloatType())), StructField("duration_ms", LongType())])


def decode(content: bytes) -> tuple[np.ndarray, int] | None:
    """Mono samples at 16 kHz (linear where the rate differs) and their milliseconds; None if unreadable or empty."""
    try:
        with wave.open(io.BytesIO(content)) as file:
            width, rate, channels = file.getsampwidth(), file.getframerate(), file.getnchannels()
            data = file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return None
    if not data or width not in (1, 2, 4):
        return None
    raw = np.frombuffer(data[: len(data) // (width * channels) * width * channels], {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype("f8")
    raw = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
    mono = raw.reshape(-1, channels).mean(axis=1)
    if rate != RATE:
        mono = np.interp(np.arange(int(len(mono) * RATE / rate)) * rate / RATE, np.arange(len(mono)), mono)
    return mono.astype("f4"), len(mono) * 1000 // RATE


def encode(samples: np.ndarray) -> bytes:
    """A mono 16-bit file at 16 kHz; samples beyond 1 are clamped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(RATE)
        file.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(CHUNK)
def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [decode(bytes(c)) for c in batch]
        yield pd.DataFrame({"samples": [r[0] if r else None for r in rows], "duration_ms": pd.array([r[1] if r else None for r in rows], "Int64")})


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Files named channel-number.wav: path, channel, seq, samples, duration_ms (null if unreadable)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    rows = files.select("path", F.regexp_extract(name, r"^(.*)-\d+$", 1).alias("channel"), F.regexp_extract(name, r"-(\d+)$", 1).cast("long").alias("seq"), decoded("content").alias("c"))
    return rows.select("path", "channel", "seq", "c.*")


def recovered(chunks: DataFrame) -> DataFrame:
    """What a channel's files tell of the recording: consecutive places up to its first unreadable or empty file."""
    before = Window.partitionBy("channel").orderBy("seq")
    bad = F.max((F.coalesce("duration_ms", F.lit(0)) == 0).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(F.sum("duration_ms").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = chunks.withColumns({"bad": bad, "t_start_ms": start}).where("bad = 0")
    return whole.select("path", "channel", "seq", "t_start_ms", (F.col("t_start_ms") + F.col("duration_ms")).alias("t_end_ms"))


def missing_from_journal(found: DataFrame, journal: DataFrame) -> DataFrame:
    """Recovered files that the journal lost, placed after the latest end it knows."""
    known = journal.groupBy("channel").agg(F.max("t_end_ms").alias("_end"))
    lost = found.join(journal.select("channel", "seq"), ["channel", "seq"], "left_anti").join(known, "channel", "left")
    before = Window.partitionBy("channel").orderBy("seq")
    length = F.col("t_end_ms") - F.col("t_start_ms")
    end = F.coalesce("_end", F.lit(0)) + F.sum(length).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return lost.withColumn("_to", end).select("path", "channel", "seq", (F.col("_to") - length).alias("t_start_ms"), F.col("_to").alias("t_end_ms"))
