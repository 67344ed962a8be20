"""Loudness envelopes and their lagged likeness, over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

HOP_MS = 10
LEAST_HOPS = 20


def envelope(samples: str | Column, window: int, hop: int) -> Column:
    """RMS of each whole window, a hop apart."""
    v = F.col(samples) if isinstance(samples, str) else samples
    starts = F.sequence(F.lit(0), F.floor((F.size(v) - window) / hop).cast("int"))
    power = lambda i: F.aggregate(F.slice(v, i * hop + 1, window), F.lit(0.0), lambda a, x: a + x * x)
    return F.when(F.size(v) >= window, F.transform(starts, lambda i: F.sqrt(power(i) / window))).otherwise(F.array().cast("array<double>"))


def likeness(mic: np.ndarray, system: np.ndarray, lag: int) -> float:
    """Pearson correlation of ``mic`` with ``system`` shifted by ``lag`` hops; 0 for too little overlap or no variance."""
    a = mic[max(0, lag) : len(system) + lag if lag < len(mic) - len(system) else len(mic)]
    b = system[max(0, -lag) :]
    n = min(len(a), len(b))
    if n < LEAST_HOPS:
        return 0.0
    a, b = a[:n] - a[:n].mean(), b[:n] - b[:n].mean()
    norm = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / norm) if norm > 0 else 0.0


BEST = StructType([StructField("correlation", DoubleType()), StructField("lag_hops", LongType())])


def best_lag(mic: str, system: str, first: int = -20, last: int = 80) -> Column:
    """The highest correlation over lags and the first lag that has it."""

    @F.pandas_udf(BEST)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for mics, systems in batches:
            rows = []
            for m, s in zip(mics, systems):
                scores = [likeness(np.asarray(m, "f8"), np.asarray(s, "f8"), lag) for lag in range(first, last + 1)]
                k = int(np.argmax(scores))
                rows.append((scores[k], first + k))
            yield pd.DataFrame(rows, columns=["correlation", "lag_hops"])

    return run(F.col(mic), F.col(system))


def mix(a: str | Column, b: str | Column) -> Column:
    """Two channels summed, scaled down only if the sum would clip."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    total = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    peak = F.array_max(F.transform(total, F.abs))
    return F.when(peak > 1, F.transform(total, lambda x: x / peak)).otherwise(total)


def downmix(samples: str | Column, channels: int) -> Column:
    """The mean of the channels of interleaved samples; what is left over at the end is dropped."""
    v = F.col(samples) if isinstance(samples, str) else samples
    number = F.floor(F.size(v) / channels).cast("int")
    mean = lambda i: sum((F.get(v, i * channels + c) for c in range(channels)), F.lit(0.0)) / channels
    return F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), mean)).otherwise(F.array().cast("array<double>"))


def resample(samples: str | Column, rate: int, to: int) -> Column:
    """The samples at another rate, by straight lines between them."""
    v = F.col(samples) if isinstance(samples, str) else samples
    if rate == to or rate <= 0 or to <= 0:
        return v
    number = F.greatest(F.round(F.size(v) * to / rate), F.lit(1)).cast("int")

    def at(k: Column) -> Column:
        place = k * rate / to
        low = F.floor(place).cast("int")
        here = F.coalesce(F.get(v, low), F.lit(0.0))
        return here + (F.coalesce(F.get(v, low + 1), here) - here) * (place - low)

    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), number - 1), at)).otherwise(v)


def _between(v: Column, start: Column, end: Column, per_ms: int) -> Column:
    first = (F.greatest(start, F.lit(0)) * per_ms).cast("int")
    return F.slice(v, first + 1, F.greatest((F.greatest(end, F.lit(0)) * per_ms).cast("int") - first, F.lit(0)))


def select_speech(samples: str, window_start_ms: Column, spans: str, most_ms: int = 8_000, per_ms: int = 16) -> Column:
    """The samples of the spans (s, e), one after another, as many as ``most_ms`` holds."""
    v = F.col(samples)
    parts = F.transform(spans, lambda x: _between(v, x["s"] - window_start_ms, x["e"] - window_start_ms, per_ms))
    return F.slice(F.flatten(parts), 1, most_ms * per_ms)


def clips(rows: DataFrame, samples: str, span: str, per_ms: int = 16, least: float = 1e-4) -> DataFrame:
    """``clip``: the samples of each row's span; rows whose clip is empty or nowhere as loud as ``least`` go."""
    found = rows.withColumn("clip", _between(F.col(samples), F.col(f"{span}.s"), F.col(f"{span}.e"), per_ms))
    return found.where(F.array_max(F.transform("clip", F.abs)) >= least)
