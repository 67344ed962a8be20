"""Spectra of recordings in parts, and voices out of classes of speaker subsets.

A recording is rows of parts (key, ``n``: the number of the part's first sample, samples), never one array. A
frame belongs to the part that it starts in and reads on into the next one's head, so each task has its
parts and some hundred samples more. Decoding is plain joins, windows and sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from . import intervals as I

#: Fixed values of the features: samples a second, bins, samples of a frame and from one to the next, of the transform; lowest tone, emphasis, floor, scale.
RATE, BINS, FRAME, SHIFT, SIZE, LOW_HZ, EMPHASIS, FLOOR, SCALE = 16_000, 80, 400, 160, 512, 20.0, 0.97, float(np.finfo("f4").eps), 32_768.0
#: Milliseconds of a turn and of a gap that stays one, at least.
SPEECH_MS, GAP_MS = 200, 200


def _mel(hz: np.ndarray | float) -> np.ndarray | float:
    return 1127.0 * np.log1p(np.asarray(hz) / 700.0)


def bank() -> np.ndarray:
    """The triangles of BINS bands, evenly spaced in mel, over the bins of the spectrum."""
    low, high = _mel(LOW_HZ), _mel(RATE / 2)
    step = (high - low) / (BINS + 1)
    place = (_mel(RATE / SIZE * np.arange(SIZE // 2))[None, :] - low) / step - np.arange(BINS)[:, None]
    return np.clip(np.minimum(place, 2 - place), 0, None)


def window() -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))) ** 0.85


def log_mel(frames: np.ndarray, bands: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """The log energies of the bands in each row of FRAME samples: without its mean, emphasised, windowed."""
    x = frames * SCALE
    x = x - x.mean(axis=1, keepdims=True)
    x = x - EMPHASIS * np.concatenate([x[:, :1], x[:, :-1]], axis=1)
    spectrum = np.fft.rfft(x * shape, SIZE)[:, : SIZE // 2]
    return np.log(np.maximum((spectrum.real**2 + spectrum.imag**2) @ bands.T, FLOOR))


def filterbank(parts: DataFrame, key: list[str], n: str = "n", samples: str = "samples", normalise: bool = True) -> DataFrame:
    """Key, frame (from 0) and ``mel`` (BINS floats) of each frame of FRAME samples, SHIFT apart; with ``normalise`` less the recording's mean.

    Parts of a key follow one another without a gap and have FRAME samples each, but for the last. What is left
    over at the end is no frame; a recording shorter than one has none. Null samples are silence.
    """
    order = Window.partitionBy(*key).orderBy("n")
    rows = parts.select(*key, F.col(n).cast("long").alias("n"), F.col(samples).cast("array<double>").alias("samples"))
    rows = rows.withColumn("more", F.coalesce(F.lead(F.slice("samples", 1, FRAME - 1)).over(order), F.array().cast("array<double>")))
    kind = StructType([*[rows.schema[k] for k in key], StructField("frame", LongType()), StructField("mel", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, shape = bank(), window()
        for frame in frames:
            for names, first, own, more in zip(frame[key].itertuples(index=False, name=None), frame["n"], frame["samples"], frame["more"]):
                sound = np.nan_to_num(np.concatenate([np.asarray(own, "f8"), np.asarray(more, "f8")]))
                number = -(-int(first) // SHIFT)
                starts = np.arange(number * SHIFT - int(first), min(len(own), len(sound) - FRAME + 1), SHIFT)
                if len(starts):
                    found = log_mel(np.lib.stride_tricks.sliding_window_view(sound, FRAME)[starts], bands, shape).astype("f4")
                    yield pd.DataFrame({**{k: [v] * len(starts) for k, v in zip(key, names)}, "frame": number + np.arange(len(starts)), "mel": list(found)})

    found = rows.mapInPandas(run, kind)
    if not normalise:
        return found
    means = found.groupBy(*key).agg(F.array(*[F.avg(F.get("mel", F.lit(i)).cast("double")) for i in range(BINS)]).alias("_mean"))
    return found.join(means, key).select(*key, "frame", F.zip_with("mel", "_mean", lambda x, m: (x - m).cast("float")).alias("mel"))


def powerset(classes: int) -> list[tuple[int, ...]] | None:
    """The speakers of each of ``classes`` classes: nobody, each alone, each pair and so on; none if no number of speakers up to 8 explains them."""
    for speakers in range(1, 9):
        found: list[tuple[int, ...]] = []
        for size in range(speakers + 1):
            found += combinations(range(speakers), size)
            if len(found) == classes:
                return found
    return None


def marginals(logits: str | Column, classes: int) -> Column:
    """How likely each speaker speaks, from one frame's logits: the softmax of all classes with that speaker."""
    subsets = powerset(classes)
    if subsets is None or classes < 2:
        raise ValueError(f"{classes} classes are no sets of speakers")
    row = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(row)
    odds = F.transform(row, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.array(*[sum((F.get(odds, F.lit(c)) for c, of in enumerate(subsets) if s in of), F.lit(0.0)) / total for s in range(max(map(max, subsets[1:])) + 1)])


def tracks(windows: DataFrame, key: list[str], classes: int, logits: str = "logits", start: str = "start_ms", length: str = "window_ms") -> DataFrame:
    """Key, local (speaker), s, e: the turns in each window of ``logits`` (an array of class scores for each frame).

    A frame is the speakers' of its likeliest class, the last of equal ones. Runs of frames are turns; gaps of up to
    GAP_MS close, and what is then shorter than SPEECH_MS goes. A window without frames has none; ``key`` names a window.
    """
    subsets = powerset(classes)
    if subsets is None or classes < 2:
        raise ValueError(f"{classes} classes are no sets of speakers")
    rows = windows.select(*key, F.col(start).alias("_start"), (F.col(length) / F.size(logits)).alias("_ms"), F.posexplode(logits).alias("f", "row"))
    best = F.lit(classes) - F.array_position(F.reverse("row"), F.array_max("row"))
    held = F.array(*[F.array(*map(F.lit, of)) if of else F.array().cast("array<int>") for of in subsets])
    on = rows.select(*key, "_start", "_ms", "f", F.explode(F.get(held, best.cast("int"))).alias("local"))
    run = F.col("f") - F.row_number().over(Window.partitionBy(*key, "local").orderBy("f"))
    runs = on.withColumn("_run", run).groupBy(*key, "local", "_run").agg(F.min("f").alias("a"), (F.max("f") + 1).alias("b"), F.first("_start").alias("_start"), F.first("_ms").alias("_ms"))
    at = lambda f: F.col("_start") + F.round(F.col(f) * F.col("_ms")).cast("long")
    spans = runs.select(*key, "local", at("a").alias("s"), F.greatest(at("b"), at("a") + 1).alias("e"))
    return I.drop_short(I.merge(spans, [*key, "local"], GAP_MS), SPEECH_MS)
