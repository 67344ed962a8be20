"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are taken of every whole text. Shallow trees, each over a random part of the statistics
and rows of a bounded labelled sample, give their paths as conjunctive rules; a lasso logistic
regression (proximal gradient) weighs the rules and drops most. The rest compile into one Spark
column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import annotate, documents, settle, without
from .language import fold

#: Labelled rows in the sample, about.
SAMPLE = 8_000
TREES, DEPTH, LEAF = 40, 3, 8
LASSO = 0.002
STATISTICS = ("words", "word_length", "distinct", "stutter", "upper", "digits", "symbols", "marks", "lines", "line_copies", "long_words", "spread")
_UPPER, _DIGITS, _SYMBOLS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@~^{}[]\\/_=+", b"!?"


def _share(data: bytes, of: bytes) -> float:
    return (len(data) - len(data.translate(None, of))) / max(1, len(data))


def statistics(text: str | None) -> tuple[float, ...]:
    """STATISTICS of a whole text; of an empty or null one, all 0."""
    data = (text or "").encode("utf-8", "replace")
    found = data.split()
    n = len(found)
    if not n:
        return (0.0,) * len(STATISTICS)
    kinds = set(found)
    lines = [line for line in data.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, found), np.int64, n)
    stutter = sum(map(bytes.__eq__, found[1:], found)) / n
    return (
        float(n), float(lengths.mean()), len(kinds) / n, stutter, _share(data, _UPPER), _share(data, _DIGITS), _share(data, _SYMBOLS), _share(data, _MARKS),
        len(lines) / n, 1 - len(set(lines)) / len(lines), float((lengths > 15).mean()), float(lengths.std()),
    )


Test = tuple[int, bool, float]  # statistic, whether over (else not over), threshold


@dataclass
class Model:
    """Weighted conjunctive rules; a score is the logistic of their sum."""

    bias: float
    rules: list[tuple[float, tuple[Test, ...]]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for k, over, bar in tests:
                holds = holds & ((F.col(STATISTICS[k]) > bar) if over else (F.col(STATISTICS[k]) <= bar))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, pool: np.ndarray, path: tuple[Test, ...] = ()) -> list[tuple[Test, ...]]:
    """Grow one tree by Gini impurity; the tests on the way to each of its nodes but the root."""
    if len(path) == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
        return []
    best = (-1e-9, 0, 0.0)
    for k in pool:
        order = np.argsort(x[:, k], kind="stable")
        v, ones = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = (v[1:] > v[:-1]) & (n >= LEAF) & (n <= len(y) - LEAF)
        left, right, m = ones[:-1], ones[-1] - ones[:-1], len(y) - n
        gain = np.where(cut, left**2 / n + (n - left) ** 2 / n + right**2 / m + (m - right) ** 2 / m, -1)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], int(k), float((v[i] + v[i + 1]) / 2))
    if best[0] < 0:
        return []
    _, k, bar = best
    over, out = x[:, k] > bar, []
    for side, rows in ((True, over), (False, ~over)):
        here = (*path, (k, side, bar))
        out += [here, *_paths(x[rows], y[rows], pool, here)]
    return out


def holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, bar in tests:
        out &= (x[:, k] > bar) == over
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, rounds: int = 500) -> Model:
    """Rules from trees, weights from a lasso logistic regression; one class or none gives a constant."""
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else 4.0 if y[0] else -4.0, [])
    rng = np.random.default_rng(seed)
    found: dict[tuple[Test, ...], None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), max(200, len(y) // 2)))
        pool = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        found |= dict.fromkeys(_paths(x[rows], y[rows].astype("f8"), pool))
    rules = list(found)
    if not rules:
        return Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), [])
    marks = np.stack([holds(x, r) for r in rules], axis=1).astype("f8")
    step = 4 * len(y) / (np.linalg.norm(marks.T @ marks, 2) + len(y))
    weights, bias = np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_bias, t = weights, bias, 1.0
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-(marks @ ahead + ahead_bias))) - y
        moved = ahead - step * (marks.T @ wrong) / len(y)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        moved_bias = ahead_bias - step * wrong.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = moved + (t - 1) / after * (moved - weights), moved_bias + (t - 1) / after * (moved_bias - bias)
        weights, bias, t = moved, moved_bias, after
    return Model(float(bias), [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6])


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with STATISTICS, which replace columns of those names."""
    adds = StructType()
    for name in STATISTICS:
        adds = adds.add(name, DoubleType())
    return annotate(docs, text, adds, lambda: statistics, keep)


def train(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", size: int = SAMPLE) -> Model:
    """A model of about ``size`` labelled rows, taken by a hash of the key.

    Null keys and labels teach nothing; a key labelled or measured twice teaches as often. Without
    labels, or with those of one class, the model is a constant. Equal rows, and splits of equal gain,
    go by a fixed order, so a table gives one model.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    number = rows.count()
    place = F.pmod(F.xxhash64("_key", F.lit(5)), F.lit(1 << 30))
    rows = rows.where(place < int((1 << 30) * min(1.0, size / max(1, number))))
    joined = measured.join(rows, F.col(key) == F.col("_key")).orderBy(place, "_key", "_label", *STATISTICS).limit(2 * size)
    table = np.array([tuple(r) for r in joined.select("_label", *STATISTICS).collect()], "f8").reshape(-1, 1 + len(STATISTICS))
    return fit(table[:, 1:], table[:, 0].astype("i4"))


def classify(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with score and predicted, which replace columns of those names.

    An empty or null text has statistics of 0 and a score as any other, a text of any length is measured
    whole. Repeated rows are scored alike, a score of 0.5 is predicted 1, an empty table stays empty.
    """
    scored = without(measured, ["score", "predicted"]).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labels whose fold of three is not 1."""
    measured = settle(measure(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1)
    found = classify(measured, train(measured, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
