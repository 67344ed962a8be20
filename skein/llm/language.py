"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-cased text's letters, word ends marked by spaces,
hashed into a fixed number of buckets. Training is stochastic gradient descent in numpy over a
bounded sample of labelled rows, whole and in short fragments. What a text's score needs of a bucket
is only its embedding times the output weights, so tasks get that small table. A part of the sample
is kept from training to calibrate, on wholes and fragments too: a temperature for the
probabilities, and the confidence below which a text is rejected.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from .common import annotate, documents, kept

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIMENSION = 16
#: Labelled rows of each language in the sample, about.
SAMPLE = 250
#: Languages up to which their counts are broadcast.
FEW = 10_000
EPOCHS = 4
#: Bytes of a text that are counted at a time.
BLOCK = 1 << 16
#: Words of the fragments that each row of the sample gives beside the whole text.
FRAGMENTS = (2, 5, 12)
#: The share of the calibration rows that rejection may cost.
REJECTS = 0.001
#: A-Z to a-z, other ASCII but letters to space; bytes of non-ASCII characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def subwords(text: str) -> np.ndarray:
    """The bucket of each subword of the whole text."""
    return np.concatenate([np.zeros(0, np.uint32), *_buckets(np.frombuffer(_letters(text), np.uint8).astype(np.uint32))])


def _letters(text: str) -> bytes:
    """The folded letters of ``text`` with one space between words and at both ends."""
    return b" " + re.sub(b"  +", b" ", text.encode("utf-8", "replace").translate(_FOLD)).strip(b" ") + b" "


def _buckets(data: np.ndarray) -> list[np.ndarray]:
    """The buckets of all runs of bytes of each order."""
    parts, run = [], data
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        run = run[:-1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n in ORDERS:
            parts.append((run * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(16))
    return parts


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of the text's subwords and how often each comes, with memory of BLOCK bytes beside the text's own."""
    folded = _letters(text)
    if len(folded) <= BLOCK:
        return np.unique(np.concatenate([np.zeros(0, np.uint32), *_buckets(np.frombuffer(folded, np.uint8).astype(np.uint32))]), return_counts=True)
    total, reach = np.zeros(BUCKETS, np.int64), max(ORDERS) - 1
    for at in range(0, len(folded), BLOCK):
        data = np.frombuffer(folded[at : at + BLOCK + reach], np.uint8).astype(np.uint32)
        for n, part in zip(ORDERS, _buckets(data)):
            total += np.bincount(part[: max(0, min(BLOCK, len(data) - n + 1))], minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket by language: what one subword adds before averaging
    temperature: float
    least: float

    def logits(self, text: str) -> np.ndarray:
        found, count = bucket_counts(text)
        return count @ self.table[found].astype("f8") / count.sum() if len(found) else np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the text is rejected; ``und`` without any letter."""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return "und", 0.0, True
        p = _softmax(self.logits(text).astype("f8") / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.least)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, language) rows; every fifth row of each language calibrates."""
    languages = sorted({lang for _, lang in rows})
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), "f4"), 1.0, 0.0)
    seen: dict[str, int] = {}
    train, aside = [], []
    rng = np.random.default_rng(seed)
    for text, lang in rows:
        seen[lang] = seen.get(lang, 0) + 1
        words = text.split()
        starts = [(int(rng.integers(max(1, len(words) - n + 1))), n) for n in FRAGMENTS]
        for part in (text, *(" ".join(words[a : a + n]) for a, n in starts)):
            if len(found := subwords(part)):
                bucket, count = np.unique(found, return_counts=True)
                (aside if seen[lang] % 5 == 0 else train).append((bucket, (count / count.sum()).astype("f4")[:, None], languages.index(lang)))
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype("f4") / DIMENSION
    out = np.zeros((DIMENSION, len(languages)), "f4")
    bias = np.zeros(len(languages), "f4")
    steps, total = 0, EPOCHS * len(train)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            bucket, share, k = train[i]
            rate = 1.0 - steps / total
            steps += 1
            hidden = (share * embed[bucket]).sum(axis=0)
            wrong = _softmax(hidden @ out + bias)
            wrong[k] -= 1
            back = out @ wrong
            out -= 0.5 * rate * np.outer(hidden, wrong)
            bias -= 0.1 * rate * wrong
            embed[bucket] -= 0.5 * rate / (share * share).sum() * share * back  # moves the average by half of back
    table = embed @ out + bias
    if not aside:
        return Model(languages, table, 1.0, 0.0)
    logits = np.array([(share * table[bucket]).sum(axis=0) for bucket, share, _ in aside], "f8")
    truth = np.array([k for *_, k in aside])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((2.0**p for p in np.arange(0, 5.25, 0.25)), key=lambda t: (loss(t), t))
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    least = min(0.5, float(np.quantile(right, REJECTS)) * 0.9) if len(right) else 0.0
    return Model(languages, table.astype("f4"), float(temperature), least)


def fold(key: Column, number: int) -> Column:
    """The fold of a key: crc32 of its text; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(number)).cast("int")


def sample(labelled: DataFrame, key: str, text: str, lang: str, each: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``each`` (text, language) rows of each language, however many there are, by a hash of the key; at most twice that in all."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = labelled.groupBy("lang").count().withColumn("share", F.lit(each) / F.col("count"))
    number = counts.count()
    if not number:
        return []
    if number <= FEW:
        counts = F.broadcast(counts)  # else the texts would move to find their share
    place = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)
    picked = labelled.withColumn("place", place).join(counts, "lang").where("place < share")
    return [(r[0], r[1]) for r in picked.orderBy("place", F.length("text"), "lang", "text").select("text", "lang").limit(2 * each * number).collect()]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None) -> Model:
    """A model of the rows of ``docs`` with a language that are not held out."""
    rows = docs if held_out is None else docs.where(~held_out)
    return fit(sample(rows, key, text, lang))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, which replace columns of those names.

    A text that is null, empty or without a letter is ``und`` with score 0, rejected; so are all
    texts if no language was learned. Repeated rows stay. An empty table gives an empty result. A
    text of any length is counted in blocks. The model that tasks get has 256 KB a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    adds = StructType().add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    name = uuid.uuid4().hex
    return annotate(docs, text, adds, lambda: kept(f"language {name}", lambda: shared.value.predict), keep)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose fold of five is not 0."""
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    found = identify(docs.select("doc_id", "text"), train(docs, held_out=held_out), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op6_language": op6_language}
