"""Recaps of meetings by map and reduce over chunks of their transcripts, and the tasks found in them.

``generate`` is any function from a prompt to a text; the default counts and quotes, so that results
can be told beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunked, json_object

RESERVED, LEAST = 1_500, 1_000
TASKS = "items array<struct<description:string,owner:string,due:string>>"


def quote(prompt: str) -> str:
    """A stand-in for a model: the first line and the size of its prompt."""
    return f"{prompt.strip().splitlines()[0][:60] if prompt.strip() else ''} ({len(prompt)})"


def transcripts(segments: DataFrame, label: Column, bar: float = 0.55) -> DataFrame:
    """text, confident and unsure of each meeting: its final lines in order; speaker names always count as confident."""
    line = F.concat(label, F.lit(": "), F.trim("text"))
    sure = F.when(F.coalesce(F.col("confidence") < bar, F.lit(False)), label).otherwise(line)
    unsure = F.when(F.coalesce(F.col("confidence") < bar, F.lit(False)), F.trim("text"))
    rows = segments.where("is_final").where(F.trim("text") != "").select("meeting_id", F.struct("t_start_ms", "turn", line.alias("line"), sure.alias("sure"), unsure.alias("unsure")).alias("l"))
    lists = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    part = lambda name: F.array_join(F.array_compact(F.transform("l", lambda x: x[name])), "\n")
    return lists.select("meeting_id", part("line").alias("text"), part("sure").alias("confident"), part("unsure").alias("unsure"))


def recaps(texts: DataFrame, context_chars: int, generate: Callable[[str], str] = quote) -> DataFrame:
    """content and chunks of each meeting: one chunk is summed up directly, several one by one and then together."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(generate)

    budget = max(context_chars - RESERVED, LEAST)
    parts = texts.select("meeting_id", F.explode(chunked("text", budget)).alias("c")).select("meeting_id", "c.n", run("c.text").alias("part"))
    lists = parts.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("p"))
    joined = lists.select("meeting_id", F.size("p").alias("chunks"), F.array_join(F.transform("p", lambda x: x.part), "\n").alias("parts"))
    return joined.select("meeting_id", "chunks", F.when(F.col("chunks") == 1, F.col("parts")).otherwise(run("parts")).alias("content"))


def tasks(replies: DataFrame, reply: str, again: str) -> DataFrame:
    """description, owner and due of the tasks in a model's reply, or in its repaired one; none if neither can be read."""
    items = F.coalesce(json_object(reply, TASKS)["items"], json_object(again, TASKS)["items"])
    kept = [c for c in replies.columns if c not in (reply, again)]
    return replies.select(*kept, F.posexplode(items).alias("pos", "t")).select(*kept, "pos", "t.*").where(F.trim("description") != "")


def grounded(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Owners that were heard in unsure lines alone are dropped; those never heard stay."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.trim("owner")))
    rows = items.join(texts.select("meeting_id", "confident", "unsure"), "meeting_id", "left")
    doubtful = has(F.col("unsure")) & ~has(F.col("confident"))
    return rows.withColumn("owner", F.when(doubtful, None).otherwise(F.col("owner"))).drop("confident", "unsure")
