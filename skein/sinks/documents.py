"""Meetings as Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_timestamp


def lines(segments: DataFrame, label: Column) -> DataFrame:
    """transcript: the meeting's final lines in order, each with its time and speaker."""
    line = F.concat(F.lit("["), format_timestamp("t_start_ms"), F.lit("] **"), label, F.lit(":** "), F.trim("text"))
    rows = segments.where("is_final").where(F.trim("text") != "").select("meeting_id", F.struct("t_start_ms", "turn", line.alias("line")).alias("l"))
    return rows.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.line), "\n\n").alias("transcript"))


def markdown(meetings: DataFrame, recap: DataFrame, tasks: DataFrame, transcript: DataFrame) -> DataFrame:
    """value: the document of each meeting (meeting_id, title) with what it has of recap, tasks and transcript; one without any is an error."""
    detail = F.concat_ws(", ", "owner", "due")
    item = F.concat(F.when(F.col("done"), "- [x] ").otherwise("- [ ] "), F.col("description"), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))
    listed = tasks.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("done", "pos", item.alias("i")))), lambda x: x.i), "\n").alias("tasks"))
    rows = meetings.join(recap.select("meeting_id", "content"), "meeting_id", "left").join(listed, "meeting_id", "left").join(transcript, "meeting_id", "left")
    part = lambda head, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {head}\n\n"), F.col(c)))
    body = F.concat_ws("\n\n", part("Recap", "content"), part("Tasks", "tasks"), part("Transcript", "transcript"))
    whole = F.concat(F.lit("# "), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Meeting")), F.lit("\n\n"), body, F.lit("\n"))
    return rows.select("meeting_id", F.when(body == "", F.raise_error(F.lit("nothing to export"))).otherwise(whole).alias("value"))


def write(documents: DataFrame, folder: str) -> None:
    """A folder of text for each meeting."""
    documents.select("meeting_id", "value").write.partitionBy("meeting_id").text(folder)
