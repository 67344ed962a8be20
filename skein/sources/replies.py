"""Framing of streamed model replies: lines of JSON, and server-sent events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = "response string, done boolean, error string"


def ndjson(body: Column) -> Column:
    """The objects of a reply, one a line; lines that can't be read are skipped."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.filter(F.transform(lines, lambda x: F.from_json(x, PIECE)), lambda p: p["response"].isNotNull() | p["done"].isNotNull() | p["error"].isNotNull())


def events(body: Column) -> Column:
    """The data of each server-sent event: its data lines joined; comments and the end mark are left out."""
    blocks = F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n\n+")
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: x.startswith("data:"))
    data = F.transform(blocks, lambda b: F.array_join(F.transform(lines(b), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda d: (d != "") & (d != "[DONE]"))


def reply(pieces: Column) -> Column:
    """(text, error): the pieces up to the one that says done; no text or an error piece is an error."""
    error = F.get(F.filter(pieces, lambda p: p["error"].isNotNull()), F.lit(0))["error"]
    end = F.array_position(F.transform(pieces, lambda p: F.coalesce(p["done"], F.lit(False))), True)
    used = F.slice(pieces, F.lit(1), F.when(end > 0, end.cast("int")).otherwise(F.size(pieces)))
    text = F.array_join(F.transform(used, lambda p: F.coalesce(p["response"], F.lit(""))), "")
    return F.struct(F.when(error.isNull(), text).alias("text"), F.coalesce(error, F.when(text == "", "empty reply")).alias("error"))
