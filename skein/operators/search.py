"""Ranked full-text search over postings, and the substring path for scripts without spaces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN

K1, B = 1.2, 0.75
_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿豈-﫿]")


def terms(query: str) -> list[str]:
    """The query's terms: white space parts them, control characters go."""
    return [t for t in ("".join(c for c in part if c.isprintable()) for part in query.split()) if t]


def by_substring(query: str) -> bool:
    """Whether the query has kana, CJK or Thai, which words can't be cut from."""
    return bool(_UNSPACED.search(query))


def folded(text: str) -> Column:
    return F.translate(F.lower(F.col(text)), ACCENTED, PLAIN)


def tokens(text: str) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, key: list[str], text: str = "text", only: list[str] | None = None) -> DataFrame:
    """term, key, tf and dl (the row's length in tokens), of the terms in ``only`` (all); to be kept beside the rows, by term."""
    found = rows.select(*key, tokens(text).alias("_t")).withColumn("dl", F.size("_t"))
    if only is not None:
        found = found.withColumn("_t", F.filter("_t", lambda t: t.isin(only)))
    return found.select(*key, "dl", F.explode("_t").alias("term")).groupBy("term", *key, "dl").agg(F.count("*").alias("tf"))


def search(rows: DataFrame, query: str, key: list[str], text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """key and score of the rows that hold all terms, best first by BM25; an empty query finds nothing.

    Through ``index`` (see :func:`postings`, made on the spot if not given), or for scripts without spaces
    by substring, which needs terms of three characters.
    """
    asked = terms(query)
    if by_substring(query):
        hit = F.lit(bool(asked) and all(len(t) >= 3 for t in asked))
        for t in asked:
            hit = hit & F.contains(folded(text), F.lit(t.lower()))
        return rows.where(hit).select(*key, F.lit(0.0).alias("score"))
    wanted = list(dict.fromkeys(w for t in asked for w in re.findall(r"[^\W_]+", t.lower().translate(str.maketrans(ACCENTED, PLAIN)))))
    index = postings(rows, key, text, wanted) if index is None else index
    if not wanted:
        return index.select(*key, F.lit(0.0).alias("score")).limit(0)
    stats = rows.select(F.size(tokens(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    hits = index.where(F.col("term").isin(wanted))
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    if len(df) < len(wanted):
        return index.select(*key, F.lit(0.0).alias("score")).limit(0)
    counts = F.create_map(*[F.lit(x) for t, n in df.items() for x in (t, float(n))])[F.col("term")]
    idf = F.greatest(F.log((stats["n"] - counts + 0.5) / (counts + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / stats["avgdl"]))
    return hits.groupBy(*key).agg(F.sum(score).alias("score"), F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).drop("_n")


def highlighted(text: Column, wanted: list[str], around: int = 14) -> Column:
    """About ``around`` tokens from the first hit on, HTML-escaped, hits in <mark>."""
    parts = F.split(text, r"\s+")
    hit = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")).isin(*wanted)
    at = F.greatest(F.coalesce(F.array_position(F.transform(parts, hit), True), F.lit(1)) - around // 3, F.lit(1)).cast("int")
    escape = lambda w: F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = F.transform(F.slice(parts, at, around), lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), escape(w), F.lit("</mark>"))).otherwise(escape(w)))
    return F.array_join(marked, " ")
