"""Read models over meetings, lines of speech and their children: filters, joins, aggregates, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most rows that a transcript or a list may ask for, and what they get without asking.
TRANSCRIPT_ROWS, LIST_ROWS = (5_000, 50_000), (50, 500)


def page(rows: DataFrame, bounds: tuple[int, int], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows from ``offset`` on, as many as asked for within ``bounds`` (usual, most)."""
    return rows.offset(offset).limit(min(bounds[0] if limit is None else limit, bounds[1]))


def title_like(column: str, needle: str | None) -> Column:
    """Contains ``needle``, ASCII case aside; a percent sign is itself, an underscore any character. A blank needle asks nothing."""
    if not needle or not needle.strip():
        return F.lit(True)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    escaped = needle.translate(fold).replace("\\", "\\\\").replace("%", "\\%")
    return F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like(f"%{escaped}%")


def transcript(segments: DataFrame, begin: int | None = None, end: int | None = None, partial: bool = False) -> DataFrame:
    """Lines that touch [begin, end], ends included; provisional ones only if asked for."""
    rows = segments if partial else segments.where("is_final")
    if begin is not None:
        rows = rows.where(F.col("t_end_ms") >= begin)
    if end is not None:
        rows = rows.where(F.col("t_start_ms") <= end)
    return rows


def said(column: str = "text") -> Column:
    """Whether a text is more than blank."""
    return F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > 0


def snippet(column: Column, most: int = 180) -> Column:
    """The first ``most`` characters, with an ellipsis where something is left out."""
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("…"))).otherwise(column)


def first_prose(column: Column) -> Column:
    """The first line that is neither blank nor heading nor bullet."""
    return F.get(F.filter(F.transform(F.split(column, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(#|[-*] )")), F.lit(0))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, from one aggregate."""
    whole = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(whole).select("_row.*")


def meeting_list(segments: DataFrame, speakers_override: DataFrame | None = None) -> DataFrame:
    """A row for each meeting: speakers (or the override), final lines, speech, its first final words."""
    final = F.col("is_final")
    first = F.min_by(F.when(final & said(), F.trim("text")), F.when(final & said(), F.struct("t_start_ms", "turn")))
    rows = segments.groupBy("meeting_id").agg(
        F.countDistinct("speaker_id").alias("speakers"), F.sum(final.cast("long")).alias("lines"),
        F.sum(F.when(final, F.col("t_end_ms") - F.col("t_start_ms")).otherwise(0)).alias("speech_ms"), F.max("t_end_ms").alias("duration_ms"), snippet(first).alias("preview"),
    )
    if speakers_override is not None:
        rows = rows.join(speakers_override, "meeting_id", "left")
        asked = F.when(F.col("override").isNotNull(), F.least(F.greatest(F.col("override"), F.lit(1)), F.lit(12)).cast("long"))
        rows = rows.withColumns({"speakers": F.coalesce(asked, F.col("speakers")), "overridden": F.col("override").isNotNull()}).drop("override")
    return rows


def resolve_aliases(rows: DataFrame, key: str = "id", alias: str = "alias_of", hops: int = 8) -> DataFrame:
    """(key, root): aliases followed up to ``hops`` times; null where one leads nowhere, the row of the last hop at the limit."""
    ends = rows.select(F.col(key).alias("_id"), F.col(alias).alias("_next"))
    found = rows.select(key, F.col(key).alias("root"), F.col(alias).alias("_to"))
    for _ in range(hops):
        found = found.join(ends, F.col("_to") == F.col("_id"), "left").select(
            key, F.when(F.col("_to").isNull(), F.col("root")).otherwise(F.col("_id")).alias("root"), F.col("_next").alias("_to")
        )
    return found.select(key, "root")


def audible(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """Speakers without alias with a final line of their own or of a direct alias of theirs."""
    heard = segments.where("is_final").select(F.col("speaker_id").alias("id")).distinct()
    owners = speakers.join(heard, "id", "left_semi").select(F.coalesce("alias_of", "id").alias("id")).distinct()
    return speakers.where("alias_of is null").join(owners, "id", "left_semi")


def language_shares(segments: DataFrame) -> DataFrame:
    """Milliseconds of final lines by meeting and language."""
    ms = F.sum(F.col("t_end_ms") - F.col("t_start_ms")).alias("ms")
    return segments.where("is_final and language is not null").groupBy("meeting_id", "language").agg(ms)


def spoken_in(shares: DataFrame) -> DataFrame:
    """The dominant language of each meeting, and a second one if its share is over a quarter; languages under 5 % don't count."""
    total = Window.partitionBy("meeting_id")
    share = F.col("ms") / F.sum("ms").over(total)
    kept = shares.withColumn("share", share).where("share >= 0.05")
    ranked = kept.withColumn("rank", F.row_number().over(total.orderBy(F.desc("ms"), "language")))
    return ranked.groupBy("meeting_id").agg(F.max(F.when(F.col("rank") == 1, F.col("language"))).alias("dominant"), F.max(F.when((F.col("rank") == 2) & (F.col("share") > 0.25), F.col("language"))).alias("also"))


def exact_median(values: Column) -> Column:
    """The median of integers; of an even number, the two middle ones' mean cut towards zero."""
    return F.percentile(values, F.lit(0.5)).cast("long")


def shaky(segments: DataFrame, least: int = 8, bar: float = 0.55, part: float = 0.75) -> DataFrame:
    """Lines with ``shaky``: confidence under ``bar`` or ``part`` of the meeting's median, which needs ``least`` readings. Null is never shaky."""
    reading = F.when(said(), F.col("confidence"))
    medians = segments.groupBy("meeting_id").agg(F.when(F.count(reading) >= least, F.percentile(reading, F.lit(0.5))).alias("median"))
    low = F.col("confidence") < F.greatest(F.lit(bar), F.coalesce(F.col("median") * part, F.lit(bar)))
    return segments.join(medians, "meeting_id").withColumn("shaky", F.coalesce(low & F.col("median").isNotNull(), F.lit(False)))


def centroids(vectors: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """The unit vector of each key's summed vectors; vectors of another length than the key's most common are skipped."""
    sized = vectors.withColumn("_n", F.size(vector))
    usual = sized.groupBy(*key).agg(F.mode("_n", True).alias("_usual"))
    parts = sized.join(usual, key).where("_n = _usual").select(*key, F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(*key, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*key)))
    return sums.withColumn("x", F.when(norm > 1e-12, F.col("x") / norm).otherwise(F.col("x")))


def top_two(scores: DataFrame, key: list[str], candidate: str, score: str, margin: float = 0.12) -> DataFrame:
    """The best candidate of each key, the runner-up's score (0 at least), and the verdict: strong, link, suggest or none."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("n"), F.col(candidate).alias("c")))), 1, 2)
    best = scores.groupBy(*key).agg(ranked.alias("_top"))
    best = best.select(*key, F.get("_top", F.lit(0)).c.alias(candidate), (-F.get("_top", F.lit(0)).n).alias("best"), F.greatest(F.coalesce(-F.get("_top", F.lit(1)).n, F.lit(0.0)), F.lit(0.0)).alias("second"))
    clear = F.col("best") - F.col("second") >= margin
    verdict = F.when(clear & (F.col("best") >= 0.78), "strong").when(clear & (F.col("best") >= 0.64), "link").when(clear & (F.col("best") >= 0.52), "suggest").otherwise("none")
    return best.withColumn("verdict", verdict)


def reconcile(installed: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Each key of either side: kept, missing or obsolete."""
    both = installed.select(*key, F.lit(1).alias("i")).distinct().join(wanted.select(*key, F.lit(1).alias("w")).distinct(), key, "full_outer")
    return both.select(*key, F.when(F.col("i").isNull(), "missing").when(F.col("w").isNull(), "obsolete").otherwise("kept").alias("state"))


def keep_only(rows: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is to be kept; an empty list to keep deletes nothing."""
    return rows if keep.isEmpty() else rows.join(keep.select(*key).distinct(), key, "left_semi")


def union_distinct(first: DataFrame, second: DataFrame, removed: DataFrame, word: str = "word", most: int = 200) -> DataFrame:
    """Words of both lists in order, equal ones (case and outer blanks aside) once, without the removed, up to ``most``."""
    rows = first.select(F.lit(0).alias("list"), "pos", word).unionByName(second.select(F.lit(1).alias("list"), "pos", word))
    rows = rows.withColumn("folded", F.lower(F.trim(word))).where("folded <> ''")
    gone = removed.select(F.lower(F.trim(word)).alias("folded")).distinct()
    kept = rows.join(gone, "folded", "left_anti").groupBy("folded").agg(F.min_by(F.struct("list", "pos", word), F.struct("list", "pos")).alias("w"))
    return kept.select("w.*").orderBy("list", "pos").limit(most)


def queue_order() -> list[Column]:
    """Queued work by kind, then newest first."""
    kinds = ("download", "catch_up", "diarize", "mixdown", "summarize")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    return [F.when(rank == 0, len(kinds) + 1).otherwise(rank), F.desc("created_at"), F.desc("id")]


def spaced_top(rows: DataFrame, key: list[str], order: list[Column], place: str, spacing: int, most: int) -> DataFrame:
    """Greedy: rows of a key in order, each at least ``spacing`` from those taken, up to ``most``.

    A round takes the best row left of every key and drops what is too near it, so the work is
    ``most`` aggregates whatever the size of a key.
    """
    left = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    taken = None
    for _ in range(most):
        best = left.groupBy(*key).agg(F.min_by(F.struct(*left.columns), "_rank").alias("_row")).select("_row.*")
        taken = best if taken is None else taken.unionByName(best)
        near = best.select(*key, F.col(place).alias("_at"))
        left = left.join(near, key).where(F.abs(F.col(place) - F.col("_at")) >= spacing).drop("_at")
    return taken.drop("_rank")


def nearest_other(rows: DataFrame, key: list[str], value: str, ident: str, side: str) -> DataFrame:
    """``other``: for each row the row of the other side (0 or 1) of its key with the nearest value, of equal gaps (to the cent) the smallest id.

    Only the distinct values next below, at and above a row can be nearest, and each side has one id for a value.
    """
    least = rows.groupBy(*key, side, value).agg(F.min(ident).alias("_id"))
    both = rows.select(*key, value).distinct()
    marks = both
    for k in (0, 1):
        own = least.where(F.col(side) == k).select(*key, value, F.struct(value, "_id").alias(f"_at{k}"))
        marks = marks.join(own, [*key, value], "left")
    up, down = Window.partitionBy(*key).orderBy(value), Window.partitionBy(*key).orderBy(F.desc(value))
    for k in (0, 1):
        marks = marks.withColumns({f"_low{k}": F.last(f"_at{k}", ignorenulls=True).over(up), f"_high{k}": F.last(f"_at{k}", ignorenulls=True).over(down)})
    placed = rows.join(marks, [*key, value])
    low, high = (F.when(F.col(side) == 0, F.col(f"_{n}1")).otherwise(F.col(f"_{n}0")) for n in ("low", "high"))
    candidate = lambda c: F.when(c.isNotNull(), F.struct(F.round(F.abs(F.col(value) - c[value]), 2).alias("gap"), c["_id"].alias("id")))
    return placed.withColumn("other", F.least(candidate(low), candidate(high))["id"]).select(*rows.columns, "other")
