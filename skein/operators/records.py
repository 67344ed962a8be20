"""Records of the archive: listings, guarded and partial updates, cascades, and small verdicts over rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .read_models import LIST_ROWS, page

ACTIVE = ("queued", "running", "paused")
#: What a correlation must show for one channel to be a copy of the other.
COPY_CORRELATION, SPAN_COLD_MS, SPAN_WARM_MS, MIC_VOICE_MS, FAR_VOICE_MS, OWN_VOICE_MS = 0.70, 3_000, 2_500, 1_000, 300, 400
#: When one stretch is read in another language than its meeting, and when a text is carried over a cut.
USABLE, OVERRIDE, OVERRIDE_MS = 0.35, 0.85, 3_000
CARRY_WORDS, CARRY_CONFIDENCE, CARRY_GAP_MS = 30, 0.5, 1_500
#: How long a line waits for the other channel, and how far that must reach past its end.
FAR_WAIT_MS, FAR_REACH_MS = 500, 200
#: Speech detection by channel; reading from disk waits longer at the end of speech.
DETECTION = {"mic": {"enter": 0.38, "exit": 0.22, "tail_ms": 400, "pre_ms": 320, "post_ms": 288}, "system": {"enter": 0.48, "exit": 0.32, "tail_ms": 320, "pre_ms": 224, "post_ms": 288}}
DISK_TAIL, DISK_POST_MS, VOICED_WINDOW_MS = (7, 4), 384, 32


def jobs(rows: DataFrame, meeting: object = None, kind: str | None = None, status: str | None = None, active: bool = False, limit: int | None = None) -> DataFrame:
    """Jobs by any of these filters, newest first, a page of them at most."""
    for name, value in (("meeting_id", meeting), ("kind", kind), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if active:
        rows = rows.where(F.col("status").isin(*ACTIVE))
    return page(rows.orderBy(F.desc("created_at"), F.desc("id")), LIST_ROWS, limit)


def standing(spans: DataFrame, start: str = "s", end: str = "e", withdrawn: str = "withdrawn_at") -> DataFrame:
    """Suppressed spans that still hold: not withdrawn, of positive width."""
    return spans.where(F.col(withdrawn).isNull() & (F.col(end) > F.col(start)))


def machine_made(label: str | Column) -> Column:
    """Whether a label is one that the engine gives by itself."""
    trimmed = F.trim(label)
    return (trimmed == "You") | trimmed.rlike(r"^Speaker \d+$")


def grouped_hits(hits: DataFrame, by: str, rank: str, *columns: str) -> DataFrame:
    """Hits nested by ``by`` in order of ``rank``; groups are numbered by their first hit."""
    nested = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(rank, *columns))).alias("hits"))
    first = F.get("hits", F.lit(0))[rank]
    place = Window.orderBy(first)  # one row a group, of those that a page of hits has
    return nested.withColumn("group", F.row_number().over(place))


def undone(rows: DataFrame, changes: DataFrame, key: str, text: str = "text", notes: str = "corrections") -> DataFrame:
    """Each (key, was, original) in ``changes`` applies if the row still reads ``was`` and has corrections; these go."""
    asked = changes.select(key, F.col("was").alias("_was"), F.col("original").alias("_original"))
    both = rows.join(asked, key, "left")
    applies = F.col("_was").isNotNull() & (F.col(text) == F.col("_was")) & F.col(notes).isNotNull()
    return both.withColumns({text: F.when(applies, F.col("_original")).otherwise(F.col(text)), notes: F.when(~applies | applies.isNull(), F.col(notes))}).select(rows.columns)


def patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Values that a patch gives replace those of its row; its nulls leave them. Patches without a row do nothing."""
    values = [c for c in patches.columns if c != key]
    both = rows.join(patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in values]), key, "left")
    return both.withColumns({c: F.coalesce(f"_new_{c}", c) for c in values}).select(rows.columns)


def without_parents(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys in ``gone``."""
    keys = gone.select(key).distinct()
    return {name: table.join(keys, key, "left_anti") for name, table in tables.items()}


def drift(rows: DataFrame, key: list[str], order: str, clock_ms: Column, delivered_ms: Column, least: int = 40, most: int = 200) -> DataFrame:
    """``drift_ms``: audio delivered up to a row less the clock since the key's first; ``correct_ms``: what to insert or drop, from ``least`` on."""
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("drift_ms", F.sum(delivered_ms).over(upto) - (clock_ms - F.first(clock_ms).over(upto)))
    beyond = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("drift_ms")))
    return found.withColumn("correct_ms", F.when(F.abs("drift_ms") >= least, -beyond).otherwise(F.lit(0)))


def ringing(levels: Column, per_hop: float) -> Column:
    """The level that a room still holds at each hop: the highest so far, fading by ``per_hop``, one hop ahead."""
    def step(done: Column, at: Column) -> Column:
        ahead = F.coalesce(F.get(levels, at + 1), F.get(levels, at))
        held = F.greatest(done.held * per_hop, F.get(levels, at), ahead)
        return F.struct(held.alias("held"), F.concat(done.out, F.array(held)).alias("out"))

    start = F.struct(F.lit(0.0).alias("held"), F.array().cast("array<double>").alias("out"))
    places = F.when(F.size(levels) > 0, F.sequence(F.lit(0), F.size(levels) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda done: done.out)


def is_copy(correlation: Column, span_ms: Column, mic_voice_ms: Column, far_voice_ms: Column, own_voice_ms: Column, warm: Column) -> Column:
    """Whether the evidence says that the microphone heard the other channel and nobody else."""
    covered = F.greatest(F.floor(mic_voice_ms * 6 / 10), F.lit(FAR_VOICE_MS))
    enough = (span_ms >= F.when(warm, SPAN_WARM_MS).otherwise(SPAN_COLD_MS)) & (mic_voice_ms >= MIC_VOICE_MS)
    return enough & (correlation >= COPY_CORRELATION) & (far_voice_ms >= covered) & (own_voice_ms < OWN_VOICE_MS)


def released(rows: DataFrame, key: list[str], start: str = "t_start_ms", end: str = "t_end_ms", channel: str = "channel", order: str = "turn") -> DataFrame:
    """``released_ms``: when a line of the microphone can be judged, the other channel having reached past it or the wait being over.

    Lines leave in order. The other channel's own lines do not wait but for those before them.
    """
    later = Window.partitionBy(*key).orderBy(-F.col(end)).rangeBetween(Window.unboundedPreceding, FAR_REACH_MS)  # a running minimum, latest first
    reached = F.min(F.when(F.col(channel) != "mic", F.greatest(F.col(end), F.lit(0)))).over(later)
    ready = F.when(F.col(channel) == "mic", F.greatest(F.col(end), F.least(reached, F.col(end) + FAR_WAIT_MS))).otherwise(F.col(end))
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_ready", ready).withColumn("released_ms", F.max("_ready").over(upto)).drop("_ready")


def snoozed(rows: DataFrame, key: list[str], order: list[str], at: str, until: Column) -> DataFrame:
    """``quiet``: whether a snooze set by an earlier row of the key, the latest, still runs; ``until`` is null where a row sets none."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("quiet", F.coalesce(F.last(until, ignorenulls=True).over(before) > F.col(at), F.lit(False)))


def stretch_language(settled: Column, heard: Column, confidence: Column, speech_ms: Column) -> Column:
    """The language to read one stretch in: another than the meeting's only if heard surely and for long enough."""
    code = F.lower(F.trim(heard))
    observed = F.when((code != "") & (code != "auto") & (confidence >= USABLE), code)
    sure = (confidence >= OVERRIDE) & (speech_ms >= OVERRIDE_MS)
    return F.when(observed.isNull() | settled.isNull(), F.coalesce(observed, settled)).when((observed == settled) | sure, observed).otherwise(settled)


def carried(rows: DataFrame, key: list[str], order: str, truncated: Column, repetitive: Column) -> DataFrame:
    """``carry``: the last words of the key's line before, if that was cut off, sure enough and fresh, and in no other language."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - CARRY_WORDS + 1), F.lit(CARRY_WORDS)), " ")
    keeps = truncated & ~repetitive & (F.col("confidence").isNull() | (F.col("confidence") >= CARRY_CONFIDENCE)) & (F.size(words) > 0)
    line = Window.partitionBy(*key).orderBy(order)
    held = F.lag(F.when(keeps, F.struct(tail.alias("words"), "language", F.col("t_end_ms").alias("ended")))).over(line)
    fresh = (F.col("t_start_ms") - F.col("_held.ended") <= CARRY_GAP_MS) & (F.col("language").isNull() | F.col("_held.language").isNull() | (F.lower("language") == F.lower("_held.language")))
    return rows.withColumn("_held", held).withColumn("carry", F.when(fresh, F.col("_held.words"))).drop("_held")


def speaker_of(channel: Column) -> Column:
    """Who speaks on a live channel: the person at the computer, the first of the others, or nobody known."""
    return F.when(channel == "mic", "You").when(channel == "system", "Speaker 1")


def detection(channel: Column, from_disk: Column) -> Column:
    """The parameters of speech detection by channel and way of reading, as a struct."""
    pick = lambda name: F.when(channel == "mic", DETECTION["mic"][name]).otherwise(DETECTION["system"][name])
    tail = F.when(from_disk, F.floor(pick("tail_ms") * DISK_TAIL[0] / DISK_TAIL[1])).otherwise(pick("tail_ms")).cast("int")
    return F.struct(pick("enter").alias("enter"), pick("exit").alias("exit"), tail.alias("tail_ms"), pick("pre_ms").alias("pre_ms"), F.when(from_disk, DISK_POST_MS).otherwise(pick("post_ms")).alias("post_ms"))


def fair_order(rows: DataFrame, lane: list[str], channel: str, order: list[str]) -> DataFrame:
    """``turn_no``: the order in which a lane's rows are taken, channels by turns while both have some, the oldest's first."""
    place = F.row_number().over(Window.partitionBy(*lane, channel).orderBy(*order))
    first = F.first(channel).over(Window.partitionBy(*lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = rows.withColumns({"_place": place, "_other": (F.col(channel) != first).cast("int")})
    return ranked.withColumn("turn_no", F.row_number().over(Window.partitionBy(*lane).orderBy("_place", "_other", *order))).drop("_place", "_other")


def voices_wanted(meetings: DataFrame, override: str = "people", mic_spoke: str = "mic_spoke", most: int = 12) -> Column:
    """How many remote voices to look for: the people said to be there, less the one at the microphone if that spoke, one at least."""
    people = F.greatest(F.lit(1), F.least(F.lit(most), F.col(override)))
    return F.greatest(F.lit(1), people - F.when(F.col(mic_spoke), 1).otherwise(0))


def colour(ident: Column, palette: int) -> Column:
    """A stable place in a palette: the 32-bit rolling hash of the id's characters, without its sign."""
    span = 1 << 32
    rolled = F.aggregate(F.filter(F.split(ident, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(span)))
    return F.pmod(F.least(rolled, F.lit(span) - rolled), F.lit(palette)).cast("int")


def meeting_clock(rows: DataFrame, key: list[str], order: list[str], at: str, pause: Column, resume: Column) -> DataFrame:
    """``audio_ms``: time since the key's first row without what lies between a pause and the next resume; repeated pauses or resumes change nothing."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy(*key).orderBy(*order)
    state = F.last(F.when(pause, F.lit(True)).when(resume, F.lit(False)), ignorenulls=True).over(upto)
    held = rows.withColumn("_paused", F.coalesce(state, F.lit(False)))
    still = F.when(F.lag("_paused").over(line), F.col(at) - F.lag(at).over(line)).otherwise(F.lit(0))
    held = held.withColumn("_still", still)
    return held.withColumn("audio_ms", F.greatest(F.lit(0), F.col(at) - F.first(at).over(upto) - F.sum("_still").over(upto))).drop("_paused", "_still")
