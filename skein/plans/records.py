"""Queries of records: lookups, listings, guarded and partial updates, cascades, and verdicts over lines in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes as G
from ..operators import intervals as I
from ..operators import read_models as R
from ..operators import records as D
from ..sources.tables import SEGMENTS, SPANS, read, segments, spans
from .meetings import _JOBS, _jobs, _speakers

HOUR = 3_600_000


def a2_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of the star read whole: its rows."""
    counts = [read(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    found = counts[0]
    for other in counts[1:]:
        found = found.unionByName(other)
    return found


def b1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order by its key."""
    return read(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


def b4_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.jobs(_jobs(spark, sf_dir), kind="diarize", active=True, limit=100).select("id", "meeting_id", "status")


def b5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that went by air, numbered as listed."""
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    place = Window.partitionBy("l_orderkey").orderBy("l_linestatus", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(place).alias("place"))


def b7_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers of each meeting as listed: the user first, then by speech."""
    rows = segments(spark, sf_dir).groupBy("meeting_id", "speaker_id").agg(F.sum(F.col("t_end_ms") - F.col("t_start_ms")).alias("speaking_ms"))
    place = Window.partitionBy("meeting_id").orderBy((F.col("speaker_id") % 10 == 0).desc(), F.desc("speaking_ms"), "speaker_id")
    return rows.withColumn("place", F.row_number().over(place))


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).where("track = 'error'")
    return rows.select("event_id", "key", "s", "e", F.when(F.col("event_id") % 3 == 0, F.col("e")).alias("withdrawn_at"))


def b8_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.standing(_suppressed(spark, sf_dir)).select("event_id", "key", "s", "e")


def b11_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as typed records: flags from words, an enumeration with a default, times in milliseconds."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("partial")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return read(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), day.alias("ordered_ms"), F.col("o_orderpriority").startswith("1").alias("urgent"))


def b13_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speakers(segments(spark, sf_dir)).where("alias_of is null")
    label = F.when(F.col("id") % 10 == 0, " You ").when(F.col("id") % 30 == 1, "Ada").otherwise(F.concat(F.lit("Speaker "), (F.col("id") % 10).cast("string")))
    return rows.select("meeting_id", "id", D.machine_made(label).alias("machine_made"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.count("*").alias("samples"))
    return samples.withColumn("tag", F.when(F.col("person_id") % 4 == 0, "old").otherwise("new"))


def c5_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of people that are no alias, with samples by the embedder in use."""
    people = read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return _profiles(spark, sf_dir).join(people, "person_id").where("tag = 'new' and samples > 0").select("person_id", "name", "samples")


def c6_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of live meetings that are neither the user, an alias nor anybody known."""
    rows = segments(spark, sf_dir)
    live = rows.groupBy("meeting_id").agg(F.max("t_end_ms").alias("duration_ms")).where("meeting_id % 9 <> 0")
    return _speakers(rows).where("alias_of is null and id % 10 <> 0 and id % 70 <> 1").join(live, "meeting_id").select("meeting_id", "id", "duration_ms")


def c11_grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 longest lines as hits, nested by meeting in order of the first."""
    size = F.length("text")
    rows = segments(spark, sf_dir).orderBy(size.desc(), "meeting_id", "turn").limit(200)
    hits = rows.withColumn("rank", F.row_number().over(Window.orderBy(size.desc(), "meeting_id", "turn")))
    found = D.grouped_hits(hits, "meeting_id", "rank", "turn")
    return found.select("meeting_id", "group", F.array_join(F.transform("hits", lambda h: h.turn.cast("string")), ",").alias("turns"))


def d9_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").agg(F.coalesce(F.sum(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("long"))), F.lit(0)).alias("bytes"))


def e8_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final lines and open ones in order of their start."""
    rows = segments(spark, sf_dir)
    place = Window.partitionBy("meeting_id").orderBy("t_start_ms", F.desc("is_final"), "turn")
    return rows.select("meeting_id", "turn", "is_final", F.row_number().over(place).alias("place"))


def e9_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fair_order(segments(spark, sf_dir), ["meeting_id"], "channel", ["turn"]).select("meeting_id", "turn", "turn_no")


def g1_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New spans join the table, but for those of no width."""
    rows = spans(spark, sf_dir).select("event_id", "s", "e")
    new = rows.where("event_id % 4 = 0").select((F.col("event_id") + 1_000_000_000).alias("event_id"), "s", F.when(F.col("event_id") % 8 == 0, F.col("s")).otherwise(F.col("e")).alias("e"))
    return rows.unionByName(new.where("e > s"))


def g6_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("text"), F.when(F.col("p_partkey") % 3 > 0, "case").alias("corrections"))
    asked = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "else").otherwise(F.upper("p_name")).alias("was"), F.col("p_name").alias("original"))
    return D.undone(rows, asked, "p_partkey")


def g7_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    patches = rows.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "MOVED").alias("c_mktsegment"), F.lit(None).cast("string").alias("c_name"), F.when(F.col("c_custkey") % 9 == 0, 7).cast("int").alias("c_nationkey"))
    return D.patched(rows, patches.unionByName(patches.limit(1).withColumn("c_custkey", F.lit(-1).cast("long"))), "c_custkey")


def g9_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation go with all their orders and lines; rows left in each table."""
    gone = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    left = D.without_parents({"orders": orders, "lineitem": lines}, gone, "o_custkey")
    counts = [table.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, table in left.items()]
    return counts[0].unionByName(counts[1])


def g15_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression decisions as they come, live or from disk; one of a span that stands already changes nothing."""
    rows = _suppressed(spark, sf_dir).select("event_id", "key", F.lit("live").alias("via"))
    again = rows.where("event_id % 2 = 0").withColumn("via", F.lit("disk"))
    late = spans(spark, sf_dir).where("track = 'signup'").select("event_id", "key", F.lit("disk").alias("via"))
    return G.insert_or_ignore(rows, again.unionByName(late), ["event_id"])


def h2_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as audio of its length plus some milliseconds, on the clock of its end."""
    delivered = F.col("t_end_ms") - F.col("t_start_ms") + F.length("text") % 90
    found = D.drift(segments(spark, sf_dir), ["meeting_id"], "turn", F.col("t_end_ms"), delivered)
    return found.select("meeting_id", "turn", "drift_ms", "correct_ms")


def h6_ringing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a room holds of each vector's levels, the mean."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", D.ringing(F.transform("embedding", lambda x: F.abs(x.cast("double"))), 10 ** (-10 / 400)).alias("room"))
    return rows.select("vec_id", F.round(F.aggregate("room", F.lit(0.0), lambda a, x: a + x) / F.size("room"), 7).alias("held"))


def i1_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span's length, and what it shares with and lies from the one before it."""
    rows = spans(spark, sf_dir)
    before = Window.partitionBy("key").orderBy("s", "event_id")
    rows = rows.withColumns({"s_b": F.lag("s").over(before), "e_b": F.lag("e").over(before)}).where("s_b is not null")
    ends = [F.col(c) for c in ("s", "e", "s_b", "e_b")]
    return rows.select("event_id", I.length().alias("ms"), I.overlap(*ends).alias("shared"), I.gap(*ends).alias("gap"))


def j1_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a recording that signups pause and purchases resume."""
    found = D.meeting_clock(spans(spark, sf_dir), ["key"], ["s", "event_id"], "s", F.col("track") == "signup", F.col("track") == "purchase")
    return found.select("event_id", "audio_ms")


def j10_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.released(segments(spark, sf_dir), ["meeting_id"]).select("meeting_id", "turn", "released_ms")


def j16_snoozed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase keeps its user's events quiet for ``value`` times 36 minutes."""
    rows = spans(spark, sf_dir)
    until = F.when(F.col("track") == "purchase", F.col("s") + (F.col("e") - F.col("s")) * 36)
    return D.snoozed(rows, ["key"], ["s", "event_id"], "s", until).select("event_id", "quiet")


def j18_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = F.when(F.col("meeting_id") % 3 != 0, "en")
    heard = F.when(F.col("turn") % 6 == 5, "auto").otherwise(F.upper("language"))
    found = D.stretch_language(settled, heard, F.col("confidence"), F.col("t_end_ms") - F.col("t_start_ms"))
    return segments(spark, sf_dir).select("meeting_id", "turn", found.alias("language"))


def j19_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.carried(segments(spark, sf_dir), ["meeting_id", "channel"], "turn", F.length("text") > 40, F.col("turn") % 4 == 3)
    return found.select("meeting_id", "turn", "carry")


def j26_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("turn") % 11 == 10, "mixed").otherwise(F.col("channel"))
    return segments(spark, sf_dir).groupBy("meeting_id", D.speaker_of(channel).alias("speaker")).agg(F.count("*").alias("lines"))


def j27_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final lines up to a bound that have not gone out before."""
    rows = segments(spark, sf_dir).where("is_final and t_start_ms < 60000")
    sent = rows.where("t_end_ms <= 20000").select("meeting_id", "turn")
    return rows.join(sent, ["meeting_id", "turn"], "left_anti").select("meeting_id", "turn", "t_start_ms")


def j28_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("p", D.detection(F.col("channel"), F.col("meeting_id") % 2 == 0))
    return rows.groupBy("channel", "p.enter", "p.exit", "p.tail_ms", "p.pre_ms", "p.post_ms").agg(F.count("*").alias("lines"))


def l20_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many remote voices to look for where somebody said how many people there were."""
    rows = segments(spark, sf_dir).where("meeting_id % 3 = 0").groupBy("meeting_id").agg(F.max((F.col("channel") == "mic") & F.col("is_final") & R.said()).alias("mic_spoke"))
    rows = rows.withColumn("people", (F.col("meeting_id") % 17).cast("int"))
    return rows.select("meeting_id", D.voices_wanted(rows).alias("voices"))


def m3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence: correlation, span, and voices of both sides."""
    ms = F.col("t_end_ms") - F.col("t_start_ms")
    verdict = D.is_copy(F.col("confidence"), ms, F.floor(ms * 2 / 3), F.floor(ms / 2), F.length("text") * 7 % 500, F.col("turn") % 2 == 0)
    return segments(spark, sf_dir).select("meeting_id", "turn", verdict.alias("copy"))


def n29_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", D.colour(F.col("c_name"), 8).alias("colour"))


_QUERIES = (
    a2_scans, i1_measures, j1_clock, b1_lookup, b4_jobs, b5_chunks, b7_speakers, b8_standing, b11_typed_rows, b13_canonical, c5_profiles, c6_unnamed, c11_grouped_hits, d9_installed, e8_view, e9_fair, g1_insert, g6_undo, g7_patch, g9_cascade, g15_remember,
    h2_drift, h6_ringing, j10_released, j16_snoozed, j18_stretch, j19_carried, j26_attributed, j27_new_only, j28_parameters, l20_targets, m3_copies, n29_colours,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_SUPPRESSED = "sup AS (SELECT event_id, key, s, e, CASE WHEN event_id % 3 = 0 THEN e END AS withdrawn_at FROM spans WHERE track = 'error')"
_SPEAKERS = "speakers AS (SELECT DISTINCT meeting_id, speaker_id AS id, CASE WHEN speaker_id % 10 = 2 THEN speaker_id - 2 END AS alias_of FROM segments)"
_WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"
ORACLE_SQL = {
    "a2_scans": " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS rows FROM {name}" for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "i1_measures": f"""WITH {SPANS}, p AS (SELECT *, lag(s) OVER w AS a, lag(e) OVER w AS b FROM spans WINDOW w AS (PARTITION BY key ORDER BY s, event_id))
SELECT event_id, greatest(e - s, 0) AS ms, greatest(least(e, b) - greatest(s, a), 0) AS shared, greatest(greatest(s, a) - least(e, b), 0) AS gap FROM p WHERE a IS NOT NULL""",
    "j1_clock": f"""WITH {SPANS}, t AS (SELECT *, coalesce(last_value(CASE track WHEN 'signup' THEN true WHEN 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY s, event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM spans),
l AS (SELECT *, CASE WHEN lag(paused) OVER w THEN s - lag(s) OVER w ELSE 0 END AS still, first_value(s) OVER w AS began FROM t WINDOW w AS (PARTITION BY key ORDER BY s, event_id))
SELECT event_id, greatest(s - began - sum(still) OVER (PARTITION BY key ORDER BY s, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS audio_ms FROM l""",
    "b1_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "b4_jobs": f"WITH {_JOBS} SELECT id, meeting_id, status FROM jobs WHERE kind = 'diarize' AND status IN ('queued', 'running', 'paused') ORDER BY created_at DESC, id DESC LIMIT 100",
    "b5_chunks": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_linenumber)::INT AS place FROM lineitem WHERE l_returnflag = 'N'",
    "b7_speakers": f"""WITH {SEGMENTS}, s AS (SELECT meeting_id, speaker_id, sum(t_end_ms - t_start_ms)::BIGINT AS speaking_ms FROM segments GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY speaker_id % 10 = 0 DESC, speaking_ms DESC, speaker_id)::INT AS place FROM s""",
    "b8_standing": f"WITH {SPANS}, {_SUPPRESSED} SELECT event_id, key, s, e FROM sup WHERE withdrawn_at IS NULL AND e > s",
    "b11_typed_rows": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'partial' END AS status,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 AS ordered_ms, o_orderpriority LIKE '1%' AS urgent FROM orders""",
    "b13_canonical": f"WITH {SEGMENTS}, {_SPEAKERS} SELECT meeting_id, id, id % 10 = 0 OR id % 30 <> 1 AS machine_made FROM speakers WHERE alias_of IS NULL",
    "c5_profiles": "SELECT o_custkey AS person_id, any_value(c_name) AS name, count(*) AS samples FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 4 <> 0 AND o_custkey % 5 <> 0 GROUP BY o_custkey",
    "c6_unnamed": f"""WITH {SEGMENTS}, {_SPEAKERS}, live AS (SELECT meeting_id, max(t_end_ms) AS duration_ms FROM segments WHERE meeting_id % 9 <> 0 GROUP BY meeting_id)
SELECT meeting_id, id, duration_ms FROM speakers JOIN live USING (meeting_id) WHERE alias_of IS NULL AND id % 10 <> 0 AND id % 70 <> 1""",
    "c11_grouped_hits": f"""WITH {SEGMENTS}, h AS (SELECT meeting_id, turn, row_number() OVER (ORDER BY length(text) DESC, meeting_id, turn) AS rank FROM segments QUALIFY rank <= 200)
SELECT meeting_id, row_number() OVER (ORDER BY min(rank))::INT AS "group", string_agg(turn::VARCHAR, ',' ORDER BY rank) AS turns FROM h GROUP BY meeting_id""",
    "d9_installed": "SELECT coalesce(sum(p_size) FILTER (p_partkey % 3 = 0), 0)::BIGINT AS bytes FROM part",
    "e8_view": f"WITH {SEGMENTS} SELECT meeting_id, turn, is_final, row_number() OVER (PARTITION BY meeting_id ORDER BY t_start_ms, is_final DESC, turn)::INT AS place FROM segments",
    "e9_fair": f"""WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, channel ORDER BY turn) AS place,
  first_value(channel) OVER (PARTITION BY meeting_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lead_channel FROM segments)
SELECT meeting_id, turn, row_number() OVER (PARTITION BY meeting_id ORDER BY place, channel <> lead_channel, turn)::INT AS turn_no FROM r""",
    "g1_insert": f"WITH {SPANS} SELECT event_id, s, e FROM spans UNION ALL SELECT event_id + 1000000000, s, e FROM spans WHERE event_id % 4 = 0 AND event_id % 8 <> 0 AND e > s",
    "g6_undo": """WITH p AS (SELECT p_partkey, p_name, p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AND p_partkey % 3 > 0 AS undone FROM part)
SELECT p_partkey, CASE WHEN undone THEN p_name ELSE upper(p_name) END AS text, CASE WHEN NOT undone AND p_partkey % 3 > 0 THEN 'case' END AS corrections FROM p""",
    "g7_patch": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer""",
    "g9_cascade": """WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))
SELECT 'orders' AS name, count(*) AS rows FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN o ON o_orderkey = l_orderkey""",
    "g15_remember": f"WITH {SPANS}, {_SUPPRESSED} SELECT event_id, key, 'live' AS via FROM sup UNION ALL SELECT event_id, key, 'disk' FROM spans WHERE track = 'signup'",
    "h2_drift": f"""WITH {SEGMENTS}, d AS (SELECT meeting_id, turn, (sum(t_end_ms - t_start_ms + length(text) % 90) OVER w - (t_end_ms - first_value(t_end_ms) OVER w))::BIGINT AS drift_ms FROM segments
  WINDOW w AS (PARTITION BY meeting_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT meeting_id, turn, drift_ms, CASE WHEN abs(drift_ms) >= 40 THEN -least(greatest(drift_ms, -200), 200) ELSE 0 END AS correct_ms FROM d""",
    "h6_ringing": """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT vec_id, i, abs(v) AS x FROM c),
b AS (SELECT vec_id, i, greatest(x, coalesce(lead(x) OVER (PARTITION BY vec_id ORDER BY i), x)) AS x FROM a),
h AS (SELECT k.vec_id, k.i, max(j.x * pow(10, -(k.i - j.i) / 40.0)) AS held FROM b k JOIN b j ON j.vec_id = k.vec_id AND j.i <= k.i GROUP BY ALL)
SELECT vec_id, round(avg(held), 7) AS held FROM h GROUP BY vec_id""",
    "j10_released": f"""WITH {SEGMENTS}, r AS (SELECT a.meeting_id, a.turn, CASE WHEN channel = 'mic' THEN greatest(t_end_ms, least(coalesce((SELECT min(b.t_end_ms) FROM segments b WHERE b.meeting_id = a.meeting_id
  AND b.channel <> 'mic' AND b.t_end_ms >= a.t_end_ms - 200), t_end_ms + 500), t_end_ms + 500)) ELSE t_end_ms END AS ready FROM segments a)
SELECT meeting_id, turn, max(ready) OVER (PARTITION BY meeting_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS released_ms FROM r""",
    "j16_snoozed": f"""WITH {SPANS}, u AS (SELECT *, last_value(CASE WHEN track = 'purchase' THEN s + (e - s) * 36 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM spans)
SELECT event_id, coalesce(until > s, false) AS quiet FROM u""",
    "j18_stretch": f"""WITH {SEGMENTS}, r AS (SELECT meeting_id, turn, CASE WHEN meeting_id % 3 <> 0 THEN 'en' END AS settled, CASE WHEN turn % 6 <> 5 AND confidence >= 0.35 THEN language END AS heard,
  confidence >= 0.85 AND t_end_ms - t_start_ms >= 3000 AS sure FROM segments)
SELECT meeting_id, turn, CASE WHEN heard IS NULL OR settled IS NULL THEN coalesce(heard, settled) WHEN heard = settled OR sure THEN heard ELSE settled END AS language FROM r""",
    "j19_carried": f"""WITH {SEGMENTS}, k AS (SELECT meeting_id, channel, turn, t_start_ms, t_end_ms, language, {_WORDS} AS w, length(text) > 40 AND turn % 4 <> 3 AND confidence >= 0.5 AS keeps FROM segments),
p AS (SELECT *, lag(keeps) OVER c AS kept, lag(array_to_string(w[-30:], ' ')) OVER c AS words, lag(language) OVER c AS before, lag(t_end_ms) OVER c AS ended FROM k WINDOW c AS (PARTITION BY meeting_id, channel ORDER BY turn))
SELECT meeting_id, turn, CASE WHEN kept AND t_start_ms - ended <= 1500 AND (language IS NULL OR before IS NULL OR language = before) THEN words END AS carry FROM p""",
    "j26_attributed": f"""WITH {SEGMENTS} SELECT meeting_id, CASE WHEN turn % 11 = 10 THEN NULL WHEN channel = 'mic' THEN 'You' ELSE 'Speaker 1' END AS speaker, count(*) AS lines FROM segments GROUP BY ALL""",
    "j27_new_only": f"WITH {SEGMENTS} SELECT meeting_id, turn, t_start_ms FROM segments WHERE is_final AND t_start_ms < 60000 AND t_end_ms > 20000",
    "j28_parameters": f"""WITH {SEGMENTS}, p AS (SELECT channel, channel = 'mic' AS m, meeting_id % 2 = 0 AS disk FROM segments)
SELECT channel, CASE WHEN m THEN 0.38 ELSE 0.48 END::DOUBLE AS enter, CASE WHEN m THEN 0.22 ELSE 0.32 END::DOUBLE AS exit, CASE WHEN m AND disk THEN 700 WHEN m THEN 400 WHEN disk THEN 560 ELSE 320 END AS tail_ms,
  CASE WHEN m THEN 320 ELSE 224 END AS pre_ms, CASE WHEN disk THEN 384 ELSE 288 END AS post_ms, count(*) AS lines FROM p GROUP BY ALL""",
    "l20_targets": f"""WITH {SEGMENTS}, m AS (SELECT meeting_id, max((channel = 'mic' AND is_final AND trim(text) <> '')::INT) AS spoke FROM segments WHERE meeting_id % 3 = 0 GROUP BY meeting_id)
SELECT meeting_id, greatest(1, greatest(1, least(12, meeting_id % 17)) - spoke)::INT AS voices FROM m""",
    "m3_copies": f"""WITH {SEGMENTS}, e AS (SELECT *, t_end_ms - t_start_ms AS ms FROM segments)
SELECT meeting_id, turn, ms >= CASE WHEN turn % 2 = 0 THEN 2500 ELSE 3000 END AND ms * 2 // 3 >= 1000 AND confidence >= 0.7 AND ms // 2 >= greatest(ms * 2 // 3 * 6 // 10, 300) AND length(text) * 7 % 500 < 400 AS copy FROM e""",
    "n29_colours": """WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM customer)
SELECT c_custkey, (least(h, 4294967296 - h) % 8)::INT AS colour FROM h""",
}
