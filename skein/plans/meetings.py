"""Queries of read models and changes over conversations as meetings, and over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes as G
from ..operators import read_models as R
from ..sources.tables import SEGMENTS, read, segments


def c1_meeting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    override = rows.where("meeting_id % 4 = 0").select("meeting_id", (F.col("meeting_id") % 15).alias("override")).distinct()
    return R.meeting_list(rows, override)


def b2_title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").where(R.title_like("p_name", "RED_W"))
    return R.page(rows.select("p_partkey", "p_name").orderBy(F.desc("p_partkey")), R.LIST_ROWS, 40, 5)


def b3_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.transcript(segments(spark, sf_dir), 20_000, 60_000)
    return rows.select("meeting_id", "turn", "t_start_ms", "t_end_ms")


def b9_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def b10_silent_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    heard = rows.where("is_final and channel = 'mic'").where(R.said()).where("t_end_ms - t_start_ms >= 30000")
    return rows.select("meeting_id").distinct().join(heard, "meeting_id", "left_anti")


def b12_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    return rows.select("meeting_id", "turn", R.snippet(R.first_prose(F.col("text")), 30).alias("preview"))


def _speakers(rows: DataFrame) -> DataFrame:
    found = rows.select("meeting_id", F.col("speaker_id").alias("id")).distinct()
    return found.withColumn("alias_of", F.when(F.col("id") % 10 == 2, F.col("id") - 2))


def c2_audible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    return R.audible(_speakers(rows), rows.where("t_end_ms - t_start_ms < 20000")).groupBy("meeting_id").agg(F.count("*").alias("people"))


def c4_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("samples"), F.max("o_orderdate").alias("last_heard"))
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return people.join(orders, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("samples", F.lit(0)).alias("samples"), "last_heard", F.col("samples").isNull().alias("needs_refresh"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") - 1 - 10_000 * (F.col("c_custkey") % 97 == 5).cast("long")).alias("alias_of"))


def c8_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_aliases(_chain(spark, sf_dir))


def c9_transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    speakers = R.resolve_aliases(_speakers(rows).where("id % 10 <> 1"))
    has_system = F.max(F.col("channel") == "system").over(Window.partitionBy("meeting_id"))
    named = rows.withColumn("far", has_system).where("is_final").where(R.said()).join(speakers, F.col("speaker_id") == F.col("id"), "left")
    label = F.coalesce(F.concat(F.lit("Speaker "), F.col("root").cast("string")), F.when(F.col("channel") == "mic", "You").when(F.col("far"), "Them").otherwise("Speaker"))
    return named.select("meeting_id", "turn", label.alias("label"), F.trim("text").alias("line"))


def c12_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.initcap("p_name").alias("word"))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit(" "), "n_name").alias("word"))
    removed = read(spark, sf_dir, "part").where("p_partkey % 50 = 7").select(F.upper("p_name").alias("word"))
    return R.union_distinct(typed, names, removed).select("list", "pos", "word")


def d3_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).groupBy("meeting_id").pivot("channel", ["mic", "system"]).agg(F.max(F.when(F.col("is_final"), F.col("t_end_ms"))))
    return rows.select("meeting_id", F.greatest(F.coalesce("mic", F.lit(0)), F.coalesce("system", F.lit(0))).alias("read_to_ms"))


def d4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.language_shares(segments(spark, sf_dir))


def d5_spoken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spoken_in(R.language_shares(segments(spark, sf_dir)))


def d6_speaking_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    spoken = rows.where("is_final").groupBy(F.col("speaker_id").alias("id")).agg(F.sum(F.col("t_end_ms") - F.col("t_start_ms")).alias("ms"))
    return _speakers(rows).join(spoken, "id", "left").select("meeting_id", "id", F.coalesce("ms", F.lit(0)).alias("speaking_ms"))


def d7_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.datediff("l_shipdate", F.lit("2000-01-01").cast("timestamp_ntz")).cast("long")
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(R.exact_median(lag).alias("lag_days"))


def d8_shaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shaky(segments(spark, sf_dir), least=6).select("meeting_id", "turn", "shaky")


def d12_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("t_end_ms") - F.col("t_start_ms")
    return segments(spark, sf_dir).groupBy("speaker_id").agg((F.sum(ms * F.col("confidence")) / F.sum(ms)).alias("confidence"))


def d14_carry_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    task = F.concat_ws(" ", "l_returnflag", F.pmod("l_partkey", F.lit(50)).cast("string"))
    old = lines.where("l_linenumber <= 3").select("l_suppkey", F.concat(F.lit(" "), F.lower(task)).alias("description"), (F.col("l_linestatus") == "F").alias("done"))
    new = lines.where("l_linenumber > 3").select("l_suppkey", task.alias("description")).distinct()
    return G.carry_done(new, old, "l_suppkey")


def d16_repeat_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("meetings"), F.sum("l_quantity").alias("speech"), F.max("l_shipdate").alias("last"), F.max_by("l_orderkey", F.struct("l_quantity", "l_orderkey")).alias("example"))
    return rows.where("meetings >= 3")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("download", "catch_up", "diarize", "mixdown", "summarize", "other", "tidy")])
    states = F.array(*[F.lit(s) for s in ("queued", "running", "paused", "done", "failed")])
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(200)).alias("meeting_id"), F.get(kinds, (F.col("o_orderkey") % 7).cast("int")).alias("kind"),
        F.get(states, (F.floor(F.col("o_orderkey") / 7) % 5).cast("int")).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("payload"), F.lit("reading").alias("phase"),
    )


def e1_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("meeting_id").orderBy(*R.queue_order())
    return _jobs(spark, sf_dir).where("status = 'queued'").withColumn("r", F.row_number().over(order)).where("r = 1").select("meeting_id", "id", "kind")


def e3_spaced_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).where("is_final")
    order = [F.desc(F.col("t_end_ms") - F.col("t_start_ms")), F.desc((F.col("confidence") * 1000).cast("int")), F.col("t_start_ms")]
    return R.spaced_top(rows, ["meeting_id", "channel"], order, "t_start_ms", 10_000, 3).select("meeting_id", "channel", "turn")


def f3_keep_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return R.keep_only(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keep, ["o_custkey"])


def f4_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    return R.reconcile(parts.where("p_size > 10").select("p_name", "p_type"), parts.where("p_size < 30 and p_retailprice > 950").select("p_name", "p_type"), ["p_name", "p_type"])


def g3_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("state"), F.lit("standing").alias("origin")).where("o_orderkey % 2 = 0").distinct()
    new = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("state"), F.lit("new").alias("origin"))
    return G.insert_or_ignore(rows, new, ["o_custkey", "state"])


def g4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = parts.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 7).alias("p_partkey"), F.upper("p_name").alias("p_name"), (F.col("p_size") + 100).alias("p_size"))
    return G.upsert(parts, new, ["p_partkey"], keep=("p_size",))


def g5_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    standing = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.pmod("o_custkey", F.lit(4)).alias("revision"))
    given = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).alias("o_orderstatus"), F.col("l_linenumber").cast("long").alias("revision"), "l_partkey")
    newest = given.groupBy("o_orderkey", "revision").agg(F.max("o_orderstatus").alias("o_orderstatus"))
    return G.revise(standing, newest, ["o_orderkey"])


def g8_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chain(spark, sf_dir).withColumn("meeting_id", F.floor(F.col("id") / 6)).where("alias_of is null or alias_of >= 0")
    pairs = rows.where("id % 6 = 3").select(F.col("id").alias("source"), (F.col("id") - 2).alias("target"))
    return G.merge_into(rows, pairs)


def g12_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.settle_jobs(_jobs(spark, sf_dir), {"queued": "paused", "running": "paused"}).select("id", "status", "phase")


def g13_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    wanted = spark.range(0, 220).select(F.col("id").alias("meeting_id"), F.lit("diarize").alias("kind"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
    return G.ensure_jobs(jobs, wanted).where("kind = 'diarize'").select("id", "meeting_id", "status", "payload")


def h1_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discontinuities of a user's events: the time since the one before, less what it carried, over a day."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    since = F.expr("timestampdiff(MICROSECOND, before, ts)") / 1000
    rows = read(spark, sf_dir, "events").withColumns({"before": F.lag("ts").over(own), "carried": F.lag("value").over(own) * 60_000})
    return rows.select("event_id", "user_id", F.round(since - F.col("carried")).cast("long").alias("gap_ms")).where("gap_ms > 86400000")


def h4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each user's last five purchases."""
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    rows = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    kept = rows.withColumn("held", F.sort_array(F.collect_list("value").over(last)))
    middle = lambda k: F.get("held", F.floor((F.size("held") - k) / 2).cast("int"))
    return kept.select("event_id", ((middle(1) + middle(0)) / 2).alias("trailing"))


def h5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of events above 50."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("over", F.col("value") > 50)
    rows = rows.withColumn("run", F.row_number().over(own) - F.row_number().over(Window.partitionBy("user_id", "over").orderBy("ts", "event_id")))
    return rows.where("over").groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


def h9_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers numbered by first appearance."""
    firsts = segments(spark, sf_dir).groupBy("meeting_id", "speaker_id").agg(F.min("t_start_ms").alias("first"))
    return firsts.select("meeting_id", "speaker_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy("first", "speaker_id")).alias("number"))


_QUERIES = (
    c1_meeting_list, b2_title_filter, b3_transcript, b9_latest, b10_silent_meetings, b12_snippets, c2_audible, c4_people, c8_aliases, c9_transcript_lines, c12_vocabulary, d3_watermark,
    d4_languages, d5_spoken_in, d6_speaking_time, d7_median, d8_shaky, d12_weighted_mean, d14_carry_done, d16_repeat_appearances, e1_queue, e3_spaced_top, f3_keep_only, f4_reconcile,
    g3_insert_or_ignore, g4_upsert, g5_revise, g8_merge, g12_pause, g13_ensure, h1_gaps, h4_trailing, h5_runs, h9_renumber,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_SPEAKERS = "speakers AS (SELECT DISTINCT meeting_id, speaker_id AS id, CASE WHEN speaker_id % 10 = 2 THEN speaker_id - 2 END AS alias_of FROM segments)"
_SHARES = "shares AS (SELECT meeting_id, language, sum(t_end_ms - t_start_ms)::BIGINT AS ms FROM segments WHERE is_final AND language IS NOT NULL GROUP BY ALL)"
_CHAIN = "chain AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey - 1 - 10000 * (c_custkey % 97 = 5)::BIGINT END AS alias_of FROM customer)"
_JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey % 200 AS meeting_id, ['download', 'catch_up', 'diarize', 'mixdown', 'summarize', 'other', 'tidy'][o_orderkey % 7 + 1] AS kind,
  ['queued', 'running', 'paused', 'done', 'failed'][(o_orderkey // 7) % 5 + 1] AS status, o_orderdate AS created_at, o_orderpriority AS payload, 'reading' AS phase FROM orders)"""
_PROSE = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|[-*] )'))[1]"
ORACLE_SQL = {
    "c1_meeting_list": f"""WITH {SEGMENTS}, m AS (SELECT meeting_id, count(DISTINCT speaker_id) AS speakers, sum(is_final::INT)::BIGINT AS lines, sum(CASE WHEN is_final THEN t_end_ms - t_start_ms ELSE 0 END)::BIGINT AS speech_ms,
  max(t_end_ms) AS duration_ms, arg_min(trim(text), turn) FILTER (is_final AND trim(text) <> '') AS first FROM segments GROUP BY meeting_id)
SELECT meeting_id, CASE WHEN meeting_id % 4 = 0 THEN least(greatest(meeting_id % 15, 1), 12) ELSE speakers END AS speakers, lines, speech_ms, duration_ms,
  CASE WHEN length(first) > 180 THEN left(first, 180) || '…' ELSE first END AS preview, meeting_id % 4 = 0 AS overridden FROM m""",
    "e3_spaced_top": f"""WITH {SEGMENTS}, r AS (SELECT meeting_id, channel, turn, t_start_ms AS t, row_number() OVER (PARTITION BY meeting_id, channel ORDER BY t_end_ms - t_start_ms DESC, trunc(confidence * 1000) DESC, t_start_ms) AS k FROM segments WHERE is_final),
a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT r.* FROM r JOIN a USING (meeting_id, channel) WHERE abs(r.t - a.t) >= 10000 QUALIFY row_number() OVER (PARTITION BY meeting_id, channel ORDER BY r.k) = 1),
c AS (SELECT r.* FROM r JOIN a USING (meeting_id, channel) JOIN b USING (meeting_id, channel) WHERE abs(r.t - a.t) >= 10000 AND abs(r.t - b.t) >= 10000 QUALIFY row_number() OVER (PARTITION BY meeting_id, channel ORDER BY r.k) = 1)
SELECT meeting_id, channel, turn FROM a UNION ALL SELECT meeting_id, channel, turn FROM b UNION ALL SELECT meeting_id, channel, turn FROM c""",
    "b2_title_filter": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red_w%' ORDER BY p_partkey DESC LIMIT 40 OFFSET 5",
    "b3_transcript": f"WITH {SEGMENTS} SELECT meeting_id, turn, t_start_ms, t_end_ms FROM segments WHERE is_final AND t_end_ms >= 20000 AND t_start_ms <= 60000",
    "b9_latest": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "b10_silent_meetings": f"WITH {SEGMENTS} SELECT DISTINCT meeting_id FROM segments a WHERE NOT EXISTS (SELECT 1 FROM segments b WHERE b.meeting_id = a.meeting_id AND is_final AND channel = 'mic' AND trim(text) <> '' AND t_end_ms - t_start_ms >= 30000)",
    "b12_snippets": f"WITH {SEGMENTS} SELECT meeting_id, turn, CASE WHEN length({_PROSE}) > 30 THEN left({_PROSE}, 30) || '…' ELSE {_PROSE} END AS preview FROM segments",
    "c2_audible": f"""WITH {SEGMENTS}, {_SPEAKERS} SELECT meeting_id, count(*) AS people FROM speakers s WHERE alias_of IS NULL AND EXISTS (
  SELECT 1 FROM segments g JOIN speakers o ON g.speaker_id = o.id WHERE g.is_final AND t_end_ms - t_start_ms < 20000 AND (o.id = s.id OR o.alias_of = s.id)) GROUP BY meeting_id""",
    "c4_people": "SELECT c_custkey, c_name, count(o_orderkey) AS samples, max(o_orderdate) AS last_heard, count(o_orderkey) = 0 AS needs_refresh FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "c8_aliases": f"""WITH RECURSIVE {_CHAIN}, walk AS (SELECT id, id AS root, alias_of, 0 AS hop FROM chain UNION ALL
  SELECT w.id, c.id, c.alias_of, hop + 1 FROM walk w LEFT JOIN chain c ON c.id = w.alias_of WHERE w.alias_of IS NOT NULL AND hop < 8)
SELECT id, root FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop DESC) = 1""",
    "c9_transcript_lines": f"""WITH {SEGMENTS}, {_SPEAKERS} SELECT g.meeting_id, turn, coalesce('Speaker ' || coalesce(s.alias_of, s.id)::VARCHAR, CASE WHEN channel = 'mic' THEN 'You'
  WHEN max(channel = 'system') OVER (PARTITION BY g.meeting_id) THEN 'Them' ELSE 'Speaker' END) AS label, trim(text) AS line
FROM segments g LEFT JOIN speakers s ON s.id = g.speaker_id AND s.id % 10 <> 1 AND (s.alias_of IS NULL OR EXISTS (SELECT 1 FROM speakers p WHERE p.id = s.alias_of)) WHERE trim(text) <> '' QUALIFY is_final""",
    "c12_vocabulary": """WITH w AS (SELECT 0 AS list, p_partkey AS pos, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS word FROM part
  UNION ALL SELECT 1, n_nationkey, ' ' || n_name FROM nation),
f AS (SELECT *, lower(trim(word)) AS folded FROM w), k AS (SELECT * FROM f WHERE folded NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_partkey % 50 = 7) AND folded <> ''
  QUALIFY row_number() OVER (PARTITION BY folded ORDER BY list, pos) = 1) SELECT list, pos, word FROM k ORDER BY list, pos LIMIT 200""",
    "d3_watermark": f"WITH {SEGMENTS} SELECT meeting_id, coalesce(max(t_end_ms) FILTER (is_final), 0) AS read_to_ms FROM segments GROUP BY meeting_id",
    "d4_languages": f"WITH {SEGMENTS}, {_SHARES} SELECT * FROM shares",
    "d5_spoken_in": f"""WITH {SEGMENTS}, {_SHARES}, k AS (SELECT *, ms / sum(ms) OVER (PARTITION BY meeting_id) AS share FROM shares), r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ms DESC, language) AS rank FROM k WHERE share >= 0.05)
SELECT meeting_id, max(language) FILTER (rank = 1) AS dominant, max(language) FILTER (rank = 2 AND share > 0.25) AS also FROM r GROUP BY meeting_id""",
    "d6_speaking_time": f"WITH {SEGMENTS} SELECT meeting_id, speaker_id AS id, coalesce(sum(t_end_ms - t_start_ms) FILTER (is_final), 0)::BIGINT AS speaking_ms FROM segments GROUP BY ALL",
    "d7_median": "SELECT l_suppkey, trunc(quantile_cont(date_diff('day', TIMESTAMP '2000-01-01', l_shipdate), 0.5))::BIGINT AS lag_days FROM lineitem GROUP BY l_suppkey",
    "d8_shaky": f"""WITH {SEGMENTS}, m AS (SELECT meeting_id, CASE WHEN count(confidence) FILTER (trim(text) <> '') >= 6 THEN quantile_cont(confidence, 0.5) FILTER (trim(text) <> '') END AS median FROM segments GROUP BY meeting_id)
SELECT meeting_id, turn, coalesce(median IS NOT NULL AND confidence < greatest(0.55, median * 0.75), false) AS shaky FROM segments JOIN m USING (meeting_id)""",
    "d12_weighted_mean": f"WITH {SEGMENTS} SELECT speaker_id, sum((t_end_ms - t_start_ms) * confidence) / sum(t_end_ms - t_start_ms) AS confidence FROM segments GROUP BY speaker_id",
    "d14_carry_done": """WITH n AS (SELECT DISTINCT l_suppkey, l_returnflag || ' ' || (l_partkey % 50) AS description FROM lineitem WHERE l_linenumber > 3),
o AS (SELECT l_suppkey, lower(l_returnflag || ' ' || (l_partkey % 50)) AS t, bool_or(l_linestatus = 'F') AS done FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
SELECT n.l_suppkey, description, coalesce(done, false) AS done FROM n LEFT JOIN o ON n.l_suppkey = o.l_suppkey AND lower(description) = t""",
    "d16_repeat_appearances": "SELECT l_partkey, count(DISTINCT l_suppkey) AS meetings, sum(l_quantity) AS speech, max(l_shipdate) AS last, arg_max(l_orderkey, (l_quantity, l_orderkey)) AS example FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 3",
    "e1_queue": f"""WITH {_JOBS} SELECT meeting_id, id, kind FROM jobs WHERE status = 'queued' QUALIFY row_number() OVER (PARTITION BY meeting_id
  ORDER BY coalesce(list_position(['download', 'catch_up', 'diarize', 'mixdown', 'summarize'], kind), 6), created_at DESC, id DESC) = 1""",
    "f3_keep_only": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "f4_reconcile": """WITH i AS (SELECT DISTINCT p_name, p_type FROM part WHERE p_size > 10), w AS (SELECT DISTINCT p_name, p_type FROM part WHERE p_size < 30 AND p_retailprice > 950)
SELECT coalesce(i.p_name, w.p_name) AS p_name, coalesce(i.p_type, w.p_type) AS p_type, CASE WHEN i.p_name IS NULL THEN 'missing' WHEN w.p_name IS NULL THEN 'obsolete' ELSE 'kept' END AS state
FROM i FULL JOIN w ON i.p_name = w.p_name AND i.p_type = w.p_type""",
    "g3_insert_or_ignore": "SELECT o_custkey, o_orderstatus AS state, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 'standing' ELSE 'new' END AS origin FROM orders GROUP BY ALL",
    "g4_upsert": """WITH n AS (SELECT p_partkey + 7 AS k, upper(p_name) AS name, p_size + 100 AS size FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(p_partkey, k) AS p_partkey, coalesce(name, p_name) AS p_name, coalesce(p_size, size) AS p_size FROM part FULL JOIN n ON p_partkey = k""",
    "g5_revise": """WITH g AS (SELECT l_orderkey, l_linenumber::BIGINT AS r, max(CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) END) AS s FROM lineitem GROUP BY ALL),
c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC) = 1)
SELECT o_orderkey, CASE WHEN o_custkey % 4 <= r THEN coalesce(s, o_orderstatus) ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
  CASE WHEN o_custkey % 4 <= r THEN r ELSE o_custkey % 4 END AS revision FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""",
    "g8_merge": f"""WITH RECURSIVE {_CHAIN}, rows AS (SELECT *, id // 6 AS meeting_id FROM chain WHERE alias_of IS NULL OR alias_of >= 0),
walk AS (SELECT id, id AS root, alias_of, 0 AS hop FROM rows UNION ALL SELECT w.id, c.id, c.alias_of, hop + 1 FROM walk w LEFT JOIN rows c ON c.id = w.alias_of WHERE w.alias_of IS NOT NULL AND hop < 8),
roots AS (SELECT id, root FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop DESC) = 1),
moves AS (SELECT s.id AS source, r.root AS dest FROM rows s JOIN rows t ON t.id = s.id - 2 JOIN roots r ON r.id = t.id WHERE s.id % 6 = 3 AND r.root <> s.id AND s.meeting_id = t.meeting_id)
SELECT r.id, coalesce(a.dest, b.dest, r.alias_of) AS alias_of, r.meeting_id FROM rows r LEFT JOIN moves a ON a.source = r.id LEFT JOIN moves b ON b.source = r.alias_of""",
    "g12_pause": f"WITH {_JOBS} SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'paused' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN NULL ELSE phase END AS phase FROM jobs",
    "g13_ensure": f"""WITH {_JOBS}, newest AS (SELECT * FROM jobs WHERE kind = 'diarize' AND status IN ('queued', 'running', 'paused') QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY created_at DESC, id DESC) = 1)
SELECT id, meeting_id, status, CASE WHEN id IN (SELECT id FROM newest) THEN 'p' || meeting_id ELSE payload END AS payload FROM jobs WHERE kind = 'diarize'
UNION ALL SELECT NULL, range, 'queued', 'p' || range FROM range(220) WHERE range NOT IN (SELECT meeting_id FROM newest)""",
    "h1_gaps": """WITH g AS (SELECT event_id, user_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER o) / 1000.0::DOUBLE - lag(value) OVER o * 60000)::BIGINT AS gap_ms FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT * FROM g WHERE gap_ms > 86400000""",
    "h4_trailing": "SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trailing FROM events WHERE event_type = 'purchase'",
    "h5_runs": """WITH r AS (SELECT user_id, value > 50 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS run FROM events),
n AS (SELECT user_id, run, count(*) AS n FROM r WHERE o GROUP BY ALL) SELECT user_id, max(n) AS longest FROM n GROUP BY user_id""",
    "h9_renumber": f"WITH {SEGMENTS} SELECT meeting_id, speaker_id, row_number() OVER (PARTITION BY meeting_id ORDER BY min(t_start_ms), speaker_id) AS number FROM segments GROUP BY meeting_id, speaker_id",
}
