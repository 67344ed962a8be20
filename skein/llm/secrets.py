"""Secret scans over a ledger of blobs, in SQL functions alone.

A text's SHA-256 names its blob. The ledger has a row for each (blob, rule version) ever scanned,
with its findings. A scan takes any number of versions of any number of paths, scans each blob that
the ledger lacks under this rule version once, appends it, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, settle, shared_dir, whole_text, without


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds group ``group``; a match counts if that group has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: In the order that ranks spans of one start. Fixed patterns; either case is spelt out for ASCII letters.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", "([0-9a-f]+)", 1, 24),
)
VERSION = "1"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (code points, end exclusive) of a rule's leftmost non-overlapping matches that count.

    A match starts where the texts between matches and the matches before it end.
    """
    whole, part = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    rows = F.arrays_zip(between.alias("b"), whole.alias("w"), part.alias("p"))

    def step(done: Column, row: Column) -> Column:
        start = done.at + F.length(row.b)
        end = start + F.length(row.w)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(row.p) >= rule.least, F.concat(done.spans, F.array(span))).otherwise(done.spans).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    found = F.aggregate(F.transform(rows, lambda r: F.struct(r["b"].alias("b"), r["w"].alias("w"), r["p"].alias("p"))), empty, step, lambda done: done.spans)
    tail = rule.pattern.removesuffix("+)")
    # few texts hold a match that counts; the others are dismissed by one search
    return F.when(text.rlike(f"{tail}{{{rule.least - (4 if rule.kind == 'access' else 0)},}})"), found).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of all rules by start, then rule."""
    return F.array_sort(F.concat(*[spans(text, rule, k) for k, rule in enumerate(rules)]))


def scan(versions: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """``versions`` without ``text``, with ``blob`` and ``spans``, all paths and versions of a blob alike.

    ``ledger`` is the folder of the ledger, a Parquet table that grows; it may not exist yet. A null
    text is the empty blob. Repeated rows stay. An empty table leaves the ledger as it was. Columns
    named blob or spans give way. A blob that two scans at once add twice counts once. A text of any length is
    scanned whole, as one value of its row.
    """
    spark = versions.sparkSession
    whole, path, first, seen_blob = fresh(versions, "_text", "_key", "_first", "_blob")
    rows = without(versions, ["blob", "spans"]).withColumn(whole, whole_text(text))
    rows = rows.withColumn("blob", F.sha2(whole, 256))
    paths = settle(rows.drop(whole, text))
    # where a blob's first path is: copies of one blob differ in it, so no key is hot below
    firsts = paths.groupBy("blob").agg(F.min(F.col(key)).alias(first))
    if _exists(spark, ledger):
        seen = spark.read.parquet(ledger).where(F.col("rule_version") == version).select("blob")
        firsts = firsts.join(seen, "blob", "left_anti")
    # the build side is two short columns; sorting the texts for a merge would cost more than the scan
    texts = rows.select("blob", F.col(key).alias(path), whole)
    unseen = texts.join(firsts.withColumnRenamed("blob", seen_blob).hint("shuffle_hash"), (F.col("blob") == F.col(seen_blob)) & F.col(path).eqNullSafe(F.col(first)), "left_semi")
    new = unseen.select("blob", F.lit(version).alias("rule_version"), all_spans(F.col(whole), rules).alias("spans"))
    new.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    found = spark.read.parquet(ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    return paths.join(found.select("blob", "spans"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def written(found: Column) -> Column:
    """Spans as kind:start:end, with commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, over a new ledger."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), f"{shared_dir(spark)}/ledger")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT row_id, {rank} AS rank, '{rule.kind}' AS kind, length(p) AS size,
    list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k-1], lambda x: length(x))), 0) AS s,
    list_sum(list_transform(b[1:k], lambda x: length(x))) + list_sum(list_transform(w[1:k], lambda x: length(x))) AS e
  FROM (SELECT row_id, b, w, unnest(p) AS p, generate_subscripts(w, 1) AS k FROM (
    SELECT row_id, regexp_split_to_array(text, '{pattern}') AS b, regexp_extract_all(text, '{pattern}', 0) AS w,
      regexp_extract_all(text, '{pattern}', {rule.group}) AS p FROM docs WHERE regexp_matches(text, '{pattern}') AND {rank} <> 2
    UNION ALL SELECT row_id, regexp_split_to_array(text, '{pattern}'), regexp_extract_all(text, '{pattern}', 0),
      regexp_extract_all(text, '{pattern}', {rule.group}) FROM docs WHERE {rank} = 2 AND regexp_matches(text, '[0-9a-f]{{24}}')))
  WHERE length(p) >= {rule.least}""")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({' UNION ALL '.join(parts)}
), joined AS (
  SELECT row_id, sum((rank = 0)::INT) AS a, sum((rank = 1)::INT) AS b, sum((rank = 2)::INT) AS c,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans FROM found GROUP BY row_id
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (row_id)
"""


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL = {"op2_secrets": _sql()}
