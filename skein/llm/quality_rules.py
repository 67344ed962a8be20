"""Quality rules by document and by host, in SQL functions alone.

Each document is measured; rules on the measures fail it or not. Failures are counted by host, each
host's rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts (method of
moments), and a host whose shrunk rate of a rule passes that rule's limit takes its documents along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, documents, fresh, settle, whole_text, without

SPAN = 8
SYMBOLS = "#*$%&|<>"
#: Rules on the measures of a document, and the share of a host's documents that may fail each.
RULES = {
    "too_short": ("n_words < 20", 0.5),
    "repetitive": ("100 * n_repeat_words > 30 * n_words", 0.5),
    "symbols": ("10 * n_symbols > word_chars", 0.5),
    "copied_lines": ("2 * n_dup_lines > n_lines", 0.5),
}
#: The rules that fail a document by itself.
BASE = ("too_short", "repetitive")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words in windows of ``span`` words that are found twice or more, the first included."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (span - 1), F.lit(1)))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, span))))
    repeats = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, span)).otherwise(F.lit(0))
    return F.when(F.size(words) > span, let(windows, repeats)).otherwise(F.lit(0)).cast("long")


def _covered(windows: Column, span: int) -> Column:
    """Places under those windows that equal another: neighbours after sorting."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        same = F.transform(p, lambda e, k: F.when((e.h == F.get(p, k - 1).h) | (e.h == F.get(p, k + 1).h), e.i))
        return F.array_sort(F.array_compact(same))

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda at, k: F.least(F.lit(span), F.get(s, k + 1) - at))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return let(let(ranked, places), covered)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns MEASURES (long), which replace columns of those names. Null texts are empty."""
    kept = without(docs, [*MEASURES])
    whole, words, lines = fresh(docs, "_text", "_words", "_lines")
    found = kept.withColumn(whole, whole_text(text))
    found = found.withColumns({
        words: F.array_remove(F.split(whole, WORD_BREAK + "+"), ""),
        lines: F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    found = found.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words)),
    })
    return found.drop(whole, words, lines)


def host_rates(measured: DataFrame, host: Column, rules: dict = RULES) -> DataFrame:
    """A row for each host: host, n_docs, and each rule's shrunk rate of failures."""
    fails = [F.sum(F.expr(f"cast({rule} as long)")).alias(name) for name, (rule, _) in rules.items()]
    hosts = settle(measured.groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count("*").alias("n_docs"), *fails))
    n = F.sum("n_docs").cast("double")
    mean = {name: F.sum(name) / n for name in rules}
    totals = hosts.agg(F.count("*").alias("hosts"), n.alias("n"), *[m.alias(name) for name, m in mean.items()]).first()
    if not totals["hosts"]:
        return hosts.select("host", "n_docs", *[F.lit(0.0).alias(name) for name in rules])
    spread = hosts.agg(*[(F.sum(F.col("n_docs") * (F.col(x) / F.col("n_docs") - totals[x]) ** 2) / totals["n"]).alias(x) for x in rules]).first()
    shrunk = []
    for name in rules:
        m = totals[name]
        within = m * (1 - m) * (totals["hosts"] - 1) / totals["n"]
        between = max(spread[name] - within, 1e-9)
        weight = max(m * (1 - m) / between - 1, 1.0)
        shrunk.append(((F.col(name) + m * weight) / (F.col("n_docs") + weight)).alias(name))
    return hosts.select("host", "n_docs", *shrunk)


def judge(docs: DataFrame, host: str = "source", text: str = "text", rules: dict = RULES, base: tuple = BASE) -> DataFrame:
    """``docs`` without ``text``, with MEASURES, base_failed, host_failed and kept (booleans).

    A null host counts as the host "". An empty text has no words and so fails as too short. Repeated
    rows are judged alike and each counts for its host. An empty table gives an empty result.
    Columns named as those given here give way to them. A text of any length is measured whole, its words as one array.
    """
    verdicts = ("base_failed", "host_failed", "kept")
    measured = settle(measures(without(docs, verdicts), text).drop(text))
    (bad_host,) = fresh(measured, "_bad")
    over = F.lit(False)
    for name, (_, limit) in rules.items():
        over = over | (F.col(name) > limit)
    bad = host_rates(measured, F.col(host), rules).where(over).select(F.col("host").alias(bad_host))
    failed = F.expr(" or ".join(f"({rules[name][0]})" for name in base))
    joined = measured.join(bad, F.coalesce(F.col(host), F.lit("")) == F.col(bad_host), "left")
    out = joined.withColumns({"base_failed": failed, "host_failed": F.col(bad_host).isNotNull()}).drop(bad_host)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the rules, by themselves and by their source."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
  FROM (SELECT row_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs)
), windows AS (
  SELECT row_id, pos, string_agg(word, ' ') OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win
  FROM words QUALIFY pos <= n - 7
), starts AS (
  SELECT row_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, win) > 1
), repeats AS (
  SELECT row_id, sum(least(8, coalesce(next - pos, 8))) AS n_repeat_words
  FROM (SELECT row_id, pos, lead(pos) OVER (PARTITION BY row_id ORDER BY pos) AS next FROM starts) GROUP BY row_id
), sizes AS (
  SELECT row_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY row_id
), lines AS (
  SELECT row_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM docs
), measured AS (
  SELECT d.doc_id, d.host, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l.l)::BIGINT AS n_lines,
    (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN sizes s USING (row_id) LEFT JOIN repeats r USING (row_id) LEFT JOIN lines l USING (row_id)
), rules AS (
  SELECT host, unnest([1, 2, 3, 4]) AS rule, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words,
    10 * n_symbols > word_chars, 2 * n_dup_lines > n_lines]) AS failed FROM measured
), hosts AS (
  SELECT host, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM rules GROUP BY host, rule
), totals AS (
  SELECT rule, count(*) AS hosts, sum(n) AS total, sum(f) / sum(n) AS m FROM hosts GROUP BY rule
), priors AS (
  SELECT t.rule, m, greatest(m * (1 - m) / greatest(sum(n * (f / n - m) ** 2) / any_value(total)
    - m * (1 - m) * (any_value(hosts) - 1) / any_value(total), 1e-9) - 1, 1.0) AS weight
  FROM hosts h JOIN totals t USING (rule) GROUP BY t.rule, m
), bad AS (
  SELECT DISTINCT host FROM hosts JOIN priors USING (rule) WHERE (f + m * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND host NOT IN (SELECT host FROM bad) AS kept
FROM measured
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL = {"op10_quality_rules": _SQL}
