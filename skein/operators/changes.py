"""Changes to tables as transformations: each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .read_models import resolve_aliases


def insert_or_ignore(standing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is free join the table; of two new rows of a key, either. Standing rows stay."""
    return standing.unionByName(new.join(standing.select(*key), key, "left_anti").dropDuplicates(key).select(standing.columns))


def upsert(standing: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace those of their key, but for the columns in ``keep``, where a standing value stays."""
    renamed = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in key], F.lit(True).alias("_new"))
    both = standing.withColumn("_old", F.lit(True)).join(renamed, key, "full_outer")
    columns = []
    for c in standing.columns:
        if c in key:
            columns.append(F.col(c))
        else:
            own, given = F.col(c), F.col(f"_new_{c}")
            columns.append((F.coalesce(own, given) if c in keep else F.when(F.col("_new"), given).otherwise(own)).alias(c))
    return both.select(*columns)


def revise(standing: DataFrame, changes: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """Changes apply where the stored revision is not newer; nulls in a change leave a value as it is. Of several changes the newest counts."""
    values = [c for c in changes.columns if c not in (*key, revision)]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*values, revision), revision).alias("_c"))
    both = standing.join(newest, key, "left")
    applies = F.col("_c").isNotNull() & (F.col(revision) <= F.col(f"_c.{revision}"))
    changed = {c: F.when(applies, F.coalesce(F.col(f"_c.{c}"), F.col(c))).otherwise(F.col(c)) for c in values}
    return both.withColumns(changed | {revision: F.when(applies, F.col(f"_c.{revision}")).otherwise(F.col(revision))}).drop("_c")


def merge_into(rows: DataFrame, pairs: DataFrame, key: str = "id", alias: str = "alias_of", scope: str = "meeting_id") -> DataFrame:
    """Each ``source`` in ``pairs`` becomes an alias of the root of its ``target``, its own aliases too.

    Pairs over scopes, of one root, or whose target hangs below the source change nothing.
    """
    roots = resolve_aliases(rows, key, alias).withColumnRenamed(key, "_id")
    placed = pairs.join(roots.select(F.col("_id").alias("source"), F.col("root").alias("_from")), "source").join(roots.select(F.col("_id").alias("target"), F.col("root").alias("_into")), "target")
    where = rows.select(F.col(key).alias("_k"), F.col(scope).alias("_s"))
    placed = placed.join(where.select(F.col("_k").alias("source"), F.col("_s").alias("_s1")), "source").join(where.select(F.col("_k").alias("target"), F.col("_s").alias("_s2")), "target")
    moves = placed.where("_into <> source and _s1 = _s2").groupBy(F.col("source").alias("_source")).agg(F.min("_into").alias("_into"))
    named = moves.select(F.col("_source").alias("_m"), "_into")
    own = rows.join(named, F.col(key) == F.col("_m"), "left").withColumnRenamed("_into", "_own").drop("_m")
    below = own.join(named, F.col(alias) == F.col("_m"), "left").drop("_m")
    return below.withColumn(alias, F.coalesce("_own", "_into", alias)).select(rows.columns)


def settle_jobs(jobs: DataFrame, change: dict[str, str]) -> DataFrame:
    """Statuses changed as a set; a changed row loses its phase."""
    status = F.col("status")
    new = F.coalesce(*[F.when(status == a, F.lit(b)) for a, b in change.items()], status)
    return jobs.withColumns({"phase": F.when(new == status, F.col("phase")), "status": new})


def ensure_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A job for each wanted (meeting_id, kind, payload): the newest active one with its payload renewed, or a new queued one."""
    active = jobs.where(F.col("status").isin("queued", "running", "paused"))
    newest = active.withColumn("_r", F.row_number().over(Window.partitionBy("meeting_id", "kind").orderBy(F.desc("created_at"), F.desc("id")))).where("_r = 1").drop("_r")
    asked = wanted.select("meeting_id", "kind", F.col("payload").alias("_payload"))
    found = newest.join(asked, ["meeting_id", "kind"]).select(F.col("id").alias("_job"), "_payload")
    renewed = jobs.join(found, F.col("id") == F.col("_job"), "left").withColumn("payload", F.coalesce("_payload", "payload")).select(jobs.columns)
    missing = asked.join(newest.select("meeting_id", "kind"), ["meeting_id", "kind"], "left_anti")
    new = missing.select(*[F.col(c) if c in ("meeting_id", "kind") else F.col("_payload").alias(c) if c == "payload" else F.lit("queued").alias(c) if c == "status" else F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns])
    return renewed.unionByName(new)


def carry_done(new: DataFrame, old: DataFrame, key: str, text: str = "description") -> DataFrame:
    """New tasks take ``done`` over from an old task of the same text, case and outer blanks aside; of duplicates, done wins."""
    fold = F.lower(F.trim(text))
    before = old.groupBy(key, fold.alias("_t")).agg(F.max("done").alias("_done"))
    return new.withColumn("_t", fold).join(before, [key, "_t"], "left").withColumn("done", F.coalesce("_done", F.lit(False))).drop("_t", "_done")
