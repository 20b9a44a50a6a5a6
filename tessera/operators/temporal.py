"""Facts with validity intervals: versions, as-of reads, current truth, change feeds and upkeep.

A fact is a row (fact_id, subject, predicate, object, valid_from, valid_until,
superseded_by, status, source, updated_at). Intervals are half-open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import scratch_folder

KEY = ("subject", "predicate")


def build_versions(rows: DataFrame, key: Sequence[str] = KEY, at: str = "valid_from", number: str = "fact_id") -> DataFrame:
    """Close each version of a key where the next begins: adds valid_until, superseded_by, status and
    superseded_at, the time at which the next was recorded (later than it begins if it came late)."""
    w = Window.partitionBy(*key).orderBy(at, number)
    recorded = F.coalesce("updated_at", at) if "updated_at" in rows.columns else F.col(at)
    rows = rows.withColumn("valid_until", F.lead(at).over(w)).withColumn("superseded_by", F.lead(number).over(w)).withColumn("superseded_at", F.lead(recorded).over(w))
    return rows.withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


def valid_at(t: Column) -> Column:
    return (F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))


def as_of(facts: DataFrame, t: Column) -> DataFrame:
    """Facts that held at ``t``, superseded ones included."""
    return facts.where(F.col("status").isin("active", "superseded") & valid_at(t))


def current_truth(facts: DataFrame, now: Column) -> DataFrame:
    return as_of(facts, now).where((F.col("status") == "active") & F.col("superseded_by").isNull())


def edges_as_of(facts: DataFrame, t: Column) -> DataFrame:
    """Facts that were graph edges at ``t``: a successor, if any, came later."""
    return as_of(facts, t).where(F.col("superseded_by").isNull() | (F.col("valid_until") > t))


def as_of_join(probes: DataFrame, facts: DataFrame, key: Sequence[str] = KEY, at: str = "at") -> DataFrame:
    """Each probe row with the version of its key that held at its time; an equi join and an interval test."""
    right = facts.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in facts.columns if c not in key])
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("valid_from") <= F.col(at), F.col("valid_until").isNull() | (F.col("valid_until") > F.col(at))]
    return probes.join(right, on).drop(*[f"_{k}" for k in key])


def latest_values(facts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Newest object of each key: one aggregate, no sort."""
    newest = F.max_by(F.struct("object", "valid_from", "fact_id"), F.struct("valid_from", "fact_id"))
    return facts.groupBy(*key).agg(newest.alias("v")).select(*key, "v.object", "v.valid_from", "v.fact_id")


def history(facts: DataFrame, subject: str, predicate: str, limit: int = 50) -> DataFrame:
    """Versions of one key, newest first."""
    rows = facts.where((F.col("subject") == subject) & (F.col("predicate") == predicate))
    return rows.orderBy(F.col("valid_from").desc(), "fact_id").limit(limit)


def changed_at(updated: str = "updated_at", start: str = "valid_from") -> Column:
    return F.coalesce(F.col(updated), F.col(start))


def change_feed(facts: DataFrame, since: Column, now: Column) -> DataFrame:
    """Upserts (d) and retractions (r) after a cursor, with the next cursor. Strictly later changes only.

    To supersede a fact is to change it, at the time its successor was recorded: a fact
    that the reader holds and that was superseded since is retracted, also where the
    successor begins before the cursor."""
    moved = facts.where(F.greatest(changed_at(), "superseded_at") > since)
    live = valid_at(now) & (F.col("status") == "active") & F.col("superseded_by").isNull()
    return moved.select("fact_id", *KEY, "object", F.when(live, "d").otherwise("r").alias("op"), now.alias("cursor"))


def conflicts(facts: DataFrame) -> DataFrame:
    """Keys with two or more different objects, members sorted."""
    agg = facts.groupBy(*KEY).agg(F.sort_array(F.collect_set("object")).alias("objects"), F.count("*").alias("members"))
    return agg.where(F.size("objects") > 1).select(*KEY, F.size("objects").alias("n_objects"), "members", F.array_join("objects", "|").alias("objects"))


def duplicates(facts: DataFrame) -> DataFrame:
    """Equal (subject, predicate, object) stated more than once."""
    return facts.groupBy(*KEY, "object").agg(F.count("*").alias("n"), F.min("fact_id").alias("keep")).where("n > 1")


def supersession_candidates(facts: DataFrame) -> DataFrame:
    """For keys with differing objects, every row but the newest and the row that would replace it."""
    w = Window.partitionBy(*KEY).orderBy(F.col("valid_from").desc(), F.col("fact_id").desc())
    key = Window.partitionBy(*KEY)
    rows = facts.withColumn("r", F.row_number().over(w)).withColumn("by", F.first("fact_id").over(w))
    rows = rows.withColumn("differ", F.min("object").over(key) < F.max("object").over(key))
    return rows.where("differ and r > 1").select("fact_id", *KEY, F.col("by").alias("superseded_by"), F.col("r").alias("age_rank"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "step") -> DataFrame:
    """``rows`` with their place in ``order``, from 1: a range sort and a prefix sum over its
    partitions, so no task sees all rows. The sorted rows are written once, so that they are numbered once."""
    spark = rows.sparkSession
    at = scratch_folder(spark, "numbered")
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    laid.write.parquet(at)
    laid = spark.read.schema(laid.schema).parquet(at)
    parts = laid.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return laid.join(parts, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def refine_plan(candidates: DataFrame, active: int, target: int) -> DataFrame:
    """Greedy upkeep plan: ids in order of class, counted once, until ``target`` facts stay active.

    The first class that lists an id counts. The plan has active - target steps at
    most, numbered across partitions."""
    first = candidates.groupBy("fact_id").agg(F.min("rank").alias("rank"))
    steps = numbered(first, ["rank", "fact_id"]).where(F.col("step") <= max(0, active - target)).withColumn("step", F.col("step").cast("int"))
    return steps.select("fact_id", "rank", "step", (F.lit(active) - F.col("step")).alias("left"))


def retired(active: DataFrame, extracted: DataFrame, key: Sequence[str] = ("subject", "predicate", "object", "source")) -> DataFrame:
    """Active facts that the latest extraction no longer states, and the fact that closes each."""
    digest = F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 12)
    return active.join(extracted.select(*key).distinct(), list(key), "left_anti").withColumn("closing_object", F.concat(F.lit("retired_"), digest))


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources added, removed or changed, from rows (source, hash)."""
    b, a = before.select("source", F.col("hash").alias("old")), after.select("source", F.col("hash").alias("new"))
    both = b.join(a, "source", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return both.select("source", kind.alias("change"))


def first_of_batch(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """First row of each key in input order, with how many more there were."""
    w = Window.partitionBy(*key)
    return rows.withColumn("r", F.row_number().over(w.orderBy(order))).withColumn("repeats", F.count("*").over(w) - 1).where("r = 1").drop("r")


#: Patterns of safe names and of what must not be stored (fixed values).
SAFE_NAME = r"^[A-Za-z0-9:_-]{1,128}$"
SECRET = r"(?i)(password\s*=|token\s*=|secret\s*=|AKIA[0-9A-Z]{12,}|-----BEGIN)"


def rejection(subject: str = "subject", predicate: str = "predicate", object_: str = "object") -> Column:
    """Why a batch fact is refused; null if it is not."""
    return (
        F.when(~F.col(subject).rlike(SAFE_NAME), "subject")
        .when(~F.col(predicate).rlike(SAFE_NAME), "predicate")
        .when(F.length(object_) > 240, "object_too_long")
        .when(F.col(object_).rlike(SECRET), "secret")
    )


def write_gate(kind: Column, trust: Column, secret: Column, duplicate: Column, conflict: Column) -> Column:
    """Decision on a proposed record."""
    return F.when(secret, "reject").when(duplicate, "reject").when(conflict | (trust < 0.5) | kind.isin("policy", "constraint"), "review").otherwise("propose")


def lifecycle(events: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """Latest status of each key and the number of transitions."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("transitions"))


def consolidate(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """ADD, UPDATE, DELETE or NOOP for each candidate (subject, predicate, object; null object: forget)."""
    held = active.groupBy(*KEY).agg(F.max_by("object", F.struct("valid_from", "fact_id")).alias("held"))
    op = (
        F.when(F.col("held").isNull() & F.col("object").isNull(), "NOOP").when(F.col("held").isNull(), "ADD").when(F.col("object").isNull(), "DELETE")
        .when(F.col("object") == F.col("held"), "NOOP").otherwise("UPDATE")
    )
    return candidates.join(held, list(KEY), "left").withColumn("op", op)


def why(facts: DataFrame, episodes: DataFrame, proposals: DataFrame, t: Column) -> DataFrame:
    """Provenance chain: source, episode, proposal, fact, and both ends of its supersession."""
    older = facts.where("superseded_by is not null").select(F.col("superseded_by").alias("fact_id"), F.col("fact_id").alias("supersedes"))
    chain = facts.join(episodes, "episode_id", "left").join(proposals, "fact_id", "left").join(older, "fact_id", "left")
    return chain.withColumn("valid", valid_at(t))
