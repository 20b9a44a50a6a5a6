"""Policy, approval and upkeep of records: decisions as columns, queues as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn


def denial_reasons(*checks: tuple[str, Column]) -> Column:
    """Names of all checks that fail, in order; access is allowed if there are none. An undecided check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))


def expired_approvals(approvals: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Pending approvals of waiting runs whose time is over."""
    waiting = runs.where("state = 'waiting'").select("run")
    return approvals.where(F.col("pending") & (F.col("expires_at") <= now)).join(waiting, "run").select("approval", "run", "expires_at")


def approve(proposals: DataFrame, sources: list[str]) -> DataFrame:
    """Facts that a bulk approval by source makes: pending proposals, those for explicit ids alone left out; confidence by how they were found."""
    confidence = F.when(F.col("found") == "extracted", 0.9).when(F.col("found") == "inferred", 0.6).otherwise(0.3)
    return proposals.where(F.col("state").isin("pending") & ~F.col("explicit_only") & F.col("source").isin(*sources)).select("proposal", "source", confidence.alias("confidence"))


def ambiguous_labels(nodes: DataFrame, samples: int = 3) -> DataFrame:
    """Labels that stand for two nodes or more, with the first few."""
    w = Window.partitionBy("label").orderBy("node")
    rows = nodes.withColumn("r", F.row_number().over(w))
    held = F.sort_array(F.collect_list(F.when(F.col("r") <= samples, F.col("node"))))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.array_join(held, ",").alias("sample")).where("n > 1")


def effect_conflicts(effects: DataFrame) -> DataFrame:
    """Idempotency keys that came with more than one fingerprint."""
    return effects.groupBy("key").agg(F.count("*").alias("calls"), F.count_distinct("fingerprint").alias("fingerprints")).where("fingerprints > 1")


def entity_pages(facts: DataFrame, most: int = 5) -> DataFrame:
    """A page a subject: how many facts, and its newest ones in short."""
    w = Window.partitionBy("subject").orderBy(F.col("valid_from").desc(), F.col("fact_id").desc())
    rows = facts.withColumn("r", F.row_number().over(w))
    line = F.when(F.col("r") <= most, F.struct("r", F.concat_ws(" ", "predicate", "object").alias("t")))
    return rows.groupBy("subject").agg(F.count("*").alias("n_facts"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "; ").alias("newest"))


def fit_in_order(rows: DataFrame, group: str, order: str, budget: int, most: int = 10_000) -> DataFrame:
    """Rows of each group that fit a token budget in order, skipping those that do not: a fold over one group's rows.

    A group holds one request's candidates; groups of more than ``most`` rows are an error, not cut."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("tokens").cast("bigint").alias("t"))))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda s, x: F.when(s["spent"] + x["t"] <= budget, F.struct((s["spent"] + x["t"]).alias("spent"), F.concat(s["taken"], F.array(x["o"].cast("bigint"))).alias("taken"))).otherwise(s)
    groups = rows.groupBy(group).agg(held.alias("held"))
    groups = groups.withColumn("held", F.when(F.size("held") > most, F.raise_error(F.lit("a request with too many candidates")).cast("array<struct<o:bigint,t:bigint>>")).otherwise(F.col("held")))
    return groups.select(group, F.aggregate("held", start, step).alias("s")).select(group, F.col("s.spent").alias("tokens"), F.explode("s.taken").alias(order))


def token_report(selected: DataFrame, everything: DataFrame, by: str) -> DataFrame:
    """Tokens before and after a selection per category, and the percentage spared."""
    a = everything.groupBy(by).agg(F.sum("tokens").alias("before"))
    b = selected.groupBy(by).agg(F.sum("tokens").alias("after"), F.count("*").alias("n"))
    after = F.coalesce(F.col("after"), F.lit(0))
    return a.join(b, by, "left").select(by, "before", after.alias("after"), F.coalesce("n", F.lit(0)).alias("n"), fn.percent(F.col("before") - after, F.col("before")).alias("percent"))


def cooccurrence(docs: DataFrame, key: str, reach: int = 2) -> DataFrame:
    """Term pairs that stand within ``reach`` places of one another, counted; each place looks ahead only."""
    words = docs.select(key, fn.terms(F.col("text")).alias("w"))
    at = F.sequence(F.lit(1), F.size("w"))
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.slice("w", i + 1, reach), lambda x: F.struct(F.least(F.element_at("w", i), x).alias("a"), F.greatest(F.element_at("w", i), x).alias("b")))))
    return words.where(F.size("w") > 0).select(F.inline(pairs)).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
