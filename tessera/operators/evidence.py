"""Evidence, content and delivery records: groups, conflicts, ledgers and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn


def dedupe_groups(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows of equal content: the smallest id stands for them. Ids are counted, not collected: a group may hold a third of all rows."""
    return rows.groupBy(F.sha2(content, 256).alias("hash")).agg(F.min(key).alias("canonical"), F.count("*").alias("members"), F.max(key).alias("last")).where("members > 1")


def dedupe_members(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Each member of a dedupe group with its canonical row."""
    hashed = rows.select(key, F.sha2(content, 256).alias("hash"))
    return hashed.join(dedupe_groups(rows, key, content).select("hash", "canonical"), "hash").select(key, "canonical")


def assertion_conflicts(rows: DataFrame) -> DataFrame:
    """(subject, predicate) with two values or more, and how many observations hold each."""
    values = rows.groupBy("subject", "predicate", "value").agg(F.count("*").alias("n"))
    held = F.sort_array(F.collect_list(F.struct("value", "n")))
    agg = values.groupBy("subject", "predicate").agg(held.alias("v")).where(F.size("v") > 1)
    return agg.select("subject", "predicate", F.array_join(F.transform("v", lambda x: F.concat_ws("=", x["value"], x["n"])), ",").alias("held"))


def citations(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """A row a cited observation: claim, observation, whether it exists and how stale it is."""
    cited = claims.select("claim", "at", F.explode("evidence").alias("observation"))
    age = F.floor((F.unix_seconds("at") - F.unix_seconds("seen_at")) / 86400)
    return cited.join(observations, "observation", "left").select("claim", "observation", F.col("seen_at").isNotNull().alias("found"), F.coalesce(age > 30, F.lit(False)).alias("stale"))


def ledger(rows: DataFrame) -> DataFrame:
    """Deliveries per tool and in all (tool null): calls, tokens delivered and spared, whole percent."""
    agg = rows.rollup("tool").agg(F.count("*").alias("calls"), F.sum("delivered").alias("delivered"), F.sum("baseline").alias("baseline"))
    saved = F.greatest(F.lit(0), F.col("baseline") - F.col("delivered"))
    return agg.select("tool", "calls", "delivered", "baseline", saved.alias("saved"), fn.percent(saved, F.col("baseline")).alias("percent"))


def feedback(uses: DataFrame) -> DataFrame:
    """Per record: how often selected, used, and not observed."""
    return uses.groupBy("record").agg(F.count("*").alias("selected"), F.count_if(F.col("used")).alias("used"), F.count_if(~F.col("used")).alias("not_observed"), F.array_join(F.sort_array(F.collect_set("outcome")), ",").alias("outcomes"))


def pattern_clusters(rows: DataFrame) -> DataFrame:
    """Groups of (format, mechanism) with size, and what the size says of saturation."""
    size = F.when(F.col("n") >= 5, "saturated").when(F.col("n") >= 2, "emerging").otherwise("single")
    return rows.groupBy("format", "mechanism").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")).withColumn("state", size)


def engagement(views: Column, replies: Column, saves: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.log1p(views / 250.0 + 4.0 * replies + 3.0 * saves) / 8), 6)


def relative_performance(value: Column, baseline: Column) -> Column:
    ratio = value / F.nullif(baseline, F.lit(0.0))
    return F.when(ratio.isNull(), "unknown").when(ratio >= 1.25, "above").when(ratio <= 0.75, "below").otherwise("typical")


def closest_source(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """Most similar source of each draft by Jaccard of term sets, by a join on terms: no pair without a shared term is made."""
    t = lambda df, k: df.select(k, F.explode(F.array_distinct(fn.terms(F.col("text")))).alias("term"))
    a, b = t(drafts, "draft"), t(sources, "source")
    na, nb = a.groupBy("draft").agg(F.count("*").alias("na")), b.groupBy("source").agg(F.count("*").alias("nb"))
    shared = a.join(b, "term").groupBy("draft", "source").agg(F.count("*").alias("m")).join(na, "draft").join(nb, "source")
    score = F.round(F.col("m") / (F.col("na") + F.col("nb") - F.col("m")), 6)
    w = Window.partitionBy("draft").orderBy(F.col("similarity").desc(), "source")
    risk = F.when(F.col("similarity") >= 0.82, "high").when(F.col("similarity") >= 0.55, "medium").otherwise("low")
    return shared.select("draft", "source", score.alias("similarity")).withColumn("r", F.row_number().over(w)).where("r = 1").select("draft", "source", "similarity", risk.alias("risk"))


def queue_claims(rows: DataFrame, now: Column, *, lease_s: int, most: int) -> DataFrame:
    """State of queue entries at ``now``: done, poison (attempts used up and lease over), claimed, or claimable."""
    over = F.unix_seconds("claimed_at") + lease_s <= F.unix_seconds(now)
    return rows.withColumn("state", F.when(F.col("done"), "done").when(over & (F.col("attempts") >= most), "poison").when(~over, "claimed").otherwise("claimable"))


def retry_delay(attempt: Column, first: int, most: int) -> Column:
    return F.least(F.lit(most), F.lit(first) * attempt)
