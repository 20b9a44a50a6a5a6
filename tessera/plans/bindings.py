"""The engine's data model over the star-schema tables: facts, edges, texts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.temporal import build_versions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement an event: user, kind of event, k of its properties."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"), F.concat(F.lit("user:"), F.col("user_id")).alias("subject"), F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), k).alias("object"), F.col("ts").alias("valid_from"), F.col("value").alias("confidence"),
        F.concat(F.lit("feed/"), F.col("user_id") % 7).alias("source"),
        F.when(F.col("event_id") % 9 == 4, F.expr("ts + interval 6 days")).otherwise(F.col("ts")).alias("updated_at"),  # some are recorded late
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_versions(raw_facts(spark, sf_dir))


#: The same in SQL, for the oracles.
RAW_FACTS_SQL = """raw_facts AS (
  SELECT event_id AS fact_id, 'user:' || user_id AS subject, event_type AS predicate, 'k' || (json_extract_string(props, '$.k')::BIGINT) AS object,
         ts AS valid_from, value AS confidence, 'feed/' || (user_id % 7) AS source, CASE WHEN event_id % 9 = 4 THEN ts + INTERVAL 6 DAY ELSE ts END AS updated_at FROM events)"""
FACTS_SQL = (
    RAW_FACTS_SQL
    + """, facts AS (
  SELECT *, lead(valid_from) OVER k AS valid_until, lead(fact_id) OVER k AS superseded_by,
         CASE WHEN lead(fact_id) OVER k IS NULL THEN 'active' ELSE 'superseded' END AS status
  FROM raw_facts WINDOW k AS (PARTITION BY subject, predicate ORDER BY valid_from, fact_id))"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property graph of places, customers and suppliers: (src, predicate, dst, fact_id, source)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def edge(df: DataFrame, src, predicate: str, dst, source: str) -> DataFrame:
        return df.select(src.alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"), F.lit(source).alias("source"))

    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    return (
        edge(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]), name("nation", "n_name"), "PART_OF", name("region", "r_name"), "geo/nation.py")
        .unionByName(edge(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), name("customer", "c_custkey"), "LIVES_IN", name("nation", "n_name"), "crm/customer.ts"))
        .unionByName(edge(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), name("supplier", "s_suppkey"), "LOCATED_IN", name("nation", "n_name"), "crm/supplier.rs"))
    )


EDGES_SQL = """edges AS (
  SELECT 'nation:' || n_name AS src, 'PART_OF' AS predicate, 'region:' || r_name AS dst, 'geo/nation.py' AS source FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'LIVES_IN', 'nation:' || n_name, 'crm/customer.ts' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || n_name, 'crm/supplier.rs' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph: events of a user in time order, each kind calling the next (caller, callee, n)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fn = lambda c: F.concat(F.col(c), F.lit("_"), F.pmod(F.col("user_id"), F.lit(40)))
    e = table(spark, sf_dir, "events").withColumn("next_type", F.lead("event_type").over(w)).where("next_type is not null and event_type <> next_type")
    return e.select(F.concat(F.lit("function:"), fn("event_type")).alias("caller"), F.concat(F.lit("function:"), F.col("next_type"), F.lit("_"), F.pmod(F.col("user_id") + F.col("event_id") % 2, F.lit(40))).alias("callee")).groupBy("caller", "callee").agg(F.count("*").alias("n"))


CALLS_SQL = """calls AS (
  SELECT 'function:' || event_type || '_' || (user_id % 40) AS caller, 'function:' || next_type || '_' || ((user_id + event_id % 2) % 40) AS callee, count(*) AS n
  FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events)
  WHERE next_type IS NOT NULL AND event_type <> next_type GROUP BY 1, 2)"""
