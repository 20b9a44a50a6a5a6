"""Queries over policy, approvals and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import governance as op
from tessera.plans.bindings import EDGES_SQL, RAW_FACTS_SQL, edges, raw_facts, table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


@register("policy_denials", """SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN NOT (c_acctbal >= 0) THEN 'balance' END, CASE WHEN NOT (c_mktsegment <> 'BUILDING') THEN 'segment' END, CASE WHEN NOT (c_nationkey < 20) THEN 'place' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer) GROUP BY 1""")
def _(spark, d):
    reasons = op.denial_reasons(("balance", F.col("c_acctbal") >= 0), ("segment", F.col("c_mktsegment") != "BUILDING"), ("place", F.col("c_nationkey") < 20))
    return table(spark, d, "customer").groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count("*").alias("n"))


@register("approval_expiry", """WITH r AS (SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT event_id AS approval, user_id AS run, ts + INTERVAL 2 DAY AS expires_at FROM events JOIN r ON r.run = user_id AND last IN ('view', 'click') WHERE event_type = 'signup' AND ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31 00:00:00'""")
def _(spark, d):
    e = table(spark, d, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.when(F.max_by("event_type", F.struct("ts", "event_id")).isin("view", "click"), "waiting").otherwise("done").alias("state"))
    approvals = e.select(F.col("event_id").alias("approval"), F.col("user_id").alias("run"), (F.col("event_type") == "signup").alias("pending"), (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"))
    return op.expired_approvals(approvals, runs, F.expr("timestamp_ntz '2024-01-31 00:00:00'"))


@register("proposal_bulk_approval", f"WITH {RAW_FACTS_SQL} SELECT fact_id AS proposal, source, CASE predicate WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM raw_facts WHERE predicate <> 'error' AND object <> 'k0' AND source IN ('feed/1', 'feed/3')")
def _(spark, d):
    found = F.when(F.col("predicate") == "view", "extracted").when(F.col("predicate") == "click", "inferred").otherwise("ambiguous")
    p = raw_facts(spark, d).select(F.col("fact_id").alias("proposal"), "source", found.alias("found"), F.when(F.col("predicate") == "error", "poison").otherwise("pending").alias("state"), (F.col("object") == "k0").alias("explicit_only"))
    return op.approve(p, ["feed/1", "feed/3"])


@register("graph_ambiguous_labels", f"WITH {EDGES_SQL}, n AS (SELECT DISTINCT src AS node, split_part(src, ':', 2) AS label FROM edges) SELECT label, count(*) AS n, array_to_string(list(node ORDER BY node)[1:3], ',') AS sample FROM n GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return op.ambiguous_labels(edges(spark, d).select(F.col("src").alias("node"), F.substring_index("src", ":", -1).alias("label")).distinct())


@register("effect_idempotency", "SELECT l_orderkey || '/' || l_partkey AS key, count(*) AS calls, count(DISTINCT l_suppkey) AS fingerprints FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(spark, d):
    return op.effect_conflicts(table(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_partkey").alias("key"), F.col("l_suppkey").alias("fingerprint")))


@register("wiki_entity_pages", f"WITH {RAW_FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY valid_from DESC, fact_id DESC) AS r FROM raw_facts) SELECT subject, count(*) AS n_facts, string_agg(predicate || ' ' || object, '; ' ORDER BY r) FILTER (r <= 5) AS newest FROM r GROUP BY 1")
def _(spark, d):
    return op.entity_pages(raw_facts(spark, d))


@register("select_fit_in_order", """WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM conversations),
  f AS (SELECT conv_id, r, turn, tokens <= 150 AS takes, CASE WHEN tokens <= 150 THEN tokens ELSE 0 END AS spent FROM t WHERE r = 1 UNION ALL
    SELECT t.conv_id, t.r, t.turn, f.spent + t.tokens <= 150, f.spent + CASE WHEN f.spent + t.tokens <= 150 THEN t.tokens ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
  SELECT conv_id, (max(spent) OVER (PARTITION BY conv_id))::BIGINT AS tokens, turn FROM f QUALIFY takes""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", fn.token_estimate(F.col("text")).alias("tokens"))
    return op.fit_in_order(rows, "conv_id", "turn", 150)


@register("select_token_report", "WITH t AS (SELECT role, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM conversations) SELECT role, sum(tokens)::BIGINT AS before, coalesce(sum(tokens) FILTER (tokens <= 40), 0)::BIGINT AS after, count(*) FILTER (tokens <= 40) AS n, round(100.0::DOUBLE * (sum(tokens) - coalesce(sum(tokens) FILTER (tokens <= 40), 0)) / sum(tokens))::BIGINT AS percent FROM t GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "conversations").select("role", fn.token_estimate(F.col("text")).alias("tokens"))
    return op.token_report(rows.where("tokens <= 40"), rows, "role")


@register("search_cooccurrence", "WITH w AS MATERIALIZED (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), p AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w), q AS (SELECT w[i] AS x, unnest(w[i + 1:i + 2]) AS y FROM p) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM q WHERE x <> y GROUP BY 1, 2")
def _(spark, d):
    return op.cooccurrence(table(spark, d, "benchmark"), "item_id")
