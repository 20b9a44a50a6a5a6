"""Queries over selection, evaluation, evidence, sources, streams and the relational baseline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import constrained, evaluation, evidence
from tessera.operators import selection as sel
from tessera.plans.bindings import table
from tessera.sources import documents as src
from tessera.sources.shared import scratch_folder
from tessera.streaming import windows as st

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _shared(spark) -> str:
    return scratch_folder(spark, "streams")


# --- selection: a request a conversation, its turns as records -------------------------------------------

_TERM = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_TURNS = f"""t AS (SELECT conv_id AS request, turn AS record, role AS category, text, {_TERM.format("text")} AS w, first_value({_TERM.format("text")}) OVER (PARTITION BY conv_id ORDER BY turn) AS q, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM conversations),
  u AS (SELECT *, CASE WHEN len(w) = 0 OR len(q) = 0 THEN 0 ELSE len(list_intersect(w, q)) / sqrt((len(w) * len(q))::DOUBLE) END AS relevance, CASE category WHEN 'system' THEN 1.0 WHEN 'assistant' THEN 0.7 ELSE 0.5 END AS authority, 0.8 AS confidence FROM t),
  s AS (SELECT *, round(0.45::DOUBLE * round(relevance, 6) + 0.2::DOUBLE * authority + 0.15::DOUBLE * confidence + 0.2::DOUBLE * least(1.0::DOUBLE, 32.0::DOUBLE / tokens), 6) AS utility FROM u)"""


def _records(spark, d):
    w = fn.terms(F.col("text"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("record"), F.col("role").alias("category"), "text", F.array_distinct(w).alias("w"), fn.token_estimate(F.col("text")).alias("tokens"))
    q = F.first("w").over(Window.partitionBy("request").orderBy("record"))
    # utility takes the relevance to 6 places; ranks go by the whole of it, which tells more records apart
    rows = rows.withColumn("overlap", fn.overlap(F.col("w"), q)).withColumn("relevance", F.round("overlap", 6)).withColumn("confidence", F.lit(0.8))
    rows = rows.withColumn("authority", F.when(F.col("category") == "system", 1.0).when(F.col("category") == "assistant", 0.7).otherwise(0.5))
    return rows.withColumn("utility", sel.utility(sel.Policy()))


@register("select_utility", f"WITH {_TURNS} SELECT request, record, tokens, utility FROM s")
def _(spark, d):
    return _records(spark, d).select("request", "record", "tokens", "utility")


@register("select_eligibility", """WITH r AS (SELECT doc_id, source, lang, text, CASE WHEN l.quality = 0 THEN 'rejected' ELSE 'active' END AS status FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))
  SELECT doc_id, array_to_string(list_filter([CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'workspace' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'data_class' END, CASE WHEN status NOT IN ('active', 'verified') THEN 'status' END, CASE WHEN regexp_matches(text, '(?i)(password|token|secret)\\s*=') THEN 'secret' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def _(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("workspace"), F.col("lang").alias("data_class"), "text", F.when(F.col("quality") == 0, "rejected").otherwise("active").alias("status"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return rows.select("doc_id", F.array_join(sel.ineligible(F.current_timestamp(), ("src0", "src1", "src2", "src3", "src4"), ("en", "fr")), ",").alias("reasons"))


@register("select_within_budget", f"WITH {_TURNS} SELECT request, record, run::BIGINT AS run FROM (SELECT *, sum(tokens) OVER (PARTITION BY request ORDER BY utility DESC, record) AS run FROM s) WHERE run <= 300")
def _(spark, d):
    return sel.within_budget(_records(spark, d), "request", [F.col("utility").desc(), "record"], 300).select("request", "record", "run")


@register("select_redundancy", f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+')[1:256] AS t FROM conversations), g AS (SELECT conv_id, turn, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [array_to_string(t, ' ')] END AS g FROM t)
  SELECT a.conv_id, a.turn AS a, b.turn AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(spark, d):
    g = table(spark, d, "conversations").select("conv_id", "turn", sel.shingles(F.col("text")).alias("g"))
    nxt = g.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return g.join(nxt, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("a"), (F.col("turn") + 1).alias("b"), F.round(fn.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


_SHINGLES = "(SELECT conv_id AS request, turn AS record, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [array_to_string(t, ' ')] END AS g FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+')[1:256] AS t FROM conversations))"
#: Likeness of the turns of one conversation, both ways.
_LIKE = f"h AS {_SHINGLES}, li AS (SELECT a.request, a.record, list({{'b': b.record, 'sim': len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))}}) AS li FROM h a JOIN h b ON a.request = b.request AND a.record <> b.record GROUP BY ALL)"
_MMR = f"""WITH RECURSIVE {_TURNS}, {_LIKE},
  c AS (SELECT s.request, s.record, s.tokens, s.category, s.utility, coalesce(li.li, []) AS li FROM s LEFT JOIN li USING (request, record) WHERE utility >= 0.1 AND tokens <= 1200),
  m AS (SELECT DISTINCT request, 0 AS position, []::BIGINT[] AS taken, []::VARCHAR[] AS cats, 0::BIGINT AS spent, NULL::BIGINT AS record, NULL::DOUBLE AS marginal, NULL::BIGINT AS tokens FROM c
    UNION ALL SELECT request, position + 1, list_append(taken, rec), list_append(cats, category), spent + tok, rec, worth, tok FROM (
      SELECT *, row_number() OVER (PARTITION BY request ORDER BY worth DESC, utility DESC, rec) AS r FROM (
        SELECT m.request, m.position, m.taken, m.cats, m.spent, c.record AS rec, c.tokens AS tok, c.category, c.utility, coalesce(list_max(list_transform(list_filter(c.li, lambda x: list_contains(m.taken, x.b)), lambda x: x.sim)), 0) AS near,
          round(c.utility - 1.25::DOUBLE * coalesce(list_max(list_transform(list_filter(c.li, lambda x: list_contains(m.taken, x.b)), lambda x: x.sim)), 0) + CASE WHEN list_contains(m.cats, c.category) THEN 0 ELSE 0.15::DOUBLE END, 6) AS worth
        FROM m JOIN c ON c.request = m.request AND NOT list_contains(m.taken, c.record) AND len(list_filter(m.cats, lambda k: k = c.category)) < 3 AND m.spent + c.tokens <= 1200) WHERE near < 0.92)
    WHERE r = 1 AND worth >= 0)"""


@register("select_diverse_mmr", _MMR + " SELECT request, record, position::INT AS position, marginal, tokens FROM m WHERE position > 0")
def _(spark, d):
    c = _records(spark, d).withColumn("shingles", sel.shingles(F.col("text")))
    return sel.select_diverse(c.select("request", "record", "utility", "tokens", "category", "shingles"))


@register("select_manifest", _MMR + " SELECT request, count(*) AS n, sum(tokens)::BIGINT AS tokens, sha256(string_agg(record::VARCHAR, ',' ORDER BY position)) AS etag FROM m WHERE position > 0 GROUP BY request")
def _(spark, d):
    return sel.manifest(QUERIES["select_diverse_mmr"](spark, d)).select("request", "n", "tokens", "etag")


# constraints: the last turn of a conversation is required, system turns govern, secrets are not eligible; the first
# turn's longer terms are the entities to cover

_BUDGET = 220
_CONSTRAINED = f"""WITH RECURSIVE {_TURNS}, {_LIKE},
  e AS (SELECT *, list_filter(w, lambda x: length(x) >= 8) AS ents, list_sort(list_filter(q, lambda x: length(x) >= 8))[1:3] AS wanted, max(record) OVER (PARTITION BY request) AS need, regexp_matches(text, '(?i)(password|token|secret)\\s*=') AS bad, md5(text) AS hash FROM t),
  c AS (SELECT e.request, e.record, e.tokens, s.utility + 0.3::DOUBLE AS utility, CASE e.category WHEN 'system' THEN 'governance' WHEN 'assistant' THEN 'evidence' ELSE 'episodes' END AS category, ents, wanted, need, bad, e.record = need OR e.category = 'system' AS forced,
      coalesce(list_transform(li.li, lambda x: {{'b': x.b, 'sim': CASE WHEN list_contains(tw.tw, x.b) THEN 1.0::DOUBLE ELSE x.sim END}}), []) AS li
    FROM e JOIN s USING (request, record) LEFT JOIN li USING (request, record) LEFT JOIN (SELECT request, hash, list(record) AS tw FROM e GROUP BY ALL) tw ON tw.request = e.request AND tw.hash = e.hash),
  q AS (SELECT request, any_value(wanted) AS wanted, bool_or(bad AND record = need) AS missing, coalesce(sum(tokens) FILTER (forced AND NOT bad), 0)::BIGINT AS spent, coalesce(list(record ORDER BY record <> need, record) FILTER (forced AND NOT bad), []) AS taken,
      coalesce(list(category ORDER BY record) FILTER (forced AND NOT bad), []) AS cats, coalesce(list_distinct(flatten(list(ents) FILTER (forced AND NOT bad))), []) AS cov FROM c GROUP BY request),
  m AS (SELECT request, wanted, len(taken) AS n, taken, taken AS gone, cats, spent, cov, NULL::BIGINT AS record, NULL::DOUBLE AS marginal, NULL::VARCHAR AS reasons, false AS took, false AS stop, 0 AS step FROM q WHERE NOT missing AND spent <= {_BUDGET}
    UNION ALL SELECT request, wanted, n + (why = '')::INT, CASE WHEN why = '' THEN list_append(taken, rec) ELSE taken END, list_append(gone, rec), CASE WHEN why = '' THEN list_append(cats, category) ELSE cats END, CASE WHEN why = '' THEN spent + tok ELSE spent END,
      CASE WHEN why = '' THEN list_distinct(list_concat(cov, ents)) ELSE cov END, rec, worth,
      CASE WHEN why = '' THEN CASE WHEN fresh THEN 'entity_coverage' ELSE 'complementary_evidence' END || ',' || CASE WHEN list_contains(cats, category) THEN 'kind_overlap' ELSE 'diversity_gain' END ELSE why END, why = '',
      why = '' AND list_has_all(list_concat(cov, ents), wanted) AND len(list_filter(list_append(cats, category), lambda k: k = 'evidence')) >= 2, step + 1
    FROM (SELECT *, array_to_string(list_filter([CASE WHEN utility < 0.35 THEN 'below_minimum_utility' END, CASE WHEN near >= 0.92 THEN 'redundant' END,
        CASE WHEN len(list_filter(cats, lambda k: k = category)) >= CASE category WHEN 'governance' THEN 6 WHEN 'evidence' THEN 4 ELSE 3 END THEN 'category_cap' END,
        CASE WHEN spent + tok > {_BUDGET} THEN 'token_budget' END, CASE WHEN worth < 0.2 THEN 'insufficient_marginal_utility' END], lambda x: x IS NOT NULL), ',') AS why
      FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY worth DESC, tok, rec) AS r FROM (
        SELECT *, round(utility - 1.25::DOUBLE * near + CASE WHEN fresh THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN list_contains(cats, category) THEN 0 ELSE 0.15::DOUBLE END, 6) AS worth FROM (
          SELECT m.*, c.record AS rec, c.tokens AS tok, c.category, c.utility, c.ents, len(list_filter(list_intersect(c.ents, m.wanted), lambda x: NOT list_contains(m.cov, x))) > 0 AS fresh,
            round(coalesce(list_max(list_transform(list_filter(c.li, lambda x: list_contains(m.taken, x.b)), lambda x: x.sim)), 0), 6) AS near
          FROM m JOIN c ON c.request = m.request AND NOT list_contains(m.gone, c.record) AND NOT c.bad WHERE NOT m.stop AND m.n < 12))) WHERE r = 1)),
  z AS (SELECT request, arg_max(stop, step) AS stop, arg_max(gone, step) AS gone, arg_max(taken, step) AS taken, arg_max(n, step) AS n, arg_max(cov, step) AS cov, arg_max(cats, step) AS cats, any_value(wanted) AS wanted FROM m GROUP BY request),
  o AS (SELECT request, record, CASE WHEN took THEN 'selected' ELSE 'excluded' END AS state, CASE WHEN took THEN n END AS position, marginal, reasons FROM m WHERE record IS NOT NULL
    UNION ALL SELECT c.request, c.record, 'selected', list_position(q.taken, c.record), 1000.0::DOUBLE, CASE WHEN c.record = need THEN 'required' ELSE 'governance' END FROM c JOIN q USING (request) JOIN z USING (request) WHERE forced AND NOT bad
    UNION ALL SELECT c.request, c.record, 'excluded', NULL, NULL, 'secret' FROM c WHERE bad
    UNION ALL SELECT c.request, c.record, 'refused', NULL, NULL, CASE WHEN missing THEN 'required_context_unresolved' ELSE 'required_context_over_budget' END FROM c JOIN q USING (request) WHERE NOT bad AND request NOT IN (SELECT request FROM z)
    UNION ALL SELECT q.request, NULL, 'refused', NULL, NULL, 'required_context_unresolved' FROM q WHERE missing AND request NOT IN (SELECT request FROM c WHERE NOT bad)
    UNION ALL SELECT c.request, c.record, 'excluded', NULL, utility, CASE WHEN NOT z.stop THEN 'maximum_candidate_count' WHEN round(coalesce(list_max(list_transform(list_filter(c.li, lambda x: list_contains(z.taken, x.b)), lambda x: x.sim)), 0), 6) >= 0.92 THEN 'redundant' ELSE 'sufficient_without' END
      FROM c JOIN z USING (request) WHERE NOT bad AND NOT list_contains(z.gone, c.record))"""


def _constrained(spark, d):
    """(requests, candidates) of the conversations."""
    rows = _records(spark, d)
    long = lambda c: F.filter(c, lambda x: F.length(x) >= 8)
    kind = F.when(F.col("category") == "system", "policy").when(F.col("category") == "assistant", "evidence").otherwise("episode")
    c = rows.withColumn("governance", F.col("category") == "system").withColumn("category", constrained.category_of(kind)).withColumn("shingles", sel.shingles(F.col("text"))).withColumn("entities", long("w"))
    against = F.when(F.col("text").rlike(r"(?i)(password|token|secret)\s*="), F.array(F.lit("secret"))).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("against", against).withColumn("hash", F.md5("text")).withColumn("path", F.lit(None).cast("string")).withColumn("conflict", F.lit(False)).withColumn("utility", F.col("utility") + 0.3)
    first = F.min_by("w", "record")
    requests = rows.groupBy("request").agg(F.lit(_BUDGET).alias("budget"), F.array(F.max("record")).alias("required"), F.slice(F.sort_array(long(first)), 1, 3).alias("entities"))
    return requests, c


@register("select_constrained", _CONSTRAINED + " SELECT request, record, state, position::INT AS position, marginal, reasons FROM o")
def _(spark, d):
    return constrained.select_constrained(*_constrained(spark, d)).drop("sufficient")


@register("select_sufficiency", _CONSTRAINED + """ SELECT request, count(*) FILTER (state = 'selected') AS n, coalesce(any_value(list_has_all(z.cov, z.wanted) AND len(list_filter(z.cats, lambda k: k = 'evidence')) >= 2), false) AS sufficient FROM o LEFT JOIN z USING (request) GROUP BY request""")
def _(spark, d):
    made = constrained.select_constrained(*_constrained(spark, d))
    return made.groupBy("request").agg(F.count_if(F.col("state") == "selected").alias("n"), F.bool_or("sufficient").alias("sufficient"))


@register("select_assembly", _CONSTRAINED + f""", a AS (SELECT o.request, o.record, c.tokens, t.text, CASE c.category WHEN 'governance' THEN 0 WHEN 'evidence' THEN 4 ELSE 6 END AS section, position FROM o JOIN c USING (request, record) JOIN t USING (request, record) WHERE state = 'selected'),
    b AS (SELECT *, 100 - coalesce(sum(tokens) OVER (PARTITION BY request ORDER BY section, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, row_number() OVER (PARTITION BY request ORDER BY section, position)::INT AS place FROM a),
    k AS (SELECT *, CASE WHEN tokens <= rest THEN 'full' WHEN rest >= 60 THEN 'snippet' WHEN rest >= 20 THEN 'outline' WHEN rest > 0 THEN 'locator' ELSE 'excluded' END AS shown FROM b)
  SELECT request, record, section, place, shown, sha256(CASE shown WHEN 'full' THEN text WHEN 'snippet' THEN substr(text, 1, 240) WHEN 'outline' THEN split_part(text, chr(10), 1) WHEN 'locator' THEN record::VARCHAR ELSE '' END) AS digest FROM k""")
def _(spark, d):
    requests, c = _constrained(spark, d)
    return constrained.assemble(constrained.select_constrained(requests, c), c.select("request", "record", "category", "tokens", "text"), 100)


@register("select_manifest_diff", """WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE lang IN ('en', 'fr')), b AS (SELECT doc_id, CASE WHEN source = 'src3' THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE lang IN ('en', 'de'))
  SELECT coalesce(a.doc_id, b.doc_id) AS record, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents")
    a = docs.where("lang in ('en', 'fr')").select(F.col("doc_id").alias("record"), F.md5("text").alias("hash"))
    b = docs.where("lang in ('en', 'de')").select(F.col("doc_id").alias("record"), F.md5(F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return sel.manifest_diff(a, b)


@register("select_profile", """WITH r AS (SELECT user_id AS owner, event_id AS record, value AS authority, CASE event_type WHEN 'purchase' THEN 1.0 ELSE 0.5 END AS confidence, ts AS t0 FROM events),
  s AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY authority DESC, confidence DESC, t0 DESC, record) AS s FROM r), x AS (SELECT *, row_number() OVER (PARTITION BY owner, s <= 8 ORDER BY t0 DESC, record) AS d FROM s)
  SELECT owner, record, CASE WHEN s <= 8 THEN 'static' ELSE 'dynamic' END AS part, CASE WHEN s <= 8 THEN s ELSE d END::INT AS position FROM x WHERE s <= 8 OR d <= 5""")
def _(spark, d):
    e = table(spark, d, "events")
    return sel.profile(e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("record"), F.col("value").alias("authority"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.5).alias("confidence"), F.col("ts").alias("at")))


@register("select_compact_view", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(array_to_string(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN i = 0 OR i = len(l) - 1 OR regexp_matches(l[i + 1], '(?i)(error|fail|decision|warning|#)') THEN l[i + 1] END), lambda x: x IS NOT NULL)[1:8], chr(10))) AS view FROM l""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sel.compact_view(F.col("text"))).alias("view"))


# --- evaluation -------------------------------------------------------------------------------------------

_EVAL = f"""{_TURNS}, r AS (SELECT request AS query, record, row_number() OVER (PARTITION BY request ORDER BY relevance DESC, record) AS rank FROM u), gold AS (SELECT conv_id AS query, turn AS record FROM conversations WHERE role = 'assistant'),
  n AS (SELECT query, count(*) AS n_gold FROM gold GROUP BY 1), h AS (SELECT query, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM r JOIN gold USING (query, record) WHERE rank <= 5 GROUP BY 1),
  m AS (SELECT q.query, round(CASE WHEN n_gold IS NULL THEN 1 ELSE coalesce(hits, 0) / n_gold END, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
    round(CASE WHEN n_gold IS NULL THEN 1 ELSE coalesce(gain, 0) / list_sum(list_transform(range(1, least(5, n_gold) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM (SELECT DISTINCT conv_id AS query FROM conversations) q LEFT JOIN n USING (query) LEFT JOIN h USING (query))"""


def _metrics(spark, d):
    w = Window.partitionBy("request").orderBy(F.col("overlap").desc(), "record")
    ranked = _records(spark, d).withColumn("rank", F.row_number().over(w)).select(F.col("request").alias("query"), "record", "rank")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("record"), "role")
    return evaluation.retrieval_metrics(ranked, turns.where("role = 'assistant'").drop("role"), turns.select("query").distinct(), 5)


@register("eval_retrieval_metrics", f"WITH {_EVAL} SELECT * FROM m")
def _(spark, d):
    return _metrics(spark, d)


@register("eval_averages", f"WITH {_EVAL} SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM m")
def _(spark, d):
    return evaluation.average(_metrics(spark, d), "recall", "mrr", "ndcg")


# --- evidence and content -----------------------------------------------------------------------------------


@register("evidence_dedupe_groups", "SELECT sha256(text) AS hash, min(doc_id) AS canonical, count(*) AS members, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return evidence.dedupe_groups(table(spark, d, "documents"), "doc_id", F.col("text"))


@register("evidence_dedupe_members", "SELECT doc_id, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def _(spark, d):
    return evidence.dedupe_members(table(spark, d, "documents"), "doc_id", F.col("text"))


@register("evidence_assertion_conflicts", """WITH v AS (SELECT c_nationkey AS subject, 'segment' AS predicate, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL) SELECT subject, predicate, string_agg(value || '=' || n, ',' ORDER BY value) AS held FROM v GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    return evidence.assertion_conflicts(table(spark, d, "customer").select(F.col("c_nationkey").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("value")))


@register("evidence_citations", """WITH e AS (SELECT event_id, event_type, ts, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ev FROM events), c AS (SELECT event_id AS claim, ts AS t0, unnest(ev) AS observation FROM e WHERE event_type = 'purchase')
  SELECT claim, observation, o.ts IS NOT NULL AS found, coalesce(floor((epoch(date_trunc('second', t0)) - epoch(date_trunc('second', o.ts))) / 86400) > 30, false) AS stale FROM c LEFT JOIN (SELECT event_id, ts FROM events WHERE event_type = 'view') o ON o.event_id = observation""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    claims = e.withColumn("evidence", F.collect_list("event_id").over(w)).where("event_type = 'purchase'").select(F.col("event_id").alias("claim"), F.col("ts").alias("at"), "evidence")
    return evidence.citations(claims, e.where("event_type = 'view'").select(F.col("event_id").alias("observation"), F.col("ts").alias("seen_at")))


@register("ledger_rollup", """WITH r AS (SELECT event_type AS tool, count(*) AS calls, sum(floor(value))::BIGINT AS delivered, (count(*) * 60)::BIGINT AS baseline FROM events GROUP BY ROLLUP (event_type))
  SELECT tool, calls, delivered, baseline, greatest(0, baseline - delivered)::BIGINT AS saved, coalesce(round(100.0::DOUBLE * greatest(0, baseline - delivered) / nullif(baseline, 0)), 0)::BIGINT AS percent FROM r""")
def _(spark, d):
    return evidence.ledger(table(spark, d, "events").select(F.col("event_type").alias("tool"), F.floor("value").alias("delivered"), F.lit(60).cast("bigint").alias("baseline")))


@register("usage_feedback", "SELECT l_partkey AS record, count(*) AS selected, count(*) FILTER (l_returnflag = 'N') AS used, count(*) FILTER (l_returnflag <> 'N') AS not_observed, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS outcomes FROM lineitem GROUP BY 1")
def _(spark, d):
    return evidence.feedback(table(spark, d, "lineitem").select(F.col("l_partkey").alias("record"), (F.col("l_returnflag") == "N").alias("used"), F.col("l_linestatus").alias("outcome")))


@register("content_pattern_clusters", "SELECT lang AS format, source AS mechanism, count(*) AS n, round(avg(n_chars), 6) AS score, CASE WHEN count(*) >= 5 THEN 'saturated' WHEN count(*) >= 2 THEN 'emerging' ELSE 'single' END AS state FROM documents GROUP BY 1, 2")
def _(spark, d):
    return evidence.pattern_clusters(table(spark, d, "documents").select(F.col("lang").alias("format"), F.col("source").alias("mechanism"), F.col("n_chars").alias("score")))


@register("content_engagement", "SELECT p_partkey, round(least(1.0::DOUBLE, ln(1 + p_retailprice / 250.0::DOUBLE + 4.0::DOUBLE * p_size + 3.0::DOUBLE * (p_partkey % 5)) / 8), 6) AS engagement FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", evidence.engagement(F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 5).alias("engagement"))


@register("content_relative_performance", "WITH b AS (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS b FROM customer) SELECT c_mktsegment, CASE WHEN b = 0 THEN 'unknown' WHEN c_acctbal / b >= 1.25 THEN 'above' WHEN c_acctbal / b <= 0.75 THEN 'below' ELSE 'typical' END AS state, count(*) AS n FROM b GROUP BY 1, 2")
def _(spark, d):
    base = F.avg("c_acctbal").over(Window.partitionBy("c_mktsegment"))
    return table(spark, d, "customer").withColumn("state", evidence.relative_performance(F.col("c_acctbal"), base)).groupBy("c_mktsegment", "state").agg(F.count("*").alias("n"))


@register("content_closest_source", f"""WITH a AS (SELECT item_id AS draft, unnest({_TERM.format("text")}) AS term FROM benchmark), b AS (SELECT page_id AS source, unnest({_TERM.format("html")}) AS term FROM pages), na AS (SELECT draft, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT source, count(*) AS nb FROM b GROUP BY 1),
  s AS (SELECT draft, source, count(*) AS m FROM a JOIN b USING (term) GROUP BY 1, 2), x AS (SELECT draft, source, round(m / (na + nb - m), 6) AS similarity FROM s JOIN na USING (draft) JOIN nb USING (source))
  SELECT draft, source, similarity, CASE WHEN similarity >= 0.82 THEN 'high' WHEN similarity >= 0.55 THEN 'medium' ELSE 'low' END AS risk FROM x QUALIFY row_number() OVER (PARTITION BY draft ORDER BY similarity DESC, source) = 1""")
def _(spark, d):
    return evidence.closest_source(table(spark, d, "benchmark").select(F.col("item_id").alias("draft"), "text"), table(spark, d, "pages").select(F.col("page_id").alias("source"), F.col("html").alias("text")))


@register("queue_states", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'done' WHEN over AND k >= 3 THEN 'poison' WHEN NOT over THEN 'claimed' ELSE 'claimable' END AS state FROM (SELECT event_type, json_extract_string(props, '$.k')::INT % 5 AS k, epoch(date_trunc('second', ts)) + 86400 <= epoch(TIMESTAMP '2024-01-28 00:00:00') AS over FROM events)) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("claimed_at"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("attempts"), (F.col("event_type") == "purchase").alias("done"))
    return evidence.queue_claims(rows, F.to_timestamp(F.lit("2024-01-28 00:00:00")), lease_s=86400, most=3).groupBy("state").agg(F.count("*").alias("n"))


@register("queue_retry_delay", "SELECT event_id, least(600, 45 * (json_extract_string(props, '$.k')::INT % 20))::INT AS delay FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", evidence.retry_delay(F.get_json_object("props", "$.k").cast("int") % 20, 45, 600).alias("delay"))


# --- sources --------------------------------------------------------------------------------------------------


@register("source_page_facts", r"""WITH t AS (SELECT url AS subject, 'HAS_TITLE' AS predicate, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS object FROM pages)
  SELECT * FROM t WHERE object <> '' UNION ALL SELECT url, 'HAS_HEADING', unnest(list_distinct(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1, 'is'))) FROM pages UNION ALL SELECT url, 'LINKS_TO', unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)', 1, 'i'))) FROM pages""")
def _(spark, d):
    return src.page_facts(table(spark, d, "pages").select(F.col("url").alias("source"), "html")).drop("source")


@register("source_chat_export", "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT 'chat:' || conv_id AS subject, 'IS_A' AS predicate, 'ChatExport' AS object FROM n UNION ALL SELECT 'chat:' || conv_id, 'HAS_MESSAGE_COUNT', n::VARCHAR FROM n")
def _(spark, d):
    return src.chat_export_facts(table(spark, d, "conversations"))


@register("source_content_hashes", "SELECT page_id, sha256(html) AS hash, octet_length(encode(html)) AS bytes FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("hash"), F.octet_length("html").cast("bigint").alias("bytes"))


@register("source_sentence_proposals", r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')[1:50]) AS s FROM documents), w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(s, '^\s*(?i:decision|fact):', '')), '\s+') AS w FROM s)
  SELECT doc_id, w[1] AS subject, w[2] AS predicate, w[3] AS object FROM w WHERE len(w) = 3 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Za-z0-9:_-]{1,128}$'))) = 0""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(src.sentence_proposals(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.col("w")[0].alias("subject"), F.col("w")[1].alias("predicate"), F.col("w")[2].alias("object"))


@register("source_artifact_store", "SELECT substr(hash, 1, 2) AS part, count(*) AS n FROM (SELECT DISTINCT sha256(text) AS hash FROM documents) GROUP BY 1")
def _(spark, d):
    at = scratch_folder(spark, "artifacts")
    src.write_artifacts(table(spark, d, "documents").select(F.col("text").cast("binary").alias("content")), at)
    assert src.broken_artifacts(spark, at).isEmpty()
    return spark.read.parquet(at).groupBy(F.substring("hash", 1, 2).alias("part")).agg(F.count("*").alias("n"))


# --- streams ----------------------------------------------------------------------------------------------------


def _local(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@register("stream_tumbling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return _local(st.run_to_end(st.tumbling(st.event_stream(spark, d)), _shared(spark)), "start")


@register("stream_sliding_counts", "WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def _(spark, d):
    return _local(st.run_to_end(st.tumbling(st.event_stream(spark, d), "24 hours", "12 hours"), _shared(spark)), "start")


@register("stream_sessions", """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR, true) AS opens FROM events), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def _(spark, d):
    return _local(st.run_to_end(st.sessions(st.event_stream(spark, d)), _shared(spark)), "start")


@register("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return st.run_to_end(st.first_seen(st.event_stream(spark, d, late="40 days")), _shared(spark), "append")


@register("stream_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1")
def _(spark, d):
    return st.run_to_end(st.latest_state(st.event_stream(spark, d)), _shared(spark))


@register("stream_running_totals", "SELECT user_id, count(*) AS calls, sum(floor(value))::BIGINT AS delivered FROM events GROUP BY 1")
def _(spark, d):
    return st.run_to_end(st.running_totals(st.event_stream(spark, d)), _shared(spark))


# --- relational baseline ------------------------------------------------------------------------------------------


@register("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2")
def _(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))


@register("rel_top_orders", "SELECT o_orderkey, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 20")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return per.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).orderBy(F.col("revenue").desc(), "o_orderkey").limit(20).select("o_orderkey", "c_mktsegment", "revenue")


@register("rel_semi_anti", "SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer GROUP BY 1")
def _(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("w"))
    b = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("x"))
    return a.join(b, "c_mktsegment", "full_outer").select("c_mktsegment", F.coalesce("w", F.lit(0)).alias("with_orders"), F.coalesce("x", F.lit(0)).alias("without"))


@register("rel_set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionAll(c.exceptAll(o).agg(F.lit("only_customer").alias("part"), F.count("*").alias("n")))


@register("rel_offset_page", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return table(spark, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@register("rel_top_per_group", "SELECT n_name, s_suppkey, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) <= 3")
def _(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 3").select("n_name", "s_suppkey", "s_acctbal")
