"""Queries over semantic search, candidates, partners, lifecycles and ignore rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import candidates, lifecycle, semantic
from tessera.plans.bindings import EDGES_SQL, edges, table
from tessera.sources.ignore import ignored

QUERIES, ORACLES = {}, {}
NOW = "2024-01-31 00:00:00"


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


_T = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_MOST = 6
_INDEX = f"""WITH d AS (SELECT item_id, {_T} AS t, ('0x' || substr(md5(item_id::VARCHAR), 1, 4))::BIGINT % 64 AS part FROM benchmark),
  o AS (SELECT item_id, part, unnest(range(len(t))) AS pos, unnest(t) AS term, t FROM d),
  n AS (SELECT *, count(*) OVER (PARTITION BY term) AS total, row_number() OVER (PARTITION BY term ORDER BY part, item_id, pos) - 1 AS ord FROM o),
  s AS (SELECT item_id, pos, term, list_concat(t[greatest(1, pos - 4):pos], t[pos + 2:pos + 6]) AS c FROM n WHERE total <= {_MOST} OR ord % ceil(total / {_MOST}::DOUBLE)::BIGINT = 0),
  bh AS (SELECT term, unnest(list_transform(range(8), lambda j: ('0x' || substr(sha256(term), (j * 4 + 1)::INT, 4))::BIGINT)) AS h FROM (SELECT DISTINCT term FROM o)),
  bs AS (SELECT term, (h % 256)::INT AS dim, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS s FROM bh GROUP BY 1, 2 HAVING s <> 0),
  b AS (SELECT term, dim, s / sqrt(sum(s * s) OVER (PARTITION BY term)) AS v FROM bs),
  p AS (SELECT term, near, sum(w) AS w FROM (SELECT term, unnest(c) AS near, 0.3::DOUBLE / len(c) AS w FROM s WHERE len(c) > 0) GROUP BY 1, 2),
  es AS (SELECT term, dim, sum(v) AS s FROM (SELECT term, dim, v FROM b UNION ALL SELECT p.term, dim, w * v FROM p JOIN b ON b.term = p.near) GROUP BY 1, 2),
  e AS (SELECT term, dim, s / sqrt(sum(s * s) OVER (PARTITION BY term)) AS v FROM es),
  tf AS (SELECT item_id, term, count(*) AS tf FROM o GROUP BY 1, 2), idf AS (SELECT term, log2(1 + (SELECT count(*) FROM benchmark) / count(*)) + 0.5 AS idf FROM tf GROUP BY 1),
  w AS (SELECT item_id, term, sqrt(tf) * idf AS w FROM tf JOIN idf USING (term)),
  ds AS (SELECT item_id, dim, sum(w * v) AS s FROM w JOIN e USING (term) GROUP BY 1, 2), dv AS (SELECT item_id, dim, s / sqrt(sum(s * s) OVER (PARTITION BY item_id)) AS v FROM ds)"""


@register("search_sampled_occurrences", _INDEX + " SELECT item_id, pos::INT AS pos, term, array_to_string(c, ' ') AS context FROM s")
def _(spark, d):
    rows = semantic.sampled_occurrences(table(spark, d, "benchmark"), "item_id", _MOST)
    return rows.select("item_id", "pos", "term", F.array_join("context", " ").alias("context"))


@register("search_enriched_terms", _INDEX + " SELECT term, dim, round(v, 6) + 0.0 AS v FROM e")
def _(spark, d):
    return semantic.term_vectors(table(spark, d, "benchmark"), "item_id", _MOST).select("term", "dim", (F.round("v", 6) + 0.0).alias("v"))


@register("search_semantic", _INDEX + """, q AS (SELECT min(item_id) AS q FROM benchmark), ri AS (SELECT a.item_id, sum(a.v * b.v) AS ri FROM dv a JOIN dv b USING (dim) JOIN q ON b.item_id = q.q WHERE a.item_id <> q.q GROUP BY 1),
  tn AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS v FROM w), ti AS (SELECT a.item_id, sum(a.v * b.v) AS tfidf FROM tn a JOIN tn b USING (term) JOIN q ON b.item_id = q.q WHERE a.item_id <> q.q GROUP BY 1),
  st AS (SELECT item_id, list_distinct(t) AS t FROM d), sg AS (SELECT item_id, t, list_transform(range(64), lambda i: list_min(list_transform(t, lambda x: substr(md5(i || ':' || x), 1, 16)))) AS g FROM st),
  mo AS (SELECT a.item_id, len(list_filter(list_zip(a.g, b.g), lambda z: z[1] = z[2])) / 64 AS minhash, len(list_intersect(a.t, b.t)) / len(b.t) AS overlap FROM sg a, sg b, q WHERE b.item_id = q.q AND a.item_id <> q.q),
  r AS (SELECT item_id, greatest(0, round(coalesce(ri, 0), 6)) AS ri, greatest(0, round(coalesce(tfidf, 0), 6)) AS tfidf, round(minhash, 6) AS minhash, round(overlap, 6) AS overlap FROM mo LEFT JOIN ri USING (item_id) LEFT JOIN ti USING (item_id))
  SELECT *, round(greatest(0.70::DOUBLE * ri + 0.20::DOUBLE * tfidf + 0.10::DOUBLE * minhash, 0.72::DOUBLE * overlap), 6) AS score FROM r WHERE score > 0 ORDER BY score DESC, item_id LIMIT 20""")
def _(spark, d):
    items = table(spark, d, "benchmark")
    first = items.agg(F.min("item_id")).first()[0]
    return semantic.semantic_search(items, "item_id", str(first), most=_MOST)


_PARTNER = "WITH t AS (SELECT doc_id, list_distinct(" + _T + ") AS t FROM documents), w AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM t), j AS (SELECT a.doc_id, b.doc_id AS partner, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 3) AS score FROM w a JOIN w b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY 1, 2)"


@register("content_best_partner", _PARTNER + " SELECT doc_id, arg_max(partner, (score, -partner)) AS partner, max(score) AS score FROM j WHERE score > 0 GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(fn.terms(F.col("text"))).alias("tokens"))
    return candidates.best_partners(docs, "doc_id")


@register("candidates_by_id", """WITH r AS (SELECT o_custkey AS request, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids FROM orders GROUP BY 1), x AS (SELECT request, unnest(range(1, len(ids) + 1)) AS rank, unnest(ids) AS id FROM r)
  SELECT request, rank::INT AS rank, id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem) THEN id END AS record FROM x""")
def _(spark, d):
    o = table(spark, d, "orders")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"])
    requests = o.groupBy(F.col("o_custkey").alias("request")).agg(ids.alias("ids"))
    return candidates.exact_candidates(requests, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record")))


def _graph_request(spark, d):
    e = edges(spark, d).withColumn("id", F.concat_ws("|", "src", "predicate", "dst")).withColumn("file", F.concat("source", F.lit("#"), F.pmod(F.length("src"), F.lit(5))))
    e = e.withColumn("kind", F.when(F.col("predicate") == "PART_OF", "imports").when(F.col("predicate") == "LIVES_IN", "calls").otherwise("references"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id"), "file").groupBy("id").agg(F.min("file").alias("file"))
    found = nodes.where("startswith(id, 'nation:')").crossJoin(spark.range(2).select((F.col("id") + 1).alias("request")))
    rank = F.when(F.col("request") == 1, F.length("id")).otherwise(-F.length("id"))
    found = found.withColumn("rank", rank).withColumn("score", 1.0 / F.length("id")).withColumn("kind", F.when(F.contains("id", F.lit("A")), "file").otherwise("symbol"))
    return found, e.select("id", "kind", "src", "dst", "file")


@register("candidates_from_graph", f"""WITH {EDGES_SQL}, e AS (SELECT src || '|' || predicate || '|' || dst AS id, CASE predicate WHEN 'PART_OF' THEN 0 WHEN 'LIVES_IN' THEN 1 ELSE 2 END AS prio, src, dst, source || '#' || (length(src) % 5) AS file FROM edges),
  nd AS (SELECT id, min(file) AS file FROM (SELECT src AS id, file FROM e UNION ALL SELECT dst, file FROM e) WHERE starts_with(id, 'nation:') GROUP BY 1),
  f AS (SELECT r AS request, id, file, CASE r WHEN 1 THEN length(id) ELSE -length(id) END AS rank, 1.0::DOUBLE / length(id) AS score, CASE WHEN contains(id, 'A') THEN 0 ELSE 1 END AS seedp FROM nd, (VALUES (1), (2)) v(r)),
  d AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rank, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY request, file ORDER BY rank, id) AS nth FROM f) WHERE nth <= 2 QUALIFY place <= 6),
  s AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY seedp, score DESC, id) AS seed FROM d),
  m AS (SELECT s.request, s.seed, s.score, e.prio, e.id, e.file FROM s JOIN e ON e.src = s.id OR e.dst = s.id),
  u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY request, id ORDER BY seed, prio) = 1), v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY request, file ORDER BY seed, prio, id) = 1),
  x AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY seed, prio, id) + (SELECT count(*) FROM d WHERE d.request = v.request) AS place FROM v)
  SELECT request::BIGINT AS request, place::BIGINT AS place, id, 'direct' AS origin, round(score, 6) AS score FROM d UNION ALL SELECT request, place, id, 'neighbour', round(greatest(0.01, score * 0.65::DOUBLE), 6) FROM x WHERE place <= 8""")
def _(spark, d):
    found, e = _graph_request(spark, d)
    return candidates.graph_candidates(found, e, 8).withColumn("place", F.col("place").cast("bigint"))


@register("search_by_age", f"""WITH h AS (SELECT event_id AS fact_id, 'user:' || user_id AS subject, event_type AS object, ts AS valid_from, value FROM events), m AS (SELECT fact_id, value / 10 AS bm25 FROM h WHERE object = 'purchase' AND value > 90), l AS (SELECT fact_id, 0.5::DOUBLE AS lexical FROM h WHERE object = 'signup'),
  n AS (SELECT DISTINCT subject AS node FROM h JOIN m USING (fact_id) UNION SELECT DISTINCT object FROM h JOIN m USING (fact_id)),
  r AS (SELECT fact_id, valid_from, round(greatest(coalesce(lexical, 0), coalesce(0.4::DOUBLE / (1 + abs(bm25)), 0)), 6) AS text, subject IN (SELECT node FROM n) OR object IN (SELECT node FROM n) AS rel,
    round(1 / (1 + greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 86400000000.0::DOUBLE), 6) AS recency FROM h LEFT JOIN l USING (fact_id) LEFT JOIN m USING (fact_id)),
  g AS (SELECT *, CASE WHEN text > 0 THEN 0.2::DOUBLE WHEN rel THEN 0.4::DOUBLE ELSE 0 END AS graph FROM r)
  SELECT fact_id, text, graph, recency, round(0.7::DOUBLE * text + 0.2::DOUBLE * graph + 0.1::DOUBLE * recency, 6) AS score FROM g WHERE text > 0 OR graph > 0 ORDER BY score DESC, valid_from DESC, fact_id LIMIT 50""")
def _(spark, d):
    f = table(spark, d, "events").select(F.col("event_id").alias("fact_id"), F.concat(F.lit("user:"), "user_id").alias("subject"), F.col("event_type").alias("object"), F.col("ts").alias("valid_from"), "value")
    matched = f.where("object = 'purchase' and value > 90").select("fact_id", (F.col("value") / 10).alias("bm25"))
    lexical = f.where("object = 'signup'").select("fact_id", F.lit(0.5).alias("lexical"))
    return candidates.hybrid_by_age(lexical, matched, f.drop("value"), F.to_timestamp(F.lit(NOW)), 50)


@register("fact_decay", f"SELECT event_id, round(exp(-(greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0::DOUBLE) / 60), 6) AS decay, round(1 / (1 + greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0::DOUBLE), 6) AS recency FROM events")
def _(spark, d):
    now = F.to_timestamp(F.lit(NOW))
    return table(spark, d, "events").select("event_id", F.round(candidates.decay(F.col("ts"), now), 6).alias("decay"), F.round(candidates.recency(F.col("ts"), now), 6).alias("recency"))


_OPS = "CASE event_type WHEN 'view' THEN 'verify' WHEN 'click' THEN 'activate' WHEN 'purchase' THEN 'retract' WHEN 'error' THEN CASE WHEN value < 40 THEN 'reject' ELSE 'supersede' END ELSE CASE WHEN value < 60 THEN 'expire' ELSE 'quarantine' END END"
_LIFE = f"""WITH RECURSIVE e AS (SELECT event_id, user_id || ':' || (epoch_us(ts) // 172800000000) AS k, ts, {_OPS} AS op, value > 20 AS evidence, user_id % 5 = 0 AS confirmed FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS i FROM e),
  f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS before, 'proposed' AS state, NULL::VARCHAR AS why FROM (SELECT DISTINCT k FROM n)
    UNION ALL SELECT k, i, event_id, before, CASE WHEN why IS NOT NULL THEN before ELSE CASE op WHEN 'verify' THEN 'verified' WHEN 'activate' THEN 'active' WHEN 'reject' THEN 'rejected' WHEN 'supersede' THEN 'superseded' WHEN 'retract' THEN 'retracted' WHEN 'expire' THEN 'expired' ELSE 'quarantined' END END, why
    FROM (SELECT n.k, n.i, n.event_id, n.op, f.state AS before, CASE op
        WHEN 'verify' THEN CASE WHEN f.state IN ('quarantined', 'rejected', 'retracted', 'expired') THEN 'cannot_verify_' || f.state WHEN NOT evidence THEN 'verification_needs_evidence' END
        WHEN 'activate' THEN CASE WHEN f.state IN ('quarantined', 'rejected', 'retracted', 'expired', 'superseded') THEN 'cannot_activate_' || f.state WHEN f.state <> 'verified' AND NOT confirmed THEN 'activation_needs_verification' END
        WHEN 'reject' THEN CASE WHEN f.state = 'active' THEN 'active_must_be_retracted' END WHEN 'supersede' THEN CASE WHEN f.state <> 'active' THEN 'only_active_is_superseded' END
        WHEN 'retract' THEN CASE WHEN f.state NOT IN ('active', 'verified') THEN 'only_active_or_verified_is_retracted' END END AS why FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1))"""


def _judged(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(":", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 172_800_000_000)).alias("k"), "ts", F.expr(_OPS).alias("op"), (F.col("value") > 20).alias("evidence"), (F.col("user_id") % 5 == 0).alias("confirmed"))
    return lifecycle.judge(e, "k", ["ts", "event_id"])


@register("lifecycle_decisions", _LIFE + " SELECT event_id, before AS state_before, state, why AS refused FROM f WHERE i > 0")
def _(spark, d):
    return _judged(spark, d).select("event_id", "state_before", "state", "refused")


@register("lifecycle_states", _LIFE + " SELECT k, arg_max(state, i) AS state, count(*) FILTER (i > 0 AND why IS NULL) AS taken, count(*) FILTER (why IS NOT NULL) AS refused FROM f GROUP BY k")
def _(spark, d):
    return lifecycle.latest(_judged(spark, d), "k", ["ts", "event_id"])


_PATH = "coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || CASE doc_id % 3 WHEN 0 THEN '/build' WHEN 1 THEN '/lib' ELSE '' END || '/d' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.log' WHEN 2 THEN '.md' ELSE '.tmp' END"
_RULES = [("", "# at the root\n*.log\n!keep*.log\nbuild/\n/src1/fr/\n\n"), ("src2", "!*.log\n*.md  \n/en/*.tmp\n"), ("src3", "!build/\nlib/**/*.py\nde/**\n!de/lib\n!d1?[0-4].md"), ("src4/en", "d[0-9]*.tmp\n!d*5.tmp\n\\#x\n")]


@register("source_ignored", f"""WITH f AS (SELECT {_PATH} AS path, source, lang, doc_id % 3 AS m, doc_id % 4 AS e, 'd' || doc_id AS d FROM documents),
  r AS (SELECT path, CASE WHEN source = 'src1' AND lang = 'fr' THEN 'src1/fr' WHEN m = 0 AND NOT coalesce(source = 'src3', false) AND NOT coalesce(source = 'src2' AND false, false) THEN coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/build'
    WHEN source = 'src3' AND lang = 'de' THEN CASE WHEN m = 0 THEN 'src3/de/build' WHEN m = 2 AND NOT (e = 2 AND regexp_matches(d, '^d1.[0-4]$')) THEN path WHEN m = 1 AND e = 2 AND regexp_matches(d, '^d1.[0-4]$') THEN NULL WHEN m = 1 THEN path END
    WHEN source = 'src3' AND e = 0 AND false THEN path
    WHEN source = 'src2' AND e = 1 THEN NULL WHEN source = 'src2' AND e = 2 THEN path WHEN source = 'src2' AND lang = 'en' AND m = 2 AND e = 3 THEN path
    WHEN source = 'src4' AND lang = 'en' AND e = 3 AND NOT regexp_matches(d, '5$') THEN path WHEN e = 1 THEN path END AS entry FROM f)
  SELECT path, entry FROM r""")
def _(spark, d):
    files = table(spark, d, "documents").select(F.expr(_PATH).alias("path"))
    return ignored(files, spark.createDataFrame(_RULES, "folder string, text string")).select("path", "entry")
