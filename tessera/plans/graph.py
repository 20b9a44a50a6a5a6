"""Queries over graphs: places and parties, and a call graph of event kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import code, cypher
from tessera.operators import graph as op
from tessera.plans.bindings import CALLS_SQL, EDGES_SQL, FACTS_SQL, calls, edges, facts, table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


_E, _C = f"WITH RECURSIVE {EDGES_SQL}", f"WITH RECURSIVE {CALLS_SQL}"
_BOTH = "both_ways AS (SELECT src, dst FROM {0} UNION SELECT dst, src FROM {0})"


@register("graph_degrees", _E + ", n AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM n GROUP BY 1")
def _(spark, d):
    return op.degrees(edges(spark, d))


@register("graph_entity_multiplicity", _E + ", n AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT split_part(node, ':', 1) AS type, count(*) AS mentions, count(DISTINCT node) AS entities FROM n GROUP BY 1")
def _(spark, d):
    ends = edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(fn.entity_type(F.col("node")).alias("type")).agg(F.count("*").alias("mentions"), F.count_distinct("node").alias("entities"))


@register("graph_resolve_entity", _E + ", n AS (SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, CASE WHEN node = 'NATION_1' THEN 0 WHEN lower(node) = lower('NATION_1') THEN 1 ELSE 2 END AS match_class FROM n WHERE contains(lower(node), lower('NATION_1')) ORDER BY 2, 1 LIMIT 1")
def _(spark, d):
    return op.resolve(edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "NATION_1")


@register("graph_triple_join", """SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))  # before the joins: one row a customer
    rows = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


_WALK = "w AS (SELECT '{0}' AS node, 0 AS depth UNION SELECT b.dst, w.depth + 1 FROM w JOIN {1} b ON b.src = w.node WHERE w.depth < {2})"


@register("graph_neighbourhood", _E + ", " + _BOTH.format("edges") + ", " + _WALK.format("supplier:1", "both_ways", 3) + " SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1")
def _(spark, d):
    return op.neighbourhood(edges(spark, d), spark.createDataFrame([("supplier:1",)], "node string"), 3)


@register("graph_shortest_path", _E + ", " + _BOTH.format("edges") + """, p AS (SELECT ['supplier:1'] AS path, 'supplier:1' AS node UNION ALL SELECT list_append(p.path, b.dst), b.dst FROM p JOIN both_ways b ON b.src = p.node
   WHERE len(p.path) < 4 AND NOT list_contains(p.path, b.dst)), t AS (SELECT path FROM p WHERE node IN (SELECT dst FROM edges WHERE predicate = 'PART_OF') AND node = (SELECT min(dst) FROM edges WHERE predicate = 'PART_OF' AND src = (SELECT dst FROM edges WHERE src = 'supplier:1')) ORDER BY len(path), path LIMIT 1)
   SELECT unnest(range(len(path)))::INT AS step, unnest(path) AS node FROM t""")
def _(spark, d):
    e = edges(spark, d)
    home = e.where("src = 'supplier:1'").select(F.col("dst").alias("home"))
    goal = e.where("predicate = 'PART_OF'").join(F.broadcast(home), F.col("src") == F.col("home")).agg(F.min("dst")).first()[0]
    return op.shortest_path(e, "supplier:1", goal)


@register("graph_reverse_impact", _C + ", w AS (SELECT 'function:signup_3' AS node, 0 AS depth UNION SELECT c.caller, w.depth + 1 FROM w JOIN calls c ON c.callee = w.node WHERE w.depth < 3) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1")
def _(spark, d):
    return op.reverse_impact(calls(spark, d), spark.createDataFrame([("function:signup_3",)], "node string"), 3)


@register("graph_trace_paths", _C + """, p AS (SELECT ['function:signup_3'] AS path, 'function:signup_3' AS node UNION ALL SELECT list_append(p.path, c.callee), c.callee FROM p JOIN calls c ON c.caller = p.node WHERE len(p.path) <= 3 AND NOT list_contains(p.path, c.callee))
  SELECT (len(path) - 1)::INT AS n_edges, array_to_string(path, ' > ') AS path FROM p WHERE len(path) > 1 ORDER BY 1, 2 LIMIT 100""")
def _(spark, d):
    e = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return op.trace_paths(e, "function:signup_3", 3)


def _lpa(passes: int) -> str:
    sql = _C + ", links AS (SELECT caller AS src, callee AS dst FROM calls UNION SELECT callee, caller FROM calls), l0 AS (SELECT DISTINCT src AS node, src AS label FROM links)"
    for k in range(passes):
        sql += f""", v{k} AS (SELECT k.src AS node, l.label, count(*) AS n FROM links k JOIN l{k} l ON l.node = k.dst GROUP BY 1, 2), l{k + 1} AS (SELECT node, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)"""
    return sql


@register("graph_communities", _lpa(3) + " SELECT node, label FROM l3")
def _(spark, d):
    return op.label_propagation(calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), 3)


@register("graph_community_stats", _lpa(3) + """, m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY node) AS r FROM l3), n AS (SELECT label, count(*) AS n_nodes, string_agg(node, ',' ORDER BY node) FILTER (r <= 5) AS sample FROM m GROUP BY 1)
  SELECT n.label, n_nodes, coalesce(e.c, 0) AS n_edges, sample FROM n LEFT JOIN (SELECT label, count(*) AS c FROM calls JOIN l3 ON node = caller GROUP BY 1) e USING (label)""")
def _(spark, d):
    e = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return op.community_stats(e, op.label_propagation(e, 3))


@register("graph_dead_code", _E + " SELECT node FROM (SELECT DISTINCT src AS node FROM edges) WHERE node NOT IN (SELECT dst FROM edges) AND NOT starts_with(node, 'customer:')")
def _(spark, d):
    e = edges(spark, d)
    as_calls = e.select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return op.dead_code(e.select(F.col("src").alias("node")).distinct(), as_calls, F.startswith("node", F.lit("customer:")))


@register("graph_overview", _C + """, e AS (SELECT node, sum(o) AS od, sum(i) AS id, count(*) AS d FROM (SELECT caller AS node, 1 AS o, 0 AS i FROM calls UNION ALL SELECT callee, 0, 1 FROM calls) GROUP BY 1)
  (SELECT 'entry_point' AS kind, node, od::BIGINT AS score FROM e WHERE od > 0 AND id = 0 ORDER BY od DESC, node LIMIT 10) UNION ALL (SELECT 'hotspot', node, d FROM e ORDER BY d DESC, node LIMIT 10)""")
def _(spark, d):
    return op.overview(calls(spark, d))


@register("graph_cross_source", _E + ", h AS (SELECT src AS node, min(source) AS source FROM edges GROUP BY 1) SELECT DISTINCT e.src, e.dst, a.source AS from_source, b.source AS to_source FROM edges e JOIN h a ON a.node = e.src JOIN h b ON b.node = e.dst WHERE a.source <> b.source")
def _(spark, d):
    e = edges(spark, d)
    return op.cross_source(e, e.groupBy(F.col("src").alias("node")).agg(F.min("source").alias("source"))).select("src", "dst", "from_source", "to_source")


@register("graph_language_histogram", _E + " SELECT CASE regexp_extract(source, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' END AS language, count(*) AS n FROM edges GROUP BY 1")
def _(spark, d):
    return op.languages(edges(spark, d))


@register("graph_semi_join_seeds", f"WITH {FACTS_SQL}, s AS (SELECT DISTINCT subject, object FROM facts WHERE predicate = 'signup' AND status = 'active') SELECT fact_id FROM facts f WHERE subject IN (SELECT subject FROM s) OR subject IN (SELECT object FROM s) OR object IN (SELECT subject FROM s)")
def _(spark, d):
    f = facts(spark, d)
    seed = f.where("predicate = 'signup' AND status = 'active'")
    s, o = seed.select(F.col("subject").alias("x")).distinct(), seed.select(F.col("object").alias("x")).distinct()
    f = f.select("fact_id", "subject", "object")
    hits = [f.join(s, f["subject"] == s["x"], "left_semi"), f.join(o, f["subject"] == o["x"], "left_semi"), f.join(s, f["object"] == s["x"], "left_semi")]
    return hits[0].unionAll(hits[1]).unionAll(hits[2]).select("fact_id").distinct()


@register("graph_clone_pairs", """WITH t AS (SELECT doc_id, lang AS language, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tokens FROM documents WHERE len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) >= 5),
  c AS (SELECT language, tokens, min(doc_id) AS a FROM t GROUP BY ALL),
  w AS (SELECT a, language, len(tokens) AS n, unnest(tokens) AS w FROM c),
  m AS (SELECT x.a, y.a AS b, count(*) / (x.n + y.n - count(*)) AS j FROM w x JOIN w y ON x.language = y.language AND x.w = y.w AND x.a < y.a GROUP BY x.a, y.a, x.n, y.n)
  SELECT a, b, round(j, 6) AS similarity FROM m WHERE round(j, 6) >= 0.8
  UNION ALL SELECT c.a, t.doc_id, 1.0::DOUBLE FROM t JOIN c ON t.language IS NOT DISTINCT FROM c.language AND t.tokens = c.tokens WHERE c.a <> t.doc_id""")
def _(spark, d):
    sets = table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.sort_array(F.array_distinct(fn.terms(F.col("text")))).alias("tokens")).where(F.size("tokens") >= 5)
    return op.similar_sets(sets, "doc_id", threshold=0.8)


_CYPHER = {
    "cypher_labels": ("MATCH (s:Supplier)-[r:LOCATED_IN]->(n:Nation) RETURN s.name AS supplier, n.name AS nation, r.source AS source", _E + " SELECT src AS supplier, dst AS nation, source FROM edges WHERE predicate = 'LOCATED_IN'"),
    "cypher_where_distinct": (
        "MATCH (a)-[r]->(b:Nation) WHERE (r.predicate = 'LIVES_IN' AND a.name CONTAINS '99') OR NOT a:Customer RETURN DISTINCT b.name AS nation ORDER BY nation LIMIT 10",
        _E + " SELECT DISTINCT dst AS nation FROM edges WHERE starts_with(dst, 'nation:') AND ((predicate = 'LIVES_IN' AND contains(src, '99')) OR NOT starts_with(src, 'customer:')) ORDER BY 1 LIMIT 10",
    ),
    "cypher_count": ("MATCH (a:Customer)-[r:LIVES_IN]->(b) WHERE b.name STARTS WITH 'nation:' RETURN count(*) AS n", _E + " SELECT count(*) AS n FROM edges WHERE predicate = 'LIVES_IN' AND starts_with(src, 'customer:')"),
    "cypher_with_distinct": ("MATCH (a:Customer)-[:LIVES_IN]->(b) WITH DISTINCT b.name AS nation RETURN nation ORDER BY nation LIMIT 5", _E + " SELECT DISTINCT dst AS nation FROM edges WHERE predicate = 'LIVES_IN' ORDER BY 1 LIMIT 5"),
    "cypher_with_groups": (
        "MATCH (a)-[r]->(b:Nation) WHERE NOT a.name = 'customer:1' WITH b.name AS nation, r.predicate AS kind, count(*) AS n WHERE n > 2 AND kind <> 'PART_OF' RETURN nation, n, kind ORDER BY n DESC",
        _E + " SELECT dst AS nation, predicate AS kind, count(*) AS n FROM edges WHERE starts_with(dst, 'nation:') AND src <> 'customer:1' GROUP BY 1, 2 HAVING count(*) > 2",
    ),
    "cypher_with_stages": (
        "MATCH (a)-[r]->(b:Nation) WITH b, count(*) AS n, count(DISTINCT r.predicate) AS kinds WITH n, kinds, count(*) AS nations, count(DISTINCT b.name) AS names WHERE nations >= 1 RETURN n, kinds, nations, names",
        _E + ", g AS (SELECT dst, count(*) AS n, count(DISTINCT predicate) AS kinds FROM edges WHERE starts_with(dst, 'nation:') GROUP BY 1) SELECT n, kinds, count(*) AS nations, count(DISTINCT dst) AS names FROM g GROUP BY 1, 2",
    ),
    "cypher_with_counts": ("MATCH (a)-[r]->(b) WITH r.predicate AS kind, count(*) AS n, count(DISTINCT b.name) AS ends RETURN kind, n, ends ORDER BY kind", _E + " SELECT predicate AS kind, count(*) AS n, count(DISTINCT dst) AS ends FROM edges GROUP BY 1"),
    "cypher_count_distinct": ("MATCH (a)-[r]->(b) RETURN count(DISTINCT b.type) AS n", _E + " SELECT count(DISTINCT split_part(dst, ':', 1)) AS n FROM edges"),
}


def _cypher(name: str, text: str, sql: str) -> None:
    @register(name, sql)
    def _(spark, d):
        return cypher.query(edges(spark, d), text)


for _name, (_text, _sql) in _CYPHER.items():
    _cypher(_name, _text, _sql)


@register("cypher_page", _E + " SELECT src AS who, dst AS nation, (SELECT count(*) FROM edges WHERE predicate = 'LIVES_IN') > 100 AS truncated FROM edges WHERE predicate = 'LIVES_IN' ORDER BY src, dst LIMIT 100")
def _(spark, d):
    rows, truncated = cypher.query_page(edges(spark, d), "MATCH (a)-[:LIVES_IN]->(b) RETURN a.name AS who, b.name AS nation ORDER BY who", 100)
    return rows.withColumn("truncated", F.lit(truncated))


@register("cypher_as_of", f"WITH {FACTS_SQL} SELECT subject AS who, object AS what FROM facts WHERE predicate = 'click' AND valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 00:00:00')")
def _(spark, d):
    e = facts(spark, d).select(F.col("subject").alias("src"), "predicate", F.col("object").alias("dst"), "source", "valid_from", "valid_until")
    return cypher.query(e, "AS OF '2024-01-15 00:00:00' MATCH (a)-[r:click]->(b) RETURN a.name AS who, b.name AS what")


@register("cypher_to_integer", f"WITH {FACTS_SQL} SELECT fact_id FROM facts WHERE predicate = 'view' AND confidence > 50")
def _(spark, d):
    e = facts(spark, d).select("fact_id", F.col("subject").alias("src"), "predicate", F.col("fact_id").cast("string").alias("dst"), F.ceil("confidence").cast("string").alias("source"))
    return cypher.query(e, "MATCH (a)-[r:view]->(b) WHERE toInteger(r.source) > 50 RETURN toInteger(b.name) AS fact_id")


@register("graph_architecture_rank", _E + """, n AS (SELECT src AS node, min(CASE predicate WHEN 'PART_OF' THEN 'class' ELSE 'function' END) AS kind, min(source) AS path FROM edges GROUP BY 1), g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
  SELECT node, path, degree, (CASE kind WHEN 'class' THEN 40 ELSE 20 END + least(60, 3 * degree))::BIGINT AS score FROM n JOIN g USING (node) ORDER BY score DESC, node LIMIT 20""")
def _(spark, d):
    e = edges(spark, d)
    nodes = e.groupBy(F.col("src").alias("node")).agg(F.min(F.when(F.col("predicate") == "PART_OF", "class").otherwise("function")).alias("kind"), F.min("source").alias("path"))
    return code.architecture_rank(nodes, e)


@register("graph_search_nodes", _E + """, n AS (SELECT src AS node, min(split_part(src, ':', 1)) AS kind, min(source) AS path FROM edges GROUP BY 1),
  s AS (SELECT node, round(CASE WHEN list_contains(w, 'nation') OR list_contains(w, '7') THEN len(list_intersect(['nation', '7'], w)) / sqrt((2 * len(w))::DOUBLE) ELSE 0 END * 0.82::DOUBLE, 6) AS score FROM (SELECT node, list_distinct(list_prepend(lower(node), regexp_extract_all(lower(regexp_replace(node, '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[a-z0-9]+'))) AS w FROM n))
  SELECT node, node AS label, score FROM s WHERE score > 0 ORDER BY score DESC, node LIMIT 20""")
def _(spark, d):
    nodes = edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.min(fn.entity_type(F.col("src"))).alias("kind"), F.min("source").alias("path"))
    return code.search_graph(nodes.withColumn("label", F.col("node")), ["nation", "7"])
