"""Queries over filters, pages, impact and export of graphs, unicode text, and statistics by category."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import explore as op
from tessera.operators import graph, views
from tessera.operators.symbols import SymbolIndex, source_graph
from tessera.plans.bindings import CALLS_SQL, FACTS_SQL, calls, facts, table
from tessera.plans.code import _FILES, source_files

QUERIES, ORACLES = {}, {}
NOW = "2024-01-31 00:00:00"


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def now():
    return F.to_timestamp(F.lit(NOW))


_UNICODE = r"'[\p{L}\p{M}\p{N}]+'"


@register("text_unicode_terms", f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), {_UNICODE}) AS t FROM documents)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", fn.unicode_terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@register("text_normal_form", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fn.normal_form(F.col("text"), "NFC").cast("binary")).alias("digest"))


_INGEST = "SELECT fact_id, subject, predicate, object FROM (SELECT *, CASE WHEN fact_id % 3 = 0 THEN '{\"by\": \"ingest:code\"}' ELSE '{\"by\": \"user\"}' END AS metadata, CASE WHEN predicate = 'error' THEN 'retired_' || object ELSE object END AS object2 FROM facts) WHERE status = 'active' AND superseded_by IS NULL AND NOT starts_with(object2, 'retired_') AND contains(metadata, 'ingest:')"


@register("fact_ingested", f"WITH {FACTS_SQL} {_INGEST}")
def _(spark, d):
    metadata = F.when(F.col("fact_id") % 3 == 0, '{"by": "ingest:code"}').otherwise('{"by": "user"}')
    rows = facts(spark, d).withColumn("metadata", metadata).withColumn("object", F.when(F.col("predicate") == "error", F.concat(F.lit("retired_"), "object")).otherwise(F.col("object")))
    return op.ingested(rows).select("fact_id", "subject", "predicate", "object")


@register("profile_accepted", r"""SELECT doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'rejected' ELSE 'active' END IN ('active', 'verified') AND coalesce(source, '') <> 'src2' AND length(trim(text)) > 0
    AND NOT (regexp_matches(text, '(?i)(password|passwd|token|secret|api[_-]?key|private[_-]?key|credential)') AND contains(text, '=')), false) AS accepted
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def _(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 0, "rejected").otherwise("active")
    return docs.select("doc_id", op.accepted(status, F.when(F.col("source") == "src2", "secret").otherwise("workspace"), F.col("text")).alias("accepted"))


@register("code_filtered_nodes", _FILES + " SELECT path, name AS label, kind FROM sy WHERE kind IN ('function', 'class') AND regexp_matches(name, '^(view|Feed)_[0-9]*[13579]$') AND starts_with(path, 'src/user_1')")
def _(spark, d):
    s = SymbolIndex(source_files(spark, d)).symbols.select("path", F.col("name").alias("label"), "kind", F.col("path").alias("locator"))
    return op.filter_graph(s, label="^(view|Feed)_[0-9]*[13579]$", kinds=("function", "class"), prefix="src/user_1").select("path", "label", "kind")


@register("rel_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) - 60 > 0 AS has_more, greatest(0, (SELECT count(*) FROM customer) - 60) AS omitted FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return op.page(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.col("c_acctbal").desc(), "c_custkey"], offset=40, limit=20).drop("c_acctbal")


@register("graph_diff_impact", _FILES + """, ed AS (SELECT DISTINCT 'calls' AS kind, path || ':' || caller AS src, to_path || ':' || callee AS dst FROM ca UNION SELECT 'contains', path, path || ':' || name FROM sy UNION SELECT 'imports', f.path, g.path FROM f JOIN f g ON g.u = f.u + 3 AND f.u % 3 < 2),
  b AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), h0 AS (SELECT path || ':' || name AS node, 0 AS depth FROM sy WHERE path IN ('src/user_6.py', 'src/user_7.js')),
  h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT b.dst, 1 FROM h0 JOIN b ON b.src = h0.node WHERE b.dst NOT IN (SELECT node FROM h0)), h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT b.dst, 2 FROM h1 JOIN b ON b.src = h1.node WHERE h1.depth = 1 AND b.dst NOT IN (SELECT node FROM h1)),
  k AS (SELECT path AS node, 'file' AS kind FROM f UNION ALL SELECT path || ':' || name, kind FROM sy), dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed WHERE kind = 'calls' UNION ALL SELECT dst FROM ed WHERE kind = 'calls') GROUP BY 1)
  SELECT node, kind, depth, coalesce(degree, 0) AS degree FROM h2 JOIN k USING (node) LEFT JOIN dg USING (node)""")
def _(spark, d):
    nodes, edges = _code_graph(spark, d)
    return op.diff_impact(nodes, edges, spark.createDataFrame([("src/user_6.py",), ("src/user_7.js",)], "path string")).select("node", "kind", "depth", "degree")


def _code_graph(spark, d):
    """Nodes and edges of the code graph under readable names: a file by its path, a symbol by path and name."""
    index = SymbolIndex(source_files(spark, d))
    nodes, edges = source_graph(index.files, index.symbols, index.imports, index.calls)
    short = F.when(F.col("kind") == "file", F.col("path")).otherwise(F.concat_ws(":", "path", F.regexp_replace("label", r"^Feed_[0-9]+_(start|run)$", "$1")))
    nodes = nodes.select("id", short.alias("node"), "kind", "path")
    a, b = nodes.select(F.col("id").alias("src"), F.col("node").alias("s")), nodes.select(F.col("id").alias("dst"), F.col("node").alias("t"))
    return nodes, edges.join(a, "src").join(b, "dst").select("kind", F.col("s").alias("src"), F.col("t").alias("dst"))


_IN = "WITH RECURSIVE " + CALLS_SQL + """, p AS (SELECT ['function:signup_3'] AS path, 'function:signup_3' AS node UNION ALL SELECT list_append(p.path, c.caller), c.caller FROM p JOIN calls c ON c.callee = p.node WHERE len(p.path) <= 3 AND NOT list_contains(p.path, c.caller))
  SELECT (len(path) - 1)::INT AS n_edges, array_to_string(path, ' > ') AS path FROM p WHERE len(path) > 1 ORDER BY 1, 2 LIMIT 100"""
_EITHER = "WITH RECURSIVE " + CALLS_SQL + """, w AS (SELECT caller AS a, callee AS b FROM calls UNION SELECT callee, caller FROM calls), p AS (SELECT ['function:signup_3'] AS path, 'function:signup_3' AS node UNION ALL SELECT list_append(p.path, w.b), w.b FROM p JOIN w ON w.a = p.node WHERE len(p.path) <= 2 AND NOT list_contains(p.path, w.b))
  SELECT (len(path) - 1)::INT AS n_edges, array_to_string(path, ' > ') AS path FROM p WHERE len(path) > 1 ORDER BY 1, 2 LIMIT 100"""


@register("graph_trace_inbound", _IN)
def _(spark, d):
    return graph.trace_paths(calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), "function:signup_3", 3, direction="inbound")


@register("graph_trace_both", _EITHER)
def _(spark, d):
    return graph.trace_paths(calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), "function:signup_3", 2, direction="both")


_EXPORT = f"WITH {FACTS_SQL}, ed AS (SELECT fact_id, subject AS src, predicate, object AS dst, valid_from <= TIMESTAMP '{NOW}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{NOW}') AND superseded_by IS NULL AS current, upper(predicate) IN ('GOVERNS', 'DECIDES', 'REQUIRES') OR starts_with(subject, 'policy:') OR starts_with(subject, 'decision:') AS governed FROM (SELECT * REPLACE (CASE WHEN predicate = 'signup' THEN 'decision:' || subject ELSE subject END AS subject) FROM facts))"
_EXPORT_LPA = _EXPORT + ", links AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), l0 AS (SELECT DISTINCT src AS node, src AS label FROM links)" + "".join(
    f", v{k} AS (SELECT k.src AS node, l.label, count(*) AS n FROM links k JOIN l{k} l ON l.node = k.dst GROUP BY 1, 2), l{k + 1} AS (SELECT node, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)" for k in range(2)
)


def _export(spark, d):
    rows = facts(spark, d).withColumn("subject", F.when(F.col("predicate") == "signup", F.concat(F.lit("decision:"), "subject")).otherwise(F.col("subject")))
    return op.graph_export(rows, now(), 2)


@register("graph_export_nodes", _EXPORT_LPA + ", dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1) SELECT node, degree, label AS community, count(*) OVER (PARTITION BY label) AS community_size FROM dg JOIN l2 USING (node)")
def _(spark, d):
    return _export(spark, d)[0]


@register("graph_export_edges", _EXPORT + " SELECT * FROM ed")
def _(spark, d):
    return _export(spark, d)[1]


@register("eval_category_stats", """WITH i AS (SELECT role AS category, contains(lower(text), 'e') AS any_hit, turn % 2 = 0 AS all_hit, turn > 0 AS scored, length(text) > 60 AS covered, length(text) // 4 AS delivered, length(text) AS baseline FROM conversations),
  g AS (SELECT category, count(*) AS n, count(*) FILTER (any_hit) AS n_any_hit, count(*) FILTER (all_hit) AS n_all_hit, count(*) FILTER (scored) AS n_scored, count(*) FILTER (scored AND covered) AS n_covered, sum(delivered)::BIGINT AS delivered, sum(baseline)::BIGINT AS baseline FROM i GROUP BY 1)
  SELECT *, round(100.0::DOUBLE * n_any_hit / n, 2) AS any_percent, round(100.0::DOUBLE * n_all_hit / n, 2) AS all_percent, CASE WHEN n_scored > 0 THEN round(100.0::DOUBLE * n_covered / n_scored, 2) ELSE 0 END AS covered_percent, CASE WHEN baseline > 0 THEN round((1 - delivered::DOUBLE / baseline) * 100, 2) ELSE 0 END AS saved_percent FROM g""")
def _(spark, d):
    t = table(spark, d, "conversations")
    size = F.length("text").cast("bigint")
    return op.category_stats(t.select(F.col("role").alias("category"), F.contains(F.lower("text"), F.lit("e")).alias("any_hit"), (F.col("turn") % 2 == 0).alias("all_hit"), (F.col("turn") > 0).alias("scored"), (size > 60).alias("covered"), F.floor(size / 4).alias("delivered"), size.alias("baseline")))


@register("source_issue_facts", """WITH i AS (SELECT o_orderkey AS number, '  order   ' || o_orderkey || ' of ' || o_custkey || ' ' AS title, o_orderstatus AS state, o_orderpriority AS label, 'c' || o_custkey AS author, 'board/' || (o_custkey % 3) AS source FROM orders)
  SELECT 'issue:' || number AS subject, 'IS_A' AS predicate, 'Issue' AS object, source FROM i UNION ALL SELECT 'issue:' || number, 'HAS_TITLE', 'order ' || number || ' of ' || author[2:], source FROM i UNION ALL SELECT 'issue:' || number, 'HAS_STATE', lower(state), source FROM i
  UNION ALL SELECT 'issue:' || number, 'OPENED_BY', author, source FROM i UNION ALL SELECT 'issue:' || number, 'HAS_LABEL', label, source FROM i""")
def _(spark, d):
    o = table(spark, d, "orders")
    title = F.concat(F.lit("  order   "), "o_orderkey", F.lit(" of "), "o_custkey", F.lit(" "))
    return op.issue_facts(o.select(F.col("o_orderkey").alias("number"), title.alias("title"), F.col("o_orderstatus").alias("state"), F.array("o_orderpriority").alias("labels"), F.concat(F.lit("c"), "o_custkey").alias("author"), F.concat(F.lit("board/"), F.col("o_custkey") % 3).alias("source")))


@register("source_episodes", r"""WITH g AS (SELECT 'git' AS kind, event_id::VARCHAR AS id, ts AS "at", event_type || ' by ' || user_id AS text FROM events UNION ALL SELECT 'doc', o_orderkey::VARCHAR, o_orderdate, o_orderpriority FROM orders UNION ALL SELECT 'graph', (l_orderkey * 10 + l_linenumber)::VARCHAR, l_shipdate, l_returnflag || ' ' || l_linestatus FROM lineitem)
  SELECT kind, id, "at", trim(text)[1:400] AS summary FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY "at" DESC, id) <= 50""")
def _(spark, d):
    e, o, li = (table(spark, d, t) for t in ("events", "orders", "lineitem"))
    return op.episodes(
        e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.concat_ws(" by ", "event_type", "user_id").alias("text")),
        o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_orderpriority").alias("text")),
        li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text")),
    )


# --- views, matching, keys, residues


_KIND = r"CASE WHEN regexp_matches(text, '^\s*[\[{]') THEN 'json' WHEN regexp_matches(text, '^\s*#{1,6}\s|\n\s*[-*]\s') THEN 'markdown' WHEN regexp_matches(text, '(?i)\b(?:error|warn|exception|traceback|failed|fatal)\b') AND len(string_split(text, chr(10))) > 4 THEN 'log' WHEN regexp_matches(text, '\b(?:import|export|function|class|const|let|fn|struct|impl)\b') THEN 'code' ELSE 'text' END"


@register("select_view_kinds", f"""WITH k AS (SELECT doc_id, {_KIND} AS kind, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
  c AS (SELECT *, len(l) AS n, CASE kind WHEN 'json' THEN 6 WHEN 'log' THEN 4 WHEN 'code' THEN 8 ELSE 6 END AS f, CASE kind WHEN 'json' THEN 6 WHEN 'log' THEN 6 ELSE 4 END AS b,
    CASE kind WHEN 'json' THEN '["{{}}\\[\\],:]' WHEN 'log' THEN '(?i)\\b(?:error|warn|exception|traceback|failed|fatal)\\b' WHEN 'code' THEN '^\\s*(?:import|export|class|function|const|let|fn|struct|impl)\\b' WHEN 'markdown' THEN '^\\s*(?:#{{1,6}}\\s|[-*]\\s)' ELSE '(?i)\\b(?:must|should|error|decision|policy|todo|fix|fail)\\b' END AS p FROM k),
  u AS (SELECT doc_id, kind, n, f, b, p, unnest(l) AS x, unnest(range(n)) AS i FROM c), s AS (SELECT * FROM u WHERE n <= 32 OR i < f OR regexp_matches(x, p) OR i >= greatest(f, n - b)),
  g AS (SELECT doc_id, kind, n, list(x ORDER BY i)[1:32] AS v FROM s GROUP BY 1, 2, 3)
  SELECT c.doc_id, c.kind, md5(CASE WHEN c.n = 0 THEN '' ELSE array_to_string(v, chr(10)) || CASE WHEN c.n > len(v) THEN chr(10) || '... ' || (c.n - len(v)) || ' lines omitted ...' ELSE '' END END) AS view FROM c LEFT JOIN g USING (doc_id)""")
def _(spark, d):
    rows = table(spark, d, "documents").where("text is not null").withColumn("kind", views.text_kind(F.col("text")))
    return rows.select("doc_id", "kind", F.md5(views.compact(F.col("text"), F.col("kind")).cast("binary")).alias("view"))


@register("fact_question", f"WITH {FACTS_SQL} SELECT fact_id FROM facts WHERE contains(lower(subject || ' ' || predicate || ' ' || object), 'purchases') OR contains(lower(subject || ' ' || predicate || ' ' || object), 'purchase') OR contains(lower(subject || ' ' || predicate || ' ' || object), 'user:77')")
def _(spark, d):
    return facts(spark, d).where(views.matches("What is the purchases of user:77?", F.col("subject"), F.col("predicate"), F.col("object"))).select("fact_id")


@register("text_token_estimates", "SELECT doc_id, greatest(1, ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4))::BIGINT AS utf16, octet_length(encode(text)) // 4 AS bytes FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", views.utf16_tokens(F.col("text")).alias("utf16"), views.byte_tokens(F.col("text")).alias("bytes"))


@register("rel_string_sort_key", "SELECT p_partkey, lpad(p_size::VARCHAR, 20, '0') AS size_key, coalesce(p_brand, '') AS brand_key FROM part ORDER BY size_key DESC, brand_key, p_partkey LIMIT 30")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", views.sort_key(F.col("p_size"), True).alias("size_key"), views.sort_key(F.col("p_brand")).alias("brand_key"))
    return rows.orderBy(F.col("size_key").desc(), "brand_key", "p_partkey").limit(30)


@register("event_pointed_values", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", views.pointed(F.col("props"), "/k").alias("k"), views.pointed(F.col("props"), "/a/0/b").alias("missing"))


@register("graph_endpoint_languages", _FILES + " SELECT 'javascript' AS language, 3 * count(*) AS n FROM ca JOIN f USING (path) WHERE u % 3 = 1 UNION ALL SELECT 'python', 3 * count(*) FROM ca JOIN f USING (path) WHERE u % 3 = 0 UNION ALL SELECT 'rust', 3 * count(*) FROM ca JOIN f USING (path) WHERE u % 3 = 2")
def _(spark, d):
    index = SymbolIndex(source_files(spark, d))
    e = index.calls.select("caller", "callee", "path", "to_path").distinct()
    return views.endpoint_languages(e.select(F.col("path").alias("src"), F.col("to_path").alias("dst"), F.col("path").alias("source")))


@register("record_key_conflicts", "SELECT source || '/' || lang AS conflict_key, count(DISTINCT n_chars // 500) AS n_values, count(*) AS n_records, min(doc_id) AS first FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1 HAVING count(DISTINCT n_chars // 500) > 1")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("conflict_key"), F.floor(F.col("n_chars") / 500).alias("value"), F.col("doc_id").alias("record"))
    return views.key_conflicts(rows)


@register("select_coverage", """WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 8)) AS e FROM conversations), w AS (SELECT conv_id, arg_min(e, turn) AS e FROM t GROUP BY 1),
  h AS (SELECT conv_id, list_distinct(flatten(list(e))) AS h FROM t WHERE role = 'assistant' GROUP BY 1)
  SELECT conv_id AS request, len(e)::INT AS n_wanted, len(list_intersect(e, coalesce(h, [])))::INT AS n_represented, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(coalesce(h, []), x))), ',') AS unresolved FROM w LEFT JOIN h USING (conv_id)""")
def _(spark, d):
    long = F.array_distinct(F.filter(fn.terms(F.col("text")), lambda x: F.length(x) >= 8))
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), "turn", "role", long.alias("entities"))
    return views.coverage(t.where("role = 'assistant'"), t.groupBy("request").agg(F.min_by("entities", "turn").alias("entities")))


@register("fact_lineage_residue", f"WITH {FACTS_SQL} SELECT fact_id, CASE WHEN fact_id % 7 = 0 THEN 'missing' ELSE 'rejected' END AS residue FROM facts WHERE status = 'active' AND (fact_id % 7 = 0 OR fact_id % 5 = 0) ORDER BY valid_from, fact_id LIMIT 50")
def _(spark, d):
    f = facts(spark, d)
    proposals = f.where("fact_id % 7 <> 0").select("fact_id", F.when(F.col("fact_id") % 5 == 0, "rejected").otherwise("approved").alias("status"))
    return views.lineage_residue(f, proposals)
