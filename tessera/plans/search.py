"""Queries over texts: scalar functions, ranking, fusion, similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import search as op
from tessera.plans.bindings import FACTS_SQL, facts, table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


Q = ("and", "the", "ation", "queeux")
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_T = _TERMS.format("text")


@register("text_normalised", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower(fn.collapse(F.col("text"))).cast("binary")).alias("digest"), fn.token_estimate(F.col("text")).alias("tokens"))


@register("text_identifier_parts", """WITH n AS (SELECT p_partkey, 'get' || replace(p_name, ' ', '') || upper(substr(p_brand, 1, 3)) || 'Value' || p_size AS name FROM part),
  s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g') AS t FROM n),
  p AS (SELECT p_partkey, list_prepend(lower(name), regexp_extract_all(lower(t), '[a-z0-9]+')) AS l FROM s)
  SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: {'v': l[i], 'f': list_position(l, l[i]) = i}), lambda x: x.f), lambda x: x.v), ' ') AS parts FROM p""")
def _(spark, d):
    name = F.concat(F.lit("get"), F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.upper(F.substring("p_brand", 1, 3)), F.lit("Value"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.array_join(fn.identifier_parts(name), " ").alias("parts"))


@register("text_path_language", """SELECT lang, count(*) AS n FROM (SELECT CASE lower(regexp_extract('src/m' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' WHEN 3 THEN '.xyz' ELSE '' END, '\\.([A-Za-z]+)$', 1))
  WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' ELSE 'other' END AS lang FROM documents) GROUP BY 1""")
def _(spark, d):
    path = F.concat(F.lit("src/m"), F.col("doc_id"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".rs", ".xyz", "")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, d, "documents").groupBy(fn.language_of(path).alias("lang")).agg(F.count("*").alias("n"))


@register("text_canonical_digest", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS digest FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.canonical_digest("c_name", "c_custkey", "c_mktsegment").alias("digest"))


@register("page_visible_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis') AS t FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<!\[CDATA\[(.*?)\]\]>', '\1', 'gs'), '<[^>]*>', ' ', 'g') AS t FROM a),
  c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' ') AS t FROM b)
  SELECT page_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest FROM c""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(fn.decode_markup(F.col("html")).cast("binary")).alias("digest"))


@register("text_redacted", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(password|token|secret)(\s*=\s*)\S+', '\1\2[redacted]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '[email]', 'g'), '/(home|Users)/[A-Za-z0-9._-]+', '/[home]', 'g')) AS digest FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fn.redact(F.col("text")).cast("binary")).alias("digest"))


@register("page_locators", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[#?].*$', '') AS path FROM pages) SELECT page_id, path, array_to_string(string_split(path, '/')[-2:], '/') AS ref FROM p WHERE contains(path, '/')""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fn.locator_parts(F.col("url")).alias("l")).select("page_id", "l.path", "l.ref").where(F.contains("path", F.lit("/")))


@register("text_levenshtein", "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INT AS distance, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 4) AS ratio FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, d):
    a, b = table(spark, d, "part").alias("a"), table(spark, d, "part").alias("b")
    dist = F.levenshtein("a.p_name", "b.p_name")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(
        F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), dist.alias("distance"), F.round(1 - dist / F.greatest(F.length("a.p_name"), F.length("b.p_name")), 4).alias("ratio")
    )


@register("text_minhash", """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
  SELECT item_id, array_to_string(list_transform(range(8), lambda i: list_min(list_transform(w, lambda x: substr(md5(i || ':' || x), 1, 16)))), ',') AS signature FROM t WHERE len(w) > 0""")
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.array_distinct(fn.terms(F.col("text"))).alias("w")).where(F.size("w") > 0)
    return rows.select("item_id", F.array_join(fn.minhash(F.col("w"), 8), ",").alias("signature"))


@register("search_postings", f"WITH w AS MATERIALIZED (SELECT doc_id, {_T} AS w FROM documents), r AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) SELECT doc_id, term, count(*) AS tf, max(len)::INT AS len FROM r GROUP BY 1, 2")
def _(spark, d):
    return op.postings(table(spark, d, "documents"))


def _bm25_sql(term: str, keep: str) -> str:
    return f"""w AS (SELECT doc_id, {_T} AS w FROM documents), s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM w),
  r AS (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM w), k AS (SELECT doc_id, len, {term} AS term FROM r WHERE {keep}),
  tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM k GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  bm AS (SELECT doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY 1)"""


_EXACT = _bm25_sql("t", f"t IN {Q}")


@register("search_bm25", f"WITH {_EXACT} SELECT doc_id, score FROM bm")
def _(spark, d):
    return op.bm25(table(spark, d, "documents"), Q)


@register("search_bm25_prefix_top", "WITH " + _bm25_sql("CASE WHEN starts_with(t, 'lich') THEN 'lich' ELSE 'zube' END", "starts_with(t, 'lich') OR starts_with(t, 'zube')") + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 25")
def _(spark, d):
    return op.bm25(table(spark, d, "documents"), ("lich", "zube"), prefix=True).orderBy(F.col("score").desc(), "doc_id").limit(25)


_TFIDF = """p AS (SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {t}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  w AS (SELECT {k}, term, round(sqrt(tf) * (log2(1 + (SELECT count(*) FROM {t}) / df) + 0.5), 6) AS weight FROM p JOIN df USING (term))"""


@register("search_tf_idf", "WITH " + _TFIDF.format(k="item_id", t="benchmark") + " SELECT item_id, term, weight FROM w")
def _(spark, d):
    return op.tf_idf(table(spark, d, "benchmark"), "item_id")


@register("search_tf_idf_cosine", "WITH " + _TFIDF.format(k="item_id", t="benchmark") + """, n AS (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY 1)
  SELECT a, b, round(dot / (x.n * y.n), 6) AS cosine FROM (SELECT l.item_id AS a, r.item_id AS b, sum(l.weight * r.weight) AS dot FROM w l JOIN w r USING (term) WHERE l.item_id < r.item_id GROUP BY 1, 2) JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b""")
def _(spark, d):
    w = op.tf_idf(table(spark, d, "benchmark"), "item_id")
    return op.sparse_cosine(w.withColumnRenamed("item_id", "a"), w.withColumnRenamed("item_id", "b"), "a", "b").where("a < b")


_OVERLAP = """qo AS (SELECT list_distinct(['the', 'and', 'eron', 'thing']) AS q), ro AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
  o AS (SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(q, w)) / sqrt((len(q) * len(w))::DOUBLE) END, 6) AS score FROM ro, qo)"""


@register("search_lexical_overlap", f"WITH {_OVERLAP} SELECT doc_id, score FROM o WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40")
def _(spark, d):
    q = F.array(*[F.lit(x) for x in ("the", "and", "eron", "thing")])
    scored = table(spark, d, "documents").select("doc_id", F.round(fn.overlap(q, F.array_distinct(fn.terms(F.col("text")))), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(40)


_HITS = f"""{_EXACT}, {_OVERLAP},
  hits AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 'bm25' AS source_kind FROM bm QUALIFY rank <= 100
    UNION ALL SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 'overlap' FROM o WHERE score > 0 QUALIFY rank <= 100)"""


def _hits(spark, d):
    docs = table(spark, d, "documents")
    q = F.array(*[F.lit(x) for x in ("the", "and", "eron", "thing")])
    over = docs.select("doc_id", F.round(fn.overlap(q, F.array_distinct(fn.terms(F.col("text")))), 6).alias("score")).where("score > 0")
    return op.ranks(op.bm25(docs, Q), "bm25", 100).unionByName(op.ranks(over, "overlap", 100))


@register("search_rrf", f"WITH {_HITS} SELECT doc_id, round(sum(CASE source_kind WHEN 'bm25' THEN 1.0 ELSE 0.7 END::DOUBLE / (60 + rank)), 6) AS score FROM hits GROUP BY 1")
def _(spark, d):
    return op.reciprocal_rank_fusion(_hits(spark, d), {"bm25": 1.0, "overlap": 0.7})


@register("search_merged_candidates", f"WITH {_HITS} SELECT doc_id, min(rank)::INT AS best_rank, max(score) AS best_score, count(*) AS n_hits, string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS sources FROM hits GROUP BY 1")
def _(spark, d):
    return op.merge_candidates(_hits(spark, d))


@register("search_omission_manifest", f"WITH {_HITS}, m AS (SELECT doc_id, min(rank) AS r FROM hits GROUP BY 1) SELECT d.doc_id, CASE WHEN m.r <= 20 THEN 'selected' WHEN m.r IS NOT NULL THEN 'budget_pressure' ELSE 'lower_relevance' END AS state FROM documents d LEFT JOIN m USING (doc_id)")
def _(spark, d):
    best = _hits(spark, d).groupBy("doc_id").agg(F.min("rank").alias("r"))
    state = F.when(F.col("r") <= 20, "selected").when(F.col("r").isNotNull(), "budget_pressure").otherwise("lower_relevance")
    return table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", state.alias("state"))


@register("search_hybrid_truth", f"""WITH {FACTS_SQL}, c AS (SELECT fact_id, lower(subject || ' ' || predicate || ' ' || object) AS t, valid_from FROM facts WHERE status = 'active'),
  k AS (SELECT *, CASE WHEN contains(t, 'purchase') THEN 1.0 / row_number() OVER (PARTITION BY contains(t, 'purchase') ORDER BY valid_from DESC, fact_id) ELSE 0.0 END AS kw FROM c),
  s AS (SELECT fact_id, kw, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM k)
  SELECT fact_id, round(0.72 * round(len(list_intersect(w, ['purchase', 'k7', 'user'])) / sqrt((3 * len(w))::DOUBLE), 6) + 0.23 * kw + 0.03, 6) AS score FROM s ORDER BY score DESC, fact_id LIMIT 50""")
def _(spark, d):
    c = facts(spark, d).where("status = 'active'").select("fact_id", "valid_from", F.lower(F.concat_ws(" ", "subject", "predicate", "object")).alias("t"))
    hit = F.contains("t", F.lit("purchase"))
    kw = F.when(hit, 1.0 / F.row_number().over(Window.partitionBy(F.contains("t", F.lit("purchase"))).orderBy(F.col("valid_from").desc(), "fact_id"))).otherwise(0.0)
    q = F.array(*[F.lit(x) for x in ("purchase", "k7", "user")])
    sem = F.round(fn.overlap(q, F.array_distinct(fn.terms(F.col("t")))), 6)
    return c.select("fact_id", op.boosted(sem, kw, F.lit(0.03)).alias("score")).orderBy(F.col("score").desc(), "fact_id").limit(50)


@register("search_grep_records", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'clown') AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 100")
def _(spark, d):
    words = F.array(F.lit("clown"), F.lit("the"))
    return table(spark, d, "documents").where((F.col("lang") == "en") & F.forall(words, lambda w: F.contains(F.lower("text"), w))).orderBy("doc_id").limit(100).select("doc_id", "source")


@register("search_snippets", f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM l),
  h AS (SELECT *, len(list_intersect(['idiot', 'clown', 'moron'], list_distinct({_TERMS.format("lines[pos + 1]")}))) AS hits FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS r FROM h WHERE hits > 0),
  s AS (SELECT doc_id, pos, hits, r, array_to_string(lines[greatest(1, pos - 1):pos + 3], chr(10)) AS snippet FROM b WHERE r <= 3), t AS (SELECT *, greatest(1, ceil(length(snippet) / 4))::BIGINT AS tokens FROM s)
  SELECT doc_id, pos::INT AS pos, hits::INT AS hits, tokens, snippet FROM (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS run FROM t) WHERE run <= 400""")
def _(spark, d):
    return op.snippets(table(spark, d, "documents"), ("idiot", "clown", "moron"))


@register("vector_cosine_top_k", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 10""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return op.dense_cosine_top_k(v, v.where("vec_id % 100 = 0"), 10)


@register("answer_coverage", f"""WITH t AS (SELECT a.conv_id, a.turn, a.text, list_distinct({_TERMS.format("a.text")}) AS d, b.text AS answer, list_distinct(list_filter({_TERMS.format("b.text")}, lambda t: length(t) >= 3)) AS w FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
  SELECT conv_id, turn, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(answer, '\\s+', ' ', 'g')))) OR (len(w) > 0 AND len(list_intersect(w, d)) >= CASE WHEN len(w) <= 2 THEN len(w) ELSE ceil(len(w) * 0.67) END) AS covered FROM t""")
def _(spark, d):
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", fn.answer_covered(F.col("text"), F.col("answer")).alias("covered"))


@register("search_random_index", f"""WITH t AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY 1, 2), h AS (SELECT item_id, tf, unnest(list_transform(range(8), lambda j: ('0x' || substr(sha256(term), (j * 4 + 1)::INT, 4))::BIGINT)) AS h FROM t),
  s AS (SELECT item_id, (h % 256)::INT AS dim, sum(tf * CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY 1, 2 HAVING s <> 0), n AS (SELECT item_id, sqrt(sum(s * s)::DOUBLE) AS norm FROM s GROUP BY 1) SELECT item_id, dim, round(s / norm, 6) AS weight FROM s JOIN n USING (item_id)""")
def _(spark, d):
    return op.random_index(table(spark, d, "benchmark"), "item_id")
