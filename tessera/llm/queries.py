"""The contract queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitplanes import read_token_files, write_token_files
from tessera.llm.common import documents
from tessera.llm.langid import fit_on_folds, held_out, identify
from tessera.llm.linedup import drop_repeated_lines
from tessera.llm.media import media_columns
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_jaccard_components
from tessera.llm.normsearch import hard_negatives
from tessera.llm.packing import pack_documents
from tessera.llm.pii import KINDS, find_personal_data, span_text
from tessera.llm.sharding import assign_shards
from tessera.llm.tiered import ranked_search
from tessera.llm.topk import top_k
from tessera.llm.toxicity import fit_toxicity, score_toxicity


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("rid", "ids")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_columns(documents(spark, sf_dir))
    pairs = F.array_join(F.transform("fingerprint", lambda p: F.concat_ws("@", p["code"], p["time"])), ",")
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.md5(pairs.cast("binary"))).alias("feature"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return score_toxicity(docs, machine).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op6_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir), [1.0] * 24, [1.0] * 25)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.array_sort(F.array_distinct(F.concat("base", "added")))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit_on_folds(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_norm_bucket_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_media_columns": op2_media_columns,
    "op3_mix_sources": op3_mix_sources,
    "op4_line_templates": op4_line_templates,
    "op5_toxicity_fm": op5_toxicity_fm,
    "op6_kd_tree_top_k": op6_kd_tree_top_k,
    "op7_rendezvous_sharding": op7_rendezvous_sharding,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_mixture": op10_language_mixture,
    "op11_tiered_search": op11_tiered_search,
    "op12_bit_planes": op12_bit_planes,
    "op13_norm_bucket_negatives": op13_norm_bucket_negatives,
}

_U = "((('0x' || substr(md5({}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

ORACLES = {
    "op3_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[^x]', '', 'g'))::BIGINT AS size,
         coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - (length(text) - length(regexp_replace(text, '[%*&$#@^~|<>=_{{}}\\[\\]\\\\!]', '', 'g')))::DOUBLE / greatest(length(text), 1)), 1.0::DOUBLE) AS weight
  FROM documents),
k AS (SELECT *, -ln({_U.format("'17:' || coalesce(doc_id::VARCHAR, '')")}) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT (SELECT level FROM l WHERE level <= most / w ORDER BY most / w, rank LIMIT 1) AS free),
t AS (SELECT source, source_size, CASE WHEN level > most / w THEN most ELSE least(most, w * free) END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, k.key, k.source, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
g AS (SELECT *, run <= rest AS taken_in, rest - coalesce(sum(CASE WHEN run <= rest THEN size END) OVER (PARTITION BY source), 0) AS gap FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY source, taken_in, size > 0 AND abs(size - gap) < gap ORDER BY abs(size - gap), key, doc_id) AS near FROM g)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN taken_in THEN 1 ELSE 0 END + CASE WHEN NOT taken_in AND size > 0 AND abs(size - gap) < gap AND near = 1 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
    "op4_line_templates": r"""
WITH l AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, text AS th, n, trim(regexp_replace(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM l),
k AS (SELECT *, string_split(t, ' ') AS w FROM m WHERE t <> ''),
x AS (SELECT *, len(w) >= 4 OR length(t) >= 24 AS able, (len(w) >= 4 OR length(t) >= 24) AND (len(w) >= 25 OR length(t) >= 150) AS long,
             len(w) || ' ' || array_to_string(w[1:least(6, len(w) // 2 + 1)], ' ') AS leaf, md5(array_to_string(w[1:3], ' ')) AS head, t IN (SELECT t FROM k GROUP BY t HAVING count(DISTINCT th) > 1) AS shared FROM k),
f AS (SELECT th, coalesce(min(substr(head, 1, 15)) FILTER (NOT shared), CASE WHEN count(DISTINCT t) = 1 THEN th END) AS f1,
             coalesce(min(substr(head, 16, 15)) FILTER (NOT shared), CASE WHEN count(DISTINCT t) = 1 THEN th END) AS f2 FROM x GROUP BY th),
held AS (SELECT DISTINCT th, t, w, leaf, long, shared, f1, f2 FROM x JOIN f USING (th) WHERE able),
first_t AS (SELECT t FROM held WHERE shared GROUP BY t HAVING least(count(DISTINCT f1), count(DISTINCT f2)) >= CASE WHEN bool_or(long) THEN 2 ELSE 3 END AND least(count(DISTINCT f1), count(DISTINCT f2)) * 5 >= count(DISTINCT th)),
leafy AS (SELECT leaf, t, w, long, count(*) AS texts FROM held WHERE leaf IN (SELECT leaf FROM held GROUP BY leaf HAVING count(DISTINCT t) > 1 AND count(DISTINCT th) > 1) GROUP BY ALL),
tok AS (SELECT leaf, t, long, texts, unnest(range(len(w))) AS pos, unnest(w) AS tok FROM leafy),
fixed AS (SELECT leaf, pos, tok FROM tok GROUP BY ALL HAVING sum(texts) >= CASE WHEN bool_or(long) THEN 2 ELSE 3 END),
pairs AS (SELECT t.leaf, t.t, t.pos, t.tok, x.tok IS NOT NULL AS kept FROM tok t LEFT JOIN fixed x ON x.leaf = t.leaf AND x.pos = t.pos AND x.tok = t.tok),
alike AS (SELECT t FROM pairs GROUP BY t HAVING count(*) FILTER (kept AND tok <> '<*>') >= count(*) * 0.7::DOUBLE),
marked AS (SELECT * FROM pairs WHERE t IN (SELECT t FROM alike)),
holes AS (SELECT DISTINCT leaf, pos FROM marked WHERE NOT kept),
shaped AS (SELECT t, leaf, count(*) FILTER (kept AND h.pos IS NULL AND tok <> '<*>') >= count(*) * 0.7::DOUBLE AS wide,
             string_agg(CASE WHEN kept AND h.pos IS NULL THEN tok ELSE '<*>' END, ' ' ORDER BY m.pos) AS g1, string_agg(CASE WHEN kept THEN tok ELSE '<*>' END, ' ' ORDER BY m.pos) AS g2
           FROM marked m LEFT JOIN holes h USING (leaf, pos) GROUP BY t, leaf),
general AS (SELECT t, leaf || '|' || CASE WHEN wide THEN g1 ELSE g2 END AS g FROM shaped),
again AS (SELECT g FROM held JOIN general USING (t) GROUP BY g HAVING least(count(DISTINCT f1), count(DISTINCT f2)) >= CASE WHEN bool_or(long) THEN 2 ELSE 3 END AND least(count(DISTINCT f1), count(DISTINCT f2)) * 5 >= count(DISTINCT th)),
wide_t AS (SELECT t, g FROM general WHERE g IN (SELECT g FROM again)),
groups AS (SELECT t, 'g' || g AS g FROM wide_t UNION ALL SELECT t, 't' || t FROM first_t WHERE t NOT IN (SELECT t FROM wide_t)),
found AS (SELECT doc_id, n, g FROM x JOIN groups USING (t) WHERE able),
gone AS (SELECT DISTINCT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, n) AS place FROM found) WHERE place > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept.text FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op6_kd_tree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_rendezvous_sharding": """
WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text,'') AS text FROM documents),
b AS (SELECT doc_id, octet_length(encode(text)) + 8 AS size,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
      FROM d, crc_table),
u AS (SELECT doc_id, j, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS draw FROM d, range(25) r(j)),
p AS (SELECT doc_id, arg_min(j, draw) FILTER (j < 24) AS shard, arg_min(j, draw) AS grown FROM u GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown::INT AS grown_shard
FROM b JOIN p USING (doc_id)""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
         ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM reach r JOIN both_ways k ON r.b = k.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op11_tiered_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT row_number() OVER () AS rid, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT rid, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(t) AS t FROM s) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * nd + 2.0::DOUBLE) / (2.0::DOUBLE * df + 1.0::DOUBLE)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
i AS (SELECT p.t, rid, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS impact FROM p JOIN w USING (t), c),
r AS (SELECT item_id, rid, doc_id, sum(impact)::BIGINT AS score FROM i JOIN q USING (t) GROUP BY ALL HAVING sum(impact) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS rank FROM r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50""",
    "op13_norm_bucket_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score FROM e a JOIN e c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
