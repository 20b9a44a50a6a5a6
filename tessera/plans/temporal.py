"""Queries over temporal facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import temporal as op
from tessera.plans.bindings import FACTS_SQL, RAW_FACTS_SQL, facts, raw_facts, table

T1, NOW = "2024-01-15 00:00:00", "2024-01-31 00:00:00"


def ts(x: str):
    return F.to_timestamp(F.lit(x))


_W = f"WITH {FACTS_SQL} "
_VALID = "valid_from <= TIMESTAMP '{0}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{0}')"
_CURRENT = f"status = 'active' AND superseded_by IS NULL AND {_VALID.format(NOW)}"

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


@register("fact_current_by_predicate", _W + f"SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects FROM facts WHERE {_CURRENT} GROUP BY 1")
def _(spark, d):
    return op.current_truth(facts(spark, d), ts(NOW)).groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@register("fact_versions", _W + "SELECT fact_id, subject, predicate, object, valid_from, valid_until, superseded_by, status FROM facts")
def _(spark, d):
    return facts(spark, d).select("fact_id", "subject", "predicate", "object", "valid_from", "valid_until", "superseded_by", "status")


@register("fact_as_of", _W + f"SELECT fact_id, subject, predicate, object, valid_from FROM facts WHERE status IN ('active', 'superseded') AND {_VALID.format(T1)}")
def _(spark, d):
    return op.as_of(facts(spark, d), ts(T1)).select("fact_id", "subject", "predicate", "object", "valid_from")


@register("fact_graph_edges_as_of", _W + f"SELECT fact_id, subject AS src, predicate, object AS dst FROM facts WHERE {_VALID.format(T1)} AND (superseded_by IS NULL OR valid_until > TIMESTAMP '{T1}')")
def _(spark, d):
    return op.edges_as_of(facts(spark, d), ts(T1)).select("fact_id", F.col("subject").alias("src"), "predicate", F.col("object").alias("dst"))


@register("fact_latest_values", f"WITH {RAW_FACTS_SQL} SELECT subject, predicate, object, valid_from, fact_id FROM raw_facts QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, fact_id DESC) = 1")
def _(spark, d):
    return op.latest_values(raw_facts(spark, d))


@register("fact_history", f"WITH {RAW_FACTS_SQL} SELECT fact_id, object, valid_from FROM raw_facts WHERE subject = 'user:7' AND predicate = 'click' ORDER BY valid_from DESC, fact_id LIMIT 50")
def _(spark, d):
    return op.history(raw_facts(spark, d), "user:7", "click").select("fact_id", "object", "valid_from")


@register("fact_change_feed", _W + f"SELECT fact_id, subject, predicate, object, CASE WHEN {_CURRENT} THEN 'd' ELSE 'r' END AS op, TIMESTAMP '{NOW}' AS cursor FROM (SELECT f.*, greatest(coalesce(f.updated_at, f.valid_from), coalesce(n.updated_at, n.valid_from)) AS moved FROM facts f LEFT JOIN raw_facts n ON n.fact_id = f.superseded_by) WHERE moved > TIMESTAMP '2024-01-25 00:00:00'")
def _(spark, d):
    return op.change_feed(facts(spark, d), ts("2024-01-25 00:00:00"), ts(NOW))


@register("fact_changed_since", f"WITH {RAW_FACTS_SQL} SELECT source, count(*) AS n, max(updated_at) AS last_change FROM raw_facts WHERE coalesce(updated_at, valid_from) > TIMESTAMP '{T1}' GROUP BY 1")
def _(spark, d):
    return raw_facts(spark, d).where(op.changed_at() > ts(T1)).groupBy("source").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_change"))


@register("fact_conflicts", f"WITH {RAW_FACTS_SQL} SELECT subject, predicate, count(DISTINCT object)::INT AS n_objects, count(*) AS members, string_agg(DISTINCT object, '|' ORDER BY object) AS objects FROM raw_facts GROUP BY 1, 2 HAVING count(DISTINCT object) > 1")
def _(spark, d):
    return op.conflicts(raw_facts(spark, d))


@register("fact_duplicates", f"WITH {RAW_FACTS_SQL} SELECT subject, predicate, object, count(*) AS n, min(fact_id) AS keep FROM raw_facts GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(spark, d):
    return op.duplicates(raw_facts(spark, d))


_SUPER = f"""WITH {RAW_FACTS_SQL}, r AS (SELECT *, row_number() OVER w AS r, first_value(fact_id) OVER w AS by_id,
  min(object) OVER (PARTITION BY subject, predicate) < max(object) OVER (PARTITION BY subject, predicate) AS differ
  FROM raw_facts WINDOW w AS (PARTITION BY subject, predicate ORDER BY valid_from DESC, fact_id DESC))"""


@register("fact_supersession_candidates", _SUPER + " SELECT fact_id, subject, predicate, by_id AS superseded_by, r::INT AS age_rank FROM r WHERE differ AND r > 1")
def _(spark, d):
    return op.supersession_candidates(raw_facts(spark, d))


@register("fact_stale_low_confidence", f"WITH {RAW_FACTS_SQL} SELECT fact_id, subject, confidence FROM raw_facts WHERE valid_from < TIMESTAMP '{T1}' AND confidence < 10 ORDER BY confidence, fact_id LIMIT 50")
def _(spark, d):
    return raw_facts(spark, d).where((F.col("valid_from") < ts(T1)) & (F.col("confidence") < 10)).orderBy("confidence", "fact_id").limit(50).select("fact_id", "subject", "confidence")


@register("fact_refine_plan", _SUPER + """, c AS (SELECT fact_id, 2 AS rank FROM r WHERE differ AND r > 1 UNION ALL
  SELECT fact_id, 1 FROM (SELECT fact_id, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY fact_id) AS k FROM raw_facts) WHERE k > 1),
 f AS (SELECT fact_id, min(rank) AS rank FROM c GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY rank, fact_id) AS step FROM f)
 SELECT fact_id, rank::INT AS rank, step::INT AS step, (5000 - step)::INT AS "left" FROM s WHERE 5000 - step >= 4000""")
def _(spark, d):
    raw = raw_facts(spark, d)
    again = raw.withColumn("k", F.row_number().over(Window.partitionBy("subject", "predicate", "object").orderBy("fact_id"))).where("k > 1").select("fact_id", F.lit(1).alias("rank"))
    return op.refine_plan(op.supersession_candidates(raw).select("fact_id", F.lit(2).alias("rank")).unionByName(again), 5000, 4000)


@register("fact_retired_anti_join", f"""WITH {RAW_FACTS_SQL}, now_extracted AS (SELECT * FROM raw_facts WHERE valid_from >= TIMESTAMP '{T1}')
  SELECT fact_id, 'retired_' || substr(sha256(subject || '|' || predicate || '|' || object || '|' || source), 1, 12) AS closing_object FROM raw_facts a
  WHERE NOT EXISTS (SELECT 1 FROM now_extracted e WHERE e.subject = a.subject AND e.predicate = a.predicate AND e.object = a.object AND e.source = a.source)""")
def _(spark, d):
    raw = raw_facts(spark, d)
    return op.retired(raw, raw.where(F.col("valid_from") >= ts(T1))).select("fact_id", "closing_object")


@register("source_changes", f"""WITH {RAW_FACTS_SQL}, h AS (SELECT subject AS source, valid_from < TIMESTAMP '2024-01-02 00:00:00' AS early, sum(('0x' || substr(md5(predicate || object || fact_id), 1, 12))::BIGINT)::BIGINT AS hash FROM raw_facts
    WHERE valid_from < TIMESTAMP '2024-01-02 00:00:00' OR valid_from >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2), b AS (SELECT * FROM h WHERE early), a AS (SELECT * FROM h WHERE NOT early)
  SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.source = b.source""")
def _(spark, d):
    rows = raw_facts(spark, d).withColumnRenamed("source", "feed").withColumnRenamed("subject", "source")
    # a sum of row digests: it does not depend on order and is summed before the exchange
    digest = F.sum(F.conv(F.substring(F.md5(F.concat("predicate", "object", "fact_id").cast("binary")), 1, 12), 16, 10).cast("bigint")).alias("hash")
    before, after = rows.where(F.col("valid_from") < ts("2024-01-02 00:00:00")), rows.where(F.col("valid_from") >= ts("2024-01-30 00:00:00"))
    return op.source_changes(before.groupBy("source").agg(digest), after.groupBy("source").agg(digest))


@register("fact_batch_dedupe", f"WITH {RAW_FACTS_SQL} SELECT subject, predicate, object, min(fact_id) AS fact_id, count(*) - 1 AS repeats FROM raw_facts GROUP BY 1, 2, 3")
def _(spark, d):
    return op.first_of_batch(raw_facts(spark, d), ["subject", "predicate", "object"], "fact_id").select("subject", "predicate", "object", "fact_id", "repeats")


_LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@register("fact_batch_rejections", f"""WITH {_LINES_SQL}, f AS (SELECT doc_id, string_split(line, ' ') AS w, line FROM lines WHERE length(line) > 0), g AS (SELECT coalesce(w[1], '') AS s, coalesce(w[2], '') AS p, line AS o FROM f)
  SELECT CASE WHEN NOT regexp_matches(s, '^[A-Za-z0-9:_-]{{1,128}}$') THEN 'subject' WHEN NOT regexp_matches(p, '^[A-Za-z0-9:_-]{{1,128}}$') THEN 'predicate' WHEN length(o) > 240 THEN 'object_too_long'
  WHEN regexp_matches(o, '(?i)(password\\s*=|token\\s*=|secret\\s*=|AKIA[0-9A-Z]{{12,}}|-----BEGIN)') THEN 'secret' ELSE 'accepted' END AS reason, count(*) AS n FROM g GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("object")).where("length(object) > 0")
    w = F.split("object", " ")
    rows = lines.select("object", F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")).alias("subject"), F.coalesce(F.try_element_at(w, F.lit(2)), F.lit("")).alias("predicate"))
    return rows.groupBy(F.coalesce(op.rejection(), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@register("fact_as_of_join", _W + """SELECT o.event_id AS probe_id, f.fact_id, f.object FROM events o JOIN facts f ON f.subject = 'user:' || o.user_id AND f.predicate = 'view'
  AND f.valid_from <= o.ts AND (f.valid_until IS NULL OR f.valid_until > o.ts) WHERE o.event_type = 'purchase'""")
def _(spark, d):
    probes = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("probe_id"), F.concat(F.lit("user:"), F.col("user_id")).alias("subject"), F.lit("view").alias("predicate"), F.col("ts").alias("at"))
    return op.as_of_join(probes, facts(spark, d)).select("probe_id", "fact_id", "object")


@register("fact_lifecycle_fold", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS transitions FROM events GROUP BY 1")
def _(spark, d):
    return op.lifecycle(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@register("memory_write_gate", """WITH r AS (SELECT d.doc_id, d.source, l.quality, regexp_matches(text, '(?i)(password\\s*=|token\\s*=|secret\\s*=|AKIA[0-9A-Z]{12,}|-----BEGIN)') AS secret,
   row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY d.doc_id) > 1 AS dup, min(d.lang) OVER (PARTITION BY d.source) < max(d.lang) OVER (PARTITION BY d.source) AND d.lang <> 'en' AS conflict
   FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))
  SELECT doc_id, CASE WHEN secret THEN 'reject' WHEN dup THEN 'reject' WHEN conflict OR coalesce(quality, 0.6) < 0.5 OR source IN ('policy', 'constraint') THEN 'review' ELSE 'propose' END AS decision FROM r""")
def _(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    same, src = Window.partitionBy(F.sha2(F.lower(F.trim("text")), 256)).orderBy("doc_id"), Window.partitionBy("source")
    conflict = (F.min("lang").over(src) < F.max("lang").over(src)) & (F.col("lang") != "en")
    decision = op.write_gate(F.col("source"), F.coalesce(F.col("quality").cast("double"), F.lit(0.6)), F.col("text").rlike(op.SECRET), F.row_number().over(same) > 1, conflict)
    return docs.select("doc_id", decision.alias("decision"))


@register("conversation_consolidation", f"""WITH {RAW_FACTS_SQL}, a AS (SELECT * FROM raw_facts WHERE valid_from < TIMESTAMP '{T1}'),
  h AS (SELECT subject, predicate, arg_max(object, (valid_from, fact_id)) AS held FROM a GROUP BY 1, 2), c AS (SELECT fact_id, subject, predicate, CASE WHEN predicate = 'error' THEN NULL ELSE object END AS object FROM raw_facts WHERE valid_from >= TIMESTAMP '{T1}')
  SELECT c.fact_id, CASE WHEN held IS NULL AND object IS NULL THEN 'NOOP' WHEN held IS NULL THEN 'ADD' WHEN object IS NULL THEN 'DELETE' WHEN object = held THEN 'NOOP' ELSE 'UPDATE' END AS op FROM c LEFT JOIN h USING (subject, predicate)""")
def _(spark, d):
    raw = raw_facts(spark, d)
    new = raw.where(F.col("valid_from") >= ts(T1)).withColumn("object", F.when(F.col("predicate") == "error", None).otherwise(F.col("object")))
    return op.consolidate(new.select("fact_id", "subject", "predicate", "object"), raw.where(F.col("valid_from") < ts(T1))).select("fact_id", "op")


@register("fact_provenance_why", _W + f""", ep AS (SELECT DISTINCT source, 'ep-' || source AS episode FROM facts), pr AS (SELECT fact_id, 'p' || fact_id AS proposal FROM facts WHERE predicate <> 'view')
  SELECT f.fact_id, ep.episode, pr.proposal, o.fact_id AS supersedes, f.superseded_by, ({_VALID.format(T1)}) AS valid FROM facts f LEFT JOIN ep USING (source) LEFT JOIN pr ON pr.fact_id = f.fact_id LEFT JOIN (SELECT fact_id, superseded_by AS s FROM facts) o ON o.s = f.fact_id""".replace("valid_from <=", "f.valid_from <=").replace("(valid_until IS", "(f.valid_until IS").replace("OR valid_until >", "OR f.valid_until >"))
def _(spark, d):
    f = facts(spark, d).withColumn("episode_id", F.col("source"))
    episodes = raw_facts(spark, d).select(F.col("source").alias("episode_id"), F.concat(F.lit("ep-"), "source").alias("episode")).distinct()
    proposals = raw_facts(spark, d).where("predicate <> 'view'").select("fact_id", F.concat(F.lit("p"), "fact_id").alias("proposal"))
    return op.why(f, episodes, proposals, ts(T1)).select("fact_id", "episode", "proposal", "supersedes", "superseded_by", "valid")


@register("run_event_sequence", "SELECT event_id, user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).cast("bigint").alias("sequence"))


@register("fact_integrity_counts", _W + "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (valid_until < valid_from) AS broken, count(DISTINCT fact_id) AS ids FROM facts")
def _(spark, d):
    return facts(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("valid_until") < F.col("valid_from")).alias("broken"), F.count_distinct("fact_id").alias("ids"))
