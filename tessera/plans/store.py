"""Queries over stored tables: merges in batches, refreshes by source, deliveries to readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.bindings import RAW_FACTS_SQL, raw_facts
from tessera.sources.facttable import HASH, FactTable, Readers
from tessera.sources.shared import scratch_folder

QUERIES, ORACLES = {}, {}
#: Statements come in three batches, by when they were recorded; some begin before others that came earlier.
CUTS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _batches(spark, d):
    rows = raw_facts(spark, d).withColumn("closes", F.lit("*")).withColumnRenamed("updated_at", "recorded_at")
    a, b = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    at = F.col("recorded_at").cast("timestamp_ntz")
    return [rows.where(at < a), rows.where((at >= a) & (at < b)), rows.where(at >= b)]


#: Every fact with the statement that closes it, as of each batch: a rebuild from all statements so far.
_STATES = f"""WITH {RAW_FACTS_SQL},
  st AS (SELECT *, CASE WHEN updated_at < TIMESTAMP '{CUTS[0]}' THEN 1 WHEN updated_at < TIMESTAMP '{CUTS[1]}' THEN 2 ELSE 3 END AS batch FROM raw_facts QUALIFY row_number() OVER (PARTITION BY subject, predicate, object, valid_from, source ORDER BY batch, fact_id) = 1),
  cl AS (SELECT k, f.fact_id, f.batch, min(CASE WHEN n.fact_id IS NOT NULL THEN {{'t': n.valid_from, 'i': n.fact_id}} END) AS c
         FROM (VALUES (1), (2), (3)) v(k) JOIN st f ON f.batch <= k LEFT JOIN st n ON n.subject = f.subject AND n.predicate = f.predicate AND n.batch <= k AND n.object <> f.object
           AND (n.valid_from > f.valid_from OR (n.valid_from = f.valid_from AND n.fact_id > f.fact_id)) GROUP BY ALL)"""


@register("store_merged_versions", _STATES + " SELECT f.fact_id, subject, predicate, object, valid_from, c.t AS valid_until, c.i AS superseded_by, CASE WHEN c IS NULL THEN 'active' ELSE 'superseded' END AS status FROM st f JOIN cl ON cl.fact_id = f.fact_id AND k = 3")
def _(spark, d):
    table = FactTable.create(spark, scratch_folder(spark, "facts"), buckets=8)
    for batch in _batches(spark, d):
        table.merge(batch)
        again = table.merge(batch)
        assert again["added"] == again["rewritten"] == 0
    return table.read().select("fact_id", "subject", "predicate", "object", "valid_from", "valid_until", "superseded_by", "status")


@register("store_change_feed", _STATES + """ SELECT n.fact_id, CASE WHEN n.c IS NULL THEN 'd' ELSE 'r' END AS op FROM cl n LEFT JOIN cl o ON o.fact_id = n.fact_id AND o.k = 1
  WHERE n.k = 3 AND (o.fact_id IS NULL OR o.c IS DISTINCT FROM n.c)""")
def _(spark, d):
    table = FactTable.create(spark, scratch_folder(spark, "facts"), buckets=8)
    first, *rest = _batches(spark, d)
    known = table.merge(first)["version"]
    for batch in rest:
        table.merge(batch)
    return table.changes(known).select("fact_id", "op")


@register("store_deliveries", _STATES + """, ch AS (SELECT n.k - 1 AS delivery, n.c FROM cl n LEFT JOIN cl o ON o.fact_id = n.fact_id AND o.k = n.k - 1 WHERE o.fact_id IS NULL OR o.c IS DISTINCT FROM n.c)
  SELECT delivery, CASE WHEN c IS NULL THEN 'd' ELSE 'r' END AS op, count(*) AS n FROM ch GROUP BY ALL""")
def _(spark, d):
    table = FactTable.create(spark, scratch_folder(spark, "facts"), buckets=8)
    readers, out = Readers(table, scratch_folder(spark, "readers")), None
    reader = Readers.name("workspace", "recall", "client", "workspace")
    for batch in _batches(spark, d):
        table.merge(batch)
        begun = readers.next(reader)  # a reader that stops before it commits: the delivery stays due
        with readers.delivery(reader) as (number, rows):
            assert number == begun[0]
            got = rows.groupBy("op").agg(F.count("*").alias("n")).select(F.lit(number).alias("delivery"), "op", "n")
            out = got if out is None else out.unionByName(got)
        assert readers.next(reader) is None
    return out


@register("store_refresh", f"""WITH {RAW_FACTS_SQL}, a AS (SELECT DISTINCT subject, predicate, object FROM raw_facts WHERE valid_from < TIMESTAMP '{CUTS[1]}'), b AS (SELECT DISTINCT subject, predicate, object FROM raw_facts WHERE valid_from >= TIMESTAMP '{CUTS[0]}')
  SELECT subject, predicate, object, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.subject = a.subject AND b.predicate = a.predicate AND b.object = a.object) THEN 'active' ELSE 'superseded' END AS status FROM a
  UNION ALL SELECT subject, predicate, object, 'active' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
  UNION ALL SELECT subject, predicate, 'retired_' || substr(sha256(subject || '|' || predicate || '|' || object || '|' || subject), 1, 12), 'active' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(spark, d):
    """A user is a source, its kinds of event with their k what it states: before one day, then from another on."""
    table = FactTable.create(spark, scratch_folder(spark, "facts"), buckets=8, fact_id="string")
    raw = raw_facts(spark, d)

    def files(rows):
        said = F.sort_array(F.collect_set(F.struct("predicate", "object")))
        return rows.groupBy(F.col("subject").alias("source")).agg(said.alias("said")).withColumn("hash", F.sha2(F.to_json("said"), 256))

    extract = lambda f: f.select(F.col("source").alias("subject"), F.inline("said"), "source")
    next_id = lambda f: f.withColumn("fact_id", F.sha2(F.to_json(F.struct("subject", "predicate", "object", "closes", "source", "valid_from")), 256))
    day = F.col("valid_from").cast("timestamp_ntz")
    for rows, now in ((raw.where(day < F.lit(CUTS[1]).cast("timestamp_ntz")), CUTS[0]), (raw.where(day >= F.lit(CUTS[0]).cast("timestamp_ntz")), CUTS[1])):
        table.refresh(files(rows), extract, F.lit(now).cast("timestamp_ntz"), next_id)
        assert table.refresh(files(rows), extract, F.lit(now).cast("timestamp_ntz"), next_id)["added"] == 0
    return table.read().where(F.col("predicate") != HASH).select("subject", "predicate", "object", "status")
