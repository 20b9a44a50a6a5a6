"""Queries over a symbol index of source files that are written from the tables.

A user is a file, in one of three languages; each kind of event that others follow is a
function that calls the kinds that come next. Comments, strings, raw strings, templates
and patterns of every file name ghosts that are not there. The SQL does not read the
files: it says from the events what the index must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.symbols import SymbolIndex, code_marks, source_graph
from tessera.plans.bindings import table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def source_files(spark, d) -> DataFrame:
    """(path, text): src/user_<id>.py, .js or .rs. A file takes view_<id + 3> from the file of that user, if it has one."""
    u = F.col("user_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").withColumn("next_type", F.lead("event_type").over(w)).where("next_type is not null and event_type <> next_type").select("user_id", "event_type", "next_type").distinct()
    functions = steps.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_set("next_type")).alias("calls"))

    def fill(pattern: str) -> Column:
        """The pattern with <u>, <v> (u + 3) and <t> put in."""
        return F.replace(F.replace(F.replace(F.lit(pattern), F.lit("<u>"), u.cast("string")), F.lit("<v>"), (u + 3).cast("string")), F.lit("<t>"), F.coalesce("event_type", F.lit("")))

    def body(head: str, call: str, tail: str) -> Column:
        made = F.transform("calls", lambda c: F.replace(F.replace(F.lit(call), F.lit("<n>"), c), F.lit("<u>"), u.cast("string")))
        return F.concat(fill(head), F.array_join(made, ""), fill(tail))

    one = F.when(u % 3 == 0, body("def <t>_<u>(x):\n    '''ghost_<u>() of <t>_<u>'''\n    # ghost_<u>()\n", "    <n>_<u>(x)\n", "    return 'ghost_<u>()' + \"ghost_<u>(\\\"\"\n\n")).when(
        u % 3 == 1, body("export function <t>_<u>(x) {\n  /* ghost_<u>( ) { */ // ghost_<u>() {\n  const s = `ghost_<u>() {`;\n", "  <n>_<u>(x);\n", "  return /ghost_<u>\\(}/.test(s) ? \"ghost_<u>() {\" : '}';\n}\n")
    ).otherwise(body("pub fn <t>_<u>(x: u64) {\n    /* a /* ghost_<u>() */ ghost_<u>() { */\n    let c = '{';\n", "    <n>_<u>(x);\n", "    let s = r#\"ghost_<u>() \" }\"#;\n}\n"))
    functions = functions.withColumn("code", one)
    files = functions.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "code"))), lambda x: x["code"]), "").alias("code")).withColumn("event_type", F.lit(""))
    first = F.when(u % 3 == 0, fill("from .user_<v> import view_<v> as other\n")).when(u % 3 == 1, fill("import { view_<v> as other } from './user_<v>.js';\n")).otherwise(fill("use crate::user_<v>;\n"))
    last = F.when(u % 3 == 0, fill("class Feed_<u>:\n    def start(self):\n        return self.run()\n    def run(self):\n        return other(1)\n")).when(
        u % 3 == 1, fill("class Feed_<u> {\n  start() { return this.run(); }\n  run() { return other(1); }\n}\n")
    ).otherwise(fill("struct Feed_<u> { x: u64 }\nimpl Feed_<u> {\n    fn start(&self) { self.run() }\n    fn run(&self) { view_<v>(1) }\n}\n"))
    suffix = F.when(u % 3 == 0, ".py").when(u % 3 == 1, ".js").otherwise(".rs")
    return files.select(F.concat(F.lit("src/user_"), u, suffix).alias("path"), F.concat(first, "code", last).alias("text"))


_FILES = """WITH n AS (SELECT user_id AS u, event_type AS t, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events),
  st AS (SELECT DISTINCT u, t, nt FROM n WHERE nt IS NOT NULL AND t <> nt), fu AS (SELECT DISTINCT u, t FROM st), us AS (SELECT DISTINCT u FROM st),
  f AS (SELECT u, 'src/user_' || u || CASE u % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.rs' END AS path FROM us),
  sy AS (SELECT path, 'function' AS kind, NULL AS owner, t || '_' || u AS name FROM fu JOIN f USING (u) UNION ALL SELECT path, 'class', NULL, 'Feed_' || u FROM f
         UNION ALL SELECT path, 'method', 'Feed_' || u, m FROM f, (VALUES ('start'), ('run')) v(m)),
  ca AS (SELECT path, t || '_' || u AS caller, nt || '_' || u AS callee, path AS to_path FROM st JOIN f USING (u) WHERE (u, nt) IN (SELECT (u, t) FROM fu)
         UNION ALL SELECT path, 'start', 'run', path FROM f
         UNION ALL SELECT f.path, 'run', 'view_' || g.u, g.path FROM f JOIN f g ON g.u = f.u + 3 WHERE (g.u, 'view') IN (SELECT (u, t) FROM fu))"""


@register("code_symbols", _FILES + " SELECT path, kind, owner, name FROM sy")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).symbols.select("path", "kind", "owner", "name")


@register("code_call_edges", _FILES + " SELECT path, caller, callee, to_path FROM ca")
def _(spark, d):
    index = SymbolIndex(source_files(spark, d))
    name = index.symbols.select("id", "name")
    edges = index.calls.join(name.select(F.col("id").alias("caller"), F.col("name").alias("from")), "caller").join(name.select(F.col("id").alias("callee"), F.col("name").alias("to")), "callee")
    return edges.select("path", F.col("from").alias("caller"), F.col("to").alias("callee"), "to_path").distinct()


@register("code_imports", _FILES + " SELECT f.path, g.path AS target_path FROM f LEFT JOIN f g ON g.u = f.u + 3 AND f.u % 3 < 2")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).imports.where("kind = 'import'").select("path", "target_path")


@register("code_exports", _FILES + " SELECT path, name FROM sy WHERE kind = 'function' UNION ALL SELECT path, name FROM sy WHERE kind = 'class' AND path LIKE '%.py'")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).exports.select("path", "name")


@register("code_symbol_graph", _FILES + """ SELECT 'contains' AS kind, count(*) AS n FROM sy UNION ALL SELECT 'imports', count(*) FROM f JOIN f g ON g.u = f.u + 3 AND f.u % 3 < 2
  UNION ALL SELECT 'calls', count(*) FROM (SELECT DISTINCT * FROM ca)""")
def _(spark, d):
    index = SymbolIndex(source_files(spark, d))
    _, edges = source_graph(index.files, index.symbols, index.imports, index.calls)
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


@register("code_callers", _FILES + " SELECT DISTINCT path, caller AS name FROM ca WHERE callee = 'view_6'")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).callers("view_6").select("path", "name")


@register("code_outline", _FILES + " SELECT path, count(*) FILTER (kind = 'class') AS n_class, count(*) FILTER (kind = 'function') AS n_function, count(*) FILTER (kind = 'method') AS n_method FROM sy GROUP BY path")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).repository_outline()


@register("code_references", _FILES + """, r AS (SELECT u, t || '_' || u AS caller, nt || '_' || u AS name FROM st WHERE (u, nt) IN (SELECT (u, t) FROM fu) UNION SELECT u, 'start', 'run' FROM us
    UNION SELECT u, 'run', 'view_' || (u + 3) FROM us WHERE u % 3 = 2 AND (u + 3, 'view') IN (SELECT (u, t) FROM fu)
    UNION SELECT u, '', 'view_' || (u + 3) FROM us WHERE u % 3 = 0 AND (u + 3, 'view') IN (SELECT (u, t) FROM fu)
    UNION SELECT u, '', 'view_' || (u + 3) FROM us WHERE u % 3 = 1 AND (u + 3, 'view') IN (SELECT (u, t) FROM fu))
  SELECT path, count(*) AS n FROM r JOIN f USING (u) GROUP BY path""")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).references.groupBy("path").agg(F.count("*").alias("n"))


@register("code_lexed_facts", _FILES + """, la AS (SELECT path, kind, CASE kind WHEN 'class' THEN 'class:' WHEN 'method' THEN 'method:' ELSE 'function:' END || coalesce(owner || '_', '') || name AS label, owner FROM sy),
  cl AS (SELECT c.path, CASE WHEN caller IN ('start', 'run') THEN 'method:Feed_' || regexp_extract(c.path, '[0-9]+') || '_' || caller ELSE 'function:' || caller END AS s, CASE WHEN callee = 'run' THEN 'method:Feed_' || regexp_extract(c.path, '[0-9]+') || '_run' ELSE 'function:' || callee END AS o FROM ca c)
  SELECT predicate, count(*) AS n FROM (SELECT DISTINCT label AS s, 'IS_A' AS predicate, kind AS o, path FROM la UNION SELECT regexp_replace(path, '\\.[a-z]+$', ''), 'DEFINES', label, path FROM la
    WHERE owner IS NULL UNION SELECT owner, 'DEFINES', label, path FROM la WHERE owner IS NOT NULL UNION SELECT s, 'CALLS', o, path FROM cl UNION SELECT path, 'IMPORTS', path, path FROM f) GROUP BY 1""")
def _(spark, d):
    return SymbolIndex(source_files(spark, d)).facts().groupBy("predicate").agg(F.count("*").alias("n"))


@register("code_ghosts", _FILES + " SELECT count(DISTINCT path) AS files, 0::BIGINT AS ghosts FROM sy")
def _(spark, d):
    """Names that only comments, strings and patterns hold: none is a mark."""
    marks = code_marks(source_files(spark, d))
    return marks.agg(F.count_distinct("path").alias("files"), F.count_if(F.startswith("name", F.lit("ghost"))).alias("ghosts"))
