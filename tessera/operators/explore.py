"""Filters, pages, impact and export of graphs and facts; statistics by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph

#: States and data class of records that a profile takes (fixed values).
ACCEPTED, SECRET_CLASS = ("active", "verified"), "secret"
UNSAFE = r"(?i)(password|passwd|token|secret|api[_-]?key|private[_-]?key|credential)"


def ingested(facts: DataFrame, mark: str = "ingest:") -> DataFrame:
    """Active facts that an ingest wrote and none has retired (columns object, metadata, status, superseded_by)."""
    return facts.where((F.col("status") == "active") & F.col("superseded_by").isNull() & ~F.startswith("object", F.lit("retired_")) & F.contains("metadata", F.lit(mark)))


def accepted(status: Column, data_class: Column, text: Column) -> Column:
    """Whether a profile takes a record: in force, not secret, with text, and no assignment of something unsafe in it."""
    unsafe = text.rlike(UNSAFE) & F.contains(text, F.lit("="))
    return F.coalesce(status.isin(*ACCEPTED) & ~data_class.eqNullSafe(F.lit(SECRET_CLASS)) & (F.length(F.trim(text)) > 0) & ~unsafe, F.lit(False))


def filter_graph(rows: DataFrame, *, label: str | None = None, kinds: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Nodes or edges that pass every filter given: a pattern in the label, a kind, the start of the locator."""
    tests = [F.col("label").rlike(label) if label is not None else None, F.col("kind").isin(*kinds) if kinds is not None else None, F.startswith("locator", F.lit(prefix)) if prefix is not None else None]
    for t in tests:
        rows = rows if t is None else rows.where(t)
    return rows


def page(rows: DataFrame, order: Sequence[Column | str], *, offset: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, with has_more and omitted (rows that no page up to this one shows);
    limit is held between 1 and ``most``. The count of all rows is one number that is sent to the page's."""
    limit, offset = max(1, min(most, limit)), max(0, offset)
    total = rows.agg(F.count("*").alias("_n"))
    shown = rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
    left = F.greatest(F.lit(0), F.col("_n") - offset - limit)
    return shown.withColumn("has_more", left > 0).withColumn("omitted", left).drop("_n")


def diff_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, *, depth: int = 2, limit: int = 500) -> DataFrame:
    """Nodes within ``depth`` steps, either way, of what changed: node, kind, depth, degree of calls and references.

    ``nodes``: node, kind, path; ``edges``: kind, src, dst; ``changed``: path. Seeds are the
    symbols of the changed files, or, where those have none, the files. Of more than ``limit`` nodes the nearest
    stay, by degree, then name."""
    nodes, edges = graph.written(nodes.select("node", "kind", "path"), "nodes"), graph.written(edges.select("kind", "src", "dst"), "edges")  # every step asks for them
    touched = nodes.join(changed.select("path").distinct(), "path", "left_semi")
    symbols = touched.where("kind <> 'file'").select("node")
    files = touched.where("kind = 'file'").join(touched.where("kind <> 'file'").select("path"), "path", "left_anti").select("node")
    reached = graph.written(graph.neighbourhood(edges, symbols.unionByName(files), max(1, min(5, depth))), "reached")
    behaviour = edges.where("kind in ('calls', 'references')")
    degree = behaviour.select(F.explode(F.array("src", "dst")).alias("node")).join(reached.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))
    rows = reached.join(nodes.select("node", "kind"), "node").join(degree, "node", "left").fillna(0, ["degree"])
    return rows.orderBy("depth", F.col("degree").desc(), "node").limit(limit)


def impact_kinds(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Kinds of the edges at nodes nearer than ``depth`` (every edge that the walk went along), with their number."""
    near = reached.where(F.col("depth") < depth).select("node")
    met = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)).distinct()
    return met.groupBy("kind").agg(F.count("*").alias("n"))


def graph_export(facts: DataFrame, now: Column, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts for display: nodes with degree, community and its size, edges with current (in force at
    ``now``) and governed (stated by a policy or decision). Communities are those of all edges, past ones too."""
    governed = F.upper("predicate").isin("GOVERNS", "DECIDES", "REQUIRES") | F.startswith("subject", F.lit("policy:")) | F.startswith("subject", F.lit("decision:"))
    current = (F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now)) & F.col("superseded_by").isNull()
    edges = facts.select("fact_id", F.col("subject").alias("src"), "predicate", F.col("object").alias("dst"), F.coalesce(current, F.lit(False)).alias("current"), F.coalesce(governed, F.lit(False)).alias("governed"))
    ends = graph.degrees(edges)
    labels = graph.label_propagation(edges.select("src", "dst"), passes)
    sizes = labels.groupBy("label").agg(F.count("*").alias("community_size"))
    nodes = ends.join(labels.join(sizes, "label"), "node", "left").select("node", "degree", F.col("label").alias("community"), "community_size")
    return nodes, edges


def category_stats(items: DataFrame) -> DataFrame:
    """A row a category: items, hits, answers covered, tokens, and their percentages, rounded; of nothing, 0.

    ``items``: category, any_hit, all_hit, scored, covered (booleans), delivered, baseline (tokens)."""
    n = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    rows = items.groupBy("category").agg(F.count("*").alias("n"), n("any_hit"), n("all_hit"), n("scored"), F.count_if(F.col("scored") & F.col("covered")).alias("n_covered"), F.sum("delivered").alias("delivered"), F.sum("baseline").alias("baseline"))
    percent = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 2)).otherwise(0.0)
    saved = F.when(F.col("baseline") > 0, F.round((1 - F.col("delivered") / F.col("baseline")) * 100, 2)).otherwise(0.0)
    return rows.select("*", percent("n_any_hit", "n").alias("any_percent"), percent("n_all_hit", "n").alias("all_percent"), percent("n_covered", "n_scored").alias("covered_percent"), saved.alias("saved_percent"))


def issue_facts(issues: DataFrame) -> DataFrame:
    """Facts of issues (number, title, state, labels, author, source): subject, predicate, object, source.

    Titles lose outer and repeated white space; an issue without a number states nothing."""
    subject = F.concat(F.lit("issue:"), F.col("number"))
    pairs = F.array(
        F.struct(F.lit("IS_A").alias("p"), F.lit("Issue").alias("o")), F.struct(F.lit("HAS_TITLE").alias("p"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("o")),
        F.struct(F.lit("HAS_STATE").alias("p"), F.lower("state").alias("o")), F.struct(F.lit("OPENED_BY").alias("p"), F.col("author").alias("o")),
    )
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.struct(F.lit("HAS_LABEL").alias("p"), x.alias("o")))
    rows = issues.where("number is not null").select(subject.alias("subject"), F.explode(F.concat(pairs, labels)).alias("f"), "source")
    return rows.select("subject", F.col("f.p").alias("predicate"), F.col("f.o").alias("object"), "source").where("object is not null and object <> ''").distinct()


def episodes(commits: DataFrame, docs: DataFrame, facts: DataFrame, *, most: int = 50, chars: int = 400) -> DataFrame:
    """Episodes to remember, ``most`` of each kind, the latest first: kind, id, at, summary (``chars`` at most).

    ``commits`` (id, at, text), ``docs`` (id, at, text), ``facts`` (id, at, text) become kinds git, doc, graph; texts without a word are left out."""
    w = Window.partitionBy("kind").orderBy(F.col("at").desc(), "id")
    rows = None
    for kind, df in (("git", commits), ("doc", docs), ("graph", facts)):
        part = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "at", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("summary")).where("summary <> ''")
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("kind", "id", "at", F.substring("summary", 1, chars).alias("summary"))
