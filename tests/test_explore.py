"""Filters, pages, impact, export, unicode text and statistics by category on small tables."""

import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import explore, graph


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms(spark, form):
    texts = ["é", "é", "ﬁ ①", "Ａ", "", None, "ǆ가각"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", fn.normal_form(F.col("t"), form)).orderBy("i").collect()]
    assert got == [t if t is None else unicodedata.normalize(form, t) for t in texts]
    with pytest.raises(ValueError):
        fn.normal_form(F.col("t"), "NF")


def test_unicode_terms(spark):
    df = spark.createDataFrame([("Éa-x_9 naïve über 日本 é",)], "t string")
    assert df.select(fn.unicode_terms(F.col("t"))).first()[0] == ["éa", "x", "9", "naïve", "über", "日本", "é"]


def test_languages_of_paths(spark):
    paths = {"a.jsx": "javascript", "b.tsx": "tsx", "c.h": "c", "d.hxx": "cpp", "e.kts": "kotlin", "f.R": "r", "g.zsh": "bash", "h.mm": "objectivec", "i.zig": "zig", "j": "other", "k.xyz": "other"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", fn.language_of(F.col("p"))).collect()} == paths


def test_accepted(spark):
    rows = [("active", None, "some text", True), ("verified", "public", "x", True), ("proposed", None, "x", False), ("active", "secret", "x", False), ("active", None, "  ", False), ("active", None, None, False), ("active", None, "token = 5", False), ("active", None, "a token", True), (None, None, "x", False)]
    df = spark.createDataFrame(rows, "s string, c string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(explore.accepted(F.col("s"), F.col("c"), F.col("t")), "want").collect())


def test_ingested(spark):
    rows = [(1, "x", "ingest:a", "active", None), (2, "retired_x", "ingest:a", "active", None), (3, "x", "by hand", "active", None), (4, "x", "ingest:a", "superseded", 5), (5, "x", None, "active", None)]
    df = spark.createDataFrame(rows, "fact_id int, object string, metadata string, status string, superseded_by int")
    assert [r.fact_id for r in explore.ingested(df).collect()] == [1]


@pytest.mark.parametrize("offset, limit, n, more, omitted", [(0, 3, 3, True, 4), (4, 3, 3, False, 0), (6, 3, 1, False, 0), (-5, 0, 1, True, 6), (0, 999, 5, True, 2), (9, 3, 0, None, None)])
def test_pages(spark, offset, limit, n, more, omitted):
    rows = explore.page(spark.range(7), ["id"], offset=offset, limit=limit, most=5).collect()
    assert len(rows) == n and all((r.has_more, r.omitted) == (more, omitted) for r in rows)


def test_filters_are_joined(spark):
    df = spark.createDataFrame([("save", "method", "a/x.py"), ("load", "method", "b/y.py"), ("Save", "class", "a/z.py")], "label string, kind string, locator string")
    labels = lambda **f: sorted(r.label for r in explore.filter_graph(df, **f).collect())
    assert labels() == ["Save", "load", "save"] and labels(label="(?i)^save") == ["Save", "save"] and labels(label="ave", kinds=("method",)) == ["save"] and labels(prefix="b/") == ["load"]


def test_impact_of_a_change(spark):
    nodes = spark.createDataFrame([("a.py", "file", "a.py"), ("b.py", "file", "b.py"), ("n.md", "file", "n.md"), ("a.f", "function", "a.py"), ("b.g", "function", "b.py"), ("b.h", "function", "b.py")], "node string, kind string, path string")
    edges = spark.createDataFrame([("contains", "a.py", "a.f"), ("contains", "b.py", "b.g"), ("contains", "b.py", "b.h"), ("calls", "b.g", "a.f"), ("imports", "n.md", "b.py")], "kind string, src string, dst string")
    changed = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = explore.diff_impact(nodes, edges, changed("a.py"), depth=2)
    assert [(r.node, r.depth) for r in got.collect()] == [("a.f", 0), ("b.g", 1), ("a.py", 1), ("b.py", 2)]
    assert {r.kind: r.n for r in explore.impact_kinds(edges, got, 2).collect()} == {"contains": 2, "calls": 1}
    assert [r.node for r in explore.diff_impact(nodes, edges, changed("n.md"), depth=1).collect()] == ["n.md", "b.py"]
    assert explore.diff_impact(nodes, edges, changed("none")).count() == 0
    assert explore.diff_impact(nodes, edges, changed("a.py"), depth=9, limit=3).count() == 3


def test_impact_reads_the_graph_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    nodes = spark.createDataFrame([(f"f{i}", "function", f"{i}.py") for i in range(6)], "node string, kind string, path string").mapInPandas(seen, "node string, kind string, path string")
    edges = spark.createDataFrame([("calls", f"f{i}", f"f{i + 1}") for i in range(5)] + [("calls", "f0", "f1")], "kind string, src string, dst string").mapInPandas(seen, "kind string, src string, dst string")
    got = explore.diff_impact(nodes, edges, spark.createDataFrame([("0.py",)], "path string"), depth=3).collect()
    assert [(r.node, r.depth, r.degree) for r in got] == [("f0", 0, 2), ("f1", 1, 3), ("f2", 2, 2), ("f3", 3, 2)] and read.value == 12


@pytest.mark.parametrize("direction, want", [("outbound", ["a > b", "a > b > c"]), ("inbound", ["a > d"]), ("both", ["a > b", "a > d", "a > b > c"])])
def test_traces_either_way(spark, direction, want):
    e = spark.createDataFrame([("a", "K", "b"), ("b", "K", "c"), ("d", "K", "a"), ("a", "other", "z")], "src string, predicate string, dst string")
    assert [r.path for r in graph.trace_paths(e, "a", 2, direction=direction, kinds=("K",)).collect()] == want


def test_export(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, "policy:p", "GOVERNS", "x", day, None, None), (2, "x", "uses", "y", day, datetime(2024, 1, 5), 3), (3, "x", "uses", "z", datetime(2024, 1, 5), None, None)]
    df = spark.createDataFrame(rows, "fact_id int, subject string, predicate string, object string, valid_from timestamp, valid_until timestamp, superseded_by int")
    nodes, edges = explore.graph_export(df, F.lit(datetime(2024, 1, 9)))
    assert {(r.fact_id, r.current, r.governed) for r in edges.collect()} == {(1, True, True), (2, False, False), (3, True, False)}
    got = {r.node: r for r in nodes.collect()}
    assert got["x"].degree == 3 and set(got) == {"policy:p", "x", "y", "z"} and all(r.community_size >= 1 for r in got.values())


def test_category_stats(spark):
    items = spark.createDataFrame([("a", True, False, True, True, 10, 40), ("a", True, True, True, False, 10, 40), ("a", False, False, False, True, 0, 0), ("b", False, False, False, False, 0, 0)], "category string, any_hit boolean, all_hit boolean, scored boolean, covered boolean, delivered long, baseline long")
    got = {r.category: r for r in explore.category_stats(items).collect()}
    assert (got["a"].n, got["a"].any_percent, got["a"].all_percent, got["a"].covered_percent, got["a"].saved_percent) == (3, 66.67, 33.33, 50.0, 75.0)
    assert (got["b"].covered_percent, got["b"].saved_percent) == (0.0, 0.0)


def test_issue_facts(spark):
    issues = spark.createDataFrame([(7, " A   title ", "OPEN", ["bug", "ui", "bug"], "me", "s"), (8, None, None, None, None, "s"), (None, "x", "open", [], "y", "s")], "number int, title string, state string, labels array<string>, author string, source string")
    got = {(r.subject, r.predicate, r.object) for r in explore.issue_facts(issues).collect()}
    assert got == {("issue:7", "IS_A", "Issue"), ("issue:7", "HAS_TITLE", "A title"), ("issue:7", "HAS_STATE", "open"), ("issue:7", "OPENED_BY", "me"), ("issue:7", "HAS_LABEL", "bug"), ("issue:7", "HAS_LABEL", "ui"), ("issue:8", "IS_A", "Issue")}


def test_episodes(spark):
    df = lambda *rows: spark.createDataFrame(rows, "id int, at int, text string")
    got = explore.episodes(df((1, 1, "first"), (2, 2, " later   one"), (3, 3, "")), df((1, 1, "x" * 900)), df((9, 1, None)), most=1)
    assert {(r.kind, r.id, len(r.summary)) for r in got.collect()} == {("git", "2", 9), ("doc", "1", 400)}
