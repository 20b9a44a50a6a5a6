"""Compact views, question matching, sort keys and estimates, coverage and residues."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import views


@pytest.mark.parametrize("text, kind", [
    ('  {"a": 1}', "json"), ("[1]", "json"), ("# Title\nx", "markdown"), ("x\n - item", "markdown"), ("a\nb\nc\nan ERROR here\ne", "log"), ("an error\nb", "text"), ("const x = 1", "code"), ("plain words", "text"), ("", "text"),
])
def test_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(views.text_kind(F.col("t"))).first()[0] == kind


def plain_compact(text, kind, most):
    import re

    lines = [x.strip() for x in re.split(r"\r?\n", text) if x.strip()]
    if len(lines) <= most:
        return "\n".join(lines)
    first, last, matters = views.KINDS[kind]
    keep = [i for i in range(len(lines)) if i < first or re.search(matters, lines[i]) or i >= max(first, len(lines) - last)][:most]
    return "\n".join([lines[i] for i in keep] + ([f"... {len(lines) - len(keep)} lines omitted ..."] if len(keep) < len(lines) else []))


@pytest.mark.parametrize("kind", list(views.KINDS))
def test_views_keep_ends_and_what_matters(spark, kind):
    lines = [f"line {i}" for i in range(60)]
    lines[20], lines[30], lines[31], lines[40] = "an error: policy", "# head", "import x", '{"k": 1}'
    texts = ["\n".join(lines), "\r\n".join(["  a  ", "", "b"]), "\n".join(["error"] * 90), "", "\n".join(lines[:32]), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", views.compact(F.col("t"), F.lit(kind))).orderBy("i").collect()]
    assert got[:-1] == [plain_compact(t, kind, 32) for t in texts[:-1]] and got[-1] is None


def test_questions(spark):
    assert views.question_terms("What are the Tokens of user:7, and why?") == ["are", "tokens", "token", "user:7", "and"]
    df = spark.createDataFrame([("user:7", "has", "token"), ("x", "y", "z"), (None, None, "TOKENS")], "a string, b string, c string")
    row = lambda q: [r[0] for r in df.select(views.matches(q, F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert row("which tokens?") == [True, False, True] and row("what is the") == [True, True, True] and row("nothing") == [False, False, False]


def test_keys_and_estimates(spark):
    df = spark.createDataFrame([(7, "b", "naïve"), (None, None, "𝒳𝒳𝒳"), (12, "a", "")], "n int, s string, t string")
    got = df.select(views.sort_key(F.col("n"), True), views.sort_key(F.col("s")), views.utf16_tokens(F.col("t")), views.byte_tokens(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("0" * 19 + "7", "b", 2, 1), ("", "", 2, 3), ("0" * 18 + "12", "a", 1, 0)]


def test_pointers(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": "x"}], "c/d": true}',), ("no json",), (None,)], "j string")
    got = df.select(*[views.pointed(F.col("j"), p) for p in ("/a/1/b", "/c~1d", "/a/9")]).collect()
    assert [tuple(r) for r in got] == [("x", "true", None), (None, None, None), (None, None, None)]


def test_coverage_conflicts_and_residues(spark):
    wanted = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["z", "y"])], "request int, entities array<string>")
    selected = spark.createDataFrame([(1, ["b", "q"]), (1, None)], "request int, entities array<string>")
    assert {tuple(r) for r in views.coverage(selected, wanted).collect()} == {(1, 2, 1, "a"), (2, 0, 0, ""), (3, 2, 0, "y,z")}
    records = spark.createDataFrame([("k", 1, 5), ("k", 2, 4), ("m", 1, 1), ("m", 1, 2), (None, 1, 9), (None, 2, 9)], "conflict_key string, value int, record int")
    assert [tuple(r) for r in views.key_conflicts(records).collect()] == [("k", 2, 2, 4)]
    facts = spark.createDataFrame([(1, "active", 3), (2, "active", 1), (3, "active", 2), (4, "superseded", 0)], "fact_id int, status string, valid_from int")
    proposals = spark.createDataFrame([(1, "approved"), (2, "rejected")], "fact_id int, status string")
    assert [tuple(r) for r in views.lineage_residue(facts, proposals).collect()] == [(2, "rejected"), (3, "missing")]


def test_endpoint_languages(spark):
    edges = spark.createDataFrame([("a.py", "b.rs", "a.py"), ("x", "b.rs", "c.py")], "src string, dst string, source string")
    assert {r.language: r.n for r in views.endpoint_languages(edges).collect()} == {"python": 3, "rust": 2, "other": 1}


def test_a_text_is_split_once(spark):
    """A view of a text of many lines takes time by its lines, not by their square."""
    import time

    n = 6000
    df = spark.createDataFrame([("\n".join(f"{i} nothing of note" for i in range(n)),)], "t string")
    begun = time.time()
    got = df.select(views.compact(F.col("t"), F.lit("text"))).first()[0].split("\n")
    assert got[-1] == f"... {n - 10} lines omitted ..." and len(got) == 11 and time.time() - begun < 10
