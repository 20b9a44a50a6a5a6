"""Golden rows and brute force for operators that the table queries do not reach."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import cypher, evidence, graph, selection, temporal
from tessera.sources import documents as src


def test_current_truth_and_history_of_a_superseded_key(spark):
    rows = spark.sql("""select * from values
        (1, 'auth', 'uses', 'hmac', timestamp '2026-01-01 09:00:00'), (2, 'auth', 'uses', 'signed', timestamp '2026-01-01 10:00:00'), (3, 'api', 'uses', 'auth', timestamp '2026-01-01 09:00:00')
        as t(fact_id, subject, predicate, object, valid_from)""")
    facts = temporal.build_versions(rows)
    now, past = F.to_timestamp(F.lit("2026-01-01 11:00:00")), F.to_timestamp(F.lit("2026-01-01 09:30:00"))
    assert {r.object for r in temporal.current_truth(facts, now).collect()} == {"signed", "auth"}
    assert {r.object for r in temporal.as_of(facts, past).collect()} == {"hmac", "auth"}
    edge = temporal.edges_as_of(facts, past).where("subject = 'auth'").collect()
    assert [e.object for e in edge] == ["hmac"]
    assert [r.object for r in temporal.history(facts, "auth", "uses").collect()] == ["signed", "hmac"]


def test_consolidation_and_gate(spark):
    active = spark.createDataFrame([Row(fact_id=1, subject="a", predicate="p", object="x", valid_from=1)])
    new = spark.createDataFrame([("a", "p", "x"), ("a", "p", "y"), ("a", "p", None), ("b", "p", "z"), ("c", "p", None)], "subject string, predicate string, object string")
    assert sorted(r.op for r in temporal.consolidate(new, active).collect()) == ["ADD", "DELETE", "NOOP", "NOOP", "UPDATE"]


EDGES = [("notes", "uses", "auth", "a.py"), ("auth", "uses", "tokens", "a.py"), ("function:f", "CALLS", "function:g", "b.rs"), ("module:m", "CALLS", "function:f", "b.rs"), ("function:g", "CALLS", "function:f", "c.ts")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, predicate string, dst string, source string")


def test_paths(edges):
    assert [r.node for r in graph.shortest_path(edges, "notes", "tokens").orderBy("step").collect()] == ["notes", "auth", "tokens"]
    assert graph.shortest_path(edges, "tokens", "notes", directed=True).count() == 0
    assert [r.path for r in graph.trace_paths(edges, "notes", 3).collect()] == ["notes > auth", "notes > auth > tokens"]
    assert {(r.node, r.depth) for r in graph.neighbourhood(edges, edges.sparkSession.createDataFrame([("auth",)], "node string"), 2).collect()} == {("auth", 0), ("notes", 1), ("tokens", 1)}


@pytest.mark.parametrize(
    "text", ["MATCH p = (a)-[r]->(b) RETURN a.name", "MATCH (a)<-[r]-(b) RETURN a.name", "MATCH (a)-[r*1..3]->(b) RETURN a.name", "MATCH (a)-[r:X|Y]->(b) RETURN a.name", "CREATE (a)", "MATCH (a) RETURN a.name", "MATCH (a)-[r]->(b) RETURN a.name, count(*)", "MATCH (a)-[r]->(b) RETURN a.name extra text"]
)
def test_cypher_refuses(edges, text):
    with pytest.raises(cypher.CypherError):
        cypher.query(edges, text)


def test_cypher_not_over_an_undecided_test_is_true(spark):
    e = spark.createDataFrame([("a", "p", "b", None), ("c", "p", "d", "s")], "src string, predicate string, dst string, source string")
    assert sorted(r.n for r in cypher.query(e, "MATCH (a)-[r]->(b) WHERE NOT r.source = 's' RETURN a.name AS n").collect()) == ["a"]


def test_identifier_parts(spark):
    row = spark.range(1).select(fn.identifier_parts(F.lit("OAuth2Token")).alias("p")).first()
    assert row.p[0] == "oauth2token" and {"auth", "2", "token"} <= set(row.p)


def test_markup_decodes_ampersand_first(spark):
    assert spark.range(1).select(fn.decode_markup(F.lit("<p>a &amp;lt; b</p><script>x</script>")).alias("t")).first().t == "a < b"


def test_document_facts(spark):
    docs = spark.createDataFrame([("adr-2", "# Use tokens\nSupersedes: adr-1\nWe sign every session token here.\n## Why\nshort")], "source string, text string")
    facts = {(r.subject, r.predicate, r.object) for r in src.document_facts(docs).collect()}
    assert {("adr-2", "HAS_TITLE", "Use tokens"), ("adr-2", "SUPERSEDES", "adr-1"), ("adr-1", "HAS_STATUS", "retired_by_adr-2"), ("Why", "PART_OF", "adr-2"), ("Use tokens", "HAS_CONTENT", "We sign every session token here.")} <= facts
    assert not any(o == "short" for _, _, o in facts)


def test_manifests_and_feeds(spark):
    files = spark.createDataFrame([("a/package.json", '{"name": "x"}'), ("b/Cargo.toml", '[package]\nname = "y"\n'), ("c/go.mod", "module z\n"), ("d.txt", "n")], "source string, text string")
    assert {r.name for r in src.manifest_names(files).collect()} == {"x", "y", "z"}
    feed = spark.createDataFrame([("f", "<rss><item><title>One</title></item><item><title><![CDATA[Two]]></title></item><item><title>One</title></item></rss>")], "source string, text string")
    assert [r.title for r in src.feed_items(feed).orderBy("place").collect()] == ["One", "Two"]


def test_files_ledger_and_artifacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("hello")
    (tmp_path / "in/b.md").write_text("too long for the limit")
    assert {(r.bytes, r.skipped, r.text) for r in src.read_files(spark, str(tmp_path / "in"), most_bytes=10).collect()} == {(5, None, "hello"), (22, "too_large", None)}
    (tmp_path / "l.jsonl").write_text('{"workspace":"w","tool":"t","delivered":10,"baseline":40}\nbroken\n{"workspace":"v","tool":"t","delivered":1,"baseline":2}\n')
    ledger = evidence.ledger(src.read_ledger(spark, str(tmp_path / "l.jsonl"), "w")).collect()
    assert {(r.tool, r.saved, r.percent) for r in ledger} == {("t", 30, 75), (None, 30, 75)}
    src.write_artifacts(spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary"), str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art")).count() == 2
    assert src.broken_artifacts(spark, str(tmp_path / "art")).isEmpty()


def test_diverse_selection(spark):
    rows = [("q", "a", 0.9, 100, "doc", ["1", "2", "3"]), ("q", "b", 0.89, 100, "doc", ["1", "2", "3"]), ("q", "c", 0.6, 100, "code", ["7", "8"]), ("q", "d", 0.5, 2000, "code", ["9"]), ("q", "e", 0.01, 10, "doc", ["5"])]
    c = spark.createDataFrame(rows, "request string, record string, utility double, tokens bigint, category string, shingles array<string>")
    out = selection.select_diverse(c).orderBy("position").collect()
    assert [r.record for r in out] == ["a", "c"]  # b repeats a, d does not fit, e is of too little use


def test_retired_and_changes(spark):
    a = spark.createDataFrame([("s", "p", "o", "f"), ("s", "p", "q", "f")], "subject string, predicate string, object string, source string")
    out = temporal.retired(a, a.where("object = 'o'")).collect()
    assert [r.object for r in out] == ["q"] and out[0].closing_object.startswith("retired_")
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "source string, hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "source string, hash string")
    assert {(r.source, r.change) for r in temporal.source_changes(before, after).collect()} == {("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added")}


def test_retrieval_ranks_by_relevance_unrounded(spark, tmp_path):
    """Two turns whose relevance differs past the sixth place are ranked by it, not by their turns."""
    from tessera.plans import content

    q = [f"q{i}" for i in range(1000)]
    # 999 / sqrt(1000 * 999) and 998 / sqrt(1000 * 997): 0.9994999 and 0.9995012 differ at the sixth place; 997 / sqrt(1000 * 996.0...) nearer
    best, found = None, {}
    for hits in range(400, 1000):
        for size in range(hits, 1001):
            key = round(hits / (1000 * size) ** 0.5, 6)
            other = found.setdefault(key, (hits, size))
            if other != (hits, size) and hits / size**0.5 > other[0] / other[1] ** 0.5 * (1 + 1e-9):
                best = (other, (hits, size))
                break
        if best:
            break
    turn = lambda x: " ".join(q[: x[0]] + [f"z{i}" for i in range(x[1] - x[0])])
    rows = [(1, 0, "user", " ".join(q)), (1, 1, "user", turn(best[0])), (1, 2, "assistant", turn(best[1]))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.mrr for r in content.QUERIES["eval_retrieval_metrics"](spark, str(tmp_path)).collect()] == [0.5]


def test_shingles_take_the_terms_once(spark):
    """The terms of a text are taken once, not for each of its runs of words."""
    import time

    from pyspark.sql import functions as F

    from tessera.operators import selection as sel

    df = spark.range(400).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.concat(F.lit("w"), i + F.col("id"))), " ").alias("t")).localCheckpoint()
    begun = time.time()
    got = df.select(F.size(sel.shingles(F.col("t"))).alias("n"), sel.shingles(F.lit("A b")).alias("two"), sel.shingles(F.col("t"))[1].alias("second")).collect()
    assert {r.n for r in got} == {254} and got[0].two == ["a b"] and {r.second for r in got} == {f"w{i + 2} w{i + 3} w{i + 4}" for i in range(400)} and time.time() - begun < 10


def test_long_sets_apart_are_told_by_bits(spark):
    """Bits by the size of a set: two long sets under the threshold differ in more of them than it allows, ones above it do not."""
    from pyspark.sql import functions as F

    from tessera.operators import graph

    tokens = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.xxhash64(i))
    df = spark.range(1).select(tokens(1, 3000).alias("a"), tokens(1501, 4700).alias("far"), tokens(201, 3100).alias("near"))
    bits = df.select(*[graph._parity()(c).alias(c) for c in df.columns]).select(graph._apart()("a", "far").alias("far"), graph._apart()("a", "near").alias("near")).first()
    allowed = lambda n, m: n + m - 2 * 0.8 / 1.8 * (n + m)
    assert bits.far > allowed(3000, 3200) and bits.near <= 300 <= allowed(3000, 2900)
    sets = [(i, "x", sorted({f"t{x}" for x in range(lo, hi)})) for i, (lo, hi) in enumerate([(0, 3000), (1500, 4700), (200, 3100), (0, 40), (1, 41), (60, 66)])]
    got = graph.similar_sets(spark.createDataFrame(sets, "k bigint, language string, tokens array<string>"), "k", threshold=0.8).collect()
    assert {(r.a, r.b, r.similarity) for r in got} == {(0, 2, round(2800 / 3100, 6)), (3, 4, round(39 / 41, 6))}


def test_similar_sets_send_no_token_to_be_counted(spark):
    """As by brute force, with copies, null languages and words that two languages share; only the rarest tokens of a set are joined."""
    import random

    from tessera.operators import graph

    rng = random.Random(4)
    rows = []
    for i in range(150):
        like = rows[rng.randrange(len(rows))][2] if rows and rng.random() < 0.6 else rng.sample(range(300), rng.randint(5, 40))
        rows.append((i, rng.choice(["x", "y", "y", None]), sorted({*like[rng.randrange(3) :], *rng.sample(range(300), rng.randrange(2))})))
    df = spark.createDataFrame([(k, lang, [f"t{x}" for x in t]) for k, lang, t in rows], "k bigint, language string, tokens array<string>")
    made = graph.similar_sets(df, "k", threshold=0.8)
    first, want = {}, set()
    for k, lang, t in rows:
        a = first.setdefault((lang, tuple(t)), k)
        if a != k:
            want.add((a, k, 1.0))
    names = [(k, lang, set(t)) for (lang, t), k in first.items() if lang]
    want |= {(a, b, round(len(s & t) / len(s | t), 6)) for a, x, s in names for b, y, t in names if a < b and x == y and len(s & t) / len(s | t) >= 0.8}
    assert len(want) > 20 and {tuple(r) for r in made.collect()} == want and made.count() == len(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(tokens" not in plan and "collect_list" not in plan
