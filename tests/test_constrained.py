"""Constrained selection: the lazy queue against rescoring all, errors, limits, assembly and manifests."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import constrained as sel
from tessera.operators.constrained import Constraints, _like, _six, choose


def record(i, utility=0.5, tokens=10, category="evidence", entities=(), shingles=(), hash_=None, path=None, governance=False, conflict=False, against=()):
    return {"record": i, "utility": utility, "tokens": tokens, "category": category, "entities": set(entities), "shingles": set(shingles), "hash": hash_, "path": path, "governance": governance, "conflict": conflict, "against": list(against)}


def eager(rows, budget, required, entities, c):
    """All gains of all records in every round; (record, state, marginal) in order of judgement."""
    rows = [r for r in rows if not r["against"]]
    forced = sorted((r for r in rows if r["record"] in required or r["governance"]), key=lambda r: (r["record"] not in required, r["record"]))
    taken, left = list(forced), [r for r in rows if r not in forced]
    out = []
    while left and len(taken) < c.most_selected:
        cats, covered = [t["category"] for t in taken], set().union(*[t["entities"] for t in taken]) if taken else set()

        def gain(r):
            near = _six(max([0.0, *(_like(r, t, c) for t in taken)]))
            return near, _six(r["utility"] - c.diversity * near + (c.new_entity if (r["entities"] & entities) - covered else 0.0) + (0.0 if r["category"] in cats else c.new_category))

        best = min(left, key=lambda r: (-gain(r)[1], r["tokens"], r["record"]))
        near, g = gain(best)
        left.remove(best)
        bad = best["utility"] < c.least_utility or near >= c.duplicate or cats.count(best["category"]) >= c.caps.get(best["category"], 2) or sum(t["tokens"] for t in taken) + best["tokens"] > budget or g < c.least_marginal
        out.append((best["record"], "excluded" if bad else "selected", g))
        if not bad:
            taken.append(best)
            covered = covered | best["entities"]
            if entities <= covered and sum(t["category"] == "evidence" for t in taken) >= c.least_evidence and sum(t["tokens"] for t in taken) / max(1, budget) >= c.least_use:
                break
    return out


@pytest.mark.parametrize("seed", range(40))
def test_lazy_queue_equals_rescoring_all(seed):
    rng = random.Random(seed)
    words = list("abcdefghij")
    rows = [
        record(i, rng.choice([0.2, 0.4, 0.5, 0.9, 1.3]), rng.randint(5, 40), rng.choice(["evidence", "episodes", "decisions", "other"]), rng.sample(words[:4], rng.randint(0, 2)), rng.sample(words, rng.randint(0, 5)),
               rng.choice([None, None, "h1", "h2"]), rng.choice([None, None, "p"]), governance=rng.random() < 0.05)
        for i in range(rng.choice([3, 20, 60]))
    ]
    c = Constraints(least_use=rng.choice([0.0, 0.5]), most_selected=rng.choice([4, 12]))
    required, entities = set(rng.sample(range(3), rng.randint(0, 1))), set(rng.sample(words[:4], rng.randint(0, 3)))
    budget = rng.choice([120, 400])
    got, _ = choose(rows, budget, required, entities, c)
    if any(s == "refused" for _, s, *_ in got):
        return
    want = eager(rows, budget, required, entities, c)
    judged = [(r, s, m) for r, s, _, m, _ in got if m != 1000.0]
    assert judged[: len(want)] == want and len(got) == len(rows)
    assert not any(s == "selected" for _, s, _ in judged[len(want) :])


def test_complementary_evidence_wins():
    rows = [
        record("a", 1.0, 12, entities=["auth"], shingles=["x", "y", "z"], hash_="same"), record("b", 0.99, 12, entities=["auth"], shingles=["x", "y", "z"], hash_="same"),
        record("c", 0.9, 12, entities=["auth"], shingles=["p", "q"]), record("d", 0.1, 12),
    ]
    got, enough = choose(rows, 80, set(), {"auth"}, Constraints())
    state = {r: (s, p, why) for r, s, p, _, why in got}
    assert enough and state["a"][:2] == ("selected", 1) and state["c"][:2] == ("selected", 2) and state["b"] == ("excluded", None, "redundant") and state["d"][0] == "excluded"


def test_one_path_is_left_before_it_is_used_twice():
    rows = [record("a1", 1.0, path="q", shingles=["1"]), record("a2", 0.99, path="q", shingles=["2"]), record("b1", 0.9, path="r", shingles=["3"])]
    got, _ = choose(rows, 80, set(), set(), Constraints())
    assert {r for r, s, *_ in got if s == "selected"} == {"a1", "b1"}


def test_budget_use_holds_off_the_stop():
    rows = [record(f"e{i}", 1.0, 5, shingles=[str(i)]) for i in range(5)] + [record("long", 0.9, 45, shingles=["l"])]
    c = Constraints(least_use=0.5, diversity=0.0, caps=dict(sel.CATEGORY_CAPS, evidence=10))
    got, enough = choose(rows, 100, set(), set(), c)
    assert enough and sum(5 if r != "long" else 45 for r, s, *_ in got if s == "selected") >= 50


@pytest.mark.parametrize("rows, required, error", [
    ([record(1)], {2}, "required_context_unresolved"), ([record(1, against=["secret"])], {1}, "required_context_unresolved"), ([record(1, conflict=True)], {1}, "required_context_conflict"),
    ([record(1, tokens=90), record(2, tokens=20, governance=True)], {1}, "required_context_over_budget"),
])
def test_requests_that_cannot_be_met(rows, required, error):
    got, enough = choose(rows, 100, required, set(), Constraints())
    assert not enough and {why for _, s, _, _, why in got if s == "refused"} == {error} and not any(s == "selected" for _, s, *_ in got)


def test_conflicts_suffice_only_together():
    rows = [record(i, 1.0 - i / 10, shingles=[str(i)], conflict=i == 3) for i in range(4)]
    got, enough = choose(rows, 100, set(), set(), Constraints())
    assert enough and {r for r, s, *_ in got if s == "selected"} == {0, 1, 2, 3}


def test_every_reason_is_given():
    rows = [record(0, 0.1), record(1, 1.0, shingles=["a"]), record(2, 0.99, tokens=500, shingles=["b"]), record(3, 0.36, shingles=["a", "c"], category="episodes")]
    got, _ = choose(rows, 100, set(), {"never"}, Constraints(caps={"evidence": 1, "episodes": 3}))
    why = {r: w.split(",") for r, s, _, _, w in got if s == "excluded"}
    assert "below_minimum_utility" in why[0] and "category_cap" in why[0] and "token_budget" in why[2] and why[3] == ["insufficient_marginal_utility"]


CANDIDATES = "request long, record long, utility double, tokens long, category string, entities array<string>, shingles array<string>, hash string, path string, governance boolean, conflict boolean, against array<string>"


def frames(spark, rows, requests):
    return spark.createDataFrame(requests, "request long, budget long, required array<long>, entities array<string>"), spark.createDataFrame(rows, CANDIDATES)


def test_only_the_best_candidates_are_judged(spark):
    rows = [(1, i, i / 1000, 1, "evidence", [], [str(i)], None, None, i == 5, None, []) for i in range(500)] + [(1, 999, 0.0, 1, "evidence", None, None, None, None, None, None, ["secret"])]
    requests, candidates = frames(spark, rows, [(1, 100, [3], []), (2, 10, [7], []), (3, 10, [], None), (4, 10, None, [])])
    got = {(r.request, r.record): r for r in sel.select_constrained(requests, candidates, Constraints(most_candidates=50)).collect()}
    assert len(got) == 502 and got[(1, 3)].state == got[(1, 5)].state == "selected" and got[(1, 100)].reasons == "candidate_limit" and got[(1, 999)].reasons == "secret"
    assert got[(2, None)].reasons == "required_context_unresolved" and got[(1, 499)].state == "selected"
    empty = sel.select_constrained(requests.where("false"), candidates)
    assert empty.count() == 0


def test_features_and_categories(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = [(["a", "b"], ["c"], ["a", "b", "c", "d"], ["x"], ["y", "x"], ["x", "y", "z"], 0.9, None, 2.0, "preference", None, None, 64, [(4.0, 1), (8.0, 2)]), ([], [], [], [], [], [], None, -1.0, None, "story", "2024-03-01", None, 0, [])]
    schema = "objective array<string>, step array<string>, text_terms array<string>, tags array<string>, relations array<string>, required_entities array<string>, authority double, confidence double, outcome double, kind string, valid_from string, valid_to string, tokens int, ranks array<struct<weight double, rank int>>"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")}).withColumns(sel.features(now)).withColumn("u", sel.weighted())
    a, b = df.collect()
    assert (a.source_fusion, a.objective_relevance, a.step_relevance) == (round(4 / 61 + 8 / 62, 6), round(2 / 8**0.5, 6), 0.5)
    assert (a.entity_coverage, a.relation_coverage, a.authority, a.confidence, a.outcome_evidence) == (round(2 / 3, 6), round(2 / 3, 6), 0.9, 0.5, 1.0)
    assert (a.preference_applicable, a.temporal_applicability, a.kind_priority, a.token_efficiency) == (1.0, 1.0, 0.7, 0.5)
    assert a.u == pytest.approx(sum(w * a[k] for k, w in sel.FEATURE_WEIGHTS.items()), abs=1e-6)
    assert (b.temporal_applicability, b.kind_priority, b.confidence, b.token_efficiency, b.entity_coverage) == (0.0, 0.35, 0.0, 1.0, 0.0)
    kinds = spark.createDataFrame([("policy", "active"), ("claim", "active"), ("odd", "quarantined"), ("odd", None), (None, None)], "kind string, status string")
    assert [r[0] for r in kinds.select(sel.category_of(F.col("kind"), F.col("status"))).collect()] == ["governance", "evidence", "negative", "other", "other"]


def test_manifests_tell_changed_work(spark):
    rows = [(q, i, 1.0 - i / 10, 5, "evidence", [], [str(i)], None, None, False, False, []) for q in (1, 2) for i in range(3)]
    requests, candidates = frames(spark, rows, [(1, 100, [], []), (2, 100, [], [])])
    records = candidates.select("request", "record", "category", "tokens", F.concat(F.lit("text "), "record").alias("text"))
    decided = sel.select_constrained(requests, candidates)
    stored = sel.manifest(decided, sel.assemble(decided, records, 50))
    assert {r.state for r in sel.verify(stored, decided, sel.assemble(decided, records, 50)).collect()} == {"same"}
    other = records.withColumn("text", F.when(F.col("request") == 2, "new").otherwise(F.col("text")))
    assert {(r.request, r.state) for r in sel.verify(stored, decided, sel.assemble(decided, other, 50)).collect()} == {(1, "same"), (2, "changed")}
    one = decided.where("request = 1")
    assert {(r.request, r.state) for r in sel.verify(stored, one, sel.assemble(one, records, 50)).collect()} == {(1, "same"), (2, "missing")}


def test_requests_across_batches(spark):
    """Requests that begin in one batch and end in another, a large one among them, and one without a name are folded whole."""
    from pyspark.sql import functions as F

    from tessera.operators.selection import by_request

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(500).select(F.when(F.col("id") < 300, F.col("id") % 40).when(F.col("id") < 480, 99).alias("request"), F.col("id").alias("record"))
        got = by_request(rows, lambda part: [{"n": len(part), "s": sum(r["record"] for r in part)}], "request bigint, n int, s bigint")
        want = rows.groupBy("request").agg(F.count("*").cast("int").alias("n"), F.sum("record").alias("s"))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain(rows, requests, c):
    """``choose`` request by request."""
    names = ("request", "record", "utility", "tokens", "category", "entities", "shingles", "hash", "path", "governance", "conflict", "against")
    out = set()
    for q, budget, required, wanted in requests:
        part = [dict(zip(names, r, strict=True)) for r in rows if r[0] == q]
        part = [{**r, "entities": set(r["entities"] or ()), "shingles": set(r["shingles"] or ()), "governance": bool(r["governance"]), "conflict": bool(r["conflict"])} for r in part]
        got, enough = choose(part, budget, set(required or ()), set(wanted or ()), c) if part or required else ([], False)
        out |= {(q, *x, enough) for x in got}
    return out


def test_all_candidates_are_judged(spark):
    """The one record that covers the entity stands behind 300 of larger utility."""
    rows = [(1, i, 0.9 - i / 10000, 5, "evidence" if i % 2 else "episodes", [], [str(i), "all"], None, None, False, False, []) for i in range(300)] + [(1, 999, 0.5, 5, "evidence", ["auth"], ["z"], None, None, False, False, [])]
    asked = [(1, 100, [], ["auth"])]
    got = sel.select_constrained(*frames(spark, rows, asked)).collect()
    assert {tuple(r) for r in got} == plain(rows, asked, Constraints())
    assert len(got) == 301 and {r.record: r.state for r in got}[999] == "selected" and not any(r.reasons == "candidate_limit" for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_the_fold(spark, seed):
    """Requests larger than a task folds, of every kind of end, beside small ones."""
    rng = random.Random(seed)
    words = list("abcdefghij")
    c = Constraints(most_folded=20, most_selected=[4, 12, 6][seed], least_use=[0.0, 0.4, 0.0][seed], caps=dict(sel.CATEGORY_CAPS, evidence=6))
    rows, asked = [], []
    for q in range(24):
        n = rng.choice([5, 30, 60])
        ids = rng.sample(range(100), n)
        clash = rng.random() < 0.2
        for i in ids:
            rows.append((
                q, i, rng.choice([0.2, 0.4, 0.5, 0.9, 1.3]), rng.randint(5, 40), rng.choice(["evidence", "episodes", "decisions", "odd", None]), rng.choice([None, rng.sample(words[:5], rng.randint(0, 2))]),
                rng.choice([None, rng.sample(words, rng.randint(0, 5))]), rng.choice([None, None, "h1", "h2"]), rng.choice([None, "", "p"]), rng.choice([None, False, False, False, rng.random() < 0.2]), clash and rng.random() < 0.1, ["secret", "status"] if rng.random() < (1.0 if q == 0 else 0.1) else [],
            ))
        asked.append((q, rng.choice([30, 120, 400]), rng.choice([None, [], [ids[0]], [ids[0], ids[1]]]), rng.choice([None, [], rng.sample(words[:5], 2), ["never"]])))
    asked[0] = (0, 100, [rows[0][1]], [])
    got = sel.select_constrained(*frames(spark, rows, asked), c).collect()
    assert {tuple(r) for r in got} == plain(rows, asked, c) and len(got) == len({(r.request, r.record) for r in got})


@pytest.mark.parametrize("name", ["select_constrained", "select_sufficiency", "select_assembly"])
def test_long_conversations_match_sql(spark, tmp_path, name):
    """A conversation of 300 turns, whose best turns come last, beside a short one: the queries give the rows of their SQL."""
    duckdb = pytest.importorskip("duckdb")
    from test_oracles import rows

    from tessera.plans import content

    rng = random.Random(3)
    words = [f"{x}{'ement' * (i % 2)}{i}" for i in range(40) for x in ("alpha", "gamma")]
    turns = [(q, i, ["user", "assistant", "user"][i % 3], " ".join(rng.sample(words, rng.randint(3, 9) if i < 280 else 4)) + (" token = 5" if i % 37 == 5 else "")) for q, n in ((1, 300), (2, 6)) for i in range(n)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = content.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(content.ORACLES[name]).df()
    assert rows(got) == rows(want)
    if name == "select_constrained":
        assert len(got) == 306


def test_assembly_holds_a_turn_behind_the_best_200(spark, tmp_path):
    """Of 300 turns only one of the least useful covers the entity, so it is chosen and shown, as in SQL."""
    duckdb = pytest.importorskip("duckdb")
    from test_oracles import rows

    from tessera.plans import content

    turns = [(1, 0, "user", "marketing plan for spring token = 5")] + [(1, i, "user", "talk of marketing today as now so" if i == 250 else f"plan for spring w{i}") for i in range(1, 300)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = content.QUERIES["select_assembly"](spark, str(tmp_path)).toPandas(), con.sql(content.ORACLES["select_assembly"]).df()
    assert 250 in set(want.record) and rows(got) == rows(want)
