"""Semantic search, candidates, partners, lifecycles and ignore rules against plain Python."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from tessera.operators import candidates, lifecycle, semantic
from tessera.sources.ignore import ignored

DAY = datetime(2024, 1, 1)


# --- random indexing


def unit(v):
    n = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / n for k, x in v.items()} if n else {}


def base(term):
    v = Counter()
    for j in range(8):
        h = int(sha256(term.encode()).hexdigest()[4 * j : 4 * j + 4], 16)
        v[h % 256] += 1 if h % 2 == 0 else -1
    return unit({k: x for k, x in v.items() if x})


def plain_vectors(docs, most):
    order = sorted((int(md5(str(k).encode()).hexdigest()[:4], 16) % 64, k) for k in docs)
    words = {k: t.lower().split() for k, t in docs.items()}
    total = Counter(w for t in words.values() for w in t)
    seen, out, taken = Counter(), {w: Counter(base(w)) for w in total}, set()
    for _, k in order:
        for i, w in enumerate(words[k]):
            n = seen[w]
            seen[w] += 1
            if total[w] > most and n % -(-total[w] // most):
                continue
            taken.add((k, i))
            near = words[k][max(0, i - 5) : i] + words[k][i + 1 : i + 6]
            for x in near:
                for dim, v in base(x).items():
                    out[w][dim] += 0.3 / len(near) * v
    return {w: unit(v) for w, v in out.items()}, taken


@pytest.mark.parametrize("most", [2, 7, 512])
def test_term_vectors(spark, most):
    rng = random.Random(most)
    docs = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "the", "the"]) for _ in range(rng.randint(1, 14))) for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "k bigint, text string")
    want, taken = plain_vectors(docs, most)
    assert {(r.k, r.pos) for r in semantic.sampled_occurrences(df, "k", most).collect()} == taken
    got = {}
    for r in semantic.term_vectors(df, "k", most).collect():
        got.setdefault(r.term, {})[r.dim] = r.v
    assert set(got) == set(want)
    for w in want:
        assert {d: round(v, 9) for d, v in got[w].items() if abs(v) > 1e-12} == {d: round(v, 9) for d, v in want[w].items() if abs(v) > 1e-12}


def test_semantic_search_finds_what_stands_in_like_places(spark):
    rows = [(0, "store keeps sql rows"), (1, "store keeps sql rows"), (2, "a database of storage pages"), (3, "green apples fall down"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "k bigint, text string")
    got = {r.k: r for r in semantic.semantic_search(df, "k", "0").collect()}
    assert got[1].score == 1.0 and got[1].minhash == 1.0 and 3 not in got or got[3].score < 0.2
    assert 4 not in got and 5 not in got
    more = {r.k: r.overlap for r in semantic.semantic_search(df, "k", "0", aliases={"sql": ("database", "storage")}).collect()}
    assert got[2].overlap == 0 if 2 in got else True
    assert more[2] == round(2 / 6, 6)


def test_slot_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], []), ([None, "b"], ["x", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(semantic.slot_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


# --- candidates


def test_exact_candidates(spark):
    requests = spark.createDataFrame([("q", ["b", "x", "a", "b"]), ("r", []), ("s", None)], "request string, ids array<string>")
    records = spark.createDataFrame([("a",), ("b",), ("b",)], "record string")
    assert sorted((r.request, r["rank"], r.id, r.record) for r in candidates.exact_candidates(requests, records).collect()) == [("q", 1, "b", "b"), ("q", 2, "x", None), ("q", 3, "a", "a")]


def plain_fill(found, edges, limit, per_file, near_per_file):
    out, seen, files = [], set(), Counter()
    direct = []
    for r in sorted(found, key=lambda r: (r["rank"], r["id"])):
        if r["id"] in seen or files[r["file"]] >= per_file:
            continue
        files[r["file"]] += 1
        seen.add(r["id"])
        out.append((r["id"], "direct"))
        direct.append(r)
        if len(out) >= max(1, min(limit, math.ceil(limit * 0.75))):
            break
    if len(out) >= limit:
        return out
    rank = {"file": 0, "symbol": 1}
    near, files = set(), Counter()
    for r in sorted(direct, key=lambda r: (rank.get(r["kind"], 4), -r["score"], r["id"])):
        for e in sorted((e for e in edges if r["id"] in (e["src"], e["dst"])), key=lambda e: (candidates.EDGE_PRIORITY.get(e["kind"], 10), e["id"])):
            if e["id"] in near or files[e["file"]] >= near_per_file:
                continue
            near.add(e["id"])
            files[e["file"]] += 1
            out.append((e["id"], "neighbour"))
            if len(out) >= limit:
                return out
    return out


@pytest.mark.parametrize("seed", range(4))
def test_graph_candidates_fill_in_sequence(spark, seed):
    rng = random.Random(seed)
    nodes = [{"request": 1, "rank": i, "id": f"n{i}", "kind": rng.choice(["file", "symbol", "edge"]), "file": f"f{rng.randrange(4)}", "score": rng.choice([0.5, 1.0, 2.0])} for i in range(12)]
    edges = [{"id": f"e{i:02}", "kind": rng.choice(["imports", "calls", "contains", "odd"]), "src": f"n{rng.randrange(14)}", "dst": f"n{rng.randrange(14)}", "file": f"f{rng.randrange(8)}"} for i in range(60)]
    limit = rng.choice([1, 5, 9])
    f = spark.createDataFrame([tuple(n.values()) for n in nodes], "request int, rank int, id string, kind string, file string, score double")
    e = spark.createDataFrame([tuple(x.values()) for x in edges], "id string, kind string, src string, dst string, file string")
    got = [(r.id, r.origin) for r in candidates.graph_candidates(f, e, limit).orderBy("place").collect()]
    assert got == plain_fill(nodes, edges, limit, 2, 1)


@pytest.mark.parametrize("seed", range(3))
def test_best_partners(spark, seed):
    rng = random.Random(seed)
    rows = [(i, sorted({rng.choice("abcdefghijklmnop") + (rng.choice("xyz") if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 9))})) for i in range(40)] + [(100, ["only", "here"]), (101, []), (102, ["a", "b"]), (103, ["a", "b"])]
    want = {}
    for k, a in rows:
        best = None
        for o, b in rows:
            both = len(set(a) & set(b))
            if o != k and both:
                s = math.floor(both / (len(a) + len(b) - both) * 1000 + 0.5) / 1000
                if s > 0 and (best is None or s > best[1]):
                    best = (o, s)
        if best:
            want[k] = best
    got = {r.k: (r.partner, r.score) for r in candidates.best_partners(spark.createDataFrame(rows, "k bigint, tokens array<string>"), "k").collect()}
    assert got == want
    assert candidates.best_partners(spark.createDataFrame([], "k bigint, tokens array<string>"), "k").count() == 0


def test_ages(spark):
    row = spark.createDataFrame([(DAY, DAY + timedelta(days=60)), (DAY + timedelta(days=9), DAY)], "a timestamp, b timestamp")
    got = row.select(F.round(candidates.decay(F.col("a"), F.col("b")), 6), candidates.recency(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(round(math.exp(-1), 6), 1 / 61), (1.0, 1.0)]


# --- lifecycle


def plain_judge(events):
    state, out = "proposed", []
    closed = ("quarantined", "rejected", "retracted", "expired")
    name = {"verify": "verified", "activate": "active", "reject": "rejected", "supersede": "superseded", "retract": "retracted", "expire": "expired", "quarantine": "quarantined"}
    for op, evidence, confirmed in events:
        bad = (
            op not in name or (op == "verify" and (state in closed or not evidence)) or (op == "activate" and (state in closed or state == "superseded" or (state != "verified" and not confirmed)))
            or (op == "reject" and state == "active") or (op == "supersede" and state != "active") or (op == "retract" and state not in ("active", "verified"))
        )
        out.append((state, state if bad else name[op], bad))
        state = out[-1][1]
    return out


@pytest.mark.parametrize("chunk", [1, 4, 1024])
def test_lifecycle_is_judged_in_order(spark, chunk):
    rng = random.Random(chunk)
    keys = {k: [(rng.choice(["verify", "activate", "reject", "supersede", "retract", "verify", "activate", "odd", None] + (["expire", "quarantine"] if rng.random() < 0.1 else [])), rng.choice([True, True, False, None]), rng.random() < 0.2) for _ in range(n)] for k, n in (("hot", 90), ("a", 7), (None, 12), ("b", 1))}
    rows = [(k, i, *e) for k, es in keys.items() for i, e in enumerate(es)]
    rng.shuffle(rows)
    judged = lifecycle.judge(spark.createDataFrame(rows, "k string, i int, op string, evidence boolean, confirmed boolean"), "k", ["i"], chunk).collect()
    for k, es in keys.items():
        got = [(r.state_before, r.state, r.refused is not None) for r in sorted((r for r in judged if r.k == k), key=lambda r: r.i)]
        assert got == plain_judge(es)
    assert len(judged) == len(rows)


def test_refusals_say_why(spark):
    rows = [("a", 1, "activate", None, False), ("a", 2, "verify", False, False), ("a", 3, "verify", True, False), ("a", 4, "activate", None, False), ("a", 5, "reject", None, False), ("a", 6, "retract", None, False), ("a", 7, "verify", True, False)]
    df = spark.createDataFrame(rows, "k string, i int, op string, evidence boolean, confirmed boolean")
    judged = lifecycle.judge(df, "k", ["i"])
    assert [r.refused for r in judged.orderBy("i").collect()] == ["activation_needs_verification", "verification_needs_evidence", None, None, "active_must_be_retracted", None, "cannot_verify_retracted"]
    assert [tuple(r) for r in lifecycle.latest(judged, "k", ["i"]).collect()] == [("a", "retracted", 3, 4)]
    assert lifecycle.judge(df.where("false"), "k", ["i"]).count() == 0


# --- ignore rules


@pytest.mark.parametrize("rules, kept, gone", [
    ("*.log", ["a.txt", "log", "a.log.txt"], ["a.log", "x/y/b.log"]),
    ("/build", ["x/build", "builds"], ["build", "build/x", "build/y/z"]),
    ("build/", ["build", "x/build"], ["y/build/a", "build2/build/q"]),
    ("doc/*.txt", ["doc/a/b.txt", "x/doc/a.txt"], ["doc/a.txt"]),
    ("**/foo", ["food"], ["foo", "a/b/foo", "a/foo/x"]),
    ("a/**/b", ["ab", "c/a/b"], ["a/b", "a/x/b", "a/x/y/b/c"]),
    ("abc/**", ["abc"], ["abc/x", "abc/y/z"]),
    ("*.log\n!keep.log", ["keep.log", "x/keep.log"], ["a.log"]),
    ("!keep.log\n*.log", [], ["keep.log"]),
    ("out/\n!out/keep.txt", [], ["out/keep.txt", "out/a"]),
    ("out/*\n!out/keep.txt", ["out/keep.txt"], ["out/a"]),
    ("# no rule\n\n\\#real\n\\!bang\nsp\\ ace\n  ", ["# no rule", "x"], ["#real", "!bang"]),
    ("a?c\n[xy]z\n[!m]n", ["ac", "a/c", "az", "mn"], ["abc", "xz", "yz", "kn"]),
    ("a.b\n(c)\n$d", ["axb"], ["a.b", "(c)", "$d"]),
])
def test_rules(spark, rules, kept, gone):
    files = spark.createDataFrame([(p,) for p in kept + gone], "path string")
    got = {r.path: r.entry is not None for r in ignored(files, spark.createDataFrame([("", rules)], "folder string, text string")).collect()}
    assert got == {p: False for p in kept} | {p: True for p in gone}


def test_deeper_rules_win(spark):
    rules = spark.createDataFrame([("", "*.md\ntmp/"), ("docs", "!*.md\n/a.txt"), ("docs/old", "*.md"), ("other", None)], "folder string, text string")
    files = spark.createDataFrame([(p,) for p in ("x.md", "docs/y.md", "docs/old/z.md", "docs/a.txt", "docs/q/a.txt", "docs/tmp/keep.md", None, "x.md")], "path string")
    got = {r.path: (r.entry, r.folder, r.line) for r in ignored(files, rules).collect()}
    assert got == {"x.md": ("x.md", "", 0), "docs/y.md": (None,) * 3, "docs/old/z.md": ("docs/old/z.md", "docs/old", 0), "docs/a.txt": ("docs/a.txt", "docs", 1), "docs/q/a.txt": (None,) * 3, "docs/tmp/keep.md": ("docs/tmp", "", 1)}


def test_dense_top_k_in_tiles(spark):
    """Tiles smaller than the block give the same rows, ties and copies among them, by brute force."""
    import numpy as np

    from tessera.operators import search

    rng = np.random.default_rng(5)
    e = rng.normal(size=(60, 4)).round(1)
    e[20:40] = e[3]  # more copies than k
    e[50] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "vec_id bigint, embedding array<double>")
    want = set()
    for q in range(0, 60, 5):
        norm = [np.sqrt((e[q] * e[q]).sum()) * np.sqrt((v * v).sum()) for v in e]
        s = [(-round(float(e[q] @ e[i]) / norm[i], 5), i) for i in range(60) if i != q and norm[i]]
        want |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(s)[:4], 1)}
    got = search.dense_cosine_top_k(df, df.where("vec_id % 5 = 0"), 4, block=5, part=30, tile=3).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_dense_top_k_holds_no_block_by_batch_matrix(spark, tmp_path):
    """3000 queries meet 9000 vectors in one task, whose Python stays under 300 MB more than it had."""
    import resource

    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessera.operators import search

    v = spark.range(9000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + i)).alias("embedding"))
    search.dense_cosine_top_k(v, v.where("vec_id % 3 = 0"), 5).write.mode("overwrite").parquet(str(tmp_path / "out"))

    def peak(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024] * min(1, b.num_rows), pa.int64())})

    # workers are used again, so theirs is the peak of the search too
    assert max(r.mb for r in spark.range(0, 64, 1, 16).mapInArrow(peak, "mb bigint").collect()) < 600


def test_best_partners_by_small_parts_without_pairs(spark):
    """Rows that share their common tokens with all others: the same by brute force, whatever the parts, and no join makes pairs of rows."""
    rng = random.Random(9)
    rows = [(i, rng.sample(range(30), 12)) for i in range(120)] + [(500, [99]), (501, None), (None, [1, 2])]
    df = spark.createDataFrame([(k, t and [f"t{x}" for x in t]) for k, t in rows], "k bigint, tokens array<string>")
    made = candidates.best_partners(df, "k", part=100, least=3)
    want = {}
    for k, a in rows[:120]:
        scores = [(-math.floor(2000 * len(set(a) & set(b)) / (2 * len(set(a) | set(b))) + 0.5) / 1000, o) for o, b in rows[:120] if o != k and set(a) & set(b)]
        want[k] = (min(scores)[1], -min(scores)[0])
    assert {r.k: (r.partner, r.score) for r in made.collect()} == want
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_best_partners_of_rows_of_common_tokens(spark):
    """24,000 rows of two thirds of the same 120 tokens and a few rare ones, some keys twice: as by a product of matrices,
    in a time that an index of such tokens (31 billion meetings) can't reach."""
    import time

    import numpy as np

    rng = np.random.default_rng(5)
    held = np.hstack([rng.random((24_000, 120)) < 2 / 3, rng.random((24_000, 400)) < 0.01])
    keys = np.arange(24_000)
    keys[5:9] = 3
    df = spark.createDataFrame([(int(k), np.flatnonzero(h).astype(str).tolist()) for k, h in zip(keys, held, strict=True)], "k bigint, tokens array<string>").repartition(4).localCheckpoint()
    began = time.monotonic()
    got = {r.k: (r.partner, r.score) for r in candidates.best_partners(df, "k").collect()}
    spent = time.monotonic() - began
    m, n = held.astype(np.float32), held.sum(1)
    for k in (0, 3, 4, 700, 23_999):
        best = None
        for i in np.flatnonzero(keys == k):
            both = (m @ m[i]).astype(int)
            union = n + n[i] - both
            score = np.where(keys == k, 0, (2000 * both + union) // (2 * union))
            mine = (-int(score.max()), int(keys[score == score.max()].min()))
            best = min(best or mine, mine)
        assert got[k] == (best[1], -best[0] / 1000)
    assert len(got) == 24_000 - 4 and spent < 15, spent
