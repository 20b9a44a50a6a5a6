"""Tiered search, bit-plane files and norm-bucketed mining: brute force, round trips, odd rows."""

import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitplanes, normsearch, tiered

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, LONG), (5, "same words here"), (6, "same words here"), (None, "words without id"), (7, "twice words"), (7, "twice words"), (8, "é ÀB-x 12"), (None, None)]
    return spark.createDataFrame([(i, t, "a", 1, 2, [3], 4, "b") for i, t in rows], "doc_id bigint, text string, rid string, n int, start int, terms array<int>, item int, path string")


# --- files of planes


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = bitplanes.to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert list(bitplanes.from_planes(planes, n, kind)) == list(ids)


def test_bit_planes_hold_one_bit_of_each_id():
    ids = np.array([1, 2, 3, 0, 0, 0, 0, 0, 1 << 31], np.uint32)
    planes = bitplanes.to_planes(ids, "bit")
    assert planes[0] == bytes([0b101, 0]) and planes[1] == bytes([0b110, 0]) and planes[31] == bytes([0, 1]) and not any(map(any, planes[2:31]))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_a_file_is_read_by_its_index(kind):
    rng, sink = random.Random(5), io.BytesIO()
    docs = [(None if i == 3 else i * 7 - 5, np.array([rng.randrange(70000) for _ in range(rng.choice([0, 1, 5, 300]))], "<u4")) for i in range(40)]
    w = bitplanes.PlaneWriter(sink, kind, block=64)
    for d, ids in docs:
        w.add(d, ids)
    size, data = w.close(), sink.getvalue()
    assert size == len(data)
    r = bitplanes.PlaneReader(pa.BufferReader(data))
    whole = np.concatenate([ids for _, ids in docs])
    ids, lengths = r.documents()
    assert ids == [d for d, _ in docs] and lengths.tolist() == [len(x) for _, x in docs]
    assert all(b[1] == 64 for b in r.index["blocks"][:-1]) and sum(b[1] for b in r.index["blocks"]) == len(whole) == r.n_ids
    for a, n in [(0, len(whole)), (63, 2), (64, 64), (100, 0), (len(whole) - 1, 1)]:
        assert list(r.ids(a, n)) == list(whole[a : a + n])
    with pytest.raises(ValueError):
        bitplanes.PlaneReader(pa.BufferReader(data[:-3]))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_round_trip(docs, kind):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    manifest = bitplanes.write_token_files(docs, TOKENIZER, kind=kind, block=1000)
    got = bitplanes.read_token_files(manifest, keep_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want
    assert manifest.agg(F.sum("n_ids")).first()[0] == at


def test_token_files_of_odd_rows(odd, tmp_path):
    manifest = bitplanes.write_token_files(odd, TOKENIZER, f"file://{tmp_path}/out")
    got = bitplanes.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1} and len({r.ids_crc32 for r in got if r.doc_id in (1, 2)}) == 1
    assert len(list((tmp_path / "out").iterdir())) == manifest.count()
    assert bitplanes.read_token_files(bitplanes.write_token_files(odd.where("false"), TOKENIZER)).count() == 0
    with pytest.raises(ValueError):
        bitplanes.write_token_files(odd, TOKENIZER, kind="nibble")


# --- tiered search


def plain_search(docs, items, k):
    term = re.compile(tiered.TERM)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = [(d, i, Counter(term.findall(low(t)))) for i, (d, t) in enumerate(docs)]
    held = [(d, i, c, c.total()) for d, i, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked = set(term.findall(low(text)))
        scored = []
        for d, i, c, n in held:
            m = 50 + 50 * n * n_docs // length
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, (d is not None, d), i))
        out += [(item, r, d[1], -s) for r, (s, d, _) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("tiers", [(), (1,), (3, 20), (1 << 40,)])
def test_search_equals_brute_force_in_every_tier(spark, docs, tiers):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)
    got = tiered.ranked_search(docs, items, 5, tiers=tiers, item_bytes=1000).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(want)
    assert {r.tier for r in got} <= set(range(len(tiers) + 1))


def test_items_without_proof_fall_through(spark):
    rare = [(i, "alpha beta " + "gamma " * 9 if i < 4 else f"alpha delta{i} filler words of many kinds here") for i in range(400)]
    common = [(1000 + i, "omega sigma " + f"pad{i} " * (i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rare + common, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "beta gamma"), (2, "alpha omega sigma")], "item_id bigint, text string")
    got = tiered.ranked_search(docs, items, 3, tiers=(8,)).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(plain_search(rare + common, [(1, "beta gamma"), (2, "alpha omega sigma")], 3))
    assert {r.item_id: r.tier for r in got} == {1: 0, 2: 1}


def test_search_of_odd_rows(spark, odd):
    asked = [(1, "SAME words"), (2, None), (3, "..."), (4, "nowhere"), (None, "twice"), (1, "SAME words"), (5, "àb 12 É é"), (6, "lorem")]
    items = spark.createDataFrame([(i, t, 0, "x") for i, t in asked], "item_id bigint, text string, item int, terms string")
    want = plain_search([(r.doc_id, r.text) for r in odd.collect()], asked, 4)
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in tiered.ranked_search(odd, items, 4).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert tiered.ranked_search(odd.where("false"), items).count() == 0 and tiered.ranked_search(odd, items.where("false")).count() == 0


@pytest.mark.parametrize("texts", [["a b", "", "C-d éÈ a"], [""], ["", "x", "   "], []])
def test_split_terms(texts):
    flat, which = tiered.split_terms(pa.array(["skipped", *texts], pa.string())[1:])
    want = [(i, t) for i, x in enumerate(texts) for t in re.findall(tiered.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), x))]
    assert list(zip(which.tolist(), flat.to_pylist())) == want


# --- hard negatives


def plain_negatives(rows, asks, positives, negatives):
    whole = [(i, k, lab, [math.floor(256 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, k, lab, v in whole:
        if not asks(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, m, other) for j, m, other, u in whole if m != k)
        for p, (s, j, _, _) in enumerate([x for x in scored if x[3] == lab][:positives], 1):
            fits = [x for x in scored if x[3] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0], p) for r, x in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("sizes", [(512, 8192, 2048), (4, 16, 3), (3, 7, 100)])
def test_negatives_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])], int(rng.integers(3))) for i in range(150)] + [(200 + i, [0.5] * 6, i % 2) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    got = normsearch.hard_negatives(v, F.col("vec_id") % 10 == 0, positives=3, negatives=4, bucket=sizes[0], stripe=sizes[1], group=sizes[2]).collect()
    want = plain_negatives(rows, lambda i: i % 10 == 0, 3, 4)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score, r.positive_rank) for r in got) == sorted(want)


def test_short_buckets_are_skipped():
    rows = [{"rid": 0, "label": 1, "v": [1.0, 0.0], "windows": [{"low": None, "high": None}]}]
    a = normsearch.Anchors(rows, 1, False, 256)
    meet = lambda rid, x: a.meet(np.array([rid]), np.array([rid]), np.array([2]), np.array([[x, 0]], np.int64))
    meet(1, 200)
    meet(2, 199)  # at most 256 * 199: below the kth score
    assert (a.seen, a.skipped) == (2, 1) and a.kept[0][0] == [(51200, 1, 1)]
    b = normsearch.Anchors([rows[0] | {"windows": [{"low": 60000, "high": 70000}]}], 1, False, 256)
    b.meet(np.array([1]), np.array([1]), np.array([2]), np.array([[200, 0]], np.int64))  # below the window's lower limit
    assert b.skipped == 1


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2), (2, [0.5, 0.25], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, None, 2), (6, [None, 1.0], 2), (7, [0.5, 0.3], None), (None, [0.5, 0.3], 2), (20, [0.2, 0.1], 3), (10, [-1.0, 0.1], 2)]
    v = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rid int, windows string")
    got = normsearch.hard_negatives(v, F.col("vec_id") % 10 == 0).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score, r.positive_rank) for r in got) == sorted(plain_negatives(rows, lambda i: i % 10 == 0, 5, 10))
    assert normsearch.hard_negatives(v.where("false"), F.lit(True)).count() == 0
    assert normsearch.hard_negatives(v, F.lit(False)).count() == 0
    huge = spark.createDataFrame([(10, [1e6, 1.0], 1), (1, [1e6, 2.0], 1), (2, [5e5, 3.0], 2)], "vec_id bigint, embedding array<double>, label int")
    assert [(r.positive_score, r.negative_score) for r in normsearch.hard_negatives(huge, F.col("vec_id") == 10).collect()] == [(65536 * 10**12 + 65536 * 2, 65536 * 5 * 10**11 + 65536 * 3)]
    with pytest.raises(ValueError):
        normsearch.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], "vec_id bigint, embedding array<double>, label int"), F.lit(True))
