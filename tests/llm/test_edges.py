"""Defined results for nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, linedup, media, mixing, ngram_join, packing, pii, sharding, topk, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid int, row string, key string, size int, th string, n int, t string, words string, k string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(texts):
    return [(i, t, l, s, len(t) if t else None, 1, "x", "y", 2, "z", 3, "w", "v", "u") for i, t, l, s in texts]


LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, LONG, "en", "b"), (5, "same words here now", "en", None), (6, "same words here now", "fr", "a"),
        (None, "a row without id", "en", "a"), (None, None, None, None), (7, "twice the same row", "en", "b"), (7, "twice the same row", "en", "b"), (8, "1234 !!! ***", "en", "b"), (9, "x" * 100_000, None, "c"),
    ]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_packing(odd, empty):
    out = packing.pack_documents(odd, TOKENIZER, capacity=64, keep_ids=True).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (r.rid, r.piece)):
        assert 1 <= r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert r.start == sum(x.length for x in out if x.rid == r.rid and x.piece < r.piece)
        whole.setdefault(r.rid, []).append(r)
    assert len(whole) == 12
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_media(odd, empty):
    out = media.media_columns(odd).collect()
    assert len(out) == 12
    for r in out:
        assert len(r.payload) % 64 == 0 and len(r.payload) >= 64 and r.payload[r.n_bytes :].strip(b"\0") == b""
    by = {r.doc_id: r for r in out}
    assert by[5].media == by[6].media and by[5].fingerprint == by[6].fingerprint and by[1].n_bytes == by[2].n_bytes == 0
    assert media.media_columns(empty).count() == 0


def test_mixing(odd, empty):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == 12 and all(r.taken <= 2 * r["size"] for r in out)
    assert all(r.source_size == sum(x["size"] for x in out if x.source == r.source) for r in out)
    many = mixing.mixed_documents(odd)
    assert many.columns == odd.columns
    assert many.count() == sum(r.copies for r in out)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_sharding(odd, empty):
    out = sharding.assign_shards(odd, [1.0] * 3, [1.0] * 4).collect()
    assert len(out) == 12
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 3) for r in out)
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.assign_shards(empty, [1.0] * 3).count() == 0


def test_line_dedup(odd, empty):
    out = linedup.drop_repeated_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in odd.collect()} and out.count() == 12
    assert linedup.drop_repeated_lines(empty).count() == 0


def test_language(odd, empty):
    model = langid.fit(odd.select("text", "lang"))
    out = langid.identify(odd, model, keep=True).collect()
    assert len(out) == 12
    assert {r.row.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3, 8, None}
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty.select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (5, 1), (None, 1), (6, None)], "doc_id bigint, toxic int")
    machine = toxicity.fit_toxicity(odd, labels)
    out = toxicity.score_toxicity(odd, machine).collect()
    assert len(out) == 12 and all(0 <= r.score <= 1 for r in out)
    none = toxicity.fit_toxicity(empty, labels)
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_personal_data(odd, empty):
    out = pii.find_personal_data(odd)
    assert out.count() == 12 and all(not r.base and not r.added for r in out.collect())
    assert pii.find_personal_data(empty).count() == 0


def test_ngram_join(odd, empty):
    out = ngram_join.ngram_jaccard_components(odd, words=3, num=90).collect()
    assert len(out) == 12
    by = {r.doc_id: r for r in out if r.doc_id}
    assert by[5].component_id == by[6].component_id == 5 and by[2].component_id == 2 and by[2].n_shingles == by[3].n_shingles == 0 and by[9].n_shingles == 1
    left = ngram_join.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert ngram_join.ngram_jaccard_components(empty).count() == 0


def test_near_duplicates_drop_rows_not_ids(spark):
    a, b, c = ("the first text of eight words is here", "another text that links with nothing at all", "a third one that is held by several rows")
    rows = [(None, a, "x"), (None, b, "x"), (None, a, "y"), (1, c, "x"), (1, b + " but longer by far than it was", "x"), (2, c, "x"), (3, a, "x"), (4, c, "x"), (4, "only here and nowhere else in the table", "x"), (None, "", "x"), (None, None, "x"), (5, "twice the same row it is", "z"), (5, "twice the same row it is", "y")]
    left = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), words=3, num=80)
    gone = [(None, a, "x"), (None, a, "y"), (2, c, "x"), (4, c, "x"), (5, "twice the same row it is", "z")]
    assert left.columns == ["doc_id", "text", "source"]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in rows if r not in gone)


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash"))
    out = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id in (1, 6)"), 3).orderBy("rank").collect()]
    assert out == [(1, 1, 3, 65536), (1, 2, 8, 65536), (1, 3, 8, 65536)]
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0
    few = topk.top_k(v.where("vec_id <= 2"), v.where("vec_id = 1"), 5).collect()
    assert [(r.vec_id, r.score) for r in few] == [(2, 32768)]
    huge = spark.createDataFrame([(1, [1e12, 1.0]), (2, [3.0, -1.0])], "vec_id bigint, embedding array<double>")
    assert topk.top_k(huge, huge.where("vec_id = 1"), 1).first().score == 256 * 10**12 * 768 - 256 * 256


def test_top_k_of_queries_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.25]), (3, [0.25, 0.5])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 1"), 2, shard=2).collect())
    assert got == [(1, 1, 2, 32768), (1, 1, 3, 32768), (1, 2, 2, 16384), (1, 2, 3, 16384)]
