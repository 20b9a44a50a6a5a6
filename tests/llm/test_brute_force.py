"""Operators held against plain Python on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import langid, linedup, media, ngram_join, packing, pii, queries, topk, toxicity

SF = "/root/testdata/sf0.001"
random.seed(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for r in docs.collect()}
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == want
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= 1.03 * total / 1024 + 2


@pytest.mark.parametrize("text", ["", " a", "a ", "a  b", "x\n y", "it's 's  ok<|endoftext|>z", " a b　c", "a\tb c\x0bd", "don't 'll 've", "é ́x", "  a", "naïve café"])
def test_chunks_encode_as_whole_texts(text):
    import pyarrow as pa

    c = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [list(x) for x in c.encode(pa.array([text]))] == [list(x) for x in c.whole([text])]


def test_sum_of_squares_rule():
    sizes = np.array([random.randint(1, 16) for _ in range(300)])
    bins, _ = packing.sum_of_squares(sizes, 16)
    level, count = {}, Counter()
    for s, b in zip(sizes.tolist(), bins.tolist()):
        def after(gap):
            c = count.copy()
            if gap < 16:
                c[gap] -= 1
            if gap > s:
                c[gap - s] += 1
            return sum(v * v for v in c.values())
        options = [g for g in range(s, 16) if count[g] > 0] + [16]
        gap = 16 - level.get(b, 0)
        assert after(gap) == min(after(g) for g in options)
        if gap < 16:
            count[gap] -= 1
        if gap > s:
            count[gap - s] += 1
        level[b] = level.get(b, 0) + s
    assert max(level.values()) <= 16


def test_chunks_that_do_not_open_with_a_space_token(monkeypatch):
    import pyarrow as pa

    c = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three", "two four two", "five", "three three one two"]
    want = [list(x) for x in c.whole(texts)]
    c.opens[c.whole([" two"])[0][0]] = False  # as if its token did not begin with the space
    assert c._learnt(["one", "two", "three"])[1] is None
    assert [list(x) for x in c.encode(pa.array(texts))] == want


def test_remembered_chunks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 2000)
    c = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(20):
        texts = [f"a{k}x b{k}x a{k}x b{k}x c{k}", "d e f d e f"]
        assert [list(x) for x in c.encode(pa.array(texts))] == [list(x) for x in c.whole(texts)]
    assert len(c.known) < 20


def test_media_digests(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.op2_media_columns(spark, SF).collect():
        raw = texts[r.doc_id]
        padded = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        wav = media.to_wav(padded)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())


def test_fingerprint_finds_an_excerpt():
    rng = np.random.default_rng(0)
    long, other = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    t, c = media.fingerprint(long)
    u, d = media.fingerprint(long[128 * 100 : 128 * 250])
    shift = Counter(int(a) - int(b) for a, x in zip(t, c) for b, y in zip(u, d) if x == y).most_common(1)[0]
    assert shift[0] == 100 and shift[1] > 0.8 * len(d)
    e = set(media.fingerprint(other)[1].tolist())
    assert len(e & set(d.tolist())) < 0.2 * len(e)


def luhn_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("signs", ["a@.-_1", "1.2", "12 -", "+1 ().-2", "a1@.+ -(é²"])
def test_base_patterns(signs):
    for _ in range(4000):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 40)))
        assert pii.base_spans(text) == luhn_spans(text)


def test_personal_data_query(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op8_pii_bootstrap(spark, SF).collect():
        spans = luhn_spans(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"you may call me at +1 212 555 {1000 + i} or so") for i in range(8)] + [(20, "you may call me at 212-555-7777 or so"), (21, "item 212-555-8888 of stock"), (22, "nothing here at all")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s.start, s.end) for s in out[20].added] == [(19, 31)] and not out[21].added and not out[22].added
    assert all(len(out[i].base) == 1 for i in range(8))


def plain_added(texts, rounds=3, least=5, confidence=0.6):
    mentions = {i: pii.mentions_of(t, pii.base_spans(t)) for i, t in texts.items()}
    edges, totals = Counter(), Counter()
    known = {}
    for i, own in mentions.items():
        for m in own:
            if m["shape"] is not None:
                totals[m["shape"]] += 1
            if m["known"] or m["able"]:
                key = (m["kind"], m["instance"])
                for p in m["patterns"] + ([m["shape"]] if m["shape"] is not None else []):
                    edges[m["kind"], p, m["instance"]] += 1
                    known[(m["kind"], p, m["instance"])] = known.get((m["kind"], p, m["instance"]), False) or m["known"]
    for t in texts.values():
        h = np.array([pii._word_hash(w) for w in t.split()], np.uint64)
        if len(h) > 1:
            for made in (pii._context(h)[:-1], pii._single(h[:-1], pii.BEFORE), pii._single(h[1:], pii.BEHIND)):
                totals.update(made.view(np.int64).tolist())
    score = {}
    for (k, p, x), sure in known.items():
        score[k, x] = max(score.get((k, x), 0.0), float(sure))
    trust = {}
    for _ in range(rounds):
        mass, seeds = Counter(), Counter()
        for (k, p, x), n in edges.items():
            mass[k, p] += n * score[k, x]
            seeds[k, p] += score[k, x] >= confidence
        trust = {kp: min(1.0, mass[kp] / totals[kp[1]]) if seeds[kp] >= least else 0.0 for kp in mass}
        new = {}
        for (k, p, x), sure in known.items():
            new[k, x] = max(new.get((k, x), 0.0), 1.0 if sure else trust[k, p])
        score = new
    out = {}
    for i, own in mentions.items():
        for m in own:
            used = m["patterns"] + ([m["shape"]] if m["shape"] is not None else [])
            if m["able"] and score.get((m["kind"], m["instance"]), 0) >= confidence and any(trust[m["kind"], p] >= confidence for p in used):
                out.setdefault(i, []).append((m["start"], m["kind"], m["end"]))
    return {i: sorted(v) for i, v in out.items()}


def test_added_spans_match_a_plain_version(spark):
    rng = random.Random(9)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    cards = ["4539578763621486", "4916338506082832", "4485275742308327", "4556737586899855", "4024007103939509", "4532015112830366"]
    for k in range(40):
        texts[10_000 + k] = f"{prose(rng, 5)} tel: +1 (212) 555-{1000 + k} 10.0.0.{k} {prose(rng, 3)} card {cards[k % 6]} {prose(rng, 2)}"
    texts[20_000] = f"{prose(rng, 4)} 1111222233334444 {cards[0]} {prose(rng, 3)}"  # the base patterns take both numbers for one
    texts[20_001] = f"{prose(rng, 4)} room 1234567890123456 {prose(rng, 3)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.added] for r in pii.find_personal_data(docs).collect() if r.added}
    want = plain_added(texts)
    assert got == want and len(want) >= 40
    assert [(texts[20_000][a:b], k) for a, k, b in got[20_000]] == [(cards[0], 2)] and 20_001 not in got


def components(sets, num, den):
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                m = len(sets[a] & sets[b])
                if den * m >= num * (len(sets[a]) + len(sets[b]) - m):
                    x, y = sorted((root(a), root(b)))
                    group[y] = x
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_ngram_components(spark, words, num, monkeypatch):
    base = [[f"w{random.randint(0, 900)}" for _ in range(random.randint(4, 120))] for _ in range(8)]
    texts = []
    for i in range(90):
        t = list(random.choice(base))
        for _ in range(random.choice((0, 0, 1, 1, 2, 4))):
            t[random.randrange(len(t))] = f"x{random.randint(0, 9)}"
        texts.append((i, " ".join(t)))
    texts += [(90, "Two words"), (91, "two WORDS"), (92, "two"), (93, "")]
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    want = components(sets, num, 100)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.ngram_jaccard_components(df, words=words, num=num).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in sets}
    monkeypatch.setattr(ngram_join, "CHUNK_MEMBERS", 3)  # every group in pairs of chunks
    made = []
    monkeypatch.setattr(ngram_join, "_tasks", lambda m, *by, f=ngram_join._tasks: made.append((m, f(m, *by))) or made[-1][1])
    monkeypatch.setattr(ngram_join, "drop_table", lambda df: None)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(df, words=words, num=num).collect()}
    assert got == want
    for members, tasks in made:  # pairs of chunks whose sizes cannot link are not made
        apart = -np.log(num / 100) * 2.001
        if "n" in tasks.columns:
            for r in tasks.groupBy("key", "i", "j").agg(ngram_join.F.min("n").alias("a"), ngram_join.F.max("n").alias("z")).collect():
                assert r.i == r.j or np.log(r.z / r.a) <= apart


@pytest.mark.parametrize("num", [50, 80, 90])
def test_linked_sets_share_a_key(num):
    rng = random.Random(num)
    for _ in range(300):
        n = rng.choice([rng.randint(1, 12), rng.randint(1, 300)])
        pool = np.array(rng.sample(range(1 << 60), n + 60), np.uint64)
        x, gone, new = pool[:n], rng.randint(0, n // 2), rng.randint(0, 60)
        y = np.concatenate([x[gone:], pool[n : n + new]])
        if len(y) and num * (len(x) + new) <= 100 * (n - gone):
            assert set(ngram_join.partition_keys(np.sort(x), num, 100)) & set(ngram_join.partition_keys(np.sort(y), num, 100))


def test_small_and_large_groups_hold_every_link():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, rng.integers(3, 300), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > p], rng.integers(0, 1 << 62, int(p * len(base)), dtype=np.uint64)])) for p in (0.0, 0.02, 0.1, 0.3)]
    sets = [x for x in sets if len(x)]
    rows = sorted((int(rng.integers(0, 9)), 0, 0, 0, k, len(x), ngram_join.bitmap(x, ngram_join.width(len(x))).tobytes()) for k, x in enumerate(sets))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 6 + (pa.binary(),))], names=["key", "i", "j", "chunk", "a", "n", "bits"])

    def parts(small, step):
        out = ngram_join._may_link(80, 100, small)(batch.slice(k, step) for k in range(0, len(batch), step))
        group = {k: k for k in range(len(sets))}
        for b in out:
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                a, c = group[x], group[y]
                group = {k: min(a, c) if v in (a, c) else v for k, v in group.items()}
        return group

    # trees fold wide bitmaps, so they may hold a few more pairs together
    pairs, trees, some = parts(1000, 1000), parts(1, 7), parts(20, 50)
    key = {k: g for g, _, _, _, k, _, _ in rows}
    for a in range(len(sets)):
        for b in range(a):
            m = len(np.intersect1d(sets[a], sets[b]))
            if key[a] == key[b] and 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m):
                assert pairs[a] == pairs[b] and trees[a] == trees[b] and some[a] == some[b]
    assert len(set(pairs.values())) > 100


def test_kd_tree_search():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-50, 50, (500, 6)), np.repeat(rng.integers(-50, 50, (1, 6)), 200, axis=0)])
    tree = topk.KDTree(np.arange(700), v)
    for q in range(0, 700, 70):
        want = sorted(((-int(v[i] @ v[q]), i) for i in range(700) if i != q))[:5]
        assert [(-s, i) for s, i in tree.search(q, v[q], 5, None)] == want
        assert [(-s, i) for s, i in tree.search(q, v[q], 5, -want[4][0])] == want


def test_languages_of_mixed_texts(spark, docs):
    model = langid.fit(docs.select("text", "lang"))
    by = {}
    for r in docs.where("lang is not null").collect():
        by.setdefault(r.lang, []).append(r.text)
    mixed = [(0, " ".join(by["en"][0].split()[:150] + by["fr"][0].split()[:150])), (1, by["de"][1])]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(mixed, "doc_id int, text string"), model).collect()}
    assert set(out[0].langs) == {"en", "fr"} and min(out[0].proportions) > 0.3 and out[1].langs == ["de"]


def test_held_out_accuracy(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in queries.op10_language_mixture(spark, SF).collect() if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out]) >= 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in queries.op5_toxicity_fm(spark, sf).collect() if r.held_out and r.doc_id in marks]
    toxic, clean = [r.score for r in out if marks[r.doc_id]], [r.score for r in out if not marks[r.doc_id]]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9


def test_toxicity_scores_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(-0.3, rng.normal(0, 0.2, toxicity.BUCKETS), rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.RANK)))
    texts = ["", None, "one", "One two, two THREE", "Été à la plage", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(6000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in toxicity.score_toxicity(docs, machine).collect():
        t = sorted({zlib.crc32(w.encode()) & (toxicity.BUCKETS - 1) for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())})
        v = machine.factors[t]
        z = -0.3 + machine.linear[t].sum() + (np.triu(v @ v.T, 1).sum() if len(t) else 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_pairs_find_what_a_linear_machine_misses(spark):
    """Against a linear machine fitted by itself on the same rows: more toxic documents at the cut, no more false alarms."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learnt = labels.where(~langid.held_out(langid.F.col("doc_id"), 4, 2))
    held = docs.join(labels, "doc_id").where(langid.held_out(langid.F.col("doc_id"), 4, 2)).select("text", "toxic").collect()
    marks, terms = np.array([r.toxic for r in held]), [toxicity.term_buckets(r.text) for r in held]

    def scores(**how):
        machine = toxicity.fit_toxicity(docs, learnt, **how)
        assert how or machine.factors.any()
        return np.array([machine.score(t) for t in terms])

    area = lambda s: np.mean(s[marks == 1][:, None] > s[marks == 0][None])
    both, alone = scores(), scores(pairs=False)
    assert area(both) > 0.98 and area(alone) > 0.98
    assert ((both >= 0.3) & (marks == 1)).sum() > ((alone >= 0.3) & (marks == 1)).sum()
    assert ((both >= 0.3) & (marks == 0)).sum() <= ((alone >= 0.3) & (marks == 0)).sum()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pairs_beat_a_linear_machine_on_planted_pairs(seed):
    """Labels by insult and group together, either alone as often without: AUC on rows not learnt from."""
    rng = np.random.default_rng(seed)

    def rows(n):
        out = []
        for _ in range(n):
            insult, group = rng.random() < 0.3, rng.random() < 0.3
            terms = {*rng.integers(100, 2100, 20).tolist(), *([1] if insult else []), *([2] if group else [])}
            out.append((np.array(sorted(terms)), int(insult == group if rng.random() < 0.9 else rng.random() < 0.5)))
        return out

    learnt, held = rows(3000), rows(1500)
    marks = np.array([y for _, y in held])

    def area(machine):
        s = np.array([machine.score(t) for t, _ in held])
        return np.mean(s[marks == 1][:, None] > s[marks == 0][None])

    assert area(toxicity.fit_machine(learnt)) > area(toxicity.fit_machine(learnt, pairs=False)) + 0.1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_toxicity_of_terms_neutral_alone(seed):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(3000):
        insult, group = rng.random() < 0.05, rng.random() < 0.05
        terms = {*rng.integers(100, 2100, 20).tolist(), *([1] if insult else []), *([2] if group else [])}
        rows.append((np.array(sorted(terms)), int((insult and group) or rng.random() < 0.1)))
    machine = toxicity.fit_machine(rows)
    both, one, two = (machine.score(np.array([*t, 500, 700, 900])) for t in ((1, 2), (1,), (2,)))
    assert both > 0.5 > 0.3 > max(one, two)


def lines_left(spark, texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in linedup.drop_repeated_lines(rows, **how).orderBy("doc_id").collect()]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_a_shared_line_goes_from_short_documents(spark):
    rng = random.Random(1)
    shared = "all rights are reserved by the publisher"
    left = lines_left(spark, [prose(rng, 3) + "\n" + shared for _ in range(30)])
    assert [shared in t for t in left] == [True] + [False] * 29


@pytest.mark.parametrize("shared,own,docs", [(20, 2, 100), (10, 1, 60), (1, 1, 3), (5, 1, 40)])
def test_blocks_of_shared_lines_go(spark, shared, own, docs):
    rng = random.Random(2)
    block = [prose(rng, 8) for _ in range(shared)]
    left = lines_left(spark, ["\n".join(block + [prose(rng, 9) for _ in range(own)]) for _ in range(docs)])
    assert all(x in left[0] for x in block) and not any(x in t for x in block for t in left[1:])


def test_long_passages_go_from_the_second_document(spark):
    rng = random.Random(3)
    passage, short = prose(rng, 55), prose(rng, 6)
    texts = [prose(rng, 40) + "\n" + passage + "\n" + short + "\n" + prose(rng, 30) for _ in range(2)]
    assert [(passage in t, short in t) for t in lines_left(spark, texts)] == [(True, True), (False, True)]


def test_copies_are_left_to_document_dedup(spark):
    rng = random.Random(4)
    base = [prose(rng, 30) for _ in range(8)]
    near = []
    for _ in range(6):
        lines = [x.split() for x in base]
        for line in rng.sample(lines, 3):
            line[rng.randrange(5, 30)] = "changed" + prose(rng, 1)
        near.append("\n".join(map(" ".join, lines)))
    texts = ["\n".join(base)] * 4 + near[:1]
    assert lines_left(spark, texts) == texts


def test_variants_of_a_known_template_go(spark):
    rng = random.Random(5)
    texts = [prose(rng, 9) + f"\nplease write to the office of {name} for more" for name in ["miller"] * 5 + ["smith", "jones"]]
    assert ["office" in t for t in lines_left(spark, texts)] == [True] + [False] * 6


def test_lines_without_spaces_and_short_lines(spark):
    rng = random.Random(6)
    chinese = "本网站的所有内容均受版权法保护未经许可不得转载或者复制使用"
    texts = [prose(rng, 7) + "\n" + chinese + "\nread more" for _ in range(4)]
    assert [(chinese in t, "read more" in t) for t in lines_left(spark, texts)] == [(True, True)] + [(False, True)] * 3
    assert ["read more" in t for t in lines_left(spark, texts, min_tokens=1)] == [True] + [False] * 3
