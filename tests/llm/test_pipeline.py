"""The pipeline held against a plain version of each stage."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import langid

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_languages(spark, docs):
    model = langid.fit_on_folds(spark.read.parquet(f"{SF}/documents.parquet"))
    words = {r.doc_id: r.w for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", langid.letters(langid.F.col("text")).cast("binary").alias("w")).collect()}
    kept = {}
    for i, d in docs.items():
        if words[i]:
            keys, counts = langid.gram_counts(bytes(words[i]))
            _, like = langid.mixture(keys, counts, model)
            if (like + math.log(langid.BUCKETS)) * counts.sum() >= corpus_pipeline.LEAST_GAIN:
                kept[i] = d
    return kept


def plain_lines(docs):
    rows = []  # doc, text, line, masked words
    for i, (text, source) in docs.items():
        for n, line in enumerate(text.split("\n")):
            words = tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
            if words:
                rows.append((i, text, n, words))
    chars = lambda w: len(" ".join(w))
    able = lambda w: len(w) >= 4 or chars(w) >= 24
    least = lambda w: 2 if len(w) >= 25 or chars(w) >= 150 else 3
    leaf = lambda w: (len(w), w[: min(6, len(w) // 2 + 1)])
    texts, own = defaultdict(set), defaultdict(set)
    for _, th, _, w in rows:
        texts[w].add(th)
        own[th].add(w)
    fam = {}
    for th, ws in own.items():
        heads = [hashlib.md5(" ".join(w[:3]).encode()).hexdigest() for w in ws if len(texts[w]) == 1]
        fam[th] = [min(h[15 * k : 15 * k + 15] for h in heads) if heads else th if len(ws) == 1 else None for k in range(2)]

    def recurs(ths, m):
        k = min(len({fam[th][j] for th in ths} - {None}) for j in range(2))
        return k >= m and k * 5 >= len(ths)

    first = {w for w, ths in texts.items() if able(w) and len(ths) > 1 and recurs(ths, least(w))}
    leaves = defaultdict(set)
    for w in texts:
        if able(w):
            leaves[leaf(w)].add(w)
    group = {w: ("t", w) for w in first}
    for at, ws in leaves.items():
        if len(ws) < 2 or len(set().union(*(texts[w] for w in ws))) < 2:
            continue
        weight, need = Counter(), defaultdict(lambda: 3)
        for w in ws:
            for p, tok in enumerate(w):
                weight[p, tok] += len(texts[w])
                need[p, tok] = min(need[p, tok], least(w))
        kept = {x for x in weight if weight[x] >= need[x]}
        alike = [w for w in ws if sum((p, tok) in kept and tok != "<*>" for p, tok in enumerate(w)) >= len(w) * 0.7]
        holes = {p for w in alike for p, tok in enumerate(w) if (p, tok) not in kept}
        shapes = defaultdict(list)
        for w in alike:
            one = tuple(tok if (p, tok) in kept and p not in holes else "<*>" for p, tok in enumerate(w))
            two = tuple(tok if (p, tok) in kept else "<*>" for p, tok in enumerate(w))
            shapes[one if sum(tok != "<*>" for tok in one) >= len(w) * 0.7 else two].append(w)
        for g, some in shapes.items():
            if recurs(set().union(*(texts[w] for w in some)), min(map(least, some))):
                group |= {w: ("g", at, g) for w in some}
    found = defaultdict(list)
    for i, _, n, w in rows:
        if w in group:
            found[group[w]].append((i, n))
    gone = {x for g in found.values() for x in sorted(g)[1:]}
    out = {}
    for i, (text, source) in docs.items():
        lines = text.split("\n")
        left = "\n".join(x for n, x in enumerate(lines) if (i, n) not in gone)
        if len(left) == len(text) or WORD.search(left):
            out[i] = (left, source)
    return out


def plain_near(docs):
    sets = {}
    for i, (text, _) in docs.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and root(a) != root(b):
                m = len(sets[a] & sets[b])
                if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m):
                    x, y = sorted((root(a), root(b)))
                    group[y] = x
    return {i: d for i, d in docs.items() if root(i) == i}


def plain_mix(docs):
    size = {i: len(WORD.findall(t)) for i, (t, _) in docs.items()}
    total = Counter()
    for i, (_, s) in docs.items():
        total[s] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    target, left = {}, 1.5 * sum(total.values())
    open_ = set(total)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over

    def key(i, text):
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        noise = len(re.findall(r"[%*&$#@^~|<>=_{}\[\]\\!]", text))
        return -math.log(u) / max(0.05, 1.0 - noise / max(1, len(text)))

    copies = Counter()
    for s in total:
        own = sorted(((key(i, t), i) for i, (t, x) in docs.items() if x == s))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, run, out = target[s] - epochs * total[s], 0, []
        for k, i in own:
            copies[i] = epochs
            run += size[i]
            if run <= rest:
                copies[i] += 1
            else:
                out.append((k, i))
        gap = rest - sum(size[i] for k, i in own if copies[i] > epochs)
        near = [(abs(size[i] - gap), k, i) for k, i in out if size[i] and abs(size[i] - gap) < gap]
        if near:
            copies[min(near)[2]] += 1
    return copies


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = plain_languages(spark, docs)
    kept = plain_near(plain_lines(kept))
    copies = plain_mix(kept)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, (text, _) in kept.items():
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        n = len(ids) // 4
        first = (n - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, n, 1024)]):
            own = ids[4 * start : 4 * (start + 1024 if piece else first)]
            want[i, piece, start, len(own) // 4, zlib.crc32(own)] += copies[i]
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == +want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.line_dedup(spark, docs, SF).columns == docs.columns


def test_languages_kept_and_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {}
    for r in docs.where("lang is not null").collect():
        by.setdefault(r.lang, r.text)
    mixed = " ".join(" ".join(by[k].split()[:n]) for k, n in (("en", 45), ("fr", 30), ("de", 25)))
    extra = [(-1, mixed), (-2, "съешь же ещё этих мягких французских булок да выпей чаю " * 5), (-3, "Of."), (-4, "1234 !!"), (-5, None)]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, more, SF).collect()}
    assert {i for i in range(-5, 0) if i in kept} == {-1, -3}
    assert kept >= {r.doc_id for r in docs.where("text rlike '[a-z]'").collect()}


ODD = [
    (1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 2, "x"), (3, " \n\t ", "en", "a", 5, 3, "x"), (4, "lorem ipsum dolor sit amet " * 5000, "en", "b", 130000, 4, "x"),
    (None, "one text without an id of its own", "en", "a", 34, 5, "x"), (None, "and some other text that has no id either", "en", "a", 41, 6, "x"), (None, None, None, None, None, 7, "x"),
    (7, "twice the very same row is in the table", "en", "b", 39, 8, "x"), (7, "twice the very same row is in the table", "en", "b", 39, 8, "x"), (7, "but this one has its id and another text", "en", None, 40, 9, "x"), (8, "x" * 50000, None, "c", 50000, 10, "x"),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, th string")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    rows = out.collect()
    texts = [t for _, t, *_ in ODD]
    if name == "pack":
        assert len({r.rid for r in rows}) == len(ODD) and sum(r.piece == 0 for r in rows) == len(ODD)
        return
    assert out.columns == docs.columns
    left = Counter((r.doc_id, r.text, r.row) for r in rows)
    if name == "language_id":  # learnt from these very rows
        assert not any(r.text is None or not re.search("[a-z]", r.text) for r in rows) and {8, 9} <= {r.row for r in rows}
    if name == "line_dedup":
        assert left == Counter((r[0], r[1], r[5]) for r in ODD)
    if name == "near_duplicates":
        assert left == Counter({(r[0], r[1], r[5]) for r in ODD})
    if name == "mix_sources":
        assert {r.text for r in rows} <= set(texts) and max(left.values()) <= 4


def test_line_dedup_drops_what_has_no_word_left(spark):
    texts = ["the same line is in each\n\tof three documents\n" + x for x in ("first alone in this text", "second alone in this text")] + ["the same line is in each\n \t"] * 1 + ["third alone in this\nthe same line is in each"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert 2 not in out and out[3].text == "third alone in this" and out[3].n_chars == 19 and out[0].text == texts[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
