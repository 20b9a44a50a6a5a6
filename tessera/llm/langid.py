"""Language identification by mixtures of per-language n-gram models, fitted by EM."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bound_batches, frugal

#: Buckets of hashed n-grams; each language has one log-likelihood a bucket.
BUCKETS = 1 << 18
#: n-grams are runs of these many bytes of lower-cased words with a space at either end.
ORDERS = (1, 2, 3, 4)
#: Documents of a language, characters of a document, and languages that a model is fitted on at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LANGS = 1500, 60_000, 64
#: Bytes of a text that are turned into n-grams at a time.
WINDOW = 1 << 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)  # odd 32-bit numbers, fixed values

#: Letters stay, everything else is a space.
_NOT_LETTERS = r"[^\p{L}\p{M}]+"


@dataclass
class Model:
    """log P(n-gram | language), languages in code point order."""

    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32


def letters(text: Column) -> Column:
    """Lower-cased words of a text with one space between; '' if it has no letter."""
    words = F.trim(F.regexp_replace(F.lower(text), _NOT_LETTERS, " "))
    return F.when(text.rlike(r"\p{L}"), words).otherwise("")  # marks alone are no letters


def gram_counts(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of lower-cased, space-separated words; whole text, a window at a time."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    data = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW + max(ORDERS) - 1]
        own = min(WINDOW, len(data) - at)
        found = []
        for n in ORDERS:
            m = min(own, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n))
            for i in range(n):
                h = (h ^ part[i : i + m]) * np.uint32(MULTIPLIERS[i])
                h ^= h >> np.uint32(15)
            found.append(h & np.uint32(BUCKETS - 1))
        got = np.unique(np.concatenate(found), return_counts=True)
        total = got if total is None else _added(total, got)
    return total


def _added(p, q):
    keys, at = np.unique(np.concatenate([p[0], q[0]]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1], q[1]])).astype(np.int64)


def fit(rows: DataFrame, *, docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS, most_langs: int = SAMPLE_LANGS, smoothing: float = 0.05) -> Model:
    """Model of each language from labelled rows (text, lang).

    Fitted on a bounded sample: of each of the ``most_langs`` languages with the most
    rows (ties in code point order) the ``docs`` documents with the smallest text
    hash, and of a longer document a window of ``most_chars`` characters at a place
    its hash tells. The candidates come from a hash threshold by the language's
    count, so no language is sorted whole; texts without letters among them teach nothing.
    """
    rows = rows.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    counts = {r["lang"]: r["n"] for r in counts}
    shares = rows.sparkSession.createDataFrame([(k, int(min(1.0, 2.0 * docs / n + 20.0 / n) * (1 << 20))) for k, n in counts.items()], "lang string, share bigint")
    some = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.col("share")).select("lang", letters(F.col("text")).alias("words"), "h")
    some = some.where("words <> ''").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))).where(F.col("r") <= docs)
    start = F.pmod(F.col("h"), F.greatest(F.length("words") - most_chars + 1, F.lit(1))) + 1
    some = some.select("lang", F.substring("words", start.cast("int"), F.lit(most_chars)).alias("words"))
    sums = {k: np.zeros(BUCKETS) for k in sorted(counts)}
    for r in some.toLocalIterator():
        keys, n = gram_counts(r["words"].encode())
        sums[r["lang"]][keys] += n
    langs = sorted(k for k, v in sums.items() if v.any())
    counted = np.stack([sums[k] for k in langs], axis=1)
    shared = counted.sum(axis=1, keepdims=True)
    prior = (shared + 0.1) / (shared.sum() + 0.1 * BUCKETS)
    logp = np.log((counted + smoothing * prior * BUCKETS * 0.01) / (counted.sum(axis=0) + smoothing * BUCKETS * 0.01))
    return Model(langs, logp.astype(np.float32))


def mixture(keys: np.ndarray, counts: np.ndarray, model: Model, *, penalty: float = 3.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Proportion of each language in a document, and its log-likelihood an n-gram.

    Each n-gram comes from one language of a set; EM estimates the set's
    proportions. The set starts with the single likeliest language and takes in
    the next one as long as the log-likelihood gains more than ``penalty`` times
    the logarithm of the number of n-grams. Of equally likely languages the
    first in code point order is taken.
    """
    logp = model.logp[keys].astype(np.float64)
    total = float(counts.sum())
    top = logp.max(axis=1)
    like = np.exp(logp - top[:, None])
    base = float(counts @ top)
    singles = counts @ logp
    chosen, best = [int(singles.argmax())], float(singles.max())
    weights = np.ones(1)
    while len(chosen) < logp.shape[1]:
        # the language that explains most of what the set explains badly
        now = like[:, chosen] @ weights
        gain = counts @ np.maximum(0.0, np.log(np.maximum(like, 1e-300)) - np.log(np.maximum(now, 1e-300))[:, None])
        gain[chosen] = -1.0
        tried = [*chosen, int(gain.argmax())]
        if gain[tried[-1]] <= penalty * np.log(total):
            break
        part = like[:, tried]
        w = np.append(weights * 0.8, 0.2)
        for _ in range(steps):
            mass = part * w
            seen = mass.sum(axis=1)
            new = (counts / np.maximum(seen, 1e-300)) @ mass / total
            done = np.abs(new - w).max() < 1e-4
            w = new
            if done:
                break
        found = base + float(counts @ np.log(np.maximum(part @ w, 1e-300)))
        if found - best <= penalty * np.log(total):
            break
        chosen, weights, best = tried, w, found
    out = np.zeros(logp.shape[1])
    out[chosen] = weights
    return out, best / total


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Language mixture of every whole text.

    Returns ``key`` (with ``keep`` the whole row instead, as the struct ``row``),
    lang_pred (the language with the largest proportion),
    score (that proportion), langs and proportions (the chosen set, largest
    first), and gain, the log-likelihood of its n-grams under the mixture less
    that under equal chances for all buckets: far below 0 where no learnt language
    explains the text. A null text, one without letters, or a model without languages
    gives ``und`` with score and gain 0 and no languages. Only ``text`` is looked at.
    Repeated rows get equal results; an empty table gives an empty result; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the input

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            cols = [[], [], [], [], []]
            for words in batch["words"].to_pylist():
                if not words or not own.langs:
                    row = ("und", 0.0, [], [], 0.0)
                else:
                    keys, counts = gram_counts(words)
                    share, like = mixture(keys, counts, own)
                    order = [int(i) for i in np.argsort(-share, kind="stable") if share[i] > 0]
                    row = (own.langs[order[0]], min(1.0, float(share[order[0]])), [own.langs[i] for i in order], [float(share[i]) for i in order], (like + float(np.log(BUCKETS))) * float(counts.sum()))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch["k"], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["k", "lang_pred", "score", "langs", "proportions", "gain"])

    bound_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.col(key)
    rows = docs.select(whole.alias("k"), letters(F.col(text)).cast("binary").alias("words"))
    schema = T.StructType([rows.schema["k"], *T._parse_datatype_string("lang_pred string, score double, langs array<string>, proportions array<double>, gain double").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", "row" if keep else key)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def fit_on_folds(docs: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """Model learnt from the documents outside the held-out fold alone."""
    return fit(docs.where(~held_out(F.col("doc_id"), folds, fold)).select("text", "lang"))
