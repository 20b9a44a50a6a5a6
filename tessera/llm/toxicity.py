"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, CACHES, frugal

#: Buckets of hashed terms, and length of a term's factor vector.
BUCKETS, RANK = 1 << 18, 4
#: Labelled documents that the machine is fitted on at most, each by its whole text.
SAMPLE_DOCS = 12_000
#: Terms a worker remembers the bucket of (some 200 bytes each).
REMEMBERED = 80_000

_TERM = re.compile(r"[^\W\d_]+")
_terms: dict[str, int] = {}
CACHES.append(_terms)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # BUCKETS
    factors: np.ndarray  # BUCKETS x RANK

    def score(self, terms: np.ndarray) -> float:
        """Probability of the label from the buckets of a document's distinct terms."""
        v = self.factors[terms]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.bias + float(self.linear[terms].sum()) + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def term_buckets(text: str | None) -> np.ndarray:
    """Sorted buckets of the distinct lower-cased runs of letters of a whole text."""
    if len(_terms) > REMEMBERED:
        _terms.clear()
    found = set(_TERM.findall(text.lower())) if text else ()
    for t in found:
        if t not in _terms:
            _terms[t] = zlib.crc32(t.encode()) & (BUCKETS - 1)
    return np.unique(np.fromiter((_terms[t] for t in found), np.int64, len(found)))


def joint_terms(docs: list[np.ndarray], y: np.ndarray, least_docs: int) -> np.ndarray:
    """Terms of pairs whose documents have the label more, or less, often than those of either term alone.

    All pairs of terms that ``least_docs`` documents share are looked at, a term at a
    time over the documents that hold it. A pair counts if, against the documents of
    each of its terms without the other, the log-likelihood ratio of its share of
    labels passes the logarithm of the number of pairs, so chance gives about one.
    """
    names, flat = np.unique(np.concatenate(docs), return_inverse=True)
    ends = np.cumsum([0, *map(len, docs)])
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    holder = np.repeat(np.arange(len(docs)), np.diff(ends))
    holder, starts = holder[np.argsort(flat, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(names)))])
    seen = np.diff(starts)
    marked = np.bincount(flat, weights=np.repeat(y, np.diff(ends)), minlength=len(names))

    def gain(n, k, n_all, k_all):
        p, q = k / n, (k_all - k + 0.5) / (n_all - n + 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(k > 0, k * np.log(p / q), 0.0) + np.where(k < n, (n - k) * np.log((1 - p) / (1 - q)), 0.0)
        return part, p > q

    total, found = 0, []
    for i in range(len(names)):
        at = holder[starts[i] : starts[i + 1]]
        later = [rows[d][np.searchsorted(rows[d], i + 1) :] for d in at]  # a document's terms are sorted
        n = np.bincount(np.concatenate(later), minlength=len(names))
        j = np.flatnonzero(n >= least_docs)
        if not len(j):
            continue
        k = np.bincount(np.concatenate([rows[0][:0], *(x for x, d in zip(later, at, strict=True) if y[d])]), minlength=len(names))[j]
        n, total = n[j], total + len(j)
        (one, up), (two, high) = gain(n, k, seen[i], marked[i]), gain(n, k, seen[j], marked[j])
        both = np.where(up == high, np.minimum(one, two), 0.0)
        few = both > np.log(total)  # the bound only grows
        found += [(float(g), i, int(x)) for g, x in zip(both[few], j[few], strict=True)]
    picked = {t for g, i, j in found if g > np.log(total) for t in (i, j)}
    return names[sorted(picked)]


def fit_machine(rows: list[tuple[np.ndarray, int]], *, epochs: int = 12, rate: float = 0.2, least_docs: int = 4, least_z: float = 4.0, common: float = 0.1, ridge: float = 1e-4, seed: int = 7, pairs: bool = True) -> Machine:
    """Factorization machine by AdaGrad on the logistic loss, one document at a time.

    A long text holds thousands of terms that tell nothing, and their noise would add
    up, so the step of a linear weight is scaled by what the term tells alone: by the
    fourth power of its z score over ``least_z`` (the share of its documents that have
    the label against that of the rest), 1 at most, 0 under half of ``least_z`` and in
    fewer than ``least_docs`` documents. Terms in a share ``common`` of all documents step
    by a tenth at least: they tell what kind of text it is, which counts once others
    explain the label. Factors are for the terms of full scale and for those of
    joint_terms(), however neutral alone. Equal rows count once. Rows are visited in
    a seeded order, so the result depends on the rows alone. Without rows, or with
    one label only, the bias is the smoothed log-odds and all weights are 0. ``pairs``
    false fits the linear machine by itself: the rival that the factors have to beat.
    """
    rows = [(np.frombuffer(t, np.int64), label) for t, label in dict.fromkeys((t.tobytes(), label) for t, label in rows)]
    y = np.array([label for _, label in rows], float)
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    linear, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, RANK))
    if len(set(y.tolist())) < 2:
        return Machine(bias, linear, factors)
    seen = np.bincount(np.concatenate([t for t, _ in rows]), minlength=BUCKETS)
    marked = np.bincount(np.concatenate([t for t, label in rows if label]), minlength=BUCKETS)
    share, few, many = (seen + 1.0) / (len(y) + 2.0), y.sum(), len(y) - y.sum()
    z = ((marked + 0.5) / (few + 1.0) - (seen - marked + 0.5) / (many + 1.0)) / np.sqrt(share * (1 - share) * (1 / few + 1 / many))
    often = seen >= least_docs
    scale = np.where(often & (np.abs(z) >= least_z / 2), np.minimum(1.0, (np.abs(z) / least_z) ** 4), 0.0)
    scale[often & (seen >= common * len(y))] = np.maximum(0.1, scale[often & (seen >= common * len(y))])
    known = scale == 1.0
    if pairs:
        known[joint_terms([t[often[t]] for t, _ in rows], y, least_docs)] = True
    else:
        known[:] = False
    docs = [t[known[t] | (scale[t] > 0)] for t, _ in rows]
    rng = np.random.default_rng(seed)
    factors[known] = rng.normal(0, 0.01, (int(known.sum()), RANK))
    g_bias, g_linear, g_factors = 1.0, np.ones(BUCKETS), np.ones((BUCKETS, RANK))
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            t = docs[k]
            w, v = linear[t], factors[t]
            s = v.sum(axis=0)
            z = bias + w.sum() + 0.5 * float((s**2 - (v**2).sum(axis=0)).sum())
            e = 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))) - y[k]
            if abs(e) < 1e-4:
                continue
            g_bias += e * e
            bias -= rate * e / np.sqrt(g_bias)
            g = e + ridge * w
            g_linear[t] += g * g
            linear[t] = w - scale[t] * rate * g / np.sqrt(g_linear[t])
            t = t[known[t]]
            v = factors[t]
            g = e * (s - v) + ridge * v
            g_factors[t] += g * g
            factors[t] = v - rate * 0.5 * g / np.sqrt(g_factors[t])
    return Machine(float(bias), linear, factors)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE_DOCS, **how) -> Machine:
    """Machine learnt from the labelled documents of ``docs`` on the driver.

    Of labelled documents the ``sample`` with the smallest hash of (doc_id) are
    taken, by their whole texts; only the buckets of their distinct terms reach the
    driver. Rows with a null label or id are left out; of
    several labels of one id the largest holds.
    """
    marks = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    marks = marks.select("doc_id", "y", F.xxhash64("doc_id", F.lit(5)).alias("h")).orderBy("h", "doc_id").limit(sample)

    @frugal
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [term_buckets(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["h"], part["doc_id"], part["y"], pa.array([t.astype("<i4").tobytes() for t in found], pa.binary())], names=["h", "doc_id", "y", "t"])

    bound_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("h", "doc_id", "y", "text")
    rows = texts.mapInArrow(terms, "h bigint, doc_id bigint, y int, t binary").toLocalIterator()
    rows = sorted((r["h"], r["doc_id"], bytes(r["t"]), r["y"]) for r in rows)
    return fit_machine([(np.frombuffer(t, "<i4").astype(np.int64), y) for _, _, t, y in rows], **how)


def score_toxicity(docs: DataFrame, machine: Machine, *, key: str = "doc_id", text: str = "text", at: float = 0.3) -> DataFrame:
    """Score and prediction of every whole text.

    Returns ``key``, score (0 to 1) and predicted (1 if score >= ``at``). Only
    ``text`` is looked at: null and empty texts score as the bias alone, and equal
    texts score alike. An empty table gives an empty result; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS x (RANK + 1), whatever the input

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [round(own.score(term_buckets(t)), 9) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(scores, pa.float64())], names=["k", "score"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, score double")
    return scored.select(F.col("k").alias(key), "score", (F.col("score") >= at).cast("int").alias("predicted"))
