"""Exact ranked lexical search over an index in tiers of impact."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop_table, frugal, materialize

#: Postings of each term in the first tier, at least, and how many times as many each next one
#: holds, until one would hold all.
FIRST, FACTOR = 4096, 4
#: Documents, a result wanted, whose whole scores a proof may ask for; an item that needs more
#: goes to the next tier, whose bounds are closer, and in the end to the last, which needs none.
LOOKED_UP = 16
#: Bytes of item texts that are asked together.
ITEM_BYTES = 1 << 20
#: Steps of tf saturation by which postings are counted: 10^6 / 2^12 of them.
STEP_BITS = 12
#: Scores that a task lays out at once.
CELLS = 1 << 21

#: Every byte of UTF-8 as it stands in a term, others as a space: ASCII digits and letters, the latter lower-cased, and all beyond ASCII.
LETTERS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Terms of a text, with repeats: an array, empty for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts one after the other, and each one's text. No nulls."""
    start, stop = texts.offset, texts.offset + len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[start : stop + 1]
    data = (texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b"")[offsets[0] : offsets[-1]].translate(LETTERS)
    clean = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])
    lists = pc.split_pattern(clean, " ")
    flat, which = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), which[full.to_numpy(zero_copy_only=False)]


def count_terms(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """rid, doc_id, n (terms with repeats), terms and tfs (places in ``vocabulary`` and their
    occurrences) of the documents with a term."""
    spark = docs.sparkSession
    words = pa.array(vocabulary, pa.string())
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, which = split_terms(batch["text"])
            n = np.bincount(which, minlength=batch.num_rows)
            code = pc.index_in(flat, value_set=words)
            known = pc.is_valid(code).to_numpy(zero_copy_only=False)
            key = which[known] * max(1, len(words)) + code.drop_null().to_numpy().astype(np.int64)
            key, tf = np.unique(key, return_counts=True)
            ends = np.searchsorted(key // max(1, len(words)), np.arange(batch.num_rows + 1))
            offsets = pa.array(ends, pa.int32())
            out = pa.RecordBatch.from_arrays([
                batch["rid"], batch["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(key % max(1, len(words)), pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
            ], schema=schema)
            yield out.filter(pa.array(n > 0))

    bound_batches(spark)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("rid"), "text")
    return rows.mapInArrow(run, "rid bigint, doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Weights:
    """Impacts: weight of each term, and the measures of the collection."""

    def __init__(self, w: np.ndarray, documents: int, length: int):
        self.w, self.documents, self.length = w, documents, length

    def saturation(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + 50 * n * self.documents // self.length
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of every posting of a batch."""
    lists = batch["terms"]
    which = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return which, lists.flatten().to_numpy().astype(np.int64), batch["tfs"].flatten().to_numpy().astype(np.int64)


def steps(counted: DataFrame, weights: Weights) -> DataFrame:
    """How many postings each term has in each step of saturation, and the most of the step: a
    few hundred rows a term, summed in the tasks first."""
    shift = 1 << STEP_BITS

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, term, tf = postings(batch)
            g = weights.saturation(tf, batch["n"].to_numpy()[which])
            key, at, count = np.unique(term * shift + (g >> STEP_BITS), return_inverse=True, return_counts=True)
            most = np.zeros(len(key), np.int64)
            np.maximum.at(most, at, g)
            yield pa.RecordBatch.from_pydict({"term": pa.array(key // shift, pa.int32()), "step": pa.array(key % shift, pa.int32()), "n": pa.array(count, pa.int64()), "most": pa.array(most, pa.int64())})

    rows = counted.mapInArrow(run, "term int, step int, n bigint, most bigint")
    return rows.groupBy("term", "step").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


def tier_of(counted: DataFrame, weights: Weights, least: np.ndarray) -> DataFrame:
    """The rows of ``counted`` with the postings whose step is ``least`` of their term or more; rows without any go."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, term, tf = postings(batch)
            g = weights.saturation(tf, batch["n"].to_numpy()[which])
            high = (g >> STEP_BITS) >= least[term]
            which = which[high]
            offsets = pa.array(np.searchsorted(which, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[high], pa.int32())) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], batch["n"], *lists], names=["rid", "doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.diff(offsets.to_numpy()) > 0))

    return counted.mapInArrow(run, counted.schema)


class Asked:
    """Items of a block that are still open: a row of terms each, turned round to the items of each term."""

    def __init__(self, items: list[int], terms_of_item: list[np.ndarray], n_terms: int):
        self.items = np.array(items, np.int64)
        pairs = np.concatenate([np.stack([terms_of_item[i], np.full(len(terms_of_item[i]), k)]) for k, i in enumerate(items)], axis=1) if items else np.empty((2, 0), np.int64)
        order = np.argsort(pairs[0], kind="stable")
        self.ends = np.searchsorted(pairs[0][order], np.arange(n_terms + 1))
        self.of_term = pairs[1][order].astype(np.int64)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each posting once for each item that asks for its term: place of the posting, item."""
        n = self.ends[term + 1] - self.ends[term]
        at = np.repeat(np.arange(len(term)), n)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.of_term[self.ends[term[at]] + inside]


FOUND = "item int, rid bigint, doc_id bigint, score bigint"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["item", "rid", "doc_id", "score"])


def _scores(batch: pa.RecordBatch, asked: Asked, weights: Weights, residual: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """By runs of rows: first row, the scores (rows x items) of their postings, and what the terms seen would leave."""
    which, term, tf = postings(batch)
    impact = weights.w[term] * weights.saturation(tf, batch["n"].to_numpy()[which])
    rows = max(1, CELLS // max(1, len(asked.items)))
    for first in range(0, batch.num_rows, rows):
        a, b = np.searchsorted(which, [first, first + rows])
        at, item = asked.spread(term[a:b])
        n = min(rows, batch.num_rows - first)
        cell = (which[a:b][at] - first) * len(asked.items) + item
        score = np.zeros(n * len(asked.items), np.int64)
        np.add.at(score, cell, impact[a:b][at])
        left = None
        if residual is not None:
            left = np.zeros_like(score)
            np.add.at(left, cell, residual[term[a:b][at]])
            left = left.reshape(n, -1)
        yield first, score.reshape(n, -1), left


def best_of_tier(tier: DataFrame, asked: Asked, weights: Weights, k: int) -> DataFrame:
    """The ``k`` best documents of each item by the scores of the tier's postings."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in asked.items]  # the worst kept first
        least = np.ones(len(asked.items), np.int64)
        for batch in batches:
            doc_ids = pc.fill_null(batch["doc_id"], np.iinfo(np.int64).min).to_numpy()
            rids = batch["rid"].to_numpy()
            for first, score, _ in _scores(batch, asked, weights, None):
                for r, i in zip(*(x.tolist() for x in np.nonzero(score >= least)), strict=True):
                    row = (int(score[r, i]), -int(doc_ids[first + r]), -int(rids[first + r]))
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], row)
                    elif row > heaps[i][0]:
                        heapq.heapreplace(heaps[i], row)
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        null = -np.iinfo(np.int64).min
        yield _emit([(int(asked.items[i]), -rid, None if doc == null else -doc, s) for i, h in enumerate(heaps) for s, doc, rid in h])

    return _ranked(tier.mapInArrow(run, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def may_reach(tier: DataFrame, asked: Asked, weights: Weights, residual: np.ndarray, rests: np.ndarray, least: np.ndarray, count: bool = False) -> DataFrame:
    """Documents whose score may reach ``least`` of an item: what they have in the tier, and the
    residual of every other term; with ``count`` only how many an item has (as score)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.items), np.int64)
        for batch in batches:
            rids, doc_ids = batch["rid"].to_pylist(), batch["doc_id"].to_pylist()
            for first, score, left in _scores(batch, asked, weights, residual):
                near = (score > 0) & (score + rests - left >= least)
                if count:
                    total += near.sum(axis=0)
                    continue
                r, i = np.nonzero(near)
                yield _emit([(int(asked.items[b]), rids[first + a], doc_ids[first + a], int(score[a, b])) for a, b in zip(r.tolist(), i.tolist(), strict=True)])
        if count:
            yield _emit([(int(i), None, None, int(n)) for i, n in zip(asked.items, total, strict=True) if n])

    return tier.mapInArrow(run, FOUND)


def exact_scores(counted: DataFrame, candidates: DataFrame, terms_of_item: list[np.ndarray], weights: Weights) -> DataFrame:
    """The whole scores of ``candidates`` (item, rid), from all postings of their documents."""
    held = [np.sort(t) for t in terms_of_item]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, term, tf = postings(batch)
            impact = weights.w[term] * weights.saturation(tf, batch["n"].to_numpy()[which])
            ends, rows = np.searchsorted(which, np.arange(batch.num_rows + 1)), []
            for r, (rid, doc_id, items) in enumerate(zip(batch["rid"].to_pylist(), batch["doc_id"].to_pylist(), batch["items"].to_pylist(), strict=True)):
                a, b = ends[r], ends[r + 1]
                for i in items:
                    score = int(impact[a:b][np.isin(term[a:b], held[i])].sum())
                    rows.append((i, rid, doc_id, score))
            yield _emit(rows)

    wanted = candidates.groupBy("rid").agg(F.collect_set("item").alias("items"))
    return counted.join(wanted, "rid").mapInArrow(run, FOUND)


def _blocks(items: DataFrame, most: int) -> list[tuple[int, int]]:
    """Runs of item numbers whose texts take ``most`` bytes or a little more. The sizes are summed by
    spans of 1024 numbers first; a span too large is cut evenly."""
    spans = items.groupBy(F.floor(F.col("item") / 1024).alias("span")).agg(F.min("item").alias("first"), F.max("item").alias("last"), F.sum(F.octet_length("text")).alias("bytes"))
    out: list[tuple[int, int]] = []
    for r in spans.orderBy("span").toLocalIterator():
        parts = min(-(-int(r["bytes"] or 1) // most), r["last"] - r["first"] + 1)
        size = -(-(r["last"] - r["first"] + 1) // max(1, parts))
        out += [(a, min(a + size - 1, r["last"])) for a in range(r["first"], r["last"] + 1, size)]
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, *, tiers: Sequence[int] | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` best documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id, score, tier (from 0: the one that proved the
    item's result) and item_row, which tells repeated items apart. The score is an
    integer BM25 with w = floor(1000 ln((2N+2)/(2df+1))) and m = 50 + (50 n N) div L:
    the sum of w ((10^9 tf) div (1000 tf + 20 m)) over the item's different terms.

    All documents are read and counted once a block of items; of each only the
    postings of the block's terms are kept. Tier 0 holds the postings of highest
    impact of each term (``tiers``[0] or FIRST of them, and those that tie within a
    step), the next tier more, the last all. In each tier the best ``k`` of an open item by the tier's
    postings give a lower limit. A document that the tier does not show can reach at
    most the sum of the terms' residual bounds: the most that any posting left out has.
    Where that is below the kth score the item is proven: the documents that may still
    reach it get their whole scores, and the best are the result. Items without proof, or
    whose proof would ask for more than LOOKED_UP * ``k`` documents, go to the next
    tier; in the last nothing is left out, and its best ``k`` are the result.

    Null texts have no terms; an item without terms, or without a hit, has no row.
    Null doc_ids rank first among equal scores; repeated rows each count, by the
    order read. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint, tier int, item_row bigint")
    numbered = materialize(items.select(F.col("item_id").cast("bigint"), "text").withColumn("at", F.monotonically_increasing_id()), "items")
    parts = numbered.groupBy((F.shiftright("at", 33)).alias("part")).agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = materialize(numbered.withColumn("part", F.shiftright("at", 33)).join(before, "part").select("item_id", "text", place.alias("item")), "numbered")
    out = [_search_block(docs, numbered.where(F.col("item").between(a, b)), a, k, tiers) for a, b in _blocks(numbered, item_bytes)]
    found = empty
    for df in out:
        found = found.unionByName(df)
    return found


def _search_block(docs: DataFrame, items: DataFrame, first: int, k: int, tiers: Sequence[int] | None) -> DataFrame:
    spark = docs.sparkSession
    rows = items.select((F.col("item") - first).cast("int").alias("item"), F.array_distinct(terms_of(F.col("text"))).alias("terms")).collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    code = {t: i for i, t in enumerate(vocabulary)}
    terms_of_item: list[np.ndarray] = [np.empty(0, np.int64)] * (max(r["item"] for r in rows) + 1)
    for r in rows:
        terms_of_item[r["item"]] = np.array([code[t] for t in r["terms"]], np.int64)

    counted = materialize(count_terms(docs, vocabulary), "counted")
    n_docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = np.zeros(len(vocabulary), np.int64)
    most = 0
    for r in df.select("term", "df", F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint").alias("w")).collect():
        w[r["term"]], most = r["w"], max(most, r["df"])
    if tiers is None:
        tiers = [FIRST]
        while tiers[-1] * FACTOR < most:
            tiers.append(tiers[-1] * FACTOR)
    weights = Weights(w, n_docs, max(1, length))

    # of each tier: the least step of each term's postings in it, and the most that a posting left out may add
    levels = steps(counted, weights)
    down = Window.partitionBy("term").orderBy(F.col("step").desc())
    levels = levels.withColumn("above", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    least = [np.zeros(len(vocabulary), np.int64) for _ in tiers]
    residual = [np.zeros(len(vocabulary), np.int64) for _ in tiers]
    out_of = [F.max(F.when(F.col("above") >= size, F.struct("step", "most"))).alias(f"t{j}") for j, size in enumerate(tiers)]
    for r in levels.groupBy("term").agg(*out_of).collect() if tiers else []:
        for j in range(len(tiers)):
            if r[f"t{j}"] is not None:
                least[j][r["term"]] = r[f"t{j}"]["step"] + 1
                residual[j][r["term"]] = r[f"t{j}"]["most"] * w[r["term"]]

    open_items = [i for i, t in enumerate(terms_of_item) if w[t].any()]
    done: list[DataFrame] = []
    for j in range(len(tiers) + 1):
        if not open_items:
            break
        last = j == len(tiers)
        asked = Asked(open_items, terms_of_item, len(vocabulary))
        tier = counted if last else materialize(tier_of(counted, weights, least[j]), f"tier{j}")
        best = materialize(best_of_tier(tier, asked, weights, k), "best")
        if last:
            done.append(best.select("item", "rank", "doc_id", "score", F.lit(j).alias("tier")))
            break
        # the whole scores of these few: their kth is a lower limit that the tier alone does not give
        whole = _ranked(exact_scores(counted, best.select("item", "rid"), terms_of_item, weights), k)
        kth = {r["item"]: r["score"] for r in whole.where(F.col("rank") == k).select("item", "score").collect()}
        rest = {i: int(residual[j][terms_of_item[i]].sum()) for i in open_items}
        # no document that the tier lacks can reach the kth score
        proven = [i for i in open_items if rest[i] < kth.get(i, 1)]
        bounds = lambda some: (Asked(some, terms_of_item, len(vocabulary)), weights, residual[j], np.array([rest[i] for i in some]), np.array([kth.get(i, 1) for i in some]))
        if proven:
            n_near = may_reach(tier, *bounds(proven), count=True).groupBy("item").agg(F.sum("score").alias("n"))
            wide = {r["item"] for r in n_near.where(F.col("n") > LOOKED_UP * k).collect()}
            proven = [i for i in proven if i not in wide]
        if proven:
            near = may_reach(tier, *bounds(proven))
            scored = exact_scores(counted, materialize(near.select("item", "rid"), "near"), terms_of_item, weights)
            top = _ranked(scored, k)
            done.append(materialize(top.select("item", "rank", "doc_id", "score", F.lit(j).alias("tier")), "proven"))
        open_items = sorted(set(open_items) - set(proven))
        drop_table(tier)
    names = items.select((F.col("item") - first).cast("int").alias("item"), F.col("item").alias("item_row"), "item_id")
    found = spark.createDataFrame([], "item int, rank int, doc_id bigint, score bigint, tier int")
    for d in done:
        found = found.unionByName(d)
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score", "tier", "item_row")
