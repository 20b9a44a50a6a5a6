"""Inverted index, ranking and fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, len): one exchange, by (key, term), with partial counts."""
    words = docs.select(key, fn.terms(F.col(text)).alias("w"))
    rows = words.select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, query: Sequence[str], *, k1: float = 1.2, b: float = 0.75, prefix: bool = False, key: str = "doc_id") -> DataFrame:
    """BM25 of each document with any query term; with ``prefix`` a query term stands for all terms it begins.

    Only the query's terms are counted: the term filter stands below the exchange."""
    words = docs.select(key, fn.terms(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_len"))
    rows = words.select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    if prefix:
        hit = F.lit(None).cast("string")
        for q in reversed(query):
            hit = F.when(F.startswith("term", F.lit(q)), q).otherwise(hit)
        rows = rows.withColumn("term", hit).where("term is not null")
    else:
        rows = rows.where(F.col("term").isin(*query))
    tf = rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row a query term, and one row
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def tf_idf(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): sqrt(tf) * (log2(1 + N / df) + 0.5)."""
    p = postings(docs, key)
    n = docs.select(F.count("*").alias("n_docs"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    w = F.sqrt(F.col("tf").cast("double")) * (F.log2(1 + F.col("n_docs") / F.col("df")) + 0.5)
    return p.join(df, "term").join(F.broadcast(n)).select(key, "term", F.round(w, 6).alias("weight"))


def sparse_cosine(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Cosine of rows (id, term, weight) of two sides that share a term."""
    norm = lambda x, k: x.groupBy(k).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"norm_{k}"))
    dots = a.select(left, "term", F.col("weight").alias("x")).join(b.select(right, "term", F.col("weight").alias("y")), "term").groupBy(left, right).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(norm(a, left), left).join(norm(b, right), right).select(left, right, F.round(F.col("dot") / (F.col(f"norm_{left}") * F.col(f"norm_{right}")), 6).alias("cosine"))


def ranks(scored: DataFrame, source: str, limit: int, key: str = "doc_id") -> DataFrame:
    """Top ``limit`` rows of a scored list, with rank and source."""
    top = scored.orderBy(F.col("score").desc(), key).limit(limit)
    w = Window.orderBy(F.col("score").desc(), key)  # over ``limit`` rows
    return top.withColumn("rank", F.row_number().over(w)).withColumn("source_kind", F.lit(source))


def reciprocal_rank_fusion(hits: DataFrame, weights: dict[str, float], k: int = 60, key: str = "doc_id") -> DataFrame:
    """Sum over lists of weight / (k + rank)."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source_kind"))
    return hits.groupBy(key).agg(F.round(F.sum(w / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))


def merge_candidates(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a record: best rank, best score, number of lists and their names."""
    return hits.groupBy(key).agg(
        F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.count("*").alias("n_hits"), F.array_join(F.sort_array(F.collect_set("source_kind")), ",").alias("sources")
    )


def dense_cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, part: int = 16384, tile: int = 1024) -> DataFrame:
    """Cosine of each query with every other vector, the ``k`` best; vectors have one length.

    Vectors are dealt into parts and queries into blocks. A task holds one block and walks
    through one part in tiles of ``tile`` queries by ``tile`` vectors: a matrix product, whose
    size does not grow with the block or the batch, and the best so far of each query."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts, blocks = max(1, -(-vectors.count() // part)), max(1, -(-queries.count() // block))
    row = lambda df, asks: df.where("embedding is not null").select(F.lit(not asks).alias("late"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    asked = row(queries, True).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    held = row(vectors, False).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    tasks = asked.select("block", "part", "late", "vec_id", "e").unionByName(held.select("block", "part", "late", "vec_id", "e")).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "late")

    def better(best: tuple, at: slice, mine: np.ndarray, own: np.ndarray, rows: np.ndarray, names: np.ndarray) -> None:
        """Put what of ``rows`` is among the ``k`` best of the queries ``at`` into ``best``."""
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (mine @ rows.T) / (np.sqrt((mine * mine).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None, :])
        s = np.where(np.isfinite(s) & (names[None, :] != own[:, None]), np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s), -np.inf)
        least = best[0][at][:, -1]
        if s.shape[1] > k:  # nothing under the kth of these rows, ties kept, can be among the best
            least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1])
        who, place = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        n = len(own)
        w, score = np.concatenate([np.repeat(np.arange(n), k), who]), np.concatenate([best[0][at].ravel(), s[who, place]])
        name = np.concatenate([best[1][at].ravel(), names[place]])
        order = np.lexsort((name, -score, w))
        w = w[order]
        first = np.searchsorted(w, np.arange(n))
        taken = order[first[:, None] + np.arange(k)[None, :]]
        best[0][at], best[1][at] = score[taken], name[taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, q, best = None, [], [], None

        def out() -> pa.RecordBatch:
            scores, found = best
            who, place = np.nonzero(np.isfinite(scores))
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids)[who], pa.int64()), pa.array(found[who, place], pa.int64()), pa.array(scores[who, place], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            key = np.stack([batch["block"].to_numpy(), batch["part"].to_numpy()], axis=1)
            late, vec = batch["late"].to_numpy(zero_copy_only=False), batch["vec_id"].to_numpy()
            flat, ends = batch["e"].flatten().to_numpy(zero_copy_only=False), batch["e"].offsets.to_numpy()
            width = int(ends[1] - ends[0]) if batch.num_rows else 0
            e = flat[ends[0] - ends[0] : ends[-1] - ends[0]].reshape(batch.num_rows, width) if batch.num_rows else flat.reshape(0, 0)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tuple(key[a]) != at:
                    if best is not None:
                        yield out()
                    at, ids, q, best = tuple(key[a]), [], [], None
                asks = ~late[a:b]
                ids += vec[a:b][asks].tolist()
                q += list(e[a:b][asks])
                rows, names = e[a:b][~asks], vec[a:b][~asks]
                if not len(rows) or not ids:
                    continue
                mine = np.array(q)
                if best is None:
                    best = (np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64))
                own = np.array(ids)
                for i in range(0, len(ids), tile):
                    for j in range(0, len(rows), tile):
                        better(best, slice(i, i + tile), mine[i : i + tile], own[i : i + tile], rows[j : j + tile], names[j : j + tile])
        if best is not None:
            yield out()

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = tasks.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def snippets(docs: DataFrame, words: Sequence[str], *, context: int = 2, per_doc: int = 3, budget: int = 400) -> DataFrame:
    """Best lines of each document by query terms hit, with their context, as far as a token budget goes."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines")).select("doc_id", "lines", F.posexplode("lines").alias("pos", "line"))
    hits = F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), F.array_distinct(fn.terms(F.col("line")))))
    best = Window.partitionBy("doc_id").orderBy(F.col("hits").desc(), "pos")
    rows = lines.withColumn("hits", hits).where("hits > 0").withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_doc)
    first = F.greatest(F.lit(1), F.col("pos") + 1 - context)
    rows = rows.withColumn("snippet", F.array_join(F.slice("lines", first, F.col("pos") + 1 + context - first + 1), "\n"))
    rows = rows.withColumn("tokens", fn.token_estimate(F.col("snippet")))
    run = F.sum("tokens").over(best.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).where(F.col("run") <= budget).select("doc_id", "pos", "hits", "tokens", "snippet")


def boosted(semantic: Column, keyword: Column, boost: Column) -> Column:
    """Hybrid score of current-truth search."""
    return F.round(0.72 * semantic + 0.23 * keyword + boost, 6)


def random_index(docs: DataFrame, key: str, *, dims: int = 256, marks: int = 8) -> DataFrame:
    """Random-indexing vectors in long form (key, dim, weight), of length 1.

    A term has ``marks`` positions from its SHA-256, each with the sign of the
    position's parity; a document is the sum of its terms by count."""
    spots = F.transform(F.sequence(F.lit(0), F.lit(marks - 1)), lambda j: F.conv(F.substring(F.sha2("term", 256), j * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    rows = postings(docs, key).select(key, "tf", F.explode(spots).alias("h"))
    sign = F.when(F.col("h") % 2 == 0, 1).otherwise(-1)
    sums = rows.groupBy(key, (F.col("h") % dims).cast("int").alias("dim")).agg(F.sum(F.col("tf") * sign).alias("s")).where("s <> 0")
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s")).cast("double")).alias("norm"))
    return sums.join(norm, key).select(key, "dim", F.round(F.col("s") / F.col("norm"), 6).alias("weight"))
