"""Exact top-k inner-product search by KD-trees per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import frugal, materialize

#: Vectors a shard, vectors a leaf, queries a block.
SHARD, LEAF, BLOCK = 4096, 64, 256


class KDTree:
    """KD-tree over integer vectors: splits at the median of the widest dimension,
    ties by row, so equal vectors split too; every node has a tight bounding box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.kids, self.rows = [], [], [], []
        if len(ids):
            self._node(np.arange(len(ids)))
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _node(self, rows: np.ndarray) -> int:
        me, v = len(self.kids), self.vectors[rows]
        self.low.append(v.min(axis=0))
        self.high.append(v.max(axis=0))
        self.kids.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF:
            dim = int((self.high[me] - self.low[me]).argmax())
            rows, half = rows[np.argsort(v[:, dim], kind="stable")], len(rows) // 2
            self.rows[me] = None
            self.kids[me] = (self._node(np.sort(rows[:half])), self._node(np.sort(rows[half:])))
        return me

    def search(self, own: int, query: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best rows other than ``own``, best first, ties to
        the smaller id; rows that score below ``bound``, a kth score found elsewhere,
        may be left out. Nodes are visited in the order of the most that their box allows."""
        if not len(self.ids):
            return []
        most = np.maximum(query * self.lows, query * self.highs).sum(axis=1)
        heap: list[tuple[int, int]] = []  # the worst kept row first: (score, -id)
        queue = [(-int(most[0]), 0)]
        while queue:
            limit, node = heapq.heappop(queue)
            floor = heap[0][0] if len(heap) == k else None
            if bound is not None and (floor is None or bound > floor):
                floor = bound
            if floor is not None and -limit < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-int(most[kid]), kid))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            if floor is not None:
                near = scores >= floor
                rows, scores = rows[near], scores[near]
            for score, i in zip(scores.tolist(), self.ids[rows].tolist()):
                if i != own:
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -i))
                    elif (score, -i) > heap[0]:
                        heapq.heapreplace(heap, (score, -i))
        return [(s, -i) for s, i in sorted(heap, reverse=True)]


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where a product could leave 64 bits."""
    y = np.floor(scale * x.astype(np.float64))
    if y.size and np.abs(y).max() ** 2 * y.shape[1] >= 2.0**62:
        return np.array([[int(v) for v in row] for row in y], dtype=object)
    return y.astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, scale: int = 256, shard: int = SHARD) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the largest inner
    product with each row of ``queries`` (the same columns), itself left out.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    Components are floor(scale * x); scores are exact integers. Vectors that are
    null, or hold a null or non-finite component, take no part; nor do rows
    without an id. All vectors have one length, or an error is raised. With fewer
    than ``k`` other rows all are returned. A row of equal id is the query's own,
    also where ids repeat; other repeated rows count one by one. Empty tables give
    an empty result. Rows of ``queries`` that share an id but not the vector are queries of
    their own, each with its ranks; rows that share both are one query.

    Vectors are dealt by a hash of the row into shards of about ``shard``. First
    each query is searched in one shard; the kth score it finds there goes with
    it, as a bound, to all others. Queries travel in blocks, so a task holds its
    shard's tree and one block.
    """
    valid = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    numbers = lambda df: df.where(valid).select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = materialize(numbers(vectors).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asked = materialize(numbers(queries).withColumn("rid", F.monotonically_increasing_id()), "queries")
    shards, blocks = max(1, -(-rows.count() // shard)), max(1, -(-asked.count() // BLOCK))
    widths = [r[0] for r in rows.select(F.size("v")).union(asked.select(F.size("v"))).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors of more than one length")
    rows = rows.select("id", "v", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"))
    asked = asked.select("id", "v", "rid", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(shards)).cast("int").alias("home"))

    @frugal
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard: its vectors first, then blocks of queries."""
        at, ids, data, tree = None, [], [], None
        for batch in batches:
            out = [[], [], [], [], [], []]
            for r in batch.to_pylist():
                if r["shard"] != at:
                    at, ids, data, tree = r["shard"], [], [], None
                if r["block"] < 0:
                    ids.append(r["ids"][0])
                    data.append(r["data"])
                    continue
                if tree is None and not ids:
                    continue  # a shard that the hash gave no vector
                if tree is None:
                    tree = KDTree(np.array(ids, np.int64), whole_numbers(np.array(data).reshape(len(ids), -1), scale))
                    ids, data = [], []
                asked = whole_numbers(np.array(r["data"]).reshape(len(r["ids"]), -1), scale)
                for i, rid, q, bound in zip(r["ids"], r["rids"], asked, r["bounds"], strict=True):
                    found = tree.search(i, q, k, bound)
                    for score, vec in found:
                        for c, v in zip(out, (i, rid, vec, score, r["block"], at), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "rid", "vec_id", "score", "block", "shard"])

    def run(blocks_of: DataFrame) -> DataFrame:
        own = rows.select("shard", F.lit(-1).alias("block"), F.array("id").alias("ids"), F.array(F.lit(None).cast("bigint")).alias("rids"), F.col("v").alias("data"), F.array(F.lit(None).cast("bigint")).alias("bounds"))
        tasks = own.unionByName(blocks_of).repartition(shards, "shard").sortWithinPartitions("shard", "block")
        return tasks.mapInArrow(search, "query_id bigint, rid bigint, vec_id bigint, score bigint, block int, shard int")

    def packed(df: DataFrame, *by: str) -> DataFrame:
        """A row a block of at most about BLOCK queries."""
        held = F.sort_array(F.collect_list(F.struct("id", "v", "bound", "rid")))
        df = df.groupBy(*by).agg(held.alias("q"))
        return df.select(*by, F.col("q.id").alias("ids"), F.col("q.rid").alias("rids"), F.flatten(F.col("q.v")).alias("data"), F.col("q.bound").alias("bounds"))

    none = F.lit(None).cast("bigint")
    asked = asked.dropDuplicates(["id", "v"])
    first = materialize(run(packed(asked.withColumn("bound", none).withColumnRenamed("home", "shard"), "shard", "block")), "first")
    ranked = F.row_number().over(Window.partitionBy("query_id", "rid").orderBy(F.col("score").desc(), "vec_id"))
    kth = first.groupBy("rid").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k)
    everywhere = asked.join(kth.select("rid", "bound"), "rid", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rest = packed(everywhere.where("shard <> home").drop("home"), "shard", "block")
    found = first.unionByName(run(rest)) if shards > 1 else first
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
