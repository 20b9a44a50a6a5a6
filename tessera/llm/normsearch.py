"""Hard-negative mining by exact search over candidates bucketed by their norms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, frugal, materialize
from tessera.llm.topk import whole_numbers

#: Vectors a bucket; vectors that one task walks through; anchors that one task holds: all
#: vectors are dealt out once for each group of anchors, so groups are large.
BUCKET, STRIPE, GROUP = 512, 8192, 16384

#: Products of numbers below this are exact in doubles, sums included.
EXACT = 2.0**53


class Anchors:
    """The anchors of a task, their windows of scores, and the best rows found in each.

    An anchor has one or more windows [low, high]. A row fits where its score lies in
    the window and its label is the anchor's (``same``) or not. Rows are kept by
    score, ties by id, then row number. ``floor`` is what a row must reach to matter
    to an anchor: the lower limit of a window, or, where k rows are kept, the kth."""

    def __init__(self, rows: list[dict], k: int, same: bool, scale: int):
        self.k, self.same = k, same
        self.rid = np.array([r["rid"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.v = whole_numbers(np.array([r["v"] for r in rows]), scale)
        self.norm = norms(self.v)
        self.windows = [r["windows"] or [] for r in rows]
        self.kept = [[[] for _ in w] for w in self.windows]
        self.floor = np.array([self._floor(i) for i in range(len(rows))], np.float64)
        self.skipped = self.seen = 0

    def _floor(self, i: int) -> float:
        lows = [rows[-1][0] if len(rows) == self.k else w["low"] for w, rows in zip(self.windows[i], self.kept[i], strict=True)]
        return min((-np.inf if x is None else x for x in lows), default=np.inf)

    def meet(self, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """Rows of one bucket against all anchors whose floor the bucket's longest row can reach
        (Cauchy-Schwarz: a score is at most the product of the norms)."""
        longest = float(norms(v).max())
        near = np.flatnonzero(self.norm * longest >= self.floor)
        self.seen, self.skipped = self.seen + len(self.rid), self.skipped + len(self.rid) - len(near)
        if not len(near):
            return
        if v.dtype == object or self.v.dtype == object or float(self.norm[near].max()) * longest >= EXACT:
            scores = self.v[near].astype(object) @ v.astype(object).T
        else:
            scores = self.v[near].astype(np.float64) @ v.T.astype(np.float64)
        fits = (labels[None, :] == self.label[near, None]) == self.same
        fits &= (rids[None, :] != self.rid[near, None]) & (scores >= self.floor[near, None])
        for i, row, fit in zip(near.tolist(), scores, fits, strict=True):
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            # the best first: all that may enter any window
            found = sorted((-int(s), int(c), int(r)) for s, c, r in zip(row[at].tolist(), ids[at], rids[at], strict=True))
            for w, rows in zip(self.windows[i], self.kept[i], strict=True):
                inside = [(-s, c, r) for s, c, r in found if (w["low"] is None or -s >= w["low"]) and (w["high"] is None or -s <= w["high"])][: self.k]
                rows[:] = sorted(rows + inside, key=lambda x: (-x[0], x[1], x[2]))[: self.k]
            self.floor[i] = self._floor(i)


def norms(v: np.ndarray) -> np.ndarray:
    """Euclidean norms, a little too long rather than too short."""
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def search(anchors: DataFrame, rows: DataFrame, k: int, same: bool, scale: int) -> DataFrame:
    """The best ``k`` rows of each window of each anchor: rid, window, vec_id, row (its number), score.

    ``rows`` (id, rid, label, v, bucket, stripe) come from by_norm(); ``anchors`` (rid,
    label, v, grp, windows). A task holds one group of anchors and walks through the
    buckets of one stripe, longest vectors first, with the running kth scores of its
    anchors; each stripe holds buckets of all lengths."""
    stripes = max(1, rows.agg(F.max("stripe")).first()[0] + 1 if rows.head(1) else 1)
    groups = max(1, anchors.agg(F.max("grp")).first()[0] + 1 if anchors.head(1) else 1)
    window = "array<struct<low bigint, high bigint>>"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held, bucket = None, [], [], None
        state: Anchors | None = None

        def bucket_done() -> None:
            if held:
                ids, rids, labels = (np.array([r[c] for r in held], np.int64) for c in ("id", "rid", "label"))
                state.meet(ids, rids, labels, whole_numbers(np.array([r["v"] for r in held]), scale))
                held.clear()

        def done() -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for rid, windows in zip(state.rid.tolist(), state.kept, strict=True):
                for w, rows_ in enumerate(windows):
                    for score, vec, row in rows_:
                        for c, x in zip(out, (rid, w, vec, row, score), strict=True):
                            c.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["rid", "window", "vec_id", "row", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["grp"], r["stripe"]) != at:
                    if state is not None:
                        bucket_done()
                        yield done()
                    at, asked, state, bucket = (r["grp"], r["stripe"]), [], None, None
                    held.clear()
                if r["bucket"] < 0:
                    asked.append(r)
                    continue
                if not asked:
                    continue
                if state is None:
                    state = Anchors(asked, k, same, scale)
                if r["bucket"] != bucket:
                    bucket_done()
                    bucket = r["bucket"]
                held.append(r)
        if state is not None:
            bucket_done()
            yield done()

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.select("grp", every(stripes).alias("stripe"), F.lit(-1).alias("bucket"), F.lit(None).cast("bigint").alias("id"), "rid", "label", "v", "windows")
    own = rows.select(every(groups).alias("grp"), "stripe", "bucket", "id", "rid", "label", "v", F.lit(None).cast(window).alias("windows"))
    asked = asked.join(rows.select("stripe").distinct(), "stripe", "left_semi").select(asked.columns) if stripes > 1 else asked
    tasks = asked.unionByName(own).repartition(stripes * groups, "grp", "stripe").sortWithinPartitions("grp", "stripe", "bucket", "rid")
    found = tasks.mapInArrow(run, "rid bigint, window int, vec_id bigint, row bigint, score bigint")
    best = Window.partitionBy("rid", "window").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def by_norm(rows: DataFrame, bucket: int, stripe: int) -> DataFrame:
    """``rows`` (id, rid, label, v) with bucket, whose number rises as the vectors get shorter,
    and stripe: buckets are dealt to the stripes in turn. Sorted by a range partitioning
    over (norm, row number), so equal vectors part too; a bucket is a run of one partition."""
    rows = rows.withColumn("norm", F.expr("aggregate(v, double(0), (s, x) -> s + x * x)"))
    laid = rows.repartitionByRange(F.col("norm").desc(), "rid").sortWithinPartitions(F.col("norm").desc(), "rid")
    laid = materialize(laid.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "by_norm")
    parts = laid.groupBy("part").agg(F.ceil(F.count("*") / bucket).cast("int").alias("buckets"))
    before = F.coalesce(F.sum("buckets").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    laid = laid.join(parts.select("part", before.alias("before")), "part").withColumn("bucket", F.col("before") + F.floor(F.col("at") / bucket).cast("int"))
    stripes = max(1, -(-laid.count() // stripe))
    return materialize(laid.select("id", "rid", "label", "v", "bucket", F.pmod("bucket", F.lit(stripes)).alias("stripe")), "buckets")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, positives: int = 5, negatives: int = 10,
    window: Callable[[Column], tuple[Column, Column]] = lambda s: (F.ceil(F.lit(30) * s / 100), F.floor(F.lit(90) * s / 100)),
    scale: int = 256, bucket: int = BUCKET, stripe: int = STRIPE, group: int = GROUP,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels whose score lies in ``window`` (lowest and
    highest score, from the positive's).

    ``vectors`` has vec_id, embedding, label; ``label``, an expression, replaces the
    label. Components become floor(scale * x); a score is the integer inner product
    with the anchor, exact. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score, and anchor_row and positive_rank, which tell
    repeated rows apart. Ties go to the smaller vec_id, then the earlier row.

    Rows without vec_id, label or vector, or with a null or non-finite component,
    take no part. Other rows are other rows, also where they repeat the anchor's id
    or vector. With fewer rows all are returned; an anchor without positives, or a
    positive without negatives, has no row. Vectors of more than one length raise an
    error, as does a score that leaves 64 bits. An empty table gives an empty
    result. Other columns are ignored.

    The search is exact and never sees a pair of a bucket and an anchor that the
    lengths rule out: see search(). Positives and negatives are one pass each.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    valid = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("id"), F.monotonically_increasing_id().alias("rid"), (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"), is_anchor.alias("asks"), valid.alias("valid"),
    ).where("valid and label is not null").drop("valid")
    rows = materialize(rows, "vectors")
    if len(rows.select(F.size("v")).distinct().limit(2).collect()) > 1:
        raise ValueError("vectors of more than one length")
    bucketed = by_norm(rows.drop("asks"), bucket, stripe)
    asks = rows.where("asks")
    groups = max(1, -(-asks.count() // group))
    anchors = materialize(asks.select("id", "rid", "label", "v", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int").alias("grp")), "anchors")
    free = F.array(F.struct(F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")))
    near = materialize(search(anchors.withColumn("windows", free), bucketed, positives, True, scale), "positives")
    low, high = window(F.col("score").cast("decimal(38,0)"))
    # one entry a positive, by its rank
    sets = near.withColumn("w", F.struct("rank", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))).groupBy("rid").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    sets = sets.select("rid", F.transform("ws", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    hard = search(anchors.join(sets, "rid").select("grp", "rid", "label", "v", "windows"), bucketed, negatives, False, scale)
    names = near.select("rid", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(names, ["rid", "window"]).join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return out.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        F.col("rid").alias("anchor_row"), (F.col("window") + 1).alias("positive_rank"),
    )
