"""Candidates for a context: by id, from a graph under quotas, by text, graph and age together; the best partner of each text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.sources.shared import scratch_folder

#: Order of kinds of edges among neighbours (fixed values).
EDGE_PRIORITY = {"imports": 0, "calls": 1, "references": 2, "exports": 3, "defined_in": 4, "contains": 5}


def age_days(then: Column, now: Column) -> Column:
    """Days, with their fraction, from ``then`` to ``now``; 0 for what is to come."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400e6)


def recency(then: Column, now: Column) -> Column:
    """1 / (1 + days)."""
    return 1 / (1 + age_days(then, now))


def decay(then: Column, now: Column, days: float = 60.0) -> Column:
    """exp(-days / 60): 1 now, and a 2.718th every 60 days."""
    return F.exp(-age_days(then, now) / days)


def exact_candidates(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Records that requests name: request, rank (place of the id, from 1), record; a null record is one that no table holds.

    ``requests``: request, ids (array; repeated ids count once, at their first place)."""
    wanted = requests.select("request", F.posexplode(F.array_distinct("ids")).alias("pos", "id"))
    known = records.select(F.col("record").alias("id"), F.lit(True).alias("_known")).distinct()
    return wanted.join(known, "id", "left").select("request", (F.col("pos") + 1).alias("rank"), "id", F.when(F.col("_known"), F.col("id")).alias("record"))


def hybrid_by_age(lexical: DataFrame, matched: DataFrame, facts: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """Current facts by 0.7 lexical + 0.2 graph + 0.1 recency.

    ``lexical`` (fact_id, lexical) and ``matched`` (fact_id, bm25) are what the words of the
    query hit; ``facts``: fact_id, subject, object, valid_from. lexical is the larger of the own score and
    0.4 / (1 + |bm25|); graph is 0.2 for a hit, 0.4 for a fact that shares an entity with one of ``matched``."""
    rows = facts.join(lexical, "fact_id", "left").join(matched.select("fact_id", "bm25"), "fact_id", "left")
    seeds = facts.join(matched.select("fact_id"), "fact_id", "left_semi")
    ends = seeds.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    touching = facts.select("fact_id", F.explode(F.array("subject", "object")).alias("node")).join(ends, "node", "left_semi").select("fact_id", F.lit(True).alias("related")).distinct()
    rows = rows.join(touching, "fact_id", "left")
    text = F.greatest(F.coalesce("lexical", F.lit(0.0)), F.coalesce(0.4 / (1 + F.abs("bm25")), F.lit(0.0)))
    graph = F.when(text > 0, 0.2).when(F.col("related"), 0.4).otherwise(0.0)
    rows = rows.withColumn("text", F.round(text, 6)).withColumn("graph", graph).withColumn("recency", F.round(recency(F.col("valid_from"), now), 6)).where("text > 0 or graph > 0")
    score = F.round(0.7 * F.col("text") + 0.2 * F.col("graph") + 0.1 * F.col("recency"), 6)
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), F.col("valid_from").desc(), "fact_id").limit(limit).select("fact_id", "text", "graph", "recency", "score")


def graph_candidates(found: DataFrame, edges: DataFrame, limit: int = 20, *, direct_share: float = 0.75, per_file: int = 2, neighbours_per_file: int = 1) -> DataFrame:
    """Direct hits and their neighbours under quotas, per request: request, place, id, origin (direct or neighbour), score.

    ``found``: request, rank, id (a node), kind, file, score. ``edges``: id, kind, src, dst, file.
    Direct hits come in the order of their ranks, ``per_file`` of a file, until three quarters of the
    limit are filled. Then the edges at those hits, hits on files before others, then by score; of
    one hit by kind of edge; ``neighbours_per_file`` of a file, no edge twice, until the limit.
    A neighbour scores 0.65 of its hit. The fill in sequence is two windows: the nth of a file,
    and the nth that is left. A node's edges are cut, before they meet the hits, to as
    many as could be taken if all before them were taken already."""
    quota = max(1, min(limit, math.ceil(limit * direct_share)))
    order = Window.partitionBy("request").orderBy("rank", "id")
    rows = found.where("file is not null").withColumn("nth", F.row_number().over(Window.partitionBy("request", "id").orderBy("rank"))).where("nth = 1")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("request", "file").orderBy("rank", "id"))).where(F.col("nth") <= per_file)
    direct = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)

    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv]), F.col("kind")), F.lit(10))
    ends = edges.where("file is not null").withColumn("priority", priority).select("id", "priority", "file", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    by_kind = Window.partitionBy("node").orderBy("priority", "id")
    ends = ends.withColumn("nth", F.row_number().over(Window.partitionBy("node", "file").orderBy("priority", "id"))).where(F.col("nth") <= limit + neighbours_per_file)
    ends = ends.withColumn("nth", F.row_number().over(by_kind)).where(F.col("nth") <= (limit + neighbours_per_file) * (limit + 1)).drop("nth")
    seed = F.when(F.col("kind") == "file", 0).when(F.col("kind").isin("symbol", "class", "function", "method"), 1).otherwise(4)
    seeds = direct.select("request", F.col("id").alias("node"), "score", F.row_number().over(Window.partitionBy("request").orderBy(seed, F.col("score").desc(), "id")).alias("seed"))
    met = seeds.join(ends, "node")
    turn = ["seed", "priority", "id"]
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("request", "id").orderBy(*turn))).where("nth = 1")
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("request", "file").orderBy(*turn))).where(F.col("nth") <= neighbours_per_file)
    counts = direct.groupBy("request").agg(F.count("*").alias("held"))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*turn))).join(counts, "request").withColumn("place", F.col("place") + F.col("held")).where(F.col("place") <= limit)
    near = met.select("request", "place", "id", F.lit("neighbour").alias("origin"), F.round(F.greatest(F.lit(0.01), F.col("score") * 0.65), 6).alias("score"))
    return direct.select("request", "place", "id", F.lit("direct").alias("origin"), F.round("score", 6).alias("score")).unionByName(near)


def best_partners(rows: DataFrame, key: str, *, places: int = 3, part: int = 8_000_000, least: int = 8) -> DataFrame:
    """Of each row (``key``, tokens: distinct) the other row with the largest Jaccard, rounded to ``places``,
    ties to the smaller key; rows that share no token with any have none. All pairs count.

    Rows are dealt into parts of about ``part`` tokens, ``least`` parts or more, and every two
    parts meet in one task: it counts, for all rows of one, the tokens that they share with each row
    of the other, those that many rows hold by a product of matrices and the others through an index, and returns the best
    of both alone. So a task holds two
    parts, no pair of rows leaves it, and what is sent is the rows as often as there are
    parts; the time goes by the square of the rows. Tokens are compared by 64-bit digests."""
    kind = dict(rows.dtypes)[key]
    at = scratch_folder(rows.sparkSession, "partners")
    base = rows.select(F.col(key).alias("k"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")).where("k is not null and size(tokens) > 0")
    base.write.parquet(at)
    base = rows.sparkSession.read.schema(base.schema).parquet(at)
    total = base.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = max(least, -(-total // part))
    mine = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(parts))
    dealt = base.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tile, late = F.least("mine", "other") * parts + F.greatest("mine", "other"), F.col("mine") > F.col("other")
    tiles = dealt.select(tile.alias("tile"), late.alias("late"), "k", "tokens").repartition(parts * (parts + 1) // 2, "tile").sortWithinPartitions("tile", "late")
    scale = 10**places

    real = np.float32 if places <= 4 else np.float64

    def least_of(who: np.ndarray, score: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of the largest score, then the smallest rank, of each ``who``."""
        order = np.lexsort((rank, -score, who))
        return order[np.append(True, who[order][1:] != who[order][:-1])] if len(order) else order

    def best(left: tuple, right: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        """The best partner among ``right`` (keys, sizes, tokens) of each row of ``left``, and, if they are two parts, the other way too.

        Tokens that so many rows of both hold that a product of matrices is cheaper are counted by one, all others through an index."""
        (names_a, n_a, t_a), (names_b, n_b, t_b) = left, right
        known_a, count_a = np.unique(t_a, return_counts=True)
        known, count = (known_a, count_a) if same else np.unique(t_b, return_counts=True)
        spot = np.minimum(np.searchsorted(known, known_a), len(known) - 1)
        both = known[spot] == known_a
        met, often = known_a[both], count_a[both].astype(np.float64) * count[spot[both]]
        most = int(25_000_000 // (len(names_a) + len(names_b)))
        common = np.flatnonzero(often * 200 > len(names_a) * float(len(names_b)))
        common = np.sort(met[common[np.argsort(-often[common], kind="stable")[:most]]])

        def halves(sizes: np.ndarray, tokens: np.ndarray) -> tuple:
            """Rows by common tokens, and owner and token of all others that both parts hold."""
            owner = np.repeat(np.arange(len(sizes)), sizes)
            dense = np.zeros((len(sizes), len(common)), real)
            if len(common):
                at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                hit = common[at] == tokens
                dense[owner[hit], at[hit]] = 1
                owner, tokens = owner[~hit], tokens[~hit]
            at = np.minimum(np.searchsorted(met, tokens), max(0, len(met) - 1))
            hit = met[at] == tokens if len(met) else np.zeros(len(tokens), bool)
            return dense, owner[hit], at[hit]

        dense_a, owner_a, rest_a = halves(n_a, t_a)
        dense_b, owner_b, rest_b = (dense_a, owner_a, rest_a) if same else halves(n_b, t_b)
        order = np.argsort(rest_b, kind="stable")
        posts = owner_b[order]
        first = np.searchsorted(rest_b[order], np.arange(len(met) + 1))
        ends = np.searchsorted(owner_a, np.arange(len(names_a) + 1))
        starts, stops = first[rest_a].tolist(), first[rest_a + 1].tolist()
        rank_a, rank_b = np.empty(len(names_a), np.int64), np.empty(len(names_b), np.int64)
        rank_a[np.argsort(names_a, kind="stable")] = np.arange(len(names_a))
        by_name = np.argsort(names_b, kind="stable")
        rank_b[by_name] = np.arange(len(names_b))
        twin = np.searchsorted(names_b[by_name], names_a), np.searchsorted(names_b[by_name], names_a, "right")
        wide, tol, tiny = len(names_b), real(1.1 / scale), np.finfo(real).tiny
        run, held = np.zeros(wide, real), (np.zeros(wide, np.int64), np.zeros(wide, np.int64))  # of a row of the right: score, row of the left
        step = max(1, min(256, 4_000_000 // wide))
        found: list[tuple] = []

        def exact(shared: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int) -> np.ndarray:
            """Score by whole numbers, halves up."""
            m = shared[i, j].astype(np.int64)
            union = n_a[lo + i] + n_b[j] - m
            return (2 * scale * m + union) // (2 * union)

        for lo in range(0, len(names_a), step):
            hi = min(lo + step, len(names_a))
            shared = dense_a[lo:hi] @ dense_b.T
            for i in range(lo, hi):
                x, y = ends[i], ends[i + 1]
                if x < y:
                    shared[i - lo] += np.bincount(np.concatenate([posts[u:v] for u, v in zip(starts[x:y], stops[x:y], strict=True)]), minlength=wide)
                shared[i - lo, by_name[twin[0][i] : twin[1][i]]] = 0  # itself, and a repeated key
            near = np.add.outer(n_a[lo:hi].astype(real), n_b.astype(real))
            near -= shared
            np.divide(shared, near, out=near)
            # scores that round to the largest
            i, j = np.nonzero(near >= np.maximum(near.max(1) - tol, tiny)[:, None])
            score = exact(shared, i, j, lo)
            at = least_of(i, score, rank_b[j])
            found.append((lo + i[at], j[at], score[at]))
            if not same:
                np.maximum(run, near.max(0), out=run)
                i, j = np.nonzero(near >= np.maximum(run - tol, tiny))
                score = exact(shared, i, j, lo)
                at = least_of(j, score, rank_a[lo + i])
                i, j, score = lo + i[at], j[at], score[at]
                better = (score > held[0][j]) | ((score == held[0][j]) & (rank_a[i] < rank_a[held[1][j]]))
                held[0][j[better]], held[1][j[better]] = score[better], i[better]

        def said(k: np.ndarray, o: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k, keys), pa.array(o, keys), pa.array(score / scale, pa.float64())], names=["k", "o", "score"])

        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        yield said(names_a[i[score > 0]], names_b[j[score > 0]], score[score > 0])
        j = np.flatnonzero(held[0])
        yield said(names_b[j], names_a[held[1][j]], held[0][j])

    keys = to_arrow_schema(rows.select(key).schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, ([], [])

        def whole(side: list) -> tuple:
            return np.concatenate([x[0] for x in side]), np.concatenate([x[1] for x in side]), np.concatenate([x[2] for x in side])

        def done() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            lo, hi = divmod(now, parts)
            if lo == hi:
                a = whole(got[0])
                yield from best(a, a, True)
            elif got[0] and got[1]:
                a, b = whole(got[0]), whole(got[1])
                got[0].clear()
                got[1].clear()
                yield from best(a, b, False)

        for batch in batches:
            tile, late = batch["tile"].to_numpy(), batch["late"].to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero((tile[1:] != tile[:-1]) | (late[1:] != late[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tile[a] != now:
                    yield from done()
                    now, got = int(tile[a]), ([], [])
                piece = batch.slice(a, b - a)
                ends = piece["tokens"].offsets.to_numpy()
                flat = piece["tokens"].values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
                got[int(late[a])].append((piece["k"].to_numpy(zero_copy_only=False).copy(), np.diff(ends).astype(np.int64), flat.copy()))
        yield from done()

    found = tiles.mapInArrow(run, f"k {kind}, o {kind}, score double")
    top = found.groupBy("k").agg(F.max_by(F.struct("o", "score"), F.struct("score", -F.col("o"))).alias("best"))
    return top.select(F.col("k").alias(key), F.col("best.o").alias("partner"), F.col("best.score").alias("score"))
