"""Budgeted, diversity-aware context selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import text as fn


@dataclass(frozen=True)
class Policy:
    """Weights and limits of a selection."""

    relevance: float = 0.45
    authority: float = 0.2
    confidence: float = 0.15
    efficiency: float = 0.2
    least_utility: float = 0.1
    duplicate: float = 0.92
    redundancy: float = 1.25
    new_category: float = 0.15
    least_marginal: float = 0.0
    per_category: int = 3
    budget: int = 1200


#: A variant for code questions: more of one file, less weight on authority.
CODE_SEARCH = Policy(relevance=0.6, authority=0.1, confidence=0.1, per_category=6)


def ineligible(now: Column, workspaces: tuple[str, ...], classes: tuple[str, ...]) -> Column:
    """All reasons against a record, in order; empty if it is eligible. Record intervals are closed."""
    checks = (
        ("workspace", ~F.col("workspace").isin(*workspaces)), ("data_class", ~F.col("data_class").isin(*classes)), ("status", ~F.col("status").isin("active", "verified")),
        ("not_yet_valid", F.col("valid_from") > now), ("expired", F.col("valid_to") < now), ("secret", F.col("text").rlike(r"(?i)(password|token|secret)\s*=")),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks]))


def utility(p: Policy) -> Column:
    """Weighted sum of the features relevance, authority, confidence and token efficiency, to 6 places."""
    efficiency = F.least(F.lit(1.0), F.lit(32.0) / F.col("tokens"))
    return F.round(p.relevance * F.col("relevance") + p.authority * F.col("authority") + p.confidence * F.col("confidence") + p.efficiency * efficiency, 6)


def within_budget(rows: DataFrame, group: str, order: list, budget: int) -> DataFrame:
    """Rows of each group in order, as long as their running tokens fit."""
    run = F.sum("tokens").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).where(F.col("run") <= budget)


def select_diverse(candidates: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Maximal marginal relevance within a token budget, per request.

    ``candidates`` has request, record, utility, tokens, category, shingles (array).
    Each round takes the record with the largest utility - redundancy * (largest
    Jaccard with one taken) + a bonus for a new category; a record leaves for good
    if it is too like a taken one, its category is full, or it does not fit. The
    fold is over one request's candidates, whose number its top-k bounds; all that
    leads there is plain DataFrame work.
    """

    def fold(rows: list[dict]) -> list[dict]:
        first = sorted((r for r in rows if r["utility"] is not None and r["utility"] >= p.least_utility), key=lambda r: (-r["utility"], r["record"] is None, r["record"]))
        left = [(r["record"], r["utility"], r["tokens"], r["category"], set(r["shingles"])) for r in first]
        near = dict.fromkeys((x[0] for x in left), 0.0)
        taken, spent, held = [], 0, {}
        while left:
            best, worth = None, None
            for x in left:
                m = round(x[1] - p.redundancy * near[x[0]] + (0.0 if held.get(x[3]) else p.new_category), 6)
                if worth is None or m > worth:
                    best, worth = x, m
            if worth < p.least_marginal:
                break
            taken.append({"record": best[0], "position": len(taken) + 1, "marginal": worth, "tokens": best[2]})
            spent += best[2]
            held[best[3]] = held.get(best[3], 0) + 1
            keep = []
            for x in left:
                if x[0] == best[0]:
                    continue
                union = len(x[4] | best[4])
                near[x[0]] = max(near[x[0]], len(x[4] & best[4]) / union if union else 0.0)
                if near[x[0]] < p.duplicate and held.get(x[3], 0) < p.per_category and spent + x[2] <= p.budget:
                    keep.append(x)
            left = keep
        return taken

    kinds = dict(candidates.dtypes)
    fits = candidates.where(F.col("tokens") <= p.budget)
    return by_request(fits, fold, f"request {kinds['request']}, record {kinds['record']}, position int, marginal double, tokens bigint")


def by_request(rows: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``fold`` of the rows of each request, with its request (null too) before what it returns.

    Rows come in batches that hold many small requests or a part of a large one; a request is
    folded when the next begins, so a task holds one request and one batch."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, request = [], None

        def folded() -> list[dict]:
            return [{"request": request, **r} for r in fold(mine)] if mine else []

        for batch in batches:
            done: list[dict] = []
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if mine and row["request"] != request:
                        done += folded()
                        mine = []
                    request = row["request"]
                    mine.append(row)
            yield pa.RecordBatch.from_pylist(done, kinds)
        yield pa.RecordBatch.from_pylist(folded(), kinds)

    return rows.repartition("request").sortWithinPartitions("request").mapInArrow(run, schema)


def representation(tokens: Column, budget_left: Column) -> Column:
    """How much of a record is shown: all, a snippet, an outline, its place alone, or nothing."""
    return F.when(tokens <= budget_left, "full").when(budget_left >= 60, "snippet").when(budget_left >= 20, "outline").when(budget_left > 0, "locator").otherwise("excluded")


def manifest(selected: DataFrame) -> DataFrame:
    """One row a request: its records in order, tokens, and a digest that tells two manifests apart."""
    held = F.sort_array(F.collect_list(F.struct("position", "record")))
    rows = selected.groupBy("request").agg(F.transform(held, lambda x: x["record"]).alias("records"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return rows.withColumn("etag", F.sha2(F.array_join("records", ","), 256))


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "record", digest: str = "hash") -> DataFrame:
    """added, removed, changed or unchanged for each record of two manifests."""
    a, b = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def profile(records: DataFrame, static: int = 8, dynamic: int = 5) -> DataFrame:
    """Each owner's lasting records (by authority, confidence, time) and latest ones besides those."""
    w = Window.partitionBy("owner").orderBy(F.col("authority").desc(), F.col("confidence").desc(), F.col("at").desc(), "record")
    rows = records.withColumn("s", F.row_number().over(w))
    t = Window.partitionBy("owner", F.col("s") <= static).orderBy(F.col("at").desc(), "record")
    rows = rows.withColumn("d", F.row_number().over(t))
    part = F.when(F.col("s") <= static, "static").when(F.col("d") <= dynamic, "dynamic")
    return rows.select("owner", "record", part.alias("part"), F.when(F.col("s") <= static, F.col("s")).otherwise(F.col("d")).alias("position")).where("part is not null")


def compact_view(text: Column, keep: int = 8) -> Column:
    """First and last lines of a text and those that matter, ``keep`` of them at most."""
    lines = F.split(text, "\n")
    flagged = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (i == F.size(lines) - 1) | x.rlike(r"(?i)(error|fail|decision|warning|#)"), x)), lambda x: x.isNotNull())
    return F.array_join(F.slice(flagged, 1, keep), "\n")


def shingles(text: Column, n: int = 3, words: int = 256) -> Column:
    """Distinct runs of ``n`` of the first ``words`` terms (the operator's own window on a record)."""

    def runs(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(every)).otherwise(F.array(F.array_join(t, " ")))

    return fn.once(F.slice(fn.terms(text), 1, words), runs)
