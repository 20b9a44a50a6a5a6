"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, unit, word_count

#: Symbols that are rare in prose; a document's quality weight falls with their share.
NOISE = r"[%*&$#@^~|<>=_{}\[\]\\!]"
#: Slices of a source's key range; only the slice that a budget ends in is sorted.
SLICES = 4096
#: Sources (rows of some 200 bytes) up to which their figures are sent to all executors.
SENT_SOURCES = 50_000


def quality_weight(text) -> F.Column:
    """1 minus the share of noise symbols, 0.05 at least; 1 for null and empty texts."""
    n = F.length(text)
    share = (n - F.length(F.regexp_replace(text, NOISE, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - share), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Target of each source, from rows (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn. They share
    ``share`` times all sizes by weight; a target stops at ``cap`` times the
    source's size and the excess goes to the others by weight. Sorted by
    cap/weight, the sources before the first that fits are the capped ones; the
    rest share what is left. One row a source is all that meets in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = [F.col("most") / F.col("w"), F.col("rank")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    total = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "level", (F.lit(float(share)) * F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ).withColumn("capped", F.col("level") > F.col("most") / F.col("w"))
    free = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct(F.col("most") / F.col("w"), "rank"))).over(total)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * free))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), *, share: float = 1.5, cap: float = 2.0, seed: int = 17, keep: bool = False) -> DataFrame:
    """How often the mix takes each document of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size (words), source_size, target, copies, taken
    (copies times size), rid, a row number, and with ``keep`` the whole row as the struct row. A source's whole epochs come
    first: floor(target / source_size) copies of every document. What is left is
    drawn without replacement with chances by quality: the key -ln(u)/weight has
    u from (seed, doc_id); in key order documents are taken while their running
    words fit. One closing document, the untaken one whose size is nearest to the
    words still missing, is added if that brings the sum nearer; ties go to the
    smaller key.

    Keys are cut into slices that keep their order; sums by slice tell which
    slice the budget ends in, and only that one is sorted. So a source holding a
    third of all rows is never sorted in one task. The same input gives the same
    result again: u depends on nothing else.

    Null texts have size 0 and weight 1. A null source is a source, and a null
    doc_id counts as an empty one. Repeated rows are each a document; where their
    keys are equal too, any of them may be the one taken. A source without words
    has target 0. An empty table gives an empty result. Other columns are ignored.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select("doc_id", "source", F.monotonically_increasing_id().alias("rid"), word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"), *whole)
    rows = rows.withColumn("key", -F.log(unit(F.lit(seed), F.col("doc_id"))) / F.col("weight"))
    rows = rows.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col("key"))) * SLICES)).cast("int"))
    rows = materialize(rows, "mix")

    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        slices.withColumn("sum", F.sum("words").over(upto)).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .groupBy(F.col("t.source").alias("source"))
        .agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"),
            F.coalesce(F.min(F.when(F.col("sum") > F.col("rest"), F.col("slice"))), F.lit(SLICES)).alias("end"),
            F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.lit(0)).alias("full"),
        )
    )
    ends = materialize(ends, "mix-ends")

    # a row a source; rows but those of the ending slices go nowhere
    few = F.broadcast(ends) if ends.count() <= SENT_SOURCES else ends
    drawn = rows.alias("r").join(few.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source"))).select("r.*", "source_size", "target", "epochs", "rest", "end", "full")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    last = drawn.where("slice = end").withColumn("in", F.col("full") + F.sum("size").over(order) <= F.col("rest"))
    drawn = drawn.where("slice <> end").withColumn("in", F.col("slice") < F.col("end")).unionByName(last)
    gaps = last.where("in").groupBy("source").agg(F.sum("size").alias("more"))
    gaps = ends.alias("e").join(gaps.alias("g"), F.col("e.source").eqNullSafe(F.col("g.source")), "left").select(
        "e.source", (F.col("rest") - F.col("full") - F.coalesce(F.col("more"), F.lit(0))).alias("gap")
    )
    closing = (
        drawn.where("not in and size > 0").alias("d").join(gaps.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
        .groupBy("d.source")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), F.col("key"), F.col("doc_id"), F.col("rid"))).getField("rid").alias("rid"))
        .select("rid", F.lit(1).alias("closing"))
    )
    closing = materialize(closing, "mix-closing")
    closing = F.broadcast(closing) if closing.count() <= SENT_SOURCES else closing
    copies = F.col("epochs") + F.col("in").cast("bigint") + F.coalesce(F.col("closing"), F.lit(0))
    return drawn.join(closing, "rid", "left").withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rid", *(["row"] if keep else [])
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), **how) -> DataFrame:
    """The rows of ``docs``, each as often as mix_sources() takes it, all columns kept.

    Rows are counted where they are read: a slice of a source is taken or not as a
    whole, and only the slice in which its words end is sorted, so no text of the others
    is shuffled. Repeated rows and null ids keep their own counts.
    """
    many = mix_sources(docs, weights, keep=True, **how).where("copies > 0")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
