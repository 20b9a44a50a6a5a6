"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, unit


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0..len(weights)-1 of ``key`` by weighted rendezvous hashing.

    Each shard draws -ln(u)/weight with u from the hash of (key, shard); the
    smallest draw wins, ties to the smaller shard. Draws of other shards do not
    depend on how many shards there are, so one more shard only takes rows into
    itself, and a changed weight moves rows only to or from that shard. A shard
    of weight 0 gets nothing. A null key counts as the empty key.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights: none negative, one positive at least")
    draws = [
        F.struct((-F.log(unit(key, F.lit(j))) / F.lit(float(w))).alias("draw"), F.lit(j).alias("shard"))
        for j, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*draws)).getField("shard")


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, and place inside the shard, of every row of ``docs``.

    Returns ``key``, size (UTF-8 bytes + 8), text_crc32, shard, slot and
    grown_shard (the shard under ``grown_weights``; null without them). Slots
    count from 0 in each shard without gaps, by key (null first), then checksum.
    They come from a range sort over all rows and a prefix sum over its
    partitions, so no shard meets in one task. Only key and digest columns are
    shuffled, never texts. Null text: size 8, checksum 0. Repeated rows each get
    a slot. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body).cast("bigint") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown"),
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "shards")
    order = ["shard", "k", "crc", "rid"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "slots")
    parts = laid.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return laid.join(parts, ["shard", "part"]).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard")
    )
