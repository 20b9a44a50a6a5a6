"""Guarded lifecycle of records: each event is judged by the state that the events before it left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import scratch_folder

#: States, the first is where a record begins (fixed values).
STATES = ("proposed", "verified", "active", "superseded", "rejected", "retracted", "expired", "quarantined")
#: Events that one task folds at a time.
CHUNK = 1024


def refusal(state: Column, op: Column, evidence: Column, confirmed: Column) -> Column:
    """Why an event does not apply to a record in ``state``; null if it does."""
    closed = state.isin("quarantined", "rejected", "retracted", "expired")
    return (
        F.when((op == "verify") & closed, F.concat(F.lit("cannot_verify_"), state))
        .when((op == "verify") & ~F.coalesce(evidence, F.lit(False)), "verification_needs_evidence")
        .when((op == "activate") & (closed | (state == "superseded")), F.concat(F.lit("cannot_activate_"), state))
        .when((op == "activate") & (state != "verified") & ~F.coalesce(confirmed, F.lit(False)), "activation_needs_verification")
        .when((op == "reject") & (state == "active"), "active_must_be_retracted")
        .when((op == "supersede") & (state != "active"), "only_active_is_superseded")
        .when((op == "retract") & ~state.isin("active", "verified"), "only_active_or_verified_is_retracted")
        .when(op.isNull() | ~op.isin("verify", "activate", "reject", "supersede", "retract", "expire", "quarantine"), "unknown_event")
    )


def after(state: Column, op: Column, evidence: Column, confirmed: Column) -> Column:
    """The state that an event leaves: its own, or, where it is refused, the one it met."""
    own = F.when(op == "verify", "verified").when(op == "activate", "active").when(op == "reject", "rejected").when(op == "supersede", "superseded").when(op == "retract", "retracted").when(op == "expire", "expired").when(op == "quarantine", "quarantined")
    return F.when(refusal(state, op, evidence, confirmed).isNull(), own).otherwise(state)


def judge(events: DataFrame, key: str, order: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``events`` (``key``, ``order``, op, evidence, confirmed) with state_before, state and refused (a reason, or null).

    An event is a map from states to states, and maps compose. So the events are range-sorted,
    cut into chunks, and each chunk folded for every state that it may begin in;
    a fold over the chunks of a key tells which it does begin in, and the chunk's events are judged
    from there. No task holds all events of a key. ``order`` decides, ties by what the event says;
    a null key is a key."""
    order = list(order)
    rows = events.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit("\0null")))
    ties = [*order, "op", "evidence", "confirmed"]
    laid = rows.repartitionByRange("_k", *ties).sortWithinPartitions("_k", *ties)
    laid = laid.withColumn("_at", F.monotonically_increasing_id())
    packed = laid.groupBy("_k", F.floor(F.col("_at") / chunk).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_at", "op", "evidence", "confirmed", F.struct(*events.columns).alias("row")))).alias("_events"))
    starts = F.array(*[F.lit(s) for s in STATES])
    fold = F.aggregate("_events", starts, lambda states, e: F.transform(states, lambda s: after(s, e["op"], e["evidence"], e["confirmed"])))
    # written, so that both readers see one numbering
    at = scratch_folder(events.sparkSession, "chunks")
    packed = packed.withColumn("_map", fold)
    packed.write.parquet(at)
    packed = events.sparkSession.read.schema(packed.schema).parquet(at)
    # the state at the start of each chunk, in order
    maps = packed.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_chunk", "_map"))).alias("_maps"))
    zero = F.struct(F.lit(STATES[0]).alias("state"), F.array().cast("array<struct<_chunk:bigint,state:string>>").alias("seen"))

    def step(acc: Column, m: Column) -> Column:
        seen = F.array_append(acc["seen"], F.struct(m["_chunk"].alias("_chunk"), acc["state"].alias("state")))
        return F.struct(F.element_at(m["_map"], F.array_position(starts, acc["state"]).cast("int")).alias("state"), seen.alias("seen"))

    begun = maps.select("_k", F.explode(F.aggregate("_maps", zero, step, lambda acc: acc["seen"])).alias("_s")).select("_k", "_s._chunk", F.col("_s.state").alias("_start"))
    ready = packed.join(begun, ["_k", "_chunk"])
    first = F.struct(F.col("_start").alias("state"), F.array().cast("array<struct<state_before:string,state:string,refused:string>>").alias("out"))

    def decide(acc: Column, e: Column) -> Column:
        now = after(acc["state"], e["op"], e["evidence"], e["confirmed"])
        said = F.struct(acc["state"].alias("state_before"), now.alias("state"), refusal(acc["state"], e["op"], e["evidence"], e["confirmed"]).alias("refused"))
        return F.struct(now.alias("state"), F.array_append(acc["out"], said).alias("out"))

    judged = ready.select(F.arrays_zip(F.col("_events.row").alias("row"), F.aggregate("_events", first, decide, lambda acc: acc["out"]).alias("said")).alias("z"))
    return judged.select(F.explode("z").alias("z")).select("z.row.*", "z.said.*")


def latest(judged: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """State of each key after all its events, and how many were taken and refused."""
    return judged.groupBy(key).agg(F.max_by("state", F.struct(*order, "op")).alias("state"), F.count_if(F.col("refused").isNull()).alias("taken"), F.count_if(F.col("refused").isNotNull()).alias("refused"))
