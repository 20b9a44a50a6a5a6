"""Selection under constraints: records forced in, a greedy choice by marginal gain, an early stop, a reason for every record left out."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.selection import by_request
from tessera.sources.shared import scratch_folder

#: Weight of each feature, caps of categories, bonuses, thresholds and limits (fixed values).
FEATURE_WEIGHTS = {
    "source_fusion": 12.0, "objective_relevance": 4.0, "step_relevance": 2.0, "entity_coverage": 4.0, "relation_coverage": 2.0, "authority": 1.0, "confidence": 1.0,
    "preference_applicable": 1.5, "outcome_evidence": 1.5, "temporal_applicability": 0.5, "kind_priority": 1.5, "token_efficiency": 1.0,
}
CATEGORY_CAPS = {"governance": 6, "workingState": 4, "decisions": 4, "preferences": 3, "evidence": 4, "procedures": 3, "episodes": 3, "artifacts": 3, "negative": 2, "examples": 2, "other": 2}
KIND_CATEGORY = {
    "policy": "governance", "constraint": "governance", "state": "workingState", "plan": "workingState", "task": "workingState", "decision": "decisions", "preference": "preferences",
    "observation": "evidence", "evidence": "evidence", "fact": "evidence", "claim": "evidence", "procedure": "procedures", "runbook": "procedures", "episode": "episodes", "memory": "episodes",
    "artifact": "artifacts", "negative": "negative", "negative-context": "negative", "retraction": "negative", "example": "examples",
}
KIND_PRIORITY = {"policy": 1.0, "constraint": 1.0, "decision": 0.85, "preference": 0.7, "observation": 0.65, "evidence": 0.65, "fact": 0.65, "procedure": 0.5, "episode": 0.5, "artifact": 0.5}


@dataclass(frozen=True)
class Constraints:
    diversity: float = 1.25
    new_entity: float = 0.75
    new_category: float = 0.15
    duplicate: float = 0.92
    same_path: float = 0.72
    least_utility: float = 0.35
    least_marginal: float = 0.2
    least_evidence: int = 2
    least_use: float = 0.0
    most_selected: int = 12
    most_candidates: int | None = None
    most_folded: int = 4096
    required_ratio: float = 1.0
    caps: dict = field(default_factory=lambda: dict(CATEGORY_CAPS))


def _lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def category_of(kind: Column, status: Column | None = None) -> Column:
    """Category of a record by its kind; a retracted or quarantined one of no other category is negative."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_CATEGORY.items() for x in kv]), kind)
    gone = status.isin("retracted", "quarantined") if status is not None else F.lit(False)
    return F.coalesce(found, F.when(gone, "negative"), F.lit("other"))


def features(now: Column) -> dict[str, Column]:
    """The twelve features of a candidate, to 6 places, from columns objective, step, text_terms (arrays of
    terms), tags, relations, required_entities (arrays), authority, confidence, outcome, kind,
    valid_from, valid_to, tokens and ranks (array of struct<weight, rank>: where sources list it)."""
    both, wanted = F.array_distinct(F.concat("relations", "tags")), F.array_distinct("required_entities")
    share = lambda hits: F.when(F.size(wanted) == 0, 0.0).otherwise(hits / F.size(wanted))
    objective, step = fn.overlap(F.array_distinct("objective"), F.array_distinct("text_terms")), fn.overlap(F.array_distinct("step"), F.array_distinct("text_terms"))
    entities = share(F.size(F.array_intersect(both, wanted)))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    fusion = F.aggregate("ranks", F.lit(0.0), lambda s, x: s + x["weight"] / (60 + x["rank"]))
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= now)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= now))
    made = {
        "source_fusion": fusion, "objective_relevance": objective, "step_relevance": step, "entity_coverage": entities,
        "relation_coverage": share(F.size(F.filter("relations", lambda x: F.array_contains("required_entities", x)))),
        "authority": unit(F.coalesce("authority", F.lit(0.5))), "confidence": unit(F.coalesce("confidence", F.lit(0.5))),
        "preference_applicable": F.when((F.col("kind") == "preference") & ((objective > 0) | (step > 0) | (entities > 0)), 1.0).otherwise(0.0),
        "outcome_evidence": unit(F.coalesce("outcome", F.lit(0.0))), "temporal_applicability": valid.cast("double"), "kind_priority": _lookup(KIND_PRIORITY, F.col("kind"), 0.35),
        "token_efficiency": unit(1 / F.greatest(F.lit(1.0), F.col("tokens") / 32)),
    }
    return {k: F.round(c.cast("double"), 6) for k, c in made.items()}


def weighted(weights: dict[str, float] = FEATURE_WEIGHTS) -> Column:
    """Utility from the feature columns: the weighted sum, to 6 places."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name)
    return F.round(total, 6)


def _six(x: float) -> float:
    """To 6 places, halves away from zero, as SQL engines round doubles."""
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x)


def _like(a: dict, b: dict, c: Constraints) -> float:
    if a["hash"] is not None and a["hash"] == b["hash"]:
        return 1.0
    union = len(a["shingles"] | b["shingles"])
    same = len(a["shingles"] & b["shingles"]) / union if union else 0.0
    return max(same, c.same_path) if a["path"] and a["path"] == b["path"] else same


def choose(rows: list[dict], budget: int, required: set, entities: set, c: Constraints) -> tuple[list[tuple], bool]:
    """Decisions (record, state, position, marginal, reasons) on one request's records, and whether the choice suffices.

    A record's gain only falls as others are taken: likeness rises, bonuses go. So a gain
    computed earlier bounds it from above, and the queue rescores what is at its head,
    until a record rescored is still the best."""
    out: list[tuple] = [(r["record"], "excluded", None, None, ",".join(r["against"])) for r in rows if r["against"]]
    rows = [r for r in rows if not r["against"]]
    clash = any(r["conflict"] for r in rows)
    missing = required - {r["record"] for r in rows}
    forced = sorted((r for r in rows if r["record"] in required or r["governance"]), key=lambda r: (r["record"] not in required, r["record"]))
    error = (
        "required_context_unresolved" if missing else "required_context_conflict" if any(r["conflict"] for r in forced if r["record"] in required)
        else "required_context_over_budget" if sum(r["tokens"] for r in forced) > int(budget * c.required_ratio) else None
    )
    if error:
        return out + [(r["record"], "refused", None, None, error) for r in rows] + ([(None, "refused", None, None, error)] if not rows else []), False
    taken, held, spent, covered = list(forced), {}, sum(r["tokens"] for r in forced), set()
    for k, r in enumerate(forced, 1):
        out.append((r["record"], "selected", k, 1000.0, "required" if r["record"] in required else "governance"))
        held[r["category"]] = held.get(r["category"], 0) + 1
        covered |= r["entities"]
    near: dict = {}

    def gain(r: dict) -> float:
        done, worst = near.get(r["record"], (0, 0.0))
        near[r["record"]] = (len(taken), max([worst, *(_like(r, t, c) for t in taken[done:])]))
        bonus = (c.new_entity if (r["entities"] & entities) - covered else 0.0) + (0.0 if held.get(r["category"]) else c.new_category)
        return _six(r["utility"] - c.diversity * _six(near[r["record"]][1]) + bonus)

    def enough() -> bool:
        evidence = sum(t["category"] == "evidence" for t in taken)
        return entities <= covered and evidence >= c.least_evidence and spent / max(1, budget) >= c.least_use and (not clash or all(r in taken for r in rows if r["conflict"]))

    chosen = {r["record"] for r in forced}
    by_place = [r for r in rows if r["record"] not in chosen]
    queue = [(-gain(r), r["tokens"], r["record"], len(taken), i) for i, r in enumerate(by_place)]
    heapq.heapify(queue)
    while queue and len(taken) < c.most_selected:
        g, tokens, record, seen, i = heapq.heappop(queue)
        r = by_place[i]
        if seen < len(taken):
            fresh = (-gain(r), tokens, record, len(taken), i)
            if queue and fresh > queue[0]:
                heapq.heappush(queue, fresh)
                continue
            g = fresh[0]
        reasons = [
            name for name, bad in (
                ("below_minimum_utility", r["utility"] < c.least_utility), ("redundant", _six(near[record][1]) >= c.duplicate), ("category_cap", held.get(r["category"], 0) >= c.caps.get(r["category"], 2)),
                ("token_budget", spent + tokens > budget), ("insufficient_marginal_utility", -g < c.least_marginal),
            ) if bad
        ]
        if reasons:
            out.append((record, "excluded", None, -g, ",".join(reasons)))
            continue
        news = ["entity_coverage" if (r["entities"] & entities) - covered else "complementary_evidence", "kind_overlap" if held.get(r["category"]) else "diversity_gain"]
        taken.append(r)
        out.append((record, "selected", len(taken), -g, ",".join(news)))
        held[r["category"]], spent, covered = held.get(r["category"], 0) + 1, spent + tokens, covered | r["entities"]
        if enough():
            for *_, k in queue:
                gain(by_place[k])
                out.append((by_place[k]["record"], "excluded", None, by_place[k]["utility"], "redundant" if _six(near[by_place[k]["record"]][1]) >= c.duplicate else "sufficient_without"))
            queue = []
    out += [(by_place[k]["record"], "excluded", None, by_place[k]["utility"], "maximum_candidate_count") for *_, k in queue]
    return out, enough()


def _rounded(x: Column) -> Column:
    """``_six`` of a column."""
    return F.signum(x) * (F.floor(F.abs(x) * 1e6 + 0.5) / 1e6)


def _replay(c: Constraints) -> Column:
    """What the rounds of a request (column rounds) made of a record: near, done, marginal, why, position.

    A round says what was taken before it (took), the state then, and the record that it took (best);
    it settles that record and those that are refused ahead of it. One that is open has no best yet, and leaves
    the record undone with its gain, its key in the order of judgement, and why it would be refused."""

    def like(t: Column) -> Column:
        same = fn.jaccard(F.col("shingles"), t["shingles"])
        path = F.coalesce((F.col("path") != "") & (F.col("path") == t["path"]), F.lit(False))
        return F.when(F.col("hash") == t["hash"], 1.0).when(path, F.greatest(same, F.lit(c.same_path))).otherwise(same)

    caps = _lookup({k: int(v) for k, v in c.caps.items()}, F.col("category"), 2) if c.caps else F.lit(2)

    def judged(h: Column, near: Column) -> Column:
        like_, held = _rounded(near), F.size(F.filter(h["held"], lambda k: k.eqNullSafe(F.col("category"))))
        fresh = F.size(F.array_except(F.array_intersect("entities", "wanted"), h["covered"])) > 0
        g = _rounded(F.col("utility") - F.lit(c.diversity) * like_ + (F.when(fresh, c.new_entity).otherwise(0.0) + F.when(held > 0, 0.0).otherwise(c.new_category)))

        def settled(g: Column) -> Column:
            bad = F.concat_ws(",", *[F.when(x, name) for name, x in (
                ("below_minimum_utility", F.col("utility") < c.least_utility), ("redundant", like_ >= c.duplicate), ("category_cap", held >= caps),
                ("token_budget", h["spent"] + F.col("tokens") > F.col("budget")), ("insufficient_marginal_utility", g < c.least_marginal),
            )])
            took = h["best"]["record"] == F.col("record")
            ahead = F.struct((-g).alias("g"), F.col("tokens"), F.col("record")) < h["best"]
            news = F.concat(F.when(fresh, "entity_coverage").otherwise("complementary_evidence"), F.lit(","), F.when(held > 0, "kind_overlap").otherwise("diversity_gain"))
            over = h["mode"].isin("enough", "full")
            done = over | (h["mode"] == "none") | F.coalesce(took | (ahead & (bad != "")), F.lit(False))
            late = F.when(h["mode"] == "full", "maximum_candidate_count").when(like_ >= c.duplicate, "redundant").otherwise("sufficient_without")
            return F.struct(
                near.alias("near"), done.alias("done"), F.when(over, F.col("utility")).otherwise(g).alias("marginal"),
                F.when(over, late).when(took, news).otherwise(bad).alias("why"), F.when(took, h["n"] + 1).cast("int").alias("position"),
            )

        return fn.once(g, settled)

    def step(said: Column, h: Column) -> Column:
        near = F.greatest(said["near"], F.coalesce(F.array_max(F.transform(h["took"], like)), F.lit(0.0)))
        return F.when(said["done"], said).otherwise(fn.once(near, lambda x: judged(h, x)))

    none = F.struct(F.lit(0.0).alias("near"), F.lit(False).alias("done"), F.lit(None).cast("double").alias("marginal"), F.lit("").alias("why"), F.lit(None).cast("int").alias("position"))
    return F.aggregate("rounds", none, step)


def _by_rounds(sets: DataFrame, candidates: DataFrame, c: Constraints) -> DataFrame:
    """The decisions of ``choose`` on requests of any number of records, which stay where they lie.

    A round a record taken: all records are judged in their tasks against what was taken so
    far, and the first that nothing is held against is a minimum by request. Only the rounds of a
    request, of at most ``most_selected`` records and those forced in, are sent to the tasks."""
    spark = candidates.sparkSession
    at = scratch_folder(spark, "rounds")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    no = lambda x: F.coalesce(x, F.lit(False))
    some = lambda x: F.array_distinct(F.coalesce(F.col(x), F.array().cast("array<string>")))
    must = no(F.array_contains("required", F.col("record")))
    rows = candidates.join(F.broadcast(sets), "request").where("record is not null").select(
        "request", "record", F.coalesce("utility", F.lit(math.nan)).alias("utility"), F.col("tokens").cast("bigint").alias("tokens"), "category", some("entities").alias("entities"), some("shingles").alias("shingles"),
        "hash", "path", no(F.col("conflict")).alias("conflict"), F.coalesce("against", F.array().cast("array<string>")).alias("against"), must.alias("must"), (must | no(F.col("governance"))).alias("forced"),
    )
    rows = stored(rows, "rows")
    fit, forced = rows.where(F.size("against") == 0), (F.size("against") == 0) & F.col("forced")
    sums = rows.groupBy("request").agg(
        F.collect_set(F.when(forced & F.col("must"), F.col("record"))).alias("found"), F.coalesce(F.sum(F.when(forced, F.col("tokens"))), F.lit(0)).alias("spent"), F.bool_or(forced & F.col("must") & F.col("conflict")).alias("clash"),
        F.count_if((F.size("against") == 0) & F.col("conflict")).alias("conflicts"), F.count_if(F.size("against") == 0).alias("fit"),
    )
    missing = F.size(F.array_except(F.coalesce("required", F.array().cast(dict(sets.dtypes)["required"])), "found")) > 0
    error = F.when(missing, "required_context_unresolved").when(F.col("clash"), "required_context_conflict").when(F.col("spent") > F.floor(F.col("budget") * F.lit(float(c.required_ratio))), "required_context_over_budget")
    asked = stored(sets.join(sums, "request").select("request", "budget", F.array_distinct(F.coalesce("wanted", F.array().cast("array<string>"))).alias("wanted"), "spent", "conflicts", "fit", error.alias("error")), "asked")
    refused, met = asked.where("error is not null"), asked.where("error is null")

    one = F.struct((~F.col("must")).alias("later"), "record", "category", "entities", "conflict", F.struct("shingles", "hash", "path").alias("like"))
    first = met.join(fit.where("forced").groupBy("request").agg(F.array_sort(F.collect_list(one)).alias("forced")), "request", "left").withColumn("forced", F.coalesce("forced", F.array()))
    kind, tokens = dict(rows.dtypes)["record"], "bigint"
    took, held = F.transform("forced", lambda x: x["like"]), F.transform("forced", lambda x: x["category"])
    n, taken_clashes = F.size("forced"), F.size(F.filter("forced", lambda x: x["conflict"])).cast("bigint")
    covered = F.array_distinct(F.flatten(F.transform("forced", lambda x: x["entities"])))

    def enough(covered: Column, held: Column, spent: Column, clashes: Column) -> Column:
        evidence = F.size(F.filter(held, lambda k: k == "evidence"))
        return no((F.size(F.array_except("wanted", covered)) == 0) & (evidence >= c.least_evidence) & (spent / F.greatest(F.lit(1), F.col("budget")) >= c.least_use) & (clashes == F.col("conflicts")))

    best = F.lit(None).cast(f"struct<g: double, tokens: {tokens}, record: {kind}>")
    entry = lambda took, n, spent, held, covered, mode: F.struct(took.alias("took"), n.cast("int").alias("n"), spent.cast("bigint").alias("spent"), held.alias("held"), covered.alias("covered"), mode.alias("mode"), best.alias("best"))
    state = first.select(
        "request", "budget", "wanted", "conflicts", taken_clashes.alias("clashes"), enough(covered, held, F.col("spent"), taken_clashes).alias("sufficient"),
        F.array(entry(took, n, F.col("spent"), held, covered, F.when(n >= c.most_selected, "full").otherwise("judge"))).alias("rounds"),
    )
    state = stored(state, "round-0")
    rest = fit.where("not forced")
    last = F.element_at("rounds", -1)
    turn = 0
    while not (live := state.where(last["mode"] == "judge")).isEmpty():
        turn += 1
        seen = rest.join(F.broadcast(live.select("request", "budget", "wanted", "rounds")), "request").withColumn("said", _replay(c)).where("not said.done and said.why = ''")
        picked = F.struct((-F.col("said.marginal")).alias("g"), "tokens", "record", "category", "entities", "conflict", F.struct("shingles", "hash", "path").alias("like"))
        top = live.join(seen.groupBy("request").agg(F.min(picked).alias("t")), "request", "left")
        t, found = F.col("t"), F.col("t").isNotNull()
        key = F.struct(t["g"].alias("g"), t["tokens"].alias("tokens"), t["record"].alias("record"))
        now = F.transform("rounds", lambda h, i: F.when(i == F.size("rounds") - 1, h.withField("best", F.when(found, key)).withField("mode", F.when(found, F.lit("judge")).otherwise("none"))).otherwise(h))
        held, covered, spent = F.concat(last["held"], F.array(t["category"])), F.array_union(last["covered"], t["entities"]), last["spent"] + t["tokens"]
        clashes, n = F.col("clashes") + t["conflict"].cast("bigint"), last["n"] + 1
        stop = enough(covered, held, spent, clashes)
        after = entry(F.array(t["like"]), n, spent, held, covered, F.when(stop, "enough").when(n >= c.most_selected, "full").otherwise("judge"))
        top = top.select(
            "request", "budget", "wanted", "conflicts", F.when(found, clashes).otherwise(F.col("clashes")).alias("clashes"), F.when(found, stop).otherwise(F.col("sufficient")).alias("sufficient"),
            F.when(found, F.concat(now, F.array(after))).otherwise(now).alias("rounds"),
        )
        state = stored(state.where(last["mode"] != "judge").unionByName(top), f"round-{turn}")

    null = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, state, position, marginal, why, ok: df.select("request", "record", state.alias("state"), position.cast("int").alias("position"), marginal.cast("double").alias("marginal"), why.alias("reasons"), ok.alias("sufficient"))
    judged = rest.join(F.broadcast(state), "request").withColumn("said", _replay(c))
    all_of = state.select("request", "sufficient").unionByName(refused.select("request", F.lit(False).alias("sufficient")))
    inside = first.join(state.select("request", "sufficient"), "request").select("request", "sufficient", F.posexplode("forced").alias("i", "x")).withColumn("record", F.col("x.record"))
    parts = [
        shape(judged, F.when(F.col("said.position").isNotNull(), "selected").otherwise("excluded"), F.col("said.position"), F.col("said.marginal"), F.col("said.why"), F.col("sufficient")),
        shape(inside, F.lit("selected"), F.col("i") + 1, F.lit(1000.0), F.when(F.col("x.later"), "governance").otherwise("required"), F.col("sufficient")),
        shape(rows.where(F.size("against") > 0).join(F.broadcast(all_of), "request"), F.lit("excluded"), null("int"), null("double"), F.array_join("against", ","), F.col("sufficient")),
        shape(fit.join(F.broadcast(refused.select("request", "error")), "request"), F.lit("refused"), null("int"), null("double"), F.col("error"), F.lit(False)),
        shape(refused.where("fit = 0").withColumn("record", null(kind)), F.lit("refused"), null("int"), null("double"), F.col("error"), F.lit(False)),
    ]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made


def select_constrained(requests: DataFrame, candidates: DataFrame, c: Constraints = Constraints()) -> DataFrame:
    """A decision on every candidate of every request.

    ``requests``: request, budget, required (ids that must be in), entities (that the
    choice should cover). ``candidates``: request, record, utility, tokens, category,
    entities, shingles, hash, path, governance, conflict, and against (reasons why
    it is not eligible, empty if it is). Returns request, record, state (selected,
    excluded, or refused where the request cannot be met), position, marginal,
    reasons, and sufficient, which holds of the whole request.

    Required and governing records come first; a request whose required ones are missing,
    in conflict or over budget is refused whole, with that reason. Then the record with
    the largest utility - diversity * (likeness to the most alike one taken) + bonuses for
    new entities and a new category is judged, ties to fewer tokens, then the smaller id,
    until the choice suffices or the most are taken. All candidates are judged: those of a
    request of ``most_folded`` at most in one task, those of a larger one by rounds, where they
    lie. Only a caller who sets ``most_candidates`` has those beyond the so many of largest
    utility, after those forced in, excluded with the reason candidate_limit. A request without candidates is
    refused if it requires any, and has no row otherwise.
    """
    kinds = dict(candidates.dtypes)
    sets = requests.select("request", F.col("budget").cast("bigint").alias("budget"), "required", F.col("entities").alias("wanted"))
    rows = sets.join(candidates, "request", "left")
    beyond = None
    if c.most_candidates is not None:
        must = F.coalesce(F.array_contains("required", F.col("record")) | F.col("governance"), F.lit(False))
        order = Window.partitionBy("request").orderBy((F.size("against") > 0).cast("int"), must.desc(), F.col("utility").desc(), "tokens", "record")
        rows = rows.withColumn("place", F.row_number().over(order))
        beyond = rows.where((F.col("place") > c.most_candidates) & F.col("record").isNotNull())
        rows = rows.where(F.col("place") <= c.most_candidates)
    schema = f"request {kinds['request']}, record {kinds['record']}, state string, position int, marginal double, reasons string, sufficient boolean"
    large = candidates.groupBy("request").agg(F.count("*").alias("_n")).where(F.col("_n") > c.most_folded).select("request")
    many = c.most_candidates is None and not large.isEmpty()
    if many:
        rows = rows.join(F.broadcast(large), "request", "left_anti")
    inside = rows.where(F.col("record").isNotNull() | (F.size("required") > 0))

    def fold(part: list[dict]) -> list[dict]:
        first = part[0]
        some = lambda x: set() if x is None else set(x)
        held = [
            {**r, "utility": math.nan if r["utility"] is None else r["utility"], "entities": some(r["entities"]), "shingles": some(r["shingles"]), "governance": bool(r["governance"]), "conflict": bool(r["conflict"])}
            for r in part if r["record"] is not None
        ]
        found, enough = choose(held, first["budget"], some(first["required"]), some(first["wanted"]), c)
        return [dict(zip(("record", "state", "position", "marginal", "reasons"), x, strict=True), sufficient=enough) for x in found]

    needed = ("request", "record", "utility", "tokens", "category", "entities", "shingles", "hash", "path", "governance", "conflict", "against", "budget", "required", "wanted")
    judged = by_request(inside.select(*needed), fold, schema)
    if many:
        judged = judged.unionByName(_by_rounds(sets.join(F.broadcast(large), "request"), candidates.join(F.broadcast(large), "request"), c))
    if beyond is None:
        return judged
    none = lambda kind: F.lit(None).cast(kind)
    reasons = F.when(F.size("against") > 0, F.array_join("against", ",")).otherwise("candidate_limit")
    return judged.unionByName(beyond.select("request", "record", F.lit("excluded").alias("state"), none("int").alias("position"), none("double").alias("marginal"), reasons.alias("reasons"), none("boolean").alias("sufficient")))


def assemble(decisions: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """Selected records in the order of their sections, governing ones first, each shown in full, as a
    snippet of 240 characters, an outline, or its place alone, as the running budget allows."""
    section = _lookup({name: i for i, name in enumerate(CATEGORY_CAPS)}, F.col("category"), len(CATEGORY_CAPS))
    rows = decisions.where("state = 'selected'").select("request", "record", "position").join(records, ["request", "record"]).withColumn("section", section)
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("request").orderBy("section", "position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    shown = F.when(F.col("tokens") <= left, "full").when(left >= 60, "snippet").when(left >= 20, "outline").when(left > 0, "locator").otherwise("excluded")
    text = F.when(shown == "full", F.col("text")).when(shown == "snippet", F.substring("text", 1, 240)).when(shown == "outline", F.substring_index("text", "\n", 1)).when(shown == "locator", F.col("record").cast("string"))
    return rows.select("request", "record", "section", F.row_number().over(Window.partitionBy("request").orderBy("section", "position")).alias("place"), shown.alias("shown"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))


def manifest(decisions: DataFrame, assembled: DataFrame) -> DataFrame:
    """A row a request: digest of all decisions and of what is shown, in a fixed order; equal work, equal etag."""
    said = F.to_json(F.struct("record", "state", "position", "marginal", "reasons"))
    a = decisions.groupBy("request").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.coalesce(said, F.lit("")))), "\n"), 256).alias("decided"), F.count_if(F.col("state") == "selected").alias("n_selected"), F.count("*").alias("n"))
    b = assembled.groupBy("request").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "shown", "digest"))), lambda x: F.concat_ws(":", x["shown"], x["digest"])), "\n"), 256).alias("shown"))
    both = a.join(b, "request", "left")
    return both.withColumn("etag", F.sha2(F.concat_ws("|", "decided", F.coalesce("shown", F.lit(""))), 256)).select("request", "n", "n_selected", "decided", "shown", "etag")


def verify(stored: DataFrame, decisions: DataFrame, assembled: DataFrame) -> DataFrame:
    """Whether each stored manifest is what its decisions and texts give now: same, changed, missing (none now) or new."""
    now = manifest(decisions, assembled).select("request", F.col("etag").alias("now"))
    rows = stored.select("request", F.col("etag").alias("held")).join(now, "request", "full_outer")
    state = F.when(F.col("held").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("held") == F.col("now"), "same").otherwise("changed")
    return rows.select("request", state.alias("state"))
