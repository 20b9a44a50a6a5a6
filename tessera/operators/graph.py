"""Graph analytics over edge lists (src, predicate, dst), as joins and aggregates.

Iterative operators take one join a round, over the frontier only, and write each
round's result to the shared checkpoint folder where a cluster names one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.sources.shared import Folder, scratch_folder


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage between rounds: a checkpoint in the shared folder, or in one below the warehouse if none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch_folder(df.sparkSession, "rounds"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, made once: what was written to the shared folder, whose size tells Spark whether a join may send it whole."""
    at = scratch_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree, out-degree and degree of each node: one exchange over both ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def resolve(names: DataFrame, query: str) -> DataFrame:
    """Best node for a name: exact, else the same in another case, else one that contains it; first by name."""
    q, n = F.lit(query), F.col("node")
    kind = F.when(n == q, 0).when(F.lower(n) == F.lower(q), 1).when(F.contains(F.lower(n), F.lower(q)), 2)
    return names.select("node", kind.alias("match_class")).where("match_class is not null").orderBy("match_class", "node").limit(1)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select("dst", "src")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, *, directed: bool = False) -> DataFrame:
    """Nodes within ``depth`` hops of the seeds, and the first hop that reaches each.

    Edges stay where they lie as long as the nodes seen are few enough to be sent to them; what a round reaches counts once."""
    hops = edges.select("src", "dst")
    hops = hops if directed else hops.unionAll(edges.select("dst", "src"))
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "round")
    for k in range(1, depth + 1):
        reached = seen.where(F.col("depth") == k - 1).join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(k))
        if k < depth:
            seen = written(seen.unionAll(fresh), "round")
        else:
            seen = seen.unionAll(fresh)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, *, hops: int = 12, directed: bool = False) -> DataFrame:
    """One shortest path, as (step, node): of several the one whose nodes come first. A node keeps its first path only."""
    steps = edges.select("src", "dst").distinct() if directed else undirected(edges)
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    frontier = seen
    for _ in range(hops):
        if not seen.where(F.col("node") == goal).isEmpty():
            break
        ahead = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = _cut(ahead.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where(F.col("node") == goal).select(F.posexplode("path").alias("step", "node"))


def reverse_impact(calls: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """Callers that lead to changed functions, with the fewest calls between; modules are passed over."""
    back = calls.where(~F.startswith("caller", F.lit("module:"))).select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    return neighbourhood(back, changed, depth, directed=True)


def trace_paths(edges: DataFrame, start: str, depth: int, limit: int = 100, *, direction: str = "outbound", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Simple paths of 1 to ``depth`` edges, short ones first, ``limit`` at most: along the edges, against them
    (inbound), or either way at each step (both); over edges of ``kinds`` (predicate), if given."""
    edges = edges if kinds is None else edges.where(F.col("predicate").isin(*kinds))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"outbound": edges.select("src", "dst"), "inbound": back, "both": edges.select("src", "dst").unionAll(back)}[direction].distinct()
    paths = edges.sparkSession.createDataFrame([([start],)], "path array<string>")
    found, n = [], 0
    for _ in range(depth):
        last = F.element_at("path", -1)
        grown = paths.join(steps, last == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        paths = _cut(grown)
        found.append(paths)
        n += paths.limit(limit).count()
        if n >= limit:
            break  # longer paths come behind all of these
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    text = F.array_join("path", " > ")
    return every.select((F.size("path") - 1).alias("n_edges"), text.alias("path")).orderBy("n_edges", "path").limit(limit)


def label_propagation(edges: DataFrame, passes: int) -> DataFrame:
    """Communities by synchronous label propagation: each node takes the commonest label around it, the smallest of equals."""
    links = undirected(edges)
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(passes):
        votes = links.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = F.min(F.struct(-F.col("n"), F.col("label").alias("label"))).getField("label")
        labels = _cut(votes.groupBy(F.col("src").alias("node")).agg(best.alias("label")))
    return labels


def community_stats(edges: DataFrame, labels: DataFrame, sample: int = 5) -> DataFrame:
    """Nodes, edges by source end, and the first node names of each community."""
    w = Window.partitionBy("label").orderBy("node")
    members = labels.withColumn("r", F.row_number().over(w))
    nodes = members.groupBy("label").agg(F.count("*").alias("n_nodes"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= sample, F.col("node")))), ",").alias("sample"))
    links = edges.join(labels, edges["src"] == labels["node"]).groupBy("label").agg(F.count("*").alias("n_edges"))
    return nodes.join(links, "label", "left").select("label", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "sample")


def dead_code(nodes: DataFrame, calls: DataFrame, excluded: Column) -> DataFrame:
    """Functions that nothing calls and that are not excluded (entry points, tests, exports)."""
    called = calls.select(F.col("callee").alias("node")).distinct()
    return nodes.join(called, "node", "left_anti").where(~excluded)


def overview(calls: DataFrame, top: int = 10) -> DataFrame:
    """Entry points (call, are not called) and hotspots (by degree), ``top`` of each."""
    e = degrees(calls.select(F.col("caller").alias("src"), F.lit("CALLS").alias("predicate"), F.col("callee").alias("dst")))
    entry = e.where("out_degree > 0 and in_degree = 0").orderBy(F.col("out_degree").desc(), "node").limit(top).select(F.lit("entry_point").alias("kind"), "node", F.col("out_degree").alias("score"))
    hot = e.orderBy(F.col("degree").desc(), "node").limit(top).select(F.lit("hotspot").alias("kind"), "node", F.col("degree").alias("score"))
    return entry.unionAll(hot)


def cross_source(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Edges whose ends live in different sources, from (node, source)."""
    a, b = homes.select(F.col("node").alias("src"), F.col("source").alias("from_source")), homes.select(F.col("node").alias("dst"), F.col("source").alias("to_source"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("from_source <> to_source")


def languages(edges: DataFrame) -> DataFrame:
    """Languages of the sources that edges come from."""
    return edges.groupBy(fn.language_of(F.col("source")).alias("language")).agg(F.count("*").alias("n"))


def _toggle(part: int):
    """Fold of 64-bit digests into the parities of one quarter of 256 bits."""
    return lambda bits, x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(3)) == part, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int")))).otherwise(bits)


def _parity():
    """Of each array of digests the parity of how many fall on each of 4 to 8 times as many bits (a power of two, 64 or more)."""

    @F.arrow_udf("binary")
    def parity(tokens: pa.Array) -> pa.Array:
        ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            n = 1 << max(6, int(4 * (b - a)).bit_length())
            out.append(np.packbits((np.bincount(values[a:b] & (n - 1), minlength=n) & 1).astype(np.uint8)).tobytes())
        return pa.array(out, pa.binary())

    return parity


def _apart():
    """Number of bits in which two such parities differ; the longer is folded to the length of the other."""

    @F.arrow_udf("int")
    def apart(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            out.append(int(np.bitwise_count(x ^ y).sum()))
        return pa.array(out, pa.int32())

    return apart


#: Counters of a sketch of how many sets hold a token.
_COUNTERS = 1 << 22


def _rarest(classes: DataFrame, threshold: float):
    """Of each set's ``tokens`` and the ``code`` of its language the rarest tokens, told apart by language, as many as no other that reaches the threshold can miss all of.

    Rarity is the count of one of 4 million counters, which tokens may share. What the order needs for exact results is only
    that it is the same for all sets; so no token is sent to learn how many hold it, and none to come back."""
    at = F.explode("tokens").alias("t")
    sums = classes.select("code", at).groupBy(F.col("t").bitwiseXOR(F.col("code")).bitwiseAND(F.lit(_COUNTERS - 1)).cast("int").alias("i")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(_COUNTERS, np.int32)
    counts[sums["i"].to_numpy()] = np.minimum(sums["n"].to_numpy(), 2**31 - 1)
    shared = classes.sparkSession.sparkContext.broadcast(counts)
    last = _COUNTERS - 1

    @F.arrow_udf("array<bigint>")
    def rarest(tokens: pa.Array, code: pa.Array) -> pa.Array:
        ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
        held, out = shared.value, []
        for a, b, c in zip(ends[:-1], ends[1:], code.to_numpy(), strict=True):
            t = values[a:b] ^ c
            most = len(t) - math.ceil(len(t) * threshold - 1e-9) + 1
            out.append(t[np.lexsort((t, held[t & last]))][:most])
        sizes = np.cumsum([0, *map(len, out)]).astype(np.int32)
        return pa.ListArray.from_arrays(sizes, np.concatenate([np.empty(0, np.int64), *out]))

    return rarest


def similar_sets(sets: DataFrame, key: str, *, threshold: float) -> DataFrame:
    """Rows (a, b, similarity) of the token sets of one ``language`` that reach a Jaccard threshold, whole.

    ``sets`` has ``key``, language and tokens (distinct). Equal sets are one class, named
    by its smallest key: its other members come as (name, member, 1.0). Pairs of classes
    come as (smaller name, larger name, similarity). Each class is indexed under its
    rarest tokens, as many as no class that reaches the threshold can miss all of.
    Of two that meet there only those go on whose sizes, whose tokens left after the one that
    they share, and whose parity bits allow the threshold: tokens toggle bits of 256, so two
    sets differ in no more bits than tokens. Long sets fill so few bits, and by chance too many
    of them pass: those that do are held against bits by the size of the sets, before
    any tokens are sent. What is left is checked exactly."""
    # written once: all that follows reads digests of tokens, not texts
    spark = sets.sparkSession
    at = scratch_folder(spark, "sets")
    for part in ("", "-copies", "-classes"):
        Folder(spark, f"{at}{part}").delete_on_exit()

    def stored(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{at}{part}")
        return spark.read.schema(df.schema).parquet(f"{at}{part}")

    digest = F.sha2(F.array_join("tokens", " "), 256).alias("digest")
    base = sets.select(F.col(key).alias("b"), "language", F.size("tokens").alias("n"), digest, F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    base = stored(base, "")
    names = base.groupBy("language", "digest").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("b", "row"))).alias("x")).select("language", "digest", F.col("x.b").alias("a"), F.col("x.row").alias("row"))
    members = base.select("b", F.col("language").alias("l"), F.col("digest").alias("d"))
    named = members.join(names, F.col("language").eqNullSafe(F.col("l")) & (F.col("digest") == F.col("d")))
    copies = stored(named.where("a <> b").select("a", "b", F.lit(1.0).alias("similarity")), "-copies")
    one = names.groupBy("a").agg(F.min("row").alias("row"))
    code = F.xxhash64("language")  # tokens of two languages are told apart by it
    classes = stored(base.join(one, "row").select("a", "language", "n", "tokens", code.alias("code")), "-classes")  # all steps below begin with them
    Folder(spark, at).delete("")  # what follows reads the classes alone
    bits = [F.aggregate("tokens", F.lit(0).cast("bigint"), _toggle(j)).alias(f"b{j}") for j in range(4)]
    told = classes.where("language is not null and a is not null")
    rare = told.select("a", "n", *bits, _rarest(told, threshold)("tokens", "code").alias("w")).select("a", "n", "b0", "b1", "b2", "b3", F.posexplode("w").alias("at", "t"))
    other = rare.select("t", *[F.col(c).alias(f"o_{c}") for c in ("a", "n", "at", "b0", "b1", "b2", "b3")])
    size = F.least("n", "o_n") >= F.greatest("n", "o_n") * F.lit(threshold) - 1e-9
    both = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("o_n")) - 1e-6
    rest = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) >= both
    apart = F.bit_count(F.col("b0").bitwiseXOR(F.col("o_b0")))
    for j in (1, 2, 3):
        apart = apart + F.bit_count(F.col(f"b{j}").bitwiseXOR(F.col(f"o_b{j}")))
    alike = apart <= F.col("n") + F.col("o_n") - 2 * both
    met = rare.join(other, "t").where((F.col("a") < F.col("o_a")) & size & rest & alike).select("a", F.col("o_a").alias("b")).distinct()
    # both ends join the same columns under the same names, so that they are sent once
    ends = lambda name, *columns: told.select(F.col("a").alias("k"), *columns).alias(name)
    wide = F.col("n").alias("n"), _parity()("tokens").alias("bits")
    near = met.join(ends("x", *wide), F.col("a") == F.col("x.k")).join(ends("y", *wide), F.col("b") == F.col("y.k"))
    both = F.lit(threshold / (1 + threshold)) * (F.col("x.n") + F.col("y.n")) - 1e-6
    met = near.where(_apart()("x.bits", "y.bits") <= F.col("x.n") + F.col("y.n") - 2 * both).select("a", "b")
    held = F.col("language").alias("language"), F.col("tokens").alias("tokens")
    scored = met.join(ends("x", *held), F.col("a") == F.col("x.k")).join(ends("y", *held), (F.col("b") == F.col("y.k")) & (F.col("x.language") == F.col("y.language")))
    scored = scored.withColumn("m", F.size(F.array_intersect("x.tokens", "y.tokens")))
    scored = scored.select("a", "b", F.round(F.col("m") / (F.size("x.tokens") + F.size("y.tokens") - F.col("m")), 6).alias("similarity"))
    return copies.unionByName(scored.where(F.col("similarity") >= threshold))
