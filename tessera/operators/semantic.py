"""Random indexing with the context of terms, and the similarity of texts that it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn

#: Dimensions, marked positions of a term, reach of its context, its share, occurrences that count, slots (fixed values).
DIMS, MARKS, REACH, SHARE, OCCURRENCES, SLOTS = 256, 8, 5, 0.3, 512, 64
#: Parts by which occurrences of one term are numbered.
PARTS = 64


def part_of(key: Column) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("bigint") % PARTS).cast("int")


def base_vectors(terms: DataFrame) -> DataFrame:
    """(term, dim, v): the sparse vector of each term of ``terms``, of length 1. Positions come from
    its SHA-256, each with the sign of the position's parity; equal positions add up."""
    spots = F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda j: F.conv(F.substring(F.sha2("term", 256), j * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    sign = F.when(F.col("h") % 2 == 0, 1).otherwise(-1)
    sums = terms.select("term").distinct().select("term", F.explode(spots).alias("h")).groupBy("term", (F.col("h") % DIMS).cast("int").alias("dim")).agg(F.sum(sign).alias("s")).where("s <> 0")
    return _unit(sums, "term", "s", "v")


def _unit(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Vectors in long form, scaled to length 1."""
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value)).cast("double")).alias("_norm"))
    return rows.join(norm, key).where("_norm > 0").select(key, "dim", (F.col(value) / F.col("_norm")).alias(name))


def sampled_occurrences(docs: DataFrame, key: str, most: int = OCCURRENCES) -> DataFrame:
    """(key, pos, term, context) of the occurrences that count: of a term with more than ``most`` every
    nth, n the least that leaves ``most`` or fewer.

    Only terms that frequent are numbered, and not in one task: by parts of the
    documents, each part's first number a prefix sum over the parts."""
    terms = docs.select(key, part_of(F.col(key)).alias("part"), fn.terms(F.col("text")).alias("terms"))
    context = F.concat(F.slice("terms", F.greatest(F.lit(1), F.col("pos") + 1 - REACH), F.least(F.col("pos"), F.lit(REACH))), F.slice("terms", F.col("pos") + 2, F.lit(REACH)))
    rows = terms.select(key, "part", "terms", F.posexplode("terms").alias("pos", "term")).withColumn("context", context).drop("terms")
    per = terms.select("part", F.explode("terms").alias("term")).groupBy("term", "part").agg(F.count("*").alias("n"))
    total = Window.partitionBy("term")
    before = Window.partitionBy("term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("n").over(total)).where(F.col("total") > most)
    per = per.select("term", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.ceil(F.col("total") / most).alias("stride"))
    marked = rows.join(per, ["term", "part"], "left")
    rest = marked.where("stride is null").select(key, "pos", "term", "context")
    w = Window.partitionBy("term", "part").orderBy(key, "pos")
    many = marked.where("stride is not null").withColumn("at", F.col("first") + F.row_number().over(w) - 1)
    return rest.unionByName(many.where("at % stride = 0").select(key, "pos", "term", "context"))


def term_vectors(docs: DataFrame, key: str, most: int = OCCURRENCES) -> DataFrame:
    """(term, dim, v), of length 1: a term's own vector and SHARE of the mean vector around each occurrence.

    What stands around a term is summed by pairs of terms first, then by dimension; the
    sampling bounds the pairs of one term, however frequent."""
    around = sampled_occurrences(docs, key, most).where(F.size("context") > 0)
    pairs = around.select("term", F.explode("context").alias("near"), (F.lit(SHARE) / F.size("context")).alias("w")).groupBy("term", "near").agg(F.sum("w").alias("w"))
    base = base_vectors(docs.select(F.explode(fn.terms(F.col("text"))).alias("term")))
    drawn = pairs.join(base.select(F.col("term").alias("near"), "dim", "v"), "near").select("term", "dim", (F.col("w") * F.col("v")).alias("v"))
    sums = base.unionByName(drawn).groupBy("term", "dim").agg(F.sum("v").alias("s"))
    return _unit(sums, "term", "s", "v")


def weights(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, w): the root of a term's count times log2(1 + N / df) + 1/2; N counts all documents."""
    tf = docs.select(key, F.explode(fn.terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    idf = df.select("term", (F.log2(1 + F.col("n") / F.col("df")) + 0.5).alias("idf"))
    return tf.join(idf, "term").select(key, "term", (F.sqrt(F.col("tf").cast("double")) * F.col("idf")).alias("w"))


def document_vectors(weighted: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, dim, v): the weighted sum of a document's term vectors, of length 1."""
    sums = weighted.join(vectors, "term").groupBy(key, "dim").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    return _unit(sums, key, "s", "v")


def slot_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots of two MinHash signatures; 0 where one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t))
    return F.when((F.size(a) == 0) | F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull()), 0.0).otherwise(same / F.size(a))


def expanded(terms: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Distinct terms with the aliases of each."""
    if not aliases:
        return F.array_distinct(terms)
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))))


def semantic_search(docs: DataFrame, key: str, query: str, *, k: int = 20, most: int = OCCURRENCES, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The ``k`` documents nearest to the document whose ``key`` is ``query``, itself left out: key, ri, tfidf, minhash, overlap, score.

    score = max(0.70 ri + 0.20 tfidf + 0.10 minhash, 0.72 overlap): cosines of the random-indexing and of the
    weighted term vectors, equal MinHash slots, and the share of the query's terms, with their
    aliases, that a document holds. The query's own vectors are the only side sent to all."""
    aliases = aliases or {}
    vectors, w = term_vectors(docs, key, most), weights(docs, key)
    dv = document_vectors(w, vectors, key)
    mine = F.col(key).cast("string") == query
    ri = dv.where(~mine).join(F.broadcast(dv.where(mine).select("dim", F.col("v").alias("q"))), "dim").groupBy(key).agg(F.sum(F.col("v") * F.col("q")).alias("ri"))
    tv = w.select(key, F.col("term").alias("dim"), "w")
    tv = _unit(tv, key, "w", "v")
    tfidf = tv.where(~mine).join(F.broadcast(tv.where(mine).select("dim", F.col("v").alias("q"))), "dim").groupBy(key).agg(F.sum(F.col("v") * F.col("q")).alias("tfidf"))
    sets = docs.select(key, expanded(fn.terms(F.col("text")), aliases).alias("set")).withColumn("sig", fn.minhash(F.col("set"), SLOTS))
    own = sets.where(mine).select(F.col("set").alias("qset"), F.col("sig").alias("qsig")).limit(1)
    rows = sets.where(~mine).crossJoin(F.broadcast(own))
    rows = rows.select(key, slot_similarity(F.col("sig"), F.col("qsig")).alias("minhash"), (F.size(F.array_intersect("qset", "set")) / F.greatest(F.lit(1), F.size("qset"))).alias("overlap"))
    rows = rows.join(ri, key, "left").join(tfidf, key, "left").fillna(0.0, ["ri", "tfidf"])
    six = lambda c: F.round(F.greatest(F.lit(0.0), F.col(c)), 6).alias(c)
    rows = rows.select(key, six("ri"), six("tfidf"), six("minhash"), six("overlap"))
    score = F.greatest(0.70 * F.col("ri") + 0.20 * F.col("tfidf") + 0.10 * F.col("minhash"), 0.72 * F.col("overlap"))
    return rows.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)
