"""Line deduplication by a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_table, materialize

#: What a variable field becomes; tokens that hold a digit are variable from the start.
ANY = "<*>"
#: Bytes of a written table of keys up to which it is sent to all executors.
SENT_BYTES = 8 << 20
#: Tokens, or characters, from which a line counts as long.
LONG_TOKENS, LONG_CHARS = 25, 150


def _sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table of rows of ``row_bytes`` at most, sent to all executors if that is SENT_BYTES at most."""
    return F.broadcast(df) if df.count() * row_bytes <= SENT_BYTES else df


def _lines(docs: DataFrame, min_tokens: int, min_chars: int, lead: int) -> DataFrame:
    """A row a line that has a word: doc_id, th (hash of the text), n, t (hash of its words,
    masked and one space apart), f1 and f2 (hashes of its first three tokens), and, of lines that are
    long enough to go, leaf (of the tree), long and words."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    line = F.col("line")
    odd = line.contains("  ") | line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    rows = rows.select("doc_id", "th", "n", F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line)).alias("words"))
    # a token with a digit, from its start: possessive, so linear in the token
    field = r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+"
    rows = rows.where("words <> ''").select("doc_id", "th", "n", F.when(F.col("words").rlike("[0-9]"), F.regexp_replace("words", field, ANY)).otherwise(F.col("words")).alias("words"))
    size = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    rows = rows.select("doc_id", "th", "n", "words", size.alias("size"), F.length("words").alias("chars"), F.md5(F.substring_index("words", " ", 3).cast("binary")).alias("head"))
    leaf = F.xxhash64("size", F.call_function("substring_index", F.col("words"), F.lit(" "), F.least(F.lit(lead), (F.col("size") / 2).cast("int") + 1)))
    able = (F.col("size") >= min_tokens) | (F.col("chars") >= min_chars)
    half = lambda at: F.conv(F.substring("head", at, 15), 16, 10).cast("bigint")
    return rows.select(
        "doc_id", "th", "n", F.xxhash64("words").alias("t"), half(1).alias("f1"), half(16).alias("f2"), F.when(able, leaf).alias("leaf"),
        (able & ((F.col("size") >= LONG_TOKENS) | (F.col("chars") >= LONG_CHARS))).alias("long"), F.when(able, F.col("words")).alias("words"),
    )


def _recurring(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys of ``rows`` (key, th, f1, f2, long) that recur across families of documents."""
    kinds = rows.groupBy(key).agg(F.count_distinct("th").alias("texts"), F.count_distinct("f1").alias("k1"), F.count_distinct("f2").alias("k2"), F.max("long").alias("long"))
    families = F.least("k1", "k2")
    return kinds.where((families >= F.when(F.col("long"), 2).otherwise(min_docs)) & (families * 5 >= F.col("texts"))).select(key)


def dropped_lines(docs: DataFrame, *, min_docs: int = 3, min_tokens: int = 4, min_chars: int = 24, lead: int = 6, similarity: float = 0.7) -> DataFrame:
    """Lines of ``docs`` (doc_id, text) to drop: rows (doc_id, th, n), th the text's hash.

    The tree has fixed depth: number of tokens, then the leading tokens, ``lead`` of
    them or one more than half of a short line's; tokens with a digit are variable. A
    line's first template is its tokens under that mask. Then each leaf with several
    templates generalises: a token that ``min_docs`` texts (two, of long lines) have at
    its place stays, any other is a variable field. Templates of which ``similarity``
    of the tokens stay are alike, and a place that is variable in one of them is
    variable in all of the leaf, as long as that share still stays.

    A template recurs if ``min_docs`` families of documents hold it, two if it is long,
    and those are a fifth of the texts that do. A family is told by the lines that no
    other text has: it is the smallest hash of the first three tokens of such a line
    (of two hashes the one that makes fewer families counts), so lines that are
    shared say nothing of it, while the copies of one document, exact or near, are one
    family, and are left to document dedup. A text all of whose lines are shared has no
    family; one that has a single template is a family by itself. The first line of a
    recurring template, by doc_id (null first), text hash and place, stays. Lines under
    both ``min_tokens`` tokens and ``min_chars`` characters are never dropped.
    """
    lines = materialize(_lines(docs, min_tokens, min_chars, lead), "lines")
    kinds = lines.groupBy("t").agg(F.min("leaf").alias("leaf"), F.max("long").alias("long"), F.min("th").alias("a"), F.max("th").alias("z"))
    kinds = materialize(kinds.select("t", "leaf", "long", "a", (F.col("a") < F.col("z")).alias("shared"), "z"), "kinds")
    # a leaf of two templates of a text each, not long, has no token that min_docs texts share
    heavy = (F.sum(F.when(F.col("shared"), min_docs).otherwise(1)) >= min_docs) | F.max("long")
    leaves = kinds.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"), heavy.alias("heavy")).where("n > 1 and a < z and heavy").select("leaf")
    leaves = materialize(leaves, "leaves")
    leafy = kinds.join(_sent(leaves, 8), "leaf").select("t", "leaf", "a")
    wanted = kinds.where("shared").select("t", "shared").unionAll(leafy.select("t", F.lit(False))).groupBy("t").agg(F.max("shared").alias("shared"))
    wanted, leafy = materialize(wanted, "wanted"), materialize(leafy, "leafy")

    # a row a text: its family, and those of its templates that may recur
    own = lambda f: F.min(F.when(F.coalesce("shared", F.lit(False)), None).otherwise(F.col(f)))
    texts = lines.select("th", "t", "f1", "f2", "long", F.col("leaf").isNotNull().alias("able")).join(_sent(wanted, 9), "t", "left").groupBy("th").agg(
        own("f1").alias("f1"), own("f2").alias("f2"), F.min("t").alias("lo"), F.max("t").alias("hi"),
        F.collect_set(F.when(F.col("able") & F.col("shared").isNotNull(), F.struct("t", "long", "shared"))).alias("held"),
    )
    alone = F.when(F.col("lo") == F.col("hi"), F.col("th"))
    held = texts.select("th", F.coalesce("f1", alone).alias("f1"), F.coalesce("f2", alone).alias("f2"), F.inline("held"))
    held = materialize(held, "held")
    first = materialize(_recurring(held.where("shared"), "t", min_docs), "templates")

    # leaves generalise over their distinct templates, each with the number of its texts
    some = lines.where("leaf is not null").select("t", "th", "long", "words").join(_sent(leafy, 24).withColumnRenamed("t", "k"), (F.col("t") == F.col("k")) & (F.col("th") == F.col("a")))
    some = some.select("t", "leaf", "long", "words").dropDuplicates(["t"]).join(held.groupBy("t").agg(F.count("*").alias("texts")), "t")
    some = materialize(some.select("t", "leaf", "long", "texts", F.split("words", " ").alias("toks")), "leafed")
    # a cell is a token at its place in a leaf, by its hash; only hashes and places are shuffled
    cells = some.select("t", "leaf", "long", "texts", F.posexplode("toks").alias("pos", "tok")).select("t", "long", "texts", "pos", F.xxhash64("leaf", "pos", "tok").alias("cell"))
    fixed = cells.groupBy("cell").agg(F.sum("texts").alias("texts"), F.max("long").alias("long"))
    fixed = materialize(fixed.where(F.col("texts") >= F.when(F.col("long"), 2).otherwise(min_docs)).select("cell"), "fixed")
    # about as many as there are templates' tokens, so never sent, at any size
    stays = cells.select("t", "pos", "cell").join(fixed.hint("merge"), "cell").groupBy("t").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    # the places that stay (kept), and those of them that are no field yet (named)
    marked = some.join(stays, "t").select("t", "leaf", "toks", "kept", F.filter("kept", lambda p: F.get("toks", p) != ANY).alias("named"))
    enough = lambda places: F.size(places) >= F.size("toks") * similarity
    alike = materialize(marked.where(enough(F.col("named"))), "alike")
    holes = alike.select("leaf", F.explode(F.array_except(F.sequence(F.lit(0), F.size("toks") - 1), "kept")).alias("pos"))
    holes = holes.groupBy("leaf").agg(F.sort_array(F.collect_set("pos")).alias("holes"))
    # a flag a place, false at holes, in one pass: a run of true up to each hole, then false
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "holes"), F.concat("holes", F.array(F.size("toks"))), lambda p, h: F.concat(F.array_repeat(F.lit(True), h - p - 1), F.array(F.lit(False))))
    ready = alike.join(holes, "leaf", "left").select("t", "leaf", "toks", "named", F.when(F.col("holes").isNotNull(), F.flatten(runs)).alias("open"))
    ready = ready.select("t", "leaf", "toks", "named", F.when(F.col("open").isNull(), F.col("named")).otherwise(F.filter("named", lambda p: F.get("open", p))).alias("both"))
    shape = lambda places: F.xxhash64("leaf", F.transform(places, lambda p: F.struct(p.alias("pos"), F.get("toks", p).alias("tok"))))
    general = materialize(ready.select("t", F.when(enough(F.col("both")), shape(F.col("both"))).otherwise(shape(F.col("named"))).alias("g")), "general")
    again = materialize(_recurring(held.join(_sent(general, 16), "t"), "g", min_docs), "again")

    groups = general.join(again, "g").select("t", "g").unionAll(first.join(general.join(again, "g"), "t", "left_anti").select("t", F.col("t").alias("g")))
    groups = materialize(groups, "groups")
    found = materialize(lines.where("leaf is not null").select("doc_id", "th", "n", "t").join(_sent(groups, 16), "t").select("doc_id", "th", "n", "g"), "recurring")
    opening = materialize(found.groupBy("g").agg(F.min(F.struct("doc_id", "th", "n")).alias("o")), "opening")
    out = materialize(found.join(_sent(opening, 40), "g").where(~(F.struct("doc_id", "th", "n").eqNullSafe(F.col("o")))).select("doc_id", "th", "n").distinct(), "dropped")
    for table in (lines, kinds, leaves, wanted, leafy, held, first, some, fixed, alike, general, again, groups, found, opening):
        drop_table(table)
    return out


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the lines of dropped_lines() taken out of its column text.

    All columns stay, and n_lines, n_dropped are added. Documents without such
    lines keep their text byte for byte; one whose lines all go has the empty
    text. A null text stays null (no lines); an empty text has one line, which is
    kept. Repeated rows are one document and are treated alike. An empty table
    gives an empty result. Columns of ``docs`` named like inner ones do not clash:
    only doc_id and text are looked at.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), **how)
    gone = gone.groupBy("doc_id", "th").agg(F.collect_list("n").alias("gone")).select(F.col("doc_id").alias("i"), "th", "gone")
    gone = materialize(gone, "gone")
    held, size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = F.broadcast(gone) if 32 * held + 4 * size <= SENT_BYTES else gone
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("h", F.xxhash64("row.text"))
    rows = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("th")), "left")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    return rows.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
