"""Compact views of texts by what they are; matching, sort keys, estimates; conflicts, coverage and residues of records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn

#: Lines that a view keeps at most, and, of each kind of text, first lines, last lines, and what makes a line matter (fixed values).
MOST_LINES = 32
KINDS = {
    "json": (6, 6, r'["{}\[\],:]'), "log": (4, 6, r"(?i)\b(?:error|warn|exception|traceback|failed|fatal)\b"), "code": (8, 4, r"^\s*(?:import|export|class|function|const|let|fn|struct|impl)\b"),
    "markdown": (6, 4, r"^\s*(?:#{1,6}\s|[-*]\s)"), "text": (6, 4, r"(?i)\b(?:must|should|error|decision|policy|todo|fix|fail)\b"),
}
#: Words of a question that match nothing (fixed values).
QUESTION_WORDS = ("what", "which", "who", "where", "when", "why", "how", "is", "the", "a", "an", "by", "does", "do", "for", "to", "of", "provider", "default", "implements")


def text_kind(text: Column) -> Column:
    """json, markdown, log, code or text, by the first of these that fits."""
    lines = F.size(F.split(text, "\r?\n"))
    return (
        F.when(text.rlike(r"^\s*[\[{]"), "json").when(text.rlike(r"^\s*#{1,6}\s|\n\s*[-*]\s"), "markdown")
        .when(text.rlike(KINDS["log"][2]) & (lines > 4), "log").when(text.rlike(r"\b(?:import|export|function|class|const|let|fn|struct|impl)\b"), "code").otherwise("text")
    )


def compact(text: Column, kind: Column, most: int = MOST_LINES) -> Column:
    """First and last lines and those that matter to the kind, ``most`` at most, in order; the number of the rest behind them.

    Lines are trimmed, empty ones dropped; a text of ``most`` lines or fewer stays whole.
    The text is split once: its lines stand in an array of one, whose transform names them."""
    trimmed = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def by_kind(value: Callable[[tuple], Column]) -> Column:
        return reduce(lambda when, name: when.when(kind == name, value(KINDS[name])), KINDS, F)

    def short(v: Column) -> Column:
        left = v["n"] - F.size(v["kept"])
        return F.array_join(F.when(left > 0, F.array_append(v["kept"], F.concat(F.lit("... "), left.cast("string"), F.lit(" lines omitted ...")))).otherwise(v["kept"]), "\n")

    def view(v: Column) -> Column:
        matters = lambda x, i: (i < v["first"]) | (i >= F.greatest(v["first"], v["n"] - v["last"])) | by_kind(lambda r: x.rlike(r[2]))
        kept = F.slice(F.filter(v["lines"], matters), 1, most)
        return F.when(v["n"] <= most, F.array_join(v["lines"], "\n")).when(v["first"].isNotNull(), fn.once(F.struct(v["n"].alias("n"), kept.alias("kept")), short))

    named = lambda x: F.struct(x.alias("lines"), F.size(x).alias("n"), by_kind(lambda r: F.lit(r[0])).alias("first"), by_kind(lambda r: F.lit(r[1])).alias("last"))
    return fn.once(trimmed, lambda x: fn.once(named(x), view))


def question_terms(query: str) -> list[str]:
    """Terms that a question looks for: its words but QUESTION_WORDS, and each without a final s."""
    words = [w for w in "".join(c if c.isascii() and (c.isalnum() or c in ":_-") else " " for c in query.lower()).split() if w not in QUESTION_WORDS]
    return [t for w in words for t in ([w, w[:-1]] if w.endswith("s") else [w]) if t]


def matches(query: str, *parts: Column) -> Column:
    """Whether any term of the question stands anywhere in the parts; a question without terms matches all."""
    terms, hay = question_terms(query), F.lower(F.concat_ws(" ", *parts))
    test = F.lit(not terms)
    for t in dict.fromkeys(terms):
        test = test | F.contains(hay, F.lit(t))
    return test


def sort_key(value: Column, number: bool = False) -> Column:
    """Text by which mixed values sort: numbers filled to 20 places, null before all."""
    return F.coalesce(F.lpad(value.cast("string"), 20, "0") if number else value.cast("string"), F.lit(""))


def utf16_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.encode(text, "UTF-16LE")) / 8)).cast("bigint")


def byte_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def pointed(json: Column, pointer: str) -> Column:
    """The value that a JSON pointer (/a/0/b) names, as text; null if there is none."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in (x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]))
    return F.get_json_object(json, path)


def endpoint_languages(edges: DataFrame) -> DataFrame:
    """Languages by suffix of both ends and the source of every edge, each counted."""
    places = edges.select(F.explode(F.array("src", "dst", "source")).alias("place"))
    return places.groupBy(fn.language_of(F.col("place")).alias("language")).agg(F.count("*").alias("n"))


def key_conflicts(records: DataFrame) -> DataFrame:
    """Conflict keys of ``records`` (conflict_key, value, record) under which they say different things, with
    how many values and records, and the first record."""
    agg = records.where("conflict_key is not null").groupBy("conflict_key").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_records"), F.min("record").alias("first"))
    return agg.where("n_values > 1")


def coverage(selected: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row a request: entities wanted, represented by the records selected, and the unresolved ones, sorted and joined.

    ``selected``: request, entities (array); ``wanted``: request, entities (array)."""
    held = selected.select("request", F.explode("entities").alias("e")).distinct().groupBy("request").agg(F.collect_set("e").alias("held"))
    rows = wanted.join(held, "request", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    asked = F.array_distinct("entities")
    return rows.select("request", F.size(asked).alias("n_wanted"), F.size(F.array_intersect(asked, "held")).alias("n_represented"), F.array_join(F.array_sort(F.array_except(asked, "held")), ",").alias("unresolved"))


def lineage_residue(facts: DataFrame, proposals: DataFrame, most: int = 50) -> DataFrame:
    """Active facts whose proposal is gone or was rejected, the oldest first: fact_id, residue (missing or rejected)."""
    held = proposals.select("fact_id", F.col("status").alias("proposal"))
    rows = facts.where("status = 'active'").join(held, "fact_id", "left")
    residue = F.when(F.col("proposal").isNull(), "missing").when(F.col("proposal") == "rejected", "rejected")
    return rows.withColumn("residue", residue).where("residue is not null").orderBy("valid_from", "fact_id").limit(most).select("fact_id", "residue")
