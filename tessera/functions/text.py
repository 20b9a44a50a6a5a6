"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of keyword queries (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "which", "with")
#: Suffix of a path and its language (fixed values).
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "rs": "rust", "go": "go", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "lua": "lua",
    "sh": "bash", "bash": "bash", "zsh": "bash", "sql": "sql", "m": "objectivec", "mm": "objectivec", "scala": "scala", "sc": "scala", "dart": "dart", "r": "r", "jl": "julia", "zig": "zig", "md": "markdown", "json": "json",
}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it.

    A lambda of a higher-order function works out anew, for every element, what it names
    from outside; what another lambda hands to it is a value."""
    return F.element_at(F.transform(F.array(value), f), 1)


def collapse(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def terms(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_terms(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits of any script, so accented words stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def normal_form(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form (NFC, NFD, NFKC, NFKD), by Arrow batches: Spark has no function for it."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no normal form {form}")

    @F.arrow_udf("string")
    def normal(batch: pa.Array) -> pa.Array:
        return pa.array([x if x is None else unicodedata.normalize(form, x) for x in batch.to_pylist()], pa.string())

    return normal(text)


def identifier_parts(name: Column) -> Column:
    """Parts of a camelCase, snake_case or numbered identifier, lower-cased, and the identifier itself first."""
    split = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    parts = F.regexp_extract_all(F.lower(split), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lower(name)), parts))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix), F.lit("other"))


def entity_type(name: Column) -> Column:
    """Type of a graph node from the prefix of its name."""
    return F.when(F.contains(name, F.lit(":")), F.lower(F.substring_index(name, ":", 1))).otherwise("entity")


def canonical_digest(*fields: str) -> Column:
    """SHA-256 of the JSON object of ``fields`` in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays of distinct members; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the root of the product of the sizes; 0 with an empty side."""
    both = F.size(a) * F.size(b)
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(both.cast("double")))


def decode_markup(html: Column) -> Column:
    """Visible text of markup: no scripts, styles or tags, entities decoded (&amp; first), white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]*>", " ")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return collapse(text)


def redact(text: Column) -> Column:
    """Secrets, mail addresses and home folders masked."""
    text = F.regexp_replace(text, r"(?i)(password|token|secret)(\s*=\s*)\S+", "$1$2[redacted]")
    text = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]")
    return F.regexp_replace(text, r"/(home|Users)/[A-Za-z0-9._-]+", "/[home]")


def percent(a: Column, b: Column) -> Column:
    """Rounded 100 a / b; 0 if b is 0."""
    return F.coalesce(F.round(F.lit(100.0) * a / F.nullif(b, F.lit(0))), F.lit(0.0)).cast("bigint")


def locator_parts(url: Column) -> Column:
    """A locator without scheme and fragment, and its last two segments."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[#?].*$", "")
    return F.struct(path.alias("path"), F.array_join(F.slice(F.split(path, "/"), -2, 2), "/").alias("ref"))


def minhash(tokens: Column, slots: int) -> Column:
    """Array of the smallest digests of salted tokens, as hex strings in the order of bytes."""
    return F.array(*[F.array_min(F.transform(tokens, lambda t: F.substring(F.md5(F.concat(F.lit(f"{i}:"), t).cast("binary")), 1, 16))) for i in range(slots)])


def answer_covered(text: Column, answer: Column) -> Column:
    """Whether a text holds an answer: verbatim, or 67 % of its terms of 3 letters or more (all, if two at most)."""
    wanted = F.array_distinct(F.filter(terms(answer), lambda t: F.length(t) >= 3))
    hits = F.size(F.array_intersect(wanted, F.array_distinct(terms(text))))
    need = F.when(F.size(wanted) <= 2, F.size(wanted)).otherwise(F.ceil(F.size(wanted) * 0.67))
    return F.contains(F.lower(collapse(text)), F.lower(collapse(answer))) | ((F.size(wanted) > 0) & (hits >= need))
