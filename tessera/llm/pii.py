"""Personal data by fixed patterns, extended by bootstrapped contextual extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, CACHES, frugal, materialize

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# The base patterns. Each is linear in the text; email is found from its sign.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser shapes of the same kinds, of which contexts pick identifiers.
_LOOSE = (
    re.compile(r"(?<![^\s<(\[\"':,;=])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?(?:\(at\)|\[at\]) ?|@)[A-Za-z0-9-]{2,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}){0,4}"),
    re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}::?){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9])[0-9](?:[._/][0-9]|[0-9]){12,24}(?![0-9])"),
    re.compile(r"(?<![0-9+(])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the leftmost non-overlapping base matches of each kind, sorted."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((place, 1, place + size))
            place += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, bool]]:
    """(start, kind, end, known, candidate) of the looser shapes: those inside a base span of
    their kind are known, those that meet no base span are candidates. Numbers of a
    card's length that fail its checksum are neither."""
    out = []
    for kind, pattern in enumerate(_LOOSE):
        if kind == 0 and "@" not in text and "at" not in text:
            continue
        if kind == 1 and text.count(":") < 3:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            met = [(x, k, y) for x, k, y in base if x < b and a < y]
            known = any(k == kind and x <= a and b <= y for x, k, y in met)
            able = not met
            if kind == 2:
                digits = re.sub(r"[._/]", "", m[0])
                able = able and 14 <= len(digits) <= 19 and luhn(digits)
            if known or not met:
                out.append((a, kind, b, known, able))
    return sorted(out)


#: Tokens a worker remembers the hash of (some 200 bytes each).
REMEMBERED = 80_000
_heads: dict[str, int] = {}
CACHES.append(_heads)
#: Kinds of patterns: the word before, the word behind; fixed odd numbers that keep them apart.
BEFORE, BEHIND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _word_hash(token: str) -> int:
    """Hash of a token's letters in lower case; of one without letters the token, digits of more than four signs alike."""
    h = _heads.get(token)
    if h is None:
        if len(_heads) >= REMEMBERED:
            _heads.clear()
        key = token.lower() if token.isalpha() else "".join(filter(str.isalpha, token.lower())) or (token if len(token) <= 4 else re.sub("[0-9]+", "#", token))
        h = _heads[token] = xxhash.xxh3_64_intdigest(key)
    return h


def _single(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (hashes ^ kind) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(31))


def _context(hashes: np.ndarray) -> np.ndarray:
    """Hash of each pair of words that follow one another: the pattern before a place."""
    with np.errstate(over="ignore"):
        h = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] + np.uint64(0xC2B2AE3D27D4EB4F))
        return h ^ (h >> np.uint64(29))


def _words_before(text: str, start: int) -> list[str]:
    """The last two words that end before ``start``, however long they are."""
    reach = 64
    while True:
        words = text[max(0, start - reach) : start].split()
        if len(words) > 2 or reach >= start:
            return words[-2:]
        reach *= 4


def _word_behind(text: str, end: int) -> str | None:
    """The first whole word that begins behind ``end``; signs that touch the place are passed over."""
    m = _BEHIND.match(text, end)
    return m[1] if m else None


_BEHIND = re.compile(r"\S*\s+(\S+)")


def patterns_at(text: str, start: int, end: int) -> list[int]:
    """The lexical patterns of a place: two words before it, one word before it, one word behind it."""
    before = np.array([_word_hash(w) for w in _words_before(text, start)], np.uint64)
    out = _context(before).tolist() + _single(before[-1:], BEFORE).tolist()
    behind = _word_behind(text, end)
    if behind is not None:
        out += _single(np.array([_word_hash(behind)], np.uint64), BEHIND).tolist()
    return [_signed(x) for x in out]


def shape_of(kind: int, span: str) -> int | None:
    """The pattern of a card within: its first digit and the number of its digits."""
    if kind != 2:
        return None
    digits = re.sub("[^0-9]", "", span)
    return _signed(xxhash.xxh3_64_intdigest(f"card:{digits[0]}:{len(digits)}"))


SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Bits of the table that tells which patterns are worth counting; its size does not grow with the input.
BITS = 1 << 22


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mentions_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Known and possible instances with their patterns; of other numbers of a card's shape, the shape alone."""
    out = []
    seen = set()
    for a, k, b, known, able in [*((a, k, b, True, False) for a, k, b in base), *loose_spans(text, base)]:
        if (a, k, b) in seen:
            continue
        seen.add((a, k, b))
        used = patterns_at(text, a, b) if known or able else []
        out.append(dict(start=a, kind=k, end=b, known=known, able=able, shape=shape_of(k, text[a:b]), patterns=used, instance=_signed(xxhash.xxh3_64_intdigest(text[a:b]))))
    return out


@frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([*span, pa.field("known", pa.bool_()), pa.field("able", pa.bool_()), pa.field("shape", pa.int64()), pa.field("patterns", pa.list_(pa.int64())), pa.field("instance", pa.int64())])
    for batch in batches:
        base, mentions = [], []
        for text in batch["text"].to_pylist():
            found = base_spans(text)
            base.append([dict(start=a, kind=k, end=b) for a, k, b in found])
            mentions.append(mentions_of(text, found))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(base, pa.list_(span)), pa.array(mentions, pa.list_(mention))], names=["doc_id", "th", "base", "mentions"])


def _pattern_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern of ``patterns`` occurs around any word of ``texts``.

    A fixed table of BITS bits tells which words and pairs may be patterns; those are
    counted a batch at a time, and summed and matched exactly by Spark.
    """
    places = patterns.select(F.pmod(F.col("pattern"), F.lit(BITS)).cast("int").alias("at"))
    words = places.selectExpr("shiftright(at, 6) as w", "shiftleft(1L, at & 63) as b")
    table = np.zeros(BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # BITS / 64 rows at most
        table[r["w"]] = r["b"]
    shared = texts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            kept = []
            for text in batch["text"].to_pylist():
                words = text.split()
                if len(words) < 2:
                    continue
                h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
                for made in (_context(h)[:-1], _single(h[:-1], BEFORE), _single(h[1:], BEHIND)):
                    at = (made.view(np.int64) % BITS).astype(np.int64)
                    kept.append(made[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1])
            keys, n = np.unique(np.concatenate(kept) if kept else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    totals = texts.select("text").mapInArrow(count, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("total"))
    return totals.join(patterns.select("pattern").distinct(), "pattern")


def find_personal_data(docs: DataFrame, *, rounds: int = 3, least_seeds: int = 5, confidence: float = 0.6) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, base (spans of the fixed patterns) and added (spans that
    contexts add), each an array of (start, kind, end) by start then kind, kind
    counting in KINDS, in code points with the end exclusive.

    The base matches, and the looser shapes inside them, are seeds. The lexical
    patterns of a place are the two words before it, the word before it and the word
    behind it, and, of a card, its first digit with its length. Patterns and instances
    (looser shapes of the same kinds that meet no base span, and seeds) form a
    graph whose edges count mentions. In each round a pattern is induced by
    ``least_seeds`` different instances of its kind that have reached ``confidence``,
    those of earlier rounds among them; its trust is the share of all its occurrences in
    the corpus, around whatever word, that lead to instances, by their scores. An
    instance scores as its best pattern; seeds keep score 1. Instances of
    ``confidence`` or more are added wherever they are mentioned by a pattern of that
    trust.

    A null or empty text has no spans. Repeated rows have equal spans; a null
    doc_id is an id like others. An empty table gives an empty result; other columns
    are ignored. All counts cover all documents.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    mention = "array<struct<start:int,kind:int,end:int,known:boolean,able:boolean,shape:bigint,patterns:array<bigint>,instance:bigint>>"
    scanned = texts.withColumn("th", F.xxhash64("text")).mapInArrow(_scan, f"doc_id {kind}, th bigint, base {SPAN}, mentions {mention}")
    scanned = materialize(scanned, "pii")
    mentions = scanned.where("size(mentions) > 0").select("doc_id", "th", F.inline("mentions"))
    used = mentions.where("known or able").withColumn("pattern", F.explode(F.expr("if(shape is null, patterns, array_append(patterns, shape))")))
    edges = used.groupBy("kind", "pattern", "instance").agg(F.max("known").alias("known"), F.count("*").alias("n"))
    edges = materialize(edges, "pii-edges")
    # only patterns that could come to stand for an unseen instance are counted over the corpus
    patterns = edges.groupBy("kind", "pattern").agg(F.count("*").alias("c"), F.min("known").alias("all")).where((F.col("c") >= least_seeds) & ~F.col("all")).select("kind", "pattern")
    patterns = materialize(patterns, "pii-patterns")
    shapes = mentions.where("shape is not null").groupBy(F.col("shape").alias("pattern")).agg(F.count("*").alias("total")).join(patterns.select("pattern").distinct(), "pattern")
    totals = materialize(_pattern_totals(texts, patterns).unionAll(shapes.select("pattern", "total")), "pii-totals")
    graph = materialize(edges.join(patterns, ["kind", "pattern"]).join(totals, "pattern"), "pii-graph")

    score: Column = F.when(F.col("known"), 1.0).otherwise(0.0)
    scores = graph.groupBy("kind", "instance").agg(F.max(score).alias("score"))
    for _ in range(rounds):
        share = F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / F.max("total"))
        induced = F.count(F.when(F.col("score") >= confidence, 1)) >= least_seeds
        rated = graph.join(scores, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.when(induced, share).otherwise(0.0).alias("trust"))
        again = graph.join(rated, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max(F.when(F.col("known"), 1.0).otherwise(F.col("trust"))).alias("score"))
        scores, trusted = materialize(again, "pii-scores"), materialize(rated, "pii-trust")

    fine = scores.where(F.col("score") >= confidence).select("kind", "instance")
    led = trusted.where(F.col("trust") >= confidence).select("kind", "pattern")
    more = used.where("able").join(fine, ["kind", "instance"]).join(led, ["kind", "pattern"])
    more = more.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added")).select(F.col("doc_id").alias("i"), F.col("th").alias("h"), "added")
    out = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
