"""Exact Jaccard self-join of documents over word n-grams, by signature trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, CACHES, drop_table, frugal, give_back, materialize

#: Members and shingles of a candidate group that one task holds; larger groups go in pairs of chunks.
CHUNK_MEMBERS, CHUNK_SHINGLES = 4096, 4_000_000
#: Rows (of 80 bytes at most) up to which a list of documents is sent to all executors.
BROADCAST_ROWS = 100_000
#: Words a worker remembers the hash of (some 200 bytes each).
REMEMBERED = 80_000
#: Bytes of sets from which a task gives its memory back after a group.
LARGE = 4 << 20
#: Odd 64-bit multipliers (fixed values).
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_words: dict[bytes, int] = {}
CACHES.append(_words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``words``-word shingles of a UTF-8 text.

    A to Z are lower-cased, words end at ASCII white space. With fewer words the
    whole sequence is the one shingle; without any the set is empty.
    """
    tokens = text.lower().split() if text else []
    if len(_words) > REMEMBERED:
        _words.clear()
    for w in tokens:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, n)
    k = min(words, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * M1
        out ^= out >> np.uint64(31)
    return np.unique(_mixed(out))


def size_classes(least: int, most: int, num: int, den: int) -> list[int]:
    """Starts of the size classes up to ``most``; a class spans about (den/num)^2."""
    starts = [least]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, starts[-1] * den**2 // num**2))
    return starts


def partition_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set, one at least in common with every set it links with.

    Sets x, y with |x & y| / |x | y| >= num/den differ in at most
    H = (|x| + |y|)(den - num)/(den + num) shingles. Under a size class, with its
    largest size for both, shingles are dealt by hash into H + 1 parts and some to
    spare; all but H of the parts are then equal in x and y. A key is a part that is not
    empty. A set with so many empty parts that the equal ones may all be empty has one
    more key, for the class: of two linked sets either both have it, or one has an equal
    part that is not empty. A set has keys under its own class and under each larger one
    that a linked set can be in.
    """
    n = len(shingles)
    starts = size_classes(1, n * den // num + 1, num, den)
    own = max(i for i, s in enumerate(starts) if s <= n)
    lows, highs, keys = (shingles & np.uint64(0xFFFFFFFF)).astype(np.float64), (shingles >> np.uint64(32)).astype(np.float64), []
    dealt = _mixed(shingles + M1)
    for c in range(own, len(starts) - 1):
        if c > own and n * den < num * starts[c]:
            break
        differ = 2 * (starts[c + 1] - 1) * (den - num) // (den + num)
        parts = differ + 1 + max(2, differ // 4) if differ else 1
        at = (dealt % np.uint64(parts)).astype(np.int64)
        held = np.flatnonzero(np.bincount(at, minlength=parts)).astype(np.uint64)
        low, high = (np.bincount(at, x, parts)[held.astype(np.int64)].astype(np.uint64) for x in (lows, highs))
        keys.append(_mixed(_mixed(low + high * M1) + np.full(len(held), c, np.uint64) * M2 + held * M3))
        if len(held) <= differ:
            keys.append(_mixed(np.array([c], np.uint64) * M2 + M1))
    return np.concatenate(keys)


def width(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` tokens: the next power of two, 64 at least."""
    return 1 << max(6, (n - 1).bit_length())


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.uint64)
    b = (shingles & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
    return out


class SignatureTree:
    """Tree over sets: a node holds the OR of its sets' token bitmaps, the range of
    their sizes, and the most shingles of a set that share a bit with another."""

    LEAF, FAN = 16, 8

    def __init__(self, sizes: list[int], maps: np.ndarray):
        self.size = sizes = np.array(sizes, np.int64)
        self.maps = maps
        self.excess = self.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        bounds = np.arange(0, len(sizes), self.LEAF)
        level = (np.append(bounds, len(sizes)), np.bitwise_or.reduceat(maps, bounds), np.minimum.reduceat(self.size, bounds), np.maximum.reduceat(self.size, bounds), np.maximum.reduceat(self.excess, bounds))
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), self.FAN)
            level = (np.append(level[0][at], len(sizes)), np.bitwise_or.reduceat(level[1], at), np.minimum.reduceat(level[2], at), np.maximum.reduceat(level[3], at), np.maximum.reduceat(level[4], at))
            self.levels.append(level)


def linked_groups(sets: list[np.ndarray], num: int, den: int, other: list[np.ndarray] | None = None) -> np.ndarray:
    """Group number of each set under the links between ``sets``, or, with
    ``other``, between a set of ``sets`` and one of ``other`` (numbered behind)."""
    every = sets + (other or [])
    bits = 1 << min(16, max(8, int(4 * np.median([len(s) for s in every])).bit_length())) if every else 64
    side = lambda some: ([len(s) for s in some], np.array([bitmap(s, bits) for s in some]).reshape(len(some), bits // 64))

    def linked(i: int, j: int) -> bool:
        p, q = every[i], every[j]
        shared = len(np.intersect1d(p, q, assume_unique=True))
        return den * shared >= num * (len(p) + len(q) - shared)

    return walk_trees(side(sets), None if other is None else side(other), num, den, linked)


def walk_trees(first: tuple, second: tuple | None, num: int, den: int, linked=None) -> np.ndarray:
    """Group numbers from walking two signature trees, or one with itself, together.

    ``first`` and ``second`` are (sizes, bitmaps). A pair of nodes is left out if the
    most that two of their sets can share (bits in common and excess, or the smaller
    size) is less than a link of their sizes needs, or if all sets of both are in one
    group already. Sets that remain are joined if ``linked`` says so, or, without it,
    as pairs that may link."""
    n_first = len(first[0])
    group = np.arange(n_first + (len(second[0]) if second else 0))
    if len(group) < 2 or (second is not None and not (n_first and len(second[0]))):
        return group
    left = SignatureTree(*first)
    right, shift = (left, 0) if second is None else (SignatureTree(*second), n_first)
    other = second

    def one(a: int, b: int) -> bool:
        return (group[a:b] == group[a]).all()

    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        A, B = left.levels[la], right.levels[lb]
        if A[3][a] * den < num * B[2][b] or B[3][b] * den < num * A[2][a]:
            continue
        need = -(-num * (A[2][a] + B[2][b]) // (num + den))
        if min(int(np.bitwise_count(A[1][a] & B[1][b]).sum()) + min(A[4][a], B[4][b]), A[3][a], B[3][b]) < need:
            continue
        (a0, a1), (b0, b1) = A[0][a : a + 2], B[0][b : b + 2] + shift
        if group[a0] == group[b0] and one(a0, a1) and one(b0, b1):
            continue
        if la or lb:
            if la >= lb:
                kids = range(a * left.FAN, min((a + 1) * left.FAN, len(left.levels[la - 1][1])))
                if other is None and la == lb and a == b:
                    stack += [(la - 1, i, la - 1, j) for i in reversed(kids) for j in reversed(kids) if j > i]
                    stack += [(la - 1, i, la - 1, i) for i in kids]
                else:
                    stack += [(la - 1, i, lb, b) for i in kids]
            else:
                kids = range(b * left.FAN, min((b + 1) * left.FAN, len(right.levels[lb - 1][1])))
                stack += [(la, a, lb - 1, j) for j in kids]
            continue
        x, y = left.size[a0:a1, None], right.size[None, b0 - shift : b1 - shift]
        most = np.bitwise_count(left.maps[a0:a1, None] & right.maps[None, b0 - shift : b1 - shift]).sum(axis=2).astype(np.int64)
        most += np.minimum(left.excess[a0:a1, None], right.excess[None, b0 - shift : b1 - shift])
        able = (np.minimum(most, np.minimum(x, y)) * (num + den) >= num * (x + y)) & (group[a0:a1, None] != group[None, b0:b1])
        for i, j in zip(*np.nonzero(able)):
            i, j = a0 + i, b0 + j
            if group[i] == group[j] or (other is None and j <= i):
                continue
            if linked is None or linked(i, j):
                low, high = sorted((group[i], group[j]))
                group[group == high] = low
    return group


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Root (smallest node reachable) of each node of ``edges`` (a, b), by turns of
    large stars and small stars; each turn is written to the shared folder."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = materialize(e, "links")
    was = state(e)
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, e = e, materialize(small.unionAll(low.select("hi", "m")).distinct(), "links")
        drop_table(old)
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _signatures(words: int, num: int, den: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, words) for t in part["text"].to_pylist()]
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys = [partition_keys(s, num, den).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, keys)])
                bits = [bitmap(s, width(len(s))).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["th"], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))],
                    names=["doc_id", "th", "n", "cls", "bits", "keys"],
                )

    return run


def _stars(names: np.ndarray, group: np.ndarray) -> pd.DataFrame:
    linked = group != np.arange(len(group))
    return pd.DataFrame({"a": names[linked], "b": names[group[linked]]})


def _chunked(members: DataFrame, by: str, num: int, den: int) -> tuple[DataFrame, int, bool]:
    """Members (cls, n, ...) of groups ``by`` of two and more with their chunk; how many, and whether a group is cut.

    A large group is cut by size class, such that linked sets are in one class or in
    neighbours, and a class by hash; ``parts`` tells how many chunks a class has."""
    members = materialize(members, "members")
    groups = members.groupBy(by).agg(F.count("*").alias("c"), F.sum("n").alias("s")).where("c > 1")
    groups = materialize(groups.select(by, ((F.col("c") > CHUNK_MEMBERS) | (F.col("s") > CHUNK_SHINGLES)).alias("large")), "groups")
    # a class is a little wider than the ratio of sizes that can link, whatever the rounding
    sized = members.withColumn("class", F.floor(F.log("n") / (-math.log(num / den) * 1.0001)).cast("int"))
    parts = sized.join(groups.where("large"), by).groupBy(by, "class").agg(F.greatest(F.ceil(F.count("*") / CHUNK_MEMBERS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("parts"))
    parts = materialize(parts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("parts")), "parts")
    cut = sized.join(groups.select(by), by).join(parts, by, "left")
    chunk = F.when(F.col("parts").isNull(), 0).otherwise(F.col("class") * (1 << 20) + F.pmod(F.xxhash64("cls"), F.element_at("parts", F.col("class"))))
    cut = materialize(cut.withColumn("chunk", chunk.cast("bigint")), "members")
    large = not parts.isEmpty()
    for table in (members, groups, parts):
        drop_table(table)
    return cut, cut.count(), large


def _tasks(members: DataFrame, *by: str) -> DataFrame:
    """A row for each pair of chunks (i, j) of its group that a member takes part in."""
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(
        F.filter(F.sequence(F.lit(0), F.coalesce(F.element_at("parts", F.col("class") + d), F.lit(0))), lambda x: x < F.element_at("parts", F.col("class") + d)), lambda x: ((F.col("class") + d) * (1 << 20) + x).cast("bigint")))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.flatten(near)))
    kept = [c for c in members.columns if c not in ("parts", "class", "rep", "th", *by)]
    return members.withColumn("other", other).select(*by, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), *kept)


class _Rows:
    """Rows of sets by candidate group: names, sizes and bitmaps (a bit a token, of any width)."""

    def __init__(self, batches: list[pa.RecordBatch]):
        batch = pa.concat_batches(batches) if len(batches) > 1 else batches[0]
        self.batch = batch
        self.group = np.stack([batch[c].to_numpy() for c in ("key", "i", "j")])
        self.chunk, self.names, self.n = (batch[c].to_numpy() for c in ("chunk", "a", "n"))
        bits = pa.array(batch["bits"], pa.binary()) if not isinstance(batch["bits"], pa.BinaryArray) else batch["bits"]
        ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
        self.at, self.words = ends[:-1] // 8, np.diff(ends) // 8
        data = bits.buffers()[2]
        self.flat = np.frombuffer(data, np.uint64, data.size // 8) if data is not None else np.empty(0, np.uint64)
        turn = np.flatnonzero((self.group[:, 1:] != self.group[:, :-1]).any(axis=0)) + 1
        self.starts, self.ends = np.concatenate([[0], turn]), np.concatenate([turn, [batch.num_rows]])

    def maps(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of ``rows``, all of one width, folded to ``words`` words."""
        own = int(self.words[rows[0]])
        m = self.flat[self.at[rows][:, None] + np.arange(own)]
        while own > words:
            own //= 2
            m = m[:, :own] | m[:, own:]
        return m


def _able(rows: _Rows, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sets of rows p and q may link by their sizes and bitmaps."""
    x, y = rows.n[p], rows.n[q]
    out = np.minimum(x, y) * den >= num * np.maximum(x, y)
    left = np.flatnonzero(out)
    swap = rows.words[p] > rows.words[q]
    p, q = np.where(swap, q, p), np.where(swap, p, q)
    kinds = rows.words[p].astype(np.int64) << 32 | rows.words[q]
    for kind in np.unique(kinds[left]):
        some, words = left[kinds[left] == kind], int(kind >> 32)
        for at in range(0, len(some), step := max(1, (1 << 20) // int(kind & 0xFFFFFFFF))):
            k = some[at : at + step]
            m, o = rows.maps(p[k], words), rows.maps(q[k], words)
            spare = np.minimum(rows.n[p[k]] - np.bitwise_count(m).sum(axis=1, dtype=np.int64), rows.n[q[k]] - np.bitwise_count(o).sum(axis=1, dtype=np.int64))
            most = np.bitwise_count(m & o).sum(axis=1, dtype=np.int64) + spare
            out[k] = np.minimum(most, np.minimum(rows.n[p[k]], rows.n[q[k]])) * (num + den) >= num * (rows.n[p[k]] + rows.n[q[k]])
    return out


def _stars_of(rows: _Rows, start: int, end: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Stars of the sets of one large candidate group that may link, by signature trees of each width."""
    every = np.arange(start, end)
    for words in np.unique(rows.words[every]).tolist():
        # sets of this width, and those of twice that which a linked set of this width can be as small as
        own = every[(rows.words[every] == words) | ((rows.words[every] == 2 * words) & (rows.n[every] * num <= den * words * 64))]
        maps = np.empty((len(own), words), np.uint64)
        for w in np.unique(rows.words[own]).tolist():
            maps[rows.words[own] == w] = rows.maps(own[rows.words[own] == w], words)
        sizes = rows.n[own]
        order = np.lexsort((maps[:, 0], (np.log(sizes) / -np.log(num / den)).astype(int)))
        i, j = rows.group[1, start], rows.group[2, start]
        here = order if i == j else order[rows.chunk[own][order] == i]
        there = None if i == j else order[rows.chunk[own][order] != i]
        group = walk_trees((sizes[here], maps[here]), None if there is None else (sizes[there], maps[there]), num, den)
        names = rows.names[own[here if there is None else np.concatenate([here, there])]]
        linked = np.flatnonzero(group != np.arange(len(group)))
        yield from zip(names[linked].tolist(), names[group[linked]].tolist(), strict=True)


def _may_link(num: int, den: int, small: int = 24):
    """Stars (a, b) of the sets of each candidate group that may link by their bitmaps.

    Rows come sorted by group. Pairs of groups of ``small`` sets at most are tested
    at once for a batch; a larger group by signature trees."""

    def found(rows: _Rows, many: int) -> set[tuple[int, int]]:
        starts, ends = rows.starts[:many], rows.ends[:many]
        size = ends - starts
        few = (size <= small) & (rows.group[1, starts] == rows.group[2, starts])
        left, right = [], []
        for c in np.unique(size[few & (size > 1)]).tolist():
            x, y = np.triu_indices(c, 1)
            at = starts[few & (size == c)][:, None]
            left.append((at + x).ravel())
            right.append((at + y).ravel())
        out: set[tuple[int, int]] = set()
        if left:
            p, q = np.concatenate(left), np.concatenate(right)
            able = _able(rows, p, q, num, den)
            root: dict[int, int] = {}
            for x, y in zip(p[able].tolist(), q[able].tolist(), strict=True):
                while x in root:
                    x = root[x]
                while y in root:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.add((int(rows.names[max(x, y)]), int(rows.names[min(x, y)])))
        for k in np.flatnonzero(~few & (size > 1)):
            out.update(_stars_of(rows, int(starts[k]), int(ends[k]), num, den))
        return out

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def batch_of(stars: set[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*stars, strict=True) if stars else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch[c][batch.num_rows - 1].as_py() for c in ("key", "i", "j"))
            if held and last == tuple(held[0][c][0].as_py() for c in ("key", "i", "j")):
                held.append(batch)  # one group so far
                continue
            rows = _Rows([*held, batch])
            yield batch_of(found(rows, len(rows.starts) - 1))
            held = [rows.batch.slice(int(rows.starts[-1]))]
        if held:
            yield batch_of(found(_Rows(held), 1))

    return run


def ngram_jaccard_components(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of the documents of ``docs`` (doc_id, text) linked at similarity num/den or more.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links
    lead to. Shingles are compared by 64-bit hashes, sets by 128-bit ones.

    Equal sets form one class. Classes that can link share a key (see
    partition_keys), so the groups of classes under one key hold every link; of keys
    with the same classes one is kept. Signature trees over the bitmaps alone, a bit a
    token, find in each such group the sets that may link (a group of a few sets is one
    leaf); only what they connect is joined over its shingles, by signature trees again
    and exact intersections. One task takes a group; a group
    over CHUNK_MEMBERS sets or CHUNK_SHINGLES shingles is cut by size class and hash
    into chunks, and every pair of chunks whose sizes can link is joined in a task of
    its own, so memory is bounded and no link is lost. Tasks return group numbers, never pairs.

    Null and empty texts, and texts of white space, have no shingles and link
    with nothing; their component is their own id. Repeated rows are one class.
    A null doc_id never becomes a component's id unless no other member has one.
    An empty table gives an empty result. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    signed = materialize(texts.mapInArrow(_signatures(words, num, den), "doc_id bigint, th bigint, n bigint, cls binary, bits binary, keys array<bigint>"), "signatures")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))  # the row that stands for a class
    classes = signed.where("cls is not null").groupBy("cls").agg(lead.alias("lead"), F.max("n").alias("n"), F.min("bits").alias("bits"))
    classes = materialize(classes.select("cls", F.col("lead.doc_id").alias("rep"), F.col("lead.th").alias("th"), "n", "bits"), "classes")
    rows = materialize(signed.select("doc_id", "n", "cls"), "rows")

    # one exchange by key serves both the search for keys of several classes and their look-up
    short = F.xxhash64("cls")
    keyed = signed.where("cls is not null").select(F.explode("keys").alias("key"), short.alias("a")).repartition("key")
    many = keyed.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b < z").select("key")
    common = materialize(keyed.join(many.hint("shuffle_hash"), "key").distinct(), "common")
    drop_table(signed)  # the keys have served
    held = common.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("a")).alias("x"))
    kept = materialize(held.groupBy("c", "x").agg(F.min("key").alias("key")).select("key"), "kept")
    buckets = common.join(kept, "key").select("key", "a").join(classes.select(short.alias("a"), "cls", "n", "bits"), "a")
    members, _, _ = _chunked(buckets, "key", num, den)
    drop_table(common)
    drop_table(kept)
    tasks = _tasks(members, "key").select("key", "i", "j", "chunk", "a", "n", "bits")
    near = connected_components(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_may_link(num, den), "a bigint, b bigint"))
    drop_table(members)
    found = classes.select("cls", "rep", "th", "n", short.alias("node")).join(near, "node").select("cls", "rep", "th", "n", "root")
    members, count, large = _chunked(found, "root", num, den)

    @frugal
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows alike in id and text: one a task
        for batch in batches:
            names = batch["cls"].to_pylist()
            sets = [shingle_set(t, words) if c not in seen else None for c, t in zip(names, batch["text"].to_pylist(), strict=True)]
            same = [s is not None and c == xxhash.xxh3_128_digest(s.tobytes()) for c, s in zip(names, sets, strict=True)]
            seen.update(c for c, one in zip(names, same, strict=True) if one)
            out = pa.array([s.tobytes() if one else None for s, one in zip(sets, same, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("cls", "root", "class", "parts", "chunk")), out], names=["cls", "root", "class", "parts", "chunk", "data"]).filter(pa.array(same, pa.bool_()))

    wanted = F.broadcast(members) if count <= BROADCAST_ROWS else members
    found = texts.alias("t").join(wanted.alias("m"), F.col("t.doc_id").eqNullSafe(F.col("m.rep")) & (F.col("t.th") == F.col("m.th"))).select("m.cls", "root", "class", "parts", "chunk", "text")
    found = found.mapInArrow(sets_of, "cls binary, root bigint, class int, parts map<int,int>, chunk bigint, data binary")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("cls")
        sets = [np.frombuffer(x, np.uint64) for x in part["data"]]
        order = sorted(range(len(sets)), key=lambda k: (int(np.log(len(sets[k])) / -np.log(num / den)), sets[k][:3].tolist()))
        names, chunk, i = part["cls"].to_numpy()[order], part["chunk"].to_numpy()[order], part["i"].iloc[0]
        sets = [sets[k] for k in order]
        if i == part["j"].iloc[0]:
            group = linked_groups(sets, num, den)
        else:
            here, there = np.flatnonzero(chunk == i), np.flatnonzero(chunk != i)
            names = np.concatenate([names[here], names[there]])
            group = linked_groups([sets[k] for k in here], num, den, [sets[k] for k in there])
        if sum(s.nbytes for s in sets) > LARGE:
            give_back()
        return _stars(names, group)

    links = _tasks(found, "root").groupBy("root", "i", "j").applyInPandas(join, "a binary, b binary")
    if large:
        roots = connected_components(links)
    else:  # every group was joined in one task: its links are stars already
        links = materialize(links, "stars")
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select("b", "b").distinct())
    merged = classes.join(roots.withColumnRenamed("node", "cls"), "cls")
    merged = merged.join(merged.groupBy("root").agg(F.min("rep").alias("low")), "root").select("cls", "low")
    # written first, so that the join with all rows has plain exchanges, which AQE splits where one class is hot
    owners = materialize(classes.join(merged, "cls", "left").select("cls", F.coalesce("low", "rep").alias("low")), "owners")
    return rows.join(owners, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of ngram_jaccard_components(), the one of
    the smallest doc_id (null last); all columns stay.

    Rows, not ids, are what links join: a row goes by the hash of its id and text,
    so rows of one id, or without id, stay where their texts link with nothing. Of
    rows alike in id and text that lead a group, the one with the smallest columns
    stays. Rows without shingles all stay. The hashes that go are sent to all
    executors up to BROADCAST_ROWS of them, and joined by shuffle beyond that.
    """
    row = F.xxhash64(docs["doc_id"], docs["text"])
    groups = ngram_jaccard_components(docs.select(row.alias("doc_id"), "text"), **how)
    groups = materialize(groups.where("n_shingles > 0").select(F.col("doc_id").alias("at"), "component_id"), "components")
    many = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = materialize(groups.join(many, "component_id").distinct(), "grouped")
    small = members.count() <= BROADCAST_ROWS
    sent = lambda df: F.broadcast(df) if small else df
    # a row of ``held`` for each row of ``docs`` in a group of several
    held = docs.select("doc_id", row.alias("row")).join(sent(members), F.col("row") == F.col("at")).select("component_id", "doc_id", "at")
    held = materialize(held, "held")
    lead = held.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).getField("at").alias("lead"))
    gone = materialize(members.join(lead, "component_id").where("at <> lead").select(F.col("at").alias("gone")), "gone")
    left = docs.join(sent(gone), row == gone["gone"], "left_anti")
    again = held.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").join(gone, F.col("at") == F.col("gone"), "left_anti")
    again = materialize(again.select(F.col("at").alias("again")), "again")
    if again.isEmpty():
        return left
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    alike = left.join(sent(again), row == again["again"], "left_semi").select(row.alias("at"), whole.alias("row")).groupBy("at").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(sent(again), row == again["again"], "left_anti").unionByName(alike.select("row.*"))
