"""Sum-of-squares packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, CACHES, frugal, give_back, materialize, regrouped

#: Pieces that one task packs. Sequences are never shared between blocks.
BLOCK = 100_000
#: Bytes of chunks and their ids that a worker remembers before it starts anew: several
#: batches' worth, or each batch would clear what the last one learnt.
REMEMBERED_BYTES = 32 << 20

#: Bytes of texts that are encoded together: the more, the fewer distinct chunks a byte, and the
#: more memory a worker takes. Where little is left, as at a pipeline's end, give less.
TOGETHER = 16 << 20

FAR = np.iinfo(np.int64).max
PIECES = "doc_id bigint, rid bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


class ChunkEncoder:
    """Token ids of whole texts by a byte-level BPE of the tokenizers library.

    The pre-tokenizer never joins text across a space that stands between two
    visible characters, so a text's ids are those of its space-separated chunks
    (each with its space), one after the other. Chunks recur: each batch of texts
    is encoded by its distinct ones, and those it holds twice or more are
    remembered, up to a bound. Texts where a space touches other white
    space, that hold a special token, or a chunk that does not open with one token
    of a space, are encoded whole.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = REMEMBERED_BYTES if remembered is None else remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # the byte-level sign for a space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = r"^\s|\s$|\s\s" + "".join("|" + "".join("\\" + c if not c.isalnum() else c for c in t) for t in self.special)
        self.known: dict[str, bytes | None] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learnt(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of each chunk behind a space; None if they do not stand alone."""
        out: list[bytes | None] = []
        for at in range(0, len(chunks), 512):
            some = chunks[at : at + 512]
            (ids,) = self.whole([" " + " ".join(some)])
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some) and starts[0] == 0:
                data, cuts = ids.tobytes(), (4 * starts).tolist()
                out += [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
            elif len(some) == 1:
                out.append(None)
            else:
                half = len(some) // 2
                out += self._learnt(some[:half]) + self._learnt(some[half:])
        return out

    def _ids(self, chunks: list[str], often: np.ndarray) -> list[bytes | None]:
        if self.held > self.remembered:
            self.known.clear()
            self.held = 0
        ids = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(ids) if x is None and chunks[i] not in self.known]
        for i, x in zip(new, self._learnt([chunks[i] for i in new]), strict=True):
            ids[i] = x
            if often[i]:
                self.known[chunks[i]] = x
                self.held += 200 + len(chunks[i]) + len(x or b"")  # with the objects and the table's entry
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; no nulls."""
        if not len(texts):
            return []
        plain = pc.invert(pc.match_substring_regex(texts, self.odd)).to_numpy(zero_copy_only=False)
        # RE2's \s is ASCII; what else Python holds for white space goes the long way too
        plain &= pc.invert(pc.match_substring_regex(texts, "[\\x0b\\x1c-\\x1f\\x85\\p{Z}]".replace("\\p{Z}", "\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"))).to_numpy(zero_copy_only=False)
        plain &= pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        rest = np.flatnonzero(~plain)
        for i, ids in zip(rest, self.whole(texts.take(pa.array(rest)).to_pylist()) if len(rest) else [], strict=True):
            out[i] = ids
        easy = np.flatnonzero(plain)
        if not len(easy):
            return out
        texts = texts.take(pa.array(easy)) if len(rest) else texts
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        index, ends = coded.indices.to_numpy().copy(), lists.offsets.to_numpy().copy()
        del lists, coded  # as large as the texts
        ids = self._ids(chunks, np.bincount(index, minlength=len(chunks)) > 1)
        alone = {i for i, x in enumerate(ids) if x is None}
        # the first chunk of a text has no space before it: it is encoded by itself
        ids = [x or b"" for x in ids] + [x.tobytes() for x in self.whole([chunks[i] for i in index[ends[:-1]]])]
        index[ends[:-1]] = len(chunks) + np.arange(len(easy))
        del chunks
        cuts = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        del ids
        took = held.take(pa.array(index))
        stop = took.offsets.to_numpy()[ends].tolist()
        took = took.flatten().to_numpy()
        for i, a, b in zip(easy.tolist(), stop[:-1], stop[1:], strict=True):
            out[i] = took[a:b]
        if alone:
            for k in np.flatnonzero([not alone.isdisjoint(index[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]):
                (out[easy[k]],) = self.whole([texts[int(k)].as_py()])
        return out


_encoders: dict[str, ChunkEncoder] = {}


class _Chunks:
    """What encoders remember of texts; their tokenizers, slow to build, stay with the worker."""

    def clear(self) -> None:
        for e in _encoders.values():
            e.known.clear()
            e.held = 0


CACHES.append(_Chunks())


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given, by the sum-of-squares rule.

    An item goes where the sum over gaps of (open bins with that gap) squared
    becomes smallest: into an open bin of some gap, or a new bin. A bin that is
    full counts no more. Equal sums: the smallest gap. Among bins of one gap the
    latest opened is used.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        gap = capacity
        if s < capacity:
            # the change of the sum when gap g + s becomes g, a filled bin (g = 0) counting no more
            change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
            change[0] = 1 - 2 * count[s]
            change[count[s:capacity] == 0] = FAR
            g = int(change.argmin())
            if change[g] < 2 * count[capacity - s] + 1:  # the change with a new bin, which no other equals
                gap = g + s
        if gap < capacity:
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            b = made
            made += 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: sum_of_squares() in the order given; then a
    repair of the bins that it leaves open: they are emptied and their items,
    longest first, each go to the one with the smallest gap that holds them."""
    bins, offsets = sum_of_squares(sizes, capacity)
    if not len(sizes):
        return bins, offsets
    again = np.flatnonzero((np.bincount(bins, sizes) < capacity)[bins])
    free = np.unique(bins[again]).tolist()[::-1]
    gaps: list[tuple[int, int]] = []
    for k in again[np.argsort(-sizes[again], kind="stable")].tolist():
        s = int(sizes[k])
        at = bisect.bisect_left(gaps, (s, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:  # longest first by smallest gap may, in theory, need a bin more than there were
            gap, b = capacity, free.pop() if free else int(bins.max()) + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            bisect.insort(gaps, (gap - s, b))
    return bins, offsets


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool, together: int = TOGETHER) -> DataFrame:
    """Pieces of each document: its ids and ``end_id``; one too long is cut into
    full pieces behind a first piece that holds the rest."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        coder.remembered = 2 * together
        for part in regrouped(batches, together):
            cols = [[], [], [], [], [], [], []]
            for doc_id, rid, ids in zip(part["doc_id"].to_pylist(), part["rid"].to_pylist(), coder.encode(part["text"]), strict=True):
                data, n = ids.tobytes() + end_id.to_bytes(4, "little"), len(ids) + 1
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    own = data[4 * start : 4 * (start + capacity if piece else first)]
                    for c, v in zip(cols, (doc_id, rid, piece, start, len(own) // 4, zlib.crc32(own), own if keep_ids else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "rid", "piece", "start", "length", "ids_crc32", "ids"],
            )
            give_back()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """Pack the documents of ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    Returns a row a piece: doc_id, rid (a row number), piece, start, length,
    ids_crc32, ids (little-endian 32-bit, null unless ``keep_ids``), sequence_id
    and offset. Texts become ids where they are read and are not shuffled; the
    small rows of the pieces are dealt by a hash of the row into blocks of about
    ``block`` pieces, and each block is packed by itself, longest pieces first,
    by the sum-of-squares rule; then the pieces of the sequences that it leaves
    open (some 8 % of those under ``capacity``) are placed once more among these, each
    where the smallest gap remains. A block's loss is a few open bins, whatever the
    number of blocks. Every piece is placed; sequence ids are block * 2^32 + bin.

    Null and empty texts are one piece with ``end_id`` alone. Repeated rows, and
    rows with a null doc_id, are each packed. Ties go to the lower row number.
    An empty table gives an empty result. Other columns are ignored. ``together``
    bounds the bytes of texts that a worker encodes at once.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, capacity, end_id, keep_ids, together), "pieces")
    blocks = max(1, round(pieces.count() / block))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "rid", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = pack_sizes(part["length"].to_numpy(), capacity)
        return pd.DataFrame({"rid": part["rid"], "piece": part["piece"], "sequence_id": (part["block"].to_numpy().astype(np.int64) << 32) + bins, "offset": offsets})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("rid", "piece"), F.lit(blocks)).cast("int"))
    placed = dealt.select("block", "rid", "piece", "length").groupBy("block").applyInPandas(pack, "rid bigint, piece int, sequence_id bigint, offset bigint")
    return pieces.join(placed, ["rid", "piece"]).select("doc_id", "rid", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
