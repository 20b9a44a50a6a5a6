"""Token ids in files of bit or byte planes, compressed plane by plane, with a chunk index."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, frugal, give_back, materialize, regrouped, shared_dir
from tessera.llm.packing import TOGETHER, encoder

#: Ids of a block; all blocks of a file but its last have as many.
BLOCK = 1 << 16
MAGIC = b"TSBPLN1\n"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of 32-bit ids, lowest first: 4 of bytes, or 32 of bits (eight ids a byte, first id lowest)."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        data = np.packbits(np.unpackbits(data, axis=1, bitorder="little").T, axis=1, bitorder="little").T
    return [np.ascontiguousarray(p).tobytes() for p in data.T]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=count, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file: magic, the blocks' planes, the table of documents, the index, its length, magic.

    A plane of nothing but zeros takes no bytes. The index is JSON: of each block its
    place, its ids and the bytes of each plane; of the table of documents its place
    and sizes. The writer holds one block and the table of documents."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.sink, self.kind, self.block = sink, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        at, sizes = self.at, []
        for plane in to_planes(ids, self.kind):
            data = self.zip.compress(plane) if plane.strip(b"\0") else b""
            sizes.append(len(data))
            self._put(data)
        self.blocks.append([at, len(ids), sizes])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            rest = np.concatenate(self.held)
            full = len(rest) // self.block * self.block
            for a in range(0, full, self.block):
                self._block(rest[a : a + self.block])
            self.held, self.n_held = [rest[full:].copy()], len(rest) - full

    def close(self) -> int:
        """Bytes of the file."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        table = [
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array([d is None for d in self.doc_ids], np.uint8).tobytes(),
            np.array(self.lengths, "<i8").tobytes(),
        ]
        at, table = self.at, [self.zip.compress(t) for t in table]
        for t in table:
            self._put(t)
        index = {"kind": self.kind, "block": self.block, "n_ids": self.n_ids, "n_docs": len(self.lengths), "blocks": self.blocks, "docs": [at, [len(t) for t in table]]}
        data = json.dumps(index, separators=(",", ":")).encode()
        self._put(data + len(data).to_bytes(8, "little") + MAGIC)
        return self.at


class PlaneReader:
    """Reads a file of PlaneWriter; each block by itself, found through the index."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size, tail = source.size(), 8 + len(MAGIC)
        source.seek(max(0, size - tail))
        end = source.read(tail)
        if size < tail + len(MAGIC) or end[8:] != MAGIC:
            raise ValueError("not a whole file of planes")
        length = int.from_bytes(end[:8], "little")
        source.seek(size - tail - length)
        self.index = json.loads(source.read(length))
        self.n_ids, self.n_docs = self.index["n_ids"], self.index["n_docs"]

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Id and number of token ids of each document, in the file's order."""
        at, sizes = self.index["docs"]
        self.source.seek(at)
        ids, null, lengths = (self.unzip.decompress(self.source.read(s), max_output_size=8 * self.n_docs) if s else b"" for s in sizes)
        null = np.frombuffer(null, np.uint8)
        return [None if n else d for d, n in zip(np.frombuffer(ids, "<i8").tolist(), null, strict=True)], np.frombuffer(lengths, "<i8")

    def block(self, k: int) -> np.ndarray:
        at, count, sizes = self.index["blocks"][k]
        width = count if self.index["kind"] == "byte" else -(-count // 8)
        self.source.seek(at)
        planes = [self.unzip.decompress(self.source.read(s), max_output_size=width) if s else bytes(width) for s in sizes]
        return from_planes(planes, count, self.index["kind"])

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start`` of the file; only the blocks that hold them are read."""
        size = self.index["block"]
        parts = [self.block(k) for k in range(start // size, -(-(start + count) // size))] if count else []
        return np.concatenate(parts)[start % size :][:count] if parts else np.empty(0, "<u4")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``uri``; a bare path, or file: with any number of slashes, is a mounted folder."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, *, end_id: int = 2, kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Write the token ids of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    Returns the manifest, a row a file: part (files in ascending order of their
    documents), path, n_docs, n_ids, n_bytes. The texts are range-partitioned by
    (doc_id, row number), sorted inside, encoded and written by the tasks that sorted
    them: one shuffle of the texts, one file a task, no task that sees all. A task's
    file has a name of its own, and only files of tasks that ended are in the
    manifest, so lost executors and repeated attempts leave no double rows.

    ``kind`` is 'byte' or 'bit'. A null text counts as empty: ``end_id`` alone. Null
    ids come first; equal ids follow in the order read, repeated rows each once.
    An empty table gives no files. Other columns are ignored. ``out_dir`` is a folder
    that all executors reach, by a scheme that pyarrow.fs knows; without it, one in
    the shared folder that goes when the application ends.
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"planes of {kind}")
    spark = docs.sparkSession
    if out_dir is None:
        out_dir = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out_dir = out_dir.rstrip("/")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder, out, name = TaskContext.get().partitionId(), encoder(tokenizer_path), None, None
        end = np.array([end_id], "<u4")
        try:
            for batch in regrouped(batches, TOGETHER):
                if out is None:
                    system, folder = file_system(out_dir)
                    system.create_dir(folder, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                    sink = system.open_output_stream(f"{folder}/{name}")
                    out = PlaneWriter(sink, kind, block)
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), coder.encode(batch["text"]), strict=True):
                    out.add(doc_id, np.concatenate([ids, end]))
                give_back()
            if out is not None:
                size = out.close()
                row = {"part": [part], "path": [f"{out_dir}/{name}"], "n_docs": [len(out.lengths)], "n_ids": [out.n_ids], "n_bytes": [size]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
        finally:
            if out is not None:
                sink.close()

    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    laid = rows.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid").select("doc_id", "text")
    return materialize(laid.mapInArrow(run, "part int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"), "manifest")


def read_token_files(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The documents of the files of ``manifest``, from the files alone: doc_id, path, start
    (ids of all documents before it, over all files), n_tokens, ids_crc32 of the ids as
    little-endian unsigned 32-bit integers, and ids (those bytes; null unless ``keep_ids``).

    A task reads whole files block by block and holds one block, and one document
    where ids are kept. The files' first places are a prefix sum over the manifest."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                system, at = file_system(path)
                with system.open_input_file(at) as source:
                    reader = PlaneReader(source)
                    doc_ids, lengths = reader.documents()
                    rows, held, k, rest = [], 0, 0, b""
                    start = base
                    for doc_id, n in zip(doc_ids, lengths.tolist(), strict=True):
                        crc, need, kept = 0, 4 * n, []
                        while need:
                            if not rest:
                                rest = memoryview(reader.block(k).tobytes())
                                k += 1
                            piece, rest = rest[:need], rest[need:]
                            crc, need = zlib.crc32(piece, crc), need - len(piece)
                            if keep_ids:
                                kept.append(bytes(piece))
                        rows.append((doc_id, path, start, n, crc, b"".join(kept) if keep_ids else None))
                        held += 100 + 4 * n * keep_ids
                        start += n
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    spark = manifest.sparkSession
    before = Window.orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    tasks = max(1, min(manifest.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)))
    return based.repartition(tasks).mapInArrow(run, "doc_id bigint, path string, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
