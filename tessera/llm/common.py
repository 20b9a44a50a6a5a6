"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition used by every operator: space, and 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or,
    where that is unset on a local master (tests), a folder below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


#: Bytes of an Arrow batch between the JVM and Python: a batch of long texts stays small.
BATCH_BYTES = 3 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to BATCH_BYTES, so that the memory of a task
    does not follow the lengths of the texts; a smaller setting is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").strip().lower()
    number, unit = int(now.rstrip("bkmg") or 0), now.lstrip("-0123456789") or "b"
    if not 0 < number * {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit[0]] <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what this worker's allocators hold but do not use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What modules remember from batch to batch, each with clear(); forgotten when a task ends.
CACHES: list = []


def end_task() -> None:
    """Forget what this worker remembers, and give the memory back."""
    for cache in CACHES:
        cache.clear()
    give_back()


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of mapInArrow, such that a reused worker starts the next task small."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            end_task()

    return wrapped


def regrouped(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``least_bytes`` and not much more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least_bytes:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage as checkpoint() does, in columns and compressed; a lost
    executor costs only the tasks that read the table. The table goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote; nothing may read ``df`` afterwards."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hash52(*parts: Column) -> Column:
    """Integer in [0, 2^52) from the MD5 of the parts joined by ':', the same
    in any engine that has MD5. A null part counts as the empty string."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def unit(*parts: Column) -> Column:
    """Number strictly between 0 and 1 from hash52."""
    return (hash52(*parts).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
