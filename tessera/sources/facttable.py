"""A stored table of facts, kept up by incremental merges, with a feed of changes for each reader.

Rows lie in Parquet folders by hash buckets of (subject, predicate). A merge reads and
rewrites only the buckets that its batch brings something new to, and commits by
putting the next manifest, which names the files of every bucket: readers see the
table before or after a merge, never between. Of two merges of one version the
second fails. Folders that no kept manifest names are removed by vacuum().
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Folder

KEY = ("subject", "predicate")
#: What a statement says. ``closes``: null (it stands beside others of its key), '*' (it
#: ends every other object of its key), or the one object that it ends.
STATED = ("fact_id", *KEY, "object", "closes", "valid_from", "source", "recorded_at")
#: What follows from the statements of a key, and the version that last changed it.
DERIVED = ("fingerprint", "valid_until", "superseded_by", "status", "changed_in")
HASH = "HAS_CONTENT_HASH"
#: Rows that one task of a merge sorts, about; a key is never parted.
TASK_ROWS = 500_000
#: How digests are made. Those of tables that do not name it in their manifest told times by the millisecond.
DIGEST = 2


class Conflict(RuntimeError):
    """Another merge was committed since this one began."""


def fingerprint() -> Column:
    """Digest (128 bits) of what a statement says and when; a repeated statement has the same, whatever its id.

    JSON would write a time slowly and without its microseconds; xxhash64 maps the 64 bits of a time one to one."""
    when = F.when(F.col("valid_from").isNotNull(), F.xxhash64("valid_from")).alias("valid_from")
    said = F.to_json(F.struct(*KEY, "object", "closes", when, "source"), {"ignoreNullFields": "false"})
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def with_intervals(rows: DataFrame, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """``rows`` of statements with valid_until, superseded_by and status.

    A fact ends where the first later statement of its key closes it: one that closes
    its very object, or, with '*', any other object. Order is by valid_from, then
    fact_id, so a late statement finds its place whenever it comes. ``by``: columns that
    follow from the key and by which the rows lie already, so that they move no more;
    without ``exact`` no statement closes one object, and one sort does for all."""
    order, key = ["valid_from", "fact_id"], [*by, *KEY]
    # nearest later row: the last of those before, in falling order (a frame that only grows)
    down = [F.col(c).desc() for c in order]
    later = Window.partitionBy(*key).orderBy(*down).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda c, w: F.last(c, ignorenulls=True).over(w)
    me, star = F.struct(*order), F.col("closes") == "*"
    rows = rows.drop("valid_until", "superseded_by", "status").withColumn("_star", nearest(F.when(star, F.struct(*order, "object")), later))
    # a run of '*' statements with one object ends none of its own; the last of a run knows the first of the next
    other = F.col("_star").isNotNull() & ~F.col("_star.object").eqNullSafe(F.col("object"))
    at = F.struct(*[F.col(f"_star.{c}").alias(c) for c in order])
    rows = rows.withColumn("_run", nearest(F.when(star & other, at), later))
    rows = rows.withColumn("_closer", F.when(other, at).otherwise(F.col("_run"))).drop("_star", "_run")
    if exact:
        # the closing of one object meets the facts of that object: both come under the value that they speak of
        none = F.lit(None).cast(rows.select(me.alias("m")).schema["m"].dataType)
        fact, closing = F.struct(F.col("object").alias("of"), none.alias("at")), F.struct(F.col("closes").alias("of"), me.alias("at"))
        rows = rows.withColumn("_said", F.explode(F.when(F.col("closes") != "*", F.array(fact, closing)).otherwise(F.array(fact))))
        rows = rows.withColumn("_of", F.col("_said.of")).withColumn("_at", F.col("_said.at")).drop("_said")
        same = Window.partitionBy(*key, "_of").orderBy(*down, F.col("_at").isNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_exact", nearest(F.col("_at"), same)).where("_at is null")
        rows = rows.withColumn("_closer", F.least("_closer", "_exact")).drop("_of", "_at", "_exact")
    rows = rows.withColumn("valid_until", F.col("_closer.valid_from")).withColumn("superseded_by", F.col("_closer.fact_id")).drop("_closer")
    return rows.withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


class FactTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64, fact_id: str = "bigint") -> FactTable:
        """A new table without rows, version 0. ``buckets`` stays: what a merge rewrites at the least."""
        table = cls(spark, path)
        if not table.folder.put("manifests/0000000000.json", {"version": 0, "buckets": buckets, "fact_id": fact_id, "digest": DIGEST, "at": {}, "since": {}, "rows": {}, "exact": False}):
            raise Conflict(f"{path} is a table already")
        return table

    @property
    def schema(self) -> str:
        kind = self.manifest()["fact_id"]
        return (
            f"fact_id {kind}, subject string, predicate string, object string, closes string, valid_from timestamp_ntz, source string, recorded_at timestamp_ntz, "
            f"fingerprint binary, valid_until timestamp_ntz, superseded_by {kind}, status string, changed_in bigint"
        )

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict:
        return self.folder.read(f"manifests/{self.versions()[-1] if version is None else version:010d}.json")

    def _load(self, manifest: dict, buckets: list[str]) -> DataFrame:
        at = [manifest["at"][b] for b in buckets if b in manifest["at"]]
        paths = [f"{self.path}/{x}" for xs in at for x in ([xs] if isinstance(xs, str) else xs)]
        if paths:
            rows = self.spark.read.schema(self.schema).parquet(*paths)
            return rows if manifest.get("digest") == DIGEST else rows.withColumn("fingerprint", fingerprint())
        names = [c.split() for c in self.schema.split(", ")]
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in names]).where("false")

    def read(self, version: int | None = None, key: tuple[str, str] | None = None) -> DataFrame:
        """All facts, as they were in ``version``; of one (subject, predicate) only its bucket is read."""
        m = self.manifest(version)
        if key is None:
            return self._load(m, list(m["at"]))
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key[0]), F.lit(key[1])), F.lit(m["buckets"]))).first()[0]
        return self._load(m, [str(bucket)]).where((F.col("subject") == key[0]) & (F.col("predicate") == key[1]))

    def merge(self, statements: DataFrame) -> dict:
        """Add the statements that the table does not hold; returns version, added and rewritten (buckets).

        ``statements`` has the columns STATED. Of equal statements in the batch the one
        with the least fact_id counts; one that the table holds changes nothing, so the
        same batch twice is the batch once, and a batch without news commits no version."""
        m = self.manifest()
        version, buckets = m["version"] + 1, m["buckets"]
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
        rows = statements.select(*STATED).withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
        # batches of one time lie in few files: dealt out by id, all cores share what follows
        rows = rows.repartition("fact_id").withColumn("fingerprint", fingerprint()).withColumn("bucket", bucket)
        stage = f"staging/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{stage}")
            staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{stage}")
            came = staged.groupBy("bucket").agg(
                F.count("*").alias("n"), F.max(F.coalesce(F.col("closes") != "*", F.lit(False))).alias("exact"),
                F.min("valid_from").cast("string").alias("begin"), F.max(F.col("valid_from").isNull()).alias("undated"),
            ).collect()  # as many rows as buckets, at most
            # an equal statement began at the same time: of the digests held, those of before the batch stay unread
            begins = [r["begin"] for r in came if r["begin"]]
            recent = F.lit(True)
            if all(b[0].isdigit() for b in begins):  # years of four digits, whose texts sort as they do
                recent = F.col("valid_from") >= F.lit(min(begins, default=None)).cast("timestamp_ntz")
                recent = F.col("valid_from").isNull() | recent if any(r["undated"] for r in came) else recent
            held = lambda bs: self._load(m, bs).where(recent).select("fingerprint")
            both = staged.select("fingerprint", "bucket").unionByName(held([str(r["bucket"]) for r in came]), allowMissingColumns=True)
            seen = both.groupBy("fingerprint").agg(F.min("bucket").alias("bucket"), F.max(F.col("bucket").isNull()).alias("held"))
            news = {str(r["bucket"]): r["n"] for r in seen.where("not held").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
            if not news:
                return {"version": m["version"], "added": 0, "rewritten": 0}
            came = [r for r in came if str(r["bucket"]) in news]
            exact = m["exact"] or any(r["exact"] for r in came)
            count = m["rows"] | {b: m["rows"].get(b, 0) + n for b, n in news.items()}
            fresh = staged.where(F.col("bucket").isin([r["bucket"] for r in came]))
            if sum(r["n"] for r in came) > sum(news.values()):  # some came twice or are held
                fresh = fresh.groupBy("fingerprint").agg(F.min_by(F.struct(*STATED, "bucket"), F.col("fact_id")).alias("s")).select("fingerprint", "s.*")
                fresh = fresh.join(held(list(news)), "fingerprint", "left_anti")
            old = self._load(m, list(news)).withColumn("_was", F.struct("superseded_by", "changed_in")).drop("valid_until", "superseded_by", "status", "changed_in")
            both = old.withColumn("bucket", bucket).unionByName(fresh, allowMissingColumns=True)
            # the rows move once: a task gets whole keys of one bucket, and writes them as they lie
            shares = [-(-count[str(b)] // TASK_ROWS) if str(b) in news else 0 for b in range(buckets)]
            first = [sum(shares[:b]) for b in range(buckets)]
            both = both.withColumn("part", (F.get(F.lit(first), "bucket") + F.pmod(F.hash(*KEY), F.greatest(F.get(F.lit(shares), "bucket"), F.lit(1)))).cast("int"))
            # a number leads the sort, so that few rows are compared by their texts
            both = both.repartitionById(sum(shares), "part").withColumn("_key", F.xxhash64(*KEY))
            done = with_intervals(both, ("_key", "part"), exact)
            kept = F.col("_was").isNotNull() & F.col("_was.superseded_by").eqNullSafe(F.col("superseded_by"))
            done = done.withColumn("changed_in", F.when(kept, F.col("_was.changed_in")).otherwise(F.lit(version).cast("bigint")))
            name = f"data/{uuid.uuid4().hex}"
            done.select(*STATED, *DERIVED, "bucket").write.parquet(f"{self.path}/{name}")
            written = self.spark.read.schema("bucket int").parquet(f"{self.path}/{name}")
            files = written.select("bucket", F.col("_metadata.file_name").alias("file")).distinct().collect()
            if len({r["file"] for r in files}) < len(files):
                self.folder.delete(name)
                raise RuntimeError(f"{name}: a file holds rows of two buckets")
        finally:
            self.folder.delete(stage)
        at = m["at"] | {b: sorted(f"{name}/{r['file']}" for r in files if str(r["bucket"]) == b) for b in news}
        since = m["since"] | {b: version for b in news}
        if not self.folder.put(f"manifests/{version:010d}.json", m | {"version": version, "at": at, "since": since, "rows": count, "exact": exact}):
            self.folder.delete(name)
            raise Conflict(f"version {version} was committed by another merge")
        return {"version": version, "added": sum(news.values()), "rewritten": len(news)}

    def changes(self, after: int, to: int | None = None) -> DataFrame:
        """What a reader that knows version ``after`` needs for version ``to``: op d (a fact to
        hold, as it is now) or r (a fact to let go). Only buckets written since are read."""
        m = self.manifest(to)
        rows = self._load(m, [b for b, v in m["since"].items() if v > after]).where(F.col("changed_in") > after)
        return rows.withColumn("op", F.when(F.col("superseded_by").isNull(), "d").otherwise("r"))

    def refresh(self, files: DataFrame, extract: Callable[[DataFrame], DataFrame], now: Column, next_id: Callable[[DataFrame], DataFrame]) -> dict:
        """Bring the table up to ``files`` (source, hash, and what ``extract`` reads).

        Only files whose hash is not the one that the table holds are given to
        ``extract``, which returns subject, predicate, object, source. Facts of changed
        and gone sources that are stated no more are closed by a fact that retires
        them; those still stated stay as they are. ``next_id`` adds fact_id."""
        active = self.read().where("superseded_by is null and not startswith(object, 'retired_')")
        known = active.where(F.col("predicate") == HASH).select("source", F.col("object").alias("_held"))
        news = files.join(known, "source", "full_outer").where("hash is null or _held is null or _held <> hash")
        stage = f"staging/{uuid.uuid4().hex}"
        try:  # files are read and compared once
            news.write.parquet(f"{self.path}/{stage}")
            news = self.spark.read.schema(news.schema).parquet(f"{self.path}/{stage}")
            if news.isEmpty():
                return {"version": self.versions()[-1], "added": 0, "rewritten": 0}
            changed, same = news.where("hash is not null").drop("_held"), [*KEY, "object", "source"]
            stated = extract(changed).select(*same).distinct().withColumn("_said", F.lit(True))
            mine = active.where(F.col("predicate") != HASH).join(news.select("source"), "source", "left_semi").select(*same, F.lit(True).alias("_mine"))
            differ = stated.join(mine, same, "full_outer").where("_said is null or _mine is null").withColumn("_gone", F.col("_said").isNull())
            ends = news.select(F.col("source").alias("subject"), F.lit(HASH).alias("predicate"), F.coalesce("hash", "_held").alias("object"), "source", F.col("hash").isNull().alias("_gone"))
            # what is gone is closed by a fact that retires it; of hashes the newest alone stands
            rows = differ.select(*same, "_gone").withColumn("closes", F.lit(None).cast("string")).unionByName(ends.withColumn("closes", F.lit("*")))
            retired = F.concat(F.lit("retired_"), F.substring(F.sha2(F.concat_ws("|", *same), 256), 1, 12))
            rows = rows.select(*KEY, F.when(F.col("_gone"), retired).otherwise(F.col("object")).alias("object"), F.when(F.col("_gone"), F.col("object")).otherwise(F.col("closes")).alias("closes"), "source")
            return self.merge(next_id(rows.withColumn("valid_from", now).withColumn("recorded_at", now)))
        finally:
            self.folder.delete(stage)

    def vacuum(self, keep: int = 10) -> int:
        """Forget all but the last ``keep`` versions; returns the folders removed."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.folder.delete(f"manifests/{v:010d}.json")
        kept = [at for v in versions[-keep:] for at in self.manifest(v)["at"].values()]
        named = {(at if isinstance(at, str) else at[0]).split("/")[1] for at in kept}
        old = [n for n in self.folder.names("data") if n not in named]
        for n in old:
            self.folder.delete(f"data/{n}")
        return len(old)


class Readers:
    """How far each reader has come, in two logs: what a delivery covers is put down before
    it is read, and that it arrived after. A delivery that was begun and not committed is
    given again with the same number and the same versions; one committed never again."""

    def __init__(self, table: FactTable, path: str):
        self.table, self.folder = table, Folder(table.spark, path)

    @staticmethod
    def name(workspace: str, tool: str, client: str, scope: str, request: str = "") -> str:
        """A reader is told by all five; another request of one client has a cursor of its own."""
        return hashlib.sha256("|".join(x.replace("\\", "\\\\").replace("|", "\\|") for x in (workspace, tool, client, scope, request)).encode()).hexdigest()[:32]

    def next(self, reader: str) -> tuple[int, int, int] | None:
        """(number, after, to) of the delivery that is due; None if the reader has all."""
        planned = [n for n in self.folder.names(f"{reader}/offsets") if n.endswith(".json")]
        last = self.folder.read(f"{reader}/offsets/{planned[-1]}") if planned else {"number": -1, "to": 0}
        if planned and not self.folder.exists(f"{reader}/commits/{planned[-1]}"):
            return last["number"], last["after"], last["to"]
        now = self.table.versions()[-1]
        if now == last["to"]:
            return None
        due = {"number": last["number"] + 1, "after": last["to"], "to": now}
        if not self.folder.put(f"{reader}/offsets/{due['number']:010d}.json", due):
            return self.next(reader)  # another process of this reader was first
        return due["number"], due["after"], due["to"]

    def commit(self, reader: str, number: int) -> None:
        self.folder.put(f"{reader}/commits/{number:010d}.json", {"number": number})

    @contextmanager
    def delivery(self, reader: str) -> Iterator[tuple[int, DataFrame] | None]:
        """The delivery that is due, committed if the block ends well. Its number lets the
        receiver write to a place of its own, so that a second attempt replaces the first."""
        due = self.next(reader)
        if due is None:
            yield None
            return
        yield due[0], self.table.changes(due[1], due[2])
        self.commit(reader, due[0])
