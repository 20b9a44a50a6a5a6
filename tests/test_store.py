"""The stored fact table: merges against a plain rebuild, commits, refreshes, readers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources.facttable import HASH, Conflict, FactTable, Readers, fingerprint, with_intervals
from tessera.sources.shared import Folder, scratch_folder, shared_folder

DAY = datetime(2024, 1, 1)
SCHEMA = "fact_id bigint, subject string, predicate string, object string, closes string, valid_from timestamp, source string, recorded_at timestamp"


def statement(i, subject, object_, closes, day, recorded=None):
    return (i, subject, "p", object_, closes, DAY + timedelta(days=day), "s", DAY + timedelta(days=day if recorded is None else recorded))


def rebuilt(rows):
    """{fact_id: fact_id that closes it} by trying every later statement."""
    out = {}
    for r in rows:
        later = [n for n in rows if n[1:3] == r[1:3] and (n[5], n[0]) > (r[5], r[0]) and (n[4] == r[3] or (n[4] == "*" and n[3] != r[3]))]
        out[r[0]] = min(later, key=lambda n: (n[5], n[0]))[0] if later else None
    return out


def held(table):
    return {r.fact_id: r.superseded_by for r in table.read().collect()}


@pytest.fixture
def table(spark):
    return FactTable.create(spark, scratch_folder(spark, "t"), buckets=4)


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_a_rebuild(spark, table, seed):
    rng = random.Random(seed)
    rows = [statement(i, rng.choice("abc"), rng.choice("xyz"), rng.choice([None, "*", "*", "x", "y"]), rng.randrange(12)) for i in range(60)]
    seen, once = set(), []
    for r in rows:  # equal statements count once
        if r[1:6] not in seen:
            seen.add(r[1:6])
            once.append(r)
    rng.shuffle(once)
    for k in range(0, len(once), 20):
        table.merge(spark.createDataFrame(once[k : k + 20], SCHEMA))
        assert held(table) == rebuilt(once[: k + 20])
    for r in table.read().collect():
        assert (r.status == "active") == (r.superseded_by is None) and (r.valid_until is None) == (r.superseded_by is None)


def test_intervals_take_one_shuffle(spark):
    """A row may not be sent, or its statement read, more than once."""
    rows = spark.createDataFrame([statement(1, "a", "x", "*", 1)], SCHEMA).repartition(3, "source")
    plan = with_intervals(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(subject") == 1 and plan.count("Scan") == 1 and "Join" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_parted_buckets_and_copies_equal_a_rebuild(spark, table, monkeypatch, seed):
    monkeypatch.setattr("tessera.sources.facttable.TASK_ROWS", 7)
    rng = random.Random(seed)
    rows = [statement(i, rng.choice("abcdefghij"), rng.choice(["x", "y", None]), "*", rng.randrange(9)) for i in range(90)]
    seen, once = set(), []
    for r in rows:  # equal statements count once
        if r[1:6] not in seen:
            seen.add(r[1:6])
            once.append(r)
    table.merge(spark.createDataFrame(rows[:50], SCHEMA))
    assert table.merge(spark.createDataFrame(rows[20:], SCHEMA))["added"] == sum(r[0] >= 50 for r in once)
    assert held(table) == rebuilt(once) and table.manifest()["rows"] == {b: n for b, n in table.manifest()["rows"].items() if n} and sum(table.manifest()["rows"].values()) == len(once)
    table.merge(spark.createDataFrame([statement(100, "a", "z", "x", 10), statement(101, "b", "z", "y", 10)], SCHEMA))
    assert held(table) == rebuilt([*once, statement(100, "a", "z", "x", 10), statement(101, "b", "z", "y", 10)])


def test_same_batch_twice_changes_nothing(spark, table):
    batch = spark.createDataFrame([statement(1, "a", "x", "*", 1), statement(2, "b", "x", None, 1), statement(9, "a", "x", "*", 1)], SCHEMA)
    first = table.merge(batch)
    assert (first["version"], first["added"]) == (1, 2)
    files = Folder(spark, table.path).names("data")
    assert table.merge(batch) == {"version": 1, "added": 0, "rewritten": 0}
    assert Folder(spark, table.path).names("data") == files and table.versions() == [0, 1] and Folder(spark, table.path).names("staging") == []
    assert sorted(r.fact_id for r in table.read().collect()) == [1, 2]


def test_a_late_statement_closes_the_right_version(spark, table):
    table.merge(spark.createDataFrame([statement(1, "a", "x", "*", 1), statement(2, "a", "z", "*", 20)], SCHEMA))
    assert held(table) == {1: 2, 2: None}
    table.merge(spark.createDataFrame([statement(3, "a", "y", "*", 10, 25)], SCHEMA))
    rows = {r.fact_id: r for r in table.read(key=("a", "p")).collect()}
    assert {i: r.superseded_by for i, r in rows.items()} == {1: 3, 2: None, 3: 2} and rows[1].valid_until == DAY + timedelta(days=10)
    assert {(r.fact_id, r.op) for r in table.changes(1).collect()} == {(1, "r"), (3, "r")}
    assert {(r.fact_id, r.op) for r in table.changes(0, 1).collect()} == {(1, "r"), (2, "d")}
    assert {r.fact_id: r.superseded_by for r in table.read(1).collect()} == {1: 2, 2: None}


def test_a_batch_in_one_partition_is_dealt_out(spark, table, monkeypatch):
    """What a merge makes of its batch may not wait for the one task that reads it."""
    staged, delete = [], Folder.delete
    monkeypatch.setattr(Folder, "delete", lambda f, n: (staged.extend(x for x in f.names(n) if x.startswith("part-")), delete(f, n)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.merge(spark.createDataFrame([statement(i, f"k{i}", "x", "*", 1) for i in range(200)], SCHEMA).coalesce(1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(staged) == 4 and table.read().count() == 200


def test_an_empty_table_is_read_without_python(spark, table):
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan


def test_repeated_statements_are_found_whatever_their_time(spark, table):
    undated = lambda i, s: statement(i, s, "x", "*", 1)[:5] + (None, "s", DAY)
    table.merge(spark.createDataFrame([statement(1, "a", "x", "*", 1), statement(2, "a", "y", "*", 5), undated(3, "a"), undated(4, "b")], SCHEMA))
    for again in ([statement(5, "a", "x", "*", 1)], [undated(6, "b")], [statement(7, "a", "y", "*", 5), undated(8, "a")]):
        assert table.merge(spark.createDataFrame(again, SCHEMA)) == {"version": 1, "added": 0, "rewritten": 0}
    late = table.merge(spark.createDataFrame([statement(9, "a", "x", "*", 1), statement(10, "a", "z", "*", 3), undated(11, "b")], SCHEMA))
    assert late["added"] == 1 and held(table) == {3: 10, 1: 10, 10: 2, 2: None, 4: None}


def test_statements_a_microsecond_apart_are_two(spark, table):
    """What a delivery counts may not fall together by the millisecond."""
    at = lambda i, object_, micros: statement(i, "a", object_, "*", 1)[:5] + (DAY + timedelta(microseconds=micros), "s", DAY)
    first = spark.createDataFrame([at(1, "x", 100), at(2, "y", 200), at(3, "x", 300)], SCHEMA)
    readers, me = Readers(table, scratch_folder(spark, "r")), Readers.name("w", "recall", "c", "s")
    assert table.merge(first)["added"] == 3 and table.merge(first)["added"] == 0 and held(table) == {1: 2, 2: 3, 3: None}
    with readers.delivery(me) as (_, rows):
        assert {(r.fact_id, r.op) for r in rows.collect()} == {(1, "r"), (2, "r"), (3, "d")}
    assert table.merge(spark.createDataFrame([at(4, "y", 400), at(5, "y", 200)], SCHEMA))["added"] == 1
    with readers.delivery(me) as (_, rows):
        assert {(r.fact_id, r.op) for r in rows.collect()} == {(3, "r"), (4, "d")}


def test_digests_take_no_time_as_text(spark):
    """Writing the times as text took most of what a digest costs."""
    text = spark.createDataFrame([statement(1, "a", "x", "*", 1)], SCHEMA).withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")).select(fingerprint())
    plan = text._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(valid_from" in plan and "valid_from, valid_from#" not in plan


def test_a_table_with_digests_by_the_millisecond_is_merged_into(spark):
    table = FactTable.create(spark, scratch_folder(spark, "t"), buckets=1)
    table.merge(spark.createDataFrame([statement(1, "a", "x", "*", 1), statement(2, "a", "y", "*", 2)], SCHEMA))
    m = {k: v for k, v in table.manifest().items() if k != "digest"}
    table.read().withColumn("fingerprint", F.unhex(F.lit("00" * 16))).coalesce(1).write.parquet(f"{table.path}/data/older")
    older = [f"data/older/{n}" for n in Folder(spark, f"{table.path}/data/older").names() if n.startswith("part-")]
    table.folder.put("manifests/0000000002.json", m | {"version": 2, "at": {"0": older}})
    assert table.merge(spark.createDataFrame([statement(3, "a", "x", "*", 1)], SCHEMA))["added"] == 0
    assert table.merge(spark.createDataFrame([statement(4, "a", "x", "*", 3), statement(5, "a", "y", "*", 2)], SCHEMA))["added"] == 1
    assert held(table) == {1: 2, 2: 4, 4: None}


def test_a_bucket_named_by_its_folder_is_read(spark):
    table = FactTable.create(spark, scratch_folder(spark, "t"), buckets=1)
    table.merge(spark.createDataFrame([statement(1, "a", "x", "*", 1)], SCHEMA))
    m = table.manifest()
    table.folder.put("manifests/0000000002.json", m | {"version": 2, "at": {b: files[0].rsplit("/", 1)[0] for b, files in m["at"].items()}})
    table.merge(spark.createDataFrame([statement(2, "a", "y", "*", 2)], SCHEMA))
    assert held(table) == {1: 2, 2: None} and {r.fact_id for r in table.read(2).collect()} == {1} and table.vacuum(2) == 0


def test_only_touched_buckets_are_rewritten(spark, table):
    table.merge(spark.createDataFrame([statement(i, f"k{i}", "x", None, 1) for i in range(40)], SCHEMA))
    before = table.manifest()["at"]
    assert len(before) == 4
    table.merge(spark.createDataFrame([statement(99, "k1", "y", None, 2)], SCHEMA))
    after = table.manifest()["at"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert len(table.changes(1).inputFiles()) < len(table.read().inputFiles())
    assert table.read(key=("k1", "p")).count() == 2 and table.read(key=("none", "p")).count() == 0


def test_of_two_merges_of_a_version_one_fails(spark, table, monkeypatch):
    other = FactTable(spark, table.path)
    stale = other.manifest()
    table.merge(spark.createDataFrame([statement(1, "a", "x", "*", 1)], SCHEMA))
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        other.merge(spark.createDataFrame([statement(2, "a", "y", "*", 2)], SCHEMA))
    assert held(table) == {1: None} and len(Folder(spark, table.path).names("data")) == 1
    with pytest.raises(Conflict):
        FactTable.create(spark, table.path)


def test_empty_tables_and_nulls(spark, table):
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], SCHEMA))["version"] == 0
    table.merge(spark.createDataFrame([(1, None, None, None, None, DAY, None, DAY), (2, None, None, None, "*", DAY + timedelta(1), None, DAY), (3, None, None, "x", None, DAY, None, None)], SCHEMA))
    assert table.read().count() == 3


def test_vacuum_keeps_what_kept_versions_name(spark, table):
    for i in range(4):
        table.merge(spark.createDataFrame([statement(i, "a", f"x{i}", "*", i)], SCHEMA))
    assert table.vacuum(2) == 2 and table.versions() == [3, 4]
    assert table.read(3).count() == 3 and table.read().count() == 4


def test_refresh_retires_what_is_stated_no_more(spark):
    table = FactTable.create(spark, scratch_folder(spark, "t"), buckets=2, fact_id="string")
    read = []

    def extract(files):
        files = files.select("source", "said").collect()
        read.extend(f.source for f in files)
        return spark.createDataFrame([("m:" + f.source, "SAYS", w, f.source) for f in files for w in f.said.split()], "subject string, predicate string, object string, source string")

    next_id = lambda df: df.withColumn("fact_id", F.sha2(F.to_json(F.struct("subject", "predicate", "object", "closes", "valid_from")), 256))

    def refresh(day, **said):
        files = spark.createDataFrame([(s, w) for s, w in said.items()], "source string, said string").withColumn("hash", F.sha2("said", 256))
        return table.refresh(files, extract, F.lit(DAY + timedelta(days=day)), next_id)

    def active():
        rows = table.read().where(f"status = 'active' and predicate <> '{HASH}' and not startswith(object, 'retired_')").collect()
        return {(r.source, r.object, (r.valid_from - DAY).days) for r in rows}

    refresh(1, a="one two", b="three", c="four")
    assert active() == {("a", "one", 1), ("a", "two", 1), ("b", "three", 1), ("c", "four", 1)} and sorted(read) == ["a", "b", "c"]
    read.clear()
    refresh(2, a="one five", b="three")
    assert active() == {("a", "one", 1), ("a", "five", 2), ("b", "three", 1)} and read == ["a"]
    assert table.read().where("startswith(object, 'retired_')").count() == 3  # two, four, and the hash of c
    assert refresh(3, a="one five", b="three")["added"] == 0
    refresh(4, a="one five two", b="three", c="four")  # stated again
    assert active() == {("a", "one", 1), ("a", "five", 2), ("a", "two", 4), ("b", "three", 1), ("c", "four", 4)}


def test_a_refresh_reads_its_files_once(spark):
    table = FactTable.create(spark, scratch_folder(spark, "t"), buckets=2, fact_id="string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    extract = lambda f: f.select(F.concat(F.lit("m:"), "source").alias("subject"), F.lit("SAYS").alias("predicate"), F.explode(F.split("said", " ")).alias("object"), "source")
    next_id = lambda df: df.withColumn("fact_id", F.sha2(F.to_json(F.struct("subject", "predicate", "object", "closes", "valid_from")), 256))
    for day, said in ((1, [("a", "one two"), ("b", "three")]), (2, [("a", "one"), ("c", "four")])):
        files = spark.createDataFrame(said, "source string, said string").mapInPandas(seen, "source string, said string").withColumn("hash", F.sha2("said", 256))
        table.refresh(files, extract, F.lit(DAY + timedelta(days=day)), next_id)
        assert read.value == 2 * day
    rows = table.read().where(f"superseded_by is null and predicate <> '{HASH}'").collect()
    assert sorted((r.source, r.object) for r in rows if not r.object.startswith("retired_")) == [("a", "one"), ("c", "four")] and len(rows) == 4


def test_a_delivery_is_neither_lost_nor_repeated(spark, table):
    readers = Readers(table, scratch_folder(spark, "r"))
    me, other = Readers.name("w", "recall", "c", "s", "first"), Readers.name("w", "recall", "c", "s", "second")
    assert me != other and readers.next(me) is None
    table.merge(spark.createDataFrame([statement(1, "a", "x", "*", 1)], SCHEMA))
    with pytest.raises(RuntimeError), readers.delivery(me) as (number, rows):
        assert number == 0 and rows.count() == 1
        raise RuntimeError("stopped between read and commit")
    table.merge(spark.createDataFrame([statement(2, "a", "y", "*", 2)], SCHEMA))
    again = Readers(table, readers.folder.path)  # another process
    with again.delivery(me) as (number, rows):  # the same delivery, not one more
        assert number == 0 and [(r.fact_id, r.op) for r in rows.collect()] == [(1, "d")]
    with again.delivery(me) as (number, rows):
        assert number == 1 and {(r.fact_id, r.op) for r in rows.collect()} == {(1, "r"), (2, "d")}
    with again.delivery(me) as due:
        assert due is None
    with again.delivery(other) as (number, rows):  # another request of the same client has its own cursor
        assert number == 0 and rows.count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Session())
