"""A symbol index of source files: definitions, imports, exports, references, calls and their targets.

One pass lexes each file where it is read (tessera.functions.lexing); everything after
it is joins over the marks. A name that many files define never meets all its
uses: what a call may mean outside its file and imports is cut to the first few
definitions of the name before the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions.lexing import marks as marks_of
from tessera.operators.code import path_priority
from tessera.sources.shared import scratch_folder

MARKS = "path string, language string, kind string, name string, receiver string, scope int, start int, stop int, line int, extra array<string>"
#: Definitions that one name stands for outside its file and imports (a limit of the operator).
MOST_TARGETS = 8
#: Marks that are sent at once, whole files, about: a batch costs more than the lexing of a small file.
BATCH_MARKS = 8192


def code_marks(files: DataFrame) -> DataFrame:
    """Marks of ``files`` (path, text); languages without a lexer and null texts have none."""
    schema = pa.schema([("path", pa.string()), ("language", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("receiver", pa.string()), ("scope", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("line", pa.int32()), ("extra", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows = []
        for batch in batches:
            for path, language, text in zip(*(batch[c].to_pylist() for c in ("path", "language", "text")), strict=True):
                rows.extend((path, language, *m) for m in marks_of(text, language))
                if len(rows) >= BATCH_MARKS:
                    yield sent(rows)
                    rows = []
        if rows:
            yield sent(rows)

    rows = files.where("text is not null and path is not null").select("path", fn.language_of(F.col("path")).alias("language"), "text")
    return rows.mapInArrow(run, MARKS)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z]+$", "")


def symbols(marks: DataFrame) -> DataFrame:
    """Definitions: id, path, kind, name, owner, start, stop, line, public. Definitions of one kind
    and name in one file, as of a type and its methods' block, are one: the first."""
    rows = marks.where(F.col("kind").isin("class", "function", "method"))
    first = F.min_by(F.struct("start", "stop", "line", "scope"), F.col("start")).alias("at")
    rows = rows.groupBy("path", "language", "kind", "name", F.col("receiver").alias("owner")).agg(first, F.max(F.array_contains("extra", "public")).alias("public"))
    ident = F.concat(F.lit("symbol_"), F.substring(F.sha2(F.concat_ws(":", "path", "kind", F.concat_ws("_", "owner", "name")), 256), 1, 32))
    return rows.select(ident.alias("id"), "path", "language", "kind", "name", "owner", "at.start", "at.stop", "at.line", "at.scope", "public")


def relative_path(folder: Column, raw: Column) -> Column:
    """``folder``/``raw`` with '.' and '..' steps taken at any depth; null where it leaves the root."""
    steps = F.split(F.concat_ws("/", folder, raw), "[/\\\\]")
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))
        return F.when(done.isNull() | part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(steps, start, step), "/")


def resolve_imports(marks: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Imports, and exports taken from a module, with the file meant: path, start, module, names, target_path (null: none known), target.

    A relative module is followed from the folder of the file, at any depth. Another
    one is looked up in ``packages`` (name, stem): whole, or by its longest prefix at '/',
    then '.', then ':'; what follows a '.' is a path below the package. Else a dotted
    module may be a path from the root. A stem may name a file, or a folder's index."""
    rows = marks.where("kind = 'import' or (kind = 'export' and receiver is not null)").select(
        "path", "language", "start", "kind", F.when(F.col("kind") == "import", F.col("name")).otherwise(F.col("receiver")).alias("module"), "name", "extra"
    ).withColumn("n", F.monotonically_increasing_id())
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    below = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.concat_ws("/", F.expr("nullif(repeat('../', length(regexp_extract(module, '^(\\\\.+)', 1)) - 1), '')"), below)
    relative = F.when(F.startswith("module", F.lit(".")), relative_path(folder, F.when((F.col("language") == "python") & (dots > 0), python).otherwise(F.col("module"))))
    bare = F.regexp_replace("module", r"^((crate|self|super)::)+", "")
    rows = rows.withColumn("relative", stem(relative)).withColumn("bare", F.when(~F.startswith("module", F.lit(".")), bare))
    spark = marks.sparkSession
    packages = packages if packages is not None else spark.createDataFrame([], "name string, stem string")
    # every prefix that a package may have, the longest first, by kind of separator
    prefixes = F.array(F.struct(F.lit(0).alias("rank"), F.col("bare").alias("prefix"), F.lit("").alias("rest")))

    def cuts(k: int, mark: str) -> Column:
        parts = F.split("bare", f"[{mark}]")
        ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        rest = lambda n: F.array_join(F.slice(parts, n + 1, F.size(parts)), "/") if mark == "." else F.lit("")
        return F.transform(ends, lambda n: F.struct((F.lit((k + 1) * 10_000) - n).alias("rank"), F.array_join(F.slice(parts, 1, n), mark).alias("prefix"), rest(n).alias("rest")))

    prefixes = F.concat(prefixes, *[cuts(k, mark) for k, mark in enumerate(("/", ".", ":"))])
    tried = rows.where("bare is not null").select("n", F.inline(prefixes)).join(packages.select(F.col("name").alias("prefix"), F.col("stem").alias("base")), "prefix")
    whole = F.when((F.col("rest") != "") & ~F.col("base").rlike(r"src/(lib|index)$"), F.concat_ws("/", "base", "rest")).otherwise(F.col("base"))
    named = tried.groupBy("n").agg(F.min_by(whole, F.col("rank")).alias("packaged"))
    rows = rows.join(named, "n", "left")
    base = F.coalesce("relative", "packaged", F.replace("bare", F.lit("."), F.lit("/")))
    options = [base, F.concat(base, F.lit("/index")), F.concat(base, F.lit("/__init__")), F.concat(base, F.lit("/mod"))]
    tried = rows.withColumn("base", base).select("n", "language", F.posexplode(F.array(*options)).alias("rank", "stem"))
    known = files.select(F.col("path").alias("target_path"), stem(F.col("path")).alias("stem"), fn.language_of(F.col("path")).alias("its")).distinct()
    found = tried.join(known, "stem").groupBy("n").agg(F.min_by("target_path", F.struct("rank", F.col("its") != F.col("language"), "target_path")).alias("target_path"))
    rows = rows.join(found, "n", "left")
    target = F.coalesce(F.concat(F.lit("module:"), stem(F.col("target_path"))), F.concat(F.lit("module:"), "relative"), F.concat(F.lit("module:"), "packaged"), F.concat(F.lit("package:"), "module"))
    return rows.select("path", "start", "kind", "module", "name", F.col("extra").alias("names"), "target_path", target.alias("target"))


def exports(marks: DataFrame, syms: DataFrame, imports: DataFrame) -> DataFrame:
    """What each file offers: path, name, symbol id. Public definitions outside others, names of export
    lists under their new names, and names taken over from another file, one by one or all."""
    own = syms.where("public and scope = -1").select("path", "name", "id")
    named = marks.where("kind = 'export' and receiver is null").select("path", F.col("name").alias("inner"), F.col("extra")[0].alias("name"))
    inside = syms.where("scope = -1").select("path", F.col("name").alias("inner"), "id")
    listed = named.join(inside, ["path", "inner"]).select("path", "name", "id")
    taken = imports.where("kind = 'export' and target_path is not null").select(F.col("path").alias("to"), F.col("target_path").alias("path"), F.col("name").alias("inner"), F.col("names")[0].alias("new"))
    first = own.unionByName(listed).distinct()
    one = taken.where("inner <> '*'").join(first.withColumnRenamed("name", "inner"), ["path", "inner"]).select(F.col("to").alias("path"), F.col("new").alias("name"), "id")
    every = taken.where("inner = '*'").join(first, "path").select(F.col("to").alias("path"), "name", "id")
    return first.unionByName(one).unionByName(every).distinct()


def call_edges(marks: DataFrame, syms: DataFrame, imports: DataFrame, offered: DataFrame) -> DataFrame:
    """Calls with their targets: path, line, name, caller (a symbol id, or file:path outside all), callee.

    In this order, the first that gives a target: the method of the receiver's type (the
    class around for self and this; the type that the receiver was bound to in the scope,
    or as a member of the class); a name that the file imports, or one of a module that
    it imports whole; a definition of the name in the file, then in imported
    files, then anywhere, by the place of the file. Of equally good ones all are kept;
    a call of production code never goes to a definition elsewhere that only tests
    have. Calls without target, and of a definition to itself, have no row."""
    calls = marks.where("kind in ('call', 'new')").select("path", "scope", "line", "name", "receiver").withColumn("call", F.monotonically_increasing_id())
    around = syms.select("path", F.col("start").alias("scope"), F.col("id").alias("caller"), F.col("owner").alias("in_class"), F.when(F.col("kind") == "class", F.col("name")).alias("is_class"))
    calls = calls.join(around, ["path", "scope"], "left").withColumn("in_class", F.coalesce("in_class", "is_class")).drop("is_class")
    bound = marks.where("kind = 'bind'").select("path", "scope", F.col("name").alias("receiver"), F.col("receiver").alias("type"), F.array_contains("extra", "member").alias("member"))
    local = bound.where("not member").groupBy("path", "scope", "receiver").agg(F.max("type").alias("local_type"))
    members = bound.where("member").join(around, ["path", "scope"]).groupBy("path", "in_class", "receiver").agg(F.max("type").alias("member_type"))
    calls = calls.join(local, ["path", "scope", "receiver"], "left").join(members, ["path", "in_class", "receiver"], "left")
    mine = F.col("receiver").isin("self", "this", "cls", "Self")
    calls = calls.withColumn("type", F.when(mine, F.col("in_class")).otherwise(F.coalesce("local_type", "member_type", "receiver"))).drop("local_type", "member_type")

    rank = lambda same, seen: F.when(same, 0).when(seen, 10).otherwise(20) + path_priority(F.col("to_path"))
    methods = syms.where("kind = 'method'").select(F.col("owner").alias("type"), "name", F.col("id").alias("callee"), F.col("path").alias("to_path"))
    few = Window.partitionBy("type", "name").orderBy(path_priority(F.col("to_path")), "to_path", "callee")
    first_methods = methods.withColumn("r", F.row_number().over(few)).where(F.col("r") <= MOST_TARGETS).drop("r")
    typed = [
        calls.join(methods.withColumn("path", F.col("to_path")), ["path", "type", "name"]).select("call", "callee", "to_path", F.lit(0).alias("rank")),
        calls.join(first_methods, ["type", "name"]).select("call", "callee", "to_path", rank(F.col("path") == F.col("to_path"), F.lit(False)).alias("rank")),
    ]
    taken = imports.where("kind = 'import' and target_path is not null").select("path", F.col("target_path").alias("to_path"), F.explode("names").alias("n"))
    taken = taken.select("path", "to_path", F.split_part("n", F.lit("="), F.lit(1)).alias("local"), F.split_part("n", F.lit("="), F.lit(2)).alias("outer"))
    outer = offered.select(F.col("path").alias("to_path"), F.col("name").alias("outer"), F.col("id").alias("callee"))
    by_import = [
        calls.where("receiver is null").join(taken, (calls["path"] == taken["path"]) & (calls["name"] == taken["local"])).select("call", "to_path", "outer"),
        calls.join(taken, (calls["path"] == taken["path"]) & (calls["receiver"] == taken["local"])).select("call", "to_path", F.col("name").alias("outer")),
    ]
    imported = by_import[0].unionByName(by_import[1]).join(outer, ["to_path", "outer"]).select("call", "callee", "to_path", F.lit(100).alias("rank"))

    named = syms.select("name", F.col("id").alias("callee"), F.col("path").alias("to_path"))
    reach = imports.where("kind = 'import' and target_path is not null").select("path", F.col("target_path").alias("to_path")).distinct()
    plain = calls.where("receiver is null").select("call", "path", "name")
    few = Window.partitionBy("name").orderBy(path_priority(F.col("to_path")), "to_path", "callee")
    anywhere = named.withColumn("r", F.row_number().over(few)).where(F.col("r") <= MOST_TARGETS).drop("r")
    by_name = [
        plain.join(named.withColumn("path", F.col("to_path")), ["path", "name"]).select("call", "path", "callee", "to_path", (F.lit(200) + rank(F.lit(True), F.lit(True))).alias("rank")),
        plain.join(reach, "path").join(named, ["to_path", "name"]).select("call", "path", "callee", "to_path", (F.lit(200) + rank(F.col("path") == F.col("to_path"), F.lit(True))).alias("rank")),
        plain.join(anywhere, "name").select("call", "path", "callee", "to_path", (F.lit(200) + rank(F.col("path") == F.col("to_path"), F.lit(False))).alias("rank")),
    ]
    options = typed[0].unionByName(typed[1]).unionByName(imported)
    for df in by_name:
        test_only = (path_priority(F.col("path")) < 3) & (F.col("rank") >= 220) & (path_priority(F.col("to_path")) >= 3)
        options = options.unionByName(df.where(~test_only).drop("path"))
    best = Window.partitionBy("call").orderBy("rank")
    chosen = options.distinct().withColumn("r", F.rank().over(best)).where("r = 1").select("call", "callee").distinct()
    out = calls.join(chosen, "call").withColumn("caller", F.coalesce("caller", F.concat(F.lit("file:"), "path")))
    # a name taken over from another file is defined there
    places = syms.select(F.col("id").alias("callee"), F.col("path").alias("to_path"))
    return out.where("caller <> callee").join(places, "callee").select("path", "line", "name", "caller", "callee", "to_path")


def references(marks: DataFrame, syms: DataFrame) -> DataFrame:
    """Uses of a defined name, calls included, once a scope: path, line, name, symbol id (at most MOST_TARGETS a name, its own file's first)."""
    uses = marks.where("kind in ('ref', 'call', 'new')").groupBy("path", "scope", "name").agg(F.min("line").alias("line"))
    own = syms.select("path", "name", "id")
    few = Window.partitionBy("name").orderBy(path_priority(F.col("path")), "path", "id")
    first = own.withColumn("r", F.row_number().over(few)).where(F.col("r") <= MOST_TARGETS).select("name", "id")
    here = uses.join(own, ["path", "name"])
    there = uses.join(own.select("path", "name").distinct(), ["path", "name"], "left_anti").join(first, "name")
    return here.select("path", "scope", "line", "name", "id").unionByName(there.select("path", "scope", "line", "name", "id"))


def source_graph(files: DataFrame, syms: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files and symbols with ids that follow from what they are; edges whose ends are no nodes are dropped."""
    digest = lambda kind, *parts: F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))
    file_id = lambda c: digest("node", F.lit("file"), F.col(c))
    symbol_id = lambda c: digest("node", F.lit("symbol"), F.col(c))
    nodes = files.select(file_id("path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"), "path").unionByName(
        syms.select(symbol_id("id").alias("id"), "kind", F.concat_ws("_", "owner", "name").alias("label"), "path")
    ).dropDuplicates(["id"])
    caller = F.when(F.startswith("caller", F.lit("file:")), file_id("path")).otherwise(symbol_id("caller"))
    edges = (
        syms.select(F.lit("contains").alias("kind"), file_id("path").alias("src"), symbol_id("id").alias("dst"))
        .unionByName(imports.where("target_path is not null").select(F.lit("imports").alias("kind"), file_id("path").alias("src"), file_id("target_path").alias("dst")))
        .unionByName(calls.select(F.lit("calls").alias("kind"), caller.alias("src"), symbol_id("callee").alias("dst")))
    ).distinct()
    ends = nodes.select("id")
    edges = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select(digest("edge", "kind", "src", "dst").alias("id"), "kind", "src", "dst")


class SymbolIndex:
    """The index of ``files`` (path, text). Its parts are made when asked for and written once to the
    shared folder, so that no file is lexed and no call resolved twice."""

    def __init__(self, files: DataFrame, packages: DataFrame | None = None, marks: DataFrame | None = None):
        self.files = files.select("path").where("path is not null").distinct()
        self._given, self._packages, self._marks = files, packages, marks

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        at = scratch_folder(df.sparkSession, name)
        df.write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    @cached_property
    def marks(self) -> DataFrame:
        return self._written(code_marks(self._given), "marks") if self._marks is None else self._marks

    @cached_property
    def symbols(self) -> DataFrame:
        return self._written(symbols(self.marks), "symbols")

    @cached_property
    def imports(self) -> DataFrame:
        return self._written(resolve_imports(self.marks, self.files, self._packages), "imports")

    @cached_property
    def exports(self) -> DataFrame:
        return exports(self.marks, self.symbols, self.imports)

    @cached_property
    def calls(self) -> DataFrame:
        return self._written(call_edges(self.marks, self.symbols, self.imports, self.exports), "calls")

    @cached_property
    def references(self) -> DataFrame:
        return references(self.marks, self.symbols)

    def definition(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name)

    def uses(self, name: str) -> DataFrame:
        return self.references.where(F.col("name") == name)

    def callers(self, name: str) -> DataFrame:
        """Symbols that call a definition of ``name``."""
        edges = self.calls.join(self.definition(name).select(F.col("id").alias("callee")), "callee", "left_semi")
        return edges.select(F.col("caller").alias("id")).distinct().join(self.symbols, "id").select("id", "path", "kind", "name")

    def callees(self, name: str) -> DataFrame:
        edges = self.calls.join(self.definition(name).select(F.col("id").alias("caller")), "caller", "left_semi")
        return edges.select(F.col("callee").alias("id")).distinct().join(self.symbols, "id").select("id", "path", "kind", "name")

    def file_outline(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("path") == path).select("line", "kind", F.concat_ws("_", "owner", "name").alias("name"), "public").orderBy("line", "name")

    def repository_outline(self) -> DataFrame:
        """Each file with how many definitions of each kind it holds; files without any too."""
        n = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
        return self.files.join(self.symbols, "path", "left").groupBy("path").agg(n("class"), n("function"), n("method"))

    def facts(self) -> DataFrame:
        """Distinct (subject, predicate, object, source): IS_A, DEFINES, CALLS and IMPORTS."""
        label = lambda kind, owner, name: F.concat(F.when(kind == "class", "class:").when(kind == "method", "method:").otherwise("function:"), F.concat_ws("_", owner, name))
        s = self.symbols.withColumn("label", label(F.col("kind"), F.col("owner"), F.col("name")))
        module = F.concat(F.lit("module:"), stem(F.col("path")))
        fact = lambda df, a, p, b: df.select(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"), F.col("path").alias("source"))
        owners = s.where("owner is not null")
        names = s.select("id", "label")
        calls = self.calls.join(names.select(F.col("id").alias("callee"), F.col("label").alias("to")), "callee").join(names.select(F.col("id").alias("caller"), F.col("label").alias("from")), "caller", "left")
        return (
            fact(s, F.col("label"), "IS_A", F.initcap("kind")).unionByName(fact(s.where("owner is null"), module, "DEFINES", F.col("label")))
            .unionByName(fact(owners, F.concat(F.lit("class:"), "owner"), "DEFINES", F.col("label")))
            .unionByName(fact(calls, F.coalesce("from", module), "CALLS", F.col("to"))).unionByName(fact(self.imports.where("kind = 'import'"), module, "IMPORTS", F.col("target")))
        ).distinct()
