"""Facts from source code by line patterns, their resolution, and the code graph.

No parser library is at hand, so extraction is lexical: one row a line, built-in
regular expressions, the enclosing class and function by running last values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn

#: Keywords that look like calls (fixed values).
NOT_CALLS = ("if", "for", "while", "switch", "return", "catch", "function", "def", "fn", "print", "super", "match", "elif", "with", "assert", "not", "and", "or", "in", "new")


def code_lines(files: DataFrame) -> DataFrame:
    """Lines of files (path, text) with language, module, and the class and function around them.

    A class or function at the margin holds the indented lines below it; in a class,
    the last method head with less indent holds a line. Nested classes are not told apart."""
    rows = files.select("path", fn.language_of(F.col("path")).alias("language"), F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.trim("line") != "")
    indent = F.length("line") - F.length(F.ltrim("line"))
    cls = F.regexp_extract("line", r"^\s*(?:export\s+|pub\s+|public\s+|abstract\s+)*(?:class|struct|trait|interface)\s+([A-Za-z_]\w*)", 1)
    fun = F.regexp_extract("line", r"^\s*(?:export\s+|pub\s+|async\s+|public\s+|private\s+|static\s+)*(?:def|function|fn|func)\s+([A-Za-z_]\w*)", 1)
    rows = rows.withColumn("indent", indent).withColumn("cls", F.when(cls != "", cls)).withColumn("fun", F.when(fun != "", fun))
    w = Window.partitionBy("path").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    top = F.last(F.when(F.col("indent") == 0, F.struct("cls", "fun", "n")), ignorenulls=True).over(before)
    head = F.last(F.when(F.col("fun").isNotNull(), F.struct("fun", "indent", "n")), ignorenulls=True).over(before)
    inner = F.when((head["n"] > top["n"]) & (head["indent"] < F.col("indent")), head["fun"])
    rows = rows.withColumn("top", top).withColumn("inner", F.when(F.col("indent") > 0, inner))
    in_class, in_function = F.when(F.col("indent") > 0, F.col("top.cls")), F.when(F.col("indent") > 0, F.coalesce("top.fun", "inner"))
    module = F.concat(F.lit("module:"), F.regexp_replace("path", r"\.[A-Za-z]+$", ""))
    return rows.withColumn("in_class", in_class).withColumn("in_function", in_function).withColumn("module", module).drop("top", "inner")


def definitions(lines: DataFrame) -> DataFrame:
    """(subject, kind, module, path, n): classes, functions, and methods as Class_method."""
    name = F.when(F.col("fun").isNotNull() & F.col("in_class").isNotNull(), F.concat_ws("_", "in_class", "fun")).otherwise(F.coalesce("fun", "cls"))
    kind = F.when(F.col("cls").isNotNull(), "class").otherwise("function")
    return lines.where("fun is not null or cls is not null").select(F.concat_ws(":", kind, name).alias("subject"), kind.alias("kind"), "module", "path", "n", F.coalesce("fun", "cls").alias("name"))


def call_sites(lines: DataFrame) -> DataFrame:
    """(caller, receiver, name, path, n) of each call in a line that defines nothing."""
    found = F.regexp_extract_all("line", F.lit(r"(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\s*\("), F.lit(0))
    caller = F.when(F.col("in_function").isNotNull() & F.col("in_class").isNotNull(), F.concat(F.lit("function:"), F.concat_ws("_", "in_class", "in_function"))).when(
        F.col("in_function").isNotNull(), F.concat(F.lit("function:"), "in_function")
    ).otherwise(F.col("module"))
    rows = lines.where("fun is null and cls is null").select(caller.alias("caller"), "in_class", "in_function", "path", "n", F.explode(found).alias("c"))
    receiver = F.regexp_extract("c", r"^([A-Za-z_]\w*)\.", 1)
    rows = rows.select("caller", "in_class", "in_function", "path", "n", F.when(receiver != "", receiver).alias("receiver"), F.regexp_extract("c", r"([A-Za-z_]\w*)\s*\($", 1).alias("name"))
    return rows.where(~F.col("name").isin(*NOT_CALLS))


def constructed(lines: DataFrame) -> DataFrame:
    """Variables bound to a new object: (path, in_function, receiver, type)."""
    pattern = r"([A-Za-z_]\w*)\s*(?::\s*\w+)?=\s*(?:new\s+)?([A-Z]\w*)\s*\("
    rows = lines.select("path", "in_function", F.regexp_extract("line", pattern, 1).alias("receiver"), F.regexp_extract("line", pattern, 2).alias("type"))
    return rows.where("receiver <> ''").groupBy("path", "in_function", "receiver").agg(F.max("type").alias("type"))


def resolve_calls(calls: DataFrame, defs: DataFrame, bound: DataFrame) -> DataFrame:
    """Target of each call: the method of the receiver's type or of ``self``, else the
    one definition of that name, else the first function of that name, else function:name."""
    calls = calls.withColumn("site", F.monotonically_increasing_id())
    b = bound.withColumnRenamed("type", "bound_type")
    on = (calls["path"] == b["path"]) & calls["in_function"].eqNullSafe(b["in_function"]) & (calls["receiver"] == b["receiver"])
    typed = calls.join(b, on, "left").drop(b["path"]).drop(b["in_function"]).drop(b["receiver"])
    owner = F.when(F.col("receiver").isin("self", "this"), F.col("in_class")).when(F.col("bound_type").isNotNull(), F.col("bound_type"))
    owner = F.coalesce(owner, F.when(F.col("receiver").isNull(), F.col("in_class")))
    typed = typed.withColumn("method", F.when(owner.isNotNull(), F.concat(F.lit("function:"), owner, F.lit("_"), F.col("name"))))
    known = defs.select(F.col("subject").alias("method"), F.lit(True).alias("is_method")).distinct()
    typed = typed.join(known, "method", "left")
    first = F.min(F.struct((F.col("kind") != "function").alias("other"), "subject"))
    named = defs.groupBy("name").agg(first.alias("d"), F.count_distinct("subject").alias("n_defs")).select("name", F.col("d.subject").alias("by_name"))
    out = typed.join(named, "name", "left")
    target = F.coalesce(F.when(F.col("is_method"), F.col("method")), F.col("by_name"), F.concat(F.lit("function:"), F.col("name")))
    return out.select("site", "caller", target.alias("callee"), "path", "n")


def imports(lines: DataFrame) -> DataFrame:
    """(module, target, path): imported modules, relative ones resolved against the folder."""
    raw = F.coalesce(
        F.nullif(F.regexp_extract("line", r"""^\s*import\b.*?from\s+['"]([^'"]+)['"]""", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"""require\(['"]([^'"]+)['"]\)""", 1), F.lit("")),
        F.nullif(F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\b", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*import\s+([\w.]+)\s*;?\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*use\s+([\w:]+)", 1), F.lit("")),
    )
    rows = lines.select("module", "path", raw.alias("raw")).where("raw is not null")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    joined = F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace("raw", r"^\./", ""))
    up = F.regexp_replace(F.regexp_replace(joined, r"[^/]+/\.\./", ""), r"[^/]+/\.\./", "")  # two steps up at most
    target = F.when(F.startswith("raw", F.lit(".")), F.concat(F.lit("module:"), F.regexp_replace(up, r"\.(js|ts|py)$", ""))).otherwise(F.concat(F.lit("package:"), "raw"))
    return rows.select("module", target.alias("target"), "path").distinct()


def routes(lines: DataFrame) -> DataFrame:
    """HTTP routes of express-like calls and Python decorators: (verb, path with :param, handler, file)."""
    js = r"""\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['"]([^'"]+)['"]\s*,\s*(?:\w+\s*,\s*)*([A-Za-z_]\w*)"""
    py = r"""^\s*@\w+\.(get|post|put|delete|patch|route)\(\s*['"]([^'"]+)['"]"""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    rows = lines.withColumn("next_fun", F.first("fun", ignorenulls=True).over(w))
    part = lambda p, i: F.regexp_extract("line", p, i)
    a = rows.where(part(js, 1) != "").select(F.upper(part(js, 1)).alias("verb"), part(js, 2).alias("route"), part(js, 3).alias("handler"), "path")
    b = rows.where(part(py, 1) != "").select(F.upper(F.replace(part(py, 1), F.lit("route"), F.lit("get"))).alias("verb"), part(py, 2).alias("route"), F.col("next_fun").alias("handler"), "path")
    return a.unionAll(b).withColumn("route", F.regexp_replace("route", r"\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*", ":param"))


def code_facts(files: DataFrame) -> DataFrame:
    """All facts of source files as distinct (subject, predicate, object, source)."""
    lines = code_lines(files)
    defs = definitions(lines)
    calls = resolve_calls(call_sites(lines), defs, constructed(lines))
    fact = lambda df, s, p, o: df.select(F.col(s).alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.col("path").alias("source"))
    every = fact(defs, "subject", "IS_A", F.initcap("kind")).unionAll(fact(defs, "module", "DEFINES", F.col("subject"))).unionAll(fact(calls, "caller", "CALLS", F.col("callee")))
    r = routes(lines).withColumn("subject", F.concat_ws(" ", F.concat(F.lit("route:"), "verb"), "route"))
    every = every.unionAll(fact(imports(lines), "module", "IMPORTS", F.col("target"))).unionAll(fact(r, "subject", "HAS_METHOD", F.col("verb"))).unionAll(fact(r, "subject", "HAS_PATH", F.col("route")))
    return every.unionAll(fact(r.where("handler is not null"), "subject", "HANDLED_BY", F.concat(F.lit("function:"), "handler"))).dropDuplicates(["subject", "predicate", "object", "source"])


def path_weight(path: Column) -> Column:
    """Weight of a file in search by its place."""
    return F.when(path.rlike(r"(^|/)(vendor|node_modules|third_party)/"), 0.35).when(path.rlike(r"(^|/)tests?/|[._]test\."), 0.55).when(path.rlike(r"(^|/)scripts?/"), 0.7).when(F.endswith(path, F.lit(".d.ts")), 0.8).otherwise(1.0)


def path_priority(path: Column) -> Column:
    return F.when(path.rlike(r"(^|/)(vendor|node_modules|third_party)/"), 4).when(path.rlike(r"(^|/)tests?/|[._]test\."), 3).when(path.rlike(r"(^|/)scripts?/") | F.endswith(path, F.lit(".d.ts")), 2).otherwise(0)


def best_targets(calls: DataFrame, defs: DataFrame, imported: DataFrame) -> DataFrame:
    """All definitions of the best rank for each call: same file, imported file, else elsewhere; then by place of the file."""
    c = calls.select("site", "name", F.col("path").alias("from_path"))
    d = defs.select("name", F.col("subject").alias("target"), F.col("path").alias("to_path"))
    i = imported.select("from_path", "to_path", F.lit(1).alias("seen")).distinct()
    rows = c.join(d, "name").join(i, ["from_path", "to_path"], "left")
    near = F.when(F.col("from_path") == F.col("to_path"), 0).when(F.col("seen") == 1, 1).otherwise(2)
    w = Window.partitionBy("site").orderBy(near * 10 + path_priority(F.col("to_path")))
    return rows.withColumn("r", F.rank().over(w)).where("r = 1").select("site", "target", "to_path")


def architecture_rank(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Files by what they are and how they are connected; the degree counts up to a bound."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    rows = nodes.join(ends, "node", "left").fillna(0, ["degree"])
    kind = F.when(F.col("kind") == "route", 90).when(F.col("kind") == "class", 40).when(F.col("kind") == "function", 20).otherwise(0)
    place = F.when(path_priority(F.col("path")) == 3, -180).when(path_priority(F.col("path")) == 4, -120).otherwise(0)
    score = kind + place + F.least(F.lit(60), 3 * F.col("degree"))
    return rows.select("node", "path", "degree", score.alias("score")).orderBy(F.col("score").desc(), "node").limit(top)


def search_graph(nodes: DataFrame, query: list[str], *, offset: int = 0, limit: int = 20) -> DataFrame:
    """Nodes (node, label, kind, path) by overlap with the query's terms, place and kind; one row a label, the best."""
    q = F.array(*[F.lit(x) for x in query])
    kind = F.when(F.col("kind").isin("class", "function", "route"), 1.18).otherwise(0.82)
    score = F.round(fn.overlap(q, fn.identifier_parts(F.col("label"))) * path_weight(F.col("path")) * kind, 6)
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "node")
    rows = nodes.withColumn("score", score).where("score > 0").withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.orderBy(F.col("score").desc(), "node").offset(offset).limit(limit).select("node", "label", "score")


def outline(defs: DataFrame, path: str) -> DataFrame:
    return defs.where(F.col("path") == path).orderBy("n").select("n", "subject")


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that two runs selected: added, removed, and those whose place moved (run rows: record, position)."""
    both = a.select("record", F.col("position").alias("p")).join(b.select("record", F.col("position").alias("q")), "record", "full_outer")
    state = F.when(F.col("p").isNull(), "added").when(F.col("q").isNull(), "removed").when(F.col("p") != F.col("q"), "moved").otherwise("same")
    return both.select("record", state.alias("state"))
