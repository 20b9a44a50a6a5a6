"""Ignore rules of a tree of files: rules of each folder, the last that matches wins, and a file below an ignored folder stays ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_rules(rule_files: DataFrame) -> DataFrame:
    """Rules of ``rule_files`` (folder, text; '' is the root): folder, n, negated, folders_only, pattern (a
    regular expression for the path below the folder). Comments and blank lines are no rules."""
    lines = rule_files.where("text is not null").select(F.coalesce("folder", F.lit("")).alias("folder"), F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")).where("line <> '' and not startswith(line, '#')")
    negated = F.startswith("line", F.lit("!"))
    body = F.when(negated, F.substring("line", 2, 1 << 20)).otherwise(F.regexp_replace("line", r"^\\([#!])", "$1"))
    folders_only, bare = F.endswith(body, F.lit("/")), F.regexp_replace(body, "/$", "")
    anchored = F.contains(bare, F.lit("/"))
    glob = F.regexp_replace(bare, "^/", "")
    # signs that mean themselves, then stars: '**' as whole steps, '*' and '?' inside one
    plain = F.regexp_replace(glob, r"([.+^$(){}|])", r"\\$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\[!", "[^"), r"^\*\*/", "\u0001")
    plain = F.regexp_replace(F.regexp_replace(plain, r"/\*\*/", "\u0002"), r"/\*\*$", "\u0003")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\*+", "[^/]*"), r"(?<!\\)\?", "[^/]")
    plain = F.replace(F.replace(F.replace(plain, F.lit("\u0001"), F.lit("(.*/)?")), F.lit("\u0002"), F.lit("/(.*/)?")), F.lit("\u0003"), F.lit("/.+"))
    pattern = F.concat(F.when(anchored, "^").otherwise("^(.*/)?"), plain, F.lit("$"))
    return lines.select("folder", "n", negated.alias("negated"), folders_only.alias("folders_only"), pattern.alias("pattern")).where("pattern not in ('^$', '^(.*/)?$')")


def _steps(path: Column) -> Column:
    """Every path above ``path``, from the root's entry down, without itself."""
    parts = F.split(path, "/")
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored(files: DataFrame, rule_files: DataFrame) -> DataFrame:
    """``files`` (path) with by: the entry that decides it, the folder of its rule and the rule's line; null if it is not ignored.

    Every folder on the way to a file is judged as an entry of its own, once for all files below
    it: rules of the folders above it are joined by folder, so a rule meets only what lies
    below its file, and the deepest folder's last matching rule wins. The topmost
    ignored entry decides; a rule below it cannot take a file back."""
    rules = parse_rules(rule_files)
    paths = files.select("path").where("path is not null").distinct()
    above = paths.select("path", F.explode(F.concat(_steps(F.col("path")), F.array("path"))).alias("entry"))
    entries = above.select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).groupBy("entry").agg(F.bool_or("is_folder").alias("is_folder"))
    reach = entries.select("entry", "is_folder", F.explode(F.concat(F.array(F.lit("")), _steps(F.col("entry")))).alias("folder"))
    met = reach.join(rules, "folder")
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    met = met.where((~F.col("folders_only") | F.col("is_folder")) & F.regexp_like(below, F.col("pattern")))
    last = met.groupBy("entry").agg(F.max_by(F.struct("negated", "folder", "n"), F.struct(F.length("folder"), "n")).alias("rule")).where("not rule.negated")
    first = above.join(last, "entry").groupBy("path").agg(F.min_by(F.struct("entry", "rule.folder", "rule.n"), F.length("entry")).alias("by"))
    return paths.join(first, "path", "left").select("path", F.col("by.entry").alias("entry"), F.col("by.folder").alias("folder"), F.col("by.n").alias("line"))
