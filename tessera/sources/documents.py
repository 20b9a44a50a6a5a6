"""Facts from documents, pages, exports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT = "subject string, predicate string, object string, source string"
#: Snippets kept of one document, and their least length (limits of the operator).
MOST_SNIPPETS, LEAST_SNIPPET = 64, 12


def read_files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 1 << 20) -> DataFrame:
    """Files below a folder with digest, size and why they are left out (null: they are not). Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    skip = F.when(F.col("length") > most_bytes, "too_large")
    return files.select(F.col("path").alias("source"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"), skip.alias("skipped"), F.when(skip.isNull(), F.decode("content", "UTF-8")).alias("text"))


def document_facts(docs: DataFrame) -> DataFrame:
    """Facts of Markdown or plain documents (source, text): kind, title, sections, content snippets, supersessions.

    A line belongs to the heading above it: a running last value over the lines of
    one document."""
    lines = docs.select("source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1)
    w = Window.partitionBy("source").orderBy("n")
    lines = lines.withColumn("head", F.when(head != "", head))
    lines = lines.withColumn("section", F.last("head", ignorenulls=True).over(w)).withColumn("k", F.count("head").over(w))
    fact = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), "source")
    plain = lines.where(F.col("head").isNull() & (F.length(F.trim("line")) >= LEAST_SNIPPET))
    snippets = plain.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MOST_SNIPPETS)
    return (
        fact(docs, F.col("source"), "IS_A", F.lit("Document"))
        .unionAll(fact(lines.where("head is not null and k = 1"), F.col("source"), "HAS_TITLE", F.col("head")))
        .unionAll(fact(lines.where("head is not null"), F.col("head"), "PART_OF", F.col("source")))
        .unionAll(fact(snippets, F.coalesce("section", "source"), "HAS_CONTENT", F.trim("line")))
        .unionAll(supersessions(lines))
    )


def supersessions(lines: DataFrame) -> DataFrame:
    """``Supersedes: X`` lines: the new decision supersedes X, and X is retired by it; never itself."""
    old = F.regexp_extract("line", r"(?i)\b(?:supersedes|replaces):?\s+([A-Za-z0-9_./-]+)", 1)
    found = lines.select("source", old.alias("old")).where((F.col("old") != "") & (F.col("old") != F.col("source")))
    return found.select(F.col("source").alias("subject"), F.lit("SUPERSEDES").alias("predicate"), F.col("old").alias("object"), "source").unionAll(
        found.select(F.col("old").alias("subject"), F.lit("HAS_STATUS").alias("predicate"), F.concat(F.lit("retired_by_"), "source").alias("object"), "source")
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of HTML pages (source, html): title, headings and links."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    many = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))))
    one = pages.select(F.col("source").alias("subject"), F.lit("HAS_TITLE").alias("predicate"), title.alias("object"), "source").where("object <> ''")
    heads = pages.select(F.col("source").alias("subject"), F.lit("HAS_HEADING").alias("predicate"), many(r"(?is)<h[1-3][^>]*>([^<]*)</h[1-3]>").alias("object"), "source")
    links = pages.select(F.col("source").alias("subject"), F.lit("LINKS_TO").alias("predicate"), many(r'(?i)href="([^"#]+)').alias("object"), "source")
    return one.unionAll(heads).unionAll(links)


def chat_export_facts(turns: DataFrame) -> DataFrame:
    """Metadata of chat exports: one fact of kind and one of message count a conversation."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    subject = F.concat(F.lit("chat:"), "conv_id").alias("subject")
    return n.select(subject, F.lit("IS_A").alias("predicate"), F.lit("ChatExport").alias("object")).unionAll(n.select(subject, F.lit("HAS_MESSAGE_COUNT").alias("predicate"), F.col("n").cast("string").alias("object")))


def sentence_proposals(text: Column, most: int = 50) -> Column:
    """Facts that sentences state in three words, of the first ``most`` sentences (the operator's limit)."""
    sentences = F.slice(F.split(text, r"[.!?\n]+"), 1, most)
    words = F.transform(sentences, lambda s: F.split(F.trim(F.regexp_replace(s, r"^\s*(?i:decision|fact):", "")), r"\s+"))
    return F.filter(words, lambda w: (F.size(w) == 3) & F.forall(w, lambda x: x.rlike(r"^[A-Za-z0-9:_-]{1,128}$")))


def manifest_names(files: DataFrame) -> DataFrame:
    """Package name of manifests (source, text): package.json, Cargo.toml, pyproject.toml, go.mod."""
    name = (
        F.when(F.endswith("source", F.lit("package.json")), F.get_json_object("text", "$.name"))
        .when(F.endswith("source", F.lit("go.mod")), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1))
        .when(F.col("source").rlike(r"(Cargo|pyproject)\.toml$"), F.regexp_extract("text", r'(?ms)^\[(?:package|project)\][^\[]*?^name\s*=\s*"([^"]+)"', 1))
    )
    return files.select("source", name.alias("name")).where("name is not null and name <> ''")


def feed_items(feeds: DataFrame, most: int = 100) -> DataFrame:
    """Items of RSS feeds (source, text): title and digest, one a digest, the first ``most`` of a feed."""
    items = feeds.select("source", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))).alias("n", "item"))
    title = F.trim(F.regexp_replace(F.regexp_extract("item", r"(?is)<title[^>]*>(.*?)</title>", 1), r"<!\[CDATA\[|\]\]>", ""))
    w = Window.partitionBy("source", "hash").orderBy("n")
    rows = items.select("source", "n", title.alias("title"), F.sha2("item", 256).alias("hash")).withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("n"))).where(F.col("place") <= most).select("source", "place", "title", "hash")


def read_ledger(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Delivery ledger in JSON lines, of one workspace."""
    schema = "workspace string, tool string, delivered bigint, baseline bigint, at timestamp, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("workspace") == workspace)).drop("_corrupt_record")


def write_artifacts(rows: DataFrame, path: str) -> None:
    """Content-addressed store: bytes once a digest, in folders by the digest's first two letters."""
    once = rows.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    once.withColumn("part", F.substring("hash", 1, 2)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def broken_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts whose bytes no longer have their digest."""
    return spark.read.parquet(path).where(F.sha2("content", 256) != F.col("hash")).select("hash")
