"""Readers for the file formats of a knowledge base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.basics import blank_to_null, present
from marginalia.operators import harvest
from marginalia.operators.sources_ledger import LEDGER_DEFAULTS, migrate
from marginalia.sources import vaultfs

# Schemas of the stored files.
COST_SCHEMA = (
    "ts timestamp, date string, vault string, action string, role string, provider string, model string, input_tokens bigint,"
    " output_tokens bigint, cost_usd double, estimated_cost_usd double, source string"
)
CHUNK_SCHEMA = (
    "schema_version int, page_path string, page_address string, chunk_index int, raw_text string, contextualized_text string,"
    " prefix string, prefix_source string, char_count int, body_hash string, page_body_hash string, created_at timestamp"
)
TRANSCRIPT_SCHEMA = (
    "uuid string, attributionSkill string, message struct<role:string,model:string,usage:struct<input_tokens:bigint,"
    "output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
)
REGISTRY_ENTRY = (
    "struct<id:string,name:string,url:string,rss_feed:string,category:string,focus:string,relevance:double,priority:string>"
)
REGISTRY_FILES = {
    "paper-publisher": ("paper-publisher.json", "sources"),
    "blog-newsfeed": ("blog-newsfeed.json", "sources"),
    "github-repos": ("github-repos.json", "repositories"),
}
# End of the fixed values.


def vault_pages(spark: SparkSession, root: str, areas: list[str] | None = None) -> DataFrame:
    """``(path, text, mtime)`` of Markdown pages, hidden names included."""
    vaultfs.register(spark)
    reader = spark.read.format("vaultfs").option("path", root)
    if areas:
        reader = reader.option("areas", ",".join(areas))
    return reader.load()


def index_pages(pages: DataFrame) -> DataFrame:
    """Wiki pages the catalogue lists: no templates, hidden or structural pages."""
    name = F.substring_index("path", "/", -1)
    hidden = F.startswith(name, F.lit("_")) | F.startswith(name, F.lit("."))
    return pages.where(F.startswith("path", F.lit("wiki/")) & ~hidden & ~F.col("path").isin("wiki/index.md", "wiki/hot.md", "wiki/log.md"))


def chunkable_pages(pages: DataFrame) -> DataFrame:
    """Wiki pages the chunker reads: templates too, but nothing below a dot name."""
    return pages.where(F.startswith("path", F.lit("wiki/")) & ~F.rlike("path", F.lit(r"(^|/)\.")))


def chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk JSON files; unreadable ones and those without a place are skipped."""
    read = spark.read.schema(CHUNK_SCHEMA + ", _corrupt string").option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path, recursiveFileLookup=True, pathGlobFilter="chunk-*.json")
    usable = F.col("_corrupt").isNull() & F.col("page_address").isNotNull() & F.col("chunk_index").isNotNull()
    return read.where(usable).drop("_corrupt").withColumn("chunk_id", F.concat_ws(":", "page_address", "chunk_index"))


def cost_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Cost rows of JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(COST_SCHEMA).option("mode", "DROPMALFORMED").json(path).withColumn("date", F.to_date("date"))


def source_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``{"sources": {id: row}}`` document in current form."""
    fields = ", ".join(f"{name}:{kind}" for name, (kind, _) in LEDGER_DEFAULTS.items())
    document = spark.read.text(path, wholetext=True)
    parsed = document.select(F.from_json("value", f"struct<sources:map<string,struct<{fields}>>>").alias("d"))
    rows = parsed.select(F.explode_outer("d.sources").alias("key", "row")).where(present("key")).select("key", "row.*")
    return migrate(rows.withColumn("id", F.coalesce(blank_to_null(F.col("id")), F.col("key"))).drop("key"))


def registry(spark: SparkSession, folder: str, engines: dict[str, str] | None = None) -> DataFrame:
    """Registry entries of the three section files; a broken file has no entries."""
    def section(name: str, file: str, key: str) -> DataFrame:
        document = spark.read.text(f"{folder}/{file}", wholetext=True)
        entries = F.from_json("value", f"struct<{key}:array<{REGISTRY_ENTRY}>>")[key]
        return document.select(F.lit(name).alias("section"), F.posexplode_outer(entries).alias("ord", "e")).where(present("ord")).select(
            "section", F.col("e.id").alias("source_id"), "e.name", "e.url", "e.rss_feed", "e.category", "e.focus",
            F.coalesce("e.relevance", F.lit(0.0)).alias("relevance"), "e.priority", "ord",
        )

    rows = reduce(DataFrame.unionByName, [section(n, f, k) for n, (f, k) in REGISTRY_FILES.items()])
    return rows.withColumn("engine", harvest.paper_engine(F.col("source_id"), F.col("category"), engines or {}))


def transcript(spark: SparkSession, path: str, order: str = "position") -> DataFrame:
    """Messages of session transcripts, one JSON object per line.

    The line number inside its file is the position; the file name the session.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("session_id"),
        F.posexplode_outer(F.split("value", "\n")).alias(order, "line"),
    ).where(present(order))
    return transcript_messages(lines, order)


def transcript_messages(lines: DataFrame, order: str = "position") -> DataFrame:
    """Messages of ``lines(session_id, position, line)``."""
    m = F.from_json("line", TRANSCRIPT_SCHEMA)
    read = lines.select("session_id", F.col(order).cast("bigint").alias("position"), m.alias("m")).where("m is not null")
    return read.select(
        "session_id",
        F.coalesce("m.uuid", F.lit("")).alias("uuid"),
        "position",
        F.col("m.message.role").alias("role"),
        F.col("m.attributionSkill").alias("skill"),
        F.col("m.message.model").alias("model"),
        F.col("m.message.usage.input_tokens").alias("input_tokens"),
        F.coalesce("m.message.usage.output_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("m.message.usage.cache_read_input_tokens", F.lit(0)).alias("cache_read_tokens"),
        F.coalesce("m.message.usage.cache_creation_input_tokens", F.lit(0)).alias("cache_create_tokens"),
    )


def feed_entries(spark: SparkSession, path: str, source_id: str, row_tag: str = "entry") -> DataFrame:
    """Entries of Atom (``entry``) or RSS (``item``) files."""
    if row_tag == "entry":
        schema = "title string, link struct<_href:string>, published string, updated string, summary string, content string"
        link: Column = F.col("link._href")
        summary = F.coalesce("summary", "content", F.lit(""))
        when, then = F.col("published"), F.col("updated")
    else:
        schema = "title string, link string, pubDate string, description string"
        link, summary = F.col("link"), F.coalesce("description", F.lit(""))
        parsed = F.try_to_timestamp("pubDate", F.lit("EEE, d MMM yyyy HH:mm:ss z"))
        when, then = F.date_format(parsed, "yyyy-MM-dd"), F.lit(None).cast("string")
    read = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return read.select(
        F.lit(source_id).alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), link.alias("link"),
        when.alias("published"), then.alias("updated"), summary.alias("summary"),
    )


def arxiv_results(spark: SparkSession, path: str) -> DataFrame:
    """Paper results of stored Atom answers."""
    schema = "id string, title string, summary string, published string, doi string"
    read = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return read.select(
        squeeze("title").alias("title"), F.regexp_replace("id", "^http://", "https://").alias("url"),
        squeeze("summary").alias("abstract"), F.substring("published", 1, 10).alias("published"), "doi",
    )


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of raw source files by suffix, assets left out."""
    from marginalia.operators.sources_ledger import scannable

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/raw")
    rel = F.regexp_extract("path", r"(raw/.*)$", 1)
    return read.select(rel.alias("path"), "content").where(scannable(F.col("path")))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
