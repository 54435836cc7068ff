"""Readers of hand-made and provider files, and exports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical column and the spellings it may have in imported files.
ALIASES = {
    "doi": ("doi", "DOI"), "title": ("title", "Title", "paper_title"), "abstract": ("abstract", "Abstract", "summary"), "journal": ("journal", "Journal", "source_title"),
    "pub_date": ("publication_date", "date", "Date", "published"), "authors": ("authors", "Authors", "author"),
}
ARXIV_SCHEMA = "id string, title string, summary string, published timestamp, updated timestamp, author array<struct<name:string>>, category array<struct<_term:string>>"


def _first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns if c in names]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_manual(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """CSV (with header, by name) or JSON records (a list a file, or with ``lines`` a record a line) with any of the known column spellings; dates
    that are none become null."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raw = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    picked = raw.select(*(_first_present(raw, names).alias(c) for c, names in ALIASES.items()))
    return picked.withColumn("pub_date", F.expr("try_to_date(pub_date, 'yyyy-MM-dd')"))


def split_values(value: Column) -> Column:
    """Trimmed parts of a list in one cell; ";" parts if there is one, else ","; later spellings that differ in case only go."""
    parts = F.split(F.coalesce(value, F.lit("")), F.when(F.contains(F.coalesce(value, F.lit("")), F.lit(";")), ";").otherwise(","))
    clean = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def read_tasks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of rows with title, concepts, materials, methods: tags are united, rows without a title rejected."""
    titled = F.length(F.trim(F.coalesce("title", F.lit("")))) > 0
    tags = split_values(F.concat_ws(";", *(F.array_join(split_values(F.col(c)), ";") for c in ("concepts", "materials", "methods"))))
    good = rows.filter(titled).withColumn("tags", F.when(F.size(F.filter(tags, lambda x: x != "")) > 0, tags).otherwise(F.array().cast("array<string>")))
    return good, rows.filter(~titled).withColumn("reason", F.lit("no title"))


def read_arxiv_feed(spark: SparkSession, path: str) -> DataFrame:
    """arxiv_id without version, version, title, abstract, dates, authors, categories of Atom feed files."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ARXIV_SCHEMA).load(path)
    name = F.regexp_extract("id", r"abs/(.+?)(?:v(\d+))?$", 1)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return raw.select(
        name.alias("arxiv_id"), F.nullif(F.regexp_extract("id", r"v(\d+)$", 1), F.lit("")).cast("int").alias("version"), clean("title").alias("title"), clean("summary").alias("abstract"),
        F.to_date("published").alias("submitted_date"), F.to_date("updated").alias("updated_date"), F.col("author.name").alias("authors"), F.col("category._term").alias("categories"),
    )


def write_feed(entries: DataFrame, path: str) -> None:
    """Text files of XML entries (column ``value``), each file with one root."""

    def rooted(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["<feed>"])], ["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</feed>"])], ["value"])

    entries.select("value").mapInArrow(rooted, "value string").write.text(path)


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns in fixed order with a header; quotes are doubled."""
    df.select(*columns).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, is_pdf, copies (files of the same content) of the files below a folder. Empty files, which the source skips, have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
    return rows.join(rows.groupBy("sha256").agg(F.count("*").alias("copies")), "sha256").select("path", "size", "sha256", "is_pdf", "copies")
