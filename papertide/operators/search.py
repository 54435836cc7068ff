"""A fielded text index in pruned folders, and paper search compiled from a record of filters."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.operators.entities import tokens, word_positions

#: Fields of a scope: all, or those that hold metadata or the full text.
SCOPES = {"all": ("title", "abstract", "body"), "metadata": ("title", "abstract"), "fulltext": ("body",)}

#: Documents whose postings of a bucket and field one task writes.
DOCS_A_PART = 250_000


def words_of_query(query: str) -> list[str]:
    """Distinct lower-case words of letters and digits."""
    return sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query).lower().split()})


def field_postings(docs: DataFrame, fields: tuple[str, ...] = SCOPES["all"]) -> DataFrame:
    """doc_id, field, token, tf, length (words of all fields of the document)."""
    worded = docs.select("doc_id", *(tokens(F.col(f)).alias(f) for f in fields))
    sized = worded.withColumn("length", reduce(Column.__add__, [F.size(f) for f in fields]))
    # words are counted within the row: a shuffle of all words would follow the text
    counts = lambda f: F.transform(F.map_entries(word_positions(F.col(f))), lambda e: F.struct(F.lit(f).alias("field"), e["key"].alias("token"), F.size(e["value"]).cast("long").alias("tf")))
    parts = sized.select("doc_id", "length", F.inline(F.flatten(F.array(*(counts(f) for f in fields)))))
    return parts.select("doc_id", "length", "field", "token", "tf")


class TextIndex:
    """Postings at ``path`` in folders by version, bucket of the token and field, so that a query opens the buckets of its words and the fields of its scope only.

    A version holds the documents that it brings; ``live`` says which version of a document counts, so an update writes its own postings and
    no others. Documents without words have no postings but count for the mean length.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def add(self, docs: DataFrame, version: int, fields: tuple[str, ...] = SCOPES["all"]) -> None:
        """Indexes ``docs`` (doc_id and the fields) as ``version``: 0 for the first, then 1, 2, .. A version that is written again is replaced."""
        bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(self.buckets)).cast("int")
        rows = field_postings(docs, fields).withColumn("bucket", bucket)
        # the postings of a frequent word are dealt to several tasks, whose number follows the documents
        parts = -(-docs.count() // DOCS_A_PART)
        tasks = max(self.spark.sparkContext.defaultParallelism, 2 * parts)
        rows.repartition(tasks, "bucket", "field", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).write.mode("overwrite").partitionBy("bucket", "field").parquet(f"{self.path}/postings/version={version}")
        own = docs.select("doc_id", reduce(Column.__add__, [F.size(tokens(F.col(f))) for f in fields]).cast("long").alias("length"), F.lit(version).alias("version"))
        if version:
            old = self.live(version - 1)
            own = old.join(own.select("doc_id"), "doc_id", "left_anti").select("doc_id", "length", "version").unionByName(own)
        own.write.mode("overwrite").parquet(f"{self.path}/live/{version}")

    def live(self, version: int) -> DataFrame:
        return self.spark.read.schema("doc_id long, length long, version int").parquet(f"{self.path}/live/{version}")

    def postings(self, words: list[str], scope: str, version: int) -> DataFrame:
        """The postings of ``words`` in the fields of ``scope``, as of ``version``."""
        schema = "doc_id long, length int, token string, tf long, version int, bucket int, field string"
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings/version=*")
        numbers = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return found.filter((F.col("version") <= version) & F.col("bucket").isin(numbers) & F.col("field").isin(*SCOPES[scope]) & F.col("token").isin(words))

    def search(self, query: str, scope: str = "all", version: int = 0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """doc_id, score (BM25, higher is nearer) of the documents that hold every word of ``query`` in a field of ``scope``. A query without words finds nothing."""
        words = words_of_query(query)
        if not words:
            return self.spark.createDataFrame([], "doc_id long, score double")
        live = self.live(version)
        totals = live.filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        hits = self.postings(words, scope, version).join(live.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        hits = hits.groupBy("doc_id", "token").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        df = F.broadcast(hits.groupBy("token").agg(F.count("*").alias("df")))  # a row for each word of the query
        scored = hits.join(df, "token").crossJoin(F.broadcast(totals))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return scored.groupBy("doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("_found")).filter(F.col("_found") == len(words)).drop("_found")


@dataclass(frozen=True)
class PaperFilter:
    """What is asked for; entries left empty ask for nothing."""

    q: str = ""
    scope: str = "all"
    author: str = ""
    topic: str = ""
    material: str = ""
    journal: str = ""
    version_type: str = ""
    year_from: int | None = None
    year_to: int | None = None
    pdf_status: str = ""
    open_access: bool = False
    review: bool = False
    favorite: bool = False
    reading_status: str = ""
    collection: str = ""


def _part(c: str, value: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(value.strip().lower()))


def _rules(wanted: PaperFilter) -> tuple[list[Column], list[tuple[str, str, Column, bool]]]:
    """What ``wanted`` asks of a version itself, and of which side tables: name, key, rule of their rows, and whether a row must be there or none may be."""
    own, among = [], []
    if wanted.journal.strip():
        own.append(_part("journal", wanted.journal))
    if wanted.version_type == "preprint":
        own.append(F.col("version_type") == "preprint")
    elif wanted.version_type == "publication":
        own.append(F.col("version_type").isin("publication", "published"))
    if wanted.year_from is not None:
        own.append(F.col("year") >= wanted.year_from)
    if wanted.year_to is not None:
        own.append(F.col("year") <= wanted.year_to)
    if wanted.open_access:
        own.append(F.col("is_open_access"))
    if wanted.author.strip():
        among.append(("authors", "version_id", _part("name", wanted.author), True))
    if wanted.topic.strip():
        among.append(("topics", "paper_id", _part("name", wanted.topic), True))
    if wanted.material.strip():
        among.append(("materials", "paper_id", _part("name", wanted.material), True))
    if wanted.pdf_status in ("downloaded", "missing"):
        among.append(("files", "paper_id", F.lit(True), wanted.pdf_status == "downloaded"))
    elif wanted.pdf_status in ("pending", "retryable_failed", "permanent_failed", "downloading"):
        among.append(("tasks", "paper_id", F.col("status") == wanted.pdf_status, True))
    elif wanted.pdf_status == "failed":
        among.append(("tasks", "paper_id", F.col("status").isin("retryable_failed", "permanent_failed"), True))
    if wanted.review:
        among.append(("reviews", "paper_id", F.col("status") == "pending", True))
    if wanted.favorite:
        among.append(("states", "paper_id", F.col("favorite"), True))
    if wanted.reading_status:
        among.append(("states", "paper_id", F.col("reading_status") == wanted.reading_status, True))
    if wanted.collection:
        among.append(("collections", "paper_id", F.col("collection_id") == wanted.collection, True))
    return own, among


#: Real papers of the main view.
_SHOWN = "data_mode = 'real' and coalesce(view_eligible, false)"


def search_papers(versions: DataFrame, side: dict[str, DataFrame], wanted: PaperFilter, hits: DataFrame | None = None) -> DataFrame:
    """The versions (version_id, paper_id, version_type, journal, year, data_mode, view_eligible, is_open_access) that pass, with ``score``.

    Real papers of the main view only. Each entry of ``wanted`` adds a filter, or a semi-join with one table of ``side`` (authors: version_id, name; topics and materials: paper_id,
    name; files: paper_id; tasks and reviews: paper_id, status; states: paper_id, favorite, reading_status; collections: paper_id, collection_id); what is not asked for
    is not read. ``hits`` (doc_id: version_id, score) are the text search's, 0 without one. Names and journals match as lower-case substrings.
    """
    rows = versions.filter(_SHOWN)
    own, among = _rules(wanted)
    for rule in own:
        rows = rows.filter(rule)
    for name, key, rule, held in among:
        rows = rows.join(side[name].filter(rule).select(key), key, "left_semi" if held else "left_anti")
    if not wanted.q.strip():
        return rows.withColumn("score", F.lit(0.0))
    if hits is None:
        raise ValueError("a text search needs the hits of an index")
    return rows.join(hits.select(F.col("doc_id").alias("version_id"), "score"), "version_id")


def count_papers(versions: DataFrame, side: dict[str, DataFrame], asked: dict[str, PaperFilter], hits: dict[str, DataFrame]) -> DataFrame:
    """asked, versions, papers: how many versions and papers ``search_papers`` finds for each of several filters, with the ``hits`` (version_id, or paper_id where papers' texts are searched) of those that have a text.

    All filters share one look at each table: the rules on a side table become marks of its keys, the marks of a key are gathered once, and versions meet them
    once by version and once by paper.
    """
    marks: dict[str, list[tuple[DataFrame, dict[str, Column]]]] = {"version_id": [], "paper_id": []}
    tables: dict[tuple[str, str], dict[str, Column]] = {}
    passed: dict[str, list[Column]] = {}

    def marked(name: str, key: str, rule: Column) -> Column:
        mark = tables.setdefault((name, key), {})
        column = next((c for c, r in mark.items() if str(r) == str(rule)), f"_{name}_{len(mark)}")
        mark[column] = rule
        return F.coalesce(F.col(column), F.lit(False))

    for name, wanted in asked.items():
        own, among = _rules(wanted)
        passed[name] = [F.coalesce(c, F.lit(False)) for c in own] + [m if held else ~m for m, held in ((marked(t, key, rule), held) for t, key, rule, held in among)]
        if wanted.q.strip():
            column, key = f"_hit_{len(passed)}", next(k for k in marks if k in hits[name].columns)
            marks[key].append((hits[name].select(key), {column: F.lit(True)}))
            passed[name].append(F.coalesce(F.col(column), F.lit(False)))
    for (name, key), rules in tables.items():
        marks[key].append((side[name].filter(reduce(Column.__or__, rules.values())), rules))
    rows = versions.filter(_SHOWN)
    for key, found in marks.items():
        if found:
            columns = [c for _, rules in found for c in rules]
            parts = [df.select(key, *((rules[c] if c in rules else F.lit(None).cast("boolean")).alias(c) for c in columns)) for df, rules in found]
            rows = rows.join(reduce(DataFrame.unionByName, parts).groupBy(key).agg(*(F.bool_or(c).alias(c) for c in columns)), key, "left")
    names = list(asked)
    by_paper = rows.groupBy("paper_id").agg(*(F.count_if(reduce(Column.__and__, passed[n], F.lit(True))).alias(f"n{i}") for i, n in enumerate(names)))
    total = by_paper.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))), *(F.count_if((F.col(f"n{i}") > 0) & F.col("paper_id").isNotNull()).alias(f"p{i}") for i in range(len(names))))
    return total.select(F.inline(F.array(*(F.struct(F.lit(n).alias("asked"), F.coalesce(f"n{i}", F.lit(0)).alias("versions"), F.col(f"p{i}").alias("papers")) for i, n in enumerate(names)))))
