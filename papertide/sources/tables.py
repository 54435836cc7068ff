"""The corpus tables as views over star-schema Parquet tables, and their SQL text.

papers (orders), versions (line items), terms (parts of the ordered items), journals (fixed weights),
docs (documents) and attempts (events) stand for a bibliographic corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Journal, class, weight; the preprint server weighs 1 and unknown journals 1.5.
JOURNALS = (("Journal A", "core", 5.0), ("Journal B", "core", 3.0), ("Journal C", "context", 2.0), ("arXiv", "preprint", 1.0))
UNKNOWN_WEIGHT = 1.5


#: Rows of line items that one task groups.
ROWS_A_TASK = 250_000
#: Line items that pass one task's parts in a join.
ITEMS_A_JOIN = 1_000_000


def dealt(rows: DataFrame, key: str, n: int, most: int = ROWS_A_TASK) -> DataFrame:
    """``rows``, made of ``n`` rows of a table, dealt by ``key``. The number of parts follows n: parts whose number the engine chooses are merged by the size of compressed
    rows, so what a task groups would grow with the input."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most)), key)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col
    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(
        o("o_orderkey").cast("string").alias("paper_id"),
        F.when(o("o_orderkey") % 5 != 0, F.concat(F.lit("10.1000/"), o("o_orderkey").cast("string"))).alias("doi"),
        F.when(o("o_orderkey") % 7 != 0, F.concat(F.lit("abstract "), o("o_orderpriority"))).otherwise("").alias("abstract"),
        F.when(o("o_orderpriority") == "1-URGENT", "Journal A").when(o("o_orderpriority") == "2-HIGH", "Journal B")
        .when(o("o_orderpriority") == "3-MEDIUM", "Journal C").when(o("o_orderpriority") == "4-NOT SPECIFIED", "Journal D").otherwise("arXiv").alias("journal"),
        day.alias("pub_date"),
        F.date_format(day, "yyyy-MM").alias("month"),
        F.year(day).alias("year"),
        F.when(o("o_orderstatus") == "F", "openalex").when(o("o_orderstatus") == "O", "crossref").otherwise("arxiv").alias("source"),
        F.when((o("o_orderpriority") == "5-LOW") | (o("o_orderstatus") == "P"), "preprint").otherwise("published").alias("source_scope"),
        F.when(o("o_custkey") % 10 == 0, "mock").otherwise("real").alias("data_mode"),
        F.when(o("o_custkey") % 4 == 0, "low").when(o("o_custkey") % 4 == 2, "high").otherwise("medium").alias("confidence"),
        (o("o_orderkey") % 4 != 0).alias("view_eligible"),
        (o("o_custkey") % 3 == 0).alias("is_open_access"),
        F.floor(o("o_totalprice") / 10000).cast("int").alias("cited_by_count"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows; dealt by paper, which serves the distinct and the joins on the paper with one shuffle. Columns are dealt as they are read; ids and dates are made where they are dealt to."""
    l, day = F.col, F.col("l_shipdate").cast("date")
    items = read(spark, sf_dir, "lineitem")
    raw = items.select(l("l_orderkey").cast("string").alias("canonical_paper_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    return dealt(raw, "canonical_paper_id", items.count()).select(
        F.concat_ws("-", "canonical_paper_id", "l_linenumber", "l_partkey", "l_suppkey").alias("version_id"),
        "canonical_paper_id",
        F.when(l("l_returnflag") == "N", "published").when(l("l_returnflag") == "R", "preprint").otherwise("metadata").alias("version_type"),
        F.when(l("l_returnflag") != "R", day).alias("publication_date"),
        F.when(l("l_returnflag") == "R", day).alias("submitted_date"),
        F.when(l("l_suppkey") % 4 == 0, "openalex").when(l("l_suppkey") % 4 == 1, "crossref").when(l("l_suppkey") % 4 == 2, "arxiv").otherwise("legacy").alias("source"),
    ).distinct()


def of_papers(spark: SparkSession, sf_dir: str, parts: DataFrame, *columns: str) -> DataFrame:
    """The line items' ``columns`` and ``parts`` (p_partkey and more) with paper_id, dealt by paper. Parts of more rows than one task groups are dealt with their line items, which pass by them unsorted;
    left to the engine, the join's tasks would be as many at any size, each sort a share of all items and hold it once more for the next shuffle."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *columns)
    n = items.count()
    if read(spark, sf_dir, "part").count() > ROWS_A_TASK:
        items, parts = dealt(items, "l_partkey", n, ITEMS_A_JOIN), dealt(parts, "p_partkey", n, ITEMS_A_JOIN).hint("shuffle_hash")
    rows = items.join(parts, items.l_partkey == parts.p_partkey).withColumn("paper_id", F.col("l_orderkey").cast("string"))
    return dealt(rows.drop("l_orderkey", "l_partkey", "p_partkey"), "paper_id", n)


def kinds() -> Column:
    """A row for each of a part's three terms: term_type, normalized_term."""
    return F.explode(F.array(*(F.struct(F.lit(t).alias("term_type"), F.col(c).alias("normalized_term")) for t, c in (("concept", "p_name"), ("material", "p_brand"), ("method", "p_type")))))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the join; the three kinds of term come from one row each. Rows are dealt by paper before they become
    three, which serves the grouping and later joins on the paper."""
    joined = of_papers(spark, sf_dir, read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "l_discount")
    rows = joined.select("paper_id", kinds().alias("k"), (1 - F.col("l_discount") * 5).alias("confidence"), F.when(F.col("p_size") % 5 != 0, 1).otherwise(0).alias("elig"))
    return rows.groupBy("paper_id", F.col("k.term_type").alias("term_type"), F.col("k.normalized_term").alias("normalized_term")).agg(
        F.max("confidence").alias("confidence"), F.max("elig").alias("display_eligible")
    )


def journals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JOURNALS, "name string, bucket string, weight double")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.split_part("text", F.lit(". "), F.lit(1)).alias("title"), F.col("text").alias("abstract"), "lang", "source",
        F.expr("date_add(date'2015-01-01', cast(doc_id % 3650 as int))").alias("pub_date"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("task_id"),
        F.expr("row_number() over (partition by user_id order by ts, event_id)").alias("attempt_number"),
        kind.alias("candidate_source"),
        F.when((kind == "error") | (value < 20), "failed").otherwise("completed").alias("status"),
        F.when(kind == "error", "http_server_error").when(value < 10, "request_timeout").when(value < 20, "access_denied").alias("failure_class"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


PAPERS_SQL = """papers_v AS (SELECT CAST(o_orderkey AS VARCHAR) AS paper_id,
 CASE WHEN o_orderkey % 5 <> 0 THEN concat('10.1000/', CAST(o_orderkey AS VARCHAR)) END AS doi,
 CASE WHEN o_orderkey % 7 <> 0 THEN concat('abstract ', o_orderpriority) ELSE '' END AS abstract,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Journal A' WHEN '2-HIGH' THEN 'Journal B' WHEN '3-MEDIUM' THEN 'Journal C' WHEN '4-NOT SPECIFIED' THEN 'Journal D' ELSE 'arXiv' END AS journal,
 CAST(o_orderdate AS DATE) AS pub_date, substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
 CASE o_orderstatus WHEN 'F' THEN 'openalex' WHEN 'O' THEN 'crossref' ELSE 'arxiv' END AS source,
 CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN 'preprint' ELSE 'published' END AS source_scope,
 CASE WHEN o_custkey % 10 = 0 THEN 'mock' ELSE 'real' END AS data_mode,
 CASE o_custkey % 4 WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS confidence,
 (o_orderkey % 4 <> 0) AS view_eligible, (o_custkey % 3 = 0) AS is_open_access, CAST(floor(o_totalprice / 10000) AS INTEGER) AS cited_by_count FROM orders)"""
VERSIONS_SQL = """versions_v AS (SELECT DISTINCT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS version_id,
 CAST(l_orderkey AS VARCHAR) AS canonical_paper_id, CASE l_returnflag WHEN 'N' THEN 'published' WHEN 'R' THEN 'preprint' ELSE 'metadata' END AS version_type,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS publication_date, CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END AS submitted_date,
 CASE l_suppkey % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' WHEN 2 THEN 'arxiv' ELSE 'legacy' END AS source FROM lineitem)"""
TERMS_SQL = """terms_v AS (SELECT paper_id, term_type, normalized_term, max(confidence) AS confidence, max(elig) AS display_eligible FROM (
 SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, k.term_type, k.term AS normalized_term, 1 - l_discount * 5 AS confidence, CASE WHEN p_size % 5 <> 0 THEN 1 ELSE 0 END AS elig
 FROM lineitem JOIN part ON l_partkey = p_partkey,
 LATERAL (SELECT unnest([{'term_type': 'concept', 'term': p_name}, {'term_type': 'material', 'term': p_brand}, {'term_type': 'method', 'term': p_type}]) AS k) x)
 GROUP BY paper_id, term_type, normalized_term)"""
JOURNALS_SQL = "journals_v(name, bucket, weight) AS (VALUES ('Journal A', 'core', CAST(5.0 AS DOUBLE)), ('Journal B', 'core', 3.0), ('Journal C', 'context', 2.0), ('arXiv', 'preprint', 1.0))"
DOCS_SQL = "docs_v AS (SELECT doc_id, split_part(text, '. ', 1) AS title, text AS abstract, lang, source, date '2015-01-01' + CAST(doc_id % 3650 AS INTEGER) AS pub_date FROM documents)"
ATTEMPTS_SQL = """attempts_v AS (SELECT event_id, CAST(user_id AS VARCHAR) AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_number,
 event_type AS candidate_source, CASE WHEN event_type = 'error' OR value < 20 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN event_type = 'error' THEN 'http_server_error' WHEN value < 10 THEN 'request_timeout' WHEN value < 20 THEN 'access_denied' END AS failure_class, ts FROM events)"""
#: A title without accents, other signs beyond ASCII, markup and punctuation.
FOLDED_TITLE = r"nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(title, '')), '[^\x00-\x7F]', '', 'g')), '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
