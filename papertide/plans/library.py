"""Queries on library upkeep, and readers and exports of files that hold the given tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import library as op
from papertide.plans.registry import query
from papertide.sources import files
from papertide.sources import tables as t
from papertide.sources.scratch import shared_path

KEY = "CAST(paper_id AS BIGINT)"


@query("link_entities", f"WITH {t.TERMS_SQL}, m AS (SELECT DISTINCT upper(p_brand) AS name, md5(p_brand) AS id FROM part WHERE p_partkey % 3 <> 0), l AS (SELECT paper_id, 'material' AS kind, id AS entity_id, confidence FROM terms_v JOIN m ON lower(normalized_term) = lower(name) WHERE term_type = 'material' UNION ALL SELECT paper_id, 'topic', md5(concat(term_type, ':', lower(normalized_term))), confidence FROM terms_v WHERE term_type <> 'material') SELECT kind, entity_id, count(DISTINCT paper_id) AS papers, max(confidence) AS confidence FROM l GROUP BY 1, 2")
def link_entities(spark, d):
    materials = t.read(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.md5(F.col("p_brand").cast("binary")).alias("material_id"), F.upper("p_brand").alias("name")).distinct()
    return op.link_entities(t.terms(spark, d), materials).groupBy("kind", "entity_id").agg(F.count("*").alias("papers"), F.max("confidence").alias("confidence"))


_IDS = f"{t.PAPERS_SQL}, ids_v AS (SELECT *, CASE WHEN {KEY} % 6 = 1 THEN concat('Cond-Mat/', paper_id) END AS arxiv_id, CASE WHEN {KEY} % 2 = 0 THEN concat('https://openalex.org/W', paper_id) END AS openalex_id FROM papers_v)"


def with_ids(spark, d):
    key = F.col("paper_id").cast("long")
    return t.papers(spark, d).withColumns({"arxiv_id": F.when(key % 6 == 1, F.concat(F.lit("Cond-Mat/"), "paper_id")), "openalex_id": F.when(key % 2 == 0, F.concat(F.lit("https://openalex.org/W"), "paper_id"))})


@query("seed_versions", f"""WITH {_IDS} SELECT concat('source-version:', lower(source), ':', paper_id) AS version_id, paper_id, CASE WHEN lower(source) = 'arxiv' OR (arxiv_id IS NOT NULL AND doi IS NULL) THEN 'preprint' WHEN doi IS NOT NULL THEN 'published' ELSE 'metadata' END AS version_type, lower(source) AS source,
 CASE WHEN source = 'openalex' AND openalex_id IS NOT NULL THEN lower(openalex_id) WHEN source = 'arxiv' AND arxiv_id IS NOT NULL THEN lower(arxiv_id) WHEN doi IS NOT NULL THEN lower(doi) ELSE paper_id END AS record_id FROM ids_v WHERE data_mode = 'real' AND NOT (source = 'openalex' AND {KEY} % 4 = 0)""")
def seed_versions(spark, d):
    existing = with_ids(spark, d).filter("source = 'openalex' and cast(paper_id as bigint) % 4 = 0").select(F.concat(F.lit("source-version:openalex:"), "paper_id").alias("version_id"))
    return op.seed_versions(with_ids(spark, d), existing)


@query("enrich_papers", f"""WITH {_IDS}, w AS (SELECT *, concat('https://openalex.org/V', paper_id) AS oa, list_distinct([concat('inst', CAST({KEY} % 3 AS VARCHAR)), concat('inst', CAST({KEY} % 5 AS VARCHAR)), concat('inst', CAST({KEY} % 3 AS VARCHAR)), concat('inst', CAST({KEY} % 2 AS VARCHAR))]) AS i FROM ids_v WHERE doi IS NOT NULL AND {KEY} % 3 <> 0)
SELECT p.paper_id, p.doi, coalesce(nullif(CASE WHEN {KEY.replace('paper_id', 'w.paper_id')} % 7 = 0 THEN '' ELSE w.oa END, ''), p.openalex_id) AS openalex_id, p.is_open_access OR coalesce({KEY.replace('paper_id', 'w.paper_id')} % 11 = 0 OR {KEY.replace('paper_id', 'w.paper_id')} % 13 = 0, false) AS is_open_access, greatest(p.cited_by_count, coalesce(CAST({KEY.replace('paper_id', 'w.paper_id')} % 50 AS INTEGER), 0)) AS cited_by_count,
 CASE WHEN w.paper_id IS NOT NULL THEN CAST(len(w.i) AS INTEGER) END AS institutions, CASE WHEN w.paper_id IS NOT NULL THEN concat('inst', CAST({KEY.replace('paper_id', 'w.paper_id')} % 3 AS VARCHAR)) END AS first_institution, w.paper_id IS NOT NULL AS enriched FROM ids_v p LEFT JOIN w ON w.doi = p.doi""")
def enrich_papers(spark, d):
    papers, key = with_ids(spark, d), F.col("paper_id").cast("long")
    inst = lambda n: F.concat(F.lit("inst"), (key % n).cast("string"))
    works = papers.filter((key % 3 != 0) & F.col("doi").isNotNull()).select(
        "doi", F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("https://openalex.org/V"), "paper_id")).alias("openalex_id"), (key % 11 == 0).alias("is_open_access"), F.when(key % 13 == 0, "http://x/y.pdf").alias("pdf_url"),
        (key % 50).cast("int").alias("cited_by_count"), F.array(F.array(inst(3), inst(5)), F.array(inst(3), inst(2))).alias("authorships"),
    )
    found = op.enrich_papers(papers, works)
    return found.select("paper_id", "doi", "openalex_id", "is_open_access", "cited_by_count", F.when(F.col("enriched"), F.size("institutions")).alias("institutions"), F.get("institutions", F.lit(0)).alias("first_institution"), "enriched")


@query("enrich_candidates", f"WITH {_IDS} SELECT paper_id, doi, pub_date FROM ids_v WHERE data_mode = 'real' AND openalex_id IS NULL AND {KEY} % 9 <> 0 ORDER BY doi IS NULL, pub_date DESC, paper_id LIMIT 100")
def enrich_candidates(spark, d):
    papers = with_ids(spark, d)
    return op.enrich_candidates(papers, papers.filter("cast(paper_id as bigint) % 9 = 0"), 100)


_SCHOOLS, _JOURNALS = ["FRANCE", "CHINA"], ["1-URGENT", "2-HIGH"]
_ONE = lambda k, j: f"""count(*) FILTER (i{k} AND journal = '{_JOURNALS[j]}') AS s{k}_j{j}_participation, count(*) FILTER (l{k} AND journal = '{_JOURNALS[j]}') AS s{k}_j{j}_corresponding_explicit, count(*) FILTER (i{k} AND NOT l{k} AND (NOT any OR blank) AND journal = '{_JOURNALS[j]}') AS s{k}_j{j}_unknown"""


@query("institution_audit", f"""WITH a AS (SELECT l_orderkey AS work_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS journal, CASE WHEN l_suppkey % 7 <> 0 THEN n_name END AS institution, l_linenumber = 1 AND l_orderkey % 4 <> 0 AS lead FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
w AS (SELECT work_id, year, journal, bool_or(coalesce(institution = 'FRANCE', false)) AS i0, bool_or(coalesce(institution = 'CHINA', false)) AS i1, bool_or(lead AND coalesce(institution = 'FRANCE', false)) AS l0, bool_or(lead AND coalesce(institution = 'CHINA', false)) AS l1, bool_or(lead) AS any, bool_or(lead AND institution IS NULL) AS blank FROM a GROUP BY 1, 2, 3)
SELECT year, {", ".join(_ONE(k, j) for k in (0, 1) for j in (0, 1))} FROM w GROUP BY 1""".replace(" any ", " anyone ").replace("AS any,", "AS anyone,").replace("NOT any OR", "NOT anyone OR"))
def institution_audit(spark, d):
    l, o, s, n = (t.read(spark, d, x) for x in ("lineitem", "orders", "supplier", "nation"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("l_orderkey").alias("work_id"), F.year(F.col("o_orderdate").cast("date")).alias("year"), F.col("o_orderpriority").alias("journal"), F.when(F.col("l_suppkey") % 7 != 0, F.col("n_name")).alias("institution"),
        ((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 4 != 0)).alias("is_corresponding"),
    )
    return op.institution_audit(rows, _SCHOOLS, _JOURNALS)


@query("brief_evidence", f"""WITH {t.PAPERS_SQL}, {t.VERSIONS_SQL}, {t.TERMS_SQL}, v AS (SELECT canonical_paper_id AS paper_id, max((coalesce(publication_date, submitted_date), version_id)) AS v FROM versions_v GROUP BY 1), r AS (SELECT p.paper_id, coalesce(v[1], pub_date) AS evidence_date, cited_by_count, v[2] AS version_id FROM papers_v p LEFT JOIN v USING (paper_id) WHERE data_mode = 'real' AND view_eligible),
c AS (SELECT * FROM r WHERE evidence_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' ORDER BY evidence_date DESC, cited_by_count DESC, paper_id LIMIT 50), n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, term_type ORDER BY confidence DESC, normalized_term) AS n FROM terms_v SEMI JOIN c USING (paper_id))
SELECT c.*, coalesce((SELECT string_agg(normalized_term, '|' ORDER BY n) FROM n WHERE n.paper_id = c.paper_id AND term_type = 'material' AND n <= 16), '') AS materials, coalesce((SELECT string_agg(normalized_term, '|' ORDER BY n) FROM n WHERE n.paper_id = c.paper_id AND term_type = 'concept' AND n <= 16), '') AS topics FROM c""")
def brief_evidence(spark, d):
    return op.brief_evidence(t.papers(spark, d), t.versions(spark, d), t.terms(spark, d), "1998-06-01", "1998-06-30", 50)


_CHUNKS = "c AS (SELECT concat('run', CAST(user_id % 5 AS VARCHAR)) AS run_id, CASE event_type WHEN 'view' THEN 'finished' WHEN 'signup' THEN 'running' WHEN 'click' THEN NULL WHEN 'error' THEN 'failed' ELSE 'odd' END AS status FROM events), k AS (SELECT run_id, CASE WHEN status = 'finished' THEN 'completed' ELSE coalesce(status, 'pending') END AS status FROM c)"


@query("chunk_status", f"WITH {_CHUNKS}, n AS (SELECT run_id, status, count(*) AS chunks FROM k WHERE status <> 'odd' GROUP BY 1, 2 UNION ALL SELECT run_id, 'total', count(*) FROM k GROUP BY 1) SELECT run_id, status, chunks FROM n UNION ALL SELECT NULL, status, CAST(sum(chunks) AS BIGINT) FROM n GROUP BY 2")
def chunk_status(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "finished").when(kind == "signup", "running").when(kind == "error", "failed").when(kind != "click", "odd")
    return op.chunk_status(t.read(spark, d, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run_id"), status.alias("status")))


@query("receipt_state", """WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'receipt_missing' WHEN page_id % 11 = 0 THEN 'receipt_invalid' WHEN page_id % 7 = 0 THEN 'receipt_schema_mismatch' WHEN page_id % 13 = 0 THEN 'source_unreadable' WHEN page_id % 3 = 0 THEN 'source_changed' ELSE 'imported' END AS state FROM pages) SELECT CAST(page_id AS VARCHAR) AS path, state, CASE WHEN state NOT IN ('receipt_missing', 'receipt_invalid') AND page_id % 2 = 0 THEN '2024-01-02' END AS imported_at FROM r""")
def receipt_state(spark, d):
    i, digest = F.col("page_id"), F.sha2(F.col("html"), 256)
    pages = t.read(spark, d, "pages").select(i, digest.alias("sha256"))
    receipt = F.to_json(F.struct(F.when(i % 7 == 0, 9).otherwise(op.RECEIPT_SCHEMA).alias("schema_version"), F.when(i % 3 == 0, "other").otherwise(F.col("sha256")).alias("source_sha256"), F.when(i % 2 == 0, "2024-01-02").otherwise(" ").alias("imported_at")))
    receipts = pages.filter(i % 5 != 0).select(i.cast("string").alias("path"), F.when(i % 11 == 0, "{broken").otherwise(receipt).alias("json"))
    return op.receipt_state(pages.select(i.cast("string").alias("path"), F.when(i % 13 != 0, F.col("sha256")).alias("sha256")), receipts)


@query("backfill_candidates", f"""WITH {t.PAPERS_SQL}, {t.VERSIONS_SQL}, x AS (SELECT paper_id, pub_date + 30 AS last_attempt, pub_date + 400 AS next_attempt FROM papers_v WHERE {KEY} % 2 = 0) SELECT p.paper_id, last_attempt FROM papers_v p LEFT JOIN x USING (paper_id) WHERE data_mode = 'real' AND view_eligible AND trim(abstract) = '' AND p.paper_id NOT IN (SELECT canonical_paper_id FROM versions_v WHERE source = 'crossref') AND (next_attempt IS NULL OR next_attempt <= DATE '1998-01-01') ORDER BY last_attempt IS NOT NULL, last_attempt, pub_date DESC, cited_by_count DESC, p.paper_id LIMIT 200""")
def backfill_candidates(spark, d):
    papers = t.papers(spark, d)
    tries = papers.filter("cast(paper_id as bigint) % 2 = 0").select("paper_id", F.date_add("pub_date", 30).alias("last_attempt"), F.date_add("pub_date", 400).alias("next_attempt"))
    told = t.versions(spark, d).select("canonical_paper_id", F.when(F.col("source") == "crossref", "told").alias("abstract"))
    return op.backfill_candidates(papers, told, tries, "1998-01-01", 200)


@query("preferred_versions", f"""WITH {t.VERSIONS_SQL}, v AS (SELECT *, length(version_id) % 2 = 0 AS told, version_type = 'published' AS pub, version_type = 'published' AND length(version_id) % 3 <> 0 AS has_doi FROM versions_v)
SELECT canonical_paper_id, coalesce(min(version_id) FILTER (source <> 'legacy' AND told), min(version_id) FILTER (source <> 'legacy'), min(version_id) FILTER (told), min(version_id)) AS listed, arg_min(version_id, (source = 'legacy', NOT told, NOT pub, -epoch(coalesce(publication_date, submitted_date)), version_id)) AS detailed, arg_max(version_id, (pub, has_doi, coalesce(publication_date, DATE '0001-01-01'), version_id)) AS monitored FROM v GROUP BY 1""")
def preferred_versions(spark, d):
    size = F.length("version_id")
    v = t.versions(spark, d).withColumns({"abstract": F.when(size % 2 == 0, "told"), "doi": F.when((F.col("version_type") == "published") & (size % 3 != 0), "10.1/x")})
    return op.preferred_versions(v)


@query("citation_items", f"""WITH {_IDS}, x AS (SELECT paper_id, CASE WHEN {KEY} % 3 = 0 THEN NULL ELSE doi END AS doi, CASE WHEN {KEY} % 3 = 0 THEN '' ELSE journal END AS journal, arxiv_id, abstract, year, {KEY} % 4 AS k, source FROM ids_v), y AS (SELECT *, CASE WHEN journal <> '' OR doi IS NOT NULL THEN 'journalArticle' WHEN arxiv_id IS NOT NULL THEN 'preprint' ELSE 'document' END AS kind FROM x)
SELECT paper_id, kind, doi, CASE WHEN kind = 'preprint' THEN arxiv_id END AS archive_id, nullif(abstract, '') AS abstract, CASE k WHEN 0 THEN 'Ada/Byron/-|-/-/Plato' WHEN 1 THEN 'J. von/Neumann/-' WHEN 2 THEN '-/-/Euler L.' END AS creators, CASE WHEN k = 3 THEN concat(source, '|Paper Intake') ELSE concat(source, '|Two|Paper Intake') END AS tags FROM y""")
def citation_items(spark, d):
    key = F.col("paper_id").cast("long")
    names = F.get(F.array(F.array(F.lit("Byron, Ada"), F.lit(" Plato "), F.lit("Byron,  Ada")), F.array(F.lit("J. von Neumann")), F.array(F.lit("Euler L.")), F.array().cast("array<string>")), (key % 4).cast("int"))
    tags = F.array(F.col("source"), F.when(key % 4 == 3, F.upper("source")).otherwise("Two"), F.lit(" "))
    papers = with_ids(spark, d).withColumns({"title": F.lit("T"), "authors": names, "tags": tags, "doi": F.when(key % 3 != 0, F.col("doi")), "journal": F.when(key % 3 == 0, "").otherwise(F.col("journal"))})
    parsed = F.from_json("item", "struct<itemType:string,DOI:string,archiveID:string,abstractNote:string,creators:array<struct<firstName:string,lastName:string,name:string>>,tags:array<struct<tag:string>>>")
    items = op.citation_items(papers).select("paper_id", parsed.alias("i"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    people = F.array_join(F.transform("i.creators", lambda c: F.concat_ws("/", dash(c["firstName"]), dash(c["lastName"]), dash(c["name"]))), "|")
    return items.select("paper_id", F.col("i.itemType").alias("kind"), F.col("i.DOI").alias("doi"), F.col("i.archiveID").alias("archive_id"), F.col("i.abstractNote").alias("abstract"), people.alias("creators"), F.array_join(F.transform("i.tags", lambda x: x["tag"]), "|").alias("tags"))


_FILES = "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN concat('10.1000/', CAST(o_orderkey AS VARCHAR)) END AS doi, concat('Title \"', CAST(o_orderkey AS VARCHAR), '\", part') AS title, CAST(o_orderdate AS DATE) AS pub_date, o_clerk AS clerk FROM orders"


@query("src_manual", f"WITH f AS ({_FILES.replace(', o_clerk AS clerk', '')}) SELECT doi, title, pub_date, 'csv' AS kind FROM f UNION ALL SELECT doi, title, pub_date, 'json' FROM f")
def src_manual(spark, d):
    o, k = t.read(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(F.when(k % 5 != 0, F.concat(F.lit("10.1000/"), k.cast("string"))).alias("DOI"), F.concat(F.lit('Title "'), k.cast("string"), F.lit('", part')).alias("Title"), F.col("o_orderdate").cast("date").cast("string").alias("Date"))
    table, lines = shared_path(spark, "manual.csv"), shared_path(spark, "manual.json")
    files.export_csv(rows, table + "/x.csv", ["DOI", "Title", "Date"])
    files.export_json(rows.select("DOI", F.col("Title").alias("paper_title"), F.col("Date").alias("published")), lines)
    both = [files.read_manual(spark, table + "/x.csv").withColumn("kind", F.lit("csv")), files.read_manual(spark, lines, lines=True).withColumn("kind", F.lit("json"))]
    return both[0].unionByName(both[1]).select("doi", "title", "pub_date", "kind")


@query("src_arxiv", "SELECT concat('cond-mat/', CAST(doc_id AS VARCHAR)) AS arxiv_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 3 AS INTEGER) END AS version, concat('Paper on ', lang) AS title, concat('A ', source) AS author, concat(lang, '|x-', lang) AS categories, DATE '2020-01-01' + CAST(doc_id % 300 AS INTEGER) AS submitted_date FROM documents")
def src_arxiv(spark, d):
    i = F.col("doc_id")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (i % 300).cast("int")).cast("string")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/cond-mat/"), i.cast("string"), F.when(i % 3 != 0, F.concat(F.lit("v"), (i % 3).cast("string"))).otherwise(""), F.lit("</id><title>Paper\n  on "), "lang", F.lit("</title><summary> s </summary><published>"), day,
        F.lit("T00:00:00Z</published><updated>"), day, F.lit("T00:00:00Z</updated><author><name>A "), "source", F.lit("</name></author><category term='"), "lang", F.lit("'/><category term='x-"), "lang", F.lit("'/></entry>"),
    )
    path = shared_path(spark, "feed")
    files.write_feed(t.read(spark, d, "documents").select(entry.alias("value")), path)
    feed = files.read_arxiv_feed(spark, path)
    return feed.select("arxiv_id", "version", "title", F.get("authors", F.lit(0)).alias("author"), F.array_join("categories", "|").alias("categories"), "submitted_date")


@query("src_tasks", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'good' END AS state, concat('T', CAST(doc_id AS VARCHAR)) AS name, CASE WHEN doc_id % 4 <> 0 THEN concat(lang, '|b,c|', source) END AS tags FROM documents")
def src_tasks(spark, d):
    i = F.col("doc_id")
    rows = t.read(spark, d, "documents").select(F.concat(F.lit("T"), i.cast("string")).alias("name"), F.when(i % 4 != 0, F.concat(F.lit("T"), i.cast("string"))).otherwise(" ").alias("title"), F.concat("lang", F.lit("; b,c")).alias("concepts"), F.concat(F.upper("lang"), F.lit(","), F.col("source")).alias("materials"), F.lit("").alias("methods"))
    path = shared_path(spark, "tasks")
    files.export_json(rows, path)
    good, rejected = files.read_tasks(spark.read.schema(rows.schema).json(path))
    return good.select(F.lit("good").alias("state"), "name", F.array_join("tags", "|").alias("tags")).union(rejected.select(F.lit("rejected"), "name", F.lit(None).cast("string")))


@query("export_tables", "SELECT kind, o_orderkey, text, o_totalprice FROM (SELECT o_orderkey, concat(o_orderpriority, ' \"', o_orderstatus, '\",') AS text, o_totalprice FROM orders), (SELECT unnest(['csv', 'json']) AS kind)")
def export_tables(spark, d):
    rows = t.read(spark, d, "orders").select(F.col("o_orderkey").cast("long"), F.concat("o_orderpriority", F.lit(' "'), "o_orderstatus", F.lit('",')).alias("text"), F.col("o_totalprice").cast("double"))
    table, lines = shared_path(spark, "table"), shared_path(spark, "lines")
    files.export_csv(rows, table, ["o_orderkey", "text", "o_totalprice"])
    files.export_json(rows, lines)
    back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(table).withColumn("kind", F.lit("csv"))
    return back.unionByName(spark.read.schema(rows.schema).json(lines).withColumn("kind", F.lit("json")))
