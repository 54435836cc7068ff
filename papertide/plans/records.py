"""Identity, merge, operations and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import records as op
from papertide.operators.acquisition import failure_plan
from papertide.plans.corpus import rounded
from papertide.plans.registry import query
from papertide.sources import tables as t
from papertide.streaming import events as st
from papertide.streaming.ingest import distinct_observations

DOC_KEYS_SQL = f"WITH {t.DOCS_SQL}, keys_v AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN concat('10.1/', CAST(doc_id % 200 AS VARCHAR)) END AS doi_key, {t.FOLDED_TITLE} AS title_key, CAST(year(pub_date) AS INTEGER) AS year FROM docs_v)"


def identified(spark, d):
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    docs = t.docs(spark, d).withColumns({
        "doi": F.when(i % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), text(i % 200), F.when(i % 2 == 0, ".").otherwise(""))),
        "arxiv_id": F.when(i % 4 == 1, F.concat(F.lit("arXiv:1500."), text(i % 150), F.when(i % 8 == 1, F.concat(F.lit("v"), text(i % 3 + 1))).otherwise(""))),
        "authors": F.array(F.concat(F.lit("Zoë "), "lang"), F.concat(F.lit("Müller, "), "source"), F.lit("12")),
    })
    return op.with_identity_keys(docs).withColumnRenamed("doc_id", "id")


def keyed(spark, d):
    return identified(spark, d).select("id", "doi_key", "title_key", "year")


_NAMES = "array_to_string(regexp_extract_all(lower(strip_accents({})), '[a-z]+'), ' ')"


@query("identity_keys", f"""{DOC_KEYS_SQL} SELECT k.*, CASE WHEN id % 4 = 1 THEN concat('1500.', CAST(id % 150 AS VARCHAR)) END AS arxiv_key, CAST(CASE WHEN id % 8 = 1 THEN id % 3 + 1 END AS INTEGER) AS arxiv_version,
 concat({_NAMES.format("concat('Zoë ', lang)")}, '|', {_NAMES.format("concat('Müller, ', source)")}) AS author_keys FROM keys_v k JOIN documents ON doc_id = id""")
def identity_keys(spark, d):
    return identified(spark, d).select("id", "doi_key", "title_key", "year", "arxiv_key", "arxiv_version", F.array_join("author_keys", "|").alias("author_keys"))


@query("title_candidates", f"{DOC_KEYS_SQL} SELECT a.id AS left_id, b.m AS right_id FROM keys_v a JOIN (SELECT title_key, min(id) AS m FROM keys_v WHERE length(title_key) >= 16 GROUP BY 1) b USING (title_key) WHERE a.id <> b.m")
def title_candidates(spark, d):
    return op.title_candidates(keyed(spark, d)).select("left_id", "right_id")


@query("id_conflicts", f"WITH {t.PAPERS_SQL}, c AS (SELECT 'group' AS namespace, concat(journal, month) AS external_id, paper_id, pub_date AS claimed_at FROM papers_v) SELECT namespace, external_id, arg_min(paper_id, (claimed_at, paper_id)) AS kept, count(DISTINCT paper_id) AS papers FROM c GROUP BY 1, 2 HAVING count(DISTINCT paper_id) > 1")
def id_conflicts(spark, d):
    claims = t.papers(spark, d).select(F.lit("group").alias("namespace"), F.concat("journal", "month").alias("external_id"), "paper_id", F.col("pub_date").alias("claimed_at"))
    return op.id_conflicts(claims)


@query("merge_sources", f"WITH {t.PAPERS_SQL} SELECT month, arg_min(doi, (source, doi)) FILTER (doi IS NOT NULL) AS doi, max(cited_by_count) AS cited_by_count, bool_or(is_open_access) AS is_open_access, count(*) AS records FROM papers_v GROUP BY 1")
def merge_sources(spark, d):
    return op.merge_sources(t.papers(spark, d), "month", "source", ["doi"], ["cited_by_count"], ["is_open_access"])


@query("new_records", f"{DOC_KEYS_SQL}, k AS (SELECT * FROM keys_v WHERE id % 4 = 0), i AS (SELECT * FROM keys_v WHERE id % 4 <> 0) SELECT min(id) AS id FROM i WHERE coalesce(doi_key, title_key) IS NOT NULL AND CASE WHEN doi_key IS NOT NULL THEN doi_key NOT IN (SELECT doi_key FROM k WHERE doi_key IS NOT NULL) ELSE title_key NOT IN (SELECT title_key FROM k WHERE title_key IS NOT NULL) END GROUP BY coalesce(doi_key, title_key)")
def new_records(spark, d):
    both = keyed(spark, d)
    return op.new_records(both.filter("id % 4 <> 0"), both.filter("id % 4 = 0")).select("id")


def newer(spark, d):
    p = t.papers(spark, d)
    third = F.col("paper_id").cast("long") % 3 == 0
    return p.withColumns({"journal": F.when(third, F.upper("journal")).otherwise(F.col("journal")), "doi": F.when(third, F.lit(None)).otherwise(F.col("doi")), "abstract": F.lit(""), "cited_by_count": F.when(third, F.col("cited_by_count") + 1).otherwise(F.col("cited_by_count") - 1)})


_NEWER = f"WITH {t.PAPERS_SQL}, n AS (SELECT paper_id, CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN upper(journal) ELSE journal END AS journal, CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN NULL ELSE doi END AS doi, '' AS abstract, CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN cited_by_count + 1 ELSE cited_by_count - 1 END AS cited_by_count FROM papers_v)"


@query("diff_records", f"{_NEWER} SELECT p.paper_id, CASE WHEN n.journal IS DISTINCT FROM p.journal THEN 'journal,cited_by_count' ELSE 'cited_by_count' END AS fields FROM papers_v p JOIN n USING (paper_id)")
def diff_records(spark, d):
    found = op.changed(t.papers(spark, d), newer(spark, d), "paper_id", ["journal", "doi", "abstract", "cited_by_count"])
    return found.select("paper_id", F.array_join("fields", ",").alias("fields"))


@query("upsert_papers", f"{_NEWER} SELECT p.paper_id, coalesce(nullif(n.journal, ''), p.journal) AS journal, coalesce(n.doi, p.doi) AS doi, coalesce(nullif(n.abstract, ''), p.abstract) AS abstract, greatest(p.cited_by_count, n.cited_by_count) AS cited_by_count FROM papers_v p LEFT JOIN n ON n.paper_id = p.paper_id")
def upsert_papers(spark, d):
    return op.upsert(t.papers(spark, d), newer(spark, d), "paper_id", ["journal", "doi", "abstract"], ["cited_by_count"])


@query("replace_terms", f"WITH {t.TERMS_SQL} SELECT paper_id, term_type, normalized_term, CASE WHEN CAST(paper_id AS BIGINT) % 5 = 0 THEN 'new' ELSE 'kept' END AS state FROM terms_v WHERE CAST(paper_id AS BIGINT) % 5 <> 0 OR term_type = 'method'")
def replace_terms(spark, d):
    terms = t.terms(spark, d).select("paper_id", "term_type", "normalized_term")
    keys = terms.filter("cast(paper_id as bigint) % 5 = 0").select("paper_id")
    new = terms.join(keys.distinct(), "paper_id", "left_semi").filter("term_type = 'method'").withColumn("state", F.lit("new"))
    return op.replace_for_keys(terms.withColumn("state", F.lit("kept")), new, keys, "paper_id")


@query("preferred_version", f"WITH {t.VERSIONS_SQL} SELECT canonical_paper_id, arg_min(version_id, (CASE WHEN version_type = 'published' THEN 0 ELSE 1 END, CASE WHEN source = 'legacy' THEN 1 ELSE 0 END, -epoch(coalesce(publication_date, submitted_date)), version_id)) AS version_id FROM versions_v GROUP BY 1")
def preferred_version(spark, d):
    day = F.coalesce("publication_date", "submitted_date")
    order = [F.when(F.col("version_type") == "published", 0).otherwise(1), F.when(F.col("source") == "legacy", 1).otherwise(0), -F.unix_date(day), F.col("version_id")]
    return op.best_by(t.versions(spark, d), "canonical_paper_id", order).select("canonical_paper_id", "version_id")


@query("best_abstract", "SELECT lang, source, max(length(text)) AS chars, arg_min(doc_id, (-length(text), doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def best_abstract(spark, d):
    docs = t.read(spark, d, "documents").select("lang", "source", "doc_id", F.char_length("text").cast("long").alias("chars"))
    return docs.groupBy("lang", "source").agg(F.max("chars").alias("chars"), F.min_by("doc_id", F.struct(-F.col("chars"), F.col("doc_id"))).alias("doc_id"))


@query("corpus_overlap", f"{DOC_KEYS_SQL}, a AS (SELECT * FROM keys_v WHERE id % 2 = 0), b AS (SELECT * FROM keys_v WHERE id % 2 = 1) SELECT CASE WHEN doi_key IN (SELECT doi_key FROM b WHERE doi_key IS NOT NULL) THEN 'doi' WHEN title_key IN (SELECT title_key FROM b WHERE title_key IS NOT NULL) THEN 'title' ELSE 'only_left' END AS found, count(*) AS records FROM a GROUP BY 1")
def corpus_overlap(spark, d):
    both = keyed(spark, d)
    right = both.filter("id % 2 = 1")
    doi = right.filter("doi_key is not null").select("doi_key", F.lit(True).alias("d")).distinct()
    title = right.filter("title_key is not null").select("title_key", F.lit(True).alias("t")).distinct()
    left = both.filter("id % 2 = 0").join(doi, "doi_key", "left").join(title, "title_key", "left")
    return left.groupBy(F.when(F.col("d"), "doi").when(F.col("t"), "title").otherwise("only_left").alias("found")).agg(F.count("*").alias("records"))


@query("integrity", f"WITH {t.PAPERS_SQL}, {t.VERSIONS_SQL} SELECT 'orphan_versions' AS problem, count(*) AS n FROM versions_v ANTI JOIN papers_v ON paper_id = canonical_paper_id UNION ALL SELECT 'papers_without_version', count(*) FROM papers_v ANTI JOIN versions_v ON paper_id = canonical_paper_id UNION ALL SELECT 'repeated_text', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def integrity(spark, d):
    p, v = t.papers(spark, d).select(F.col("paper_id").alias("k")), t.versions(spark, d).select(F.col("canonical_paper_id").alias("k"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    repeated = t.read(spark, d, "documents").groupBy(F.sha2(F.col("text"), 256)).agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("repeated_text").alias("problem"), "n")
    return one("orphan_versions", v.join(p, "k", "left_anti")).union(one("papers_without_version", p.join(v, "k", "left_anti"))).union(repeated)


@query("attempt_stats", f"WITH {t.ATTEMPTS_SQL} SELECT candidate_source, coalesce(failure_class, 'none') AS failure_class, count(*) AS attempts, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / count(*), 9) AS success FROM attempts_v GROUP BY 1, 2")
def attempt_stats(spark, d):
    done = F.count_if(F.col("status") == "completed")
    return t.attempts(spark, d).groupBy("candidate_source", F.coalesce("failure_class", F.lit("none")).alias("failure_class")).agg(F.count("*").alias("attempts"), done.alias("completed"), F.round(done / F.count("*"), 9).alias("success"))


_MAY_PASS = "(code IS NULL OR code IN (408, 425, 429) OR code >= 500 OR kind IN ('connection_error', 'http_rate_limited', 'http_server_error', 'request_timeout', 'tls_error'))"


@query("retry_plan", f"""WITH {t.ATTEMPTS_SQL}, a AS (SELECT *, CASE WHEN failure_class IS NULL THEN CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 451 WHEN 3 THEN 503 END END AS code, CASE event_id % 7 WHEN 0 THEN 100000 WHEN 1 THEN 60 END AS after FROM attempts_v),
k AS (SELECT *, coalesce(failure_class, CASE code WHEN 404 THEN 'not_found' WHEN 429 THEN 'http_rate_limited' WHEN 451 THEN 'legal_restriction' WHEN 503 THEN 'http_server_error' ELSE 'request_error' END) AS kind FROM a),
r AS (SELECT *, kind IN ('access_denied', 'legal_restriction') AS manual, {_MAY_PASS} AS may FROM k), q AS (SELECT *, NOT manual AND may AND attempt_number < 5 AS retry FROM r)
SELECT event_id, kind, CASE WHEN retry THEN 'retryable_failed' WHEN manual OR may THEN 'manual_review' ELSE 'permanent_failed' END AS status, retry, CASE WHEN retry THEN CASE WHEN after IS NOT NULL THEN least(86400.0, greatest(least(3600.0, 5 * pow(2, attempt_number - 1)), after)) ELSE least(3600.0, 5 * pow(2, attempt_number - 1)) END END AS delay FROM q""")
def retry_plan(spark, d):
    i = F.col("event_id")
    code = F.when(F.col("failure_class").isNull(), F.when(i % 5 == 0, 404).when(i % 5 == 1, 429).when(i % 5 == 2, 451).when(i % 5 == 3, 503))
    attempts = t.attempts(spark, d).withColumns({"http_status": code, "retry_after": F.when(i % 7 == 0, 100000.0).when(i % 7 == 1, 60.0)})
    return failure_plan(attempts).select("event_id", "kind", "status", "retry", "delay")


@query("latest_status", f"WITH {t.ATTEMPTS_SQL}, l AS (SELECT task_id, arg_max(status, attempt_number) AS status, max(attempt_number) AS attempts FROM attempts_v GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS paper_id, coalesce(status, 'not_requested') AS status, CAST(coalesce(attempts, 0) AS INTEGER) AS attempts FROM customer LEFT JOIN l ON task_id = CAST(c_custkey AS VARCHAR)")
def latest_status(spark, d):
    papers = t.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"))
    tasks = t.attempts(spark, d).withColumnRenamed("task_id", "paper_id")
    return op.latest_status(papers, tasks, F.col("attempt_number"))


_TASKS = f"""WITH {t.ATTEMPTS_SQL}, l AS (SELECT task_id, CAST(task_id AS BIGINT) AS i, max(attempt_number) AS attempt_count, arg_max(status, attempt_number) AS last, arg_max(coalesce(failure_class, ''), attempt_number) AS last_class,
 arg_max(candidate_source, attempt_number) AS source, CAST(min(ts) AS DATE) AS created_at, CAST(max(ts) AS DATE) AS updated_at FROM attempts_v GROUP BY 1),
tasks AS (SELECT *, CASE WHEN i % 10 = 0 THEN 'pending' WHEN last = 'completed' THEN CASE WHEN i % 4 = 1 THEN 'permanent_failed' ELSE 'completed' END WHEN last_class = 'access_denied' THEN 'manual_review' ELSE 'retryable_failed' END AS status, CASE WHEN i % 3 <> 0 THEN updated_at + CAST(i % 9 AS INTEGER) END AS next_attempt_at, i % 5 AS priority,
 CASE WHEN i % 4 = 1 THEN concat('[request_timeout] ', task_id) ELSE '' END AS last_error FROM l)"""
NOW = "2024-01-28"


def tasks(spark, d):
    """One task a user, with the state after its last attempt."""
    i = F.col("task_id").cast("long")
    last = t.attempts(spark, d).groupBy("task_id").agg(F.max("attempt_number").alias("attempt_count"), F.max_by(F.struct("status", "failure_class", "candidate_source"), "attempt_number").alias("l"), F.min("ts").cast("date").alias("created_at"), F.max("ts").cast("date").alias("updated_at"))
    state = (
        F.when(i % 10 == 0, "pending").when(F.col("l.status") == "completed", F.when(i % 4 == 1, "permanent_failed").otherwise("completed"))
        .when(F.col("l.failure_class") == "access_denied", "manual_review").otherwise("retryable_failed")
    )
    return last.select(
        "task_id", state.alias("status"), "attempt_count", F.when(i % 3 != 0, F.expr("date_add(updated_at, cast(task_id % 9 as int))")).alias("next_attempt_at"), (i % 5).alias("priority"), "created_at", "updated_at",
        F.when(i % 4 == 1, F.concat(F.lit("[request_timeout] "), "task_id")).otherwise("").alias("last_error"), F.col("l.candidate_source").alias("source"),
    )


@query("due_tasks", f"{_TASKS} SELECT task_id, status, priority, attempt_count FROM tasks WHERE status = 'pending' OR (status = 'retryable_failed' AND (next_attempt_at IS NULL OR next_attempt_at <= DATE '{NOW}')) ORDER BY priority DESC, created_at, task_id LIMIT 50")
def due_tasks(spark, d):
    return op.due_tasks(tasks(spark, d), F.lit(NOW).cast("date"), 50).select("task_id", "status", "priority", "attempt_count")


@query("requeue", f"""{_TASKS}, k AS (SELECT task_id FROM tasks WHERE status IN ('retryable_failed', 'permanent_failed', 'manual_review') AND (last_class = 'request_timeout' OR contains(last_error, '[request_timeout]')) AND source IN ('click', 'view', 'error', 'purchase') ORDER BY updated_at, created_at, task_id LIMIT 40)
SELECT CASE WHEN k.task_id IS NULL THEN status ELSE 'pending' END AS status, k.task_id IS NOT NULL AS again, count(*) AS tasks, CAST(sum(CASE WHEN k.task_id IS NULL THEN attempt_count ELSE 0 END) AS BIGINT) AS attempts, CAST(sum(CASE WHEN k.task_id IS NULL THEN 0 ELSE i END) AS BIGINT) AS ids FROM tasks LEFT JOIN k USING (task_id) GROUP BY 1, 2""")
def requeue(spark, d):
    attempts = t.attempts(spark, d).withColumn("candidate_index", F.lit(1))
    after = op.requeue(tasks(spark, d), attempts, failure_classes=("request_timeout",), sources=("click", "view", "error", "purchase"), limit=40)
    again = F.col("source").isNull()
    return after.groupBy("status", again.alias("again")).agg(F.count("*").alias("tasks"), F.sum("attempt_count").alias("attempts"), F.sum(F.when(again, F.col("task_id").cast("long")).otherwise(0)).alias("ids"))


@query("lifecycle_counts", f"WITH {t.ATTEMPTS_SQL} SELECT status, candidate_source, count(DISTINCT task_id) AS tasks FROM attempts_v GROUP BY ROLLUP (status, candidate_source)")
def lifecycle_counts(spark, d):
    return t.attempts(spark, d).rollup("status", "candidate_source").agg(F.countDistinct("task_id").alias("tasks"))


@query("storage_estimate", f"WITH {t.PAPERS_SQL} SELECT journal, count(*) AS papers, round(count(*) * 0.006 + sum(CASE WHEN is_open_access THEN 5 ELSE 0 END), 6) AS mb FROM papers_v GROUP BY ROLLUP (journal)")
def storage_estimate(spark, d):
    mb = F.count("*") * 0.006 + F.sum(F.when(F.col("is_open_access"), 5.0).otherwise(0.0))
    return t.papers(spark, d).rollup("journal").agg(F.count("*").alias("papers"), F.round(mb, 6).alias("mb"))


@query("completeness_grid", "WITH g AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), c AS (SELECT n_nationkey, n_name FROM nation), f AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS n_nationkey, count(*) AS papers FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1, 2) SELECT g.year, c.n_name, f.papers FROM g CROSS JOIN c LEFT JOIN f ON f.year = g.year AND f.n_nationkey = c.n_nationkey")
def completeness_grid(spark, d):
    o, c, n = (t.read(spark, d, x) for x in ("orders", "customer", "nation"))
    year = F.year(F.col("o_orderdate").cast("date")).alias("year")
    facts = o.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").join(c, o.o_custkey == c.c_custkey).groupBy(year, F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("papers"))
    return op.completeness_grid(facts, [o.select(year).distinct(), n.select("n_nationkey", "n_name")], ["year", "n_nationkey"]).select("year", "n_name", "papers")


_CITED = f"WITH {t.PAPERS_SQL}, c AS (SELECT *, CAST(paper_id AS BIGINT) AS i, concat('A {{study}} of ', journal) AS title FROM papers_v)"


def cited(spark, d):
    i = F.col("paper_id").cast("long")
    authors = F.when(i % 4 == 0, F.array(F.lit("Ada  Byron"), F.lit("Li, Wei"))).when(i % 4 == 1, F.array(F.lit("Müller-Lee, Jo"))).when(i % 4 == 2, F.array().cast("array<string>"))
    return t.papers(spark, d).withColumns({"title": F.concat(F.lit("A {study} of "), "journal"), "authors": authors, "journal": F.when(i % 3 != 0, F.col("journal")), "url": F.when(i % 5 == 0, F.lit("http://u")), "arxiv_id": F.when(i % 7 == 0, F.col("paper_id"))})


_AUTHORED = "CASE i % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} END"


@query("export_ris", f"""{_CITED} SELECT paper_id, concat_ws(concat(chr(13), chr(10)), 'TY  - JOUR', concat('TI  - ', title), {_AUTHORED.format("concat('AU  - Ada Byron', chr(13), chr(10), 'AU  - Li, Wei')", "'AU  - Müller-Lee, Jo'")}, CASE WHEN i % 3 <> 0 THEN concat('JO  - ', journal) END, concat('PY  - ', CAST(year AS VARCHAR)),
 CASE WHEN doi IS NOT NULL THEN concat('DO  - ', doi) END, CASE WHEN i % 5 = 0 THEN 'UR  - http://u' END, CASE WHEN abstract <> '' THEN concat('AB  - ', abstract) END, 'ER  -') AS ris FROM c""")
def export_ris(spark, d):
    return op.ris(cited(spark, d))


@query("export_bibtex", f"""{_CITED} SELECT paper_id, concat('@', CASE WHEN i % 3 = 0 THEN 'misc' ELSE 'article' END, '{{', 'key', paper_id, ',', chr(10), concat_ws(concat(',', chr(10)), concat('  title = {{A study of ', journal, '}}'), {_AUTHORED.format("'  author = {Ada Byron and Li, Wei}'", "'  author = {Müller-Lee, Jo}'")}, concat('  year = {{', CAST(year AS VARCHAR), '}}'),
 CASE WHEN i % 3 <> 0 THEN concat('  journal = {{', journal, '}}') END, CASE WHEN doi IS NOT NULL THEN concat('  doi = {{', doi, '}}') END, CASE WHEN i % 5 = 0 THEN '  url = {{http://u}}' END, CASE WHEN abstract <> '' THEN concat('  abstract = {{', abstract, '}}') END, CASE WHEN i % 7 = 0 THEN concat('  eprint = {{', paper_id, '}}', ',', chr(10), '  archivePrefix = {{arXiv}}') END), chr(10), '}}') AS bibtex FROM c""")
def export_bibtex(spark, d):
    return op.bibtex(cited(spark, d).withColumn("citation_key", F.concat(F.lit("key"), "paper_id")))


@query("citation_keys", f"""{_CITED}, b AS (SELECT paper_id, concat({_AUTHORED.format("'Byron'", "'M_ller_Lee'").replace(' END', " ELSE 'unknown' END")}, '_', CAST(year AS VARCHAR), '_study') AS base FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY paper_id) AS n FROM b) SELECT paper_id, CASE WHEN n = 1 THEN base ELSE concat(base, '_', CAST(n AS VARCHAR)) END AS citation_key FROM r""")
def citation_keys(spark, d):
    return op.citation_keys(cited(spark, d), hot_rows=800)


@query("in_window", f"WITH {t.VERSIONS_SQL} SELECT version_id FROM versions_v WHERE submitted_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' OR publication_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def in_window(spark, d):
    return t.versions(spark, d).filter("submitted_date between date'1998-01-01' and date'1998-06-30' or publication_date between date'1998-03-01' and date'1998-03-31'").select("version_id")


@query("st_tumbling", "SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def st_tumbling(spark, d):
    return rounded(st.tumbling(spark, d), "value").withColumn("value", F.round("value", 4))


@query("st_dedup", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2")
def st_dedup(spark, d):
    stream = st.arriving(spark, d).select("event_type", "user_id", F.to_date("ts").alias("day"))
    return distinct_observations(spark, stream, "event_type", "user_id", ["day"]).groupBy("user_id", "event_type").agg(F.count("*").alias("days"))


@query("st_hits", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS hits FROM events WHERE event_type = 'error' OR value < 20 GROUP BY 1")
def st_hits(spark, d):
    return st.hits(spark, d)
