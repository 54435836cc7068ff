"""Queries over records with several kinds of id: resolution, decisions, plans, merges and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import matching as op
from papertide.operators.records import normalized_doi, title_key
from papertide.operators.titles import first_come_groups as first_come
from papertide.plans.corpus import rounded
from papertide.plans.registry import query
from papertide.sources import tables as t
from papertide.sources.scratch import saved

RECS_SQL = f"""{t.DOCS_SQL}, recs_v AS (SELECT doc_id AS id, source, concat('rec-', CAST(doc_id AS VARCHAR)) AS record_id, abstract, pub_date, CAST(year(pub_date) AS INTEGER) AS year,
 CASE WHEN doc_id % 3 = 0 THEN concat('10.1/', CAST(doc_id % 200 AS VARCHAR)) END AS doi_key, CASE WHEN doc_id % 4 = 1 THEN concat('1500.', CAST(doc_id % 150 AS VARCHAR)) END AS arxiv_key,
 CASE WHEN doc_id % 5 = 2 THEN concat('https://openalex.org/w', CAST(doc_id % 120 AS VARCHAR)) END AS openalex_key, {t.FOLDED_TITLE} AS title_key,
 [concat('Author ', lang), concat('Writer ', source)] AS authors, CASE WHEN doc_id % 14 = 3 THEN concat('J. X 5 (2001), doi 10.1/', CAST((doc_id + 1) % 200 AS VARCHAR)) END AS reference FROM docs_v)"""
IDS_SQL = "ids_v AS (SELECT 'doi' AS namespace, doi_key AS external_id, id AS paper_id FROM recs_v WHERE id % 2 = 0 AND doi_key IS NOT NULL UNION ALL SELECT 'arxiv', arxiv_key, id FROM recs_v WHERE id % 8 = 1 AND arxiv_key IS NOT NULL UNION ALL SELECT 'openalex', openalex_key, id FROM recs_v WHERE id % 2 = 0 AND openalex_key IS NOT NULL)"
RESOLVED_SQL = """res_v AS (SELECT i.*, d.p AS d, x.p AS x, o.p AS o FROM (SELECT * FROM recs_v WHERE id % 2 = 1) i
 LEFT JOIN (SELECT external_id, min(paper_id) AS p FROM ids_v WHERE namespace = 'doi' GROUP BY 1) d ON d.external_id = i.doi_key LEFT JOIN (SELECT external_id, min(paper_id) AS p FROM ids_v WHERE namespace = 'arxiv' GROUP BY 1) x ON x.external_id = i.arxiv_key
 LEFT JOIN (SELECT external_id, min(paper_id) AS p FROM ids_v WHERE namespace = 'openalex' GROUP BY 1) o ON o.external_id = i.openalex_key),
exact_v AS (SELECT *, coalesce(d, x, o) AS paper_id, CASE WHEN d IS NOT NULL THEN 'doi_exact' WHEN x IS NOT NULL THEN 'arxiv_exact' WHEN o IS NOT NULL THEN 'openalex_exact' ELSE 'new_library_record' END AS rule,
 CAST(CASE WHEN d IS NOT NULL THEN 1.0 WHEN x IS NOT NULL THEN 0.99 WHEN o IS NOT NULL THEN 0.995 ELSE 0.0 END AS DOUBLE) AS confidence FROM res_v)"""
_KEYS = "list_filter([CASE WHEN doi_key IS NOT NULL THEN concat('d:', doi_key) END, CASE WHEN arxiv_key IS NOT NULL THEN concat('x:', arxiv_key) END, CASE WHEN title_key IS NOT NULL THEN concat('t:', title_key) END{}], lambda k: k IS NOT NULL)"
_NAME = "list_filter(list_transform({}, lambda a: array_to_string(regexp_extract_all(lower(strip_accents(a)), '[a-z]+'), ' ')), lambda a: a <> '')"
DECIDED_SQL = f"""heads_v AS (SELECT k, min(id) AS c FROM (SELECT id, unnest({_KEYS.format('')}) AS k FROM recs_v WHERE id % 2 = 0) GROUP BY 1),
asked_v AS (SELECT id, unnest({_KEYS.format(", CASE WHEN reference IS NOT NULL THEN concat('d:', regexp_extract(lower(reference), '(10[.][0-9]+/[^ ,;)]+)', 1)) END")}) AS k FROM recs_v WHERE id % 2 = 1),
pairs_v AS (SELECT DISTINCT a.id AS left_id, h.c AS right_id FROM asked_v a JOIN heads_v h USING (k) WHERE a.id <> h.c),
both_v AS (SELECT left_id, right_id, i.doi_key AS id, c.doi_key AS cd, i.arxiv_key AS ix, c.arxiv_key AS cx, i.title_key AS it, c.title_key AS ct, i.year AS iy, c.year AS cy, lower(i.reference) AS ir, lower(c.reference) AS cr, {_NAME.format('i.authors')} AS ia, {_NAME.format('c.authors')} AS ca
 FROM pairs_v JOIN recs_v i ON i.id = left_id JOIN recs_v c ON c.id = right_id),
rules_v AS (SELECT *, CASE WHEN id = cd THEN 'doi_exact' WHEN ix = cx THEN 'arxiv_exact' WHEN contains(ir, cd) OR contains(cr, id) THEN 'arxiv_journal_reference_doi' WHEN it = ct THEN CASE WHEN id <> cd OR ix <> cx THEN 'title_external_id_conflict' WHEN ia[1] = ca[1] AND iy = cy THEN 'title_author_year' ELSE 'title_similarity_review' END ELSE 'none' END AS rule FROM both_v),
dec_v AS (SELECT left_id, right_id, rule <> 'none' AS matched, rule IN ('doi_exact', 'arxiv_exact', 'arxiv_journal_reference_doi', 'title_author_year') AS auto_merge, rule,
 CAST(CASE rule WHEN 'doi_exact' THEN 1.0 WHEN 'arxiv_exact' THEN 0.99 WHEN 'arxiv_journal_reference_doi' THEN 0.98 WHEN 'title_author_year' THEN least(0.97, 0.94 + 0.03 * len(list_intersect(ia, ca)) / len(list_distinct(list_concat(ia, ca)))) WHEN 'none' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS confidence FROM rules_v),
best_v AS (SELECT left_id, arg_min(right_id, (-confidence, NOT auto_merge, right_id)) AS right_id, arg_min(auto_merge, (-confidence, NOT auto_merge, right_id)) AS auto_merge, arg_min(rule, (-confidence, NOT auto_merge, right_id)) AS rule, max(confidence) AS confidence FROM dec_v WHERE matched GROUP BY 1)"""


def records(spark, d):
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    docs = t.docs(spark, d).select(
        i.alias("id"), "source", F.concat(F.lit("rec-"), text(i)).alias("record_id"), "abstract", "pub_date", F.year("pub_date").alias("year"),
        normalized_doi(F.when(i % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), text(i % 200)))).alias("doi_key"),
        op.arxiv_base(F.when(i % 4 == 1, F.concat(F.lit("arXiv:1500."), text(i % 150), F.lit("v"), text(i % 3 + 1)))).alias("arxiv_key"),
        op.openalex_key(F.when(i % 5 == 2, F.concat(F.lit("https://openalex.org/W"), text(i % 120), F.lit("/")))).alias("openalex_key"),
        title_key(F.col("title")).alias("title_key"), F.array(F.concat(F.lit("Author "), "lang"), F.concat(F.lit("Writer "), "source")).alias("authors"),
        F.when(i % 14 == 3, F.concat(F.lit("J. X 5 (2001), doi 10.1/"), text((i + 1) % 200))).alias("reference"),
    )
    return docs


def external_ids(recs):
    some = lambda n, rule: recs.filter(rule).select(F.lit(n).alias("namespace"), F.col(f"{n}_key").alias("external_id"), F.col("id").alias("paper_id"))
    even = "id % 2 = 0"
    return some("doi", even).union(some("arxiv", "id % 8 = 1")).union(some("openalex", even)).filter("external_id is not null")


@query("resolve_exact", f"WITH {RECS_SQL}, {IDS_SQL}, {RESOLVED_SQL} SELECT id, paper_id, rule, confidence FROM exact_v")
def resolve_exact(spark, d):
    recs = records(spark, d)
    return op.resolve_exact(recs.filter("id % 2 = 1"), external_ids(recs)).select("id", "paper_id", "rule", "confidence")


def decisions(spark, d):
    recs = records(spark, d)
    return op.score_pairs(op.candidate_pairs(recs.filter("id % 2 = 1"), recs.filter("id % 2 = 0")))


@query("match_decisions", f"WITH {RECS_SQL}, {DECIDED_SQL} SELECT left_id, right_id, matched, auto_merge, rule, round(confidence, 6) AS confidence FROM dec_v")
def match_decisions(spark, d):
    return rounded(decisions(spark, d), "confidence")


_CUT = "concat(substr(title_key, 1, 8 + CAST(id % 7 AS INTEGER)), substr(title_key, 10 + CAST(id % 7 AS INTEGER)))"


def shortened(recs):
    """Titles of 24 characters or more without one of them."""
    cut = F.concat(F.expr("substring(title_key, 1, 8 + cast(id % 7 as int))"), F.expr("substring(title_key, 10 + cast(id % 7 as int))"))
    return recs.filter("length(title_key) >= 24").select("id", F.lit(None).cast("string").alias("doi_key"), F.lit(None).cast("string").alias("arxiv_key"), cut.alias("title_key"), "authors", "year", F.lit(None).cast("string").alias("reference"))


@query("fuzzy_decisions", f"""WITH {RECS_SQL}, i AS (SELECT id, {_CUT} AS title_key, length(title_key) - 1 AS n FROM recs_v WHERE id % 2 = 1 AND length(title_key) >= 24), k AS (SELECT title_key, length(title_key) AS n, min(id) AS id FROM recs_v WHERE id % 2 = 0 AND title_key IS NOT NULL GROUP BY 1, 2)
SELECT i.id AS left_id, k.id AS right_id, 'title_similarity_review' AS rule, round(2.0 * (k.n - 1) / (2 * k.n - 1), 6) AS confidence FROM i JOIN k ON i.n = k.n - 1 AND levenshtein(i.title_key, k.title_key) = 1""")
def fuzzy_decisions(spark, d):
    """Titles without one character against all known titles that are one longer: no near title is lost."""
    # looked at several times: texts are folded once
    recs = saved(records(spark, d).select("id", "doi_key", "arxiv_key", "title_key", "authors", "year", "reference"), "records")
    asked = shortened(recs.filter("id % 2 = 1"))
    found = op.score_pairs(op.candidate_pairs(asked, recs.filter("id % 2 = 0"), fuzzy=True)).filter("matched")
    longer = found.join(asked.select(F.col("id").alias("left_id"), F.length("title_key").alias("n")), "left_id")
    longer = longer.join(recs.select(F.col("id").alias("right_id"), F.length("title_key").alias("m")), "right_id").filter("m = n + 1 and confidence >= (2 * n / (2 * n + 1)) - 1e-9")
    return rounded(longer.select("left_id", "right_id", "rule", "confidence"), "confidence")


@query("first_come_groups")
def first_come_groups(spark, d):
    """Titles with one character left out of every third; tests hold the operator against a loop."""
    recs = records(spark, d)
    cut = F.concat(F.expr("substring(title_key, 1, 8 + cast(id % 7 as int))"), F.expr("substring(title_key, 10 + cast(id % 7 as int))"))
    mixed = recs.withColumn("title_key", F.when((F.col("id") % 3 == 1) & (F.length("title_key") >= 24), cut).otherwise(F.col("title_key")))
    return first_come(mixed, lambda df: saved(df, "groups"))


@query("best_match", f"WITH {RECS_SQL}, {DECIDED_SQL} SELECT left_id, right_id, auto_merge, rule, round(confidence, 6) AS confidence FROM best_v")
def best_match(spark, d):
    return rounded(op.best_match(decisions(spark, d)), "confidence")


@query("version_plan", f"""WITH {RECS_SQL}, {IDS_SQL}, {RESOLVED_SQL}, {DECIDED_SQL}, p AS (SELECT e.id, e.paper_id, e.rule, e.confidence, s.id AS stored, b.right_id, coalesce(b.auto_merge, false) AS auto, b.rule AS best_rule, b.confidence AS best_confidence
 FROM exact_v e LEFT JOIN (SELECT * FROM recs_v WHERE id % 2 = 0 OR id % 10 = 1) s ON s.source = e.source AND s.record_id = e.record_id LEFT JOIN best_v b ON b.left_id = e.id)
SELECT id, CASE WHEN stored IS NOT NULL THEN 'updated_existing_version' WHEN paper_id IS NOT NULL OR auto THEN 'attached_version' ELSE 'created_canonical' END AS action, CASE WHEN stored IS NOT NULL THEN stored WHEN paper_id IS NOT NULL THEN paper_id WHEN auto THEN right_id END AS paper_id,
 CASE WHEN stored IS NOT NULL THEN 'source_record_exact' WHEN paper_id IS NOT NULL THEN rule WHEN right_id IS NOT NULL THEN best_rule ELSE 'new_library_record' END AS rule, round(CASE WHEN stored IS NOT NULL THEN 1.0 WHEN paper_id IS NOT NULL THEN confidence WHEN right_id IS NOT NULL THEN best_confidence ELSE 0.0 END, 6) AS confidence,
 CASE WHEN stored IS NULL AND paper_id IS NULL AND NOT auto THEN CASE WHEN right_id IS NOT NULL THEN 'identity_match' ELSE 'corpus_eligibility' END END AS review FROM p""")
def version_plan(spark, d):
    recs = records(spark, d)
    stored = recs.filter("id % 2 = 0 or id % 10 = 1").withColumn("paper_id", F.col("id"))
    return rounded(op.plan_versions(recs.filter("id % 2 = 1"), stored, external_ids(recs), recs.filter("id % 2 = 0")), "confidence")


_COMPONENTS = f"""WITH RECURSIVE {RECS_SQL}, safe AS (SELECT title_key FROM recs_v WHERE title_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doi_key) <= 1 AND count(DISTINCT arxiv_key) <= 1),
f AS (SELECT id, concat('d:', doi_key) AS k FROM recs_v WHERE doi_key IS NOT NULL UNION ALL SELECT id, concat('x:', arxiv_key) FROM recs_v WHERE arxiv_key IS NOT NULL UNION ALL SELECT id, concat('t:', title_key) FROM recs_v SEMI JOIN safe USING (title_key)),
e AS (SELECT DISTINCT a.id AS a, b.m AS b FROM f a JOIN (SELECT k, min(id) AS m FROM f GROUP BY 1) b USING (k) WHERE a.id <> b.m), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node), r AS (SELECT node, min(root) AS root FROM w GROUP BY 1), rooted AS (SELECT recs_v.*, coalesce(root, id) AS root FROM recs_v LEFT JOIN r ON node = id)"""


@query("components", f"{_COMPONENTS} SELECT node, root FROM r")
def components(spark, d):
    links, _ = op.identity_links(records(spark, d))
    return op.components(links, lambda df: saved(df, "components"))


@query("title_conflicts", f"WITH {RECS_SQL} SELECT title_key, count(*) AS records FROM recs_v WHERE title_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doi_key) > 1 OR count(DISTINCT arxiv_key) > 1")
def title_conflicts(spark, d):
    return op.identity_links(records(spark, d))[1]


def rooted(spark, d):
    recs = records(spark, d)
    return op.with_roots(recs, op.identity_links(recs)[0], lambda df: saved(df, "components"))


_SCORED = "(SELECT *, (doi_key IS NOT NULL)::INT + (arxiv_key IS NOT NULL)::INT + (openalex_key IS NOT NULL)::INT + (title_key IS NOT NULL)::INT + (coalesce(abstract, '') <> '')::INT AS filled FROM rooted)"


@query("dedup_records", f"""{_COMPONENTS}, s AS (SELECT *, (-(filled + least(floor(length(coalesce(abstract, '')) / 500), 4)), id) AS o FROM {_SCORED}) SELECT root, arg_min(id, o) AS base_id, arg_min(doi_key, o) FILTER (doi_key IS NOT NULL) AS doi_key, arg_min(arxiv_key, o) FILTER (arxiv_key IS NOT NULL) AS arxiv_key, arg_min(openalex_key, o) FILTER (openalex_key IS NOT NULL) AS openalex_key, count(*) AS copies FROM s GROUP BY 1""")
def dedup_records(spark, d):
    return op.dedup_records(rooted(spark, d), ["doi_key", "arxiv_key", "openalex_key"], ["doi_key", "arxiv_key", "openalex_key", "title_key", "abstract"])


@query("merge_components", f"""{_COMPONENTS} SELECT root, arg_max(id, ((doi_key IS NOT NULL)::INT + (arxiv_key IS NOT NULL)::INT, filled, length(coalesce(abstract, '')), pub_date, id)) AS paper_id, min(pub_date) AS created_at, max(pub_date) AS last_seen_at, count(*) - 1 AS aliases FROM {_SCORED} GROUP BY 1""")
def merge_components(spark, d):
    return op.merge_components(rooted(spark, d), ["doi_key", "arxiv_key", "openalex_key", "title_key", "abstract"])


_LAST = "CASE WHEN contains({0}, ',') THEN coalesce(regexp_extract_all(lower(split_part({0}, ',', 1)), '[a-z]+')[-1], regexp_extract_all(lower({0}), '[a-z]+')[1]) ELSE regexp_extract_all(lower({0}), '[a-z]+')[-1] END"
_IDENTITY = f"concat({_LAST}, ':', substr(array_to_string(list_transform(list_slice(regexp_extract_all(lower({{0}}), '[a-z]+'), 1, -2), lambda q: substr(q, 1, 1)), ''), 1, 3))"


@query("clean_authors", f"""WITH a AS (SELECT p_partkey, [concat(' ', p_name, '  '), concat(upper(substr(p_name, 1, 1)), '. ', split_part(p_name, ' ', 2)), concat(split_part(p_name, ' ', 2), ' , ', split_part(p_name, ' ', 1)), p_brand, '12 - 3', p_name] AS x FROM part),
n AS (SELECT p_partkey, list_filter(list_transform(x, lambda v: trim(replace(regexp_replace(v, '\\s+', ' ', 'g'), ' , ', ', '))), lambda v: regexp_matches(lower(v), '[a-z]')) AS x FROM a), k AS (SELECT *, list_transform(x, lambda v: {_IDENTITY.format('v')}) AS ks FROM n)
SELECT p_partkey, array_to_string(list_filter(x, lambda v, i: list_position(ks, ks[i]) = i), '|') AS authors FROM k""")
def clean_authors(spark, d):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    names = F.array(F.concat(F.lit(" "), "p_name", F.lit("  ")), F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(". "), second), F.concat(second, F.lit(" , "), first), F.col("p_brand"), F.lit("12 - 3"), F.col("p_name"))
    parts = t.read(spark, d, "part").select("p_partkey", names.alias("raw"))
    return parts.select("p_partkey", F.array_join(op.clean_authors(F.col("raw")), "|").alias("authors"))


_SOURCES = f"""WITH {RECS_SQL}, v AS (SELECT *, CASE WHEN doi_key IS NOT NULL THEN 'published' WHEN arxiv_key IS NOT NULL THEN 'preprint' ELSE 'metadata' END AS version_type FROM recs_v),
s AS (SELECT id, title_key, nullif(regexp_extract(lower(coalesce(reference, '')), '(10[.][0-9]+/[^ ,;)]*[^ ,;.)])', 1), '') AS doi FROM v WHERE arxiv_key IS NOT NULL AND doi_key IS NULL),
g AS (SELECT doi_key AS doi, arg_min(id, (version_type <> 'published', id)) AS target_id FROM v WHERE doi_key IS NOT NULL GROUP BY 1), x AS (SELECT s.*, target_id FROM s LEFT JOIN g USING (doi))"""


def versioned(spark, d):
    kind = F.when(F.col("doi_key").isNotNull(), "published").when(F.col("arxiv_key").isNotNull(), "preprint").otherwise("metadata")
    return records(spark, d).withColumns({"version_type": kind, "raw_doi": F.lit(None).cast("string")})


@query("link_versions", f"{_SOURCES} SELECT id, target_id, doi, 'journal_reference_doi_exact' AS rule, CAST(1.0 AS DOUBLE) AS confidence FROM x WHERE target_id <> id")
def link_versions(spark, d):
    return op.link_publications(versioned(spark, d))[0]


@query("version_reviews", f"{_SOURCES}, c AS (SELECT title_key, id AS candidate_id, row_number() OVER (PARTITION BY title_key ORDER BY id) AS n FROM v WHERE version_type = 'published' AND title_key IS NOT NULL) SELECT id, candidate_id, 'title-only publication candidate requires manual review' AS reason FROM x JOIN c USING (title_key) WHERE target_id IS NULL AND n <= 2 AND candidate_id <> id")
def version_reviews(spark, d):
    return op.link_publications(versioned(spark, d))[1]
