"""Queries on the strict classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import strict as op
from papertide.plans.entities import SEEDED_SQL, seeded
from papertide.plans.registry import query
from papertide.sources import tables as t

# Words and phrases by what they say of a paper; journals that are followed, and those of all fields among them.
PHRASES = (
    ("strong", "topological insulator"), ("strong", "quantum Hall effect"), ("keep", "spin-liquid"), ("keep", "ARPES"), ("keep", "density functional theory"), ("keep", "MoS2"), ("keep", "WSe2"), ("exclude", "DNA"), ("exclude", "Bi2Se3"), ("exclude", "erratum"),
    ("domain", "Weyl semimetal"), ("domain", "quantum hall effect"), ("domain", "study"),
)
TRACKED, GENERALIST = ["Journal A", "Journal B", "Journal C"], ["Journal C"]
_FOLD = "concat(' ', trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
STRICT_SQL = f"""{SEEDED_SQL}, ph(kind, phrase) AS (VALUES {", ".join(str(p) for p in PHRASES)}), p AS (SELECT doc_id AS paper_id, title, abstract, ['Journal A', 'Journal B', 'Journal C', 'Journal D', 'arXiv'][doc_id % 5 + 1] AS journal, CASE WHEN doc_id % 11 = 0 THEN 'mock' ELSE 'real' END AS data_mode, CASE doc_id % 7 WHEN 0 THEN 'low' WHEN 1 THEN '' ELSE 'high' END AS confidence,
 concat(' ', trim(lower(regexp_replace(concat(title, '. ', abstract), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS folded FROM seeded_v),
tm AS (SELECT doc_id AS paper_id, concat('term ', lang) AS term FROM seeded_v WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Spin Liquid' FROM seeded_v WHERE doc_id % 13 = 0),
h AS (SELECT paper_id, kind, phrase AS hit FROM p JOIN ph ON contains(folded, {_FOLD.format('phrase')}) UNION SELECT paper_id, kind, term FROM tm JOIN ph ON {_FOLD.format('term')} = {_FOLD.format('phrase')} WHERE kind <> 'domain'),
g AS (SELECT paper_id, {", ".join(f"array_to_string(list_slice(list_sort(list(DISTINCT hit) FILTER (kind = '{k}')), 1, 5), ',') AS {k}" for k in ("strong", "keep", "exclude", "domain"))} FROM h GROUP BY 1),
j AS (SELECT p.*, coalesce(strong, '') AS strong, coalesce(keep, '') AS keep, coalesce(exclude, '') AS exclude, coalesce(domain, '') AS domain, paper_id IN (SELECT paper_id FROM tm) AS shown, coalesce(nullif(confidence, ''), 'medium') AS grade FROM p LEFT JOIN g USING (paper_id)),
strict_v AS (SELECT paper_id, CASE WHEN data_mode <> 'real' THEN 'not_real' WHEN journal NOT IN ('Journal A', 'Journal B', 'Journal C', 'arXiv') THEN 'not_tracked_journal' WHEN grade NOT IN ('high', 'medium') THEN concat('confidence_', grade) WHEN exclude <> '' AND strong = '' THEN concat('excluded:', exclude)
 WHEN journal = 'Journal C' THEN CASE WHEN domain <> '' THEN concat('strict:generalist_text=', domain) ELSE 'generalist_requires_text' END WHEN keep <> '' OR strong <> '' OR shown THEN concat('strict', CASE WHEN strong <> '' THEN concat(':strong=', strong) WHEN keep <> '' THEN concat(':hit=', keep) ELSE ':display_term' END, CASE WHEN exclude <> '' THEN concat(':override_excluded=', exclude) ELSE '' END) ELSE 'no_hit' END AS reason FROM j)"""


def flags(spark, d):
    i = F.col("doc_id")
    docs = seeded(spark, d)
    journal = F.get(F.array(*map(F.lit, ("Journal A", "Journal B", "Journal C", "Journal D", "arXiv"))), (i % 5).cast("int"))
    papers = docs.select(
        i.alias("paper_id"), "title", "abstract", journal.alias("journal"), F.lit("openalex").alias("source"), F.lit("published").alias("source_scope"), F.when(i % 11 == 0, "mock").otherwise("real").alias("data_mode"),
        F.when(i % 7 == 0, "low").when(i % 7 == 1, "").otherwise("high").alias("confidence"),
    )
    terms = docs.filter(i % 3 == 0).select(i.alias("paper_id"), F.concat(F.lit("term "), "lang").alias("term")).union(docs.filter(i % 13 == 0).select(i, F.lit("Spin Liquid")))
    return op.classify_strict(papers, terms, spark.createDataFrame(PHRASES, "kind string, phrase string"), TRACKED, GENERALIST)


@query("strict_flags", f"{STRICT_SQL} SELECT paper_id, starts_with(reason, 'strict') AS eligible, reason FROM strict_v")
def strict_flags(spark, d):
    return flags(spark, d)


@query("reclassify_report", f"""{STRICT_SQL}, n AS (SELECT paper_id, starts_with(reason, 'strict') AS now, reason, paper_id % 4 <> 0 AS was, CASE WHEN paper_id % 2 = 0 THEN 'no_hit' ELSE 'strict:display_term' END AS why FROM strict_v)
SELECT unnest(['processed', 'eligible', 'excluded', 'changed', 'downgraded', 'promoted', 'updates_needed']) AS metric, unnest([count(*), count(*) FILTER (now), count(*) FILTER (NOT now), count(*) FILTER (now <> was), count(*) FILTER (was AND NOT now), count(*) FILTER (now AND NOT was), count(*) FILTER (now <> was OR reason <> why)]) AS papers FROM n
UNION ALL SELECT concat('reason:', split_part(reason, ':', 1)), count(*) FROM n GROUP BY 1""")
def reclassify_report(spark, d):
    new = flags(spark, d)
    old = t.docs(spark, d).select(F.col("doc_id").alias("paper_id"), (F.col("doc_id") % 4 != 0).alias("eligible"), F.when(F.col("doc_id") % 2 == 0, "no_hit").otherwise("strict:display_term").alias("reason"))
    return op.reclassify(old, new)


@query("repo_downgrade", f"""WITH {t.PAPERS_SQL}, {t.VERSIONS_SQL}, v AS (SELECT canonical_paper_id AS paper_id, version_id, source = 'openalex' AND version_type = 'metadata' AS r, (source = 'arxiv' AND version_type = 'preprint') OR (source = 'crossref' AND version_type = 'published') AS q FROM versions_v),
g AS (SELECT paper_id, bool_or(r) AS r, bool_or(q) AS q, count(*) AS versions, concat('repository ', min(version_id) FILTER (r)) AS reason FROM v GROUP BY 1), o AS (SELECT paper_id, versions, reason, CASE WHEN q THEN 'preserved' WHEN view_eligible IS NULL THEN 'missing' WHEN NOT view_eligible THEN 'already_excluded' ELSE 'downgraded' END AS outcome FROM g LEFT JOIN papers_v USING (paper_id) WHERE r)
SELECT paper_id, outcome, versions, CASE WHEN outcome = 'downgraded' THEN reason END AS reason FROM o""")
def repo_downgrade(spark, d):
    kind, source = F.col("version_type"), F.col("source")
    v = t.versions(spark, d).select(
        "canonical_paper_id", "version_id", ((source == "openalex") & (kind == "metadata")).alias("is_repository"), (((source == "arxiv") & (kind == "preprint")) | ((source == "crossref") & (kind == "published"))).alias("qualifies"),
        F.concat(F.lit("repository "), "version_id").alias("reason"),
    )
    return op.downgrade_repository_only(v, t.papers(spark, d))
