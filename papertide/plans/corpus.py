"""Scope, preset, monthly and term statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.operators import corpus as op
from papertide.operators.records import with_version_type
from papertide.plans.registry import query
from papertide.sources import tables as t

SCOPED_SQL = """scoped_v AS (SELECT p.*, CASE WHEN source_scope = 'preprint' OR source = 'arxiv' OR journal = 'arXiv' THEN 'preprint' ELSE coalesce(j.bucket, 'unknown') END AS bucket,
 CASE WHEN source_scope = 'preprint' OR source = 'arxiv' OR journal = 'arXiv' THEN 1.0 ELSE coalesce(j.weight, 1.5) END AS weight, j.bucket AS journal_bucket
 FROM papers_v p LEFT JOIN journals_v j ON lower(p.journal) = lower(j.name))"""
SCOPES_SQL = "scopes_v(bucket, corpus_scope) AS (VALUES ('core', 'core'), ('core', 'core_context'), ('core', 'all'), ('context', 'core_context'), ('context', 'all'), ('unknown', 'core_context'), ('unknown', 'all'), ('preprint', 'all'))"
BASE_SQL = f"WITH {t.PAPERS_SQL}, {t.JOURNALS_SQL}, {SCOPED_SQL}, {SCOPES_SQL}"
STATS_SQL = f"""{BASE_SQL}, {t.TERMS_SQL},
once AS (SELECT DISTINCT paper_id, normalized_term AS term FROM terms_v),
totals AS (SELECT month, corpus_scope, count(*) AS n, sum(weight) AS w FROM scoped_v JOIN scopes_v USING (bucket) GROUP BY ALL),
freq AS (SELECT term, month, corpus_scope, count(*) AS raw_freq, sum(weight) AS weighted_freq, CAST(sum(cited_by_count) AS BIGINT) AS citation_sum, count(DISTINCT journal) AS journals,
 CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS m
 FROM once JOIN scoped_v USING (paper_id) JOIN scopes_v USING (bucket) GROUP BY ALL),
stats_v AS (SELECT term, month, corpus_scope, raw_freq, weighted_freq, citation_sum, journals, raw_freq / n AS raw_share, weighted_freq / w AS weighted_share,
 ln(1 + weighted_freq) * least((sum(weighted_freq) OVER (PARTITION BY term, corpus_scope ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) + 1)
  / (coalesce(sum(weighted_freq) OVER (PARTITION BY term, corpus_scope ORDER BY m RANGE BETWEEN 8 PRECEDING AND 3 PRECEDING), 0) + 1), 4.0)
  * (1 + 0.35 * least(ln(1 + citation_sum / raw_freq), 3.0)) AS momentum
 FROM freq JOIN totals USING (month, corpus_scope))"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def stats(spark, d) -> DataFrame:
    return op.term_month(t.papers(spark, d), t.terms(spark, d), t.journals(spark))


@query("scope_counts", f"{BASE_SQL} SELECT corpus_scope, count(*) AS papers, round(sum(weight), 6) AS weight FROM scoped_v JOIN scopes_v USING (bucket) GROUP BY 1")
def scope_counts(spark, d):
    small = op.with_journal(t.papers(spark, d), t.journals(spark)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return op.with_scopes(small).groupBy("corpus_scope").agg(F.sum("n").alias("papers"), F.round(F.sum("w"), 6).alias("weight"))


@query("journal_resolve", f"WITH {t.PAPERS_SQL}, a(alias, name) AS (VALUES ('journal a', 'Journal A'), ('journal b', 'Journal B'), ('JOURNAL C', 'Journal C')) SELECT p.journal, a.name, count(*) AS papers FROM papers_v p LEFT JOIN a ON lower(trim(p.journal)) = lower(a.alias) GROUP BY 1, 2")
def journal_resolve(spark, d):
    aliases = spark.createDataFrame([("journal a", "Journal A"), ("journal b", "Journal B"), ("JOURNAL C", "Journal C")], "alias string, name string")
    return op.resolve_journal(t.papers(spark, d), aliases).groupBy("journal", "name").agg(F.count("*").alias("papers"))


@query("preset_counts", f"""{BASE_SQL}, s AS (SELECT *, data_mode = 'real' AND view_eligible AS strict, coalesce(journal_bucket, 'unknown') AS b FROM scoped_v)
SELECT preset, count(*) AS papers FROM (SELECT unnest([CASE WHEN strict AND b = 'core' AND source_scope = 'published' THEN 'strict_core_published' END, CASE WHEN strict AND b = 'context' AND source_scope = 'published' THEN 'strict_context_published' END,
 CASE WHEN strict AND b IN ('core', 'context') AND source_scope = 'published' THEN 'strict_core_plus_context_published' END, CASE WHEN strict AND (source_scope = 'preprint' OR source = 'arxiv' OR journal = 'arXiv') THEN 'arxiv_preprint' END,
 CASE WHEN data_mode = 'real' AND b = 'core' THEN 'core_all' END, CASE WHEN data_mode = 'mock' THEN 'mock' END, CASE WHEN data_mode = 'real' THEN 'all_real' END, CASE WHEN data_mode = 'real' THEN 'published_vs_preprint' END, CASE WHEN strict AND b = 'core' AND source_scope = 'published' THEN 'strict' END]) AS preset FROM s) WHERE preset IS NOT NULL GROUP BY 1""")
def preset_counts(spark, d):
    known = F.broadcast(t.journals(spark).select(F.col("name").alias("journal"), F.col("bucket").alias("journal_bucket")))
    papers = t.papers(spark, d).join(known, "journal", "left")
    parts = [op.preset_filter(papers, p).select(F.lit(p).alias("preset")) for p in op.PRESETS]
    return reduce(DataFrame.unionByName, parts).groupBy("preset").agg(F.count("*").alias("papers"))


@query("mode_counts", f"WITH {t.PAPERS_SQL} SELECT mode, count(*) AS papers FROM (SELECT unnest([data_mode, 'mixed']) AS mode FROM papers_v) GROUP BY 1")
def mode_counts(spark, d):
    small = t.papers(spark, d).groupBy("data_mode").agg(F.count("*").alias("n"))
    return op.by_mode(small).groupBy("mode").agg(F.sum("n").alias("papers"))


@query("monthly_corpus", f"""{BASE_SQL} SELECT month, corpus_scope, mode AS data_mode, count(*) AS paper_count, round(sum(weight), 6) AS weighted_count
FROM (SELECT *, unnest([data_mode, 'mixed']) AS mode FROM scoped_v) JOIN scopes_v USING (bucket) GROUP BY 1, 2, 3""")
def monthly_corpus(spark, d):
    return rounded(op.monthly_corpus(t.papers(spark, d), t.journals(spark)), "weighted_count")


@query("term_month_sparse", f"{STATS_SQL} SELECT term, month, corpus_scope, raw_freq, round(weighted_freq, 6) AS weighted_freq, citation_sum, journals, round(raw_share, 9) AS raw_share, round(weighted_share, 9) AS weighted_share, round(momentum, 6) AS momentum FROM stats_v")
def term_month_sparse(spark, d):
    found = stats(spark, d).withColumns({c: F.round(c, 9) for c in ("raw_share", "weighted_share")})
    return rounded(found, "weighted_freq", "momentum")


@query("momentum", f"{STATS_SQL} SELECT term, month, round(momentum, 6) AS momentum FROM stats_v WHERE corpus_scope = 'all'")
def momentum(spark, d):
    return rounded(stats(spark, d).filter("corpus_scope = 'all'").select("term", "month", "momentum"), "momentum")


@query("term_flags", f"""WITH {t.TERMS_SQL}, r AS (SELECT normalized_term AS term, CASE WHEN display_eligible = 1 THEN 'canonical' WHEN confidence < 0.7 THEN 'weak' ELSE 'not_canonical' END AS display_reason, count(*) AS n, max(display_eligible) AS e FROM terms_v GROUP BY 1, 2)
SELECT term, max(e) AS display_eligible, arg_min(display_reason, (-n, display_reason)) AS display_reason FROM r GROUP BY 1""")
def term_flags(spark, d):
    reason = F.when(F.col("display_eligible") == 1, "canonical").when(F.col("confidence") < 0.7, "weak").otherwise("not_canonical")
    return op.term_flags(t.terms(spark, d).select(F.col("normalized_term").alias("term"), reason.alias("display_reason"), "display_eligible"))


@query("distributions", f"""WITH {t.PAPERS_SQL}, a AS (SELECT count(*) AS n FROM papers_v), l AS (SELECT unnest(['journal', 'source', 'year', 'confidence', 'source_scope']) AS field, unnest([journal, source, CAST(year AS VARCHAR), confidence, source_scope]) AS value FROM papers_v)
SELECT field, value, count(*) AS papers, round(count(*) / max(a.n), 6) AS share FROM l, a GROUP BY 1, 2""")
def distributions(spark, d):
    papers = t.papers(spark, d)
    fields = ("journal", "source", "year", "confidence", "source_scope")
    return rounded(reduce(DataFrame.unionByName, [op.distribution(papers, f).select(F.lit(f).alias("field"), "*") for f in fields]), "share")


@query("corpus_summary", f"""{BASE_SQL} SELECT bucket, count(*) AS papers, count(*) FILTER (view_eligible) AS eligible, count(*) FILTER (source_scope = 'preprint') AS preprints, count(doi) AS with_doi, min(month) AS first_month, max(month) AS last_month FROM scoped_v GROUP BY 1""")
def corpus_summary(spark, d):
    return op.with_journal(t.papers(spark, d), t.journals(spark)).groupBy("bucket").agg(
        F.count("*").alias("papers"), F.count_if("view_eligible").alias("eligible"), F.count_if(F.col("source_scope") == "preprint").alias("preprints"),
        F.count("doi").alias("with_doi"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
    )


@query("quality_audit", f"""WITH {t.PAPERS_SQL} SELECT count(*) AS total, count(*) FILTER (abstract <> '') AS abstract, count(doi) AS doi, count(*) FILTER (is_open_access) AS open_access, count(*) FILTER (view_eligible) AS eligible,
 round(count(*) FILTER (abstract <> '') / count(*), 6) AS abstract_share, round(count(doi) / count(*), 6) AS doi_share, round(count(*) FILTER (is_open_access) / count(*), 6) AS open_access_share, round(count(*) FILTER (view_eligible) / count(*), 6) AS eligible_share FROM papers_v""")
def quality_audit(spark, d):
    found = op.coverage(t.papers(spark, d), abstract=F.col("abstract") != "", doi=F.col("doi").isNotNull(), open_access=F.col("is_open_access"), eligible=F.col("view_eligible"))
    return rounded(found, "abstract_share", "doi_share", "open_access_share", "eligible_share")


@query("corpus_report", f"""WITH {t.PAPERS_SQL}, {t.TERMS_SQL} SELECT source, count(*) AS papers, count(doi) AS with_doi, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS with_terms, sum(coalesce(n, 0))::BIGINT AS terms FROM papers_v LEFT JOIN (SELECT paper_id, count(*) AS n FROM terms_v WHERE display_eligible = 1 GROUP BY 1) USING (paper_id) GROUP BY 1""")
def corpus_report(spark, d):
    counted = t.terms(spark, d).filter("display_eligible = 1").groupBy("paper_id").agg(F.count("*").alias("n"))
    return t.papers(spark, d).join(counted, "paper_id", "left").groupBy("source").agg(
        F.count("*").alias("papers"), F.count("doi").alias("with_doi"), F.count_if(F.col("n") > 0).alias("with_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")
    )


@query("term_summary", f"{STATS_SQL} SELECT term, min(month) AS first_month, max(month) AS last_month, arg_min(month, (-raw_freq, month)) AS peak_month, CAST(sum(raw_freq) AS BIGINT) AS papers, count(*) AS months FROM stats_v WHERE corpus_scope = 'all' GROUP BY 1")
def term_summary(spark, d):
    return stats(spark, d).filter("corpus_scope = 'all'").groupBy("term").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.min_by("month", F.struct(-F.col("raw_freq"), F.col("month"))).alias("peak_month"),
        F.sum("raw_freq").alias("papers"), F.count("*").alias("months"),
    )


_METRICS = ("raw_freq", "weighted_freq", "raw_share", "weighted_share", "momentum")


@query("top_terms", f"""{STATS_SQL}, n AS (SELECT date_diff('month', min(CAST(concat(month, '-01') AS DATE)), max(CAST(concat(month, '-01') AS DATE))) + 1 AS months FROM stats_v WHERE corpus_scope = 'all'),
s AS (SELECT term, CAST(sum(raw_freq) AS DOUBLE) AS raw_freq, sum(weighted_freq) AS weighted_freq, sum(raw_share) / max(months) AS raw_share, sum(weighted_share) / max(months) AS weighted_share, max(momentum) AS momentum, sum(raw_freq) AS k FROM stats_v, n WHERE corpus_scope = 'all' GROUP BY 1 HAVING sum(raw_freq) >= 2),
""" + "SELECT metric, rank, term, round(value, 6) AS value FROM (SELECT metric, term, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY round(value, 9) DESC, term) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, term, {m} AS value FROM s" for m in _METRICS) + ")) WHERE rank <= 20")
def top_terms(spark, d):
    rows = stats(spark, d).filter("corpus_scope = 'all'")
    found = None
    for metric in _METRICS:
        best = op.top_terms(rows, metric, 20).withColumn("metric", F.lit(metric)).withColumn("value", F.round("value", 6))
        found = best if found is None else found.unionByName(best)
    return found.select("metric", "rank", "term", "value")


@query("top_terms_by_type", f"WITH {t.TERMS_SQL} SELECT term_type, term, papers FROM (SELECT term_type, normalized_term AS term, count(*) AS papers, row_number() OVER (PARTITION BY term_type ORDER BY count(*) DESC, normalized_term) AS r FROM terms_v GROUP BY 1, 2) WHERE r <= 10")
def top_terms_by_type(spark, d):
    counted = t.terms(spark, d).groupBy("term_type", F.col("normalized_term").alias("term")).agg(F.count("*").alias("papers"))
    ranked = counted.withColumn("r", F.expr("row_number() over (partition by term_type order by papers desc, term)"))
    return ranked.filter("r <= 10").drop("r")


@query("concept_search", f"WITH {t.TERMS_SQL} SELECT normalized_term AS term, count(*) AS papers FROM terms_v WHERE term_type = 'concept' AND normalized_term ILIKE '%blue%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def concept_search(spark, d):
    found = t.terms(spark, d).filter((F.col("term_type") == "concept") & F.col("normalized_term").ilike("%blue%"))
    return found.groupBy(F.col("normalized_term").alias("term")).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "term").limit(10)


def for_concepts(terms: DataFrame, wanted: list[str], every: bool) -> DataFrame:
    if not 1 <= len(wanted) <= 8:
        raise ValueError("one to eight concepts")
    hits = terms.filter(F.col("normalized_term").isin(wanted)).groupBy("paper_id").agg(F.countDistinct("normalized_term").alias("matched"))
    return hits.filter(F.col("matched") >= (len(wanted) if every else 1))


_TWO = "(SELECT normalized_term FROM terms_v WHERE term_type = 'material' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)"


def _two(spark, d) -> list[str]:
    top = t.terms(spark, d).filter("term_type = 'material'").groupBy("normalized_term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "normalized_term").limit(2)
    return [r["normalized_term"] for r in top.collect()]


@query("compare_papers_and", f"WITH {t.TERMS_SQL} SELECT paper_id, count(DISTINCT normalized_term) AS matched FROM terms_v WHERE normalized_term IN {_TWO} GROUP BY 1 HAVING count(DISTINCT normalized_term) >= 2")
def compare_papers_and(spark, d):
    return for_concepts(t.terms(spark, d), _two(spark, d), True)


@query("compare_papers_or", f"WITH {t.TERMS_SQL} SELECT paper_id, count(DISTINCT normalized_term) AS matched FROM terms_v WHERE normalized_term IN {_TWO} GROUP BY 1")
def compare_papers_or(spark, d):
    return for_concepts(t.terms(spark, d), _two(spark, d), False)


@query("papers_momentum", f"""{STATS_SQL}, v AS (SELECT DISTINCT paper_id, normalized_term AS term FROM terms_v WHERE paper_id IN (SELECT paper_id FROM terms_v WHERE display_eligible = 1))
SELECT paper_id, round(sum(coalesce(s.momentum, 0)), 5) AS score FROM v JOIN papers_v p USING (paper_id) LEFT JOIN stats_v s ON s.term = v.term AND s.month = p.month AND s.corpus_scope = 'all' WHERE p.confidence <> 'low' GROUP BY 1""")
def papers_momentum(spark, d):
    terms = t.terms(spark, d)
    shown = terms.groupBy("paper_id").agg(F.max("display_eligible").alias("shown")).filter("shown = 1")  # all terms of a paper that shows one
    visible = terms.join(shown, "paper_id").select("paper_id", F.col("normalized_term").alias("term")).distinct()
    papers = t.papers(spark, d).filter("confidence <> 'low'").select("paper_id", "month")
    scores = stats(spark, d).filter("corpus_scope = 'all'").select("term", "month", "momentum")
    joined = visible.join(papers, "paper_id").join(scores, ["term", "month"], "left")
    return joined.groupBy("paper_id").agg(F.round(F.sum(F.coalesce("momentum", F.lit(0.0))), 5).alias("score"))


@query("version_types", f"""WITH {t.PAPERS_SQL}, p AS (SELECT *, CAST(paper_id AS BIGINT) AS i FROM papers_v) SELECT CASE WHEN i % 10 = 0 THEN 'repository' WHEN i % 10 = 1 THEN 'published' WHEN i % 3 = 0 AND doi IS NULL AND (source = 'arxiv' OR journal = 'arXiv') THEN 'preprint' WHEN doi IS NOT NULL THEN 'published' WHEN i % 7 = 0 AND source <> 'arxiv' THEN 'imported' ELSE 'metadata' END AS derived,
 source, count(*) AS papers FROM p GROUP BY 1, 2""")
def version_types(spark, d):
    i = F.col("paper_id").cast("long")
    papers = t.papers(spark, d).withColumns({"version_type": F.when(i % 10 == 0, " Repository").when(i % 10 == 1, "PUBLISHED").otherwise("article"), "arxiv_id": F.when(i % 3 == 0, F.concat(F.lit("arXiv:1500."), "paper_id"))})
    other = papers.withColumns({"given": F.col("source"), "source": F.when((i % 7 == 0) & (F.col("source") != "arxiv"), "legacy_intake").otherwise(F.col("source"))})
    return with_version_type(other).groupBy(F.col("version_type").alias("derived"), F.col("given").alias("source")).agg(F.count("*").alias("papers"))
