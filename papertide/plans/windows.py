"""Two-window analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import windows as op
from papertide.plans.corpus import rounded
from papertide.plans.registry import query
from papertide.sources import tables as t
from papertide.sources.scratch import saved

LAST, DAYS = "1998-06-30", 180
EVENTS_SQL = f"""WITH {t.PAPERS_SQL}, {t.VERSIONS_SQL}, events_v AS (SELECT v.version_id, v.version_type, v.source, p.paper_id, p.abstract, p.doi, p.is_open_access, p.cited_by_count, p.source AS paper_source,
 coalesce(CASE WHEN v.version_type = 'preprint' THEN v.submitted_date END, v.publication_date, v.submitted_date, p.pub_date) AS paper_date
 FROM (SELECT * FROM papers_v WHERE view_eligible AND data_mode = 'real') p JOIN versions_v v ON v.canonical_paper_id = p.paper_id)"""
OUT_SQL = f"""{EVENTS_SQL}, out_v AS (SELECT *, CASE WHEN research_date >= DATE '1998-01-02' THEN 'current' ELSE 'baseline' END AS window_name FROM (SELECT paper_id, min(paper_date) AS research_date, CAST(max(CASE WHEN version_type = 'preprint' THEN 1 ELSE 0 END) AS INTEGER) AS has_preprint,
 CAST(max(CASE WHEN version_type IN ('publication', 'published') THEN 1 ELSE 0 END) AS INTEGER) AS has_publication, CAST(max(CASE WHEN trim(coalesce(abstract, '')) <> '' THEN 1 ELSE 0 END) AS INTEGER) AS has_abstract, CAST(max(CASE WHEN coalesce(doi, '') <> '' THEN 1 ELSE 0 END) AS INTEGER) AS has_doi,
 CAST(max(CASE WHEN is_open_access THEN 1 ELSE 0 END) AS INTEGER) AS is_open_access, max(coalesce(cited_by_count, 0)) AS cited_by_count FROM events_v WHERE paper_date <= DATE '1998-06-30' GROUP BY 1) WHERE research_date BETWEEN DATE '1997-07-06' AND DATE '1998-06-30')"""
SRC_SQL = f"""{OUT_SQL}, src_v AS (SELECT DISTINCT o.paper_id, o.window_name, CASE WHEN e.source = 'legacy' THEN e.paper_source ELSE e.source END AS source_name FROM out_v o JOIN events_v e USING (paper_id))"""
MIX_SQL = f"""{SRC_SQL}, mix AS (SELECT source_name, count(*) FILTER (window_name = 'current') AS current, count(*) FILTER (window_name = 'baseline') AS baseline FROM src_v GROUP BY 1)"""
LINK_SQL = f"{t.TERMS_SQL}, link_v AS (SELECT DISTINCT paper_id, normalized_term AS term FROM terms_v WHERE term_type = 'concept' AND display_eligible = 1)"


def events(spark, d):
    return op.version_events(t.papers(spark, d).filter("view_eligible and data_mode = 'real'"), t.versions(spark, d))


def outputs(spark, d):
    return op.canonical_outputs(events(spark, d), LAST, DAYS)


def sources(spark, d):
    return both(spark, d)[1]


def both(spark, d):
    """Outputs and their sources; the events are made once, only as wide as both need."""
    seen = kept(events(spark, d).select("paper_id", "version_type", "source", "paper_source", "paper_date", "abstract", "doi", "is_open_access", "cited_by_count"), "events")
    out = op.canonical_outputs(seen, LAST, DAYS)
    return out, op.output_sources(out, seen)


def kept(df, name):
    """Made once where a query reads it several times."""
    return saved(df, name)


def links(spark, d):
    return t.terms(spark, d).filter("term_type = 'concept' and display_eligible = 1").select("paper_id", F.col("normalized_term").alias("term")).distinct()


@query("anchor", f"{EVENTS_SQL} SELECT coalesce(max(paper_date) FILTER (paper_date < DATE '2001-08-01'), max(paper_date) FILTER (paper_date = DATE '2001-08-01')) AS anchor FROM events_v")
def anchor(spark, d):
    return op.anchor(events(spark, d), "2001-08-01")


@query("version_events", f"{EVENTS_SQL} SELECT version_type, source, count(*) AS versions, min(paper_date) AS first_day, max(paper_date) AS last_day FROM events_v WHERE paper_date BETWEEN DATE '1997-07-06' AND DATE '1998-06-30' GROUP BY 1, 2")
def version_events(spark, d):
    inside = events(spark, d).filter(F.col("paper_date").between(F.lit("1997-07-06").cast("date"), F.lit(LAST).cast("date")))
    return inside.groupBy("version_type", "source").agg(F.count("*").alias("versions"), F.min("paper_date").alias("first_day"), F.max("paper_date").alias("last_day"))


@query("canonical_outputs", f"{OUT_SQL} SELECT * FROM out_v")
def canonical_outputs(spark, d):
    return outputs(spark, d)


@query("output_sources", f"{SRC_SQL} SELECT * FROM src_v")
def output_sources(spark, d):
    return sources(spark, d)


@query("window_summary", f"{OUT_SQL} SELECT window_name, count(*) AS papers, CAST(sum(has_preprint) AS BIGINT) AS preprints, CAST(sum(has_publication) AS BIGINT) AS publications, round(avg(has_abstract), 9) AS abstract_share, round(avg(has_doi), 9) AS doi_share, round(avg(is_open_access), 9) AS open_share FROM out_v GROUP BY 1")
def window_summary(spark, d):
    share = lambda c, name: F.round(F.avg(c), 9).alias(name)
    return outputs(spark, d).groupBy("window_name").agg(
        F.count("*").alias("papers"), F.sum("has_preprint").alias("preprints"), F.sum("has_publication").alias("publications"),
        share("has_abstract", "abstract_share"), share("has_doi", "doi_share"), share("is_open_access", "open_share"),
    )


@query("source_mix", f"{MIX_SQL} SELECT source_name, current, baseline, round(current / sum(current) OVER (), 9) AS current_share, round(baseline / sum(baseline) OVER (), 9) AS baseline_share, current >= 10 AND baseline >= 10 AS comparable FROM mix")
def source_mix(spark, d):
    return op.source_mix(sources(spark, d)).withColumns({c: F.round(c, 9) for c in ("current_share", "baseline_share")})


@query("source_overlap", f"{SRC_SQL} SELECT x.source_name AS a, y.source_name AS b, count(*) AS papers FROM src_v x JOIN src_v y USING (paper_id) GROUP BY 1, 2")
def source_overlap(spark, d):
    return op.source_overlap(sources(spark, d))


_COUNTS = f"""{OUT_SQL}, {LINK_SQL}, n AS (SELECT count(*) FILTER (window_name = 'current') AS current_total, count(*) FILTER (window_name = 'baseline') AS baseline_total, count(*) AS n FROM out_v), i AS (SELECT * FROM link_v JOIN out_v USING (paper_id)),
c AS (SELECT term, count(*) FILTER (window_name = 'current') AS current, count(*) FILTER (window_name = 'baseline') AS baseline FROM i GROUP BY 1),
r AS (SELECT *, (SELECT count(DISTINCT paper_id) FROM i) / n AS coverage FROM c, n),
m AS (SELECT *, least(1.0, sqrt((current + baseline) / 20)) * greatest(0, least(1, coverage)) AS reliability, log2(((current + 0.5) / (current_total + 1)) / ((baseline + 0.5) / (baseline_total + 1))) AS ratio FROM r),
k AS (SELECT *, 100 * (exp(ratio) - 1) / (exp(ratio) + 1) * reliability AS momentum FROM m)"""


@query("two_window", f"""{_COUNTS} SELECT term, current, baseline, round(reliability, 6) AS reliability, round(momentum, 6) AS momentum, CASE WHEN current < 3 OR current_total < 5 OR baseline_total < 5 THEN 'insufficient_evidence' WHEN momentum >= 15 THEN CASE WHEN baseline = 0 THEN 'emerging' ELSE 'rising' END WHEN momentum <= -15 THEN 'cooling' ELSE 'stable' END AS status,
round(greatest(0, momentum) * 0.55 + least(100, 25 * ln(1 + current)) * 0.45, 6) AS heat_score FROM k""")
def two_window(spark, d):
    out = kept(outputs(spark, d), "outputs")
    found = op.two_window_momentum(op.window_counts(out, kept(links(spark, d).join(out.select("paper_id"), "paper_id", "left_semi"), "links")))
    return rounded(found.select("term", "current", "baseline", "reliability", "momentum", "status", "heat_score"), "reliability", "momentum", "heat_score")


@query("entity_trends", f"""{MIX_SQL}, {LINK_SQL}, n AS (SELECT count(*) FILTER (window_name = 'current') AS ct, count(*) FILTER (window_name = 'baseline') AS bt, count(*) FILTER (window_name = 'current' AND k) AS kc, count(*) FILTER (window_name = 'baseline' AND k) AS kb FROM (SELECT *, paper_id IN (SELECT paper_id FROM link_v) AS k FROM out_v)),
fr AS (SELECT *, greatest(2, ceil(ct * 0.002)) AS least_n, greatest(2, least(10, ceil(least(ct, bt) * 0.02))) AS fl, kc / ct AS cover_c, kb / bt AS cover_b FROM n), sh AS (SELECT source_name, current AS cn, baseline AS bn FROM mix, fr WHERE current >= fl AND baseline >= fl),
po AS (SELECT sum(cn) AS sc, sum(bn) AS sb, sum(cn + bn) AS pooled, sum((cn + bn) * (cn + bn)) / sum(cn + bn) / 2 AS en FROM sh), c AS (SELECT term, count(*) FILTER (window_name = 'current') AS current, count(*) FILTER (window_name = 'baseline') AS baseline FROM link_v JOIN out_v USING (paper_id) GROUP BY 1),
s AS (SELECT term, source_name, count(*) FILTER (window_name = 'current') AS c, count(*) FILTER (window_name = 'baseline') AS b FROM link_v JOIN src_v USING (paper_id) GROUP BY 1, 2), p AS (SELECT term, CAST(sum(c) AS BIGINT) AS cc, CAST(sum(b) AS BIGINT) AS cb, sum((cn + bn) * c / cn) AS wc, sum((cn + bn) * b / bn) AS wb FROM s JOIN sh USING (source_name) GROUP BY 1),
q AS (SELECT term, current, baseline, coalesce(cc, 0) AS comparable_current, coalesce(cb, 0) AS comparable_baseline, coalesce(wc / pooled, 0) AS current_share, coalesce(wb / pooled, 0) AS baseline_share, 0.5 / greatest(1, coalesce(en, 0)) AS prior, ct, bt, least_n, cover_c, cover_b, coalesce(pooled, 0) AS pooled, least(1.0, sc / ct, sb / bt) AS support FROM c LEFT JOIN p USING (term), fr, po WHERE current >= least_n OR current + baseline >= least_n * 2),
g AS (SELECT *, cover_c >= 0.6 AND cover_b >= 0.6 AND abs(cover_c - cover_b) <= 0.15 AS even, pooled = 0 OR comparable_current + comparable_baseline < least_n AS conf, least(1.0, sqrt((comparable_current + comparable_baseline) / 20)) * least(cover_c, cover_b) * sqrt(greatest(0, coalesce(support, 0))) AS shrunk, log2((current_share + prior) / (baseline_share + prior)) AS ratio FROM q),
r AS (SELECT *, CASE WHEN conf OR NOT even THEN 0 ELSE shrunk END AS reliability, CASE WHEN conf OR NOT even THEN 0 ELSE 100 * (exp(ratio) - 1) / (exp(ratio) + 1) * shrunk END AS momentum FROM g)
SELECT term, current, baseline, comparable_current, comparable_baseline, round(current_share, 9) AS current_share, round(baseline_share, 9) AS baseline_share, round(reliability, 6) AS reliability, round(momentum, 6) AS momentum,
CASE WHEN NOT even THEN 'insufficient_evidence' WHEN conf THEN 'source_mix_confounded' WHEN current < least_n OR ct < 5 OR bt < 5 THEN 'insufficient_evidence' WHEN momentum >= 15 THEN CASE WHEN comparable_baseline = 0 THEN 'emerging' ELSE 'rising' END WHEN momentum <= -15 THEN 'cooling' ELSE 'stable' END AS status,
round(CASE WHEN conf OR NOT even THEN least(15, 3 * ln(1 + current)) ELSE greatest(0, momentum) * 0.55 + least(100, 25 * ln(1 + comparable_current)) * 0.45 END, 6) AS heat_score FROM r""")
def entity_trends(spark, d):
    out, found = both(spark, d)
    out = kept(out, "outputs")
    inside = kept(links(spark, d).join(out.select("paper_id"), "paper_id", "left_semi"), "links")
    found = op.source_trends(out, kept(found, "output-sources"), inside)
    return found.withColumns({c: F.round(c, 9) for c in ("current_share", "baseline_share")} | {c: F.round(c, 6) for c in ("reliability", "momentum", "heat_score")})


_COVER = lambda k: f"count(*) FILTER (window_name = 'current' AND paper_id IN (SELECT paper_id FROM terms_v WHERE term_type = '{k}' AND display_eligible = 1)) / count(*) FILTER (window_name = 'current') AS {k}_c, count(*) FILTER (window_name = 'baseline' AND paper_id IN (SELECT paper_id FROM terms_v WHERE term_type = '{k}' AND display_eligible = 1)) / count(*) FILTER (window_name = 'baseline') AS {k}_b"
_GATE = lambda k: f"common AND {k}_c >= 0.6 AND {k}_b >= 0.6 AND abs({k}_c - {k}_b) <= 0.15"


@query("reliability", f"""{MIX_SQL}, {t.TERMS_SQL}, n AS (SELECT count(*) FILTER (window_name = 'current') AS ct, count(*) FILTER (window_name = 'baseline') AS bt, max(research_date) AS last, sum(has_abstract) FILTER (window_name = 'current') AS told, {_COVER('concept')}, {_COVER('material')}, {_COVER('method')} FROM out_v),
sh AS (SELECT sum(abs(current / tc - baseline / tb)) / 2 AS shift FROM mix, (SELECT sum(current) AS tc, sum(baseline) AS tb FROM mix)), m AS (SELECT count(*) FILTER (k > 1) AS several FROM (SELECT paper_id, count(*) AS k FROM src_v WHERE window_name = 'current' GROUP BY 1)), pr AS (SELECT count(DISTINCT source_name) AS providers FROM src_v WHERE window_name = 'current'),
r AS (SELECT *, ct / bt AS volume_ratio, told / ct AS abstract_coverage, greatest(0, date_diff('day', last, DATE '1998-06-30')) AS stale_days, several / ct AS multi_source, several / ct >= 0.25 AND providers >= 3 AS overlap FROM n, sh, m, pr),
g AS (SELECT *, ct >= 100 AND bt >= 100 AND volume_ratio BETWEEN 0.5 AND 2 AND abstract_coverage >= 0.7 AND shift <= 0.15 AND stale_days <= 3 AND overlap AS common FROM r)
SELECT round(volume_ratio, 9) AS volume_ratio, round(abstract_coverage, 9) AS abstract_coverage, round(shift, 9) AS source_shift, stale_days, round(multi_source, 9) AS multi_source, providers, overlap, common, {_GATE('concept')} AS concept, {_GATE('material')} AS material, {_GATE('method')} AS method, CASE WHEN ({_GATE('concept')}) AND ({_GATE('material')}) AND ({_GATE('method')}) THEN 'pass' ELSE 'caution' END AS verdict FROM g""")
def reliability(spark, d):
    out, found = both(spark, d)
    out, found = kept(out, "outputs"), kept(found, "output-sources")
    terms = kept(t.terms(spark, d).filter("display_eligible = 1").join(out.select("paper_id"), "paper_id", "left_semi").select("paper_id", "term_type").distinct(), "covered")
    by_kind = {k: terms.filter(F.col("term_type") == k).select("paper_id") for k in ("concept", "material", "method")}
    gates = op.release_gates(out, found, by_kind, LAST)
    return gates.withColumns({c: F.round(c, 9) for c in ("volume_ratio", "abstract_coverage", "source_shift", "multi_source")})


@query("pathways", f"""{EVENTS_SQL}, f AS (SELECT paper_id, min(paper_date) FILTER (version_type = 'preprint') AS pre, min(paper_date) FILTER (version_type = 'published') AS pub FROM events_v GROUP BY 1),
k AS (SELECT *, CASE WHEN pre IS NOT NULL AND pub IS NOT NULL THEN 'linked' WHEN pre IS NOT NULL THEN 'preprint_only' WHEN pub IS NOT NULL THEN 'publication_only' END AS pathway FROM f) SELECT pathway, count(*) AS papers, median(CASE WHEN pathway = 'linked' THEN greatest(date_diff('day', pre, pub), 0) END) AS median_lag FROM k WHERE pathway IS NOT NULL GROUP BY 1""")
def pathways(spark, d):
    return op.pathways(events(spark, d))


@query("quality_timeline", f"{OUT_SQL} SELECT CAST(date_trunc('week', research_date) AS DATE) AS period, count(*) AS papers, CAST(sum(has_abstract) AS BIGINT) AS with_abstract, CAST(sum(has_doi) AS BIGINT) AS with_doi FROM out_v GROUP BY 1")
def quality_timeline(spark, d):
    return outputs(spark, d).groupBy(F.trunc("research_date", "week").alias("period")).agg(F.count("*").alias("papers"), F.sum("has_abstract").alias("with_abstract"), F.sum("has_doi").alias("with_doi"))


@query("timeline", f"{OUT_SQL} SELECT CAST(x AS DATE) AS day, count(paper_id) AS papers, CAST(coalesce(sum(has_preprint), 0) AS BIGINT) AS preprints, CAST(coalesce(sum(has_publication), 0) AS BIGINT) AS publications FROM generate_series(DATE '1998-01-02', DATE '1998-06-30', INTERVAL 1 DAY) g(x) LEFT JOIN out_v ON research_date = CAST(x AS DATE) GROUP BY 1")
def timeline(spark, d):
    return op.daily(outputs(spark, d), LAST, DAYS)


@query("citation_hist", f"{OUT_SQL} SELECT CASE WHEN cited_by_count = 0 THEN '0' WHEN cited_by_count < 5 THEN '1-4' WHEN cited_by_count < 20 THEN '5-19' WHEN cited_by_count < 100 THEN '20-99' ELSE '100+' END AS bucket, count(*) AS papers FROM out_v GROUP BY 1")
def citation_hist(spark, d):
    n = F.col("cited_by_count")
    bucket = F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")
    return outputs(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("papers"))


@query("top_materials", f"{OUT_SQL}, {t.TERMS_SQL} SELECT normalized_term AS material, count(DISTINCT paper_id) AS papers, count(DISTINCT CASE WHEN has_preprint = 1 THEN paper_id END) AS preprints, count(DISTINCT CASE WHEN has_publication = 1 THEN paper_id END) AS publications FROM terms_v JOIN out_v USING (paper_id) WHERE term_type = 'material' AND window_name = 'current' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_materials(spark, d):
    rows = t.terms(spark, d).filter("term_type = 'material'").join(outputs(spark, d).filter("window_name = 'current'"), "paper_id")
    counted = rows.groupBy(F.col("normalized_term").alias("material")).agg(F.count("*").alias("papers"), F.sum("has_preprint").alias("preprints"), F.sum("has_publication").alias("publications"))
    return counted.orderBy(F.desc("papers"), "material").limit(15)


@query("type_coverage", f"{OUT_SQL}, {t.TERMS_SQL} SELECT term_type, count(DISTINCT paper_id) AS papers, round(count(DISTINCT paper_id) / (SELECT count(*) FROM out_v), 9) AS share FROM terms_v JOIN out_v USING (paper_id) GROUP BY 1")
def type_coverage(spark, d):
    out = outputs(spark, d)
    counted = t.terms(spark, d).select("paper_id", "term_type").distinct().join(out, "paper_id").groupBy("term_type").agg(F.count("*").alias("papers"))
    return counted.crossJoin(F.broadcast(out.agg(F.count("*").alias("n")))).select("term_type", "papers", F.round(F.col("papers") / F.col("n"), 9).alias("share"))


COVER_SQL = f"""WITH {t.PAPERS_SQL}, {t.VERSIONS_SQL}, ks AS (SELECT canonical_paper_id AS paper_id, source FROM versions_v WHERE source <> 'legacy' UNION SELECT paper_id, source FROM papers_v), cov AS (SELECT p.paper_id, p.doi, list_sort(list(ks.source)) AS sources FROM papers_v p JOIN ks USING (paper_id) GROUP BY 1, 2)"""
PROVIDERS = ("arxiv", "crossref", "openalex")


def covered(spark, d):
    return op.coverage_sources(t.papers(spark, d), t.versions(spark, d))


@query("coverage_audit", f"{COVER_SQL} SELECT array_to_string(sources, '+') AS sources, count(*) AS papers, count(doi) AS with_doi FROM cov GROUP BY 1")
def coverage_audit(spark, d):
    return covered(spark, d).groupBy(F.array_join("sources", "+").alias("sources")).agg(F.count("*").alias("papers"), F.count("doi").alias("with_doi"))


@query("coverage_pairs", f"{COVER_SQL}, n AS (SELECT source, count(*) AS n FROM ks GROUP BY 1), p AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM ks x JOIN ks y ON x.paper_id = y.paper_id AND x.source < y.source GROUP BY 1, 2) SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 9) AS jaccard FROM p JOIN n na ON na.source = a JOIN n nb ON nb.source = b")
def coverage_pairs(spark, d):
    rows = covered(spark, d).select("paper_id", F.explode("sources").alias("source"))
    n = F.broadcast(rows.groupBy("source").agg(F.count("*").alias("n")))
    pairs = rows.select("paper_id", F.col("source").alias("a")).join(rows.select("paper_id", F.col("source").alias("b")), "paper_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = pairs.join(n.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 9).alias("jaccard"))


@query("coverage_gaps", f"""{COVER_SQL}, c AS (SELECT *, CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN concat('1500.', paper_id) END AS arxiv_id FROM cov), g AS (SELECT paper_id, sources, unnest([{{'t': 'crossref', 'l': 'doi', 'v': doi, 'r': 'DOI record has no Crossref observation'}}, {{'t': 'openalex', 'l': 'doi', 'v': doi, 'r': 'DOI record has no OpenAlex observation'}}, {{'t': 'arxiv', 'l': 'arxiv', 'v': arxiv_id, 'r': 'arXiv identity has no arXiv observation'}}]) AS x FROM c)
SELECT paper_id, x.t AS target, x.l AS lookup, x.v AS value, x.r AS reason, sha256(concat_ws('|', paper_id, x.t, x.l, x.v)) AS gap_id FROM g WHERE x.v IS NOT NULL AND NOT list_contains(coalesce(sources, []), x.t)""")
def coverage_gaps(spark, d):
    arxiv = F.when(F.col("paper_id").cast("long") % 3 == 0, F.concat(F.lit("1500."), "paper_id"))
    return op.coverage_gaps(covered(spark, d).withColumn("arxiv_id", arxiv))
