"""Term series, growth, lifecycles and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import corpus as op
from papertide.operators import series as se
from papertide.plans.corpus import STATS_SQL, rounded, stats
from papertide.plans.registry import query
from papertide.sources import tables as t
from papertide.sources.scratch import saved

FIRST, LAST, TREND = "1995-01", "2001-08", "1999-09"
#: Dense calendar of all terms in scope ``all``.
DENSE_SQL = f"""{STATS_SQL}, cal AS (SELECT strftime(m, '%Y-%m') AS month, CAST(year(m) * 12 + month(m) AS INTEGER) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS m)),
dense_v AS (SELECT k.term, c.month, c.n, coalesce(s.raw_freq, 0) AS raw_freq, coalesce(s.weighted_freq, 0) AS weighted_freq FROM (SELECT DISTINCT term FROM stats_v WHERE corpus_scope = 'all') k CROSS JOIN cal c
 LEFT JOIN stats_v s ON s.term = k.term AND s.month = c.month AND s.corpus_scope = 'all')"""
#: The eight materials of most papers.
EIGHT_SQL = "eight AS (SELECT normalized_term AS term FROM terms_v WHERE term_type = 'material' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)"


def all_scope(spark, d):
    return stats(spark, d).filter("corpus_scope = 'all'")


def dense(spark, d):
    return se.densify(all_scope(spark, d), ["term"], ["raw_freq", "weighted_freq"], FIRST, LAST)


def eight(spark, d):
    found = t.terms(spark, d).filter("term_type = 'material'").groupBy(F.col("normalized_term").alias("term")).agg(F.count("*").alias("n"))
    return F.broadcast(found.orderBy(F.desc("n"), "term").limit(8).select("term"))


@query("term_month_dense", f"{DENSE_SQL} SELECT term, month, raw_freq, round(weighted_freq, 6) AS weighted_freq FROM dense_v")
def term_month_dense(spark, d):
    return rounded(dense(spark, d), "weighted_freq")


@query("concept_series", f"{DENSE_SQL}, {EIGHT_SQL} SELECT term, month, raw_freq FROM dense_v SEMI JOIN eight USING (term)")
def concept_series(spark, d):
    return dense(spark, d).join(eight(spark, d), "term").select("term", "month", "raw_freq")


@query("smooth_rolling", f"{DENSE_SQL} SELECT term, month, round(avg(weighted_freq) OVER (PARTITION BY term ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_3, round(avg(weighted_freq) OVER (PARTITION BY term ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling_6 FROM dense_v")
def smooth_rolling(spark, d):
    three = se.rolling(dense(spark, d), ["term"], "weighted_freq", 3).withColumnRenamed("smooth", "rolling_3")
    six = se.rolling(three, ["term"], "weighted_freq", 6).withColumnRenamed("smooth", "rolling_6")
    return rounded(six.select("term", "month", "rolling_3", "rolling_6"), "rolling_3", "rolling_6")


@query("smooth_ewma", f"""WITH RECURSIVE {DENSE_SQL[5:]}, s AS (SELECT term, month, n, CAST(weighted_freq AS DOUBLE) AS v FROM dense_v),
e AS (SELECT term, month, n, v AS smooth FROM s WHERE n = 1995 * 12 + 1 UNION ALL SELECT s.term, s.month, s.n, 0.35 * s.v + 0.65 * e.smooth FROM e JOIN s ON s.term = e.term AND s.n = e.n + 1) SELECT term, month, round(smooth, 6) AS smooth FROM e""")
def smooth_ewma(spark, d):
    return rounded(se.ewma(dense(spark, d), ["term"], "weighted_freq"), "smooth")


@query("compare_zscore", f"{DENSE_SQL}, {EIGHT_SQL} SELECT term, month, round((weighted_freq - avg(weighted_freq) OVER w) / CASE WHEN stddev_pop(weighted_freq) OVER w = 0 THEN 1 ELSE stddev_pop(weighted_freq) OVER w END, 6) AS z FROM dense_v SEMI JOIN eight USING (term) WINDOW w AS (PARTITION BY term)")
def compare_zscore(spark, d):
    return rounded(se.zscore(dense(spark, d).join(eight(spark, d), "term"), ["term"], "weighted_freq").select("term", "month", "z"), "z")


_GROWTH = f"""{STATS_SQL}, s AS (SELECT normalized_term AS term FROM terms_v GROUP BY 1 HAVING max(display_eligible) = 1 AND count(*) FILTER (term_type IN ('method', 'material')) = 0), g AS (SELECT term, sum(CASE WHEN month >= '2001-06' THEN weighted_freq ELSE 0 END) AS recent, sum(CASE WHEN month < '2001-06' THEN weighted_freq ELSE 0 END) AS previous
 FROM stats_v SEMI JOIN s USING (term) WHERE corpus_scope = 'all' AND month BETWEEN '2001-03' AND '2001-08' GROUP BY 1)
SELECT term, round(recent, 6) AS recent, round(previous, 6) AS previous, round((recent + 1) / (previous + 1), 6) AS change FROM g WHERE @@ >= 1 ORDER BY (recent + 1) / (previous + 1)"""


def shown(spark, d):
    """Terms that show, with their class."""
    terms = t.terms(spark, d).groupBy(F.col("normalized_term").alias("term")).agg(F.max("display_eligible").alias("e"), F.collect_set("term_type").alias("types"))
    return terms.filter("e = 1").select("term", concept_class(F.col("types")).alias("concept_class"))


@query("rising", f"{_GROWTH.replace('@@', 'recent')} DESC, term LIMIT 20")
def rising(spark, d):
    return rounded(se.growth_table(all_scope(spark, d), LAST, shown(spark, d), True).orderBy(F.desc("change"), "term").limit(20), "recent", "previous", "change")


@query("cooling", f"{_GROWTH.replace('@@', 'previous')}, term LIMIT 20")
def cooling(spark, d):
    return rounded(se.growth_table(all_scope(spark, d), LAST, shown(spark, d), False).orderBy("change", "term").limit(20), "recent", "previous", "change")


@query("heatmap", f"""{STATS_SQL}, s AS (SELECT normalized_term AS term FROM terms_v GROUP BY 1 HAVING max(display_eligible) = 1 AND count(*) FILTER (term_type = 'method') = 0), c AS (SELECT term, month, raw_freq, momentum FROM stats_v WHERE corpus_scope = 'all' AND month BETWEEN '{TREND}' AND '{LAST}'),
k AS (SELECT term FROM c SEMI JOIN s USING (term) GROUP BY 1 HAVING sum(raw_freq) >= 2 ORDER BY round(sum(momentum), 9) DESC, 1 LIMIT 15) SELECT term, month, round(momentum, 6) AS value FROM c SEMI JOIN k USING (term) WHERE momentum > 0""")
def heatmap(spark, d):
    return rounded(se.heatmap(all_scope(spark, d), TREND, LAST, "momentum", shown(spark, d), without=("method",), top=15), "value")


@query("compare_smoothed", f"""{DENSE_SQL}, {EIGHT_SQL}, z AS (SELECT term, month, n, (weighted_freq - avg(weighted_freq) OVER w) / CASE WHEN stddev_pop(weighted_freq) OVER w = 0 THEN 1 ELSE stddev_pop(weighted_freq) OVER w END AS z FROM dense_v SEMI JOIN eight USING (term) WINDOW w AS (PARTITION BY term))
SELECT term, month, round(avg(z) OVER (PARTITION BY term ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value FROM z""")
def compare_smoothed(spark, d):
    return rounded(se.compare(dense(spark, d).join(eight(spark, d), "term"), ["term"], "weighted_freq", "rolling_3"), "value")


LIFE_SQL = f"""{DENSE_SQL}, b AS (SELECT term, min(CASE WHEN raw_freq > 0 THEN month END) AS first_seen, min(CASE WHEN raw_freq > 0 AND month >= '1999-09' THEN month END) AS trend_first_seen, max(weighted_freq) AS peak_value, arg_min(n, (-weighted_freq, n)) AS peak_n,
 avg(weighted_freq) AS mean, stddev_pop(weighted_freq) AS sigma, CAST(sum(raw_freq) AS BIGINT) AS baseline_total, CAST(sum(CASE WHEN month < '1999-09' THEN raw_freq ELSE 0 END) AS BIGINT) AS before_trend, CAST(sum(CASE WHEN month >= '1999-09' THEN raw_freq ELSE 0 END) AS BIGINT) AS trend_total,
 count(*) FILTER (raw_freq > 0) AS active_months, sum(CASE WHEN month >= '2001-06' THEN weighted_freq ELSE 0 END) AS recent_3m, sum(CASE WHEN month BETWEEN '2001-03' AND '2001-05' THEN weighted_freq ELSE 0 END) AS previous_3m,
 CAST(sum(CASE WHEN month >= '2001-03' THEN raw_freq ELSE 0 END) AS BIGINT) AS recent_6m_count, sum(CASE WHEN month = '2001-08' THEN weighted_freq ELSE 0 END) AS current FROM dense_v GROUP BY 1),
mk AS (SELECT d.*, b.peak_value, b.peak_n, weighted_freq >= greatest(1.0, b.peak_value * 0.2) AS active, weighted_freq > mean + sigma AS high FROM dense_v d JOIN b USING (term)),
sh AS (SELECT term, min(CASE WHEN n > peak_n AND weighted_freq <= peak_value * 0.5 THEN n - peak_n END) AS half_life, coalesce(max(CASE WHEN active THEN n END) - min(CASE WHEN active THEN n END) + 1, 0) AS active_span FROM mk GROUP BY 1),
bu AS (SELECT term, coalesce(max(CASE WHEN high THEN len END), 0) AS burst_months FROM (SELECT term, high, run, count(*) AS len FROM (SELECT term, high, n - row_number() OVER (PARTITION BY term, high ORDER BY n) AS run FROM mk) GROUP BY ALL) GROUP BY 1),
life_v AS (SELECT b.*, half_life, active_span, burst_months, month AS peak_month, 1 / (1 + before_trend) AS novelty FROM b JOIN sh USING (term) JOIN bu USING (term) JOIN cal c ON c.n = b.peak_n WHERE baseline_total > 0)"""


def life(spark, d):
    return se.lifecycle(dense(spark, d), TREND, LAST)


@query("lifecycle", f"{LIFE_SQL} SELECT term, first_seen, trend_first_seen, peak_month, round(peak_value, 6) AS peak_value, half_life, active_span, burst_months, baseline_total, before_trend, trend_total, round(novelty, 9) AS novelty FROM life_v")
def lifecycle(spark, d):
    return life(spark, d).select(
        "term", "first_seen", "trend_first_seen", "peak_month", F.round("peak_value", 6).alias("peak_value"), "half_life", "active_span", "burst_months",
        "baseline_total", "before_trend", "trend_total", F.round("novelty", 9).alias("novelty"),
    )


def concept_class(term_types):
    """Class by the types a term stands under: method before material before physics concept."""
    return F.when(F.array_contains(term_types, "method"), "method").when(F.array_contains(term_types, "material"), "material_system").otherwise("physics_concept")


def with_types(spark, d):
    types = t.terms(spark, d).groupBy(F.col("normalized_term").alias("term")).agg(F.collect_set("term_type").alias("types"))
    return life(spark, d).join(types, "term")


_STATUS_SQL = f"""{LIFE_SQL}, ty AS (SELECT normalized_term AS term, CASE WHEN bool_or(term_type = 'method') THEN 'method' WHEN bool_or(term_type = 'material') THEN 'material_system' ELSE 'physics_concept' END AS concept_class FROM terms_v GROUP BY 1),
st AS (SELECT *, CASE WHEN concept_class = 'method' OR active_months >= 18 OR before_trend >= 50 THEN 'persistent' WHEN before_trend <= 5 AND recent_3m >= 3 AND (recent_3m + 1) / (previous_3m + 1) >= 2 AND trend_total >= 3 THEN 'emerging'
 WHEN before_trend > 0 AND recent_6m_count = 0 THEN 'stale' WHEN recent_6m_count > 0 AND peak_value > 0 AND current >= 0.5 * peak_value AND before_trend > 5 THEN 'active' WHEN peak_value > 0 AND recent_3m < 0.5 * peak_value AND recent_6m_count > 0 THEN 'cooling'
 WHEN trend_total > 0 THEN 'active' ELSE 'stale' END AS status FROM life_v JOIN ty USING (term))"""


@query("lifecycle_status", f"{_STATUS_SQL} SELECT term, concept_class, status FROM st")
def lifecycle_status(spark, d):
    return se.lifecycle_status(with_types(spark, d), concept_class(F.col("types"))).select("term", "concept_class", "status")


@query("lifecycle_summary", f"{_STATUS_SQL} SELECT status, count(*) AS terms, median(half_life) AS half_life, median(burst_months) AS burst_months FROM st GROUP BY 1")
def lifecycle_summary(spark, d):
    found = se.lifecycle_status(with_types(spark, d), concept_class(F.col("types")))
    return found.groupBy("status").agg(F.count("*").alias("terms"), F.median("half_life").alias("half_life"), F.median("burst_months").alias("burst_months"))


def sides(spark, d):
    """Published and preprint statistics from one pass over the terms."""
    papers, journals = t.papers(spark, d), t.journals(spark)
    counts = saved(op.term_counts(papers, t.terms(spark, d), journals, "source_scope"), "sides")
    own = lambda df, s: df.filter(F.col("source_scope") == s)
    return [op.term_month_of(own(counts, s), own(papers, s), journals).filter("corpus_scope = 'all'") for s in ("published", "preprint")]


def _side(scope: str) -> str:
    return f"""{STATS_SQL.replace('papers_v AS (SELECT', 'papers_all AS (SELECT', 1).replace('scoped_v AS (SELECT p.*', f"papers_v AS (SELECT * FROM papers_all WHERE source_scope = '{scope}'), scoped_v AS (SELECT p.*", 1)} SELECT term, month, raw_share, momentum FROM stats_v WHERE corpus_scope = 'all'"""


_GAP = f"""WITH a AS ({_side('published')}), b AS ({_side('preprint')}), g AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.month, b.month) AS month, coalesce(a.raw_share, 0) AS published_share, coalesce(b.raw_share, 0) AS preprint_share,
 greatest(coalesce(b.raw_share, 0) - coalesce(a.raw_share, 0), 0) * (1 + coalesce(b.momentum, 0)) AS gap FROM a FULL JOIN b ON a.term = b.term AND a.month = b.month)"""


@query("pub_preprint", f"{_GAP} SELECT term, month, round(published_share, 9) AS published_share, round(preprint_share, 9) AS preprint_share, round(gap, 6) AS gap FROM g")
def pub_preprint(spark, d):
    found = se.published_and_preprint(*sides(spark, d))
    return found.select("term", "month", F.round("published_share", 9).alias("published_share"), F.round("preprint_share", 9).alias("preprint_share"), F.round("gap", 6).alias("gap"))


@query("pub_preprint_top", f"{_GAP} SELECT term, round(sum(gap), 5) AS gap FROM g GROUP BY 1 ORDER BY sum(gap) DESC, 1 LIMIT 20")
def pub_preprint_top(spark, d):
    summed = se.published_and_preprint(*sides(spark, d)).groupBy("term").agg(F.sum("gap").alias("gap"))
    return summed.orderBy(F.desc("gap"), "term").limit(20).select("term", F.round("gap", 5).alias("gap"))


_SIDES = f"""WITH {t.TERMS_SQL}, pc AS (SELECT normalized_term AS term FROM terms_v GROUP BY 1 HAVING max(display_eligible) = 1 AND count(*) FILTER (term_type IN ('method', 'material')) = 0), a AS ({_side('published').replace('raw_share, momentum', 'raw_share, momentum, raw_freq')}), b AS ({_side('preprint').replace('raw_share, momentum', 'raw_share, momentum, raw_freq')}), g AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.momentum, 0) AS heat, coalesce(b.momentum, 0) AS rise, coalesce(a.raw_freq, 0) AS pub_n, coalesce(b.raw_freq, 0) AS pre_n,
 greatest(coalesce(b.raw_share, 0) - coalesce(a.raw_share, 0), 0) * (1 + coalesce(b.momentum, 0)) AS gap FROM a FULL JOIN b ON a.term = b.term AND a.month = b.month),
s AS (SELECT term, round(sum(heat), 6) AS heat, round(sum(rise), 6) AS rise, round(sum(gap), 6) AS gap, CAST(sum(pub_n) AS BIGINT) AS pub_n, CAST(sum(pre_n) AS BIGINT) AS pre_n FROM g SEMI JOIN pc USING (term) GROUP BY 1),
k AS (SELECT 'published_heat' AS ranking, term, heat AS score, row_number() OVER (ORDER BY heat DESC, term) AS rank FROM s WHERE pub_n >= 2 UNION ALL SELECT 'preprint_rising', term, rise, row_number() OVER (ORDER BY rise DESC, term) FROM s WHERE pre_n >= 1
 UNION ALL SELECT 'validation_gap', term, gap, row_number() OVER (ORDER BY gap DESC, term) FROM s WHERE pre_n >= 1 UNION ALL SELECT 'cooling_published', term, heat, row_number() OVER (ORDER BY heat, pub_n DESC, term) FROM s WHERE pub_n >= 2)"""


@query("pub_preprint_rankings", f"{_SIDES} SELECT ranking, CAST(rank AS INTEGER) AS rank, term, score FROM k WHERE rank <= 20")
def pub_preprint_rankings(spark, d):
    return se.side_rankings(*sides(spark, d), 20, shown(spark, d).filter("concept_class = 'physics_concept'"))


def pairs_of(spark, d):
    return t.terms(spark, d).filter("display_eligible = 1").select("paper_id", F.col("normalized_term").alias("term")).distinct()


_ONCE = f"WITH {t.TERMS_SQL}, o AS (SELECT DISTINCT paper_id, normalized_term AS term FROM terms_v WHERE display_eligible = 1)"
_KEPT = f"{_ONCE}, k AS (SELECT term, count(*) AS papers FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"


@query("cooc_nodes", f"{_KEPT} SELECT term, papers FROM k")
def cooc_nodes(spark, d):
    return se.network(pairs_of(spark, d), 2, 50)[0]


@query("cooc_links", f"{_KEPT} SELECT x.term AS a, y.term AS b, count(*) AS papers FROM (SELECT * FROM o SEMI JOIN k USING (term)) x JOIN (SELECT * FROM o SEMI JOIN k USING (term)) y ON x.paper_id = y.paper_id AND x.term < y.term GROUP BY 1, 2 HAVING count(*) >= 2")
def cooc_links(spark, d):
    return se.network(pairs_of(spark, d), 2, 50)[1]


@query("ego", f"{_ONCE} SELECT term, count(*) AS papers FROM o WHERE term <> 'Brand#1' AND paper_id IN (SELECT paper_id FROM o WHERE term = 'Brand#1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def ego(spark, d):
    return se.ego(pairs_of(spark, d), "Brand#1", 12)


@query("associated", f"""WITH {t.TERMS_SQL}, o AS (SELECT paper_id, term_type, normalized_term AS term FROM terms_v), p AS (SELECT x.term, y.term AS other, count(*) AS papers FROM o x JOIN o y ON x.paper_id = y.paper_id WHERE x.term_type = 'material' AND y.term_type = 'concept' GROUP BY 1, 2)
SELECT term, other, papers FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY papers DESC, other) AS r FROM p) WHERE r <= 5""")
def associated(spark, d):
    terms = t.terms(spark, d).select("paper_id", "term_type", F.col("normalized_term").alias("term"))
    return se.associated(terms.filter("term_type = 'material'").drop("term_type"), terms.filter("term_type = 'concept'").drop("term_type"), 5)


@query("period_chunks", f"""WITH {t.JOURNALS_SQL}, q AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-15', INTERVAL 3 MONTH)) AS s) SELECT name, greatest(CAST(s AS DATE), DATE '1995-02-10') AS date_from, least(CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), DATE '2001-08-15') AS date_to, n AS papers
FROM journals_v CROSS JOIN q JOIN (SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 'Journal A' WHEN '2-HIGH' THEN 'Journal B' WHEN '3-MEDIUM' THEN 'Journal C' WHEN '5-LOW' THEN 'arXiv' END AS name FROM orders GROUP BY 1) USING (name)""")
def period_chunks(spark, d):
    names = t.papers(spark, d).groupBy(F.col("journal").alias("name")).agg(F.count("*").alias("papers")).join(F.broadcast(t.journals(spark).select("name")), "name", "left_semi")
    return se.period_chunks(spark, "1995-02-10", "2001-08-15", "quarter", names)


@query("windows", f"WITH {t.PAPERS_SQL} SELECT min(pub_date) AS baseline_from, max(pub_date) AS baseline_to, CAST(date_trunc('month', max(pub_date)) - INTERVAL 23 MONTH AS DATE) AS trend_from, max(month) AS last_month FROM papers_v")
def windows(spark, d):
    return t.papers(spark, d).agg(F.min("pub_date").alias("baseline_from"), F.max("pub_date").alias("baseline_to"), F.add_months(F.trunc(F.max("pub_date"), "month"), -23).alias("trend_from"), F.max("month").alias("last_month"))


@query("period_change", f"""WITH {t.PAPERS_SQL}, m AS (SELECT source, month, count(*) AS papers FROM papers_v GROUP BY 1, 2) SELECT source, month, papers, round(avg(papers) OVER (PARTITION BY source ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, papers - lag(papers, 3) OVER (PARTITION BY source ORDER BY month) AS change FROM m""")
def period_change(spark, d):
    m = t.papers(spark, d).groupBy("source", "month").agg(F.count("*").alias("papers"))
    moving = se.rolling(m, ["source"], "papers", 3).withColumnRenamed("smooth", "moving")
    return rounded(moving.withColumn("change", F.expr("papers - lag(papers, 3) over (partition by source order by month)")), "moving")
