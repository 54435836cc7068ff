"""Two-window analytics: outputs, sources, momentum, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED_SOURCES = ("", "unknown", "legacy_intake", "manual", "imported", "repository")


def anchor(outputs: DataFrame, today: str) -> DataFrame:
    """One row: the latest research date not after ``today``, and before it if an earlier day exists."""
    day = F.lit(today).cast("date")
    return outputs.agg(F.coalesce(F.max(F.when(F.col("paper_date") < day, F.col("paper_date"))), F.max(F.when(F.col("paper_date") == day, F.col("paper_date")))).alias("anchor"))


def scholarly_date() -> Column:
    """Submission of a preprint, else publication, submission, date of the paper."""
    return F.coalesce(F.when(F.col("version_type") == "preprint", F.col("submitted_date")), F.col("publication_date"), F.col("submitted_date"), F.col("pub_date"))


def version_events(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions of eligible papers with ``paper_date``."""
    held = papers.select("paper_id", "pub_date", "abstract", "doi", "is_open_access", "cited_by_count", F.col("source").alias("paper_source"))
    return versions.join(held, versions.canonical_paper_id == held.paper_id).withColumn("paper_date", scholarly_date())


def canonical_outputs(events: DataFrame, last: str, days: int) -> DataFrame:
    """A row for each paper whose first scholarly date (of those up to ``last``) lies in the current window of
    ``days`` or the equally long one before."""
    end = F.lit(last).cast("date")
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    found = events.filter(F.col("paper_date") <= end).groupBy("paper_id").agg(
        F.min("paper_date").alias("research_date"), has(F.col("version_type") == "preprint").alias("has_preprint"), has(F.col("version_type").isin("publication", "published")).alias("has_publication"),
        has(F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("has_abstract"), has(F.coalesce("doi", F.lit("")) != "").alias("has_doi"), has(F.col("is_open_access")).alias("is_open_access"), F.max(F.coalesce("cited_by_count", F.lit(0))).alias("cited_by_count"),
    )
    start = F.date_sub(end, days - 1)
    return found.filter(F.col("research_date").between(F.date_sub(end, 2 * days - 1), end)).withColumn("window_name", F.when(F.col("research_date") >= start, "current").otherwise("baseline"))


def effective_source(value: Column, fallback: Column) -> Column:
    """Provider name: legacy labels take the paper's source; names that contain a provider's become it."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    raw = F.when(raw.isin("", "legacy"), F.coalesce(F.nullif(F.lower(F.trim(fallback)), F.lit("")), F.lit("unknown"))).otherwise(raw)
    out = F.when(raw.contains("semantic") & raw.contains("scholar"), "semantic_scholar")
    for name in ("openalex", "crossref", "arxiv"):
        out = out.when(raw.contains(name), name)
    return out.otherwise(F.replace(raw, F.lit(" "), F.lit("_")))


def output_sources(outputs: DataFrame, events: DataFrame) -> DataFrame:
    """paper_id, window_name, source_name without repeats and without sources that are no provider."""
    rows = events.select("paper_id", effective_source(F.col("source"), F.col("paper_source")).alias("source_name")).distinct()
    return outputs.select("paper_id", "window_name").join(rows.filter(~F.col("source_name").isin(*IGNORED_SOURCES)), "paper_id")


def two_window_momentum(counts: DataFrame, min_count: int = 3) -> DataFrame:
    """Adds momentum columns to rows of current, baseline, current_total, baseline_total, coverage."""
    c = F.col
    share = lambda n, total: F.when(c(total) > 0, (c(n) + 0.5) / (c(total) + 1)).otherwise(0.5)
    ratio = F.log2(share("current", "current_total") / share("baseline", "baseline_total"))
    support = F.least(F.lit(1.0), F.sqrt((c("current") + c("baseline")) / 20))
    reliability = support * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("coverage")))
    rows = counts.withColumns({"reliability": reliability, "momentum": 100 * F.tanh(ratio / 2) * reliability})
    weak = (c("current") < min_count) | (c("current_total") < 5) | (c("baseline_total") < 5)
    status = F.when(weak, "insufficient_evidence").when(c("momentum") >= 15, F.when(c("baseline") == 0, "emerging").otherwise("rising")).when(c("momentum") <= -15, "cooling").otherwise("stable")
    heat = F.greatest(F.lit(0.0), c("momentum")) * 0.55 + F.least(F.lit(100.0), 25 * F.log1p("current")) * 0.45
    return rows.withColumns({"status": status, "heat_score": heat})


def window_counts(outputs: DataFrame, links: DataFrame) -> DataFrame:
    """term, current, baseline, current_total, baseline_total, coverage of distinct (paper_id, term) links."""
    totals = F.broadcast(outputs.agg(F.count_if(F.col("window_name") == "current").alias("current_total"), F.count_if(F.col("window_name") == "baseline").alias("baseline_total"), F.count("*").alias("_n")))
    inside = links.join(outputs.select("paper_id", "window_name"), "paper_id")
    covered = F.broadcast(inside.agg(F.countDistinct("paper_id").alias("_c")))
    counts = inside.groupBy("term").agg(F.count_if(F.col("window_name") == "current").alias("current"), F.count_if(F.col("window_name") == "baseline").alias("baseline"))
    return counts.crossJoin(totals).crossJoin(covered).withColumn("coverage", F.col("_c") / F.col("_n")).drop("_n", "_c")


def source_mix(sources: DataFrame) -> DataFrame:
    """source_name, current, baseline, their shares and whether both windows have 10 at least."""
    counts = sources.groupBy("source_name").agg(F.count_if(F.col("window_name") == "current").alias("current"), F.count_if(F.col("window_name") == "baseline").alias("baseline"))
    totals = F.broadcast(counts.agg(F.sum("current").alias("_c"), F.sum("baseline").alias("_b")))
    rows = counts.crossJoin(totals)
    return rows.select("source_name", "current", "baseline", (F.col("current") / F.col("_c")).alias("current_share"), (F.col("baseline") / F.col("_b")).alias("baseline_share"), ((F.col("current") >= 10) & (F.col("baseline") >= 10)).alias("comparable"))


def source_trends(outputs: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """Source-standardised momentum of terms (distinct links paper_id, term).

    Sources are shared if both windows hold enough of their papers (2 % of the smaller window, 2 to 10). A term's share in a window is its share
    in each shared source, 0 where it is absent, weighted by the source's part of all shared papers. Momentum is shrunk by the
    papers that support it, by the coverage of links and by the part of the outputs that shared sources hold. A term with too few papers
    in shared sources is ``source_mix_confounded``; if links cover the windows unevenly or under 60 %, all is ``insufficient_evidence``.
    """
    now, old = F.col("window_name") == "current", F.col("window_name") == "baseline"
    two = lambda a, b: (F.count_if(now).alias(a), F.count_if(old).alias(b))
    totals = outputs.agg(*two("ct", "bt"))
    linked = links.join(outputs.select("paper_id", "window_name"), "paper_id")
    covered = outputs.join(links.select("paper_id").distinct(), "paper_id", "left_semi").agg(*two("kc", "kb"))
    frame = totals.crossJoin(covered).select(
        "*", F.greatest(F.lit(2), F.ceil(F.col("ct") * 0.002)).alias("least"), F.greatest(F.lit(2), F.least(F.lit(10), F.ceil(F.least("ct", "bt") * 0.02))).alias("floor"),
        F.coalesce(F.col("kc") / F.nullif("ct", F.lit(0)), F.lit(0.0)).alias("cover_c"), F.coalesce(F.col("kb") / F.nullif("bt", F.lit(0)), F.lit(0.0)).alias("cover_b"),
    )
    shared = sources.groupBy("source_name").agg(*two("cn", "bn")).crossJoin(F.broadcast(frame.select("floor"))).filter((F.col("cn") >= F.col("floor")) & (F.col("bn") >= F.col("floor"))).drop("floor")
    pooled = shared.agg(F.sum("cn").alias("sc"), F.sum("bn").alias("sb"), F.sum((F.col("cn") + F.col("bn")) * (F.col("cn") + F.col("bn"))).alias("square"))
    size = F.col("sc") + F.col("sb")
    frame = frame.crossJoin(pooled).select(
        "ct", "bt", "least", "cover_c", "cover_b", size.alias("pooled"), (F.col("square") / size / 2).alias("effective_n"),
        F.least(F.lit(1.0), F.col("sc") / F.col("ct"), F.col("sb") / F.col("bt")).alias("support"),
    )
    counts = linked.groupBy("term").agg(*two("current", "baseline"))
    parts = links.join(sources, "paper_id").groupBy("term", "source_name").agg(*two("c", "b")).join(shared, "source_name")
    weight = F.col("cn") + F.col("bn")
    by_term = parts.groupBy("term").agg(F.sum("c").alias("comparable_current"), F.sum("b").alias("comparable_baseline"), F.sum(weight * F.col("c") / F.col("cn")).alias("wc"), F.sum(weight * F.col("b") / F.col("bn")).alias("wb"))
    rows = counts.join(by_term, "term", "left").crossJoin(F.broadcast(frame))
    rows = rows.filter((F.col("current") >= F.col("least")) | (F.col("current") + F.col("baseline") >= F.col("least") * 2))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("comparable_current", "comparable_baseline", "pooled")})
    share = lambda w: F.coalesce(F.col(w) / F.nullif("pooled", F.lit(0)), F.lit(0.0))
    rows = rows.withColumns({"current_share": share("wc"), "baseline_share": share("wb"), "_n": F.col("comparable_current") + F.col("comparable_baseline"), "_prior": 0.5 / F.greatest(F.lit(1.0), F.coalesce("effective_n", F.lit(0.0)))})
    even = (F.col("cover_c") >= 0.6) & (F.col("cover_b") >= 0.6) & (F.abs(F.col("cover_c") - F.col("cover_b")) <= 0.15)
    confounded = (F.col("pooled") == 0) | (F.col("_n") < F.col("least"))
    shrunk = F.least(F.lit(1.0), F.sqrt(F.col("_n") / 20)) * F.least("cover_c", "cover_b") * F.sqrt(F.greatest(F.lit(0.0), F.coalesce("support", F.lit(0.0))))
    ratio = F.log2((F.col("current_share") + F.col("_prior")) / (F.col("baseline_share") + F.col("_prior")))
    rows = rows.withColumn("reliability", F.when(confounded | ~even, 0.0).otherwise(shrunk))
    rows = rows.withColumn("momentum", F.when(confounded | ~even, 0.0).otherwise(100 * F.tanh(ratio / 2) * F.col("reliability")))
    weak = (F.col("current") < F.col("least")) | (F.col("ct") < 5) | (F.col("bt") < 5)
    status = (
        F.when(~even, "insufficient_evidence").when(confounded, "source_mix_confounded").when(weak, "insufficient_evidence")
        .when(F.col("momentum") >= 15, F.when(F.col("comparable_baseline") == 0, "emerging").otherwise("rising")).when(F.col("momentum") <= -15, "cooling").otherwise("stable")
    )
    heat = F.when(confounded | ~even, F.least(F.lit(15.0), 3 * F.log1p("current"))).otherwise(F.greatest(F.lit(0.0), F.col("momentum")) * 0.55 + F.least(F.lit(100.0), 25 * F.log1p("comparable_current")) * 0.45)
    return rows.select("term", "current", "baseline", "comparable_current", "comparable_baseline", "current_share", "baseline_share", "reliability", "momentum", status.alias("status"), heat.alias("heat_score"))


def release_gates(outputs: DataFrame, sources: DataFrame, links: dict[str, DataFrame], today: str) -> DataFrame:
    """One row: volume_ratio, abstract_coverage, source_shift, stale_days, multi_source, providers, and the gates ``overlap``, ``common``, one for each kind
    of ``links`` (covers 60 % of both windows, at most 15 points apart), and ``verdict`` (pass if all hold). Shares are between 0 and 1."""
    now, old = F.col("window_name") == "current", F.col("window_name") == "baseline"
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    row = outputs.agg(F.count_if(now).alias("ct"), F.count_if(old).alias("bt"), F.max("research_date").alias("last"), F.sum(F.when(now, F.col("has_abstract"))).alias("told"))
    mix = source_mix(sources).agg((F.sum(F.abs(F.col("current_share") - F.col("baseline_share"))) / 2).alias("source_shift"))
    per_paper = sources.filter(now).groupBy("paper_id").agg(F.count("*").alias("n"))
    several = per_paper.agg(F.count_if(F.col("n") > 1).alias("several"))
    known = sources.filter(now).agg(F.countDistinct("source_name").alias("providers"))
    row = row.crossJoin(mix).crossJoin(several).crossJoin(known)
    for kind, found in links.items():
        inside = outputs.join(found.select("paper_id").distinct(), "paper_id", "left_semi").agg(F.count_if(now).alias(f"{kind}_c"), F.count_if(old).alias(f"{kind}_b"))
        row = row.crossJoin(inside)
    row = row.withColumns({"volume_ratio": share(F.col("ct"), F.col("bt")), "abstract_coverage": share(F.col("told"), F.col("ct")), "stale_days": F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), "last")), "multi_source": share(F.col("several"), F.col("ct"))})
    row = row.withColumn("overlap", (F.col("multi_source") >= 0.25) & (F.col("providers") >= 3))
    common = (F.col("ct") >= 100) & (F.col("bt") >= 100) & F.col("volume_ratio").between(0.5, 2.0) & (F.col("abstract_coverage") >= 0.7) & (F.coalesce("source_shift", F.lit(1.0)) <= 0.15) & (F.col("stale_days") <= 3) & F.col("overlap")
    row = row.withColumn("common", common)
    for kind in links:
        c, b = share(F.col(f"{kind}_c"), F.col("ct")), share(F.col(f"{kind}_b"), F.col("bt"))
        row = row.withColumn(kind, F.col("common") & (c >= 0.6) & (b >= 0.6) & (F.abs(c - b) <= 0.15))
    every = F.forall(F.array(*(F.col(k) for k in links)), lambda x: x)
    return row.select("volume_ratio", "abstract_coverage", "source_shift", "stale_days", "multi_source", "providers", "overlap", "common", *links, F.when(every, "pass").otherwise("caution").alias("verdict"))


def source_overlap(sources: DataFrame, top: int = 8) -> DataFrame:
    """a, b, papers: in how many papers both sources stand, among the ``top`` sources; a = b is the size."""
    kept = F.broadcast(sources.groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(top).select("source_name"))
    rows = sources.select("paper_id", "source_name").join(kept, "source_name")
    return rows.select("paper_id", F.col("source_name").alias("a")).join(rows.select("paper_id", F.col("source_name").alias("b")), "paper_id").groupBy("a", "b").agg(F.count("*").alias("papers"))


def pathways(events: DataFrame) -> DataFrame:
    """pathway, papers, median_lag: preprint only, publication only or both; lag in days, 0 at least."""
    first = events.groupBy("paper_id").agg(F.min(F.when(F.col("version_type") == "preprint", F.col("paper_date"))).alias("pre"), F.min(F.when(F.col("version_type") == "published", F.col("paper_date"))).alias("pub"))
    kind = F.when(F.col("pre").isNotNull() & F.col("pub").isNotNull(), "linked").when(F.col("pre").isNotNull(), "preprint_only").when(F.col("pub").isNotNull(), "publication_only")
    lag = F.greatest(F.datediff("pub", "pre"), F.lit(0))
    return first.withColumn("pathway", kind).filter("pathway is not null").groupBy("pathway").agg(F.count("*").alias("papers"), F.median(F.when(kind == "linked", lag)).alias("median_lag"))


def coverage_sources(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """paper_id, doi, sources (sorted, distinct): the providers that know a paper."""
    known = versions.select(F.col("canonical_paper_id").alias("paper_id"), "source").union(papers.select("paper_id", "source")).filter(~F.col("source").isin("legacy", *IGNORED_SOURCES))
    return papers.select("paper_id", "doi").join(known.groupBy("paper_id").agg(F.array_sort(F.collect_set("source")).alias("sources")), "paper_id", "left")


def coverage_gaps(covered: DataFrame) -> DataFrame:
    """A row for each lookup that could fill a gap of papers (paper_id, doi, arxiv_id, sources), with a stable id: Crossref and OpenAlex are asked
    by DOI, arXiv by its id."""
    known = F.coalesce("sources", F.array().cast("array<string>"))
    row = lambda target, lookup, value, reason: F.when(F.col(value).isNotNull() & ~F.array_contains(known, target), F.struct(F.lit(target).alias("target"), F.lit(lookup).alias("lookup"), F.col(value).alias("value"), F.lit(reason).alias("reason")))
    wanted = F.array_compact(F.array(
        row("crossref", "doi", "doi", "DOI record has no Crossref observation"), row("openalex", "doi", "doi", "DOI record has no OpenAlex observation"),
        row("arxiv", "arxiv", "arxiv_id", "arXiv identity has no arXiv observation"),
    ))
    rows = covered.select("paper_id", F.inline(wanted))
    return rows.withColumn("gap_id", F.sha2(F.concat_ws("|", "paper_id", "target", "lookup", "value"), 256))


def daily(outputs: DataFrame, last: str, days: int) -> DataFrame:
    """day, papers, preprints, publications for every day of the window, zeros included."""
    calendar = outputs.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date_sub(date'{last}', {days - 1}), date'{last}')")).alias("day"))
    counts = outputs.groupBy(F.col("research_date").alias("day")).agg(F.count("*").alias("papers"), F.sum("has_preprint").alias("preprints"), F.sum("has_publication").alias("publications"))
    return F.broadcast(calendar).join(counts, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("papers", "preprints", "publications")))
