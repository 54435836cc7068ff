"""Strict classification of papers by venue, grade and words, and reports on what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.corpus import is_preprint
from papertide.operators.entities import phrase_hits, tokens


def classify_strict(papers: DataFrame, terms: DataFrame, phrases: DataFrame, tracked: list[str], generalist: list[str]) -> DataFrame:
    """paper_id, eligible, reason of papers (paper_id, title, abstract, journal, source, source_scope, data_mode, confidence).

    ``phrases`` holds (kind, phrase): ``strong`` words beat ``exclude``, ``keep`` words are enough, and a paper of a ``generalist`` venue
    needs a ``domain`` phrase in its own text. ``terms`` (paper_id, term) are displayed terms; they count as hits if listed. The reason
    names the first five distinct hits in order. The first rule that holds decides.
    """
    text = F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    listed = phrases.select("kind", "phrase")
    in_text = phrase_hits(papers.select("paper_id", text.alias("text")), listed).select("paper_id", "kind", F.col("phrase").alias("hit"), F.lit(True).alias("literal"))
    keyed = listed.filter("kind <> 'domain'").select("kind", F.array_join(tokens(F.col("phrase")), " ").alias("_k"))
    in_terms = terms.withColumn("_k", F.array_join(tokens(F.col("term")), " ")).join(keyed, "_k").select("paper_id", "kind", F.col("term").alias("hit"), F.lit(False).alias("literal"))
    five = lambda kind: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("hit")))), 1, 5), ",").alias(kind)
    hits = in_text.union(in_terms).groupBy("paper_id").agg(*(five(k) for k in ("strong", "keep", "exclude", "domain")))
    shown = terms.groupBy("paper_id").agg(F.lit(True).alias("_shown"))
    rows = papers.join(hits, "paper_id", "left").join(shown, "paper_id", "left")
    has = lambda k: F.coalesce(F.col(k), F.lit("")) != ""
    venue = F.coalesce(F.col("journal").isin(tracked), F.lit(False)) | F.coalesce(is_preprint(), F.lit(False))
    grade = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium"))
    strict = F.concat(
        F.lit("strict"), F.when(has("strong"), F.concat(F.lit(":strong="), "strong")).when(has("keep"), F.concat(F.lit(":hit="), "keep")).otherwise(":display_term"),
        F.when(has("exclude"), F.concat(F.lit(":override_excluded="), "exclude")).otherwise(""),
    )
    wide = F.coalesce(F.lower("journal").isin([g.lower() for g in generalist]), F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("data_mode") != "real", F.lit(True)), "not_real").when(~venue, "not_tracked_journal").when(~grade.isin("high", "medium"), F.concat(F.lit("confidence_"), grade))
        .when(has("exclude") & ~has("strong"), F.concat(F.lit("excluded:"), "exclude"))
        .when(wide, F.when(has("domain"), F.concat(F.lit("strict:generalist_text="), "domain")).otherwise("generalist_requires_text"))
        .when(has("keep") | has("strong") | F.coalesce("_shown", F.lit(False)), strict).otherwise("no_hit")
    )
    return rows.select("paper_id", reason.alias("reason")).select("paper_id", F.startswith("reason", F.lit("strict")).alias("eligible"), "reason")


def reclassify(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, papers: processed, eligible, excluded, changed, downgraded, promoted, updates_needed, and ``reason:..`` by what stands before the colon.
    ``old`` and ``new`` hold paper_id, eligible, reason; papers without an old flag count as not eligible."""
    both = new.join(old.select("paper_id", F.col("eligible").alias("was"), F.col("reason").alias("why")), "paper_id", "left").withColumn("was", F.coalesce("was", F.lit(False)))
    now, was = F.col("eligible"), F.col("was")
    metrics: dict[str, Column] = {
        "processed": F.lit(True), "eligible": now, "excluded": ~now, "changed": now != was, "downgraded": was & ~now, "promoted": ~was & now, "updates_needed": (now != was) | ~F.col("reason").eqNullSafe(F.coalesce("why", F.lit(""))),
    }
    counts = both.agg(*(F.count_if(rule).alias(k) for k, rule in metrics.items()))
    long = counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("papers")) for k in metrics))))
    reasons = both.groupBy(F.concat(F.lit("reason:"), F.split_part("reason", F.lit(":"), F.lit(1))).alias("metric")).agg(F.count("*").alias("papers"))
    return long.union(reasons)


def downgrade_repository_only(versions: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, outcome, versions, reason of papers with a repository version: ``preserved`` if any version qualifies, ``already_excluded``, or
    ``downgraded``. ``versions`` holds canonical_paper_id, is_repository, qualifies, reason, version_id; nothing is deleted."""
    first = F.min_by("reason", F.when(F.col("is_repository"), F.col("version_id")))
    by_paper = versions.groupBy(F.col("canonical_paper_id").alias("paper_id")).agg(F.bool_or("is_repository").alias("_r"), F.bool_or("qualifies").alias("_q"), F.count("*").alias("versions"), first.alias("reason"))
    rows = by_paper.filter("_r").join(papers.select("paper_id", "view_eligible"), "paper_id", "left")
    outcome = F.when(F.col("_q"), "preserved").when(F.col("view_eligible").isNull(), "missing").when(~F.col("view_eligible"), "already_excluded").otherwise("downgraded")
    return rows.select("paper_id", outcome.alias("outcome"), "versions", F.when(outcome == "downgraded", F.col("reason")).alias("reason"))
