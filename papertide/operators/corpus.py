"""Scopes, weights, presets and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.sources.tables import UNKNOWN_WEIGHT

PRESETS = ("strict_core_published", "strict_context_published", "strict_core_plus_context_published", "arxiv_preprint", "core_all", "mock", "all_real", "strict", "published_vs_preprint")


def is_preprint() -> Column:
    return (F.col("source_scope") == "preprint") | (F.col("source") == "arxiv") | (F.col("journal") == "arXiv")


def with_journal(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """Adds ``bucket`` (core, context, preprint or unknown) and ``weight``; the journal table is a
    dimension of fixed size and is broadcast."""
    known = F.broadcast(journals.select(F.lower("name").alias("_name"), F.col("bucket").alias("_bucket"), F.col("weight").alias("_weight")))
    joined = papers.join(known, F.lower("journal") == F.col("_name"), "left")
    preprint = is_preprint()
    return joined.select(
        *papers.columns,
        F.when(preprint, "preprint").otherwise(F.coalesce("_bucket", F.lit("unknown"))).alias("bucket"),
        F.when(preprint, 1.0).otherwise(F.coalesce("_weight", F.lit(UNKNOWN_WEIGHT))).alias("weight"),
    )


def scopes() -> Column:
    """The corpus scopes a paper's bucket counts for."""
    return F.when(F.col("bucket") == "core", F.array(F.lit("core"), F.lit("core_context"), F.lit("all"))).when(F.col("bucket") == "preprint", F.array(F.lit("all"))).otherwise(F.array(F.lit("core_context"), F.lit("all")))


def with_scopes(papers: DataFrame) -> DataFrame:
    """A row for each scope of a paper."""
    return papers.withColumn("corpus_scope", F.explode(scopes()))


def preset_filter(papers: DataFrame, preset: str) -> DataFrame:
    """Papers (with their ``bucket``) of a corpus preset."""
    real = F.col("data_mode") == "real"
    published = F.coalesce(F.nullif("source_scope", F.lit("")), F.lit("published")) == "published"
    strict = real & F.coalesce("view_eligible", F.lit(False))
    journal = F.coalesce("journal_bucket", F.lit("unknown"))
    rule = {
        "strict_core_published": strict & (journal == "core") & published,
        "strict_context_published": strict & (journal == "context") & published,
        "strict_core_plus_context_published": strict & journal.isin("core", "context") & published,
        "arxiv_preprint": strict & is_preprint(),
        "core_all": real & (journal == "core"),
        "mock": F.col("data_mode") == "mock",
        "all_real": real,
        "published_vs_preprint": real,
    }
    rule["strict"] = rule["strict_core_published"]
    if preset not in rule:
        raise ValueError(f"no preset {preset}; there are {', '.join(rule)}")
    return papers.filter(rule[preset])


def resolve_journal(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``journal`` -> ``name`` by name or alias, without regard to case or outer blanks."""
    key = F.broadcast(aliases.select(F.lower(F.trim("alias")).alias("_alias"), "name").distinct())
    return names.join(key, F.lower(F.trim("journal")) == F.col("_alias"), "left").drop("_alias")


def by_mode(papers: DataFrame) -> DataFrame:
    """A row for the paper's own data mode and one for ``mixed``."""
    return papers.withColumn("mode", F.explode(F.array("data_mode", F.lit("mixed"))))


def monthly_corpus(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """month, corpus_scope, data_mode, paper_count, weighted_count. Counted by bucket and mode first,
    so the expansion to scopes and modes works on few rows."""
    small = with_journal(papers, journals).groupBy("month", "bucket", "data_mode").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    wide = by_mode(with_scopes(small))
    return wide.groupBy("month", "corpus_scope", F.col("mode").alias("data_mode")).agg(F.sum("n").alias("paper_count"), F.sum("w").alias("weighted_count"))


def month_number(month: str | Column) -> Column:
    month = F.col(month) if isinstance(month, str) else month
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def number_month(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor((number - 1) / 12).cast("int"), (F.pmod(number - 1, F.lit(12)) + 1).cast("int"))


def momentum_columns(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``momentum`` to sparse rows with month, weighted_freq, raw_freq and citation_sum: log weight times
    growth (this and two months before, over the six before those, at most 4) times a citation factor.
    Absent months add nothing to the range frames, so no calendar is joined."""
    index = month_number("month")
    by = F.expr  # frames in SQL text stay short
    stats = stats.withColumn("_m", index)
    part = ", ".join(f"`{k}`" for k in keys)
    frame = f"over (partition by {part} order by _m range between"
    recent, before = by(f"sum(weighted_freq) {frame} 2 preceding and current row)"), by(f"coalesce(sum(weighted_freq) {frame} 8 preceding and 3 preceding), 0)")
    cites = F.log1p(F.col("citation_sum") / F.col("raw_freq"))
    growth = F.least((recent + 1) / (before + 1), F.lit(4.0))
    return stats.withColumn("momentum", F.log1p("weighted_freq") * growth * (1 + 0.35 * F.least(cites, F.lit(3.0)))).drop("_m")


def term_month(papers: DataFrame, terms: DataFrame, journals: DataFrame) -> DataFrame:
    """Sparse statistics by term, month and scope: a paper counts once for a term and scope.

    term, month, corpus_scope, raw_freq, weighted_freq, citation_sum, raw_share, weighted_share,
    journals (number), momentum. Terms are made distinct by paper, then counted by bucket
    and journal before the scopes multiply the rows.
    """
    return term_month_of(term_counts(papers, terms, journals), papers, journals)


def term_counts(papers: DataFrame, terms: DataFrame, journals: DataFrame, *parts: str) -> DataFrame:
    """Papers (n), weight (w) and citations (c) by term, month, bucket and journal, and by further columns of the papers: few rows, from one pass over the terms."""
    held = with_journal(papers, journals).select("paper_id", "month", "journal", "bucket", "weight", "cited_by_count", *parts)
    once = terms.select("paper_id", F.col("normalized_term").alias("term")).distinct()
    return once.join(held, "paper_id").groupBy("term", "month", "bucket", "journal", *parts).agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.coalesce("cited_by_count", F.lit(0))).alias("c")
    )


def term_month_of(small: DataFrame, papers: DataFrame, journals: DataFrame) -> DataFrame:
    """``term_month`` from the ``term_counts`` of the same papers."""
    held = with_journal(papers, journals).select("month", "bucket", "weight")
    wide = with_scopes(small).groupBy("term", "month", "corpus_scope").agg(
        F.sum("n").alias("raw_freq"), F.sum("w").alias("weighted_freq"), F.sum("c").alias("citation_sum"), F.countDistinct("journal").alias("journals")
    )
    totals = with_scopes(held.groupBy("month", "bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))).groupBy("month", "corpus_scope").agg(
        F.sum("n").alias("_n"), F.sum("w").alias("_w")
    )
    shares = wide.join(totals, ["month", "corpus_scope"]).select(
        *wide.columns, (F.col("raw_freq") / F.col("_n")).alias("raw_share"), (F.col("weighted_freq") / F.col("_w")).alias("weighted_share")
    )
    return momentum_columns(shares, ["term", "corpus_scope"])


def term_flags(terms: DataFrame) -> DataFrame:
    """term, display_eligible (any eligible row) and the most frequent reason, the first by name among equals."""
    reasons = terms.groupBy("term", "display_reason").agg(F.count("*").alias("n"), F.max("display_eligible").alias("e"))
    return reasons.groupBy("term").agg(F.max("e").alias("display_eligible"), F.min_by("display_reason", F.struct(-F.col("n"), F.col("display_reason"))).alias("display_reason"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, papers, share of all rows."""
    counted = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("papers"))
    return counted.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select("value", "papers", (F.col("papers") / F.col("_all")).alias("share"))


def coverage(df: DataFrame, **flags: Column) -> DataFrame:
    """One row: total and, for each flag, how many rows have it and their share."""
    counted = [F.count_if(c).alias(k) for k, c in flags.items()]
    row = df.agg(F.count("*").alias("total"), *counted)
    return row.select("total", *flags, *((F.col(k) / F.nullif(F.col("total"), F.lit(0))).alias(f"{k}_share") for k in flags))


def top_terms(stats: DataFrame, metric: str, top: int, least: int = 2) -> DataFrame:
    """term, value, rank: the ``top`` terms of ``least`` occurrences or more by a metric of their months: sums of frequencies, greatest momentum, or shares summed and divided
    by the calendar months from the first to the last of ``stats``. Ties go to the smaller term."""
    months = stats.agg((F.max(month_number("month")) - F.min(month_number("month")) + 1).alias("_months"))
    value = F.max(metric) if metric == "momentum" else F.sum(metric)
    summed = stats.groupBy("term").agg(value.cast("double").alias("value"), F.sum("raw_freq").alias("_n")).filter(F.col("_n") >= least)
    if metric.endswith("_share"):
        summed = summed.crossJoin(F.broadcast(months)).withColumn("value", F.col("value") / F.col("_months"))
    best = summed.select("term", "value").orderBy(F.desc(F.round("value", 9)), "term").limit(top)
    return best.withColumn("rank", F.expr("row_number() over (order by round(value, 9) desc, term)"))
