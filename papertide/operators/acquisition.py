"""Which papers to fetch first, and what to do about failed attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.ordering import kth_largest

# Failure classes that pass by themselves, and those that a person must look at.
TRANSIENT = (
    "connection_error", "empty_pdf", "file_io_error", "http_rate_limited", "http_server_error", "invalid_pdf_structure", "not_pdf_content", "pdf_too_small",
    "request_timeout", "tls_error", "truncated_pdf",
)
MANUAL = ("access_denied", "encrypted_pdf", "institutional_auth_required", "legal_restriction", "no_legal_oa_location", "pdf_too_large")


def failure_class(status: Column) -> Column:
    """Failure class of an HTTP status."""
    return (
        F.when(status.isin(401, 403, 407), "access_denied").when(status == 451, "legal_restriction").when(status.isin(404, 410), "not_found").when(status == 429, "http_rate_limited")
        .when(status.isin(408, 425), "request_timeout").when(status >= 500, "http_server_error").otherwise("request_error")
    )


def failure_plan(attempts: DataFrame, most: int = 5, base: float = 5.0, longest: float = 3600.0, day: float = 86400.0) -> DataFrame:
    """Adds kind (failure class), status (retryable_failed, manual_review, permanent_failed), retry and delay (seconds) to failed attempts
    (attempt_number, failure_class, and http_status and retry_after where they have them).

    Classes for a person are never tried again. Else a status that may pass (none, 408, 425, 429, 500 and more) or a transient class is, until ``most``
    attempts are made; then it goes to a person, and what cannot pass fails for good. The delay doubles up to ``longest``; a Retry-After is waited for, up to ``day``.
    """
    given = lambda c, kind: F.col(c) if c in attempts.columns else F.lit(None).cast(kind)
    code, after = given("http_status", "int"), given("retry_after", "double")
    kind = F.coalesce(F.nullif("failure_class", F.lit("")), failure_class(code))
    may_pass = code.isNull() | code.isin(408, 425, 429) | (code >= 500) | kind.isin(*TRANSIENT)
    retry = ~kind.isin(*MANUAL) & may_pass & (F.col("attempt_number") < most)
    status = F.when(retry, "retryable_failed").when(kind.isin(*MANUAL) | may_pass, "manual_review").otherwise("permanent_failed")
    wait = F.least(F.lit(longest), base * F.pow(F.lit(2.0), F.greatest(F.col("attempt_number"), F.lit(1)) - 1))
    wait = F.when(after.isNotNull(), F.least(F.lit(day), F.greatest(wait, after))).otherwise(wait)
    return attempts.withColumns({"kind": kind, "status": status, "retry": retry, "delay": F.when(retry, wait)})


def acquisition_priority(papers: DataFrame, selected: list[str], today: str, core: list[str], context: list[str]) -> DataFrame:
    """Adds priority (0 to 100) and reason to papers (journal, source, terms: array, momentum, pub_date, doi, arxiv_id, pdf_url).

    Points: journal (core 30, context 15, else arXiv 5), matched terms (20 for the first of ``selected``, 10 for each other), momentum (30 from the top twentieth's
    least value, 15 from the top fifth's, else 5), month (10 in the last 12 months, 5 in the last 36), DOI 10, arXiv id 5, PDF 10. The limits
    are exact order statistics of all papers, found by narrowing, without a sort in one place.
    """
    n = papers.count()
    top5, top20 = kth_largest(papers.select(F.coalesce(F.col("momentum").cast("double"), F.lit(0.0)).alias("v")), "v", [max(1, int(n * 0.05)), max(1, int(n * 0.2))]) if n else (0.0, 0.0)
    momentum = F.coalesce(F.col("momentum").cast("double"), F.lit(0.0))
    matched = F.filter(F.array(*map(F.lit, selected)).cast("array<string>"), lambda x: F.array_contains(F.coalesce("terms", F.array().cast("array<string>")), x))
    month = lambda back: F.date_format(F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -back), "yyyy-MM")
    published = F.coalesce(F.substring(F.col("pub_date").cast("string"), 1, 7), F.lit(""))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    journal = F.coalesce("journal", F.lit(""))
    arxiv = (F.coalesce("source", F.lit("")) == "arxiv") | (journal == "arXiv")
    groups = [
        [(journal.isin(*core), 30, F.lit("core journal")), (journal.isin(*context), 15, F.lit("context journal")), (arxiv, 5, F.lit("arXiv only"))],
        [(F.size(matched) > 0, 10 + 10 * F.size(matched), F.concat(F.lit("matched "), F.array_join(matched, ", ")))],
        [(momentum >= top5, 30, F.lit("top momentum")), (momentum >= top20, 15, F.lit("high momentum")), (F.lit(True), 5, F.lit("nonzero momentum"))],
        [(published >= month(12), 10, F.lit("recent 12 months")), (published >= month(36), 5, F.lit("recent 36 months"))],
        [(has("doi"), 10, F.lit("has DOI"))], [(has("arxiv_id"), 5, F.lit("has arxiv_id"))], [(has("pdf_url"), 10, F.lit("has pdf_url"))],
    ]

    def first(rules: list[tuple[Column, int | Column, Column]], at: int) -> Column:
        out = None
        for rule in rules:
            value = rule[at] if isinstance(rule[at], Column) else F.lit(rule[at])
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out

    points = sum((F.coalesce(first(g, 1), F.lit(0)) for g in groups), F.lit(0))
    return papers.withColumn("priority", F.least(points, F.lit(100)).cast("int")).withColumn("reason", F.concat_ws("; ", *(first(g, 2) for g in groups)))
