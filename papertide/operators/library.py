"""Library upkeep: entity links, recovered versions, enrichment, audits, evidence, receipts and citation items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertide.operators.matching import clean_authors

#: Schema of import receipts that counts as known.
RECEIPT_SCHEMA = 1


def _given(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def link_entities(terms: DataFrame, materials: DataFrame) -> DataFrame:
    """paper_id, kind, entity_id, name, confidence: material terms to the dimension ``materials`` (material_id, name) by lower-case name, the
    others to a topic whose id comes from type and name. Of repeated links the surest stays."""
    known = materials.select("material_id", F.lower("name").alias("_k")).groupBy("_k").agg(F.min("material_id").alias("entity_id"))
    material = F.col("term_type") == "material"
    # one left join: rows stay dealt by paper, which two halves put together again would not
    rows = terms.withColumn("_t", F.lower("normalized_term")).withColumn("_k", F.when(material, F.col("_t"))).join(known, "_k", "left")
    topic = F.md5(F.concat_ws(":", "term_type", "_t").cast("binary"))
    links = rows.select("paper_id", F.when(material, "material").otherwise("topic").alias("kind"), F.when(material, F.col("entity_id")).otherwise(topic).alias("entity_id"), F.col("normalized_term").alias("name"), "confidence")
    return links.filter("entity_id is not null").groupBy("paper_id", "kind", "entity_id").agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"))


def seed_versions(papers: DataFrame, existing: DataFrame, providers: tuple[str, ...] = ("openalex", "crossref", "arxiv")) -> DataFrame:
    """version_id, paper_id, version_type, source, record_id of the versions that rows of ``papers`` (paper_id, source, doi, arxiv_id,
    openalex_id, data_mode) stand for and ``existing`` (version_id) lacks."""
    source = F.lower("source")
    lower = lambda c: F.lower(F.col(c))
    kind = F.when((source == "arxiv") | (_given("arxiv_id") & ~_given("doi")), "preprint").when(_given("doi"), "published").otherwise("metadata")
    record = F.when((source == "openalex") & _given("openalex_id"), lower("openalex_id")).when((source == "arxiv") & _given("arxiv_id"), lower("arxiv_id")).when(_given("doi"), lower("doi")).otherwise(F.col("paper_id"))
    rows = papers.filter((F.col("data_mode") == "real") & source.isin(*providers))
    made = rows.select(F.concat(F.lit("source-version:"), source, F.lit(":"), "paper_id").alias("version_id"), "paper_id", kind.alias("version_type"), source.alias("source"), record.alias("record_id"))
    return made.join(existing.select("version_id"), "version_id", "left_anti")


def enrich_papers(papers: DataFrame, works: DataFrame) -> DataFrame:
    """New snapshot of ``papers`` (paper_id, doi, openalex_id, is_open_access, cited_by_count) with works of the same DOI: non-empty ids win, flags and
    counts only grow, institutions are the distinct ones of the authorships as they first appear. Of several works of a DOI the first id counts."""
    picked = works.groupBy("doi").agg(F.min_by(F.struct("openalex_id", "is_open_access", "pdf_url", "cited_by_count", "authorships"), "openalex_id").alias("w"))
    rows = papers.join(picked, "doi", "left")
    institutions = F.filter(F.array_distinct(F.flatten(F.col("w.authorships"))), lambda x: F.coalesce(x, F.lit("")) != "")
    opened = F.coalesce("is_open_access", F.lit(False)) | F.coalesce("w.is_open_access", F.lit(False)) | (F.coalesce("w.pdf_url", F.lit("")) != "")
    return rows.select(
        "paper_id", "doi", F.coalesce(F.nullif("w.openalex_id", F.lit("")), "openalex_id").alias("openalex_id"), opened.alias("is_open_access"),
        F.greatest(F.coalesce("cited_by_count", F.lit(0)), F.coalesce("w.cited_by_count", F.lit(0))).alias("cited_by_count"), institutions.alias("institutions"), F.col("w").isNotNull().alias("enriched"),
    )


def enrich_candidates(papers: DataFrame, processed: DataFrame, top: int) -> DataFrame:
    """The ``top`` papers to enrich next: real, never enriched and not ``processed``; with a DOI first, then the newest."""
    open_ = papers.filter("data_mode = 'real' and openalex_id is null").join(processed.select("paper_id"), "paper_id", "left_anti")
    return open_.orderBy(F.when(_given("doi"), 0).otherwise(1), F.desc_nulls_last("pub_date"), "paper_id").limit(top).select("paper_id", "doi", "pub_date")


def institution_audit(authorships: DataFrame, schools: list[str], journals: list[str]) -> DataFrame:
    """A row a year with the columns ``<school>_<journal>_participation``, ``_corresponding_explicit`` and ``_unknown``.

    ``authorships`` has a row for each author and institution of a work (work_id, year, journal, institution or null, is_corresponding). A
    work is explicit for a school if a corresponding author belongs to it; unknown if no author is marked as corresponding, or one has no institution.
    """
    corresponding = F.coalesce("is_corresponding", F.lit(False))
    school = [F.bool_or(F.coalesce(F.col("institution") == s, F.lit(False))).alias(f"in_{k}") for k, s in enumerate(schools)]
    leads = [F.bool_or(corresponding & F.coalesce(F.col("institution") == s, F.lit(False))).alias(f"lead_{k}") for k, s in enumerate(schools)]
    works = authorships.groupBy("work_id", "year", "journal").agg(*school, *leads, F.bool_or(corresponding).alias("any"), F.bool_or(corresponding & F.col("institution").isNull()).alias("blank"))
    columns = []
    for k in range(len(schools)):
        for j, journal in enumerate(journals):
            inside = F.col(f"in_{k}") & (F.col("journal") == journal)
            unsure = inside & ~F.col(f"lead_{k}") & (~F.col("any") | F.col("blank"))
            columns += [F.count_if(inside).alias(f"s{k}_j{j}_participation"), F.count_if(inside & F.col(f"lead_{k}")).alias(f"s{k}_j{j}_corresponding_explicit"), F.count_if(unsure).alias(f"s{k}_j{j}_unknown")]
    return works.groupBy("year").agg(*columns)


def brief_evidence(papers: DataFrame, versions: DataFrame, terms: DataFrame, first: str, last: str, top: int, most: int = 16) -> DataFrame:
    """The ``top`` papers of the window by date and citations, dated by their newest version, with their surest ``most`` materials and topics."""
    dated = versions.select(F.col("canonical_paper_id").alias("paper_id"), "version_id", F.coalesce("publication_date", "submitted_date").alias("day"))
    newest = dated.groupBy("paper_id").agg(F.max(F.struct("day", "version_id")).alias("v"))
    rows = papers.filter("data_mode = 'real' and view_eligible").join(newest, "paper_id", "left").withColumn("evidence_date", F.coalesce("v.day", "pub_date"))
    rows = rows.filter(F.col("evidence_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    chosen = rows.orderBy(F.desc("evidence_date"), F.desc("cited_by_count"), "paper_id").limit(top).select("paper_id", "evidence_date", "cited_by_count", "v.version_id")
    kinds = terms.filter("term_type in ('material', 'concept')").join(F.broadcast(chosen.select("paper_id")), "paper_id", "left_semi")
    order = Window.partitionBy("paper_id", "term_type").orderBy(F.desc("confidence"), "normalized_term")
    ranked = kinds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    names = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("term_type") == k, F.struct("n", "normalized_term")))), lambda x: x["normalized_term"]), "|")
    lists = ranked.groupBy("paper_id").agg(names("material").alias("materials"), names("concept").alias("topics"))
    return chosen.join(lists, "paper_id", "left").select("paper_id", "evidence_date", "cited_by_count", "version_id", F.coalesce("materials", F.lit("")).alias("materials"), F.coalesce("topics", F.lit("")).alias("topics"))


def chunk_status(chunks: DataFrame) -> DataFrame:
    """run_id (null for all runs), status, chunks: finished counts as completed, null as pending; ``total`` counts every status."""
    status = F.when(F.col("status") == "finished", "completed").otherwise(F.coalesce("status", F.lit("pending")))
    counted = chunks.groupBy("run_id", status.alias("status")).agg(F.count("*").alias("n"))
    known = counted.filter(F.col("status").isin("completed", "failed", "pending", "running", "skipped"))
    every = known.union(counted.groupBy("run_id").agg(F.lit("total").alias("status"), F.sum("n").alias("n")))
    return every.union(every.groupBy(F.lit(None).cast("string").alias("run_id"), "status").agg(F.sum("n").alias("n"))).select("run_id", "status", F.col("n").alias("chunks"))


def receipt_state(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """path, state, imported_at of files (path, sha256): receipt_missing, receipt_invalid, receipt_schema_mismatch, source_unreadable,
    source_changed or imported. ``receipts`` holds path and the receipt's JSON text."""
    parsed = F.from_json("json", "struct<schema_version:int,source_sha256:string,imported_at:string>", {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.json_object_keys("json").isNotNull(), F.lit(False))
    known = receipts.select("path", parsed.alias("r"), valid.alias("valid"), F.lit(True).alias("there"))
    rows = files.join(known, "path", "left")
    state = (
        F.when(F.col("there").isNull(), "receipt_missing").when(~F.col("valid"), "receipt_invalid").when(~F.col("r.schema_version").eqNullSafe(F.lit(RECEIPT_SCHEMA)), "receipt_schema_mismatch")
        .when(F.col("sha256").isNull(), "source_unreadable").when(~F.col("r.source_sha256").eqNullSafe(F.col("sha256")), "source_changed").otherwise("imported")
    )
    return rows.select("path", state.alias("state"), F.when(F.col("valid"), F.nullif(F.trim("r.imported_at"), F.lit(""))).alias("imported_at"))


def backfill_candidates(papers: DataFrame, versions: DataFrame, tries: DataFrame, now: str, top: int) -> DataFrame:
    """The ``top`` papers (paper_id, last_attempt) without an abstract in the paper or any version whose next attempt is due: never tried ones
    first, then the longest ago, the newest, the most cited. ``versions`` holds canonical_paper_id and abstract, ``tries`` paper_id, last_attempt, next_attempt."""
    empty = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    told = versions.filter(~empty).select(F.col("canonical_paper_id").alias("paper_id"))
    rows = papers.filter((F.col("data_mode") == "real") & F.col("view_eligible") & empty).join(told, "paper_id", "left_anti").join(tries, "paper_id", "left")
    due = rows.filter(F.col("next_attempt").isNull() | (F.col("next_attempt") <= F.lit(now).cast("date")))
    order = [F.when(F.col("last_attempt").isNull(), 0).otherwise(1), F.asc_nulls_first("last_attempt"), F.desc_nulls_last("pub_date"), F.desc("cited_by_count"), F.col("paper_id")]
    return due.orderBy(*order).limit(top).select("paper_id", "last_attempt")


def preferred_versions(versions: DataFrame) -> DataFrame:
    """canonical_paper_id and its preferred version by three rules: ``listed`` (least id that is not legacy and has an abstract, then either),
    ``detailed`` (not legacy, with abstract, published, newest, least id) and ``monitored`` (published, with DOI, newest, greatest id)."""
    legacy, told = F.col("source") == "legacy", F.trim(F.coalesce("abstract", F.lit(""))) != ""
    published = F.coalesce(F.col("version_type").isin("published", "publication"), F.lit(False))
    day = F.coalesce(F.unix_date(F.coalesce("publication_date", "submitted_date")), F.lit(-(1 << 30)))
    flag = lambda c: F.when(c, 1).otherwise(0)
    first = lambda c: F.min(F.when(c, F.col("version_id")))
    listed = F.coalesce(first(~legacy & told), first(~legacy), first(told), F.min("version_id"))
    detailed = F.min_by("version_id", F.struct(flag(legacy).alias("a"), flag(~told).alias("b"), flag(~published).alias("c"), (-day).alias("d"), F.col("version_id").alias("e")))
    monitored = F.max_by("version_id", F.struct(flag(published).alias("a"), flag(_given("doi")).alias("b"), F.coalesce(F.unix_date("publication_date"), F.lit(-(1 << 30))).alias("c"), F.col("version_id").alias("d")))
    return versions.groupBy("canonical_paper_id").agg(listed.alias("listed"), detailed.alias("detailed"), monitored.alias("monitored"))


def creators(authors: Column) -> Column:
    """firstName and lastName of each distinct author: what a comma parts, else the last word unless it is an initial; else the whole name."""

    def split(x: Column) -> Column:
        last, first = F.trim(F.split_part(x, F.lit(","), F.lit(1))), F.trim(F.regexp_extract(x, r"^[^,]*,(.*)$", 1))
        words = F.split(x, " ")
        tail = F.element_at(words, -1)
        comma = F.contains(x, F.lit(",")) & (first != "") & (last != "")
        plain = (F.size(words) >= 2) & ~tail.rlike(r"^[A-Z]\.?$")
        given = F.when(comma, first).when(plain, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        return F.struct(given.alias("firstName"), F.when(comma, last).when(plain, tail).alias("lastName"), F.when(~comma & ~plain, x).alias("name"), F.lit("author").alias("creatorType"))

    return F.transform(clean_authors(authors), split)


def citation_items(papers: DataFrame) -> DataFrame:
    """paper_id and the JSON of its citation item: type by journal, DOI and arXiv id, creators, and tags without later spellings of the same."""
    kind = F.when(_given("journal") | _given("doi"), "journalArticle").when(_given("arxiv_id"), "preprint").otherwise("document")
    clean = F.filter(F.transform(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("Paper Intake"))), lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(clean, lambda x: F.lower(x))
    tags = F.transform(F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), lambda x: F.struct(x.alias("tag")))
    preprint = (kind == "preprint") & _given("arxiv_id")
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    people = creators(F.col("authors"))
    item = F.struct(
        kind.alias("itemType"), text("title").alias("title"), text("abstract").alias("abstractNote"), text("year").alias("date"), text("journal").alias("publicationTitle"), text("doi").alias("DOI"),
        F.when(preprint, F.lit("arXiv")).alias("repository"), F.when(preprint, F.col("arxiv_id")).alias("archiveID"), F.when(F.size(people) > 0, people).alias("creators"), tags.alias("tags"),
    )
    return papers.select("paper_id", F.to_json(item).alias("item"))
