"""Provider records (JSON) to canonical columns, and quality gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.entities import inverted_index_to_text
from papertide.operators.records import normalized_doi

_SOURCE = "struct<id:string,display_name:string,type:string>"
_LOCATION = f"struct<pdf_url:string,landing_page_url:string,source:{_SOURCE}>"
_TOPIC = "struct<id:string,display_name:string,score:double,subfield:struct<id:string,display_name:string>>"
OPENALEX = (
    f"struct<id:string,doi:string,title:string,publication_date:string,type:string,type_crossref:string,cited_by_count:int,open_access:struct<is_oa:boolean,oa_url:string,oa_status:string>,primary_location:{_LOCATION},"
    f"locations:array<{_LOCATION}>,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>,"
    f"concepts:array<struct<display_name:string,score:double>>,topics:array<{_TOPIC}>,primary_topic:{_TOPIC},keywords:array<struct<display_name:string,score:double>>>"
)
_DATED = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    f"struct<DOI:string,title:array<string>,`container-title`:array<string>,`published-print`:{_DATED},`published-online`:{_DATED},published:{_DATED},"
    f"issued:{_DATED},abstract:string,URL:string,publisher:string,type:string,subject:array<string>,license:array<struct<URL:string>>,`reference-count`:int,`is-referenced-by-count`:int>"
)


def first_spellings(names: Column) -> Column:
    """Names without later ones that differ in case only."""
    return F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)) | x.isNull(), acc).otherwise(F.concat(acc, F.array(x))))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def parse_openalex(rows: DataFrame, column: str = "json", fallback_journal: str = "") -> DataFrame:
    """Canonical columns of a work's JSON: doi, title, abstract (from the inverted index), pub_date, journal (of the primary location, else the fallback), authors, concepts (names of
    concepts, topics and primary topic, the first spelling of each), topics, primary_topic, keywords, locations, cited_by_count, pdf_url (of the primary location, else the open one), url,
    is_open_access (open or with a PDF), work_type, type_crossref, source_scope, primary_source_type. Broken JSON gives nulls."""
    rest = [c for c in rows.columns if c != column]
    parsed = rows.select(*rest, F.from_json(F.col(column), OPENALEX).alias("w"))
    plain = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.nullif(F.trim(x["display_name"]), F.lit("")))
    pdf = F.coalesce(F.nullif("w.primary_location.pdf_url", F.lit("")), F.nullif("w.open_access.oa_url", F.lit("")), F.lit(""))
    kind = F.coalesce(F.nullif("w.type", F.lit("")), F.lit("article"))
    return parsed.select(
        *rest, F.col("w.id").alias("openalex_id"), normalized_doi(F.col("w.doi")).alias("doi"), _text(F.col("w.title")).alias("title"), inverted_index_to_text(F.col("w.abstract_inverted_index")).alias("abstract"),
        F.to_date("w.publication_date").alias("pub_date"), F.coalesce(F.nullif("w.primary_location.source.display_name", F.lit("")), F.lit(fallback_journal)).alias("journal"),
        F.filter(F.transform(F.coalesce("w.authorships", F.array()), lambda a: a["author"]["display_name"]), lambda x: _text(x) != "").alias("authors"),
        first_spellings(F.concat(plain("w.concepts"), plain("w.topics"), F.array(F.nullif(F.trim("w.primary_topic.display_name"), F.lit(""))))).alias("concepts"),
        F.col("w.topics").alias("topics"), F.col("w.primary_topic").alias("primary_topic"), F.col("w.keywords").alias("keywords"), F.col("w.locations").alias("locations"),
        F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by_count"), pdf.alias("pdf_url"), F.coalesce(F.nullif("w.primary_location.landing_page_url", F.lit("")), F.nullif(pdf, F.lit("")), F.col("w.id")).alias("url"),
        (F.coalesce("w.open_access.is_oa", F.lit(False)) | (pdf != "")).alias("is_open_access"), kind.alias("work_type"), _text(F.col("w.type_crossref")).alias("type_crossref"),
        F.when(kind == "preprint", "preprint").otherwise("published").alias("source_scope"), F.coalesce(F.nullif(F.lower(F.trim("w.primary_location.source.type")), F.lit("")), F.lit("unknown")).alias("primary_source_type"),
    )


def _date(parts: Column) -> Column:
    """Date of the first date-parts; a missing month or day is 1."""
    p = F.get(parts, F.lit(0))
    return F.make_date(F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.lit(1)), F.coalesce(F.get(p, F.lit(2)), F.lit(1)))


def _untagged(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_text(value), "<[^>]*>", " "), r"\s+", " "))


def parse_crossref(rows: DataFrame, column: str = "json", fallback_journal: str = "") -> DataFrame:
    """Canonical columns of a work's JSON: doi, title (all parts), abstract without tags, pub_date (of the first that is given: print, online, published, issued), journal, url,
    publisher, subjects, reference_count, cited_by_count, is_open_access (with a licence), work_type, source_scope. Broken JSON gives nulls."""
    rest = [c for c in rows.columns if c != column]
    parsed = rows.select(*rest, F.from_json(F.col(column), CROSSREF).alias("w"))
    dated = F.coalesce(*(F.col(f"w.`{k}`") for k in ("published-print", "published-online", "published", "issued")))
    doi, joined = normalized_doi(F.col("w.DOI")), lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    return parsed.select(
        *rest, doi.alias("doi"), _untagged(joined("w.title")).alias("title"), _untagged(F.col("w.abstract")).alias("abstract"), _date(dated["date-parts"]).alias("pub_date"),
        F.coalesce(F.nullif(joined("w.`container-title`"), F.lit("")), F.lit(fallback_journal)).alias("journal"), F.coalesce(F.nullif("w.URL", F.lit("")), F.concat(F.lit("https://doi.org/"), doi), F.lit("")).alias("url"),
        _text(F.col("w.publisher")).alias("publisher"), F.coalesce("w.subject", F.array().cast("array<string>")).alias("subjects"), F.coalesce("w.reference-count", F.lit(0)).alias("reference_count"),
        F.coalesce("w.is-referenced-by-count", F.lit(0)).alias("cited_by_count"), (F.coalesce(F.size("w.license"), F.lit(0)) > 0).alias("is_open_access"), _text(F.col("w.type")).alias("work_type"), F.lit("published").alias("source_scope"),
    )


def last_part(address: Column) -> Column:
    """What stands behind the last slash of an address, slashes at its end aside; empty for null."""
    return F.regexp_extract(F.coalesce(address, F.lit("")), r"([^/]*)/*$", 1)


def topic_gate(rows: DataFrame, subfield: str, by_text: Column, generalists: list[str], primary: float = 0.35, any_score: float = 0.45) -> DataFrame:
    """Adds primary_score, best_score, topic_keep, generalist_only and passes to works (topics, primary_topic, journal as ``parse_openalex`` reads them).

    A work's topics keep it if its primary topic is of the subfield with a score of ``primary`` or any topic of it has ``any_score``; the primary topic has the better of
    its own score and the one it has among the topics. ``by_text`` says that the text alone keeps it: in a journal of ``generalists`` topics without that
    do not suffice. No topics, no scores and no journal count as 0 and as the empty name.
    """
    top, empty = F.col("primary_topic"), F.array().cast(rows.schema["topics"].dataType)
    most = lambda xs: F.greatest(F.coalesce(F.array_max(F.transform(xs, lambda x: x["score"])), F.lit(0.0)), F.lit(0.0))
    inside = F.filter(F.coalesce("topics", empty), lambda x: last_part(x["subfield"]["id"]) == subfield)
    same = F.filter(inside, lambda x: (F.coalesce(top["id"], F.lit("")) != "") & (x["id"] == top["id"]))
    journal = F.lower(F.trim(F.regexp_replace(F.coalesce("journal", F.lit("")), r"\s+", " ")))
    scored = rows.withColumns({"primary_score": F.greatest(F.coalesce(top["score"], F.lit(0.0)), most(same)), "best_score": most(inside)})
    kept = ((last_part(top["subfield"]["id"]) == subfield) & (F.col("primary_score") >= primary)) | (F.col("best_score") >= any_score)
    text = F.coalesce(by_text, F.lit(False))
    scored = scored.withColumn("topic_keep", kept).withColumn("generalist_only", F.col("topic_keep") & ~text & journal.isin([x.lower() for x in generalists]))
    return scored.withColumn("passes", text | (F.col("topic_keep") & ~F.col("generalist_only")))


def source_quality(rows: DataFrame, trusted: tuple[list[str], list[str]], repositories: tuple[list[str], list[str]], formal_types: list[str], formal_crossref: list[str], repository_dois: list[str]) -> DataFrame:
    """Adds repository_primary, trusted_preprint, formal_venue_evidence, decision and eligible to works (doi, type_crossref, primary_location, locations as
    ``parse_openalex`` reads them; a location has pdf_url, landing_page_url and source with display_name and type).

    ``trusted`` and ``repositories`` are names and hosts; a host counts with all below it. A work whose primary location is a repository and no trusted preprint server needs formal
    evidence: a location of one of ``formal_types``, or a DOI outside ``repository_dois`` of one of ``formal_crossref``. Else it is excluded; what names no source stays.
    """
    place = F.col("primary_location")
    every = F.coalesce("locations", F.array().cast(rows.schema["locations"].dataType))
    every = F.when(place.isNotNull() & ~F.array_contains(every, place), F.concat(F.array(place), every)).otherwise(every)
    name = lambda x: F.lower(F.trim(F.coalesce(x["source"]["display_name"], F.lit(""))))
    kind = lambda x: F.lower(F.trim(F.coalesce(x["source"]["type"], F.lit(""))))
    host = lambda url: F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    below = lambda h, xs: F.exists(F.array(*map(F.lit, xs)).cast("array<string>"), lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x)))
    at = lambda xs: below(host(place["landing_page_url"]), xs) | below(host(place["pdf_url"]), xs)
    known = lambda xs: name(place).isin(*(x.lower() for x in xs)) if xs else F.lit(False)
    is_trusted, is_repository = known(trusted[0]) | at(trusted[1]), (kind(place) == "repository") | known(repositories[0]) | at(repositories[1])
    doi = F.coalesce(normalized_doi(F.col("doi")), F.lit(""))
    formal_doi = (doi != "") & ~F.exists(F.array(*map(F.lit, repository_dois)).cast("array<string>"), lambda p: F.startswith(doi, p)) & F.lower(F.trim(F.coalesce("type_crossref", F.lit("")))).isin(*formal_crossref)
    marked = rows.withColumns({
        "repository_primary": F.coalesce(is_repository, F.lit(False)), "trusted_preprint": F.coalesce(is_trusted, F.lit(False)), "formal_venue_evidence": F.exists(every, lambda x: kind(x).isin(*formal_types)) | formal_doi,
    })
    decision = (
        F.when(F.col("repository_primary") & ~F.col("trusted_preprint") & ~F.col("formal_venue_evidence"), "exclude_generic_repository_without_formal_version").when(F.col("trusted_preprint"), "allow_trusted_preprint")
        .when(F.col("formal_venue_evidence"), "allow_formal_scholarly_venue").when(F.coalesce(kind(place), F.lit("")).isin(*formal_types), "allow_primary_scholarly_venue").otherwise("allow_no_explicit_repository_evidence")
    )
    return marked.withColumn("decision", decision).withColumn("eligible", ~F.startswith("decision", F.lit("exclude")))
