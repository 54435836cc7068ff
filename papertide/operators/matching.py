"""Deciding which records are the same paper, and merging those that are."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from papertide.operators.graphs import components
from papertide.operators.nearness import run_ratio
from papertide.operators.records import arxiv_base  # noqa: F401
from papertide.operators.titles import FUZZY_CHARS, TITLE_RATIO, folded_names, near_titles


def openalex_key(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), "/+$", ""), F.lit(""))


def resolve_exact(incoming: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds paper_id, rule, confidence: by DOI (1.0), else arXiv id (0.99), else OpenAlex id (0.995), else a new record (0).

    ``ids`` holds (namespace, external_id, paper_id); of several papers of an id the least counts. ``incoming`` has
    doi_key, arxiv_key, openalex_key. Three equi-joins; a null key meets nothing.
    """
    rows = incoming
    for name in ("doi", "arxiv", "openalex"):
        known = ids.filter(F.col("namespace") == name).groupBy(F.col("external_id").alias(f"{name}_key")).agg(F.min("paper_id").alias(f"_{name}"))
        rows = rows.join(known, f"{name}_key", "left")
    has = lambda n: F.col(f"_{n}").isNotNull()
    rule = F.when(has("doi"), "doi_exact").when(has("arxiv"), "arxiv_exact").when(has("openalex"), "openalex_exact").otherwise("new_library_record")
    confidence = F.when(has("doi"), 1.0).when(has("arxiv"), 0.99).when(has("openalex"), 0.995).otherwise(0.0)
    return rows.withColumns({"paper_id": F.coalesce("_doi", "_arxiv", "_openalex"), "rule": rule, "confidence": confidence}).select(*incoming.columns, "paper_id", "rule", "confidence")


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two titles. Where one title is the other with a run of characters put in, all of the shorter one matches; the
    matcher, which passes over frequent characters in texts of 200 or more, is asked about other pairs only."""

    def ratio(x: str, y: str) -> float:
        r = run_ratio(x, y)
        return SequenceMatcher(None, x, y).ratio() if r is None else r

    return pd.Series([1.0 if x == y else ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """left_id, right_id, matched, auto_merge, rule, confidence of pairs with columns ``i_..`` and ``c_..`` (id, doi_key,
    arxiv_key, title_key, authors, year, reference) of the incoming record and the candidate.

    The first rule that holds decides: DOI, arXiv id, a DOI named in the other's journal reference, then the titles' ratio with
    contradicting ids, with first author and year, or neither (a case for review). Only pairs that no id decides get a ratio.
    """
    i, c = (lambda n: F.col(f"i_{n}")), (lambda n: F.col(f"c_{n}"))
    same = lambda n: F.coalesce(i(n) == c(n), F.lit(False))
    named = F.coalesce(F.contains(F.lower(i("reference")), c("doi_key")), F.lit(False)) | F.coalesce(F.contains(F.lower(c("reference")), i("doi_key")), F.lit(False))
    by_id = F.when(same("doi_key"), "doi_exact").when(same("arxiv_key"), "arxiv_exact").when(named, "arxiv_journal_reference_doi")
    rows = pairs.withColumn("_by_id", by_id)
    rows = rows.withColumn("_ratio", F.when(F.col("_by_id").isNull() & i("title_key").isNotNull() & c("title_key").isNotNull(), title_ratio(i("title_key"), c("title_key"))))
    conflict = F.coalesce(i("doi_key") != c("doi_key"), F.lit(False)) | F.coalesce(i("arxiv_key") != c("arxiv_key"), F.lit(False))
    rows = rows.withColumn("_left", folded_names(i("authors"))).withColumn("_right", folded_names(c("authors")))
    left, right = F.col("_left"), F.col("_right")
    shared = F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), F.size(F.array_union(left, right)))
    first = F.coalesce(F.get(left, F.lit(0)) == F.get(right, F.lit(0)), F.lit(False))
    sure = same("title_key") & first & same("year")
    near = F.coalesce(F.col("_ratio") >= TITLE_RATIO, F.lit(False))
    title = F.when(near & conflict, "title_external_id_conflict").when(near & sure, "title_author_year").when(near, "title_similarity_review")
    rule = F.coalesce(F.col("_by_id"), title, F.lit("none"))
    overlap = F.when((F.size(left) > 0) & (F.size(right) > 0), shared).otherwise(0.0)
    confidence = (
        F.when(rule == "doi_exact", 1.0).when(rule == "arxiv_exact", 0.99).when(rule == "arxiv_journal_reference_doi", 0.98)
        .when(rule == "title_author_year", F.least(F.lit(0.97), 0.90 + F.col("_ratio") * 0.04 + overlap * 0.03)).when(near, F.col("_ratio")).otherwise(0.0)
    )
    auto = rule.isin("doi_exact", "arxiv_exact", "arxiv_journal_reference_doi", "title_author_year")
    return rows.select(i("id").alias("left_id"), c("id").alias("right_id"), (rule != "none").alias("matched"), auto.alias("auto_merge"), rule.alias("rule"), confidence.alias("confidence"))


def candidate_pairs(incoming: DataFrame, known: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Pairs for ``score_pairs``: each incoming record with the first known one of its DOI, arXiv id, DOI in the reference and
    title; with ``fuzzy`` also with the first of its title, first author and year, and with the first of every title of ratio ``TITLE_RATIO`` or
    more, none of which is lost, whatever their length (``near_titles``). At most one candidate a key, so pairs grow with the incoming rows whatever the groups' sizes."""
    columns = ["id", "doi_key", "arxiv_key", "title_key", "authors", "year", "reference"]
    named = lambda prefix: [F.col(c).alias(f"{prefix}_{c}") for c in columns]
    keys = [F.concat(F.lit(mark), c) for mark, c in (("d:", "doi_key"), ("x:", "arxiv_key"), ("t:", "title_key"))]
    if fuzzy:
        incoming, known = (df.withColumn("_first", F.get(folded_names(F.col("authors")), F.lit(0))) for df in (incoming, known))
        keys.append(F.concat(F.lit("u:"), "title_key", F.lit("|"), "_first", F.lit("|"), F.col("year").cast("string")))
    every = F.array_compact(F.array(*keys))
    found = F.regexp_extract(F.lower(F.coalesce("reference", F.lit(""))), r"(10\.\d+/[^\s,;)]+)", 1)
    heads = known.select(F.struct(*columns).alias("r"), F.explode(every).alias("k")).groupBy("k").agg(F.min_by("r", "r.id").alias("r"))
    asked = incoming.select(*columns, F.explode(F.array_union(every, F.when(found != "", F.array(F.concat(F.lit("d:"), found))).otherwise(F.array().cast("array<string>")))).alias("k"))
    both = asked.join(heads.hint("merge"), "k")
    if fuzzy:
        near = near_titles(incoming.select("title_key"), known.select("title_key"), runs=True).select(F.col("asked").alias("title_key"), F.concat(F.lit("t:"), "known").alias("k"))
        both = both.select(*columns, "r").unionByName(incoming.select(*columns).join(near.hint("merge"), "title_key").join(heads.hint("merge"), "k").select(*columns, "r"))
    both = both.filter(F.col("id") != F.col("r.id"))
    return both.select(*named("i"), *(F.col("r")[c].alias(f"c_{c}") for c in columns)).dropDuplicates(["i_id", "c_id"])


def best_match(decisions: DataFrame) -> DataFrame:
    """The match of greatest (confidence, auto_merge) of each incoming record, of equals the least candidate."""
    order = F.struct((-F.col("confidence")).alias("a"), (~F.col("auto_merge")).alias("b"), F.col("right_id").alias("c"))
    best = decisions.filter("matched").groupBy("left_id").agg(F.min_by(F.struct("right_id", "auto_merge", "rule", "confidence"), order).alias("r"))
    return best.select("left_id", "r.*")


def plan_versions(incoming: DataFrame, versions: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """id, action, paper_id, rule, confidence, review of incoming records (with source, record_id and keys).

    A record whose (source, record_id) exists updates that version; one whose id or sure match is known is attached; any other
    creates a paper, to be reviewed as an identity match if a title was near, else for its place in the corpus.
    """
    stored = versions.groupBy("source", "record_id").agg(F.min("paper_id").alias("_stored"))
    rows = resolve_exact(incoming, ids).join(stored, ["source", "record_id"], "left")
    best = best_match(score_pairs(candidate_pairs(incoming, known))).select(F.col("left_id").alias("id"), F.col("right_id").alias("_best"), F.col("auto_merge").alias("_auto"), F.col("rule").alias("_rule"), F.col("confidence").alias("_confidence"))
    rows = rows.join(best, "id", "left")
    old, exact, auto, weak = F.col("_stored").isNotNull(), F.col("paper_id").isNotNull(), F.coalesce("_auto", F.lit(False)), F.col("_best").isNotNull()
    return rows.select(
        "id", F.when(old, "updated_existing_version").when(exact | auto, "attached_version").otherwise("created_canonical").alias("action"),
        F.when(old, F.col("_stored")).when(exact, F.col("paper_id")).when(auto, F.col("_best")).alias("paper_id"),
        F.when(old, "source_record_exact").when(exact, F.col("rule")).when(weak, F.col("_rule")).otherwise("new_library_record").alias("rule"),
        F.when(old, 1.0).when(exact, F.col("confidence")).when(weak, F.col("_confidence")).otherwise(0.0).alias("confidence"),
        F.when(~(old | exact | auto), F.when(weak, "identity_match").otherwise("corpus_eligibility")).alias("review"),
    )


def identity_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, conflicts): ``(a, b)`` of each record and the first of its DOI, arXiv id and title. A title that carries two DOIs or
    two arXiv ids links nothing and is a conflict (title_key, records)."""
    titles = records.filter("title_key is not null").groupBy("title_key").agg(F.min("id").alias("b"), F.count("*").alias("records"), *((F.min(c) != F.max(c)).alias(f"two_{c}") for c in ("doi_key", "arxiv_key")))
    several = F.coalesce("two_doi_key", F.lit(False)) | F.coalesce("two_arxiv_key", F.lit(False))
    heads = [(c, records.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias("b"))) for c in ("doi_key", "arxiv_key")]
    heads.append(("title_key", titles.filter(~several).select("title_key", "b")))
    links = [records.select(F.col("id").alias("a"), c).join(h, c).filter("a <> b").select("a", "b") for c, h in heads]
    return reduce(DataFrame.union, links).distinct(), titles.filter(several).select("title_key", "records")


def with_roots(records: DataFrame, links: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``root``, the least id of the record's component."""
    roots = components(links, save).select(F.col("node").alias("id"), "root")
    return records.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _filled(columns: list[str]) -> Column:
    return reduce(Column.__add__, [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns])


def dedup_records(rooted: DataFrame, fill: list[str], score: list[str]) -> DataFrame:
    """One row a root: of each column of ``fill`` the first filled value by metadata score, with copies.

    The score counts the filled columns of ``score`` and up to four points for every 500 characters of the abstract; of equals the
    least id goes first. Values are reduced by ``min_by``, so a component of any size needs no list.
    """
    points = _filled(score) + F.least(F.floor(F.length(F.coalesce("abstract", F.lit(""))) / 500), F.lit(4))
    order = F.struct((-points).alias("s"), F.col("id").alias("i"))
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    first = [F.min_by(c, F.when(given(c), order)).alias(c) for c in fill]
    return rooted.groupBy("root").agg(F.min_by("id", order).alias("base_id"), *first, F.count("*").alias("copies"))


def merge_components(rooted: DataFrame, filled: list[str]) -> DataFrame:
    """root, paper_id (the row of best quality: ids, filled columns, length of the abstract, date, id), created_at, last_seen_at, aliases."""
    ids = _filled(["doi_key", "arxiv_key"])
    quality = F.struct(ids.alias("a"), _filled(filled).alias("b"), F.length(F.coalesce("abstract", F.lit(""))).alias("c"), F.col("pub_date").alias("d"), F.col("id").alias("e"))
    return rooted.groupBy("root").agg(F.max_by("id", quality).alias("paper_id"), F.min("pub_date").alias("created_at"), F.max("pub_date").alias("last_seen_at"), (F.count("*") - 1).alias("aliases"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used; inside functions on arrays a plain column would be computed at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def author_identity(name: Column) -> Column:
    """``last:initials``: the last word, or that before a comma, and the first letters of all words but the last, three at most."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("([a-z]+)"), F.lit(1))

    def identity(every: Column) -> Column:
        last = F.when(F.contains(name, F.lit(",")), F.coalesce(F.try_element_at(words(F.split_part(name, F.lit(","), F.lit(1))), F.lit(-1)), F.get(every, F.lit(0)))).otherwise(F.try_element_at(every, F.lit(-1)))
        initials = F.array_join(F.transform(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1)), "")
        return F.when(F.size(every) > 0, F.concat(last, F.lit(":"), F.substring(initials, 1, 3)))

    return _once(words(name), identity)


def clean_authors(authors: Column) -> Column:
    """Names with single blanks; of names with the same identity the first stays, names without letters go."""
    blanks = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), " , ", ", "))
    named = F.transform(authors, lambda x: _once(blanks(x), lambda y: F.struct(y.alias("name"), author_identity(y).alias("key"))))
    # names and keys of a row are made once and then only looked at
    first = lambda pairs: F.filter(pairs, lambda x, i: F.array_position(pairs.getField("key"), x["key"]) == i + 1)
    return _once(F.filter(named, lambda x: x["key"].isNotNull()), lambda pairs: first(pairs).getField("name"))


def link_publications(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, reviews) of versions with an arXiv id and no DOI: by the DOI in the journal reference, or raw_doi, to the version of that
    DOI (published first, then least id); else the at most two published versions of the same title go to review."""
    sources = versions.filter("arxiv_key is not null and doi_key is null")
    found = F.nullif(F.regexp_extract(F.lower(F.coalesce("reference", F.lit(""))), r"(10\.\d+/[^\s,;)]*[^\s,;.)])", 1), F.lit(""))
    wanted = sources.select("id", "title_key", F.coalesce(found, "raw_doi").alias("doi"))
    published = F.when(F.col("version_type") == "published", 0).otherwise(1)
    targets = versions.filter("doi_key is not null").groupBy(F.col("doi_key").alias("doi")).agg(F.min_by("id", F.struct(published.alias("p"), "id")).alias("target_id"))
    decided = wanted.join(targets, "doi", "left")
    good = F.col("target_id").isNotNull() & (F.col("target_id") != F.col("id"))
    links = decided.filter(good).select("id", "target_id", "doi", F.lit("journal_reference_doi_exact").alias("rule"), F.lit(1.0).alias("confidence"))
    two = versions.filter("version_type = 'published' and title_key is not null").select("title_key", F.col("id").alias("candidate_id"))
    two = two.withColumn("n", F.row_number().over(Window.partitionBy("title_key").orderBy("candidate_id"))).filter("n <= 2").drop("n")
    reviews = decided.filter(~F.coalesce(good, F.lit(False))).select("id", "title_key").join(two, "title_key").filter("candidate_id <> id")
    return links, reviews.select("id", "candidate_id", F.lit("title-only publication candidate requires manual review").alias("reason"))
