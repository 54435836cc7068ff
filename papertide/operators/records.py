"""Identity resolution, merging, change detection and operations data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.titles import folded_names, folded_title


def normalized_doi(doi: Column) -> Column:
    """Lower case without resolver prefix and without dots at its ends; empty becomes null."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.btrim(F.trim(F.regexp_replace(bare, r"^doi:\s*", "")), F.lit(".")), F.lit(""))


def arxiv_base(value: Column) -> Column:
    """Lower-case arXiv id without prefix, address, suffix and version; empty becomes null."""
    return F.nullif(F.regexp_replace(_arxiv(value), r"v\d+$", ""), F.lit(""))


def arxiv_version(value: Column) -> Column:
    """Version number at the end of an arXiv id, null without one."""
    return F.nullif(F.regexp_extract(_arxiv(value), r".v(\d+)$", 1), F.lit("")).cast("int")


def _arxiv(value: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^arxiv:\s*", "")
    bare = F.regexp_replace(bare, r"^https?://(export\.)?arxiv\.org/(abs|pdf)/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"\.pdf$", "")


def title_key(title: Column) -> Column:
    """Letters and digits without accents and markup, lower case, with single blanks; null if nothing is left."""
    return folded_title(title)


def with_identity_keys(records: DataFrame) -> DataFrame:
    """Adds doi_key, arxiv_key and arxiv_version, title_key, author_keys (folded names in order) and year of records (doi, title,
    pub_date, and arxiv_id and authors where they have them)."""
    given = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    arxiv = given("arxiv_id", "string")
    return records.withColumns({
        "doi_key": normalized_doi(F.col("doi")), "arxiv_key": arxiv_base(arxiv), "arxiv_version": arxiv_version(arxiv), "title_key": title_key(F.col("title")),
        "author_keys": folded_names(given("authors", "array<string>")), "year": F.year("pub_date"),
    })


def title_candidates(records: DataFrame, least: int = 16) -> DataFrame:
    """left_id, right_id: each record and the first of its title, for titles of ``least`` characters at least. One pair a record, not
    all pairs of a title: what joins them is the same."""
    long_titles = records.filter(F.length("title_key") >= least)
    heads = long_titles.groupBy("title_key").agg(F.min("id").alias("right_id"))
    return long_titles.select(F.col("id").alias("left_id"), "title_key").join(heads, "title_key").filter("left_id <> right_id")


def id_conflicts(claims: DataFrame) -> DataFrame:
    """namespace, external_id, kept (the paper of the first claim), papers (several)."""
    return claims.groupBy("namespace", "external_id").agg(F.min_by("paper_id", F.struct("claimed_at", "paper_id")).alias("kept"), F.countDistinct("paper_id").alias("papers")).filter("papers > 1")


def merge_sources(records: DataFrame, key: str, order: str, fill: list[str], grow: list[str], any_of: list[str]) -> DataFrame:
    """One row a key: of ``fill`` the first non-null by ``order``, of ``grow`` the greatest, of ``any_of`` any true."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in fill]
    return records.groupBy(key).agg(*first, *(F.max(c).alias(c) for c in grow), *(F.bool_or(c).alias(c) for c in any_of), F.count("*").alias("records"))


def new_records(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose DOI is unseen or, without DOI, whose title is; one for each key."""
    doi = known.filter("doi_key is not null").select("doi_key").distinct()
    title = known.filter("title_key is not null").select("title_key").distinct()
    with_doi = incoming.filter("doi_key is not null").join(doi, "doi_key", "left_anti").select(*incoming.columns)
    without = incoming.filter("doi_key is null").join(title, "title_key", "left_anti").select(*incoming.columns)
    key = F.coalesce("doi_key", "title_key")
    return with_doi.unionByName(without).withColumn("_k", key).filter("_k is not null").groupBy("_k").agg(F.min(F.struct(*incoming.columns)).alias("r")).select("r.*")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, fields (names of the columns that differ); null or empty incoming values never count."""
    given = lambda c: F.col(f"n.{c}").isNotNull() & (F.col(f"n.{c}").cast("string") != "")
    joined = old.alias("o").join(new.alias("n"), key)
    fields = F.filter(F.array(*(F.when(given(c) & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return joined.select(key, fields.alias("fields")).filter(F.size("fields") > 0)


def upsert(target: DataFrame, incoming: DataFrame, key: str, replace: list[str], grow: list[str]) -> DataFrame:
    """New snapshot of ``target``: non-empty incoming values win, those of ``grow`` only rise."""
    t, i = target.alias("t"), incoming.alias("i")
    joined = t.join(i, F.col(f"t.{key}") == F.col(f"i.{key}"), "full")
    picked = [F.coalesce(F.when(F.col(f"i.{c}").cast("string") != "", F.col(f"i.{c}")), F.col(f"t.{c}")).alias(c) for c in replace]
    raised = [F.greatest(F.col(f"t.{c}"), F.col(f"i.{c}")).alias(c) for c in grow]
    return joined.select(F.coalesce(f"t.{key}", f"i.{key}").alias(key), *picked, *raised)


def replace_for_keys(target: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``target`` with all rows of the keys replaced by ``new``; no keys, no change."""
    return target.join(keys.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(new)


def latest_status(papers: DataFrame, tasks: DataFrame, order: Column) -> DataFrame:
    """paper_id, status, attempts of every paper: the status of its last task by ``order``, ``not_requested`` without one."""
    last = tasks.groupBy("paper_id").agg(F.max_by("status", order).alias("status"), F.max("attempt_number").alias("attempts"))
    return papers.select("paper_id").join(last, "paper_id", "left").select("paper_id", F.coalesce("status", F.lit("not_requested")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def hit_rollup(hits: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """monitor_id, paper_id, first_matched, last_matched, matches, hit_id, version_id, version_type: one row for each rule and paper of hits (monitor_id, paper_id, version_id,
    hit_id, first_matched, last_matched, matches). Hit and version are those of a published version (versions: version_id, version_type), then of
    the latest match, then of the least hit_id; a hit whose version is unknown ranks as not published. A version named by several rows counts once, as published if one of them says so.
    Without ``versions`` the hits bring their version_type, and hits that are dealt by paper are not shuffled again."""
    late = F.coalesce(-F.unix_micros(F.col("last_matched").cast("timestamp")), F.lit(1 << 62))  # no date ranks last
    kind = F.when(F.col("version_type").isin("publication", "published"), 0).otherwise(1)
    rank = F.struct(kind.alias("kind"), late.alias("late"), F.col("hit_id").alias("id"))
    if versions is not None:
        hits = hits.join(versions.groupBy("version_id").agg(F.min_by("version_type", F.struct(kind, "version_type")).alias("version_type")), "version_id", "left")
    rows = hits.groupBy("monitor_id", "paper_id").agg(F.min("first_matched").alias("first_matched"), F.max("last_matched").alias("last_matched"), F.sum("matches").alias("matches"), F.min_by(F.struct("hit_id", "version_id", "version_type"), rank).alias("b"))
    return rows.select("monitor_id", "paper_id", "first_matched", "last_matched", "matches", "b.*")


#: States from which a task may be put back.
FAILED = ("retryable_failed", "permanent_failed", "manual_review")


def due_tasks(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    """The ``limit`` tasks (status, next_attempt_at, priority, created_at, task_id) to work on next: pending, or failed for a while with no or a reached time; by falling priority, then age."""
    reached = (F.col("status") == "retryable_failed") & F.coalesce(F.col("next_attempt_at") <= now, F.lit(True))
    return tasks.filter((F.col("status") == "pending") | reached).orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def requeue(tasks: DataFrame, attempts: DataFrame, ids: DataFrame | None = None, failure_classes: tuple[str, ...] = (), sources: tuple[str, ...] = (), limit: int | None = 25) -> DataFrame:
    """New snapshot of tasks (task_id, status, attempt_count, next_attempt_at, last_error, source, updated_at, created_at) with failed ones pending again, their attempts, time, error and source unset.

    With ``ids`` (task_id; an empty table chooses none) those of them that failed, ``limit`` of them if it is given. Else 1 to 100 of all failed ones, those longest untouched first, whose last
    attempt (attempts: task_id, attempt_number, candidate_index, failure_class) has one of the classes or whose error names it in brackets, and that come from one of the sources; no
    classes and no sources ask for nothing. The limit is the feature: a stated number of tasks is put back at a time.
    """
    failed = tasks.filter(F.col("status").isin(*FAILED))
    if ids is not None:
        chosen = failed.join(ids.select("task_id").distinct(), "task_id", "left_semi")
    else:
        limit, chosen = max(1, min(limit or 25, 100)), failed
        if failure_classes:
            last = attempts.groupBy("task_id").agg(F.max_by("failure_class", F.struct("attempt_number", "candidate_index")).alias("_class"))
            named = reduce(Column.__or__, [F.contains(F.coalesce("last_error", F.lit("")), F.lit(f"[{k}]")) for k in failure_classes])
            chosen = failed.join(last, "task_id", "left").filter(F.coalesce(F.col("_class").isin(*failure_classes), F.lit(False)) | named)
        if sources:
            chosen = chosen.filter(F.coalesce("source", F.lit("")).isin(*sources))
    if limit is not None:
        chosen = chosen.orderBy("updated_at", "created_at", "task_id").limit(max(0, limit))
    marked = tasks.join(chosen.select("task_id", F.lit(True).alias("_again")), "task_id", "left")
    reset = {"status": F.lit("pending"), "attempt_count": F.lit(0), "next_attempt_at": F.lit(None), "last_error": F.lit(None), "source": F.lit(None)}
    return marked.select(*(F.when(F.col("_again"), reset[c]).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in tasks.columns))


def best_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    names = rows.columns
    return rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*(o.alias(f"o{n}") for n, o in enumerate(order)))).alias("r")).select("r.*")


def with_version_type(records: DataFrame) -> DataFrame:
    """Adds version_type: an explicit known one, else a preprint (arXiv id, no DOI, from arXiv), else published (DOI), imported (by source) or metadata.
    Columns version_type, doi, arxiv_id, source, journal; missing ones count as empty."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")
    explicit, doi, arxiv = F.lower(F.trim(given("version_type"))), normalized_doi(given("doi")), arxiv_base(given("arxiv_id"))
    source = F.lower(given("source"))
    preprint = arxiv.isNotNull() & doi.isNull() & ((source == "arxiv") | F.contains(F.lower(given("journal")), F.lit("arxiv")))
    kind = (
        F.when(explicit.isin("preprint", "published", "repository", "imported", "metadata"), explicit).when(preprint, "preprint").when(doi.isNotNull(), "published")
        .when(source.isin("legacy_intake", "imported", "repository"), "imported").otherwise("metadata")
    )
    return records.withColumn("version_type", kind)


def _present(records: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in records.columns else F.lit(None).cast(kind)


def ris(records: DataFrame) -> DataFrame:
    """paper_id and its RIS text (TY, TI, an AU line an author, JO, PY, DO, UR, AB) of records with title, and authors, journal, year, doi, url, abstract where they have
    them; empty fields are left out, the title line always stands."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    line = lambda tag, name: F.when(clean(_present(records, name)) != "", F.concat(F.lit(f"{tag}  - "), clean(_present(records, name))))
    authors = F.coalesce(_present(records, "authors", "array<string>"), F.array().cast("array<string>"))
    named = F.array_join(F.transform(F.filter(authors, lambda a: clean(a) != ""), lambda a: F.concat(F.lit("AU  - "), clean(a))), "\r\n")
    lines = [F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), clean(_present(records, "title"))), F.nullif(named, F.lit("")), *(line(t, n) for t, n in (("JO", "journal"), ("PY", "year"), ("DO", "doi"), ("UR", "url"), ("AB", "abstract"))), F.lit("ER  -")]
    return records.select("paper_id", F.concat_ws("\r\n", *lines).alias("ris"))


def bibtex(records: DataFrame) -> DataFrame:
    """paper_id and its BibTeX entry (article with a journal, else misc) under ``citation_key``: title, author, year, journal, doi, url (else the PDF's), abstract,
    eprint; empty fields are left out, braces in values dropped."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c.cast("string"), "[{}]", ""), r"\s+", " "))
    line = lambda name, c: F.when(clean(c) != "", F.concat(F.lit(f"  {name} = {{"), clean(c), F.lit("}")))
    has = lambda n: F.nullif(_present(records, n).cast("string"), F.lit(""))
    kind = F.when(has("journal").isNull(), "misc").otherwise("article")
    authors = F.array_join(_present(records, "authors", "array<string>"), " and ")
    fields = F.concat_ws(
        ",\n", line("title", has("title")), line("author", authors), line("year", has("year")), line("journal", has("journal")), line("doi", has("doi")), line("url", F.coalesce(has("url"), has("pdf_url"))), line("abstract", has("abstract")),
        line("eprint", has("arxiv_id")), F.when(has("arxiv_id").isNotNull(), F.lit("  archivePrefix = {arXiv}")),
    )
    return records.select("paper_id", F.concat(F.lit("@"), kind, F.lit("{"), F.col("citation_key"), F.lit(",\n"), fields, F.lit("\n}")).alias("bibtex"))


def citation_base(records: DataFrame) -> Column:
    """``author_year_word``: last name of the first author (before a comma, else the last word), the year or ``nd``, and the first title word of three characters or
    more, with other signs as single underscores."""
    first = F.trim(F.coalesce(F.get(_present(records, "authors", "array<string>"), F.lit(0)), F.lit("unknown")))
    last = F.when(F.contains(first, F.lit(",")), F.split_part(first, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(first, r"\s+"), -1))
    word = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(_present(records, "title"), F.lit("")), r"([A-Za-z0-9]{3,})", 1), F.lit("")), F.lit("paper"))
    base = F.concat_ws("_", last, F.coalesce(_present(records, "year").cast("string"), F.lit("nd")), word)
    return F.btrim(F.regexp_replace(base, r"[^A-Za-z0-9]+", "_"), F.lit("_"))


def citation_keys(records: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """paper_id, citation_key: base key, later papers of the same base get _2, _3 in id order. ``records`` has paper_id and base, or the columns of ``citation_base``.

    Ranks come from one window a base, which one author, year and word bound; a base with more than ``hot_rows`` papers (records without
    author or title) is ranked in range partitions of the ids.
    """
    named = records.select("paper_id", (F.col("base") if "base" in records.columns else citation_base(records)).alias("base"))
    sizes = named.groupBy("base").agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).select("base")
    if hot.isEmpty():
        ranked = named.withColumn("n", F.expr("row_number() over (partition by base order by paper_id)"))
    else:
        cold = named.join(hot, "base", "left_anti").withColumn("n", F.expr("row_number() over (partition by base order by paper_id)"))
        dealt = named.join(hot, "base", "left_semi").repartitionByRange("base", "paper_id").sortWithinPartitions("base", "paper_id").withColumn("_p", F.spark_partition_id())
        counts = dealt.groupBy("base", "_p").agg(F.count("*").alias("_k")).withColumn("_before", F.expr("coalesce(sum(_k) over (partition by base order by _p rows between unbounded preceding and 1 preceding), 0)")).drop("_k")
        inside = dealt.withColumn("_i", F.expr("row_number() over (partition by base, _p order by paper_id)"))
        ranked = cold.unionByName(inside.join(counts, ["base", "_p"]).select("paper_id", "base", (F.col("_i") + F.col("_before")).cast("int").alias("n")))
    return ranked.select("paper_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("citation_key"))


def completeness_grid(facts: DataFrame, dims: list[DataFrame], keys: list[str]) -> DataFrame:
    """Every expected cell of the dimensions (small tables); cells without facts stay null, not 0."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)
    return grid.join(facts, keys, "left")
