"""Terms, formulas, filters, relevance and search postings from texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.ordering import packed_groups

# The chemical elements; those made only in reactors are no material; molecules that are no formula.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U"
).split()
NO_FORMULAS = ("H2O", "CO2", "O2", "N2", "NH3", "CH4", "NO", "NO2")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; hyphens and other marks part words."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")), " "), "")


def phrases(words: str, longest: int = 4) -> Column:
    """All distinct runs of one to ``longest`` words of a column of words (a plain column: an expression
    would be computed again for every run)."""
    words = F.col(words)
    run = lambda n: F.transform(words, lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, n))))
    fits = lambda n: lambda _, i: i <= F.size(words) - n
    runs = [F.filter(run(n), fits(n)) if n > 1 else words for n in range(1, longest + 1)]
    return F.array_distinct(F.flatten(F.array(*runs)))


#: First words of phrases that are looked for in a text directly; with more every run of words is looked up.
HEADS = 5_000


def phrase_hits(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The rows of ``texts`` (without ``text``) for each phrase of ``dictionary`` they hold, with its other columns; once a text.

    Only runs of words that start like a phrase leave the text, as long as the longest phrase; they meet the phrases by an
    equi-join, so the cost follows the text and not the number of phrases.
    """
    key = dictionary.withColumn("_words", tokens(F.col("phrase"))).filter(F.size("_words") > 0)
    heads = [r[0] for r in key.select(F.get("_words", F.lit(0))).distinct().limit(HEADS + 1).collect()]
    longest = key.agg(F.max(F.size("_words"))).first()[0] or 1
    rest = [c for c in texts.columns if c != "text"]
    worded = texts.select(*rest, F.explode(F.array(tokens(F.col("text")))).alias("_w"))  # cut to words once
    words = F.col("_w")
    starts = F.transform(words, lambda w, i: F.when(w.isin(heads), i) if len(heads) <= HEADS else i)
    run = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)), lambda k: F.array_join(F.slice(words, i + 1, k), " "))
    runs = worded.select(*rest, F.explode(F.array_distinct(F.flatten(F.transform(F.array_compact(starts), run)))).alias("_run"))
    return runs.join(key.withColumn("_run", F.array_join("_words", " ")).drop("_words"), "_run").drop("_run")


def by_field(docs: DataFrame) -> DataFrame:
    """doc_id, field (title or abstract), text."""
    return docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "abstract")))))


def extract_terms(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, term, term_type, confidence: dictionary phrases (phrase, term, term_type, in_title, in_abstract)
    found in title or abstract, the best confidence of each."""
    hits = phrase_hits(by_field(docs), dictionary)
    return hits.groupBy("doc_id", "term", "term_type").agg(F.max(F.when(F.col("field") == "title", F.col("in_title")).otherwise(F.col("in_abstract"))).alias("confidence"))


def normalize_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds ``normalized``: the synonym's canonical form, matched without case, hyphens and outer marks."""
    key = F.array_join(tokens(F.col("term")), " ")
    known = synonyms.select(F.array_join(tokens(F.col("alias")), " ").alias("_k"), "canonical").dropDuplicates(["_k"])
    cleaned = F.btrim(F.regexp_replace("term", r"\s+", " "), F.lit(" .,;:()[]{}"))
    return terms.withColumn("_k", key).join(known, "_k", "left").withColumn("normalized", F.coalesce("canonical", cleaned)).drop("_k", "canonical")


def eligibility(terms: DataFrame, generic: list[str], allowed: list[str], methods: list[str], broken: tuple[str, ...] = (), plain_methods: tuple[str, ...] = ()) -> DataFrame:
    """Adds display_eligible and display_reason by the first rule that holds. A generic word among ``plain_methods`` is a method all the same if it stands as one; a term
    that holds one of ``broken`` anywhere is a scrap of a longer phrase, unless it is allowed."""
    key = F.lower(F.replace(F.trim("term"), F.lit("-"), F.lit(" ")))
    scrap = reduce(Column.__or__, [F.contains(key, F.lit(x)) for x in broken], F.lit(False))
    named_method = (F.col("term_type") == "method") & (key.isin(*plain_methods) if plain_methods else F.lit(False))
    formula = F.col("term").rlike(r"^([A-Z][a-z]?[0-9]*){2,}$")
    words = F.split(key, " ")
    all_generic = (F.size(words) >= 2) & F.forall(words, lambda w: w.isin(*generic, "van", "der", "waals"))
    reason = (
        F.when(F.length(F.trim("term")) < 3, "too_short").when(key.isin(generic), F.when(named_method, "method_dictionary").otherwise("generic_term"))
        .when(scrap & ~key.isin(allowed), "broken_ngram").when(all_generic & ~key.isin(allowed), "generic_ngram")
        .when(F.col("term_type") == "material", F.when(formula | key.isin(allowed), "material").otherwise("weak_material_candidate"))
        .when(F.col("term_type") == "method", F.when(key.isin(methods), "method_dictionary").otherwise("weak_method_candidate"))
        .when(key.isin(allowed), "canonical_phrase").when(formula, "material_formula").when(F.col("confidence") < 0.7, "weak_candidate").otherwise("not_canonical")
    )
    good = F.col("display_reason").isin("material", "method_dictionary", "canonical_phrase", "material_formula")
    return terms.withColumn("display_reason", reason).withColumn("display_eligible", good.cast("int"))


def material_search(materials: DataFrame, aliases: DataFrame, wanted: str) -> DataFrame:
    """material_id of the materials (canonical_name, material_family, phase, thickness, composition) that hold ``wanted`` in one of the five, or in an alias (material_id, alias), without
    case; all materials if nothing is wanted. Both tables are read once and not joined."""
    word = wanted.strip().lower()
    if not word:
        return materials.select("material_id").distinct()
    holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word))
    by_name = materials.filter(reduce(Column.__or__, [holds(c) for c in ("canonical_name", "material_family", "phase", "thickness", "composition")]))
    return by_name.select("material_id").union(aliases.filter(holds("alias")).select("material_id")).distinct()


def formulas(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, formula: chemical formulas of two elements at least, 4 to 32 characters; without digits
    at most three elements. Known molecules and unknown symbols are left out."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9])((?:[A-Z][a-z]?(?:[0-9]+(?:\.[0-9]+)?)?){2,})(?![A-Za-z0-9])"), F.lit(1))))
    rows = docs.select("doc_id", found.alias("formula"))
    symbols = F.regexp_extract_all("formula", F.lit("([A-Z][a-z]?)"), F.lit(1))
    known = F.forall(symbols, lambda s: s.isin(*ELEMENTS))
    short = F.col("formula").rlike("[0-9]") | (F.size(symbols) <= 3)
    return rows.filter(F.length("formula").between(4, 32) & ~F.col("formula").isin(*NO_FORMULAS) & known & short)


def lookup_text(*texts: Column) -> Column:
    """Texts one after the other, lower case, hyphens as blanks, single blanks: what terms are looked up in."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.concat_ws(" ", *texts)), F.lit("-"), F.lit(" ")), r"\s+", " "))


def _first_held(text: Column, terms: list[str], mark: str) -> Column:
    """``mark:term`` of the first term that the text holds, null if it holds none."""
    keys = F.array(*(F.struct(F.lit(" ".join(x.lower().replace("-", " ").split())).alias("k"), F.lit(x).alias("t")) for x in terms)) if terms else None
    if keys is None:
        return F.lit(None).cast("string")
    return F.concat(F.lit(mark + ":"), F.get(F.transform(F.filter(keys, lambda x: F.contains(text, x["k"])), lambda x: x["t"]), F.lit(0)))


def field_filter(docs: DataFrame, prefixes: list[str], hard: list[str], keep: list[str], drop: list[str], categories: str, texts: list[str]) -> DataFrame:
    """Adds in_field and reason. The first that holds decides: a category (array) with one of the prefixes, a hard term, a keyword; an exclusion keeps nothing
    in that one of them has let in. Terms are found anywhere in the columns ``texts`` and the categories, without case and hyphens; the first of each list
    is named. ``none`` if nothing holds."""
    cats = F.coalesce(F.col(categories), F.array().cast("array<string>"))
    rows = docs.withColumn("_text", lookup_text(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts), F.array_join(cats, " ")))
    text = F.col("_text")
    by_category = F.when(F.exists(cats, lambda c: reduce(Column.__or__, [F.startswith(c, F.lit(p)) for p in prefixes])), "category")
    reason = F.coalesce(by_category, _first_held(text, hard, "hard"), _first_held(text, keep, "keyword"), _first_held(text, drop, "exclude"), F.lit("none"))
    return rows.withColumn("reason", reason).withColumn("in_field", (F.col("reason") == "category") | F.col("reason").rlike("^(hard|keyword):")).drop("_text")


def grade_field(filtered: DataFrame, direct: str, categories: str, concepts: str, hints: list[str], journals: list[str], text_hints: list[str], texts: list[str], strict: bool = False) -> DataFrame:
    """Adds kept, grade and grade_reason to rows of ``field_filter``: high with a category that starts with ``direct`` or a hard term, medium with another reason. Of the rest,
    ``strict`` excludes all; else a concept with one of the hints or, in one of ``journals``, a text with one of ``text_hints`` is medium, and what
    is left is low, to be reviewed."""
    empty = F.array().cast("array<string>")
    any_of = lambda text, xs: reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in xs], F.lit(False))
    is_direct = F.exists(F.coalesce(F.col(categories), empty), lambda c: F.startswith(c, F.lit(direct)))
    hinted = F.exists(F.coalesce(F.col(concepts), empty), lambda c: any_of(lookup_text(c), hints))
    relaxed = F.coalesce("journal", F.lit("")).isin(*journals) & any_of(lookup_text(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts)), text_hints)
    why = F.when(is_direct, "direct").when(F.col("in_field"), F.when(F.startswith("reason", F.lit("hard:")), "hard").otherwise("filter"))
    why = F.coalesce(why, F.lit("strict")) if strict else F.coalesce(why, F.when(hinted, "concept").when(relaxed, "journal").otherwise("review"))
    grade = F.when(F.col("grade_reason").isin("direct", "hard"), "high").when(F.col("grade_reason") == "strict", "excluded").when(F.col("grade_reason") == "review", "low").otherwise("medium")
    return filtered.withColumn("grade_reason", why).withColumn("grade", grade).withColumn("kept", F.col("grade") != "excluded")


# Words that say nothing about a prompt.
STOP_WORDS = ("about", "after", "also", "and", "are", "can", "for", "from", "into", "paper", "papers", "recent", "that", "the", "this", "with")


def prompt_terms(text: Column) -> Column:
    """Distinct lower-case words of three characters or more that start with a letter, hyphens inside, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9\-]{2,})"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def relevance(docs: DataFrame, prompt: str, texts: list[str], abstract: str, link: str) -> DataFrame:
    """Adds overlap (terms that texts and prompt share), score (2 + 1.2 a shared term up to 6, 0.8 with a PDF link, 0.8 with an abstract, at most 10, one
    digit) and priority (high from 7, medium from 4)."""
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 0.8).otherwise(0.0)
    words = prompt_terms(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in texts)))
    rows = docs.withColumn("overlap", F.size(F.array_intersect(words, prompt_terms(F.lit(prompt)))))
    rows = rows.withColumn("score", F.least(F.lit(10.0), F.round(2.0 + F.least(1.2 * F.col("overlap"), F.lit(6.0)) + has(link) + has(abstract), 1)))
    return rows.withColumn("priority", F.when(F.col("score") >= 7, "high").when(F.col("score") >= 4, "medium").otherwise("low"))


def postings(docs: DataFrame, text: str) -> DataFrame:
    """token, doc_id, tf, length (words of the document)."""
    # the length is made before the words become rows, else each row would carry all words of its document
    sized = docs.select("doc_id", tokens(F.col(text)).alias("w")).select("doc_id", F.size("w").alias("length"), "w")
    worded = sized.select("doc_id", "length", F.explode("w").alias("token"))
    return worded.groupBy("token", "doc_id", "length").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, totals: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of documents that hold every word of the query. ``totals`` is one row: n, mean."""
    wanted = sorted(set(query.lower().split()))
    hits = index.filter(F.col("token").isin(wanted))
    df = F.broadcast(hits.groupBy("token").agg(F.count("*").alias("df")))  # a row for each word of the query
    scored = hits.join(df, "token").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("found")).filter(F.col("found") == len(wanted)).drop("found")


def bm25_texts(docs: DataFrame, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Like ``bm25``, from the texts: the words of the query are counted in each text, and one row of totals is gathered; no
    postings are built and no text is shuffled."""
    wanted = sorted(set(query.lower().split()))
    count = lambda q: F.size(F.filter("w", lambda x: x == q))
    worded = docs.select("doc_id", F.explode(F.array(tokens(F.col(text)))).alias("w"))
    counted = worded.select("doc_id", F.size("w").alias("length"), *(count(q).alias(f"tf{i}") for i, q in enumerate(wanted))).filter("length > 0")
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    every = reduce(Column.__and__, [F.col(f"tf{i}") > 0 for i in range(len(wanted))])
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm)
    return counted.filter(every).crossJoin(F.broadcast(totals)).select("doc_id", reduce(Column.__add__, [part(i) for i in range(len(wanted))]).alias("score"))


def rebuild_terms(target: DataFrame, docs: DataFrame, dictionary: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """New snapshot of ``target`` (doc_id, term, term_type, confidence, display_eligible, display_reason): the terms of ``ids`` (all
    documents if None; none if empty) extracted anew. Documents of low or excluded ``grade`` hide all their terms."""
    wanted = docs if ids is None else docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    low = F.coalesce("grade", F.lit("medium")).isin("low", "excluded")
    found = extract_terms(wanted, dictionary).join(wanted.select("doc_id", low.alias("_low")), "doc_id")
    new = found.select("doc_id", "term", "term_type", "confidence", F.when(F.col("_low"), 0).otherwise(1).alias("display_eligible"), F.when(F.col("_low"), "low_confidence").otherwise("dictionary").alias("display_reason"))
    return target.join(wanted.select("doc_id"), "doc_id", "left_anti").select(*new.columns).unionByName(new)


def refresh_postings(index: DataFrame, docs: DataFrame, text: str, ids: DataFrame | None = None) -> DataFrame:
    """New snapshot of ``index``: the postings of ``ids`` and of documents that have none are made anew, the others stay."""
    missing = docs.join(index.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")
    changed = missing if ids is None else missing.union(ids.select("doc_id")).distinct()
    new = postings(docs.join(changed, "doc_id", "left_semi"), text)
    return index.join(changed, "doc_id", "left_anti").select(*new.columns).unionByName(new)


def translation_estimate(docs: DataFrame, done: DataFrame, save: Callable[[DataFrame], DataFrame], batch: int = 20, most: int = 12_000) -> DataFrame:
    """One row: unique_inputs, input_chars, oversized, requests, input_tokens, output_tokens of the texts of docs (doc_id, text) still to do.

    Four characters are one token in, three one token out; a request costs 160 and an input 35 tokens more. Requests are filled in the order of the
    first document of each text, exactly as taking one text after the other fills them (``packed_groups``). Empty texts need none.
    """
    first = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first"))
    plan = translation_plan(docs.select("text"), done).filter("state = 'needed'").join(first, "key")
    plan = save(plan.select("first", "key", F.col("chars").cast("long").alias("chars")))
    fits = plan.filter(F.col("chars").between(1, most))
    requests = packed_groups(fits, ["first", "key"], "chars", batch, most, save)
    sums = fits.agg(F.count("*").alias("unique_inputs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("input_chars"))
    large = plan.filter(F.col("chars") > most).agg(F.count("*").alias("oversized"))
    rows = sums.crossJoin(F.broadcast(large)).withColumn("requests", F.lit(requests).cast("long"))
    tokens_in = F.ceil(F.col("input_chars") / 4) + 160 * F.col("requests") + 35 * F.col("unique_inputs")
    return rows.withColumns({"input_tokens": tokens_in, "output_tokens": F.ceil(F.col("input_chars") / 3) + 35 * F.col("unique_inputs")})


def provider_terms(works: DataFrame, existing: DataFrame, synonyms: DataFrame, lists: tuple[list[str], list[str], list[str]], least: float = 0.25) -> DataFrame:
    """doc_id, term, normalized, confidence, display_eligible, display_reason of the concepts (score ``least`` or more) and keywords (score 0.5
    if none is given) of works (doc_id, concepts, keywords: arrays of display_name, score); terms that the document already has stay out."""
    empty = F.array().cast("array<struct<display_name:string,score:double>>")
    concepts = F.filter(F.coalesce("concepts", empty), lambda x: F.coalesce(x["score"], F.lit(0.0)) >= least)
    keywords = F.transform(F.coalesce("keywords", empty), lambda x: F.struct(x["display_name"].alias("display_name"), F.coalesce(x["score"], F.lit(0.5)).alias("score")))
    rows = works.select("doc_id", F.inline(F.concat(concepts, keywords))).filter(F.trim(F.coalesce("display_name", F.lit(""))) != "")
    named = normalize_terms(rows.select("doc_id", F.col("display_name").alias("term"), F.col("score").alias("confidence")), synonyms)
    graded = eligibility(named.select("doc_id", F.col("term").alias("given"), F.col("normalized").alias("term"), "confidence", F.lit("concept").alias("term_type")), *lists)
    once = graded.groupBy("doc_id", F.col("term").alias("normalized")).agg(F.min_by(F.struct("given", "confidence", "display_eligible", "display_reason"), F.struct((-F.col("confidence")).alias("c"), "given")).alias("r"))
    new = once.join(existing.select("doc_id", "normalized"), ["doc_id", "normalized"], "left_anti")
    return new.select("doc_id", F.col("r.given").alias("term"), "normalized", "r.confidence", "r.display_eligible", "r.display_reason")


# Names of parameters that carry credentials; all that start with x-amz- do as well.
SECRETS = (
    "access_token", "api_key", "apikey", "awsaccesskeyid", "auth", "authorization", "code", "credential", "googleaccessid", "jsessionid", "key", "key-pair-id", "password", "policy",
    "relaystate", "samlresponse", "secret", "session", "sessionid", "sig", "signature", "state", "ticket", "token", "x-goog-credential", "x-goog-signature",
)
HIDDEN = "***REDACTED***"


def redacted_url(url: Column) -> Column:
    """URL without user info and fragment, host in lower case, and with the values of secret parameters hidden; other parameters stay. Null gives the empty text."""
    names = "|".join(SECRETS)
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*://)(?:[^/?#@]*@)?([^/?#]*)(.*)$"
    part = lambda n: F.regexp_extract(clean, shape, n)
    whole = F.when(clean.rlike(shape), F.concat(part(1), F.lower(part(2)), part(3))).otherwise(clean)
    return F.regexp_replace(whole, rf"(?i)([?&](?:{names}|x-amz-[^=&]*)=)[^&]*", "$1%2A%2A%2AREDACTED%2A%2A%2A")


def redacted_text(text: Column) -> Column:
    """Free text with its URLs as in ``redacted_url`` and the value behind every secret name and ``=`` or ``:`` hidden."""
    names = "|".join(sorted(SECRETS, key=len, reverse=True))
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(https?://)[^/?#@\s'\"<>]*@", "$1")
    clean = F.regexp_replace(clean, r"(https?://[^\s'\"<>#]*)#[^\s'\"<>]*", "$1")
    clean = F.regexp_replace(clean, r"(?i)([?&]x-amz-[^=&\s]*=)[^&\s'\"<>]*", "$1%2A%2A%2AREDACTED%2A%2A%2A")
    return F.regexp_replace(clean, rf"(?i)((?:{names})\s*[=:]\s*)[^&\s,;]+", "$1" + HIDDEN.replace("*", "*"))


def redact_urls(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, redacted_url(F.col(column)))


def research_only(df: DataFrame, title: str) -> DataFrame:
    """Without errata, comments, replies and the like."""
    return df.filter(~F.lower(F.trim(F.coalesce(title, F.lit("")))).rlike(r"^(erratum|corrigendum|comment on|reply to|publisher.s note|retraction|editorial)"))


def word_positions(words: Column) -> Column:
    """Map of word -> positions of an array of words, made within the row: rows without words have an empty map, and rows of one id stay apart. Null gives null."""
    ordered = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    # sorted rows and the places where a word begins are bound by a name, as they are looked into at each word
    starts = lambda xs: F.filter(F.transform(xs, lambda _, i: i), lambda i: (i == 0) | (F.get(xs, i)["w"] != F.get(xs, i - 1)["w"]))
    places = lambda xs, at, i, k: F.slice(xs, i + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - i).getField("p")
    entries = lambda xs, at: F.transform(at, lambda i, k: F.struct(F.get(xs, i)["w"], places(xs, at, i, k)))
    bound = F.transform(F.array(ordered), lambda xs: F.get(F.transform(F.array(starts(xs)), lambda at: entries(xs, at)), F.lit(0)))
    return F.map_from_entries(F.get(bound, F.lit(0)))


def inverted_index_to_text(index: Column) -> Column:
    """Text from a map of word -> positions; of two words on one place the last of the map wins. Null and empty maps give the empty text."""
    entries = F.map_entries(index)
    places = F.flatten(F.transform(entries, lambda e, o: F.transform(e["value"], lambda p: F.struct(p.alias("p"), o.alias("o"), e["key"].alias("w")))))
    # sorted by place and falling order, the first of a place stands
    ordered = F.sort_array(F.transform(places, lambda x: F.struct(x["p"].alias("p"), (-x["o"]).alias("o"), x["w"].alias("w"))))
    # sorted once and bound by a name; words are picked, not put one behind the other, which would copy the text at each word
    first = lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~F.get(xs, i - 1)["p"].eqNullSafe(x["p"]))
    words = F.get(F.transform(F.array(ordered), lambda xs: first(xs).getField("w")), F.lit(0))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def translation_plan(texts: DataFrame, done: DataFrame) -> DataFrame:
    """key, chars, state (cached or needed): distinct texts by content hash against the finished ones."""
    keyed = texts.select(F.sha2(F.col("text"), 256).alias("key"), F.char_length("text").alias("chars")).groupBy("key").agg(F.max("chars").alias("chars"))
    marked = keyed.join(done.select("key", F.lit(True).alias("d")).distinct(), "key", "left")
    return marked.select("key", "chars", F.when(F.col("d"), "cached").otherwise("needed").alias("state"))
