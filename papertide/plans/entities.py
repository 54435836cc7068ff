"""Text and entity queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import entities as op
from papertide.operators import fields as fd
from papertide.plans.corpus import rounded
from papertide.plans.registry import query
from papertide.sources import tables as t
from papertide.sources.scratch import saved

# Phrases put before titles and abstracts, so that the invented texts hold entities.
SEEDS = ("MoS2 on BN", "quantum hall effect", "Weyl-semimetal FeSe", "ARPES study", "erratum for GaAs", "comment on spin liquid", "WSe2 and CrI3", "density functional theory", "H2O and NaCl", "topological insulator Bi2Se3", "DNA and NATO", "plain words")
DICTIONARY = (
    ("quantum hall effect", "quantum Hall effect", "concept", 1.0, 0.72), ("weyl semimetal", "Weyl semimetal", "concept", 1.0, 0.72), ("spin liquid", "quantum spin liquid", "concept", 1.0, 0.72),
    ("topological-insulator", "topological insulator", "concept", 1.0, 0.72), ("arpes", "ARPES", "method", 0.9, 0.62), ("density functional theory", "DFT", "method", 0.9, 0.62), ("mos2", "MoS2", "material", 0.92, 0.66), ("gaas", "GaAs", "material", 0.92, 0.66),
)
_SEED_LIST = "[" + ", ".join(f"'{s}'" for s in SEEDS) + "]"
SEEDED_SQL = f"WITH {t.DOCS_SQL}, seeded_v AS (SELECT doc_id, lang, source, concat({_SEED_LIST}[doc_id % 12 + 1], '. ', title) AS title, CASE WHEN doc_id % 24 >= 12 THEN concat({_SEED_LIST}[(doc_id + 5) % 12 + 1], '. ', abstract) ELSE abstract END AS abstract FROM docs_v)"
_FOLD = "concat(' ', trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
_DICT_SQL = "d(phrase, term, term_type, in_title, in_abstract) AS (VALUES " + ", ".join(f"('{p.replace('-', ' ')}', '{n}', '{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, n, k, a, b in DICTIONARY) + ")"


def seeded(spark, d):
    seeds = F.array(*map(F.lit, SEEDS))
    seed = lambda n: F.element_at(seeds, (n % 12 + 1).cast("int"))
    i = F.col("doc_id")
    abstract = F.when(i % 24 >= 12, F.concat(seed(i + 5), F.lit(". "), "abstract")).otherwise(F.col("abstract"))
    return t.docs(spark, d).select("doc_id", "lang", "source", F.concat(seed(i), F.lit(". "), "title").alias("title"), abstract.alias("abstract"))


_EXTRACT = f"""{SEEDED_SQL}, {_DICT_SQL}, f AS (SELECT doc_id, {_FOLD.format('title')} AS ti, {_FOLD.format('abstract')} AS ab FROM seeded_v),
x AS (SELECT doc_id, term, term_type, greatest(CASE WHEN contains(ti, concat(' ', phrase, ' ')) THEN in_title ELSE 0 END, CASE WHEN contains(ab, concat(' ', phrase, ' ')) THEN in_abstract ELSE 0 END) AS confidence FROM f CROSS JOIN d)"""


def extracted(spark, d):
    return op.extract_terms(seeded(spark, d), dictionary(spark))


@query("extract_terms", f"{_EXTRACT} SELECT doc_id, term, term_type, confidence FROM x WHERE confidence > 0")
def extract_terms(spark, d):
    return extracted(spark, d)


@query("normalize_terms", f"WITH {t.TERMS_SQL}, s(k, canonical) AS (VALUES ('red gear', 'gear'), ('blue bolt', 'bolt')) SELECT term_type, coalesce(canonical, normalized_term) AS normalized, count(*) AS papers FROM terms_v LEFT JOIN s ON lower(normalized_term) = k GROUP BY 1, 2")
def normalize_terms(spark, d):
    synonyms = spark.createDataFrame([("Red-Gear", "gear"), ("blue bolt", "bolt")], "alias string, canonical string")
    terms = t.terms(spark, d).groupBy("term_type", F.col("normalized_term").alias("term")).agg(F.count("*").alias("n"))
    return op.normalize_terms(terms, synonyms).groupBy("term_type", "normalized").agg(F.sum("n").alias("papers"))


@query("eligibility", f"""WITH {t.TERMS_SQL}, r AS (SELECT *, lower(replace(trim(normalized_term), '-', ' ')) AS k FROM terms_v) SELECT term_type, CASE WHEN length(trim(normalized_term)) < 3 THEN 'too_short' WHEN k IN ('red', 'gear', 'blue', 'economy') THEN CASE WHEN term_type = 'method' AND k = 'economy' THEN 'method_dictionary' ELSE 'generic_term' END WHEN contains(k, 'green') AND k <> 'green bolt' THEN 'broken_ngram' WHEN k IN ('red gear', 'blue gear') THEN 'generic_ngram'
WHEN term_type = 'material' THEN CASE WHEN regexp_matches(normalized_term, '^([A-Z][a-z]?[0-9]*){{2,}}$') OR k IN ('green bolt') THEN 'material' ELSE 'weak_material_candidate' END WHEN term_type = 'method' THEN CASE WHEN k IN ('standard', 'promo') THEN 'method_dictionary' ELSE 'weak_method_candidate' END
WHEN k IN ('green bolt') THEN 'canonical_phrase' WHEN regexp_matches(normalized_term, '^([A-Z][a-z]?[0-9]*){{2,}}$') THEN 'material_formula' WHEN confidence < 0.7 THEN 'weak_candidate' ELSE 'not_canonical' END AS display_reason, count(*) AS n FROM r GROUP BY 1, 2""")
def eligibility(spark, d):
    terms = t.terms(spark, d).withColumnRenamed("normalized_term", "term")
    return op.eligibility(terms, ["red", "gear", "blue", "economy"], ["green bolt"], ["standard", "promo"], ("green",), ("economy",)).groupBy("term_type", "display_reason").agg(F.count("*").alias("n"))


@query("formulas", f"""{SEEDED_SQL}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(title, '[A-Za-z0-9.]+')) AS f FROM seeded_v), c AS (SELECT doc_id, rtrim(f, '.') AS f FROM w), s AS (SELECT DISTINCT doc_id, f, regexp_extract_all(f, '[A-Z][a-z]?') AS e FROM c WHERE regexp_matches(f, '^([A-Z][a-z]?([0-9]+(\\.[0-9]+)?)?){{2,}}$'))
SELECT doc_id, f AS formula FROM s WHERE length(f) BETWEEN 4 AND 32 AND f NOT IN {op.NO_FORMULAS} AND len(list_filter(e, lambda x: NOT list_contains({op.ELEMENTS}, x))) = 0 AND (regexp_matches(f, '[0-9]') OR len(e) <= 3)""")
def formulas(spark, d):
    return op.formulas(seeded(spark, d), "title")


_FILTER = f"""{SEEDED_SQL}, x AS (SELECT *, lower(replace(regexp_replace(concat_ws(' ', title, source), '\\s+', ' ', 'g'), '-', ' ')) AS k FROM seeded_v), r AS (SELECT *, CASE WHEN starts_with(source, 'src1') THEN 'category' WHEN contains(k, 'quantum hall') THEN 'hard:quantum-Hall' WHEN contains(k, 'spin') THEN 'keyword:spin' WHEN contains(k, 'gaas') THEN 'keyword:GaAs'
 WHEN contains(k, 'erratum') THEN 'exclude:erratum' WHEN contains(k, 'dna') THEN 'exclude:DNA' ELSE 'none' END AS reason FROM x)"""


def filtered(spark, d):
    docs = seeded(spark, d).withColumns({"cats": F.array("source"), "concepts": F.array("lang", F.lit("Weyl-Study"))}).withColumn("journal", F.col("lang"))
    return op.field_filter(docs, ["src1"], ["quantum-Hall"], ["spin", "GaAs"], ["erratum", "DNA"], "cats", ["title"])


@query("field_filter", f"{_FILTER} SELECT reason, reason = 'category' OR starts_with(reason, 'hard:') OR starts_with(reason, 'keyword:') AS in_field, count(*) AS docs FROM r GROUP BY 1, 2")
def field_filter(spark, d):
    return filtered(spark, d).groupBy("reason", "in_field").agg(F.count("*").alias("docs"))


@query("research_only", f"{SEEDED_SQL} SELECT doc_id FROM seeded_v WHERE NOT regexp_matches(lower(trim(title)), '^(erratum|corrigendum|comment on|reply to|publisher.s note|retraction|editorial)')")
def research_only(spark, d):
    return op.research_only(seeded(spark, d), "title").select("doc_id")


_PROMPT = "quantum spin transport of the in and hall insulator"


@query("relevance", f"""{SEEDED_SQL}, o AS (SELECT doc_id, len(list_intersect(list_distinct(list_filter(list_transform(regexp_extract_all(concat_ws(' ', title, abstract, lang), '[A-Za-z][A-Za-z0-9\\-]{{2,}}'), lambda w: lower(w)), lambda w: NOT list_contains({list(op.STOP_WORDS)}, w))), ['quantum', 'spin', 'transport', 'hall', 'insulator', 'spin-liquid'])) AS overlap, abstract FROM seeded_v),
s AS (SELECT doc_id, overlap, least(10.0, round(2 + least(1.2 * overlap, 6.0) + CASE WHEN doc_id % 3 = 0 THEN 0.8 ELSE 0 END + CASE WHEN abstract <> '' THEN 0.8 ELSE 0 END, 1)) AS score FROM o)
SELECT doc_id, CAST(overlap AS INTEGER) AS overlap, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS priority FROM s""")
def relevance(spark, d):
    docs = seeded(spark, d).withColumn("pdf_url", F.when(F.col("doc_id") % 3 == 0, "http://x/y.pdf"))
    return op.relevance(docs, "Quantum spin transport of the in, and Hall insulator with a spin-liquid", ["title", "abstract", "lang"], "abstract", "pdf_url").select("doc_id", "overlap", "score", "priority")


_POSTINGS = f"""WITH p AS (SELECT doc_id, list_filter(string_split({_FOLD.format('text')}, ' '), lambda x: x <> '') AS w FROM documents), post AS (SELECT token, doc_id, length, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS INTEGER) AS length, unnest(w) AS token FROM p) GROUP BY ALL)"""


@query("postings", f"{_POSTINGS} SELECT token, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY 1")
def postings(spark, d):
    return op.postings(t.read(spark, d, "documents"), "text").groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query("bm25", f"""{_POSTINGS}, n AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM post)), h AS (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM post WHERE token IN ('the', 'of'))
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h, n GROUP BY 1 HAVING count(*) = 2""")
def bm25(spark, d):
    return rounded(op.bm25_texts(t.read(spark, d, "documents"), "text", "the of"), "score")


def texts(spark, d):
    """Texts dealt by document in small parts: what one task groups is bounded, and postings of a document need no further shuffle."""
    docs = t.read(spark, d, "documents").select("doc_id", "text")
    return t.dealt(docs, "doc_id", docs.count(), 2_500)


@query("bm25_index", f"""{_POSTINGS}, n AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM post)), h AS (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM post WHERE token IN ('is', 'and'))
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h, n GROUP BY 1 HAVING count(*) = 2""")
def bm25_index(spark, d):
    docs = texts(spark, d)
    totals = docs.select(F.size(op.tokens(F.col("text"))).alias("length")).filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    return rounded(op.bm25(op.postings(docs, "text"), totals, "and is"), "score")


_HID = "%2A%2A%2AREDACTED%2A%2A%2A"


@query("redact_urls", f"SELECT page_id, concat(split_part(url, '#', 1), '?page=2&Token={_HID}&q=a+b&x-amz-date={_HID}') AS url, concat('GET ', split_part(url, '#', 1), '?a=1&token=***REDACTED*** failed; api_key: ***REDACTED***, page=7') AS log FROM pages")
def redact_urls(spark, d):
    pages = t.read(spark, d, "pages")
    signed = F.concat(F.regexp_replace(F.split_part("url", F.lit("#"), F.lit(1)), "://", "://me:pw@"), F.lit("?page=2&Token=abc&q=a+b&x-amz-date=1#part"))
    log = F.concat(F.lit("GET "), F.regexp_replace(F.split_part("url", F.lit("#"), F.lit(1)), "://", "://me:pw@"), F.lit("?a=1&token=abc#top failed; api_key: xyz, page=7"))
    return op.redact_urls(pages.select("page_id", signed.alias("url"), op.redacted_text(log).alias("log")), "url")


@query("file_dedup", "SELECT sha256(html) AS digest, CAST(max(strlen(html)) AS BIGINT) AS size, count(*) AS copies, min(page_id) AS first_page, starts_with(max(html), '%PDF-') AS is_pdf FROM pages GROUP BY 1")
def file_dedup(spark, d):
    data = F.col("html").cast("binary")
    return t.read(spark, d, "pages").groupBy(F.sha2(data, 256).alias("digest")).agg(
        F.max(F.octet_length("html")).cast("long").alias("size"), F.count("*").alias("copies"), F.min("page_id").alias("first_page"), F.startswith(F.max("html"), F.lit("%PDF-")).alias("is_pdf")
    )


@query("src_inverted_index", "SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') AS text FROM documents")
def src_inverted_index(spark, d):
    words = F.filter(F.split(F.regexp_replace("text", r"[ \t\n\f\r]+", " "), " "), lambda x: x != "")
    index = texts(spark, d).select("doc_id", op.word_positions(words).alias("index"))
    return index.select("doc_id", F.when(F.col("index").isNotNull(), op.inverted_index_to_text(F.col("index"))).alias("text"))


@query("translation_plan", "WITH k AS (SELECT sha256(text) AS key, CAST(max(length(text)) AS BIGINT) AS chars, bool_or(doc_id % 3 = 0) AS done FROM documents GROUP BY 1) SELECT CASE WHEN done THEN 'cached' ELSE 'needed' END AS state, count(*) AS texts, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(ceil(chars / 4)) AS BIGINT) AS tokens FROM k GROUP BY 1")
def translation_plan(spark, d):
    docs = t.read(spark, d, "documents")
    done = docs.filter("doc_id % 3 = 0").select(F.sha2(F.col("text"), 256).alias("key"))
    plan = op.translation_plan(docs.select("text"), done)
    return plan.groupBy("state").agg(F.count("*").alias("texts"), F.sum("chars").cast("long").alias("chars"), F.sum(F.ceil(F.col("chars") / 4)).alias("tokens"))


@query("confidence", f"""{_FILTER}, g AS (SELECT *, CASE WHEN starts_with(source, 'src11') THEN 'direct' WHEN starts_with(reason, 'hard:') THEN 'hard' WHEN reason = 'category' OR starts_with(reason, 'keyword:') THEN 'filter' WHEN lang = 'fr' THEN 'concept' WHEN lang = 'es' AND contains(k, 'dna') THEN 'journal' ELSE 'review' END AS why FROM r)
SELECT why AS grade_reason, CASE WHEN why IN ('direct', 'hard') THEN 'high' WHEN why = 'review' THEN 'low' ELSE 'medium' END AS grade, count(*) AS docs FROM g GROUP BY 1, 2""")
def confidence(spark, d):
    return op.grade_field(filtered(spark, d), "src11", "cats", "concepts", ["fr"], ["es"], ["dna"], ["title"]).groupBy("grade_reason", "grade").agg(F.count("*").alias("docs"))


FIELDS = {"spin": ("spin", "hall", "arpes"), "matter": ("weyl", "gaas", "hall"), "theory": ("dft", "density functional", "dna")}
_N_OF = ", ".join("+".join(f"CAST(contains(k, '{w}') AS INTEGER)" for w in words) + f" AS {f}" for f, words in FIELDS.items())


@query("primary_field", f"""{_EXTRACT}, tt AS (SELECT doc_id, string_agg(term, chr(10)) AS terms FROM x WHERE confidence > 0 GROUP BY 1), e AS (SELECT doc_id, source, title, concat_ws(chr(10), concat(title, ' ', abstract), terms) AS whole FROM seeded_v LEFT JOIN tt USING (doc_id)),
b AS (SELECT *, CASE WHEN starts_with(source, 'src1') THEN 'category' WHEN doc_id % 3 = 0 THEN 'topic' ELSE 'text' END AS basis FROM e), k AS (SELECT *, lower(CASE basis WHEN 'topic' THEN title ELSE whole END) AS k FROM b), n AS (SELECT *, {_N_OF} FROM k),
fq AS (SELECT *, greatest(spin, matter, theory) AS most FROM n), g AS (SELECT CASE WHEN source = 'src1' THEN 'alpha' WHEN basis = 'category' THEN 'other' WHEN most = 0 THEN CASE basis WHEN 'topic' THEN 'other' ELSE 'unclassified' END WHEN spin = most THEN 'spin' WHEN matter = most THEN 'matter' ELSE 'theory' END AS field,
 CASE WHEN basis <> 'text' THEN 'direct' WHEN most > 0 THEN 'inferred' ELSE 'unclassified' END AS evidence FROM fq)
SELECT field, count(*) AS papers, count(*) FILTER (evidence = 'direct') AS direct, count(*) FILTER (evidence = 'inferred') AS inferred, count(*) FILTER (evidence = 'unclassified') AS unclassified FROM g GROUP BY 1""")
def primary_field(spark, d):
    subfield = F.struct(F.when(F.col("doc_id") % 3 == 0, "https://x.org/subfields/3104").alias("id"))
    docs = seeded(spark, d).select(F.col("doc_id").alias("paper_id"), F.array("source").alias("categories"), F.struct(F.col("title").alias("display_name"), subfield.alias("subfield")).alias("primary_topic"), "title", "abstract")
    terms = extracted(spark, d).select(F.col("doc_id").alias("paper_id"), "term")
    return fd.field_distribution(fd.primary_field(docs, terms, {"src1": "alpha"}, "src1", "other", "3104", FIELDS))


@query("paper_children", f"WITH {t.TERMS_SQL} SELECT paper_id, array_to_string(list(normalized_term ORDER BY confidence DESC, normalized_term), '|') AS materials FROM terms_v WHERE term_type = 'material' GROUP BY 1")
def paper_children(spark, d):
    rows = t.terms(spark, d).filter("term_type = 'material'").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("normalized_term").alias("m")))).alias("s"))
    return rows.select("paper_id", F.array_join(F.transform("s", lambda x: x["m"]), "|").alias("materials"))


@query("material_search", "SELECT p_partkey AS material_id FROM part WHERE p_name ILIKE '%gear%' OR p_type ILIKE '%gear%' OR p_brand ILIKE '%gear%' OR p_partkey % 7 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 11 = 0 AND p_size > 25")
def material_search(spark, d):
    part = t.read(spark, d, "part")
    materials = part.select(F.col("p_partkey").alias("material_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("material_family"), F.col("p_brand").alias("phase"), F.lit(None).cast("string").alias("thickness"), F.when(F.col("p_partkey") % 7 == 0, "Head-GEAR 2").alias("composition"))
    aliases = part.filter("p_partkey % 11 = 0").select(F.col("p_partkey").alias("material_id"), F.when(F.col("p_size") > 25, "old Gears").otherwise("none").alias("alias"))
    return op.material_search(materials, aliases, "  Gear ")


_GRADED = "CASE WHEN doc_id % 6 = 0 THEN 'low' ELSE 'high' END"


def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "phrase string, term string, term_type string, in_title double, in_abstract double")


@query("rebuild_terms", f"{_EXTRACT} SELECT doc_id, term, term_type, CASE WHEN doc_id % 3 = 0 THEN confidence ELSE confidence / 2 END AS confidence, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN {_GRADED} = 'low' THEN 0 ELSE 1 END ELSE 1 END AS display_eligible, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN {_GRADED} = 'low' THEN 'low_confidence' ELSE 'dictionary' END ELSE 'old' END AS display_reason FROM x WHERE confidence > 0")
def rebuild_terms(spark, d):
    docs = seeded(spark, d).withColumn("grade", F.when(F.col("doc_id") % 6 == 0, "low").otherwise("high"))
    old = extracted(spark, d).withColumns({"confidence": F.col("confidence") / 2, "display_eligible": F.lit(1), "display_reason": F.lit("old")})
    return op.rebuild_terms(old, docs, dictionary(spark), docs.filter("doc_id % 3 = 0").select("doc_id"))


@query("postings_refresh", f"{_POSTINGS} SELECT doc_id, max(length) AS length, count(*) AS tokens, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY 1")
def postings_refresh(spark, d):
    docs = texts(spark, d)
    stale = docs.filter("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 8 == 1, "an older text").otherwise(F.col("text")))
    index = op.refresh_postings(op.postings(stale, "text"), docs, "text", docs.filter("doc_id % 8 = 1").select("doc_id"))
    return index.groupBy("doc_id").agg(F.max("length").alias("length"), F.count("*").alias("tokens"), F.sum("tf").alias("tf"))


@query("translation_estimate", """WITH RECURSIVE k AS (SELECT sha256(text) AS key, max(length(text)) AS chars, bool_or(doc_id % 3 = 0) AS done, min(doc_id) AS first FROM documents GROUP BY 1), f AS (SELECT chars, row_number() OVER (ORDER BY first, key) AS i FROM k WHERE NOT done AND chars BETWEEN 1 AND 12000),
p(i, used, total, groups) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT f.i, CASE WHEN used = 0 OR used = 20 OR total + chars > 12000 THEN 1 ELSE used + 1 END, CASE WHEN used = 0 OR used = 20 OR total + chars > 12000 THEN chars ELSE total + chars END, CASE WHEN used = 0 OR used = 20 OR total + chars > 12000 THEN groups + 1 ELSE groups END FROM p JOIN f ON f.i = p.i + 1),
s AS (SELECT count(*) AS unique_inputs, CAST(coalesce(sum(chars), 0) AS BIGINT) AS input_chars, (SELECT max(groups) FROM p) AS requests FROM f) SELECT *, (SELECT count(*) FROM k WHERE NOT done AND chars > 12000) AS oversized, CAST(ceil(input_chars / 4) + 160 * requests + 35 * unique_inputs AS BIGINT) AS input_tokens, CAST(ceil(input_chars / 3) + 35 * unique_inputs AS BIGINT) AS output_tokens FROM s""")
def translation_estimate(spark, d):
    docs = t.read(spark, d, "documents")
    return op.translation_estimate(docs.select("doc_id", "text"), docs.filter("doc_id % 3 = 0").select(F.sha2(F.col("text"), 256).alias("key")), lambda df: saved(df, "estimate"))


@query("provider_terms", """WITH w AS (SELECT doc_id, unnest([{'n': concat(lang, ' Theory'), 's': doc_id % 10 / 10.0}, {'n': 'Spin-Liquid', 's': doc_id % 4 / 4.0}, {'n': concat('key ', lang), 's': CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.75 END}, {'n': 'Fe2O3', 's': 0.5}]) AS x, unnest(['c', 'c', 'k', 'k']) AS kind FROM documents),
f AS (SELECT doc_id, x.n AS term, CASE WHEN x.n = 'Spin-Liquid' THEN 'quantum spin liquid' ELSE x.n END AS normalized, CAST(x.s AS DOUBLE) AS confidence FROM w WHERE kind = 'k' OR x.s >= 0.25),
g AS (SELECT *, lower(replace(normalized, '-', ' ')) AS k FROM f WHERE NOT (doc_id % 7 = 0 AND normalized = 'Fe2O3')), h AS (SELECT *, CASE WHEN k = 'key en' THEN 'generic_term' WHEN k IN ('quantum spin liquid') THEN 'canonical_phrase' WHEN normalized = 'Fe2O3' THEN 'material_formula' WHEN confidence < 0.7 THEN 'weak_candidate' ELSE 'not_canonical' END AS display_reason FROM g)
SELECT doc_id, term, normalized, confidence, CASE WHEN display_reason IN ('canonical_phrase', 'material_formula') THEN 1 ELSE 0 END AS display_eligible, display_reason FROM h""")
def provider_terms(spark, d):
    i = F.col("doc_id")
    item = lambda name, score: F.struct(name.alias("display_name"), score.cast("double").alias("score"))
    works = t.read(spark, d, "documents").select(
        "doc_id", F.array(item(F.concat("lang", F.lit(" Theory")), i % 10 / 10), item(F.lit("Spin-Liquid"), i % 4 / 4)).alias("concepts"),
        F.array(item(F.concat(F.lit("key "), "lang"), F.when(i % 2 == 1, 0.75)), item(F.lit("Fe2O3"), F.lit(None))).alias("keywords"),
    )
    synonyms = spark.createDataFrame([("spin liquid", "quantum spin liquid")], "alias string, canonical string")
    existing = works.filter("doc_id % 7 = 0").select("doc_id", F.lit("Fe2O3").alias("normalized"))
    return op.provider_terms(works, existing, synonyms, (["key en"], ["quantum spin liquid"], []))
