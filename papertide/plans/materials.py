"""Queries on materials in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.operators import materials as op
from papertide.operators.entities import ELEMENTS, NO_FORMULAS
from papertide.plans.registry import query
from papertide.sources import tables as t
from papertide.sources.scratch import saved

# Phrases put before titles and abstracts, so that the invented texts hold materials: with markup and, for the SQL, without.
MARKED = (
    "BaTiO<sub>3</sub> films", "Sb 2 Te 3 wires", "WTe 2 on hBN", "KMgF3_2 phase", "Co₃O₄ and twisted bilayer graphene", r"${\mathrm{LaMnO}}_{3}$ gate", "<msub><mi>BaTiO</mi><mn>3</mn></msub> gas",
    "cuprate YBCO rods", "EuIn 2 As 2 flakes", "GaAs wells and ZrO2", "plain words only", "H2O and NATO rinse", "kagome metal RbV3Sb5", "barium titanate bulk",
)
PLAIN = (
    "BaTiO3 films", "Sb2Te3 wires", "WTe2 on hBN", "KMgF3 phase", "Co3O4 and twisted bilayer graphene", "$LaMnO3$ gate", "BaTiO3 gas",
    "cuprate YBCO rods", "EuIn2As2 flakes", "GaAs wells and ZrO2", "plain words only", "H2O and NATO rinse", "kagome metal RbV3Sb5", "barium titanate bulk",
)
REGISTRY = (
    ("twisted bilayer graphene", "twisted bilayer graphene", "phrase"), ("bilayer graphene", "bilayer graphene", "phrase"), ("cuprate", "cuprate", "phrase"), ("kagome metal", "kagome metal", "phrase"),
    ("barium titanate", "BaTiO3", "alias"), ("BaTiO3", "BaTiO3", "alias"), ("BTO", "BaTiO3", "alias"), ("gallium arsenide", "GaAs", "alias"), ("hBN", "hexagonal boron nitride", "alias"),
)
FAMILIES = (("BaTiO3", "perovskite oxide"), ("GaAs", "III-V semiconductor"))
_list = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
_JOINED = "regexp_replace({}, '(^|[^A-Za-z0-9])(([A-Z][a-z]?){{2,}})\\s+([0-9.]+)($|[^A-Za-z0-9])', '\\1\\2\\4\\5', 'g')"
NAMED_SQL = f"WITH {t.DOCS_SQL}, raw_v AS (SELECT doc_id, concat({_list(PLAIN)}[doc_id % 14 + 1], '. ', title) AS title, CASE WHEN doc_id % 28 >= 14 THEN concat({_list(PLAIN)}[(doc_id + 5) % 14 + 1], '. ', abstract) ELSE abstract END AS abstract FROM docs_v), named_v AS (SELECT doc_id, {_JOINED.format('title')} AS title, {_JOINED.format('abstract')} AS abstract FROM raw_v)"
_FOLD = "concat(' ', trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
_REG = "reg(alias, material, kind) AS (VALUES " + ", ".join(str(r) for r in REGISTRY) + ")"
FOUND_SQL = f"""{NAMED_SQL}, {_REG}, f AS (SELECT doc_id, 'title' AS field, title AS text FROM named_v UNION ALL SELECT doc_id, 'abstract', abstract FROM named_v),
w AS (SELECT DISTINCT doc_id, field, rtrim(unnest(regexp_extract_all(text, '[A-Za-z0-9.]+')), '.') AS term FROM f), e AS (SELECT *, regexp_extract_all(term, '[A-Z][a-z]?') AS sym FROM w WHERE regexp_matches(term, '^([A-Z][a-z]?([0-9]+([.][0-9]+)?)?){{2,}}$')),
v AS (SELECT doc_id, field, term FROM e WHERE term IN {op.ALLOWED_FORMULAS + ('',)} OR (length(term) BETWEEN 4 AND 32 AND term NOT IN {NO_FORMULAS} AND len(list_filter(sym, lambda x: NOT list_contains({ELEMENTS}, x))) = 0 AND (regexp_matches(term, '[0-9]') OR (len(sym) <= 3 AND NOT (len(sym) = 3 AND sym[3] = 'Cs' AND sym[1] <> 'Cs'))))),
a AS (SELECT doc_id, field, coalesce(k.material, term) AS material, 0 AS rank FROM v LEFT JOIN (SELECT lower(alias) AS l, min(material) AS material FROM reg WHERE kind = 'alias' GROUP BY 1) k ON k.l = lower(term)
 UNION ALL SELECT doc_id, field, material, CASE WHEN kind = 'phrase' THEN 1 ELSE 2 END FROM f JOIN reg ON (kind = 'phrase' OR length(alias) >= 4) AND contains({_FOLD.format('text')}, {_FOLD.format('alias')})),
r AS (SELECT *, CASE WHEN field = 'title' THEN 0.98 ELSE 0.74 END AS confidence, concat(['formula_ner_', 'registry_phrase_', 'registry_alias_'][rank + 1], field) AS detector FROM a),
found_v AS (SELECT doc_id, material, CAST(max(confidence) AS DOUBLE) AS confidence, arg_max(detector, (confidence, rank)) AS detector FROM r GROUP BY 1, 2)"""
EVIDENCE_SQL = f"""{FOUND_SQL}, fam(material, family) AS (VALUES {", ".join(str(x) for x in FAMILIES)}), x AS (SELECT doc_id, material, detector, coalesce(family, CASE WHEN contains(material, 'O') THEN 'paper-extracted oxide' WHEN contains(material, 'S') OR contains(material, 'Te') THEN 'paper-extracted chalcogenide' WHEN contains(material, 'P') OR contains(material, 'As') OR contains(material, 'Sb') OR contains(material, 'N') THEN 'paper-extracted pnictide' ELSE 'paper-extracted material' END) AS family,
 CASE WHEN ends_with(detector, '_title') OR contains(lower(title), lower(material)) THEN 'title' ELSE 'abstract' END AS field, title, abstract FROM found_v LEFT JOIN fam USING (material) JOIN named_v USING (doc_id)),
y AS (SELECT *, trim(regexp_replace(CASE WHEN field = 'title' THEN title ELSE abstract END, '\\s+', ' ', 'g')) AS text FROM x), z AS (SELECT *, strpos(lower(text), lower(material)) AS pos FROM y),
ev_v AS (SELECT doc_id, material, family, CASE WHEN starts_with(detector, 'formula_ner') THEN 'paper_text_formula' ELSE 'paper_text_registry' END AS source, field, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 110), pos + length(material) + 190 - greatest(1, pos - 110)) ELSE substr(text, 1, 360) END AS snippet FROM z)"""


#: Bytes of a batch of texts that crosses to Python.
BATCH_BYTES = 4 << 20


def named(spark, d):
    seeds = F.array(*map(F.lit, MARKED))
    seed = lambda n: F.element_at(seeds, (n % 14 + 1).cast("int"))
    i = F.col("doc_id")
    abstract = F.when(i % 28 >= 14, F.concat(seed(i + 5), F.lit(". "), "abstract")).otherwise(F.col("abstract"))
    return t.docs(spark, d).select("doc_id", F.concat(seed(i), F.lit(". "), "title").alias("title"), abstract.alias("abstract"))


def flat(spark, d):
    """The flattened texts, made once for formulas, phrases and evidence. Batches that cross to Python are bounded in bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = named(spark, d)
    return saved(op.flattened(t.dealt(docs, "doc_id", docs.count(), 2_500)), "flattened")


def found(spark, docs):
    return op.extract_materials(docs, spark.createDataFrame(REGISTRY, "alias string, material string, kind string"))


@query("flatten_markup", f"{NAMED_SQL} SELECT doc_id, title, sha256(abstract) AS abstract FROM named_v")
def flatten_markup(spark, d):
    return op.flattened(named(spark, d)).select("doc_id", "title", F.sha2("abstract", 256).alias("abstract"))


@query("materials", f"{FOUND_SQL} SELECT * FROM found_v")
def materials(spark, d):
    return found(spark, flat(spark, d))


@query("material_evidence", f"{EVIDENCE_SQL} SELECT * FROM ev_v")
def material_evidence(spark, d):
    docs = flat(spark, d)
    return op.material_evidence(docs, found(spark, docs), spark.createDataFrame(FAMILIES, "material string, family string"))


@query("material_dimension", f"{EVIDENCE_SQL} SELECT material, family, count(*) AS papers, md5(lower(material)) AS material_id FROM ev_v GROUP BY 1, 2")
def material_dimension(spark, d):
    rows = found(spark, flat(spark, d)).groupBy("material").agg(F.count("*").alias("papers"))
    families = spark.createDataFrame(FAMILIES, "material string, family string")
    return rows.join(families, "material", "left").select("material", op.family(F.col("material"), F.col("family")).alias("family"), "papers", F.md5(F.lower("material").cast("binary")).alias("material_id"))
