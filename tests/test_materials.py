"""Formula markup, formulas, mentions and strict classification on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from papertide.operators import entities, materials, strict


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("BaTiO<sub>3</sub> on MgO", "BaTiO3 on MgO"), ("BaTiO$_3$ and BaTiO$_{3}$", "BaTiO3 and BaTiO3"), (r"${\mathrm{BaTiO}}_{3}$", "$BaTiO3$"), ("<mml:msub><mml:mi>BaTiO</mml:mi><mml:mn>3</mml:mn></mml:msub>", "BaTiO3"), ("Co₃O₄", "Co3O4"),
        ("KMgF3_2 and CO2_4", "KMgF3 and CO24"), ("Cd_3As_2", "Cd3As2"), ("Sb 2 Te 3", "Sb2Te3"), ("WTe 2 sheets", "WTe2 sheets"), ("EuIn 2 As 2", "EuIn2As2"), ("x &lt; y &amp; z", "x < y & z"), ("a <b>bold</b> word", "a  bold  word"), (None, ""),
    ],
)
def test_markup(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(materials.flatten_markup(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("formula", "good"),
    [("GaAs", True), ("YBCO", True), ("CoFeB", True), ("H2O", False), ("NATO", False), ("DNAs", False), ("ABCs", False), ("PuO2", False), ("MoS2", True), ("HfO", False), ("Bi2Sr2CaCu2O8", True), ("CO2", False), ("Fe" * 20, False)],
)
def test_formulas(spark, formula, good):
    assert spark.createDataFrame([(formula,)], "t string").select(materials.valid_formula(F.col("t"))).first()[0] is good


def test_mentions_and_evidence(spark):
    docs = spark.createDataFrame([(1, "Gates of BaTiO3", "Barium titanate and GaAs " + "pad " * 60 + "end"), (2, "Kagome metal", None), (3, None, "nothing")], "doc_id long, title string, abstract string")
    registry = spark.createDataFrame([("barium titanate", "BaTiO3", "alias"), ("BaTiO3", "BaTiO3", "alias"), ("kagome metal", "kagome metal", "phrase"), ("BN", "h-BN", "alias")], "alias string, material string, kind string")
    found = materials.extract_materials(docs, registry)
    got = {(r["doc_id"], r["material"]): (r["confidence"], r["detector"]) for r in found.collect()}
    assert got == {(1, "BaTiO3"): (0.98, "registry_alias_title"), (1, "GaAs"): (0.74, "formula_ner_abstract"), (2, "kagome metal"): (0.98, "registry_phrase_title")}
    families = spark.createDataFrame([("GaAs", "III-V")], "material string, family string")
    rows = {r["material"]: r for r in materials.material_evidence(docs, found, families).collect()}
    assert (rows["GaAs"]["family"], rows["GaAs"]["field"], len(rows["GaAs"]["snippet"])) == ("III-V", "abstract", len("Barium titanate and ") + len("GaAs") + 190)
    assert (rows["BaTiO3"]["family"], rows["BaTiO3"]["snippet"], rows["BaTiO3"]["source"]) == ("paper-extracted oxide", "Gates of BaTiO3", "paper_text_registry")


def test_phrases_at_the_end_and_over_marks(spark):
    texts = spark.createDataFrame([(1, "of spin-liquid"), (2, "spin"), (3, "Spin, liquid spin liquid"), (4, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([("spin liquid", 1), ("liquid", 2), ("--", 3)], "phrase string, k int")
    assert sorted((r["doc_id"], r["k"]) for r in entities.phrase_hits(texts, phrases).collect()) == [(1, 1), (1, 2), (3, 1), (3, 2)]


def test_strict_reasons(spark):
    phrases = spark.createDataFrame([("strong", "quantum hall effect"), ("keep", "spin liquid"), ("exclude", "protein"), ("domain", "semiconductor")], "kind string, phrase string")
    rows = [
        ("a", "Quantum Hall effect in protein", "J"), ("b", "A protein", "J"), ("c", "A spin-liquid", "J"), ("d", "A spin liquid", "Wide"), ("e", "A semiconductor", "Wide"), ("f", "plain", "J"), ("g", "plain", "J"), ("h", "plain", "No"), ("i", "spin liquid", "J"), ("j", "spin liquid", "J"),
    ]
    papers = spark.createDataFrame(rows, "paper_id string, title string, journal string").selectExpr("*", "cast(null as string) abstract", "'crossref' source", "'published' source_scope", "if(paper_id = 'j', 'mock', 'real') data_mode", "if(paper_id = 'i', 'low', 'high') confidence")
    terms = spark.createDataFrame([("g", "shown")], "paper_id string, term string")
    got = {r["paper_id"]: (r["eligible"], r["reason"]) for r in strict.classify_strict(papers, terms, phrases, ["J", "Wide"], ["wide"]).collect()}
    assert got == {
        "a": (True, "strict:strong=quantum hall effect:override_excluded=protein"), "b": (False, "excluded:protein"), "c": (True, "strict:hit=spin liquid"), "d": (False, "generalist_requires_text"), "e": (True, "strict:generalist_text=semiconductor"),
        "f": (False, "no_hit"), "g": (True, "strict:display_term"), "h": (False, "not_tracked_journal"), "i": (False, "confidence_low"), "j": (False, "not_real"),
    }
