"""Small cases with known results."""

from pyspark.sql import functions as F

from papertide.operators import corpus, entities, series


def test_statistics_of_a_term_by_hand(spark):
    """Four papers of two journals in one month, one two months later; a term twice in a paper counts once."""
    rows = [("k1", "1999-11", "Low", 3), ("k2", "1999-11", "High", 0), ("k3", "1999-11", "High", 9), ("k4", "1999-11", "Low", 0), ("k5", "2000-01", "High", 1)]
    papers = spark.createDataFrame(rows, "paper_id string, month string, journal string, cited_by_count int").selectExpr("*", "'crossref' source", "'published' source_scope")
    terms = spark.createDataFrame([("k1", "ring"), ("k1", "ring"), ("k2", "ring"), ("k3", "bolt"), ("k5", "ring")], "paper_id string, normalized_term string")
    journals = spark.createDataFrame([("High", "core", 4.0), ("Low", "context", 2.0)], "name string, bucket string, weight double")
    stats = corpus.term_month(papers, terms, journals)
    got = {(r["term"], r["month"], r["corpus_scope"]): (r["raw_freq"], r["weighted_freq"], round(r["raw_share"], 4)) for r in stats.collect()}
    assert got["ring", "1999-11", "all"] == (2, 6.0, 0.5) and got["ring", "1999-11", "core"] == (1, 4.0, 0.5) and got["bolt", "1999-11", "core_context"] == (1, 4.0, 0.25)
    whole = series.densify(stats.filter("corpus_scope = 'all'"), ["term"], ["raw_freq"], "1999-10", "2000-02")
    assert [r["raw_freq"] for r in whole.filter("term = 'ring'").orderBy("month").collect()] == [0, 2, 0, 1, 0]


def test_month_numbers_round_trip(spark):
    months = spark.createDataFrame([("1999-12",), ("2000-01",), ("2000-11",)], "m string")
    assert months.filter(corpus.number_month(corpus.month_number("m")) != F.col("m")).count() == 0


def test_phrases_hold_all_runs(spark):
    row = spark.createDataFrame([(["a", "b", "c"],), ([],)], "w array<string>").select(entities.phrases("w", 2).alias("p")).collect()
    assert [sorted(r["p"]) for r in row] == [["a", "a b", "b", "b c", "c"], []]


def test_formulas(spark):
    docs = spark.createDataFrame([(1, "MoS2 and GaAs, not H2O, NATO or Pu2O3"), (2, None)], "doc_id long, title string")
    assert sorted(r["formula"] for r in entities.formulas(docs, "title").collect()) == ["GaAs", "MoS2"]  # plutonium is no material here


def test_postings_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "One, one two")], "doc_id long, text string")
    assert {(r["token"], r["tf"]) for r in entities.postings(docs, "text").collect()} == {("one", 2), ("two", 1)}
