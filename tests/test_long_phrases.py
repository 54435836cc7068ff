from papertide.operators import entities


def test_phrases_longer_than_four_words_are_found(spark):
    kinds = "phrase string, term string, term_type string, in_title double, in_abstract double"
    dictionary = [("de Haas-van Alphen effect", "de Haas-van Alphen effect", "concept", 1.0, 0.72), ("one two three four five six seven", "seven", "concept", 1.0, 0.72), ("effect", "effect", "concept", 0.9, 0.6)]
    docs = spark.createDataFrame([(1, "The de Haas van Alphen effect", "x"), (2, "plain", "One, two three-four five six seven!"), (3, "de Haas van Alphen", None)], "doc_id long, title string, abstract string")
    found = entities.extract_terms(docs, spark.createDataFrame(dictionary, kinds)).collect()
    assert sorted((r["doc_id"], r["term"], r["confidence"]) for r in found) == [(1, "de Haas-van Alphen effect", 1.0), (1, "effect", 0.9), (2, "seven", 0.72)]
    assert entities.extract_terms(docs, spark.createDataFrame([], kinds)).count() == 0
