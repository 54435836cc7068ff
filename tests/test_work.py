"""What queries compute again, and what one task holds."""

import os

import pytest
from pyspark.sql import functions as F

from papertide.operators import entities, library, matching, records
from papertide.plans import entities as texts
from papertide.plans import materials, more, search, series
from papertide.sources import tables

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_follow_the_rows(spark):
    assert tables.dealt(spark.range(10), "id", 1000, 100).rdd.getNumPartitions() == 10


@given
def test_terms_and_versions_are_dealt_by_number(spark):
    assert "RepartitionByExpression [paper_id" in plan(tables.terms(spark, SF)) and "], 4" in plan(tables.terms(spark, SF))
    assert "], 4" in plan(tables.versions(spark, SF))


@given
@pytest.mark.parametrize("name", ["cooc_nodes", "cooling"])
def test_term_queries_are_dealt_by_number(spark, name):
    dealt = [x for x in plan(getattr(series, name)(spark, SF)).splitlines() if "RepartitionByExpression [paper_id" in x]
    assert dealt and all(x.endswith("], 4") for x in dealt)  # parts of the engine's choice grew with the input


@given
def test_many_parts_are_dealt_with_their_items(spark, monkeypatch):
    few = tables.terms(spark, SF)
    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)
    monkeypatch.setattr(tables, "ITEMS_A_JOIN", 500, raising=False)
    many = tables.terms(spark, SF)
    for key in ("l_partkey", "p_partkey"):
        n = next(x for x in plan(many).splitlines() if f"RepartitionByExpression [{key}" in x).rsplit(" ", 1)[1]
        assert int(n) == -(-tables.read(spark, SF, "lineitem").count() // 500)  # as many at any size before
        assert key not in [x.split("[")[1].split("#")[0] for x in plan(few).splitlines() if "RepartitionByExpression [" in x]
    assert "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()  # the sort held a task's share of all items
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


@given
def test_cooling_deals_many_parts_at_each_look(spark, monkeypatch):
    few = series.cooling(spark, SF)
    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)
    many = series.cooling(spark, SF)
    assert plan(many).count("RepartitionByExpression [l_partkey") == plan(many).count("RepartitionByExpression [paper_id") > 0
    assert list(map(tuple, few.collect())) == list(map(tuple, many.collect()))


def test_links_stay_dealt_by_paper(spark):
    terms = spark.createDataFrame([("p", "material", "Si", 0.5), ("p", "topic", "Spin", 0.7), ("q", "material", "none", 0.9)], "paper_id string, term_type string, normalized_term string, confidence double")
    links = library.link_entities(terms, spark.createDataFrame([("m1", "si")], "material_id string, name string"))
    assert "Union" not in plan(links)
    assert {(r["paper_id"], r["kind"], r["name"], r["confidence"]) for r in links.collect()} == {("p", "material", "Si", 0.5), ("p", "topic", "Spin", 0.7)}


def test_names_are_read_once(spark):
    df = spark.createDataFrame([(["A B"],)], "a array<string>").select(matching.clean_authors(F.col("a")))
    assert plan(df).count("regexp_extract_all") <= 4  # each use of a name read it anew


def test_text_is_not_copied_at_each_word(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({},), (None,)], "m map<string,array<int>>").select(entities.inverted_index_to_text(F.col("m")).alias("t"))
    assert "aggregate(" not in plan(df) and [r["t"] for r in df.collect()] == ["a b a", "", ""]


def test_words_do_not_carry_their_document(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    found = entities.postings(docs, "text")
    generate = next(x for x in plan(found).splitlines() if "Generate explode(w" in x)
    assert "[1]" in generate or "[2]" in generate  # the words themselves are dropped as they become rows
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 3, 2), ("b", 1, 3, 1)]


@given
def test_tables_of_several_looks_are_made_once(spark):
    assert "l_orderkey" not in plan(more.priority(spark, SF))
    assert "l_orderkey" not in plan(search.paper_filters(spark, SF))
    assert not any("l_orderkey" in plan(side) for side in series.sides(spark, SF))


@given
def test_texts_are_dealt_in_bounded_batches(spark):
    assert "RepartitionByExpression [doc_id" in plan(texts.texts(spark, SF))
    materials.flat(spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(materials.BATCH_BYTES)


@given
def test_hits_are_dealt_by_paper_only(spark):
    hits = more.hit_rollup(spark, SF)
    shuffles = [x for x in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert shuffles and all("hashpartitioning(paper_id" in x or "hashpartitioning(canonical_paper_id" in x or "partkey" in x for x in shuffles)  # ids of versions were dealt twice more
    assert "l_discount" not in hits._jdf.queryExecution().executedPlan().toString()  # all terms were dealt, not those that a rule asks for


def test_hits_with_their_version_type(spark):
    hits = spark.sql("select * from values ('m', '1', 'v1', 'h1', date'2024-01-02', date'2024-03-01', 2L, 'preprint'), ('m', '1', 'v2', 'h2', date'2024-01-05', date'2024-01-06', 3L, 'published') as t(monitor_id, paper_id, version_id, hit_id, first_matched, last_matched, matches, version_type)")
    assert [(r["matches"], r["hit_id"], r["version_type"]) for r in records.hit_rollup(hits).collect()] == [(5, "h2", "published")]


@given
def test_all_filters_share_one_look_at_each_table(spark):
    looks = [x for x in plan(search.paper_filters(spark, SF)).splitlines() if "Relation [" in x and "version_type#" in x]
    assert len(looks) == 2  # the versions and their authors; each filter read its tables anew
