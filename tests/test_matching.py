"""Identity rules on hand-made records."""

import pytest
from pyspark.sql import functions as F

from papertide.operators import library, matching

COLUMNS = "id long, doi_key string, arxiv_key string, title_key string, authors array<string>, year int, reference string"


def records(spark, *rows):
    return spark.createDataFrame([(i, *rest) for i, *rest in rows], COLUMNS)


def test_external_ids_go_by_priority(spark):
    ids = spark.createDataFrame([("doi", "10.1/a", 7), ("doi", "10.1/a", 9), ("arxiv", "2001.1", 8), ("openalex", "w1", 3)], "namespace string, external_id string, paper_id long")
    rows = spark.createDataFrame([(1, "10.1/a", "2001.1", None), (2, None, "2001.1", "w1"), (3, "10.1/zz", None, "w1"), (4, None, None, None)], "id long, doi_key string, arxiv_key string, openalex_key string")
    got = {r["id"]: (r["paper_id"], r["rule"], r["confidence"]) for r in matching.resolve_exact(rows, ids).collect()}
    assert got == {1: (7, "doi_exact", 1.0), 2: (8, "arxiv_exact", 0.99), 3: (3, "openalex_exact", 0.995), 4: (None, "new_library_record", 0.0)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("arXiv:2001.00001v3", "2001.00001"), ("https://arxiv.org/pdf/cond-mat/9901001v2.pdf", "cond-mat/9901001"), ("http://export.arxiv.org/abs/2002.1?x=1", "2002.1"), (" ", None), (None, None)],
)
def test_arxiv_ids(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(matching.arxiv_base(F.col("x"))).first()[0] == want


def decide(spark, left, right):
    pairs = records(spark, (1, *left)).select(*(F.col(c).alias(f"i_{c}") for c in ("id", "doi_key", "arxiv_key", "title_key", "authors", "year", "reference")))
    pairs = pairs.crossJoin(records(spark, (2, *right)).select(*(F.col(c).alias(f"c_{c}") for c in ("id", "doi_key", "arxiv_key", "title_key", "authors", "year", "reference"))))
    r = matching.score_pairs(pairs).first()
    return r["rule"], r["auto_merge"], round(r["confidence"], 4)


def test_pair_rules(spark):
    title = "transport in twisted layers of graphene"
    who, other = ["Ann Lee", "Bo Chen"], ["Ann Lee", "Cy Dow"]
    base = ("10.1/a", None, title, who, 2020, None)
    assert decide(spark, base, ("10.1/a", None, "something else", None, 1990, None)) == ("doi_exact", True, 1.0)
    assert decide(spark, (None, "2001.1", title, who, 2020, None), ("10.1/b", "2001.1", "other", None, None, None)) == ("arxiv_exact", True, 0.99)
    assert decide(spark, (None, "2001.1", "x", None, None, "PRB 5, doi:10.1/B"), ("10.1/b", None, "y", None, None, None)) == ("arxiv_journal_reference_doi", True, 0.98)
    assert decide(spark, base, ("10.1/z", None, title, who, 2020, None)) == ("title_external_id_conflict", False, 1.0)
    assert decide(spark, base, (None, None, title, other, 2020, None)) == ("title_author_year", True, 0.95)
    assert decide(spark, base, (None, None, title, who, 2020, None)) == ("title_author_year", True, 0.97)
    assert decide(spark, base, (None, None, title, who, 2021, None)) == ("title_similarity_review", False, 1.0)
    rule, auto, ratio = decide(spark, base, (None, None, title + "s", who, 2020, None))
    assert rule == "title_similarity_review" and not auto and 0.94 < ratio < 1
    assert decide(spark, base, (None, None, "a wholly different name", who, 2020, None))[0] == "none"
    assert decide(spark, ("10.1/a", None, None, None, None, None), (None, None, None, None, None, None))[0] == "none"


def test_fuzzy_candidates_are_found(spark):
    known = records(spark, (1, None, None, "transport in twisted layers of graphene", ["A B"], 2020, None))
    asked = records(spark, (5, None, None, "transport in twisted layer of graphene", ["A B"], 2020, None), (6, None, None, "short", None, None, None))
    pairs = matching.candidate_pairs(asked, known, fuzzy=True)
    assert [(r["left_id"], r["right_id"], r["rule"]) for r in matching.score_pairs(pairs).collect()] == [(5, 1, "title_similarity_review")]
    assert matching.candidate_pairs(asked, known).count() == 0


def test_titles_with_two_ids_do_not_link(spark):
    rows = records(
        spark, (1, "10.1/a", None, "t", None, None, None), (2, "10.1/b", None, "t", None, None, None), (3, None, None, "t", None, None, None), (4, "10.1/b", "7", "u", None, None, None), (5, None, "7", None, None, None, None), (6, None, None, "u", None, None, None)
    )
    links, conflicts = matching.identity_links(rows)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(4, 2), (5, 4), (6, 4)}
    assert [(r["title_key"], r["records"]) for r in conflicts.collect()] == [("t", 3)]


def test_authors(spark):
    df = spark.createDataFrame([(["Ada  Byron", "Byron, Ada", "A. Byron", None, "  ", "12", "Ada Byron"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(matching.clean_authors(F.col("a"))).collect()] == [["Ada Byron", "Byron, Ada"], [], None]


def test_publications_by_reference_then_title(spark):
    rows = [
        (1, None, "2001.1", "x", "preprint", "PRB 1 (2020), https://doi.org/10.1/p."), (2, "10.1/p", None, "y", "metadata", None), (3, "10.1/p", None, "y", "published", None), (4, None, "2001.2", "z", "preprint", None), (5, "10.1/q", None, "z", "published", None),
        (6, "10.1/r", None, "z", "published", None), (7, "10.1/s", None, "z", "published", None), (8, None, "2001.3", None, "preprint", "no doi"),
    ]
    df = spark.createDataFrame(rows, "id long, doi_key string, arxiv_key string, title_key string, version_type string, reference string").withColumn("raw_doi", F.lit(None).cast("string"))
    links, reviews = matching.link_publications(df)
    assert [(r["id"], r["target_id"]) for r in links.collect()] == [(1, 3)]
    assert sorted((r["id"], r["candidate_id"]) for r in reviews.collect()) == [(4, 5), (4, 6)]


def test_receipts(spark):
    files = spark.createDataFrame([(p, "h") for p in "abcde"] + [("f", None)], "path string, sha256 string")
    receipts = spark.createDataFrame(
        [("b", "{oops"), ("c", '{"schema_version": 2}'), ("d", '{"schema_version": 1, "source_sha256": "old"}'), ("e", '{"schema_version": 1, "source_sha256": "h", "imported_at": "now"}'), ("f", '{"schema_version": 1}')], "path string, json string"
    )
    got = {r["path"]: (r["state"], r["imported_at"]) for r in library.receipt_state(files, receipts).collect()}
    assert got == {
        "a": ("receipt_missing", None), "b": ("receipt_invalid", None), "c": ("receipt_schema_mismatch", None), "d": ("source_changed", None), "e": ("imported", "now"), "f": ("source_unreadable", None)
    }


def test_long_titles_without_one_character_are_candidates(spark):
    title = "band structure of layered quantum materials and the like " * 12
    row = lambda i, t: (i, None, None, t, ["A B"], 2001, None)
    schema = "id long, doi_key string, arxiv_key string, title_key string, authors array<string>, year int, reference string"
    asked, known = spark.createDataFrame([row(1, title[:200] + title[201:])], schema), spark.createDataFrame([row(2, title), row(4, title)], schema)
    got = [tuple(r) for r in matching.score_pairs(matching.candidate_pairs(asked, known, fuzzy=True)).select("left_id", "right_id", "rule", "confidence").collect()]
    n = len(title)
    assert got == [(1, 2, "title_similarity_review", 2 * (n - 1) / (2 * n - 1))]


def test_fuzzy_candidates_of_long_titles_differ_in_several_places(spark):
    """Titles of more than 300 characters met those with one character more or less only; a run put in counts whole, as the titles' ratio says."""
    title = " ".join(f"layer {i} of the sample {i * 37 % 101}" for i in range(24))
    plain = "aab bba " * 60  # only frequent characters
    row = lambda i, t: (i, None, None, t, ["A B"], 2001, None)
    schema = "id long, doi_key string, arxiv_key string, title_key string, authors array<string>, year int, reference string"
    asked = spark.createDataFrame([row(1, title[:200] + "z" + title[201:400] + "q" + title[401:]), row(3, plain[:100] + "ab" * 10 + plain[100:])], schema)
    pairs = matching.candidate_pairs(asked, spark.createDataFrame([row(2, title), row(4, plain)], schema), fuzzy=True)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "half" not in plan  # halves of titles were shuffled too
    assert sorted((r["left_id"], r["right_id"], r["rule"]) for r in matching.score_pairs(pairs).collect()) == [(1, 2, "title_similarity_review"), (3, 4, "title_similarity_review")]
