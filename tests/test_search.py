"""The fielded index against a loop, its pruning and its updates."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from papertide.operators import search
from papertide.operators.search import SCOPES, PaperFilter, TextIndex, count_papers, search_papers, words_of_query

WORDS = ["spin", "hall", "the", "of", "moire", "bands", "x1"]


def corpus(n, seed):
    r = random.Random(seed)
    text = lambda most: " ".join(r.choice(WORDS) for _ in range(r.randrange(most)))
    return [(i, text(4), text(9), r.choice([None, "", text(30)])) for i in range(n)]


def brute(rows, query, scope):
    words = sorted(set(query.lower().split()))
    split = {i: {f: (t or "").replace("-", " ").split() for f, t in zip(SCOPES["all"], texts, strict=True)} for i, *texts in rows}
    length = {i: sum(map(len, f.values())) for i, f in split.items()}
    full = [n for n in length.values() if n]
    mean = sum(full) / len(full)
    tf = {i: {w: sum(f[x].count(w) for x in SCOPES[scope]) for w in words} for i, f in split.items()}
    df = {w: sum(1 for i in tf if tf[i][w]) for w in words}
    out = {}
    for i, counts in tf.items():
        if all(counts.values()):
            out[i] = sum(math.log(1 + (len(full) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, n in counts.items())
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", 8)
    made.add(spark.createDataFrame(corpus(120, 1), "doc_id long, title string, abstract string, body string"), 0)
    return made


@pytest.mark.parametrize("query", ["spin", "Spin hall", "the of moire", "nowhere", "x1 spin x1"])
@pytest.mark.parametrize("scope", list(SCOPES))
def test_search_equals_a_loop(index, query, scope):
    got = {r["doc_id"]: r["score"] for r in index.search(query, scope).collect()}
    assert got == pytest.approx(brute(corpus(120, 1), query, scope))


def test_a_query_opens_its_buckets_and_fields_only(index):
    found = index.postings(["spin"], "fulltext", 0)
    files = [r["f"] for r in found.select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all("/field=body/" in f for f in files) and len({f.split("/bucket=")[1].split("/")[0] for f in files}) == 1
    # the scan itself is cut to them: both are filters on folders, not on rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = plan[plan.index("PartitionFilters: [") :].split("], Pushed")[0]
    assert "bucket#" in folders and "field#" in folders and "version#" in folders


def test_an_update_writes_its_own_postings(index, spark, tmp_path):
    rows = {i: (i, *rest) for i, *rest in corpus(60, 2)}
    made = TextIndex(spark, f"file://{tmp_path}/index", 8)
    schema = "doc_id long, title string, abstract string, body string"
    made.add(spark.createDataFrame(list(rows.values()), schema), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings/version=0").rglob("*.parquet")}
    new = [(3, "spin", "spin hall", "moire"), (7, "", "", None), (90, "hall", "of spin", "")]
    made.add(spark.createDataFrame(new, schema), 1)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings/version=0").rglob("*.parquet")}
    now = list((rows | {r[0]: r for r in new}).values())
    for scope in SCOPES:
        assert {r["doc_id"]: r["score"] for r in made.search("spin hall", scope, 1).collect()} == pytest.approx(brute(now, "spin hall", scope))
        assert {r["doc_id"]: r["score"] for r in made.search("spin hall", scope, 0).collect()} == pytest.approx(brute(list(rows.values()), "spin hall", scope))


def test_queries_without_words(index):
    assert words_of_query(" -- ") == [] and words_of_query("Spin-Hall (2D)") == ["2d", "hall", "spin"]
    assert index.search(" . ", "all").collect() == []


def test_counts_of_many_filters_are_those_of_each(spark):
    rows = [("v1", "1", "published", "Journal A", 1995, "real", True, True), ("v2", "1", "preprint", "arXiv", 1996, "real", True, False), ("v3", "2", "published", None, 1997, "real", True, None), ("v4", "3", "preprint", "Journal B", None, "mock", True, True), ("v5", "4", "metadata", "Journal B", 1997, "real", None, True), ("v6", "5", "publication", "journal c", 1999, "real", True, True), ("v6", "5", "preprint", "journal c", 1999, "real", True, True)]
    versions = spark.createDataFrame(rows, "version_id string, paper_id string, version_type string, journal string, year int, data_mode string, view_eligible boolean, is_open_access boolean")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    side = {
        "authors": make([("v1", "Ada"), ("v1", None), ("v6", "ADA B"), ("v3", "Bo")], "version_id string, name string"), "topics": make([("1", "Spin"), ("1", "spin ice"), ("5", None)], "paper_id string, name string"),
        "materials": make([("2", "Si")], "paper_id string, name string"), "files": make([("1",), ("1",)], "paper_id string"), "tasks": make([("2", "pending"), ("5", "permanent_failed"), ("5", None)], "paper_id string, status string"),
        "reviews": make([("5", "pending")], "paper_id string, status string"), "states": make([("1", True, "reading"), ("2", None, "unread")], "paper_id string, favorite boolean, reading_status string"), "collections": make([("5", "c1")], "paper_id string, collection_id string"),
    }
    asked = {
        "none": {}, "author": {"author": " ADA"}, "topic": {"topic": "spin"}, "both": {"topic": "SPIN", "author": "a", "version_type": "publication"}, "material": {"material": "si"}, "journal": {"journal": "journal"}, "from": {"year_from": 1996}, "to": {"year_to": 1996}, "there": {"pdf_status": "downloaded"},
        "missing": {"pdf_status": "missing"}, "pending": {"pdf_status": "pending"}, "failed": {"pdf_status": "failed"}, "open": {"open_access": True}, "review": {"review": True}, "favorite": {"favorite": True}, "unread": {"reading_status": "unread"}, "collection": {"collection": "c1"}, "text": {"q": "x"}, "nothing": {"q": "y", "author": "zz"},
    }
    asked = {n: PaperFilter(**w) for n, w in asked.items()}
    hits = make([("v6", 0.5), ("v2", 0.1)], "doc_id string, score double")
    want = set()
    for n, w in asked.items():
        found = search_papers(versions, side, w, hits if w.q else None).collect()
        want.add((n, len(found), len({r["paper_id"] for r in found})))
    found = count_papers(versions, side, asked, {"text": hits.withColumnRenamed("doc_id", "version_id"), "nothing": make([], "version_id string")})
    assert {tuple(r) for r in found.collect()} == want and len({v for _, v, _ in want}) > 3
    by_paper = count_papers(versions, side, {"text": asked["text"]}, {"text": make([("1",)], "paper_id string")})
    assert [tuple(r) for r in by_paper.collect()] == [("text", 2, 1)]


def test_postings_of_a_frequent_word_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "DOCS_A_PART", 10)
    docs = spark.createDataFrame([(i, "spin", f"spin {i}", "") for i in range(60)], "doc_id long, title string, abstract string, body string")
    made = TextIndex(spark, f"file://{tmp_path}/index", 4)
    made.add(docs, 0)
    bucket = zlib.crc32(b"spin") % 4
    assert len(list((tmp_path / f"index/postings/version=0/bucket={bucket}/field=title").glob("*.parquet"))) > 1
    assert sorted(r["doc_id"] for r in made.search("spin").collect()) == list(range(60)) and [r["doc_id"] for r in made.search("spin 7").collect()] == [7]
