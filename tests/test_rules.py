"""Hand-made cases of the rules."""

import pytest
from pyspark.sql import functions as F

from papertide.operators import acquisition, entities, fields, providers, records, series, windows


def test_category_comes_before_hard_terms_keywords_and_exclusions(spark):
    rows = [
        (["cond-mat.str-el"], "Erratum: quantum Hall effect"), (["physics.app-ph"], "a sensor"), (["hep-th"], "Quantum-Hall cells in DNA"), (["hep-th"], "Erratum: spin ice"),
        (None, "DNA origami"), (["math.AG"], "schemes"), ([], None), (["x"], "GAAS and   spin"),
    ]
    df = spark.createDataFrame(rows, "cats array<string>, title string")
    got = [(r["reason"], r["in_field"]) for r in entities.field_filter(df, ["cond-mat.", "physics.app-ph"], ["quantum Hall"], ["spin", "GaAs"], ["DNA", "erratum"], "cats", ["title"]).collect()]
    assert got == [("category", True), ("category", True), ("hard:quantum Hall", True), ("keyword:spin", True), ("exclude:DNA", False), ("none", False), ("none", False), ("keyword:spin", True)]


def test_grades(spark):
    rows = [(["cond-mat.x"], "a", [], ""), (["physics.app-ph"], "a", [], ""), ([], "quantum hall", [], ""), ([], "spin", [], ""), ([], "dna", ["Solid-State Physics"], ""), ([], "lattice of dna", [], "J. Open"), ([], "lattice", [], "Other"), ([], None, None, None)]
    df = spark.createDataFrame(rows, "cats array<string>, title string, concepts array<string>, journal string")
    kept = entities.field_filter(df, ["cond-mat.", "physics.app-ph"], ["quantum hall"], ["spin"], ["dna"], "cats", ["title"])
    grade = lambda strict: [(r["grade"], r["kept"]) for r in entities.grade_field(kept, "cond-mat.", "cats", "concepts", ["solid state"], ["J. Open"], ["lattice"], ["title"], strict).collect()]
    assert grade(False) == [("high", True), ("medium", True), ("high", True), ("medium", True), ("medium", True), ("medium", True), ("low", True), ("low", True)]
    assert grade(True) == [("high", True), ("medium", True), ("high", True), ("medium", True)] + [("excluded", False)] * 4


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://me:pw@Host.Example.ORG:8443/a/b?page=2&api_key=abc&X-Amz-Credential=q&token=#top", "https://host.example.org:8443/a/b?page=2&api_key=%2A%2A%2AREDACTED%2A%2A%2A&X-Amz-Credential=%2A%2A%2AREDACTED%2A%2A%2A&token=%2A%2A%2AREDACTED%2A%2A%2A"),
        ("https://x.org/p?page=3&monkey=7", "https://x.org/p?page=3&monkey=7"), (None, ""), ("  ", ""), ("/local/path?key=5", "/local/path?key=%2A%2A%2AREDACTED%2A%2A%2A"),
    ],
)
def test_only_secrets_are_hidden_in_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(entities.redacted_url(F.col("u"))).first()[0] == want


def test_secrets_in_text(spark):
    text = "GET https://me:pw@x.org/a?page=1&token=abc#f failed, password: hunter2; Authorization=Basic page=7"
    got = spark.createDataFrame([(text,)], "t string").select(entities.redacted_text(F.col("t"))).first()[0]
    assert got == "GET https://x.org/a?page=1&token=***REDACTED*** failed, password: ***REDACTED***; Authorization=***REDACTED*** page=7"


def test_failed_attempts(spark):
    rows = [
        (1, "request_timeout", None, None), (1, "request_timeout", None, 60.0), (2, None, 429, 1e6), (9, None, 503, None), (1, None, 404, None), (1, None, 403, None), (1, "pdf_too_large", None, None), (1, "not_found", None, None),
        (4, "invalid_pdf_structure", 404, None), (5, "invalid_pdf_structure", 404, None), (0, "", 500, None),
    ]
    df = spark.createDataFrame(rows, "attempt_number int, failure_class string, http_status int, retry_after double")
    got = [(r["kind"], r["status"], r["delay"]) for r in acquisition.failure_plan(df).collect()]
    assert got == [
        ("request_timeout", "retryable_failed", 5.0), ("request_timeout", "retryable_failed", 60.0), ("http_rate_limited", "retryable_failed", 86400.0), ("http_server_error", "manual_review", None), ("not_found", "permanent_failed", None),
        ("access_denied", "manual_review", None), ("pdf_too_large", "manual_review", None), ("not_found", "retryable_failed", 5.0), ("invalid_pdf_structure", "retryable_failed", 40.0), ("invalid_pdf_structure", "manual_review", None), ("http_server_error", "retryable_failed", 5.0),
    ]


def test_priorities(spark):
    rows = [("Core", "crossref", ["a", "b"], 10.0, "2024-01-05", "10.1/x", "1500.1", "http://p"), ("Ctx", "arxiv", ["b"], 4.0, "2022-02-01", "", None, ""), ("arXiv", "x", None, 4.0, "2010", None, "7", None), (None, "x", [], None, None, None, None, None)]
    df = spark.createDataFrame(rows, "journal string, source string, terms array<string>, momentum double, pub_date string, doi string, arxiv_id string, pdf_url string")
    got = [(r["priority"], r["reason"]) for r in acquisition.acquisition_priority(df, ["b", "a", "z"], "2024-06-15", ["Core"], ["Ctx"]).collect()]
    assert got == [
        (100, "core journal; matched b, a; top momentum; recent 12 months; has DOI; has arxiv_id; has pdf_url"), (45, "context journal; matched b; nonzero momentum; recent 36 months"), (15, "arXiv only; nonzero momentum; has arxiv_id"), (5, "nonzero momentum"),
    ]
    assert acquisition.acquisition_priority(df.limit(0), [], "2024-06-15", ["Core"], []).count() == 0


def test_relevance(spark):
    rows = [("Spin-Liquid and the spin of it", "", None), ("spin liquid candidates", "x", "http://p"), (None, None, None), ("quantum spin hall edge transport gap", "moire bands", "u")]
    df = spark.createDataFrame(rows, "title string, abstract string, pdf string")
    got = [(r["overlap"], r["score"], r["priority"]) for r in entities.relevance(df, "The spin-liquid, spin and a quantum Hall gap with edge transport in bands", ["title", "abstract"], "abstract", "pdf").collect()]
    assert got == [(2, 4.4, "medium"), (1, 4.8, "medium"), (0, 2.0, "low"), (7, 9.6, "high")]


def test_last_word_of_a_place_stands(spark):
    df = spark.sql("select map('a', array(0, 3), 'b', array(0), 'c', array(1)) as m union all select cast(null as map<string,array<int>>) union all select map('z', array(2, 2))")
    assert [r[0] for r in df.select(entities.inverted_index_to_text(F.col("m"))).collect()] == ["b c a", "", "z"]


def test_dates_of_crossref_records(spark):
    both = '{"DOI":"10.1/X","title":["One","<i>two</i>"],"published":{"date-parts":[[2020,5]]},"issued":{"date-parts":[[2021]]},"container-title":["J","B"],"license":[{"URL":"l"}]}'
    empty = '{"published-print":{"date-parts":[]},"issued":{"date-parts":[[2021]]}}'
    got = providers.parse_crossref(spark.createDataFrame([(both,), (empty,), ("broken",)], "json string")).collect()
    assert (str(got[0]["pub_date"]), got[0]["title"], got[0]["journal"], got[0]["url"], got[0]["is_open_access"]) == ("2020-05-01", "One two", "J B", "https://doi.org/10.1/x", True)
    assert got[1]["pub_date"] is None and got[1]["is_open_access"] is False and got[2]["doi"] is None


def test_pdf_of_openalex_records(spark):
    rows = ['{"id":"W1","primary_location":{"pdf_url":"http://p"},"open_access":{"is_oa":false}}', '{"id":"W2","best_oa_location":{"pdf_url":"http://p"}}', '{"id":"W3","type":"preprint","open_access":{"oa_url":"http://o"},"concepts":[{"display_name":"Spin "}],"primary_topic":{"display_name":"SPIN"}}']
    got = providers.parse_openalex(spark.createDataFrame([(r,) for r in rows], "json string")).collect()
    assert [(r["is_open_access"], r["pdf_url"], r["url"], r["source_scope"], r["concepts"]) for r in got] == [(True, "http://p", "http://p", "published", []), (False, "", "W2", "published", []), (True, "http://o", "http://o", "preprint", ["Spin"])]


def test_version_types(spark):
    rows = [(" Repository ", "10.1/a", None, None, None), ("article", None, "1500.1v2", "arxiv", ""), ("article", None, "1500.1", "openalex", "arXiv preprint"), (None, "10.1/a.", "1500.1", "arxiv", "arXiv"), (None, None, "1500.1", "openalex", "PRB"), (None, " ", None, "Legacy_Intake", None)]
    df = spark.createDataFrame(rows, "version_type string, doi string, arxiv_id string, source string, journal string")
    assert [r["version_type"] for r in records.with_version_type(df).collect()] == ["repository", "preprint", "preprint", "published", "metadata", "imported"]


def test_gaps_are_asked_by_the_right_id(spark):
    rows = [("1", "10.1/a", "1500.1", ["openalex"]), ("2", None, "1500.2", None), ("3", "10.1/c", None, ["crossref", "openalex"]), ("4", None, None, [])]
    df = spark.createDataFrame(rows, "paper_id string, doi string, arxiv_id string, sources array<string>")
    got = sorted((r["paper_id"], r["target"], r["lookup"], r["value"]) for r in windows.coverage_gaps(df).collect())
    assert got == [("1", "arxiv", "arxiv", "1500.1"), ("1", "crossref", "doi", "10.1/a"), ("2", "arxiv", "arxiv", "1500.2")]


def test_identity_keys(spark):
    rows = [("https://doi.org/10.1/ABC.", "arXiv:2001.00001v3", "Moiré <i>Bands</i>", ["Zoë Ångström", "Müller, J."]), ("doi: 10.1/abc", "http://arxiv.org/abs/cond-mat/9901001", "MOIRE bands!", None), (".", None, None, [])]
    df = spark.createDataFrame(rows, "doi string, arxiv_id string, title string, authors array<string>").withColumn("pub_date", F.lit("2020-02-01").cast("date"))
    got = [(r["doi_key"], r["arxiv_key"], r["arxiv_version"], r["title_key"], r["author_keys"]) for r in records.with_identity_keys(df).collect()]
    assert got == [("10.1/abc", "2001.00001", 3, "moire bands", ["zoe angstrom", "muller j"]), ("10.1/abc", "cond-mat/9901001", None, "moire bands", []), (None, None, None, None, [])]


def test_source_quality(spark):
    place = "struct<pdf_url:string,landing_page_url:string,source:struct<id:string,display_name:string,type:string>>"
    at = lambda name=None, kind=None, url=None, pdf=None: (pdf, url, (None, name, kind))
    rows = [
        ("10.1/a", "journal-article", at("Store", "repository"), []), (None, None, at("Store", "repository"), [at("J", "Journal")]), (None, None, at("Store", "repository"), [at("J", "other")]), ("10.77/x", "journal-article", at(None, None, "https://www.deposit.example/1"), None),
        (None, None, at("Good Server ", "repository"), None), (None, None, at("x", "repository", None, "http://me@Export.preprints.example:80/p.pdf"), []), (None, None, None, None), (None, None, at("J", "conference"), []), (None, None, at("J", None, "http://notdeposit.example/"), []),
    ]
    df = spark.createDataFrame(rows, f"doi string, type_crossref string, primary_location {place}, locations array<{place}>")
    got = [(r["decision"], r["eligible"]) for r in providers.source_quality(df, (["good server"], ["preprints.example"]), (["Old Store"], ["deposit.example"]), ["journal", "conference"], ["journal-article"], ["10.77/"]).collect()]
    out, formal, trusted, open_ = "exclude_generic_repository_without_formal_version", "allow_formal_scholarly_venue", "allow_trusted_preprint", "allow_no_explicit_repository_evidence"
    assert got == [(formal, True), (formal, True), (out, False), (out, False), (trusted, True), (trusted, True), (open_, True), (formal, True), (open_, True)]


def test_citations(spark):
    rows = [("1", "On the  Hall effect", ["Ada Byron", " "], "PRB", 2020, "10.1/a", "http://u", "1500.1"), ("2", "On {the} Hall", ["Byron, Ada"], "", 2020, None, None, None), ("3", "a", None, None, None, "", None, ""), ("4", "The Hall", ["B. Byron"], None, 2020, None, None, None)]
    df = spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, journal string, year int, doi string, pdf_url string, arxiv_id string")
    for hot in (100_000, 1):
        keys = {r["paper_id"]: r["citation_key"] for r in records.citation_keys(df, hot).collect()}
        assert keys == {"1": "Byron_2020_the", "2": "Byron_2020_the_2", "3": "unknown_nd_paper", "4": "Byron_2020_The"}
    text = {r["paper_id"]: r["ris"].split("\r\n") for r in records.ris(df).collect()}
    assert text["1"] == ["TY  - JOUR", "TI  - On the Hall effect", "AU  - Ada Byron", "JO  - PRB", "PY  - 2020", "DO  - 10.1/a", "ER  -"] and text["3"] == ["TY  - JOUR", "TI  - a", "ER  -"]
    made = {r["paper_id"]: r["bibtex"] for r in records.bibtex(df.withColumn("citation_key", F.concat(F.lit("k"), "paper_id"))).collect()}
    assert made["2"] == "@misc{k2,\n  title = {On the Hall},\n  author = {Byron, Ada},\n  year = {2020}\n}"
    assert made["1"].startswith("@article{k1,") and made["1"].endswith("  url = {http://u},\n  eprint = {1500.1},\n  archivePrefix = {arXiv}\n}")


def test_growth_ranks_shown_concepts_with_weight(spark):
    rows = [("a", "2024-06", 4.0), ("a", "2024-01", 1.0), ("b", "2024-01", 2.0), ("hidden", "2024-06", 9.0), ("method", "2024-06", 9.0), ("faint", "2024-06", 0.5)]
    stats = spark.createDataFrame(rows, "term string, month string, weighted_freq double")
    shown = spark.createDataFrame([("a", "physics_concept"), ("b", None), ("method", "method"), ("faint", "physics_concept")], "term string, concept_class string")
    table = lambda rising: {r["term"]: (r["recent"], r["previous"], r["change"]) for r in series.growth_table(stats, "2024-06", shown, rising).collect()}
    assert table(True) == {"a": (4.0, 1.0, 2.5)} and table(False) == {"a": (4.0, 1.0, 2.5), "b": (0.0, 2.0, 1 / 3)}


def test_papers_without_a_task(spark):
    tasks = spark.createDataFrame([("1", 1, "failed"), ("1", 2, "completed")], "paper_id string, attempt_number int, status string")
    got = sorted(tuple(r) for r in records.latest_status(spark.createDataFrame([("1",), ("2",)], "paper_id string"), tasks, F.col("attempt_number")).collect())
    assert got == [("1", "completed", 2), ("2", "not_requested", 0)]


def test_scraps_and_plain_methods_among_terms(spark):
    rows = [("transport", "method", 1.0), ("transport", "concept", 1.0), ("physics quantum-matter", "concept", 1.0), ("physics quantum Hall", "concept", 1.0), ("quantum state", "concept", 1.0), ("ARPES", "method", 1.0), ("odd words", "concept", 0.6), ("odd words", "concept", 0.7), ("Fe", "material", 1.0)]
    df = spark.createDataFrame(rows, "term string, term_type string, confidence double")
    got = [(r["display_reason"], r["display_eligible"]) for r in entities.eligibility(df, ["transport", "quantum", "state"], ["physics quantum hall"], ["arpes"], ("physics quantum",), ("transport",)).collect()]
    assert got == [
        ("method_dictionary", 1), ("generic_term", 0), ("broken_ngram", 0), ("canonical_phrase", 1), ("generic_ngram", 0), ("method_dictionary", 1), ("weak_candidate", 0), ("not_canonical", 0), ("too_short", 0),
    ]


def test_topics_alone_do_not_keep_papers_of_generalist_journals(spark):
    topic = "struct<id:string,display_name:string,score:double,subfield:struct<id:string,display_name:string>>"
    at = lambda i, score, sub: (i, None, score, (sub, None))
    ours, away = "https://x.org/subfields/3104/", "https://x.org/subfields/3100"
    rows = [
        ([at("t", 0.36, ours)], at("t", 0.1, ours), "PRB", False), ([at("u", 0.36, ours)], at("t", 0.1, ours), "PRB", False), ([at("u", 0.45, ours)], at("t", 0.9, away), "PRB", None), ([at("u", 0.45, ours)], at("t", 0.9, away), " big  Journal", False),
        ([at("u", 0.45, ours)], None, "Big Journal", True), ([], None, "Big Journal", True), (None, None, None, None), ([at("", 0.44, ours)], at("", 0.1, ours), "PRB", False),
    ]
    df = spark.createDataFrame(rows, f"topics array<{topic}>, primary_topic {topic}, journal string, by_text boolean")
    got = [(r["topic_keep"], r["generalist_only"], r["passes"]) for r in providers.topic_gate(df, "3104", F.col("by_text"), ["Big Journal"]).collect()]
    assert got == [(True, False, True), (False, False, False), (True, False, True), (True, True, False), (True, False, True), (False, False, True), (False, False, False), (False, False, False)]


def test_primary_fields(spark):
    topic = "struct<display_name:string,subfield:struct<id:string>>"
    rows = [
        ("1", ["hep-th", "cond.soft"], None, "superconductor", None), ("2", ["cond.new"], None, None, None), ("3", None, ("Mott and Kondo pairing", ("x/3104",)), "polymer polymer", "colloid"), ("4", [], ("nothing", ("3104/",)), "polymer", ""),
        ("5", [], ("polymer", ("x/1",)), "On SPIN ice", "colloid"), ("6", None, None, None, None), ("7", None, None, "pairing", "polymer"), ("8", None, None, "x", None),
    ]
    papers = spark.createDataFrame(rows, f"paper_id string, categories array<string>, primary_topic {topic}, title string, abstract string")
    terms = spark.createDataFrame([("5", "polymer"), ("5", "spin"), ("3", "polymer"), ("8", "Kondo"), ("9", "Kondo"), ("7", None)], "paper_id string, term string")
    words = {"super": ("superconduct", "pairing"), "strong": ("mott", "kondo", "spin"), "soft": ("polymer", "colloid")}
    found = fields.primary_field(papers, terms, {"cond.soft": "soft"}, "cond.", "other", "3104", words)
    assert {r["paper_id"]: (r["field"], r["evidence"]) for r in found.collect()} == {
        "1": ("soft", "direct"), "2": ("other", "direct"), "3": ("strong", "direct"), "4": ("other", "direct"), "5": ("soft", "inferred"), "6": ("unclassified", "unclassified"), "7": ("super", "inferred"), "8": ("strong", "inferred"),
    }
    assert {r["field"]: tuple(r)[1:] for r in fields.field_distribution(found).collect()} == {"soft": (2, 1, 1, 0), "other": (2, 2, 0, 0), "strong": (2, 1, 1, 0), "super": (1, 0, 1, 0), "unclassified": (1, 0, 0, 1)}
    assert fields.primary_field(papers.limit(0), terms, {}, "cond.", "other", "3104", words).count() == 0


def test_heatmap_of_allowed_classes(spark):
    rows = [("a", "2024-01", 1, 3.0), ("a", "2024-02", 1, 0.0), ("m", "2024-01", 9, 9.0), ("rare", "2024-01", 1, 8.0), ("b", "2024-02", 2, 1.0), ("b", "2023-12", 2, 50.0), ("hidden", "2024-01", 5, 5.0)]
    stats = spark.createDataFrame(rows, "term string, month string, raw_freq long, momentum double")
    shown = spark.createDataFrame([("a", "physics_concept"), ("m", "method"), ("rare", None), ("b", None)], "term string, concept_class string")
    cells = lambda **k: sorted(tuple(r) for r in series.heatmap(stats, "2024-01", "2024-02", "momentum", shown, **k).collect())
    assert cells(without=("method",)) == [("a", "2024-01", 3.0), ("b", "2024-02", 1.0)] and cells(top=1) == [("m", "2024-01", 9.0)] and cells(concept_class="physics_concept") == [("a", "2024-01", 3.0)]
    assert [c[0] for c in cells(min_count=0)] == ["a", "b", "m", "rare"]


def test_comparison_is_smoothed_after_the_z_score(spark):
    df = spark.createDataFrame([("a", "2024-01", 1.0), ("a", "2024-02", 3.0), ("b", "2024-01", 5.0), ("b", "2024-02", 5.0)], "term string, month string, v double")
    values = lambda how: {(r["term"], r["month"]): round(r["value"], 6) for r in series.compare(df, ["term"], "v", how).collect()}
    assert values("raw") == {("a", "2024-01"): -1.0, ("a", "2024-02"): 1.0, ("b", "2024-01"): 0.0, ("b", "2024-02"): 0.0}
    assert values("rolling_3")["a", "2024-02"] == 0.0 and values("ewma")["a", "2024-02"] == -0.3


def test_rankings_hold_concepts_only(spark):
    side = spark.createDataFrame([("a", "2024-01", 0.1, 1.0, 2), ("method", "2024-01", 0.9, 9.0, 9)], "term string, month string, raw_share double, momentum double, raw_freq long")
    assert {r["term"] for r in series.side_rankings(side, side, 5, spark.createDataFrame([("a",)], "term string")).collect()} == {"a"}


def test_hits_of_a_paper_become_one(spark):
    hits = spark.sql("select * from values ('m', '1', 'v1', 'h1', date'2024-01-02', date'2024-03-01', 2L), ('m', '1', 'v2', 'h2', date'2024-01-05', date'2024-01-06', 3L), ('m', '1', 'v3', 'h0', date'2024-01-05', null, 1L), ('n', '1', null, 'h3', null, null, 1L) as t(monitor_id, paper_id, version_id, hit_id, first_matched, last_matched, matches)")
    versions = spark.createDataFrame([("v1", "preprint"), ("v2", "published"), ("v3", "publication")], "version_id string, version_type string")
    got = sorted((r["monitor_id"], str(r["first_matched"]), str(r["last_matched"]), r["matches"], r["hit_id"], r["version_type"]) for r in records.hit_rollup(hits, versions).collect())
    assert got == [("m", "2024-01-02", "2024-03-01", 6, "h2", "published"), ("n", "None", "None", 1, "h3", None)]


def test_a_version_of_two_rows_counts_its_hits_once(spark):
    hits = spark.sql("select * from values ('m', '1', 'v1', 'h1', date'2024-01-02', date'2024-03-01', 2L), ('m', '1', 'v2', 'h2', date'2024-01-05', date'2024-03-02', 3L) as t(monitor_id, paper_id, version_id, hit_id, first_matched, last_matched, matches)")
    versions = spark.createDataFrame([("v1", "preprint"), ("v1", "published"), ("v2", "metadata")], "version_id string, version_type string")
    assert [(r["matches"], r["hit_id"], r["version_type"]) for r in records.hit_rollup(hits, versions).collect()] == [(5, "h1", "published")]


def test_due_and_requeued_tasks(spark):
    rows = [("a", "pending", 1, "2024-01-03", None, None, "x", 0), ("b", "retryable_failed", 5, "2024-01-02", "2024-02-01", "[timeout] t", "x", 2), ("c", "retryable_failed", 5, "2024-01-01", "2024-03-01", None, None, 3), ("d", "manual_review", 9, "2024-01-01", None, "[denied] no", "y", 4), ("e", "completed", 9, "2024-01-01", None, None, "y", 1), ("f", "retryable_failed", 5, "2024-01-01", None, "", "y", 1)]
    tasks = spark.createDataFrame(rows, "task_id string, status string, priority int, created_at string, next_attempt_at string, last_error string, source string, attempt_count int").withColumn("updated_at", F.col("created_at"))
    assert [r["task_id"] for r in records.due_tasks(tasks, F.lit("2024-02-01"), 9).collect()] == ["f", "b", "a"]
    attempts = spark.createDataFrame([("c", 1, 1, "denied"), ("c", 2, 1, "denied"), ("c", 2, 2, "timeout"), ("e", 1, 1, "timeout"), ("f", 1, 1, "timeout"), ("f", 2, 1, "denied")], "task_id string, attempt_number int, candidate_index int, failure_class string")
    again = lambda **k: sorted(r["task_id"] for r in records.requeue(tasks, attempts, **k).collect() if r["status"] == "pending" and r["task_id"] != "a")
    assert again(failure_classes=("timeout",)) == ["b", "c"] and again(failure_classes=("denied",)) == ["d", "f"] and again(sources=("y",)) == ["d", "f"] and again() == ["b", "c", "d", "f"]
    ids = spark.createDataFrame([("d",), ("e",), ("b",)], "task_id string")
    assert again(ids=ids) == ["b", "d"] and again(ids=ids, limit=1) == ["d"] and again(ids=ids.limit(0)) == [] and again(limit=1) == ["c"]
    row = records.requeue(tasks, attempts, ids=ids).filter("task_id = 'd'").first()
    assert (row["attempt_count"], row["last_error"], row["source"], row["priority"]) == (0, None, None, 9)


def test_materials_by_attributes_and_aliases(spark):
    materials = spark.createDataFrame([(1, "MoS2", None, "2H", None, None), (2, "x", "TMD family", None, None, "moS"), (3, "y", None, None, "bulk", None)], "material_id int, canonical_name string, material_family string, phase string, thickness string, composition string")
    aliases = spark.createDataFrame([(3, "Molybdenum"), (1, "Molybdenite"), (4, None)], "material_id int, alias string")
    ids = lambda word: sorted(r[0] for r in entities.material_search(materials, aliases, word).collect())
    assert ids(" MOS ") == [1, 2] and ids("molyb") == [1, 3] and ids("bulk") == [3] and ids("") == [1, 2, 3] and ids("zz") == []
