"""Readers and exports on small files."""

import json

from papertide.sources.files import export_csv, export_json, file_inventory, read_arxiv_feed, read_manual, read_tasks


def test_manual_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('DOI,Title,Date\n10.1/x,"A, b",2020-01-02\n,"Two\nlines",no date\n')
    got = read_manual(spark, f"file://{tmp_path}/a.csv").collect()
    assert [(r["doi"], r["title"], str(r["pub_date"])) for r in got] == [("10.1/x", "A, b", "2020-01-02"), (None, "Two\nlines", "None")]
    (tmp_path / "b.json").write_text(json.dumps([{"doi": "10.1/y", "paper_title": "T", "journal": 5}]))
    row = read_manual(spark, f"file://{tmp_path}/b.json").first()
    assert (row["doi"], row["title"], row["journal"], row["authors"]) == ("10.1/y", "T", "5", None)


def test_tasks(spark):
    rows = spark.createDataFrame([("T", "a;b,c", "B,x", None), ("", "a", None, None), (None, None, None, None), ("U", None, "", " ")], "title string, concepts string, materials string, methods string")
    good, rejected = read_tasks(rows)
    assert {r["title"]: r["tags"] for r in good.collect()} == {"T": ["a", "b,c", "B", "x"], "U": []}
    assert rejected.count() == 2


def test_arxiv_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2001.00001v2</id><title>A\n title</title><summary> s </summary><published>2020-01-01T00:00:00Z</published>'
        "<updated>2020-02-01T00:00:00Z</updated><author><name>N. One</name></author><author><name>T. Two</name></author><category term='cond-mat'/></entry>"
        "<entry><id>http://arxiv.org/abs/cond-mat/9901001</id><title>B</title></entry></feed>"
    )
    got = {r["arxiv_id"]: r for r in read_arxiv_feed(spark, f"file://{tmp_path}/f.xml").collect()}
    one = got["2001.00001"]
    assert (one["version"], one["title"], one["abstract"], one["authors"], one["categories"]) == (2, "A title", "s", ["N. One", "T. Two"], ["cond-mat"])
    assert got["cond-mat/9901001"]["version"] is None


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "two\nlines", "x")], "id long, title string, note string")
    export_csv(df, f"file://{tmp_path}/csv", ["title", "id"])
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert back.columns == ["title", "id"] and sorted(r["title"] for r in back.collect()) == ['a "q", b', "two\nlines"]
    export_json(df, f"file://{tmp_path}/json")
    assert spark.read.schema(df.schema).json(f"file://{tmp_path}/json").exceptAll(df).count() == 0


def test_inventory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c", b"x"), ("d", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["is_pdf"], r["copies"]) for r in file_inventory(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"a.pdf": (6, True, 2), "b.pdf": (6, True, 2), "c": (1, False, 1)}
