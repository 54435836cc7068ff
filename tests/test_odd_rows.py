"""Queries against their SQL on odd rows."""

import pytest

from papertide.plans import catalog

TEXTS = [(1, "b a  b\tc"), (2, ""), (3, None), (4, " \n "), (5, "one\x0btwo\x0c\r three"), (6, "twice"), (6, "twice named"), (None, "no id"), (None, "no id at all"), (7, "a\x85b\xa0c  d")]


def test_rows_without_words_and_of_one_id_keep_their_text(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    got = order(catalog.queries()["src_inverted_index"](spark, str(tmp_path)).collect())
    assert got == order(con.sql(catalog.oracle_sql()["src_inverted_index"]).fetchall()) and len(got) == len(TEXTS)
