import os
import random

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_stage_on_its_own_input(spark):
    import corpus_pipeline
    from papertide.llm.common import table, written
    from tests.llm.test_nearcopies import brute as groups_of
    from tests.llm.test_pieces_and_items import brute as items_in
    from tests.llm.test_suffix import brute as removal

    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in after for i in good) / len(good) > 0.98
            bad = [i for i, q in labels.items() if q == 0]
            assert sum(i in after for i in bad) / len(bad) < 0.2
        elif name == "near_duplicates":
            assert sorted(after) == sorted(set(groups_of([(i, r["text"]) for i, r in before.items()]).values()))
        elif name == "repeated_strings":
            ids = sorted(before)
            want = dict(zip(ids, removal([before[i]["text"] for i in ids], corpus_pipeline.REPEAT_BYTES), strict=True))
            assert {i: r["text"] for i, r in after.items()} == {i: w[0].decode(errors="ignore") for i, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "decontamination":
            dirty = {d for d, _ in items_in([(i, r["text"]) for i, r in before.items()], items, 0.8)}
            assert sorted(after) == sorted(set(before) - dirty)
        else:
            assert all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["piece_ids"]) for r in after.values()) and sorted(after) == sorted(before)
        if name != "subword_pieces":
            assert docs.columns == columns
        before = after


def test_passages_of_over_50_words_go(spark):
    import corpus_pipeline
    from papertide.llm.common import table

    r = random.Random(8)
    texts = [t["text"] for t in table(spark, SF, "documents").filter("lang = 'en'").select("text").collect()]
    pool = [w for t in texts for w in (t or "").split() if w.isalpha()]
    words = lambda n: [r.choice(pool) for _ in range(n)]
    passages = [" ".join(words(51 + k)) for k in range(0, 50, 2)]
    rows, clean = [], []
    for i, passage in enumerate(passages):
        rows += [(1000 * c + i, " ".join([*words(r.randint(5, 300)), passage, *words(r.randint(5, 300))])) for c in range(r.choice([2, 2, 3, 12]))]
        clean.append((90_000 + i, " ".join(words(400))))
    left = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_strings(spark, spark.createDataFrame(rows + clean, "doc_id long, text string"), SF).collect()}
    assert not any(passages[i % 1000] in left[i] for i, _ in rows)
    assert all(left[i] == t for i, t in clean)
    assert all(len(left[i]) > len(t) - len(passages[i % 1000]) - 60 for i, t in rows)


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "repeated_strings", "decontamination", "subword_pieces"])
def test_odd_tables_pass_each_stage(spark, stage):
    """Nulls, empty texts, repeated rows, ties, an empty table and columns named like the stages' own."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, long), (1, long), (2, long + " tail"), (None, "alone"), (None, None), (3, ""), (4, None), (5, "é" * 3000), (5, "other words")]
    names = ("n_bytes", "kept", "ranges", "_left", "row", "n_removed", "n_spans", "_was_null", "id", "key", "fp", "n", "q_words", "item_id", "component_id", "size")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"{i} {n}" for i, n in enumerate(names)), "'en' lang", "'s' source", "0 n_chars")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, SF)
    got = out.collect()
    assert set(docs.columns) <= set(out.columns) and len(got) <= len(rows)
    assert all(r[n] == i for r in got for i, n in enumerate(names))
    assert run(spark, docs.limit(0), SF).count() == 0
    if stage == "near_duplicates":
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "5", "5", "None", "None"]
