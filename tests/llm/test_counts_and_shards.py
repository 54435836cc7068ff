import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertide.llm.hilbert import hilbert_index, shard, write_shards
from papertide.llm.tokencount import read_cache, token_counter, token_counts, tokenizer_version
from papertide.llm.topk import exact_topk

P = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello world", "Hello world", " Hello world\n", "", None, "<|endoftext|> a <|startoftext|>", "naïve café " * 10, "a b " * 300_000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, tmp_path, name):
    path = P.path(name)
    drops = name.startswith("word")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 digest", "'x' content", "2 n_tokens")
    cache = f"file://{tmp_path}/cache"
    got = {r["doc_id"]: r for r in token_counts(docs, path, cache, 2048, drops).collect()}
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in TEXTS])]
    assert [got[i]["n_tokens"] for i in range(len(TEXTS))] == want
    assert [got[i]["n_bytes"] for i in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
    assert [got[i]["over_limit"] for i in range(len(TEXTS))] == [n > 2048 for n in want]


def test_cache_is_used_and_grows(spark, tmp_path):
    path, cache = P.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    version = tokenizer_version(path, True)
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    token_counts(docs, path, cache, 2048, True).collect()
    assert read_cache(spark, cache, version).count() == 2
    spark.createDataFrame([(bytes(r["digest"]), version, 77) for r in read_cache(spark, cache, version).collect()], "digest binary, version string, n_tokens long").write.mode("append").parquet(cache)
    more = token_counts(docs.union(spark.createDataFrame([(4, "four")], docs.schema)), path, cache, 2048, True)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in more.collect()) == [(1, 77), (2, 77), (3, 77), (4, token_counter(path)(["four"])[0])]
    assert read_cache(spark, cache, version).count() == 3


def test_hilbert_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = hilbert_index(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_shards_obey_the_row_law(spark, tmp_path):
    rows = [(i, "x" * (i * i % 700) if i % 9 else None, ["en", "de", None][i % 3], f"src{i % 7}") for i in range(1000)] + [(5, "same", "en", "s"), (None, "same", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "0 shard", "1 curve", "2 rank")
    got = shard(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and set(by) == set(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    one = next(r for r in got if r["doc_id"] is None)
    assert (one["size"], one["text_crc32"], one["grown_shard"]) == (12, zlib.crc32(b"same"), None)
    assert shard(docs.limit(0)).count() == 0 and shard(docs.limit(3)).select("shard").distinct().count() == 3
    plain = docs.drop("shard", "curve", "rank").filter("doc_id <> 5")
    placed = shard(plain)
    assert write_shards(plain.drop("size"), placed, f"file://{tmp_path}/out").agg(F.sum("rows")).first()[0] == plain.count()


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault((i, tuple(int(np.floor(256 * float(x))) for x in v)), None)
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        v = min(w for i, w in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return out


def test_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(100, rows[100][1]), (None, rows[1][1]), (2000, None), (2050, [None] * 16), (2100, [float("nan")] * 16), (2150, [0.5] * 3), (2200, []), (2250, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 dim", "2 near", "3 v", "4 score")
    got = exact_topk(vectors, F.col("vec_id") % 50 == 0, 5, block=32)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(rows, 5)
    chunked = exact_topk(vectors, F.col("vec_id") % 50 == 0, 5, query_chunk=4, block=7)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in chunked.collect()) == brute(rows, 5)
    assert exact_topk(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
