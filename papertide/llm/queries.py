"""The operators' queries over the given tables and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.toxicity import fit_toxicity, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.simhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papertide.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), drops_white_space=True)


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.hilbert import shard

    return shard(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, first_word, bits, similarity of each benchmark item found in a document."""
    from papertide.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256 (of the ids joined by commas), decoded_sha256, round_trip."""
    import public_tokenizers

    from papertide.llm.unigram import Vocabulary, decode_column, encode_column

    vocab = Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = decode_column(encode_column(docs, vocab), vocab)
    return both.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.pages import fit_pages, main_texts

    pages = table(spark, sf_dir, "pages")
    return main_texts(pages, fit_pages(pages))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.suffix import kept_digest, without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", kept_digest(F.col("kept")).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.variants import marked_words, variant_groups

    return variant_groups(marked_words(table(spark, sf_dir, "documents")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.hyperminhash import near_sets

    return near_sets(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL, "op13_phrase_collocations": OP13_SQL}


OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
), p2 AS (SELECT lang, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 2
), p3 AS (SELECT lang, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3
), f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM p2 GROUP BY ALL HAVING count(*) >= 10
), f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM p3 GROUP BY ALL HAVING count(*) >= 10
), held AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL
), two AS (
  SELECT a.lang, a.x || ' ' || a.y AS phrase, a.f AS a, b.f AS l, c.f AS r,
    CAST(1000000 AS HUGEINT) * a.f * a.f // (CAST(b.f AS HUGEINT) * c.f) AS score
  FROM f2 a JOIN f1 b ON a.lang = b.lang AND a.x = b.x JOIN f1 c ON a.lang = c.lang AND a.y = c.x
  LEFT JOIN held h ON a.lang = h.lang AND a.x = h.x AND a.y = h.y
  WHERE h.f IS NULL OR 100 * h.f < 50 * a.f
), cuts AS (
  SELECT a.lang, a.x || ' ' || a.y || ' ' || a.z AS phrase, a.f AS a, b.f AS l1, yz.f AS r1, xy.f AS l2, c.f AS r2,
    CAST(1000000 AS HUGEINT) * a.f * a.f // (CAST(b.f AS HUGEINT) * yz.f) AS s1,
    CAST(1000000 AS HUGEINT) * a.f * a.f // (CAST(xy.f AS HUGEINT) * c.f) AS s2
  FROM f3 a JOIN f1 b ON a.lang = b.lang AND a.x = b.x JOIN f1 c ON a.lang = c.lang AND a.z = c.x
  JOIN f2 xy ON a.lang = xy.lang AND a.x = xy.x AND a.y = xy.y JOIN f2 yz ON a.lang = yz.lang AND a.y = yz.x AND a.z = yz.y
), every AS (
  SELECT * FROM two
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every
)
SELECT p.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM placed p JOIN totals t ON p.lang = t.lang WHERE rank <= 2000
"""
