"""Token counts with a digest cache.

The cache is a Parquet table (digest, version, n_tokens): digest of the normalised text,
version = digest of the tokenizer file and the normalisation. A run joins the texts' digests
to it, encodes each distinct missing text once and appends the counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from papertide.llm.common import scratch_path, split_join, utf8_size, written

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Characters encoded in one call, and chunks between white space whose counts a task remembers.
CALL_CHARS, REMEMBERED = 1 << 20, 400_000
_CHUNK = re.compile("[^ \t\n\r]+")


def token_counter(path: str, drops_white_space: bool = False) -> Callable[[list[str]], list[int]]:
    """Counts as the file's own library gives them: no begin, end or added tokens, special strings
    in texts as its default has them, nothing truncated or padded.

    Where the tokenizer drops white space, nothing it does reaches across a blank or line end, so a
    text's count is the sum over its chunks, and each distinct chunk is encoded once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def counts(texts: list[str]) -> list[int]:
            return [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    elif path.endswith(".model"):
        import sentencepiece

        tok = sentencepiece.SentencePieceProcessor(model_file=path)

        def counts(texts: list[str]) -> list[int]:
            return [len(x) for x in tok.encode(texts, num_threads=1)]
    else:
        raise ValueError(f"no library known for {path}")

    def whole(texts: list[str]) -> list[int]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CALL_CHARS:
                out += counts(held)
                held, size = [], 0
        return out + counts(held)

    known: dict[str, int] = {}

    def by_chunk(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            chunks = _CHUNK.findall(text)
            if len(known) > REMEMBERED:
                known.clear()
            if new := list({c: None for c in chunks if c not in known}):
                for i in range(0, len(new), 65536):
                    known.update(zip(new[i : i + 65536], counts(new[i : i + 65536]), strict=True))
            out.append(sum(map(known.__getitem__, chunks)))
        return out

    return by_chunk if drops_white_space else whole


def tokenizer_version(path: str, strip: bool) -> str:
    with open(path, "rb") as f:
        return f"{hashlib.file_digest(f, 'sha256').hexdigest()[:32]}-{'strip' if strip else 'as-is'}"


def _normalised(text: Column, strip: bool) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.btrim(text, F.lit(" \t\n\r")) if strip else text


#: Digests that a task remembers.
SEEN = 1 << 18


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the later copies of a text within one task, before the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        if len(seen) > SEEN:  # a copy that is met again is counted twice at worst
            seen.clear()
        for i, digest in enumerate(batch["digest"].to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def _encode(path: str, version: str, drops: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path, drops)
        for batch in _once(batches):
            n = pa.array(counter(batch["content"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array([version] * len(n)), n], ["digest", "version", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """digest, n_tokens of one version; None if nothing was ever stored there."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        return None
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, drops_white_space: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    ``cache_path`` keeps counts between runs; without one the cache lives in a new shared folder.
    ``drops_white_space`` states that the tokenizer ignores white space around words, so outer
    white space is normalised away and texts are counted chunk by chunk. Null texts count as
    empty; repeated rows return a row each; ids may be null; other columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokenizer_version(tokenizer_path, drops_white_space)
    content = docs.select("doc_id", F.col("text").cast("string").alias("text"), _normalised(F.col("text"), drops_white_space).alias("content"))
    content = content.withColumn("digest", F.unhex(F.sha2("content", 256)))
    rows = written(content.select("doc_id", F.coalesce(utf8_size(F.col("text")), F.lit(0).cast("long")).alias("n_bytes"), "digest"), "digests")
    known = read_cache(spark, cache_path, version)
    texts = content.select("digest", "content").mapInArrow(_once, "digest binary, content string")
    if known is None:
        misses = texts.repartition("digest")
    else:
        misses = texts.join(known.select("digest").hint("shuffle_hash"), "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer_path, version, drops_white_space), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counted = split_join(rows, read_cache(spark, cache_path, version), ["digest"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
