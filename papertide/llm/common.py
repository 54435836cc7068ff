"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch: a task holds a batch in Spark and in Python, whatever the texts' lengths.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Rows of one key that stay in one task, and keys at most that are split.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def split_join(big: DataFrame, small: DataFrame, on: list[str], sizes: DataFrame | None = None, how: str = "inner", hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """``big`` joined to ``small``, whose keys may be frequent in ``big``: a key of more than ``hot_rows`` rows
    is split by a hash of the row into pieces, and its rows of ``small`` go to each piece.

    ``sizes`` holds the keys and their number of rows in ``big`` as ``n`` (counted here if not given), ``total`` a bound of their sum. At most ``HOT_KEYS``
    keys are split, so what is broadcast is bounded: with N rows, the bound of a piece becomes N / ``HOT_KEYS`` if that is more.
    """
    total = big.count() if total is None else total
    if total <= hot_rows:
        return big.join(small, on, how)
    sizes = big.groupBy(*on).agg(F.count("*").alias("n")) if sizes is None else sizes
    bound = max(hot_rows, total // HOT_KEYS)
    hot = sizes.filter(F.col("n") > bound)
    if hot.isEmpty():
        return big.join(small, on, how)
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("n") / bound).cast("int").alias("_pieces")))
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = big.join(hot, on, "left").withColumn("_piece", F.pmod(F.xxhash64(*big.columns), pieces).cast("int")).drop("_pieces")
    each = small.join(hot, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return dealt.join(each, [*on, "_piece"], how).drop("_piece")


def ragged_arange(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .., concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
