"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is cut at its approximate quantiles into 2^bits cells; the curve index of the
cell orders the rows, and runs of that order become shards, so a shard covers a narrow range in
every dimension and files can be skipped by their minima and maxima.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papertide.llm.common import utf8_size, written


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer cells, shape (rows, dimensions), each below 2^bits."""
    x = np.array(cells, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def string_cuts(rows: DataFrame, column: str, points: list[float]) -> list[str]:
    """The values of a string column at the given shares of its rows, by whole value in byte order.

    Values are counted first; the counted values are sorted in range partitions, of which only the sums are gathered,
    and each partition finds the points that fall into it. At most one value a point reaches the driver.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange("v").select("*", F.spark_partition_id().alias("part")), "values")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ends = placed.join(offsets, "part").withColumn("upto", upto)
    at = F.array(*(F.lit(int(p * total)) for p in points))
    reached = F.filter(at, lambda x: (x > F.col("upto") - F.col("n")) & (x <= F.col("upto")))
    return sorted({r["v"] for r in ends.filter(F.size(reached) > 0).select("v").collect()})


def with_curve(rows: DataFrame, dims: dict[str, Column], bits: int = 4) -> DataFrame:
    """Adds ``curve``: the Hilbert index of the quantised dimensions (nulls fall in the first cell).

    The cut points are quantiles over all rows, at most 2^bits - 1 values a dimension: estimates of numbers, exact for strings.
    """
    names = list(dims)
    valued = rows.withColumns({f"_d{i}": dims[d] for i, d in enumerate(names)})
    points = [k / (1 << bits) for k in range(1, 1 << bits)]
    strings = [i for i in range(len(names)) if isinstance(valued.schema[f"_d{i}"].dataType, StringType)]
    numbers = [i for i in range(len(names)) if i not in strings]
    found = valued.agg(*(F.percentile_approx(F.col(f"_d{i}").cast("double"), points, 1000).alias(f"_d{i}") for i in numbers), F.count("*").alias("n")).first()
    cuts = {i: found[f"_d{i}"] or [] for i in numbers} | {i: string_cuts(valued, f"_d{i}", points) for i in strings}
    cells = []
    for i in range(len(names)):
        steps = [F.when(F.col(f"_d{i}") > c, 1).otherwise(0) for c in sorted(set(cuts[i]))]
        cells.append(reduce(Column.__add__, steps, F.lit(0)))

    @F.pandas_udf("long")
    def curve(*c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([x.to_numpy() for x in c]), bits))

    return valued.withColumn("curve", curve(*cells)).drop(*(f"_d{i}" for i in range(len(names))))


def ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` (0, 1, .. along ``order``) and their number, without one task seeing all rows.

    Range partitions are sorted and written with their number and place; only the partitions'
    sizes are gathered to turn places into ranks.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    placed = written(placed, name)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    offsets = rows.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start"), total


def shard(docs: DataFrame, shards: int = 24, bits: int = 4) -> DataFrame:
    """All rows in ``shards`` runs of the Hilbert order over size, language, source and length in characters.

    Law ``rows``: shard sizes differ by one row at most. Returns doc_id, size, text_crc32, law,
    shard, slot, grown_shard (null), curve. Null texts have size 8 and the checksum of no bytes;
    missing lang, source or n_chars count as null and fall in the first cell; equal texts of one
    source stand together; ties go by checksum and doc_id; an empty table gives no rows.
    """
    has = set(docs.columns)
    size = F.coalesce(utf8_size(F.col("text")), F.lit(0)) + 8
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        *((F.col(c) if c in has else F.lit(None)).cast("string").alias(f"_{c}") for c in ("lang", "source")),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).alias("_chars"),
    )
    dims = {"size": F.col("size"), "lang": F.col("_lang"), "source": F.col("_source"), "chars": F.col("_chars") / F.col("size")}
    curved = with_curve(written(rows, "shard-rows"), dims, bits).drop("_lang", "_source", "_chars")
    placed, total = ranked(curved, ["curve", "text_crc32", "doc_id", "size"], "shard-order")
    number = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", number).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, by: str = "doc_id") -> DataFrame:
    """Writes ``docs`` as one folder a shard, in slot order; returns the manifest (rows, bytes and
    the least and greatest size of each shard). ``by`` must identify rows."""
    rows = docs.join(placed.select(by, "shard", "slot", "size"), by)
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("size").alias("least_size"), F.max("size").alias("greatest_size")
    )
