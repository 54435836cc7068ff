"""Ranks, order statistics and greedy packing over all rows without a task that sees them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a block, and values that are sorted on the driver at the end of a selection.
BLOCK, FEW = 8192, 10_000
#: Cells of one narrowing step.
CELLS = 1024


def numbered(rows: DataFrame, order: list[str], save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """``rows`` with ``place`` (0, 1, .. along ``order``) and their number. Range partitions are written with their number; only their sizes are gathered."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = save(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long"))
    return placed.join(offsets, "_part").withColumn("place", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


def kth_largest(rows: DataFrame, column: str, ks: list[int], few: int = FEW) -> list[float | None]:
    """The k-th largest value (from 1) for each of ``ks``; None where there are fewer. Nulls do not count.

    The interval that holds a value is narrowed by counts of ``CELLS`` cells until ``few`` rows or one value are left: a count over all rows a
    step, no sort of all rows.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    least, most, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    out: list[float | None] = []
    for k in ks:
        if not 1 <= k <= n:
            out.append(None)
            continue
        low, high, above, inside = least, most, 0, n
        while low < high and inside > few:
            width = (high - low) / CELLS
            cell = F.least(F.floor((F.col("v") - low) / width), F.lit(CELLS - 1))
            part = values.filter(F.col("v").between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
            for r in sorted(part.collect(), key=lambda r: -r["c"]):  # at most CELLS rows
                if above + r["n"] >= k:
                    low, high, inside = r["a"], r["b"], r["n"]
                    break
                above += r["n"]
        if low == high:
            out.append(low)
        else:
            out.append(sorted((r["v"] for r in values.filter(F.col("v").between(low, high)).collect()), reverse=True)[k - above - 1])
    return out


def packed_groups(items: DataFrame, order: list[str], size: str, batch: int, most: int, save: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> int:
    """Number of groups that taking the items one after the other along ``order`` fills: a group ends before the item that would make it more than
    ``most`` in ``size`` or more than ``batch`` items.

    Where a group starts decides where all later ones do, so a block of items is a map from the place of the first start inside it (one of
    ``batch`` at most) to that in the next block and to the groups between. Blocks make their maps side by side; neighbouring maps are joined to one,
    twice as long, until one is left.
    """
    block = max(block, 2 * batch)
    placed, total = numbered(items.select(*order, F.col(size).cast("long").alias("_n")), order, save)
    if not total:
        return 0
    own = F.expr(f"place div {block}")
    # the first items of a block are known to the block before as well: its last group may reach into them
    rows = placed.select(own.alias("b"), "place", "_n").unionAll(placed.filter((F.col("place") % block < batch) & (F.col("place") >= block)).select((own - 1).alias("b"), "place", "_n"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: int, n: np.ndarray) -> pa.RecordBatch:
            here = min(block, total - b * block)
            ends = np.cumsum(n)
            before = ends - n
            # first item that does not fit behind a start; one item always fits
            nexts = np.minimum(np.maximum(np.searchsorted(ends, before + most, "right"), np.arange(len(n)) + 1), np.arange(len(n)) + batch)
            leave, groups = np.zeros(here, np.int64), np.zeros(here, np.int64)
            for i in range(here - 1, -1, -1):
                j = int(nexts[i])
                leave[i], groups[i] = (j - here, 1) if j >= here else (leave[j], groups[j] + 1)
            k = min(batch, here)
            # a start behind the end of the last block is none: everything is packed
            entry, leave, groups = np.r_[np.arange(k), np.arange(k, batch)], np.r_[leave[:k], np.arange(k, batch) - k], np.r_[groups[:k], np.zeros(batch - k, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), b)), pa.array(entry), pa.array(leave), pa.array(groups)], ["b", "entry", "leave", "groups"])

        now, kept = None, []
        for part in batches:
            blocks, sizes = part["b"].to_numpy(), part["_n"].to_numpy()
            for first in np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]] if len(blocks) else []).tolist():
                if blocks[first] != now:
                    if kept:
                        yield one(now, np.concatenate(kept))
                    now, kept = int(blocks[first]), []
                kept.append(sizes[first : int(np.searchsorted(blocks, blocks[first], "right"))])
        if kept:
            yield one(now, np.concatenate(kept))

    table = save(rows.repartition("b").sortWithinPartitions("b", "place").mapInArrow(maps, "b long, entry long, leave long, groups long"))
    count = -(-total // block)
    while count > 1:
        left = table.filter("b % 2 = 0").select(F.expr("b div 2").alias("b"), "entry", "leave", "groups")
        right = table.filter("b % 2 = 1").select(F.expr("b div 2").alias("b"), F.col("entry").alias("leave"), F.col("leave").alias("_leave"), F.col("groups").alias("_groups"))
        both = left.join(right, ["b", "leave"], "left")
        table = save(both.select("b", "entry", F.coalesce("_leave", "leave").alias("leave"), (F.col("groups") + F.coalesce("_groups", F.lit(0))).alias("groups")))
        count = -(-count // 2)
    return table.filter("entry = 0").first()["groups"]
