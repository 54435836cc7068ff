"""Near-duplicate groups by SimHash with bit-sliced distance comparison.

Fingerprints are grouped by equal value first, so copies cost one row. Candidates come from
keys of two 16-bit quarters: with at most two differing bits, two of four quarters are equal.
Inside a key the fingerprints stand as vertical bit planes; carry-save counters add the
difference planes of many lanes at once and blocks of lanes are dropped when all exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import map_batches, written
from papertide.llm.components import star_components

#: Fingerprints of one key that are compared in one place; larger keys are refined, then dealt in block pairs.
KEY_ROWS = 2048
#: Words of 64 lanes that are abandoned together.
BLOCK_WORDS = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(spans), 65536):
        h = np.fromiter((digest(line[a:b], 42) for a, b in spans[i : i + 65536]), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    above, equal = over.copy(), ~over
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            equal &= counter[level]
        else:
            above |= equal & counter[level]
            equal &= ~counter[level]
    return above


def within_radius(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Indices i with Hamming distance of left[i] and right[i] at most radius, by bit planes.
    Fingerprints are unsigned longs, or rows of several."""
    n = len(left)
    words = -(-n // (64 * BLOCK_WORDS)) * BLOCK_WORDS
    size = 64 * (left.shape[1] if left.ndim > 1 else 1)
    planes = np.zeros((size, words * 8), np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(left ^ right).view(np.uint8).reshape(n, size // 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    alive = np.arange(words)
    counter = [np.zeros(words, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(words, np.uint64)

    def add(plane: np.ndarray, level: int) -> None:
        nonlocal over
        for c in range(level, len(counter)):
            counter[c], plane = counter[c] ^ plane, counter[c] & plane
        over = over | plane

    for first in range(0, size, 8):
        part = planes[first : first + 8][:, alive]
        for i in (0, 3):
            a, b, c = part[i], part[i + 1], part[i + 2]
            half = a ^ b
            add(half ^ c, 0)
            carry = (a & b) | (half & c)
            if len(counter) > 1:
                add(carry, 1)
            else:
                over = over | carry
        add(part[6], 0)
        add(part[7], 0)
        live = (~_exceeds(counter, over, radius)).reshape(-1, BLOCK_WORDS).any(1)
        if not live.all():
            keep = np.repeat(live, BLOCK_WORDS)
            alive, over, counter = alive[keep], over[keep], [c[keep] for c in counter]
        if not len(alive):
            return np.zeros(0, np.int64)
    left_in = np.unpackbits((~_exceeds(counter, over, radius)).view(np.uint8), bitorder="little").reshape(len(alive), 64)
    row, lane = np.nonzero(left_in)
    found = alive[row] * 64 + lane
    return found[found < n]


def pairs_within(left: np.ndarray, right: np.ndarray, radius: int, words_at_once: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all rows left[i], right[j] of several unsigned longs with Hamming distance at most radius.

    The planes of ``right`` are stored once; each row of ``left`` turns them into its differences, of which 64 lanes
    a word are counted by carry-save counters. Words whose lanes all exceed the radius are abandoned.
    """
    bits, n = 64 * right.shape[1], len(right)
    packed = np.packbits(np.unpackbits(np.ascontiguousarray(right).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T, axis=1, bitorder="little")
    words = -(-n // 64)
    planes = np.zeros((bits, words * 8), np.uint8)
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, words_at_once // words)
    for first in range(0, len(left), step):
        part = np.ascontiguousarray(left[first : first + step])
        masks = np.where(np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").T == 1, ~np.uint64(0), np.uint64(0))
        query, word = np.repeat(np.arange(len(part)), words), np.tile(np.arange(words), len(part))
        counter = [np.zeros(len(query), np.uint64) for _ in range(max(2, radius.bit_length()))]
        over = np.zeros(len(query), np.uint64)
        for at in range(0, bits, 32):
            for b in range(at, at + 32, 2):
                x, y = (planes[k][word] ^ masks[k][query] for k in (b, b + 1))
                half = counter[0] ^ x
                carry = (counter[0] & x) | (half & y)
                counter[0] = half ^ y
                for c in range(1, len(counter)):
                    counter[c], carry = counter[c] ^ carry, counter[c] & carry
                over |= carry
            if at + 32 > radius:
                live = _exceeds(counter, over, radius) != ~np.uint64(0)
                if not live.all():
                    query, word, over, counter = query[live], word[live], over[live], [c[live] for c in counter]
        close = np.unpackbits((~_exceeds(counter, over, radius)).view(np.uint8), bitorder="little").reshape(len(query), 64)
        row, lane = np.nonzero(close)
        j = word[row] * 64 + lane
        found.append((query[row[j < n]] + first, j[j < n]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among rows with equal key (rows sorted by key), as a forest for each call."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    rows = np.arange(len(keys))
    values = fps.view(np.int64)
    out = []
    shift = 1
    while True:
        rows = rows[rows + shift < len(keys)]
        rows = rows[keys[rows] == keys[rows + shift]]
        if not len(rows):
            return out
        for i in range(0, len(rows), 1 << 16):
            part = rows[i : i + (1 << 16)]
            hit = part[within_radius(fps[part], fps[part + shift], radius)]
            for a, b in zip(values[hit].tolist(), values[hit + shift].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((a, b))
        shift += 1


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def flush(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            links = _linked(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) >= 1 << 16 and (cut := int(np.searchsorted(keys, keys[-1]))):
                yield flush(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield flush(keys, fps)

    return run


def _with_key_count(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")


def fingerprint_links(fps: DataFrame, radius: int = 2, key_rows: int = KEY_ROWS) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``(a, b)`` that connect all pairs within ``radius`` <= 2.

    A key with more than ``key_rows`` fingerprints is refined by a third of its other 32 bits
    (one of three thirds is equal within two bits); what is still larger is dealt in block pairs,
    so nothing is capped and no task holds more than two blocks of a key.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the quarters guarantee radii up to 2")
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys, rest = [], []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        p, q = (x for x in range(4) if x not in (i, j))
        keys.append(F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(quarter[i], 16) + quarter[j])
        rest.append(F.shiftleft(quarter[p], 16) + quarter[q])
    pair = F.explode(F.array(*(F.struct(k.alias("key"), r.alias("rest")) for k, r in zip(keys, rest, strict=True))))
    rows = written(_with_key_count(fps.select("fp", pair.alias("x")).select("fp", "x.key", "x.rest")), "fp-keys")
    small = rows.filter(F.col("n") <= key_rows).select("key", "fp")
    thirds = [F.shiftright("rest", 21), F.shiftright("rest", 10).bitwiseAND(0x7FF), F.col("rest").bitwiseAND(0x3FF)]
    finer = F.explode(F.array(*(F.xxhash64("key", F.lit(i), x) for i, x in enumerate(thirds))))
    large = _with_key_count(rows.filter(F.col("n") > key_rows).select("fp", finer.alias("key")))
    blocks = F.ceil(F.col("n") / key_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = large.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"
    )
    return small.union(dealt).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare(radius), "a long, b long")


def near_duplicate_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links).

    Null or wordless texts have fingerprint zero and are linked like any other; a text shorter
    than a shingle is one shingle. Repeated rows return a row each; a null doc_id keeps its row
    and never is a component's id unless all ids of the component are null. Other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle), "fp")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fp-distinct")
    nodes = star_components(fingerprint_links(distinct.select("fp"), radius))
    rooted = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "fp-roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows, with all their columns, that stay when of each group only the least doc_id does.
    Of repeated rows one stays; rows without an id cannot be told apart and all stay."""
    return least_of_groups(docs, near_duplicate_groups(docs.filter("doc_id is not null"), radius, shingle))


def least_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows, with all their columns, that stay when of each group (doc_id, component_id) only the least doc_id does.
    Of rows of the same id and text one stays; rows without an id cannot be told apart and all stay."""
    ids = written(groups.select("doc_id", "component_id"), "groups")
    kept = ids.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    once = docs.join(kept.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    if not kept.filter("times > 1").isEmpty():
        once = once.dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
