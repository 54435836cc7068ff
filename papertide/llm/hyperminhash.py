"""Near copies by HyperMinHash: texts whose sets of two-word shingles have similarity (Jaccard) 0.8 or more.

Each shingle falls into buckets; a bucket keeps of its least hash the number of leading zeros and the ten bits that follow, two bytes
in all. Small sets enter a shingle into several buckets, by powers of two, so that each bucket sees some eight shingles; a set whose
partners may use another power has both signatures. Bands of registers are keys: at similarity 0.8 no band of a pair is equal
in less than one case of 10^7. Pairs on a key are first judged by their registers, less the share that equal by chance, at six standard deviations
below the bound; what passes is decided on the full sets.

Sets that are equal are one node. A first round compares each node of a key with the one that shares most keys with others, as an
original does among its edited copies; the second compares what is then left in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import HOT_ROWS, split_join, written
from papertide.llm.components import star_components
from papertide.llm.nearcopies import BUCKETS, KEY_ROWS, _map_slices, shingle_set, sketch, words_of

SHINGLE, SIMILARITY = 2, 0.8
#: Buckets, bits after the leading one, and the register of an empty bucket.
REGISTERS, MANTISSA, EMPTY = 512, 10, 0xFFFF
#: Shingles a bucket sees at least, on average, where copies of shingles can bring that about.
FILL = 8
#: Chance that no band of a pair at the bound is equal, at most; standard deviations by which an estimate may fall short of it.
MISS, DEVIATIONS = 1e-7, 6.0
#: Rows whose pairs are judged side by side.
AT_ONCE = 1 << 14

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def band_rows(least: float) -> int:
    """Registers a band: as many as keep the chance of a lost pair at the bound below ``MISS``."""
    fit = [r for r in range(1, 65) if (1 - least**r) ** (REGISTERS // r) <= MISS]
    if not fit:
        raise ValueError("so low a similarity needs more registers")
    return fit[-1]


def copies(n: int) -> int:
    """Buckets that each shingle of a set of n falls into."""
    return min(REGISTERS, 1 << (-(-REGISTERS * FILL // n) - 1).bit_length()) if n else 0


def classes(n: int, least: float) -> list[int]:
    """The numbers of copies by which sets of similarity ``least`` and size n or more may meet this one, greatest first."""
    if not n:
        return []
    last, found = copies(int(n / least + 1e-9)), [copies(n)]
    while found[-1] > last:
        found.append(found[-1] // 2)
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def registers(shingles: np.ndarray, times: int) -> np.ndarray:
    """The compressed registers: ``times`` groups of buckets, each of which holds all shingles."""
    each = REGISTERS // times
    best = np.full(REGISTERS, 1 << 53, np.int64)
    for first in range(0, len(shingles), 1 << 16):
        part = shingles[first : first + (1 << 16)]
        h = _mixed(part[:, None] + (np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None])
        bucket = (h & np.uint64(each - 1)).astype(np.int64) + np.arange(0, REGISTERS, each)[None]
        np.minimum.at(best, bucket.ravel(), (h >> np.uint64(11)).astype(np.int64).ravel())
    share, size = np.frexp(best.astype(np.float64))
    mantissa = np.maximum((share * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return np.where(best == 1 << 53, EMPTY, (53 - size) << MANTISSA | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int, times: int) -> np.ndarray:
    """A key a band of registers."""
    bands = REGISTERS // rows
    part = regs[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64) << np.uint64(16) | np.uint64(times)
    for k in range(rows):
        h = _mixed(h + part[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return h


def parities(regs: np.ndarray) -> np.ndarray:
    """One bit of a hash of each register."""
    bits = _mixed(regs.astype(np.uint64) + np.arange(REGISTERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def chance_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that the registers of buckets with a and b different shingles (on average) are equal: least hashes of density
    a e^(-a x) and b e^(-b x) in one cell, whose width at x in [2^-i, 2^(1-i)) is 2^-(i + ``MANTISSA``)."""
    both = a + b
    total = np.zeros(len(both))
    for i in range(1, 54):
        total += 2.0**-i * (np.exp(-both * 2.0**-i) - np.exp(-both * 2.0 ** (1 - i)))
    return np.minimum(2.0**-MANTISSA * a * b * total / both, 0.5)


def estimates(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, others: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, used registers) of pairs: the share of equal registers, corrected for those equal by chance."""
    used = (left != EMPTY) | (right != EMPTY)
    n = np.maximum(used.sum(1), 1)
    share = ((left == right) & used).sum(1) / n
    chance = chance_equal(sizes * times / REGISTERS, others * times / REGISTERS)
    return (share - chance) / (1 - chance), n


def _signed(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, hi and lo (key of the set), n (shingles), parity (each shingle flips one of 512 bits), times (copies), and bands, regs and bits of
    one signature after the other."""
    rows = band_rows(least)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, odd, times, bands, regs, bits = [], [], [], [], [], [], []
        for text in batch["text"]:
            shingles = shingle_set(words_of(text.as_py()), SHINGLE)
            own = classes(len(shingles), least)
            signed = [registers(shingles, t) for t in own]
            keys.append(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64))
            sizes.append(len(shingles))
            odd.append(sketch(shingles).tobytes())
            times.append(own)
            bands.append(np.concatenate([band_keys(r, rows, t) for r, t in zip(signed, own, strict=True)] or [np.zeros(0, np.uint64)]).view(np.int64))
            regs.append(b"".join(r.tobytes() for r in signed))
            bits.append(b"".join(parities(r).tobytes() for r in signed))
        hi, lo = np.stack(keys).T
        columns = [batch["doc_id"], pa.array(np.ascontiguousarray(hi)), pa.array(np.ascontiguousarray(lo)), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary()), pa.array(times, pa.list_(pa.int32()))]
        columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary()), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "hi", "lo", "n", "parity", "times", "bands", "regs", "bits"])

    return _map_slices(docs, run, "doc_id long, hi long, lo long, n long, parity binary, times array<int>, bands array<long>, regs binary, bits binary")


def _words(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _dealt(rows: DataFrame, key_rows: int) -> DataFrame:
    """Rows of a key as they are; of more than ``key_rows`` (``size``) in block pairs."""
    blocks = F.ceil(F.col("size") / key_rows).cast("int")
    both = rows.withColumn("_own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.when(F.col("size") <= key_rows, F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return both.withColumn("key", key).drop("_own", "_other", "size")


def _left_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of rows (key, node, n, root, bits, parity) of one key and different roots whose sizes, bits and parities let them be near.
    The parities are an exact bound: they differ in no more bits than the sets in shingles."""
    share = (1 - least) / 2
    radius = int(REGISTERS * share + DEVIATIONS * np.sqrt(REGISTERS * share * (1 - share)))

    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray, odd: np.ndarray) -> pa.RecordBatch:
        out, at, shift = [np.zeros((0, 2), np.int64)], np.arange(len(key)), 1
        while len(at := at[at + shift < len(key)]) and len(at := at[key[at] == key[at + shift]]):
            i, j = at, at + shift
            good = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[good], j[good]
            for k in range(0, len(i), AT_ONCE):
                x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
                hit = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64) <= (1 - least) / (1 + least) * (n[x] + n[y]) + 1e-9
                x, y = x[hit], y[hit]
                hit = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= radius
                out.append(np.sort(np.stack([node[x[hit]], node[y[hit]]], 1), axis=1))
            shift += 1
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy() for c in ("key", "node", "n", "root")] + [_words(batch[c], np.uint64) for c in ("bits", "parity")]
            kept = [np.concatenate(v) for v in zip(kept, new, strict=True)] if kept else new
            if len(kept[0]) >= 1 << 15 and (cut := int(np.searchsorted(kept[0], kept[0][-1]))):
                yield pairs(*(v[:cut] for v in kept))
                kept = [v[cut:] for v in kept]
        if kept:
            yield pairs(*kept)

    dealt = rows.select("key", "node", "n", "root", "bits", "parity").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _both(pairs: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
    """Pairs with the columns ``names`` of ``side`` (node, ..) for both ends, as x_ and y_."""
    total, wide = pairs.count(), pairs
    for end, mark in (("b", "y_"), ("a", "x_")):
        sizes = pairs.groupBy(end).agg(F.count("*").alias("n"))
        wide = split_join(wide, side.select(F.col("node").alias(end), *(F.col(c).alias(mark + c) for c in names)), [end], sizes, total=total)
    return wide


def _signatures(every: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, regs, bits of the nodes ``wanted``, from the row of each node's least id: the signatures of all other texts stay where they are. At most
    ``BUCKETS`` hash values of ids are broadcast."""
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = written(nodes.select("node", "hi", "lo", F.coalesce("least_id", F.lit(-(1 << 63))).alias("_id")).join(wanted.select("node").distinct(), "node", "left_semi"), "near-ids")
    bucket = F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).cast("int")
    rows = every.select("hi", "lo", known.alias("_id"), "regs", "bits").withColumn("_bucket", bucket)
    some = rows.join(F.broadcast(ids.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi")
    found = some.join(ids, ["hi", "lo", "_id"]).dropDuplicates(["hi", "lo", "_id"])  # one row a node, where the join has dealt it
    return written(found.select("node", "regs", "bits"), "near-signatures")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the bound and whose corrected estimate reaches it, less its deviation."""
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                left, right = (_words(part[c], np.uint16) for c in ("left", "right"))
                seen, used = estimates(left, right, *(part[c].to_numpy().astype(float) for c in ("x_n", "y_n", "both")))
                good = seen >= least - DEVIATIONS * np.sqrt(least * (1 - least) / used)
                yield part.select(["a", "b"]).filter(pa.array(good))

    wide = _both(pairs, nodes, ["n", "times", "regs"]).filter(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
    wide = wide.withColumn("both", F.array_max(F.array_intersect("x_times", "y_times")))
    one = lambda regs, times: F.substring(F.col(regs), (F.array_position(F.col(times), F.col("both")).cast("int") - 1) * 2 * REGISTERS + 1, F.lit(2 * REGISTERS))
    cut = wide.filter("both is not null").select("a", "b", "x_n", "y_n", "both", one("x_regs", "x_times").alias("left"), one("y_regs", "y_times").alias("right"))
    return cut.mapInArrow(run, "a long, b long")


def _full_sets(rows: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the sets in pairs. At most ``BUCKETS`` hash values of ids are broadcast, to keep most other texts from being dealt out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words_of(t.as_py()), SHINGLE) for t in batch["text"]]
        keys = np.stack([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        own = (keys[:, 0] == batch["hi"].to_numpy()) & (keys[:, 1] == batch["lo"].to_numpy())  # an id of several texts: only the set of the node
        columns = [batch["node"], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["node", "shingles"]).filter(pa.array(own))

    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "hi", "lo", F.col("least_id").alias("doc_id")), "node"), "near-ids")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    some = rows.withColumn("_bucket", bucket).join(F.broadcast(wanted.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")
    # repeated rows go where the join has dealt them: sets are wider than texts. Texts of one id and set that differ in blanks only repeat a link
    once = some.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "node", "hi", "lo", "text").distinct().drop("doc_id")
    return written(_map_slices(once, run, "node long, shingles array<long>"), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have ``percent`` of 100 shingles in common or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch["x_shingles"], batch["y_shingles"], strict=True):
            a, b = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= percent * (len(a) + len(b) - both))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _map_slices(_both(pairs, sets, ["shingles"]), run, "a long, b long")


def near_sets(docs: DataFrame, percent: int = 80, key_rows: int = KEY_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (whether it is the document's own).

    Two documents link if 100 x intersection >= ``percent`` x union of their sets of two-word shingles (a text of one word is one shingle). Null and
    wordless texts have empty sets and link with nothing. Repeated rows return a row each and link like any other, empty ones by their id; rows without
    an id return a row, are not kept, and name a component only if none of it has an id. Other columns are ignored; an empty table gives no rows.
    """
    least = percent / 100
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(_signed(rows, least), "near-signed")
    # equal sets are one node, which the least id stands for
    signed = F.first(F.struct("n", "parity", "times", "bands")).alias("x")
    nodes = every.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least_id"), signed).select("hi", "lo", "least_id", "x.*")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    bands = REGISTERS // band_rows(least)
    shared = nodes.select("node", F.posexplode("bands").alias("at", "key")).select("key", "node", F.expr(f"cast(at div {bands} as int)").alias("s"))
    sizes = written(shared.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-keys")
    total = nodes.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    keys = written(split_join(shared, sizes.withColumnRenamed("n", "size"), ["key"], sizes, hot_rows=hot_rows, total=total), "near-keys")
    degrees = keys.groupBy("node").agg(F.sum("size").alias("degree"))
    heads = keys.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("head"))
    starred = split_join(keys, heads, ["key"], sizes, hot_rows=hot_rows, total=total).filter("node <> head")
    pairs = written(starred.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "near-pairs")
    links = _links(rows, every, pairs, nodes, percent)
    roots = star_components(links, hot_rows)
    left = keys.drop("size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = left.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("size")).filter("_a <> _b").select("key", "size")
    rest = written(left.join(mixed, "key"), "near-left")  # keys of one component are done
    bits = F.expr(f"substring(bits, s * {REGISTERS // 8} + 1, {REGISTERS // 8})").alias("bits")
    rest = written(rest.join(nodes.select("node", "n", "parity"), "node").join(_signatures(every, nodes, rest), "node").select("key", "node", "root", "size", "n", bits, "parity"), "near-left")
    pairs = written(_left_pairs(_dealt(rest, key_rows), least), "near-pairs")
    links = links.union(_links(rows, every, pairs, nodes, percent))
    named = nodes.select("node", "hi", "lo", "least_id").join(star_components(links, hot_rows), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "near-roots")
    component = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = every.select("doc_id", "hi", "lo", "n")
    found = split_join(members, named.join(component, "root").select("hi", "lo", "component_id"), ["hi", "lo"], how="left", hot_rows=hot_rows)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))


def _links(rows: DataFrame, every: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    signed = _signatures(every, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    likely = written(_likely(pairs, nodes.select("node", "n", "times").join(signed.select("node", "regs"), "node"), percent), "near-likely")
    return written(_confirmed(likely, _full_sets(rows, likely, nodes), percent), "near-links")
