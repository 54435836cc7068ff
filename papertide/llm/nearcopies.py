"""Near copies: texts whose sets of five-word shingles have similarity (Jaccard) 0.8 or more, by SimHash.

The 256-bit SimHashes of a group of candidates stand as bit planes and are compared by the carry-save counters of
``simhash``; what is within the radius is verified on the texts. At similarity 0.8 the sets' cosine is 0.889 at least,
so a bit differs with probability 0.151: 39 of 256 bits on average, and more than ``RADIUS`` in less than one pair of 10^6. That holds for sets of
``SMALL`` shingles or more; of fewer, a bit differs more often, so pairs with a smaller set skip the SimHash and go by the exact bounds only.

Before the texts are read, a parity sketch (each shingle flips one of 512 bits) drops pairs by an exact bound: it differs in no more
bits than the sets in shingles.

Two SimHashes that far apart share no block of bits that could be looked up, so the groups come from prefixes of the sets. Shingles
have one order for all texts; of two sets of similarity t, the first n - ceil(t n) + 1 shingles of each share one, whatever
the order is, so no pair is left out. Shingles that are frequent in a sample stand last, which keeps the groups small. A first round
compares each text of a group with the most central only (that nearest to the bits' majority, as an original is among its
edited copies) and joins large groups; the last compares the pairs that are still in different components.
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
from papertide.llm.decontaminate import shingle_hashes
from papertide.llm.simhash import pairs_within, within_radius

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a SimHash, and differing bits up to which a pair is verified.
BITS, RADIUS = 256, 71
#: Shingles of the smaller set from which on SimHashes are compared.
SMALL = 64
#: Bits of a parity sketch.
SKETCH = 512
#: Pairs whose bit planes stand side by side.
AT_ONCE = 1 << 14
#: Rows of a group from which on its bit planes are stored once for all its comparisons.
LARGE = 96
#: Rounds of comparisons with one text a group before the pairs that are left.
HEAD_ROUNDS = 1
#: Texts of one shingle that are compared in one place; larger groups are dealt in block pairs.
KEY_ROWS = 2048
#: Texts of the sample for the order of shingles, and frequent shingles sent to the executors (cost only: any order is right).
SAMPLE, FREQUENT = 8_000, 50_000
#: Hash values of ids that are broadcast at most.
BUCKETS = 1 << 19
#: Texts that are hashed, and pairs that are verified, at once.
SLICE = 256


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    # a text of fewer words has another length than a shingle: its own length keeps the two apart
    return np.unique(shingle_hashes(hashes, size) + np.uint64(min(size, len(words)) % size))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``BITS``-bit SimHash as unsigned longs."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), 65536):
        lanes = [shingles[i : i + 65536]]
        while len(lanes) < BITS // 64:
            h = (lanes[-1] ^ (lanes[-1] >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
            lanes.append(h ^ (h >> np.uint64(29)))
        bits = np.unpackbits(np.stack(lanes, 1).view(np.uint8).reshape(len(lanes[0]), BITS // 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8))


def central(bits: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of rows the row nearest to the majority of the run's bits."""
    heads = firsts.copy()
    for k in np.flatnonzero(sizes > 2).tolist():
        run = bits[firsts[k] : firsts[k] + sizes[k]]
        votes = np.unpackbits(run.view(np.uint8).reshape(len(run), BITS // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        majority = np.packbits(votes * 2 > len(run), bitorder="little").view(np.uint64)
        heads[k] += int(np.argmin(np.bitwise_count(run ^ majority).sum(1, dtype=np.int64)))
    return heads


def _map_slices(df: DataFrame, fn, schema: str) -> DataFrame:
    """A function over parts of at most ``SLICE`` rows: their sets are larger than their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                yield fn(batch.slice(i, SLICE))

    return df.mapInArrow(run, schema)


def prefix(shingles: np.ndarray, tokens: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set: those not frequent by hash, then the frequent ones by count."""
    rank = np.zeros(len(shingles), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        rank = np.where(tokens[at] == shingles, counts[at], 0)
    n = len(shingles)
    return shingles[np.lexsort((shingles, rank))[: n - int(np.ceil(least * n - 1e-9)) + 1]] if n else shingles


def _text_key(words: list[bytes]) -> int:
    """Hash of the words in order, 0 without words."""
    return xxhash.xxh64_intdigest(b" ".join(words)) if words else 0


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in three or more texts of a sample, sorted, and their counts there."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words_of(t.as_py())) for t in batch["text"]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SAMPLE))) == 0).select("text").distinct()
    counts = _map_slices(part, run, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens, n = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    at = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[at], n[at]


def _sets(docs: DataFrame, shared, least: float) -> DataFrame:
    """doc_id, fp (text key), n (shingles), bits (SimHash), sketch (parities), tokens (the prefix)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t.as_py()) for t in batch["text"]]
        sets = [shingle_set(w) for w in words]
        prints = [wide_fingerprint(s).tobytes() for s in sets]
        tokens = [prefix(s, *shared.value, least).view(np.int64) for s in sets]
        fp = np.array([_text_key(w) for w in words], np.uint64).view(np.int64)
        columns = [batch["doc_id"], pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints, pa.binary()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n", "bits", "sketch", "tokens"])

    return _map_slices(docs, run, "doc_id long, fp long, n int, bits binary, sketch binary, tokens array<long>")


def _longs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _candidates(rows: DataFrame, least: float, heads: bool) -> DataFrame:
    """Pairs ``(a, b)`` of rows (key, fp, n, bits, root, and sketch for all pairs) of one key and different roots that sizes, SimHashes and
    sketches let pass: each row with the key's most central, or all pairs."""
    names = ["key", "fp", "n", "root", "bits"] + ([] if heads else ["sketch"])

    def pairs(part: list[np.ndarray]) -> pa.RecordBatch:
        key, fp, n, root, bits = part[:5]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        sizes = np.diff(np.r_[first, len(key)])
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]

        def put(i: np.ndarray, j: np.ndarray, near: bool) -> None:
            good = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[good], j[good]
            if len(i) and not near:
                small = np.flatnonzero(np.minimum(n[i], n[j]) < SMALL)
                large = np.flatnonzero(np.minimum(n[i], n[j]) >= SMALL)
                hit = [large[k : k + AT_ONCE][within_radius(bits[i[large[k : k + AT_ONCE]]], bits[j[large[k : k + AT_ONCE]]], RADIUS)] for k in range(0, len(large), AT_ONCE)]
                hit = np.concatenate([small, *hit])
                i, j = i[hit], j[hit]
            if len(i) and not heads:
                differ = np.bitwise_count(part[5][i] ^ part[5][j]).sum(1, dtype=np.int64)
                hit = differ <= (1 - least) / (1 + least) * (n[i] + n[j]) + 1e-9
                i, j = i[hit], j[hit]
            out.append(np.stack([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])], 1))
            if len(out) > 64:
                out[:] = [np.unique(np.concatenate(out), axis=0)]

        if heads:
            at = np.flatnonzero(np.repeat(several, sizes))
            own = np.flatnonzero(several)
            begins, lengths = np.cumsum(sizes[own]) - sizes[own], sizes[own]
            if len(at):
                put(at[np.repeat(central(bits[at], begins, lengths), lengths)], at, False)
        else:
            for g in np.flatnonzero(several & (sizes >= LARGE)).tolist():
                group = np.arange(first[g], first[g] + sizes[g])
                roots, times = np.unique(root[group], return_counts=True)
                asking = group[root[group] != roots[np.argmax(times)]]  # rows of the most common root need not ask each other
                few = asking[n[asking] < SMALL / least]
                others = group[n[group] < SMALL / least]
                for k in range(0, len(few), 64):
                    some = few[k : k + 64]
                    i, j = np.repeat(some, len(others)), np.tile(others, len(some))
                    only = np.minimum(n[i], n[j]) < SMALL
                    put(i[only], j[only], True)
                for k in range(0, len(asking), 256):
                    i, j = pairs_within(bits[asking[k : k + 256]], bits[group], RADIUS)
                    put(asking[k + i], group[j], True)
            at = np.flatnonzero(np.repeat(several & (sizes < LARGE), sizes))
            shift = 1
            while len(at := at[at + shift < len(key)]) and len(at := at[key[at] == key[at + shift]]):
                for k in range(0, len(at), 1 << 16):
                    put(at[k : k + (1 << 16)], at[k : k + (1 << 16)] + shift, False)
                shift += 1
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c]), pa.int64()) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy(zero_copy_only=False) for c in names[:4]] + [_longs(batch[c]) for c in names[4:]]
            kept = [np.concatenate(v) for v in zip(kept, new, strict=True)] if kept else new
            if len(kept[0]) >= 1 << 15 and (cut := int(np.searchsorted(kept[0], kept[0][-1]))):
                yield pairs([v[:cut] for v in kept])
                kept = [v[cut:] for v in kept]
        if kept:
            yield pairs(kept)

    return rows.select(*names).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts are similar."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, last, left = [], None, None
        for a, x, y in zip(batch["a"].to_pylist(), batch["left"], batch["right"], strict=True):
            if a != last:
                last, left = a, shingle_set(words_of(x.as_py()))
            good.append(similar(left, shingle_set(words_of(y.as_py())), least))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("fp").alias(k), F.col("text").alias(v)) for k, v in (("a", "left"), ("b", "right")))
    sizes = {k: pairs.groupBy(k).agg(F.count("*").alias("n")) for k in ("a", "b")}
    total = pairs.count()
    both = split_join(split_join(pairs, right, ["b"], sizes["b"], total=total), left, ["a"], sizes["a"], total=total)
    return _map_slices(both.select("a", "b", "left", "right"), run, "a long, b long")


def _texts(rows: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """fp, text of the texts in pairs. A broadcast of at most ``BUCKETS`` hash values of their ids keeps most other texts from being dealt out."""

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        """An id of several texts: only the text of the key."""
        keys = np.array([_text_key(words_of(t.as_py())) for t in batch["text"]], np.uint64).view(np.int64)
        return batch.select(["fp", "text"]).filter(pa.array(keys == batch["fp"].to_numpy()))

    ids = written(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(firsts, "fp").select("doc_id", "fp"), "copy-ids")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    wanted = F.broadcast(ids.select(bucket.alias("_bucket")).distinct())
    some = rows.withColumn("_bucket", bucket).join(wanted, "_bucket", "left_semi").drop("_bucket")
    found = some.join(ids, "doc_id").dropDuplicates(["doc_id", "fp", "text"])
    return written(_map_slices(found.select("fp", "text"), own, "fp long, text string"), "copy-texts")


def _dealt(shares: DataFrame, key_rows: int) -> DataFrame:
    """Rows of a key as they are; of more than ``key_rows`` (``size``) in block pairs."""
    blocks = F.ceil(F.col("size") / key_rows).cast("int")
    dealt = shares.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.when(F.col("size") <= key_rows, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select(key.alias("key"), "fp")


def near_copy_groups(docs: DataFrame, least: float = SIMILARITY, key_rows: int = KEY_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, component_id (least doc_id reachable over pairs of similarity ``least`` or more) of rows with an id.

    Texts of the same words are one group, null and wordless texts too. Repeated rows return a row each, rows without an id
    none; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(rows))
    every = written(_sets(rows, shared, least), "copy-sets")
    distinct = written(every.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "copy-distinct")
    firsts = distinct.filter("fp <> 0").select("fp", F.col("least_id").alias("doc_id"))
    sets = written(every.join(firsts, ["fp", "doc_id"], "left_semi").drop("doc_id"), "copy-first-sets")
    tokens = sets.select("fp", F.explode("tokens").alias("key"))
    counts = written(tokens.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "copy-keys")
    total = every.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    shares = written(_dealt(split_join(tokens, counts, ["key"], counts.withColumnRenamed("size", "n"), hot_rows=hot_rows, total=total), key_rows), "copy-shares")
    needed = written(shares.select("fp").distinct(), "copy-ids")  # texts that share a shingle; all others end here
    prints = written(sets.join(needed, "fp", "left_semi").select("fp", "n", "bits", "sketch").dropDuplicates(["fp"]), "copy-prints")
    with_prints = written(shares.join(prints.drop("sketch"), "fp"), "copy-rows")
    return _joined(rows, every, distinct, with_prints, prints.select("fp", "sketch"), firsts, least)


def _joined(rows: DataFrame, every: DataFrame, distinct: DataFrame, with_prints: DataFrame, sketches: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """The rounds of verified links, their components, and the rows' ids."""
    links, rooted = None, with_prints.withColumn("root", F.col("fp"))
    for turn in range(HEAD_ROUNDS + 1):
        heads = turn < HEAD_ROUNDS
        pairs = written(_candidates(rooted if heads else rooted.join(sketches, "fp"), least, heads), "copy-pairs")
        found = written(_verified(pairs, _texts(rows, pairs, firsts), least), "copy-links")
        links = found if links is None else links.union(found)
        if heads:
            roots = star_components(links).select(F.col("node").alias("fp"), "root")
            left = with_prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            mixed = left.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("key")
            rooted = written(left.join(mixed, "key", "left_semi"), "copy-rows")  # keys of one component are done
    nodes = star_components(links).select(F.col("node").alias("fp"), "root")
    named = written(distinct.join(nodes, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "copy-roots")
    component = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return every.select("doc_id", "fp").join(named.join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")
