"""Benchmark decontamination with SimHash over item-sized windows.

Texts are word sequences (ASCII punctuation is white space, A-Z lower-cased). For each item a
window of as many words slides over a text; the window's five-word shingles, repeats included, are
summed to a SimHash. Windows of whose shingles too few occur in any item cannot reach the similarity and
are not hashed. A multi-index over eight fingerprint blocks finds every item within the radius: of eight blocks one
differs in at most an eighth of the radius, and each block lists, for each of its values, the items so near to it. Lists are
read for as many windows at once as ``PAIRS`` allows, so memory is bounded. What it finds is verified by the exact weighted similarity: sum of the lesser over sum of the
greater shingle counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import ragged_arange, utf8_size

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints at similarity 0.8 differ in about 10 of 64 bits; more than 23 is over 4 standard deviations away.
RADIUS = 23
#: Windows times items that are looked at together.
PAIRS = 1 << 20
#: Items and their bytes that one pass over the documents sends to the executors.
PASS_ITEMS, PASS_BYTES = 20_000, 32 << 20
_SPACE = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(128)) + bytes(range(128, 256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIXES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_SPACE).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of word hashes; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = h * _FACTOR + words[i : len(words) - k + 1 + i]
    for m in _MIXES:
        h ^= h >> np.uint64(32)
        h *= m
    return h ^ (h >> np.uint64(29))


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 for each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = a.keys() | b.keys()
    return sum(min(a[x], b[x]) for x in both) / max(1, sum(max(a[x], b[x]) for x in both))


class ItemIndex:
    """Items by id: shingle counts, lengths and the multi-index over their fingerprints."""

    def __init__(self, items: list[tuple[int, list[int]]], radius: int):
        self.radius = radius
        self.ids = [i for i, _ in items]
        hashes = [shingle_hashes(np.array(w, np.uint64)) for _, w in items]
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.words = np.array([len(w) for _, w in items], np.int64)
        self.prints = np.array([pack(bit_rows(h).sum(0)[None])[0] for h in hashes], np.uint64)
        self.shingles = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        near = np.array([[bin(a ^ b).count("1") <= radius // 8 for b in range(256)] for a in range(256)])
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        self.sizes = []
        for size in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == size)
            lists = [np.nonzero(near[:, blocks[own, b]]) for b in range(8)] if size >= SHINGLE else []
            self.sizes.append((size, own, [(np.searchsorted(value, np.arange(257)), item) for value, item in lists]))
        self.short_by_size: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero(self.words < SHINGLE).tolist():
            self.short_by_size.setdefault(int(self.words[i]), {}).setdefault(int(hashes[i][0]), []).append(i)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if len(at):
            to = np.minimum(np.searchsorted(self.shingles, h[at]), len(self.shingles) - 1)
            at = at[self.shingles[to] == h[at]]
        return at

    def within(self, prints: np.ndarray, own: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, item) of all items of one size within the radius: the blocks' lists
        name the candidates, whose differing bits are then counted."""
        found = [np.zeros(0, np.int64)]
        step = max(1, PAIRS // len(own))
        for first in range(0, len(prints), step):
            part = prints[first : first + step]
            blocks = part.view(np.uint8).reshape(-1, 8)
            for b, (starts, items) in enumerate(lists):
                low = starts[blocks[:, b]]
                n = starts[blocks[:, b].astype(np.int64) + 1] - low
                at, item = np.repeat(np.arange(len(part)), n), items[ragged_arange(low, n)]
                close = np.bitwise_count(self.prints[own[item]] ^ part[at]) <= self.radius
                found.append((at[close] + first) * len(own) + item[close])
        at, item = np.divmod(np.unique(np.concatenate(found)), len(own))
        return at, own[item]

    def short_matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Items of fewer words than a shingle, word for word at their first place."""
        for size, items in self.short_by_size.items():
            if len(words) >= size:
                seen: set[int] = set()
                for start, h in enumerate(shingle_hashes(words, size).tolist()):
                    if h in items and h not in seen:
                        seen.add(h)
                        yield from ((self.ids[i], start, 0, 1.0) for i in items[h])

    def matches(self, words: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, differing bits, similarity) of each item's best window."""
        found = list(self.short_matches(words))
        if len(words) < SHINGLE:
            return found
        h = shingle_hashes(words)
        hit = self.hits(h)
        if not len(hit):
            return found
        before = np.zeros(len(h) + 1, np.int64)
        before[hit + 1] = 1
        before = before.cumsum()
        best: dict[int, tuple[float, int, int]] = {}
        for size, own, lists in self.sizes:
            if not lists:
                continue
            width = min(size, len(words)) - SHINGLE + 1
            starts = np.unique(np.clip(ragged_arange(hit - width + 1, np.full(len(hit), width)), 0, len(h) - width))
            starts = starts[before[starts + width] - before[starts] >= least * width - 1e-9]
            for a, b in self._stretches(starts, width):
                run = starts[a:b]
                lo, hi = int(run[0]), int(run[-1]) + width
                sums = np.concatenate([np.zeros((1, 64), np.int32), bit_rows(h[lo:hi]).cumsum(0, dtype=np.int32)])
                prints = pack(sums[run - lo + width] - sums[run - lo])
                for at, i in zip(*(x.tolist() for x in self.within(prints, own, lists)), strict=True):
                    start = int(run[at])
                    sim = weighted_similarity(Counter(h[start : start + width].tolist()), self.counts[i])
                    if sim >= least and (i not in best or sim > best[i][0]):
                        best[i] = (sim, start, int(np.bitwise_count(prints[at] ^ self.prints[i])))
        return [*found, *((self.ids[i], start, bits, sim) for i, (sim, start, bits) in best.items())]

    @staticmethod
    def _stretches(starts: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
        """Runs of starts close to each other, at most 65,536 words long."""
        if not len(starts):
            return iter(())
        cut = [0]
        for i in (np.flatnonzero(np.diff(starts) > width) + 1).tolist() + [len(starts)]:
            while i - cut[-1] > 65536:
                cut.append(cut[-1] + 65536)
            cut.append(i)
        return zip(cut, cut[1:], strict=False)


def _found(index: ItemIndex, text: str | None, least: float) -> list[tuple[int, int, int, float]]:
    words = words_of(text)
    return index.matches(np.fromiter(map(word_hash, words), np.uint64, len(words)), least)


def _match(shared, least: float):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = [(doc, *m) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for m in _found(index, text.as_py(), least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "first_word", "bits", "similarity"])

    return run


def _passes(items: DataFrame, radius: int) -> Iterator:
    """Broadcast indexes over the items, each of bounded size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    n, size = items.agg(F.count("*"), F.sum(utf8_size(F.col("text")))).first()
    passes = max(1, -(-n // PASS_ITEMS), -(-(size or 0) // PASS_BYTES))
    for p in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(passes)) == p).collect()
        worded = [(r["item_id"], [word_hash(w) for w in words_of(r["text"])]) for r in rows]
        ordered = sorted((x for x in worded if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(ordered, radius))


def contaminated(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, first_word, bits, similarity: the best window of each benchmark item that a
    document holds with similarity ``least`` or more (the first among equals).

    Items go to the executors in passes of bounded size, each over all documents. Null or wordless
    texts match nothing; items under five words are found word for word; repeated rows of documents return
    their matches each, repeated items count once; null ids stay null; other columns are ignored; empty tables give an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [rows.mapInArrow(_match(shared, least), "doc_id long, item_id long, first_word int, bits int, similarity double") for shared in _passes(items, radius)]
    return reduce(DataFrame.unionByName, parts)


def _clean(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = [i for i, text in enumerate(batch["text"]) if not _found(index, text.as_py(), least)]
            if keep:
                yield batch.take(pa.array(keep))

    return run


def clean_documents(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item; null and wordless texts hold none, repeated rows
    stay or go together, other columns may have any name; an empty table gives an empty one."""
    schema = docs.schema
    for shared in _passes(items, radius):
        docs = docs.mapInArrow(_clean(shared, least), schema)
    return docs
