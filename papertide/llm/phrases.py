"""Phrases that occur together more often than their parts would, by direct-address tiles of frequency-ranked ids.

Texts become sequences of chunk-local numbers; the chunks' word lists meet in one count, and words of ``least``
occurrences or more get ids by falling frequency, which go back to the chunks by a join. Pairs of neighbouring ids are then
counted in tiles of ids: tiles with many pairs by a dense ``bincount``, all others as sorted coordinates. The chunks' counts travel as packed blocks, a
block for each group of small squares of ids, and are added up there; frequent pairs get numbers, go back to their chunks and are ranked there by
their frequency, and the same step counts them with the word that follows, and so on up to the longest phrase.
A task holds one chunk, or some squares; nothing that grows with the corpus is sent to all tasks or to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertide.llm.common import written
from papertide.llm.hilbert import ranked

#: Sentence marks and line ends, made full stops; a full stop is then a word of its own, the gap between pieces.
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes.maketrans(_MARKS, b"." * len(_MARKS))
#: Words of a chunk, about; words of one row of a chunk's sequence.
CHUNK, PART = 1 << 20, 1 << 18
#: Side of a tile, tiles a side that may be dense, and pairs from which on a tile is counted densely.
SIDE, TILES, DENSE = 1024, 32, 1 << 16

#: Side of the squares of ids that go to one task together, and entries of chunks that a task adds up, about.
SQUARE, ENTRIES = 64, 1 << 20

_ENCODED = "chunk long, lang string, part int, word string, local int, n long, data binary"
_COUNTED = "chunk long, part int, square int, data binary"
_SUMMED = "chunk long, u long, w int, f long, id long, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed value: bytes of equal weight stand together."""
    parts = [pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), "zstd", asbytes=True) for a in arrays]
    head = np.array([(len(a), a.itemsize, len(p)) for a, p in zip(arrays, parts, strict=True)], np.int64)
    return bytes([len(arrays)]) + head.tobytes() + b"".join(parts)


def unpacked(value: bytes) -> list[np.ndarray]:
    count, out = value[0], []
    at = 1 + 24 * count
    for n, size, length in np.frombuffer(value, np.int64, 3 * count, 1).reshape(count, 3).tolist():
        raw = pa.decompress(value[at : at + length], n * size, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"i{size}").ravel() if n else np.zeros(0, f"i{size}"))
        at += length
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pieces_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, with a full stop between pieces."""
    return (text or "").encode().lower().translate(_TO_STOP).replace(b".", b" . ").split()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one language: a row a word with its number in the chunk and its count, and the sequence of numbers (0: gap)."""
    task, made, held = TaskContext.get().partitionId(), 0, 0
    open_chunks: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    sizes: dict[str, int] = {}
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("part", pa.int32()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made, held
        numbers, kept = open_chunks.pop(lang)
        held -= sizes.pop(lang)
        chunk, made = (task << 32) + made, made + 1
        tokens = np.concatenate(kept)
        counts, words = np.bincount(tokens, minlength=len(numbers)), list(numbers)
        for i in range(1, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            k = len(part)
            columns = [[chunk] * k, [lang] * k, [None] * k, part, np.arange(i, i + k, dtype=np.int32), counts[i : i + k], [None] * k]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for i in range(0, len(tokens), PART):
            columns = [[chunk], [lang], [i // PART], [None], [None], [None], [packed(tokens[i : i + PART])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            if lang not in open_chunks:
                open_chunks[lang], sizes[lang] = (_Numbers({b".": 0}), []), 0
            numbers, kept = open_chunks[lang]
            words = pieces_of(text.as_py())
            kept.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            kept.append(np.zeros(1, np.int32))
            sizes[lang] += len(words) + 1
            held += len(words) + 1
            if held > 2 * CHUNK:
                yield from close(max(sizes, key=sizes.__getitem__))
    for lang in list(open_chunks):
        yield from close(lang)


def tile_counts(a: np.ndarray, b: np.ndarray, side: int = SIDE, tiles: int = TILES, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids (a, b) below 2^31 and their counts: dense tiles by direct address, the others as sorted coordinates."""
    row, column = a // side, b // side
    head = np.flatnonzero((row < tiles) & (column < tiles))
    tile = row[head] * tiles + column[head]
    full = np.flatnonzero(np.bincount(tile, minlength=tiles * tiles) >= dense)
    out, rest = [], np.ones(len(a), bool)
    if len(full):
        slot = np.full(tiles * tiles, -1)
        slot[full] = np.arange(len(full))
        inside = slot[tile] >= 0
        head, tile = head[inside], tile[inside]
        rest[head] = False
        head = head[np.argsort(slot[tile], kind="stable")]
        ends = np.searchsorted(np.sort(slot[tile]), np.arange(len(full) + 1))
        for k, t in enumerate(full.tolist()):
            at = head[ends[k] : ends[k + 1]]
            cells = np.bincount((a[at] - t // tiles * side) * side + (b[at] - t % tiles * side), minlength=side * side)
            hit = np.flatnonzero(cells)
            out.append((hit // side + t // tiles * side, hit % side + t % tiles * side, cells[hit]))
    keys = np.sort(a[rest] << 32 | b[rest])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    out.append((keys[first] >> 32, keys[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(keys)])))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _blocks(chunk: int, u: np.ndarray, w: np.ndarray, n: np.ndarray, squares: int) -> Iterator[pa.RecordBatch]:
    """The counts of a chunk, a row for each group of squares of ids."""
    h = (u // SQUARE).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (w // SQUARE).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    group = ((h >> np.uint64(32)) % np.uint64(squares)).astype(np.int64)
    order = np.lexsort((w, u, group))
    u, w, n, group = u[order], w[order].astype(np.int32), n[order].astype(np.int32), group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[: len(group)]
    ends = np.r_[first[1:], len(group)]
    for i in range(0, len(first), 512):
        spans = list(zip(first[i : i + 512].tolist(), ends[i : i + 512].tolist(), strict=True))
        data = [packed(np.diff(u[a:b], prepend=0), w[a:b], n[a:b]) for a, b in spans]
        k = len(data)
        columns = [pa.array(np.full(k, chunk)), pa.nulls(k, pa.int32()), pa.array(group[[a for a, _ in spans]].astype(np.int32)), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "square", "data"])


def _numbered(length: int, keep: bool, squares: int):
    """Rows of chunks (in order: ids of units, then the sequences) -> the counts of units with the word that follows and, if they are
    needed again, the sequences by the new ids. ``length`` is that of the units in words; of length 1 they are words."""

    def chunk_rows(chunk: int, ids: list[list[np.ndarray]], parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        known = [np.concatenate(x) for x in zip(*ids, strict=True)] if ids else [np.zeros(0, np.int64)] * (2 if length == 1 else 4)
        if length == 1:
            local = np.concatenate([p[0] for p in parts])
            table = np.full(int(max(local.max(initial=0), known[0].max(initial=0))) + 1, -1, np.int64)
            table[known[0]] = known[1]
            seq = table[local]
            seq = seq[np.r_[True, (seq[1:] >= 0) | (seq[:-1] >= 0)]]  # one gap in a row is enough
            follow, names = seq, None
        else:
            # a unit is the one before it and the word that follows that one; its number in the chunk follows its frequency
            before, follow = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, -1))
            u, w, names, f = known
            heads = np.unique(u)
            order = np.argsort(-f, kind="stable")
            names, number = names[order], np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            keys = np.searchsorted(heads, u) << 32 | w.astype(np.int64)
            order = np.argsort(keys)
            keys, number = keys[order], number[order]
            seq = np.full(len(before), -1, np.int64)
            if len(keys):
                nexts = np.r_[follow[length - 1 :], np.full(min(length - 1, len(follow)), -1, np.int64)]
                at = np.minimum(np.searchsorted(heads, before), len(heads) - 1)
                good = np.flatnonzero((before >= 0) & (nexts >= 0) & (heads[at] == before))
                wanted = at[good] << 32 | nexts[good]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[place] == wanted
                seq[good[hit]] = number[place[hit]]
        nexts = np.r_[follow[length:], np.full(min(length, len(follow)), -1, np.int64)]
        both = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0) & (nexts[:-1] >= 0))
        a, b, n = tile_counts(seq[both], nexts[both])
        yield from _blocks(chunk, a if names is None else names[a], b, n, squares)
        if keep:
            units = seq.astype(np.int32) if names is None else np.where(seq >= 0, names[np.maximum(seq, 0)], -1) if len(names) else seq
            for i in range(0, len(seq), PART):
                data = packed(units[i : i + PART]) if names is None else packed(units[i : i + PART], follow[i : i + PART].astype(np.int32))
                columns = [pa.array([chunk], pa.int64()), pa.array([i // PART], pa.int32()), pa.nulls(1, pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "square", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []
        for batch in batches:
            chunks, places = batch["chunk"].to_numpy(), batch["part"].to_numpy()
            for first in np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]] if len(chunks) else []).tolist():
                if chunks[first] != now:
                    if parts:
                        yield from chunk_rows(now, ids, parts)
                    now, ids, parts = int(chunks[first]), [], []
                end = int(np.searchsorted(chunks, chunks[first], "right"))
                split = first + int((places[first:end] < 0).sum())
                data = batch["data"].slice(first, end - first).to_pylist()
                if length == 1:
                    ids.append([batch[c].slice(first, split - first).to_numpy() for c in ("u", "id")])
                else:
                    for value in data[: split - first]:
                        u, *others = unpacked(value)
                        ids.append([np.cumsum(u), *others])
                parts += map(unpacked, data[split - first :])
        if parts:
            yield from chunk_rows(now, ids, parts)

    return run


def _summed(least: int, keep: bool):
    """Blocks of chunks, in the order of their squares -> the pairs of ``least`` occurrences or more with new ids and, if they are
    needed again, the ids for each chunk."""

    def square_rows(square: int, chunks: list[int], blocks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        u, w, n = (np.concatenate([b[i] for b in blocks]) for i in range(3))
        owner = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])
        order = np.lexsort((owner, w, u))
        u, w = u[order], w[order]
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])[: len(u)]
        f = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        good = np.flatnonzero(f >= least)
        for i in range(0, len(good), 1 << 16):
            at = good[i : i + (1 << 16)]
            k = len(at)
            columns = [pa.nulls(k, pa.int64()), pa.array(u[first[at]]), pa.array(w[first[at]]), pa.array(f[at]), pa.array((square << 32) + at), pa.nulls(k, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "u", "w", "f", "id", "data"])
        if keep:
            number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(u)]))
            rows = np.flatnonzero(f[number] >= least)
            own = owner[order][rows]
            rows = rows[np.argsort(own, kind="stable")]
            ends = np.searchsorted(np.sort(own), np.arange(len(blocks) + 1))
            for k, chunk in enumerate(chunks):
                at = rows[ends[k] : ends[k + 1]]
                if len(at):
                    data = packed(np.diff(u[at], prepend=0), w[at], (square << 32) + number[at], f[number[at]])
                    columns = [pa.array([chunk], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "u", "w", "f", "id", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, blocks = None, [], []
        for batch in batches:
            for square, chunk, value in zip(*(batch[c].to_pylist() for c in ("square", "chunk", "data")), strict=True):
                if square != now:
                    if blocks:
                        yield from square_rows(now, chunks, blocks)
                    now, chunks, blocks = square, [], []
                u, w, n = unpacked(value)
                chunks.append(chunk)
                blocks.append([np.cumsum(u), w, n])
        if blocks:
            yield from square_rows(now, chunks, blocks)

    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(words, phrases, totals): words (id, lang, word, n) of ``least`` occurrences or more; for each length from 2 to ``longest``
    (words: array of ids, f) of the phrases of ``least`` or more; totals (lang, total) of all word occurrences."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    encoded = written(rows.mapInArrow(_encode, _ENCODED), "phrase-chunks")
    named = encoded.filter("word is not null")
    totals = written(named.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    counted = written(named.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-sums")
    words, _ = ranked(counted.withColumn("_order", -F.col("n")), ["_order", "lang", "word"], "phrase-words")
    words = written(words.select(F.col("rank").alias("id"), "lang", "word", "n"), "phrase-words")
    squares = 1 + int(totals.agg(F.sum("total")).first()[0] or 0) // ENTRIES
    none = F.lit(None).cast("binary").alias("data")
    ids = named.select("chunk", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"])
    ids = ids.select("chunk", F.lit(-1).alias("part"), F.col("local").cast("long").alias("u"), "id", none)
    zero = F.lit(0).cast("long")
    sequences = encoded.filter("part is not null").select("chunk", "part", zero.alias("u"), zero.alias("id"), "data")
    phrases: list[DataFrame] = []
    spelled = words.select("id", F.array("id").alias("words"))
    for length in range(1, longest):
        keep = length + 1 < longest
        dealt = ids.union(sequences).repartition("chunk").sortWithinPartitions("chunk", "part")
        level = written(dealt.mapInArrow(_numbered(length, keep, squares), _COUNTED), "phrase-counts")
        dealt = level.filter("square is not null").select("square", "chunk", "data").repartition("square").sortWithinPartitions("square", "chunk")
        summed = written(dealt.mapInArrow(_summed(least, keep), _SUMMED), "phrase-sums")
        grams = summed.filter("id is not null").select("id", "u", "w", "f").join(spelled.select(F.col("id").alias("u"), F.col("words").alias("_head")), "u")
        grams = written(grams.select("id", F.concat("_head", F.array(F.col("w").cast("long"))).alias("words"), "f"), "phrase-grams")
        phrases.append(grams.select("words", "f"))
        spelled = grams.select("id", "words")
        ids = summed.filter("chunk is not null").select("chunk", F.lit(-1).alias("part"), zero.alias("u"), zero.alias("id"), "data")
        sequences = level.filter("part is not null").select("chunk", "part", zero.alias("u"), zero.alias("id"), "data")
    return words, phrases, totals


def _scored(words: DataFrame, phrases: list[DataFrame], length: int) -> DataFrame:
    """Phrases of one length with a, l, r and score of their lowest-scoring cut."""
    known = {1: words.select(F.array("id").alias("words"), F.col("n").alias("f"))} | {k + 2: p for k, p in enumerate(phrases)}
    rows = phrases[length - 2].withColumnRenamed("f", "a")
    for cut in range(1, length):
        first = known[cut].select(F.col("words").alias("_first"), F.col("f").alias(f"_l{cut}"))
        rest = known[length - cut].select(F.col("words").alias("_rest"), F.col("f").alias(f"_r{cut}"))
        rows = rows.join(first, F.slice("words", 1, cut) == F.col("_first")).drop("_first")
        rows = rows.join(rest, F.slice("words", cut + 1, length - cut) == F.col("_rest")).drop("_rest")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = []
    for cut in range(1, length):
        rows = rows.withColumn("_up", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(38,0)")).withColumn("_down", wide(f"_l{cut}") * wide(f"_r{cut}"))
        rows = rows.withColumn(f"_s{cut}", F.expr("_up div _down")).drop("_up", "_down")
        cuts.append(F.struct(F.col(f"_s{cut}").alias("score"), F.lit(cut).alias("k"), F.col(f"_l{cut}").alias("l"), F.col(f"_r{cut}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return rows.select("words", "a", best.alias("_best")).select("words", "a", "_best.l", "_best.r", "_best.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, contained: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language, by score, then a, then phrase.

    Phrases of 2 to ``longest`` words with ``least`` occurrences or more, unless a longer one that holds them has ``contained``
    percent of their occurrences. The score of a cut is floor(1,000,000 a a / (l r)), exact in 128-bit decimals; the lowest cut counts,
    ties to the shorter first part. A null language is ``und``; null and empty texts hold nothing; repeated rows count as often
    as they stand; texts of any length are whole; an empty table gives no rows; other columns are ignored. Word ids must stay below 2^31.
    """
    docs.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(top, 1000)))  # best rows are cut before they are dealt out
    words, phrases, totals = frequent_phrases(docs, longest, least)
    kept = []
    for length in range(2, longest + 1):
        scored = _scored(words, phrases, length)
        parts = [
            longer.select(F.slice("words", at, length).alias("words"), "f")
            for size, longer in enumerate(phrases[length - 1 :], length + 1)
            for at in range(1, size - length + 2)
        ]
        if parts:
            held = reduce(DataFrame.union, parts).groupBy("words").agg(F.max("f").alias("_f"))
            scored = scored.join(held, "words", "left").filter(F.coalesce(100 * F.col("_f") < contained * F.col("a"), F.lit(True))).drop("_f")
        kept.append(scored)
    spelled = reduce(DataFrame.unionByName, (_spelled(k, words, length) for length, k in enumerate(kept, 2)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _spelled(rows: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """The rows with lang and phrase in place of the ids."""
    for k in range(length):
        named = words.select(F.col("id").alias("_id"), F.col("word").alias(f"_w{k}"), *(["lang"] if k == 0 else []))
        rows = rows.join(named, F.col("words")[k] == F.col("_id")).drop("_id")
    return rows.select("lang", F.concat_ws(" ", *(f"_w{k}" for k in range(length))).alias("phrase"), "a", "l", "r", "score")
