"""Groups of spelling variants: words that differ by one inserted, deleted or replaced character, by variable-length grams.

A dictionary of grams is grown from a sample of the words: a gram is lengthened only where it is frequent, so common beginnings get
long, selective grams and rare ones stay short. Each word is cut into its longest dictionary grams that no other covers.
For each place where one edit may fall, the grams are counted that it may change: their greatest number bounds what two near words
can lose, so the rarest grams up to that bound and one more hold a gram of the other word. The lists of words behind a gram, its place
and the shorter word's length are merged, and what is on one list is verified. The sample decides only the cost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import written
from papertide.llm.hilbert import ranked

#: Shortest gram, and longest; a gram is never longer than half of the shorter word, so an edit leaves one whole.
SHORTEST, LONGEST = 2, 8
#: Words of the sample, occurrences there up to which a gram is not lengthened, and grams of the dictionary at most.
SAMPLE, FREQUENT, GRAMS = 50_000, 20, 200_000
#: Words of a list from which on it is cut by what surrounds the gram.
LIST_ROWS = 256
#: Characters of a word that are compared side by side; longer words are compared one by one.
WIDTH = 48


def marked_words(docs: DataFrame, pattern: str = "[A-Za-zÀ-ÿ]", least: int = 7, every: int = 31) -> DataFrame:
    """word, n: runs of ``pattern`` with A-Z lower-cased, of at least ``least`` characters. Where ``every`` divides the crc32 h of
    ``<doc_id>:<run>``, the character h % length is left out. Null texts hold none; a null doc_id counts as empty text."""
    runs = re.compile(f"{pattern}{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(found)
            for i in range(0, len(words), 1 << 16):
                part = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())], ["word", "n"])
            found.clear()

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if not text.is_valid:
                    continue
                words = runs.findall(text.as_py().encode().lower().decode())
                head = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                hashes = [zlib.crc32(w.encode(), head) for w in words]
                for i in [i for i, h in enumerate(hashes) if h % every == 0]:
                    w, at = words[i], hashes[i] % len(words[i])
                    words[i] = w[:at] + w[at + 1 :]
                found.update(words)
            if len(found) > 1 << 17:
                yield from rows()
        yield from rows()

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.filter(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """Frequency-pruned gram dictionary: with each gram stand all its beginnings of ``SHORTEST`` characters or more."""

    def __init__(self, words: list[str], frequent: int = FREQUENT, most: int = GRAMS) -> None:
        counts = Counter(w[i : i + SHORTEST] for w in words for i in range(len(w) - SHORTEST + 1))
        self.frequency = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])
        for size in range(SHORTEST + 1, LONGEST + 1):
            longer = Counter(w[i : i + size] for w in words for i in range(len(w) - size + 1) if self.frequency.get(w[i : i + size - 1], 0) > frequent)
            if not longer or len(self.frequency) + len(longer) > most:
                break
            self.frequency |= longer
        self.longer = {g[:-1] for g in self.frequency}
        #: What a gram holds after its first character: only such a part of a word can come to lie inside another gram.
        self.inner = {g[i:j] for g in self.frequency for i in range(1, len(g)) for j in range(i + 1, len(g) + 1)}

    def cut(self, word: str, longest: int) -> list[tuple[int, int]]:
        """(place, length) of the longest grams that no earlier one covers."""
        known, n, end, out = self.frequency, len(word), 0, []
        for p in range(n - SHORTEST + 1):
            size = SHORTEST
            while size < longest and p + size < n and word[p : p + size + 1] in known:
                size += 1
            if p + size > end:
                end = p + size
                out.append((p, size))
        return out

    def affected(self, word: str, cut: list[tuple[int, int]], longest: int) -> int:
        """The most grams of ``cut`` that one edit can change or cover.

        A gram changes if the edit falls inside it, or right behind it where it could be lengthened. One that starts behind
        the edit can be covered by a new gram that starts before and holds all from the edit to the gram's end.
        """
        n, longer, inner = len(word), self.longer, self.inner
        change, insert = [0] * (n + 1), [0] * (n + 1)  # edits of the character i; insertions before it
        for p, size in cut:
            end = p + size
            change[p] += 1
            for i in range(p + 1, end):
                change[i] += 1
                insert[i] += 1
            if size < longest and word[p:end] in longer:
                change[end] += 1
                insert[end] += 1
            # what reaches less far back is covered by less
            for i in range(p, max(0, end - longest + 1) - 1, -1):
                if word[i:end] not in inner:
                    break
                insert[i] += 1
                if i:
                    change[i - 1] += i - 1 >= end - longest
        return max(max(change), max(insert))

    def rarest(self, word: str, longest: int) -> list[tuple[int, int]]:
        """The grams of which a word at one edit's distance holds one at least, rarest first."""
        cut = self.cut(word, longest)
        cut.sort(key=lambda x: (self.frequency.get(word[x[0] : x[0] + x[1]], 0), word[x[0] : x[0] + x[1]], x[0]))
        return cut[: self.affected(word, cut, longest) + 1]


def _lists(words: DataFrame, grams, least: int) -> DataFrame:
    """key, id, word, size (length of the shorter word), p, l: a row for each list a word stands on."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digest, index = xxhash.xxh64_intdigest, grams.value
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            keys, ids, names, sizes, places, lengths = [], [], [], [], [], []
            for number, word in zip(part["id"].to_pylist(), part["word"].to_pylist(), strict=True):
                n, known = len(word), {}
                for size in (n, n - 1) if n > least else (n,):
                    longest = min(LONGEST, (size - 1) // 2)
                    if longest not in known:
                        known[longest] = index.rarest(word, longest)
                    for p, length in known[longest]:
                        gram = word[p : p + length]
                        # a gram of the longer word stands in the shorter one at the same place or one before
                        for at in (p,) if size == n else (p, p - 1)[: 2 if p else 1]:
                            keys.append(digest(f"{size},{at},{gram}"))
                            ids.append(number), names.append(word), sizes.append(size), places.append(p), lengths.append(length)
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(names, pa.string()), *(pa.array(x, pa.int32()) for x in (sizes, places, lengths))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "word", "size", "p", "l"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    return words.mapInArrow(every, "key long, id long, word string, size int, p int, l int")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _near(words: list[str], i: np.ndarray, j: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart."""
    swap = lengths[i] > lengths[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    same = lengths[i] == lengths[j]
    differ = codes[i] != codes[j]
    shifted = np.zeros_like(differ)
    shifted[:, :-1] = codes[i][:, :-1] != codes[j][:, 1:]
    first = differ.argmax(1)
    at = np.arange(codes.shape[1])[None]
    good = np.where(same, differ.sum(1) == 1, ~(shifted & (at >= first[:, None]) & (at < lengths[i][:, None])).any(1) & (first < lengths[j]))
    for k in np.flatnonzero(np.maximum(lengths[i], lengths[j]) > WIDTH).tolist():
        good[k] = one_edit(words[i[k]], words[j[k]])
    return good


def _merge(keys: np.ndarray, ids: np.ndarray, words: list[str]) -> pa.RecordBatch:
    """Both directions of the near pairs among rows of one key (rows sorted by key)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = max(1, min(WIDTH, int(lengths.max(initial=1))))
    codes = np.array([w[:width] for w in words] or [""], f"U{width}").view(np.uint32).reshape(-1, width)
    if codes.max(initial=0) < 256:
        codes = codes.astype(np.uint8)
    letters = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        letters |= np.where(column > 0, np.uint64(1) << (column % 64).astype(np.uint64), np.uint64(0))
    long = lengths > WIDTH
    rows, shift, found, waiting, many = np.arange(len(keys)), 1, [np.zeros((0, 2), np.int64)], [], 0

    def check() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            hit = _near(words, x, y, codes, lengths)
            found.append(np.stack([ids[x[hit]], ids[y[hit]]], 1))
        waiting.clear()

    while len(rows := rows[rows + shift < len(keys)]) and len(rows := rows[keys[rows] == keys[rows + shift]]):
        other = rows + shift
        maybe = (np.bitwise_count(letters[rows] ^ letters[other]) <= 2) | long[rows] | long[other]
        i, j = rows[maybe], other[maybe]
        close = (np.abs(lengths[i] - lengths[j]) < 2) & (ids[i] != ids[j])
        waiting.append((i[close], j[close]))
        many += int(close.sum())
        if many >= 1 << 14:
            check()
            many = 0
        shift += 1
    if waiting:
        check()
    pairs = np.concatenate(found)
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["id", "other"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, ids, words = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for batch in batches:
        keys = np.concatenate([keys, batch["key"].to_numpy()])
        ids = np.concatenate([ids, batch["id"].to_numpy()])
        words += batch["word"].to_pylist()
        if len(keys) >= 1 << 16 and (cut := int(np.searchsorted(keys, keys[-1]))):
            yield _merge(keys[:cut], ids[:cut], words[:cut])
            keys, ids, words = keys[cut:], ids[cut:], words[cut:]
    if words:
        yield _merge(keys, ids, words)


def near_words(words: DataFrame, least: int = 7, list_rows: int = LIST_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Distinct words (id, word) of at least ``least`` >= 5 characters -> (id, other) of all words at one edit's distance, both ways."""
    if least < 2 * SHORTEST + 1:
        raise ValueError("an edit may change all grams of so short a word")
    some = [r["word"] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()]
    grams = words.sparkSession.sparkContext.broadcast(Grams(some))
    rows = written(_lists(words.select("id", "word").repartition("id"), grams, least), "gram-lists")
    hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > list_rows).select("key", F.lit(True).alias("_hot")), "hot-grams")
    if hot.isEmpty():
        dealt = rows.select("key", "id", "word")
    else:
        # the edit is outside the gram, so half of what surrounds it is whole
        marked = rows.join(hot, "key", "left")
        rest = F.concat(F.expr("substring(word, 1, p)"), F.expr("substring(word, p + l + 1)"))
        half = F.expr("(size - l) div 2").cast("int")
        sides = F.array(*(F.xxhash64("key", F.lit(k), part) for k, part in enumerate((F.substring(rest, F.lit(1), half), F.substring(rest, F.char_length(rest) - half + 1, half)))))
        dealt = marked.withColumn("key", F.explode(F.when(F.col("_hot"), sides).otherwise(F.array("key")))).select("key", "id", "word")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_merged, "id long, other long").repartition("id").dropDuplicates(["id", "other"])


def variant_groups(counts: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, list_rows: int = LIST_ROWS, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n) of ``least`` characters and ``times`` occurrences or more.

    Near words differ by exactly one inserted, deleted or replaced character. A word's form is its near word of largest n, ties to the
    smaller word, if that n is ``ratio`` times the word's or more, else null; its root is the end of the chain of forms, or the word.
    Null words and counts are left out; rows of one word are summed; other columns are ignored; an empty table gives no rows.
    """
    known = counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= times) & (F.char_length("word") >= least))
    # ids follow falling n, then the word, so that the least id of near words is the form
    words, _ = ranked(written(known, "variant-words").withColumn("_order", -F.col("n")), ["_order", "word"], "variant-words")
    words = written(words.select(F.col("rank").alias("id"), "word", "n"), "variant-words")
    near = near_words(words, least, list_rows, sample).groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("first"))
    forms = words.select(F.col("id").alias("first"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = words.join(near, "id", "left").join(forms, "first", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    found = found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(good, F.col(c)).alias(c) for c in ("first", "form", "form_n")))
    found = written(found, "variant-forms")
    at, left = written(found.filter("first is not null").select("id", F.col("first").alias("root")), "variant-roots"), True
    while left:  # twice as far along the chains in each round
        then = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = written(at.join(then, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_moved")), "variant-roots")
        left = not at.filter("_moved").isEmpty()
        at = at.drop("_moved")
    names = words.select(F.col("id").alias("root"), F.col("word").alias("_root"))
    rooted = found.join(at.join(names, "root").select("id", "_root"), "id", "left")
    return rooted.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
