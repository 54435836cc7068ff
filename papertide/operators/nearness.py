"""Texts against texts: which pairs share most of their characters, at any length and without loss.

Pairs meet in cells of texts of about one length. Inside a cell runs of characters that a near pair must share are looked up by hash,
pairs that meet go through bounds of their places and letters, and what is left is matched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this length of the known text on, ``SequenceMatcher`` starts no match at characters that are more than one in a hundred, except where both texts begin.
FREQUENT_FROM = 200
#: Characters of a side that a cell holds, and of asked texts that are compared at once; pairs that are looked at together.
CELL, SLICE, PAIRS = 16_000_000, 200_000, 1_000_000

#: Lengths of runs that are looked for in long texts.
_RUNS = np.array([*range(1, 9), *(int(10 * 1.25**k) for k in range(70))])


def run_ratio(x: str, y: str) -> float | None:
    """Share of matching characters where one text is the other with a run of characters put in: all of the shorter one matches. Null else."""
    short, long = sorted((x, y), key=len)
    same = next((i for i, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    return 2 * len(short) / len(x + y) if short[same:] == long[len(long) - len(short) + same :] else None


def _longest(n, ratio: float):
    return np.floor(n * ((2 - ratio) / ratio) + 1e-9)


class _Texts:
    """Texts end to end, with hashes of all runs of a length. Two runs of one hash may differ; what is found by hash is compared later."""

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        self.place = np.arange(len(self.codes)) - self.start[self.owner]
        with np.errstate(over="ignore"):
            mixed = (self.codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            base = 0xD6E8FEB86659FD93
            power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(mixed), x, np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(31))) * power(base)[:-1])])
            self.back = power(pow(base, -1, 1 << 64))

    def runs(self, at: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[at + size] - self.sums[at]) * self.back[at]
            return h ^ (h >> np.uint64(29))

    def letters(self) -> np.ndarray:
        """How often each character code (modulo 64) stands in a text."""
        counts = np.bincount(self.owner * 64 + (self.codes & 63), minlength=64 * len(self.size)).reshape(-1, 64)
        return counts.astype(np.int16 if self.size.max(initial=0) < 30_000 else np.int32)

    def blocks(self, by_frequency: bool, least: int) -> np.ndarray:
        """Most blocks of matching characters that the matcher finds in a (known) text, by the text alone. From ``FREQUENT_FROM`` on it starts none at a frequent character, but for what both
        texts begin with; short texts have no such bound."""
        out = np.full(len(self.size), 1 << 40)
        for i in np.flatnonzero(self.size >= FREQUENT_FROM).tolist() if by_frequency else []:
            counts = np.unique(self.codes[self.start[i] : self.start[i] + self.size[i]], return_counts=True)[1]
            out[i] = max(least, int(counts[counts <= self.size[i] // 100 + 1].sum()) + 1)
        return out

    def shared_runs(self, ratio: float, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """size, text and start of runs of these (known) texts, of which each near text holds one of its partner's at least.

        Short texts are cut into one piece more than the characters that may be left out or put in. In long ones the longest block of
        matching characters has its share of all that must match; blocks are one more than the characters that do not match at most, and not more than ``blocks``.
        A block of n characters holds one of the runs that start at every step.
        """
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        put = lambda size, text, start: found.setdefault(int(size), []).append((text, start))
        for n in np.unique(self.size[self.size < FREQUENT_FROM]).tolist():
            text = np.flatnonzero(self.size == n)
            k = int((1 - ratio) * (n + _longest(n, ratio)) + 1e-9) + 1
            cuts = np.arange(k + 1) * n // k
            for size in np.unique(np.diff(cuts)).tolist():
                at = cuts[:-1][np.diff(cuts) == size]
                put(size, np.repeat(text, len(at)), np.tile(at, len(text)))
        for i in np.flatnonzero(self.size >= FREQUENT_FROM).tolist():
            n = int(self.size[i])
            both = n + np.ceil(n * ratio / (2 - ratio) - 1e-9)
            length = max(1, np.ceil(ratio * both / 2 / min((1 - ratio) * both + 1, blocks[i]) - 1e-9))
            run = int(_RUNS[np.searchsorted(_RUNS, length, "right") - 1])
            step = max(1, run // 4)
            at = np.arange(0, n - (run - step + 1) + 1, step)
            put(run - step + 1, np.full(len(at), i), at)
        for size, parts in found.items():
            yield size, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def share_enough(self, i: int, other: _Texts, j: int, ratio: float, blocks: int) -> bool:
        """Whether two texts have as many equal runs of half a block's mean length as they must if all that must match lies in ``blocks`` at most: each holds all but its last ones."""
        both = int(self.size[i] + other.size[j])
        blocks = min(int((1 - ratio) * both + 1e-9) + 1, blocks)
        size = max(1, int(ratio * both / 2 / blocks / 2))
        (x, m), (y, n) = (np.unique(t.runs(np.arange(t.start[k], t.start[k] + t.size[k] - size + 1), size), return_counts=True) for t, k in ((self, i), (other, j)))
        at = np.searchsorted(y, x)
        same = at < len(y)
        same[same] = y[at[same]] == x[same]
        return np.minimum(m[same], n[at[same]]).sum() >= ratio * both / 2 - 1e-9 - (size - 1) * blocks


class _Known:
    def __init__(self, texts: list[str], ids: np.ndarray, ratio: float, by_frequency: bool, least_blocks: int) -> None:
        self.texts, self.ids, self.size = texts, ids, np.array([len(t) for t in texts], np.int64)
        letters, blocks, runs = [], [], {}
        for lo, hi in _slices(self.size):
            part = _Texts(texts[lo:hi])
            letters.append(part.letters().astype(np.int32))
            blocks.append(part.blocks(by_frequency, least_blocks))
            for size, text, start in part.shared_runs(ratio, blocks[-1]):
                runs.setdefault(size, []).append((part.runs(part.start[text] + start, size), (text + lo).astype(np.int32), start.astype(np.int32)))
        self.letters, self.blocks = np.concatenate(letters), np.concatenate(blocks)
        self.runs = {}
        for size, parts in runs.items():
            h, text, start = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(h)
            seen = np.zeros(1 << 22, bool)
            seen[(h >> np.uint64(42)).astype(np.int64)] = True
            self.runs[size] = h[order], text[order], start[order], seen


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours of ``SLICE`` characters or little more."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


def _candidates(part: _Texts, ids: np.ndarray, known: _Known, ratio: float, earlier: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of asked and known texts that share a run at places where a near pair may, letters enough and, long ones, runs enough."""
    met = [np.zeros(0, np.int64)]
    for size, (hashes, texts, starts, seen) in known.runs.items():
        at = np.flatnonzero(part.place + size <= part.size[part.owner])
        h = part.runs(at, size)
        some = seen[(h >> np.uint64(42)).astype(np.int64)]
        at, h = at[some], h[some]
        first = np.searchsorted(hashes, h)
        n = np.searchsorted(hashes, h, "right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
            one = np.searchsorted(ends, pair, "right")
            entry = first[one] + pair - (ends[one] - n[one])
            x, y = part.owner[at[one]], texts[entry].astype(np.int64)
            a, b, shift = part.size[x], known.size[y], part.place[at[one]] - starts[entry]
            d = np.floor((a + b) * (1 - ratio) + 1e-9)
            fits = (2 * np.minimum(a, b) >= ratio * (a + b) - 1e-9) & (2 * shift <= d + (a - b)) & (2 * shift >= (a - b) - d)
            if earlier:
                fits &= known.ids[y] < ids[x]
            met.append(np.unique(y[fits] * len(part.size) + x[fits]))
            if len(met) > 8:
                met = [np.unique(np.concatenate(met))]
    y, x = np.divmod(np.unique(np.concatenate(met)), len(part.size))  # by known text
    letters, enough = part.letters(), np.zeros(len(x), bool)
    for lo in range(0, len(x), PAIRS // 8):
        i, j = x[lo : lo + PAIRS // 8], y[lo : lo + PAIRS // 8]
        enough[lo : lo + PAIRS // 8] = 2 * np.minimum(letters[i], known.letters[j]).sum(1) >= ratio * (part.size[i] + known.size[j]) - 1e-9
    last, text = -1, part
    for k in np.flatnonzero(enough & (known.size[y] >= FREQUENT_FROM)).tolist():
        if y[k] != last:
            last, text = y[k], _Texts([known.texts[y[k]]])
        enough[k] = part.share_enough(int(x[k]), text, 0, ratio, int(known.blocks[y[k]]))
    return x[enough], y[enough]


def _meet(asked: pa.Table, known: pa.Table, ratio: float, by_frequency: bool, least_blocks: int, earlier: bool) -> pa.Table:
    """The pairs of a cell that may be near."""
    out = {c: [] for c in ("asked", "known", "x", "y")}
    if asked.num_rows and known.num_rows:
        held = _Known(known["text"].to_pylist(), np.array(known["id"].to_pylist(), np.int64), ratio, by_frequency, least_blocks)
        ids, sizes = np.array(asked["id"].to_pylist(), np.int64), np.array(asked["n"].to_pylist(), np.int64)
        for lo, hi in _slices(sizes):
            texts = asked["text"].slice(lo, hi - lo).to_pylist()
            x, y = _candidates(_Texts(texts), ids[lo:hi], held, ratio, earlier)
            for c, values in zip(out, (ids[lo + x].tolist(), held.ids[y].tolist(), [texts[i] for i in x.tolist()], [held.texts[j] for j in y.tolist()]), strict=True):
                out[c] += values
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.large_string(), pa.large_string()), strict=True)], list(out)).cast(_MET)


_MET = pa.schema([("asked", pa.int64()), ("known", pa.int64()), ("x", pa.string()), ("y", pa.string())])


def _match(batches: Iterator[pa.RecordBatch], ratio: float, both_ways: bool, runs: bool) -> Iterator[pa.RecordBatch]:
    """The pairs that are near, with their ratio in place of the texts' numbers."""
    for batch in batches:
        x, y = batch["x"].to_pylist(), batch["y"].to_pylist()
        matcher, kept, ratios = SequenceMatcher(None), [], []
        for k in sorted(range(len(y)), key=y.__getitem__):
            if x[k] == y[k]:
                continue
            r = run_ratio(x[k], y[k]) if runs else None
            if r is None:
                if y[k] != matcher.b:
                    matcher.set_seq2(y[k])  # what is known of it is kept from pair to pair
                matcher.set_seq1(x[k])
                r = matcher.ratio()
            if both_ways and r < ratio:
                r = SequenceMatcher(None, y[k], x[k]).ratio()
            if r >= ratio:
                kept.append(k)
                ratios.append(r)
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ratios, pa.float64())], [*_MET.names, "ratio"])


def _bounds(shortest: int) -> list[int]:
    """Least lengths of the classes of known texts."""
    out = [max(1, shortest)]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 4, out[-1] * 9 // 8))
    return sorted({*out, FREQUENT_FROM} if shortest < FREQUENT_FROM else out)


def near_texts(asked: DataFrame, known: DataFrame, ratio: float, shortest: int, both_ways: bool = False, runs: bool = False, earlier: bool = False, with_texts: bool = False) -> DataFrame:
    """asked, known, ratio of all pairs of unequal texts (``asked`` and ``known`` have id, text) of ``shortest`` characters or more, however long, whose share of matching characters is ``ratio`` or more.

    The share is that of ``SequenceMatcher(None, asked, known)``; with ``both_ways`` that in the other order counts as well, with ``runs`` all of the shorter text matches where the other is the same with a
    run of characters put in. ``earlier`` asks only for known texts of lesser id. Pairs are given by their ids, or by their texts.

    Known texts lie in classes of about one length, an asked text goes to all classes of its partners. Classes of more than ``CELL`` characters are split, and each part of
    one side meets each of the other, so what a task holds does not grow with the input. Only texts, and pairs that pass all bounds, are shuffled; runs and pairs that share one stay in the task.
    """
    bounds, n = _bounds(shortest), F.char_length("text").cast("long")
    of = lambda size: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= size)) - 1
    # new columns for each side, as both may come from one table
    sized = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("text").alias("text"), n.alias("n")).filter(F.col("n") >= shortest)
    least, most = F.ceil(F.col("n") * F.lit(ratio / (2 - ratio)) - 1e-9), F.floor(F.col("n") * F.lit((2 - ratio) / ratio) + 1e-9)
    left = sized(asked).withColumn("class", F.explode(F.sequence(F.greatest(of(least), F.lit(0)), of(most))))
    right = sized(known).withColumn("class", of(F.col("n")))
    # a row for each class, of which there are less than two hundred
    share = lambda df: {r["class"]: -(-r["c"] // CELL) for r in df.groupBy("class").agg(F.sum("n").alias("c")).collect()}
    parts_right = share(right)
    parts_left = {c: k for c, k in share(left.select("class", "n")).items() if c in parts_right}
    first, cells = {}, 0
    for c in sorted(parts_left):
        first[c] = cells
        cells += parts_left[c] * parts_right[c]
    kind = "string" if with_texts else "long"
    if not cells:
        return asked.sparkSession.createDataFrame([], f"asked {kind}, known {kind}, ratio double")
    table = lambda d: F.create_map(*(F.lit(x) for c in first for x in (c, d[c])))[F.col("class")]
    own, other, base = F.col("_own"), F.col("_other"), F.col("_base")

    def dealt(df: DataFrame, mine: dict[int, int], others: dict[int, int], cell: Callable[[Column], Column]) -> DataFrame:
        rows = df.filter(F.col("class").isin(*first)).withColumns({"_base": table(first), "_own": F.pmod(F.xxhash64("text"), table(mine)), "_other": F.explode(F.sequence(F.lit(0), table(others) - 1)), "_right": table(parts_right)})
        return rows.select(cell(F.col("_right")).cast("long").alias("cell"), "id", "text", "n").repartition(2 * cells, "cell")

    left = dealt(left, parts_left, parts_right, lambda k: base + own * k + other)
    right = dealt(right, parts_right, parts_left, lambda k: base + other * k + own)
    meet = lambda x, y: _meet(x, y, ratio, not both_ways, 2 if runs else 1, earlier)
    met = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, "asked long, known long, x string, y string")
    # few pairs are left, of which a long one takes seconds: they are dealt anew
    near = met.repartition(2 * cells, "asked", "known", "x", "y").mapInArrow(lambda it: _match(it, ratio, both_ways, runs), "asked long, known long, x string, y string, ratio double")
    return near.select(F.col("x").alias("asked"), F.col("y").alias("known"), "ratio") if with_texts else near.select("asked", "known", "ratio")
