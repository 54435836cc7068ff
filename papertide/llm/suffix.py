"""Removal of repeated strings with suffix arrays built by two-stage sorting.

A suffix array over the whole corpus would need one task to see everything, so candidates are
found first, without loss: every window of ``length`` bytes is assigned to the least hash among
its strings of ``gram_size(length)`` bytes (the leftmost if several are equal). Equal windows have equal
anchors, so only contexts (the windows of one anchor, as one string) with the same anchor hash need
comparing. Equal contexts repeat as a whole; different contexts of one anchor are sorted as a suffix
array, where neighbours with a common prefix of ``length`` bytes repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import HOT_ROWS, ragged_arange, split_join, written

#: Bytes hashed at once; longer texts are cut with an overlap of a window.
SLICE = 1 << 18
#: Shortest strings that can be looked for.
LEAST = 96
#: Contexts sorted in one place; anchors with more are dealt out and meet again by window hash.
GROUP_CONTEXTS = 256
#: Neighbouring windows of a dealt-out context that are looked up by what they have in common.
PROBE_WINDOWS = 17
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def gram_size(length: int) -> int:
    """Bytes of an anchor: the largest power of two that is at most a third of the window."""
    return 1 << (length // 3).bit_length() - 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes from each position, by doubling."""
    h, size, factor = _BYTE[data], 1, _MULTIPLIER
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    out, size = values, 1
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def anchor_contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows): all windows inside the texts
    [starts[i], ends[i]) of ``data``, each in the row of its anchor."""
    gram = gram_size(length)
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(data, gram)
    least = _sliding(h, width, np.minimum)
    ok = np.zeros(len(least) + 1, np.int8)
    long_enough = ends - starts >= length
    np.add.at(ok, starts[long_enough], 1)
    np.add.at(ok, ends[long_enough] - length + 1, -1)
    least[np.cumsum(ok[:-1]) == 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    text = np.searchsorted(starts, at, "right") - 1
    value = h[at]
    low = np.maximum(at - width + 1, starts[text])
    high = np.minimum(at, ends[text] - length)
    for side, beats in ((-1, np.less_equal), (1, np.less)):
        open_ = np.arange(len(at))
        step = 1
        while len(open_):
            other = open_ + side * step
            inside = (other >= 0) & (other < len(at))
            open_, other = open_[inside], other[inside]
            near = np.abs(at[other] - at[open_]) < width
            open_, other = open_[near], other[near]
            wins = beats(value[other], value[open_])
            won, by = open_[wins], at[other[wins]]
            if side < 0:
                low[won] = np.maximum(low[won], by + 1)
            else:
                high[won] = np.minimum(high[won], by - width)
            open_ = open_[~wins]
            step += 1
    keep = (low <= high) & (value > 0)
    return value[keep], low[keep], high[keep] - low[keep] + 1


def _slices(sizes: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of about SLICE bytes; windows of a cut text are in one slice each."""
    held, size = [], 0
    for i, n in enumerate(sizes.tolist()):
        for start in range(0, max(n - length + 1, 0), SLICE):
            stop = min(n, start + SLICE + length - 1)
            held.append((i, start, stop))
            size += stop - start
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = np.frombuffer(batch["text"].buffers()[1], np.int64 if pa.types.is_large_binary(batch["text"].type) else np.int32)
            offsets = offsets[batch["text"].offset :][: batch.num_rows + 1].astype(np.int64)
            if not batch.num_rows or not offsets[-1] - offsets[0]:
                continue
            every = np.frombuffer(batch["text"].buffers()[2], np.uint8)
            ids, keys = batch["id"].to_numpy(), batch["key"].to_numpy()
            for held in _slices(np.diff(offsets), length):
                text, start, stop = (np.array(x, np.int64) for x in zip(*held, strict=True))
                data = every[ragged_arange(offsets[text] + start, stop - start)] if len(held) > 1 else every[offsets[text[0]] + start[0] : offsets[text[0]] + stop[0]]
                ends = np.cumsum(stop - start)
                begins = ends - (stop - start)
                anchor, low, n = anchor_contexts(data, begins, ends, length)
                if not len(anchor):
                    continue
                raw = data.tobytes()
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + m]) for a, m in zip(low.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, len(low))
                part = np.searchsorted(begins, low, "right") - 1
                place = low - begins[part] + start[part]
                order = np.lexsort((place, ctx, anchor, text[part]))
                t, a, c, place, n = text[part][order], anchor[order], ctx[order], place[order], n[order]
                first = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[t[first]]), pa.array(keys[t[first]]), pa.array(a[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(n[first].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.r_[first, len(t)].astype(np.int32)), pa.array(place)),
                    ],
                    ["id", "key", "anchor", "ctx", "n", "at"],
                )

    return run


def two_stage_suffix_array(s: bytes, depth: int) -> list[int]:
    """Suffixes of ``s`` in order of their first ``depth`` bytes at least.

    Stage one sorts the suffixes that are smaller than their successor; stage two scans the buckets
    from the left and puts each remaining suffix behind the one it precedes.
    """
    n = len(s)
    smaller = bytearray(n)  # 1: smaller than its successor
    for i in range(n - 2, -1, -1):
        if s[i] < s[i + 1] or (s[i] == s[i + 1] and smaller[i + 1]):
            smaller[i] = 1
    sizes = np.bincount(np.frombuffer(s, np.uint8), minlength=256)
    bucket_end = np.cumsum(sizes).tolist()
    head = (np.cumsum(sizes) - sizes).tolist()
    order = [-1] * n
    tail = bucket_end[:]
    for i in sorted((i for i in range(n) if smaller[i]), key=lambda i: s[i : i + depth], reverse=True):
        tail[s[i]] -= 1
        order[tail[s[i]]] = i
    if n:
        order[head[s[n - 1]]] = n - 1
        head[s[n - 1]] += 1
    for i in order:
        if i > 0 and not smaller[i - 1]:
            order[head[s[i - 1]]] = i - 1
            head[s[i - 1]] += 1
    return order


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the class of each of its windows: windows that share their ``length`` bytes
    with another window of any of the contexts have the number of the class, others -1."""
    joined = b"".join(contexts)
    owner = np.repeat(np.arange(len(contexts)), [len(c) for c in contexts])
    ends = np.cumsum([len(c) for c in contexts])
    whole = (np.arange(len(joined)) + length <= ends[owner]).tolist()
    classes = np.full(len(joined), -1, np.int64)
    last = None
    for i in two_stage_suffix_array(joined, length):
        if whole[i]:
            if last is not None and joined[last : last + length] == joined[i : i + length]:
                if classes[last] < 0:
                    classes[last] = last
                classes[i] = classes[last]
            last = i
    return [classes[e - len(c) : e - length + 1] for c, e in zip(contexts, ends, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _probes(text: bytes, wanted: np.ndarray, length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For the wanted windows of a context: (hash of a probe, [(window, hash of the window)]).

    Equal windows lie at the same distance from their anchor, so windows are binned by that
    distance; the probe is what all windows of a bin have in common.
    """
    gram = gram_size(length)
    anchor = int(np.argmin(_gram_hashes(np.frombuffer(text, np.uint8), gram)[: length - gram + 1]))
    bins: dict[int, list[tuple[int, int]]] = {}
    for i in wanted.tolist():
        bins.setdefault((anchor - i) // PROBE_WINDOWS, []).append((i, xxhash.xxh3_64_intdigest(text[i : i + length]) - (1 << 63)))
    out = []
    for b, windows in bins.items():
        start = anchor - PROBE_WINDOWS * b
        core = text[start : start - PROBE_WINDOWS + 1 + length]
        out.append((xxhash.xxh3_64_intdigest(core, seed=b) - (1 << 63), windows))
    return out


def _sort_groups(length: int):
    """Contexts sorted by group -> flagged window runs; for dealt-out groups also, by probe, each window
    class: with its context where it is alone in its group, without one where it already repeats."""
    window = pa.struct([("at", pa.int32()), ("hash", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shared, held = None, False, {}

        def flush() -> pa.RecordBatch | None:
            out = []
            if len(held) > 1 or shared:
                seen: set[int] = set()
                for (anchor, ctx), text, classes in zip(list(held), held.values(), repeated_windows(list(held.values()), length), strict=True):
                    out += [(group, anchor, ctx, a, b, None, None) for a, b in _runs(classes >= 0)]
                    if shared:
                        new = [i for i, c in enumerate(classes.tolist()) if c >= 0 and c not in seen]
                        seen.update(classes[new].tolist())
                        for owner, wanted in ((ctx, np.flatnonzero(classes < 0)), (None, np.array(new, np.int64))):
                            out += [(group, anchor, owner, None, None, p, [{"at": i, "hash": h} for i, h in w]) for p, w in _probes(text, wanted, length)]
            held.clear()
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["group", "anchor", "ctx", "lo", "hi", "probe", "windows"])

        for batch in batches:
            for g, s, a, c, text in zip(*(batch[x].to_pylist() for x in ("group", "shared", "anchor", "ctx", "bytes")), strict=True):
                if g != group:
                    if (done := flush()) is not None:
                        yield done
                    group, shared = g, s
                held[a, c] = text
        if (done := flush()) is not None:
            yield done

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, wants in zip(batch["text"].to_pylist(), batch["wants"].to_pylist(), strict=True):
            out += [(w["anchor"], w["ctx"], text[w["at"] : w["at"] + w["size"]]) for w in wants]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["anchor", "ctx", "bytes"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["anchor", "ctx", "bytes"])


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns but the text), was_null (the text was), text (bytes), id, key (hash of the text)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), docs["text"].isNull().alias("was_null"), text.alias("text"), docs["doc_id"].cast("long").alias("id"))
    return rows.select("row", "was_null", F.col("text").cast("binary").alias("text"), F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("key"))


def repeated_ranges(docs: DataFrame, length: int = 400, group_contexts: int = GROUP_CONTEXTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, key, ranges (array of byte ranges ``[from, to)``, unmerged) of texts with a string of
    ``length`` bytes that starts at another place too. An anchor or context of more than ``hot_rows`` rows is split over several tasks."""
    if length < LEAST:
        raise ValueError(f"strings shorter than {LEAST} bytes have anchors too short to tell texts apart")
    texts = _keyed(docs).select("id", "key", "text")
    long_texts = texts.filter(F.length("text") >= length)
    placed = written(long_texts.mapInArrow(_contexts(length), "id long, key long, anchor long, ctx long, n int, at array<long>"), "contexts")
    kinds = placed.groupBy("anchor", "ctx").agg(F.sum(F.size("at")).alias("times"), F.min(F.struct("id", "key", F.col("at")[0].alias("at"), "n")).alias("one"), F.count("*").alias("rows"))
    kinds = written(kinds, "context-kinds")
    mixed = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed-anchors")
    per_anchor, n_kinds = mixed.withColumnRenamed("kinds", "n"), kinds.count()
    whole = kinds.filter("times > 1").select("anchor", "ctx", F.lit(0).alias("lo"), F.col("one.n").alias("hi"))

    wants = split_join(kinds, mixed, ["anchor"], per_anchor, hot_rows=hot_rows, total=n_kinds).select("anchor", "ctx", "kinds", "one.*")
    dealt = written(wants, "wanted-contexts")
    lists = dealt.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "ctx", "at", (F.col("n") + length - 1).alias("size"))).alias("wants"))
    cut = texts.join(lists.hint("shuffle_hash"), ["id", "key"]).select("text", "wants").mapInArrow(_cut_out, "anchor long, ctx long, bytes binary")
    groups = F.ceil(F.col("kinds") / group_contexts)
    sized = split_join(cut, mixed, ["anchor"], per_anchor, hot_rows=hot_rows, total=n_kinds).select(
        "anchor", "ctx", "bytes", (F.col("kinds") > group_contexts).alias("shared"),
        F.xxhash64("anchor", F.pmod("ctx", groups)).alias("group"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "group long, anchor long, ctx long, lo int, hi int, probe long, windows array<struct<at:int,hash:long>>"
    found = written(sized.repartition(parts, "group").sortWithinPartitions("group", "anchor").mapInArrow(_sort_groups(length), schema), "window-runs")
    probes = found.filter("probe is not null")
    several = probes.groupBy("anchor", "probe").agg(F.min("group").alias("g"), F.max("group").alias("h")).filter("g <> h").select("anchor", "probe")
    windows = probes.join(several, ["anchor", "probe"]).select("anchor", "ctx", F.inline("windows"))
    again = windows.groupBy("anchor", "hash").agg(F.count("*").alias("times")).filter("times > 1").select("anchor", "hash")
    met = windows.filter("ctx is not null").join(again, ["anchor", "hash"]).select("anchor", "ctx", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    runs = whole.union(found.filter("probe is null").select("anchor", "ctx", "lo", "hi")).union(met)
    runs = runs.groupBy("anchor", "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    at_each = lambda r: lambda a: F.struct((a + r["lo"]).alias("from"), (a + r["hi"] + length - 1).alias("to"))
    ranges = F.flatten(F.transform("runs", lambda r: F.transform("at", at_each(r))))
    per_context = kinds.filter("rows > 1").select("anchor", "ctx", F.col("rows").alias("n"))
    hit = split_join(placed, runs, ["anchor", "ctx"], per_context, hot_rows=hot_rows, total=placed.count()).select("id", "key", ranges.alias("ranges"))
    return hit.groupBy("id", "key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["from"], r["to"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
            runs = merged(ranges or [])
            at, parts = 0, []
            for a, b in runs:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join([*parts, text[at:]]) if runs else text)
            removed.append(len(text) - len(kept[-1]))
            spans.append(len(runs))
        cols = [batch["row"], batch["was_null"], batch["n_bytes"], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["row", "was_null", "n_bytes", "kept", "n_removed", "n_spans"])


def _cut_rows(docs: DataFrame, length: int, group_contexts: int) -> DataFrame:
    """row (all columns of ``docs`` but the text), was_null, n_bytes, kept (the remaining bytes), n_removed, n_spans."""
    ranges = repeated_ranges(docs, length, group_contexts)
    rows = _keyed(docs).join(ranges.hint("shuffle_hash"), ["id", "key"], "left").select("row", "was_null", F.length("text").cast("long").alias("n_bytes"), "text", "ranges")
    schema = f"row {dict(rows.dtypes)['row']}, was_null boolean, n_bytes long, kept binary, n_removed long, n_spans long"
    return rows.mapInArrow(_remove, schema)


def without_repeats(docs: DataFrame, length: int = 400, carry: list[str] | None = None, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """The columns ``carry`` (doc_id) of each row with n_bytes, kept (the remaining bytes), n_removed and n_spans.

    Every byte covered by a string of ``length`` bytes that starts anywhere else, in the same or
    another row, is removed; strings are judged on the input. Null texts are empty; texts shorter
    than ``length`` stay whole; repeated rows remove each other's bytes; null ids are fine; other columns
    may have any name; an empty table gives an empty one.
    """
    carry = carry or ["doc_id"]
    rows = _cut_rows(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])), length, group_contexts)
    return rows.select(*(F.col("row")[c].alias(c) for c in carry), "n_bytes", "kept", "n_removed", "n_spans")


def shortened(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with repeated strings removed from ``text`` and ``n_chars`` counted anew; a character
    that loses some of its bytes goes whole. Rows stay even if nothing is left of their text; null texts stay null,
    repeated rows lose their common text, other columns stay as they are, whatever their names; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode("utf-8", errors="ignore") for k in batch["kept"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["was_null"], pa.array(texts, pa.string())], ["row", "was_null", "left"])

    left = _cut_rows(docs, length, GROUP_CONTEXTS).select("row", "was_null", "kept")
    left = left.mapInArrow(run, f"row {dict(left.dtypes)['row']}, was_null boolean, left string")
    was_null = F.col("was_null")
    new = {"text": F.when(~was_null, F.col("left"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(was_null, F.col("row")["n_chars"]).otherwise(F.char_length("left")).cast(docs.schema["n_chars"].dataType)
    return left.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def kept_digest(kept: Column) -> Column:
    return F.sha2(kept, 256)
