"""Subword encoding and decoding with a unigram model.

The pieces and their scores come from a SentencePiece model file; the best segmentation is found by
Viterbi over a double-array trie. Texts are cut into chunks no piece can cross (a run of white-space
markers opens a chunk), each distinct chunk is segmented once, all chunks of one length side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from papertide.llm.common import ragged_arange

MARK = "▁"
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of text segmented together, chunks remembered by a task.
SLICE, REMEMBERED = 1 << 20, 150_000


@dataclass
class DoubleArray:
    """Trie over bytes: the child of state s by byte c is t = base[s] + c + 1 if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = number
        size = 2 * len(children) + 1024
        base, check, out = (np.full(size, x, np.int32) for x in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0] = True
        out[0] = value[0]
        tried = [1] * 257  # by number of children: no state below has room for so many
        queue = [(0, 0)]
        for node, state in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            codes = np.array(kids) + 1
            start, look = tried[len(kids)], 4096
            while True:
                while start + look + 300 > len(used):
                    base, check, out = (np.concatenate([x, np.full(size, y, np.int32)]) for x, y in ((base, 0), (check, -1), (out, -1)))
                    used = np.concatenate([used, np.zeros(size, bool)])
                room = np.flatnonzero(~used[start : start + look]) + start - codes[0]
                room = room[room >= 0]
                room = room[~used[room[:, None] + codes].any(1)]
                if len(room):
                    break
                start += look
            tried[len(kids)] = int(room[0] + codes[0])
            at = int(room[0])
            base[state] = at
            used[at + codes] = True
            check[at + codes] = state
            for c in kids:
                out[at + c + 1] = value[children[node][c]]
                queue.append((children[node][c], at + c + 1))
        last = int(np.flatnonzero(used)[-1]) + 300
        return cls(base[:last], check[:last], out[:last])


@dataclass
class Vocabulary:
    """Pieces of a model file; bounded by the file, so it is sent to the executors as it is."""

    trie: DoubleArray
    scores: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    cuts_lines: bool
    cuts_words: bool

    @classmethod
    def load(cls, path: str, scores: str = "auto") -> Vocabulary:
        """Pieces of a model file. ``scores``: ``file`` takes the stored ones as log probabilities;
        ``rank`` takes their order, with the log probability of that rank under Zipf's law. ``auto``
        is ``rank`` where the file stores whole numbers, as files of merge ranks do."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: list[tuple[str, float, str]] = []
        for i in range(model.get_piece_size()):
            kind = "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "none" if model.is_control(i) or model.is_unused(i) else "piece"
            pieces.append((model.id_to_piece(i), model.get_score(i), kind))
        normal = [i for i, p in enumerate(pieces) if p[2] == "piece"]
        if scores == "rank" or (scores == "auto" and all(float(pieces[i][1]).is_integer() for i in normal)):
            total = float(np.sum(1 / np.arange(1, len(normal) + 1)))
            for rank, i in enumerate(sorted(normal, key=lambda i: (-pieces[i][1], i)), 1):
                pieces[i] = (pieces[i][0], -float(np.log(rank * total)), "piece")
        return cls.of(pieces)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> Vocabulary:
        """From (piece, log score, kind): piece, byte (<0xNN>), unknown or none (never produced)."""
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        unknown = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        byte_ids = np.full(256, unknown, np.int32)
        surface = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_ids[int(p[3:5], 16)] = i
            surface.append({"piece": p.replace(MARK, " ").encode(), "byte": bytes([int(p[3:5], 16)]) if kind == "byte" else b"", "unknown": " ⁇ ".encode(), "none": b""}[kind])
        long_ones = [p for p, _, kind in pieces if kind == "piece" and len(p) > 1]
        scores = np.array([s for _, s, _ in pieces], float)
        worst = min((s for _, s, kind in pieces if kind == "piece"), default=0.0)
        return cls(
            DoubleArray.build(normal), scores, surface, byte_ids, unknown, worst - UNKNOWN_PENALTY,
            not any("\n" in p for p in long_ones), not any(MARK in p.lstrip(MARK) for p in long_ones),
        )

    def lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        """Base, check and value of the trie, and the scores, as plain lists made once a process."""
        if not hasattr(self, "_lists"):
            self._lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist())
        return self._lists

    def chunks(self, text: str) -> list[str]:
        """The text with a leading marker, cut where no piece can cross; blanks stand for markers."""
        text = " " + text.replace(MARK, " ") if text else ""
        if not self.cuts_words:
            return [text] if text else []
        return re.findall(" *[^ \n]+| +|\n" if self.cuts_lines else " *[^ ]+| +", text)


def _segment_equal(cells: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best piece ids of chunks of one byte length (rows of ``cells``), flat, and their counts."""
    m, n = cells.shape
    trie, scores = vocab.trie, vocab.scores
    best = np.full((m, n + 1), -np.inf)
    best[:, 0] = 0
    back_id = np.full((m, n + 1), -1, np.int32)
    back_len = np.zeros((m, n + 1), np.int32)
    for i in range(n):
        rows = np.flatnonzero(best[:, i] > -np.inf)
        lead = cells[rows, i]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        width = np.minimum(width, n - i)
        single = np.zeros(m, bool)
        char = np.zeros(m, np.int64)
        char[rows] = width
        act, state = rows, np.zeros(len(rows), np.int64)
        for j in range(i, n):
            to = trie.base[state] + cells[act, j] + 1
            ok = trie.check[to] == state
            act, state = act[ok], to[ok]
            if not len(act):
                break
            ids = trie.value[state]
            has = ids >= 0
            r, ids = act[has], ids[has]
            single[r[char[r] == j + 1 - i]] = True
            cand = best[r, i] + scores[ids]
            up = cand > best[r, j + 1]
            r = r[up]
            best[r, j + 1], back_id[r, j + 1], back_len[r, j + 1] = cand[up], ids[up], j + 1 - i
        r = rows[~single[rows]]
        if len(r):
            end = i + char[r]
            cand = best[r, i] + vocab.unknown_score
            up = cand > best[r, end]
            r, end = r[up], end[up]
            best[r, end] = cand[up]
            for j in range(4):
                inside = char[r] > j
                q = r[inside]
                if not len(q):
                    break
                back_id[q, i + j + 1], back_len[q, i + j + 1] = vocab.byte_ids[cells[q, i + j]], 1
    at = np.full(m, n)
    steps = []
    rows = np.arange(m)
    while len(rows):
        p = at[rows]
        steps.append((rows, back_id[rows, p]))
        at[rows] = p - back_len[rows, p]
        rows = rows[at[rows] > 0]
    counts = np.zeros(m, np.int64)
    for r, _ in steps:
        counts[r] += 1
    ends = np.cumsum(counts)
    flat = np.empty(int(ends[-1]) if m else 0, np.int32)
    for s, (r, ids) in enumerate(steps):
        flat[ends[r] - 1 - s] = ids
    return flat, counts


#: Chunks of one length up to which each goes alone: one long run without blanks would pay numpy's cost for every byte.
FEW = 12


def _segment_one(chunk: bytes, vocab: Vocabulary) -> list[int]:
    """Best piece ids of one chunk, by the same steps as ``_segment_equal``."""
    base, check, value, scores = vocab.lists()
    n, unset = len(chunk), float("-inf")
    best, back_id, back_len = [unset] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == unset:
            continue
        lead = chunk[i]
        end = min(n, i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4))
        state, j, single = 0, i, False
        while j < n:
            to = base[state] + chunk[j] + 1
            if check[to] != state:
                break
            state = to
            j += 1
            found = value[state]
            if found >= 0:
                single = single or j == end
                score = here + scores[found]
                if score > best[j]:
                    best[j], back_id[j], back_len[j] = score, found, j - i
        if not single and here + vocab.unknown_score > best[end]:
            best[end] = here + vocab.unknown_score
            for j in range(i, end):
                back_id[j + 1], back_len[j + 1] = int(vocab.byte_ids[chunk[j]]), 1
    ids, at = [], n
    while at > 0:
        ids.append(back_id[at])
        at -= back_len[at]
    return ids[::-1]


def segment(chunks: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids and their number for each chunk, in order."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    data = np.frombuffer(b"".join(chunks), np.uint8).astype(np.int32)
    at = np.cumsum(sizes) - sizes
    counts = np.zeros(len(chunks), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        if len(own) <= FEW:
            for i in own.tolist():
                flat = np.array(_segment_one(chunks[i], vocab), np.int32)
                counts[i] = len(flat)
                parts.append((own[own == i], flat))
            continue
        step = max(1, (1 << 20) // int(n))
        for k in range(0, len(own), step):
            rows = own[k : k + step]
            flat, c = _segment_equal(data[at[rows][:, None] + np.arange(n)], vocab)
            counts[rows] = c
            parts.append((rows, flat))
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(chunks) else 0, np.int32)
    for rows, flat in parts:
        out[ragged_arange((ends - counts)[rows], counts[rows])] = flat
    return out, counts


class Encoder:
    """Encodes texts and remembers the pieces of the chunks it has seen."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids and their number for each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [self.vocab.chunks(t) for t in texts]
        words = [w for c in cut for w in c]
        new = list({w: None for w in words if w not in self.known})
        if new:
            flat, counts = segment([w.replace(" ", MARK).encode() for w in new], self.vocab)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(self.counts) - self.counts
        sizes = self.counts[code]
        ids = self.flat[ragged_arange(starts[code], sizes)]
        in_text = np.fromiter(map(len, cut), np.int64, len(cut))
        totals = np.r_[0, np.cumsum(sizes)]
        edge = np.r_[0, np.cumsum(in_text)]
        return ids, np.diff(totals[edge])


def decode(ids: np.ndarray, counts: np.ndarray, surface: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Texts of flat ids: surfaces joined, broken UTF-8 replaced, the leading blank dropped."""
    lengths = sizes[ids]
    data = surface[ragged_arange(at[ids], lengths)].tobytes()
    edge = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]].tolist()
    out = []
    for a, b in zip(edge, edge[1:], strict=False):
        text = data[a:b].decode("utf-8", errors="replace")
        out.append(text[1:] if text[:1] == " " else text)
    return out


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def without_clash(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column called ``name``, in any case, renamed by an added ``_in``."""
    for c in df.columns:
        if c.lower() == name.lower():
            return without_clash(df, c + "_in").withColumnRenamed(c, c + "_in")
    return df


def encode_column(df: DataFrame, vocab: Vocabulary, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """Adds the piece ids of a text column; null and empty texts have none. Other columns and
    repeated rows stay as they are; a literal marker character counts as a blank; a column that is already named ``to``
    stays as ``to`` with ``_in`` added; an empty table gives an empty one."""
    df = without_clash(df, to)
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch[text].cast(pa.large_string()).fill_null("")
            for part in _parts(batch, np.array(pc.binary_length(column).to_numpy(zero_copy_only=False)), SLICE):
                ids, counts = encoder.encode([t or "" for t in part[text].to_pylist()])
                held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, held], [*part.schema.names, to])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{to}` array<int>")


def decode_column(df: DataFrame, vocab: Vocabulary, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """Adds the text of a column of piece ids; null ids give an empty text. A column that is already named ``to`` stays as
    ``to`` with ``_in`` added; an empty table gives an empty one."""
    df = without_clash(df, to)
    shared = df.sparkSession.sparkContext.broadcast(vocab.surface)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        sizes = np.array([len(x) for x in pieces], np.int64)
        surface, at = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            counts = np.array(pc.list_value_length(batch[ids]).fill_null(0).to_numpy(zero_copy_only=False))
            for part in _parts(batch, counts, SLICE // 2):
                n = np.array(pc.list_value_length(part[ids]).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = decode(part[ids].flatten().to_numpy(zero_copy_only=False), n, surface, at, sizes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, to])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{to}` string")
