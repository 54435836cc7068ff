import random
from collections import Counter

import numpy as np
import pytest

from papertide.llm.decontaminate import clean_documents, contaminated, weighted_similarity, words_of
from papertide.llm.unigram import Encoder, Vocabulary, _segment_equal, _segment_one, decode, decode_column, encode_column

P = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello  world\nagain ", "", "日本語 and 🙂 mixed\ttabs", "a", " ", "   lead", "x" * 5000, "plain words here " * 2000, "\x00\x01"]


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary.load(P.path("piece_bpe_32k.model"))


def best_score(text, vocab):
    """Plain Viterbi over the whole text."""
    pieces = {p.replace(b" ", "▁".encode()).decode(): s for p, s, b in zip(vocab.surface, vocab.scores, range(len(vocab.surface)), strict=True) if b > 258}
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-1e300] * len(text)
    for i in range(len(text)):
        if text[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + vocab.unknown_score)
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if text[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[text[i:j]])
    return best[-1]


def test_segmentation_is_the_best(vocab):
    for text in ("Hello world again", "internationalisation of the quick brown fox", "a  b", "日本語 🙂 x"):
        ids, _ = Encoder(vocab).encode([text])
        unknown = sum(1 for c in "▁" + text.replace(" ", "▁") if c.encode() not in {s.replace(b" ", "▁".encode()) for s in vocab.surface})
        own = sum(vocab.scores[i] for i in ids if i > 258) + unknown * vocab.unknown_score
        assert own == pytest.approx(best_score(text, vocab))


def test_one_chunk_alone_is_cut_alike(vocab):
    r = random.Random(6)
    chunks = [(" " + "".join(r.choice(["the", "q", "é", "日", "🙂", "ing", "\x01", "7"]) for _ in range(r.randint(1, 9)))).encode() for _ in range(300)] + [b"\xe6\x97"]
    for c in chunks:
        flat, counts = _segment_equal(np.frombuffer(c, np.uint8).astype(np.int32)[None], vocab)
        assert _segment_one(c, vocab) == flat.tolist() and counts.tolist() == [len(flat)]


def test_long_run_without_blanks(vocab):
    text = "".join(random.Random(2).choice("abcdefgh漢字") for _ in range(200_000))
    ids, counts = Encoder(vocab).encode([text, "x"])
    assert counts.sum() == len(ids) and decode_all(ids, counts, vocab) == [text, "x"]


def decode_all(ids, counts, vocab):
    sizes = np.array([len(x) for x in vocab.surface])
    return [t.removeprefix(" ") for t in decode(ids, counts, np.frombuffer(b"".join(vocab.surface), np.uint8), np.cumsum(sizes) - sizes, sizes)]


def test_library_gives_the_same_score(vocab):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        piece.score = float(vocab.scores[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    r = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(r.choice(["the", "ing", "er", "qu", "z", "an", "é"]) for _ in range(r.randint(1, 5))) for _ in range(12))
        mine, theirs = Encoder(vocab).encode([text])[0].tolist(), library.encode(text)
        assert mine == theirs or vocab.scores[mine].sum() == pytest.approx(vocab.scores[theirs].sum())


def test_round_trip(spark, vocab):
    docs = spark.createDataFrame([*enumerate(TEXTS), (50, None), (None, "a"), (0, TEXTS[0])], "doc_id long, text string")
    back = decode_column(encode_column(docs, vocab), vocab).collect()
    assert len(back) == len(TEXTS) + 3 and all(r["decoded"] == (r["text"] or "") for r in back)
    assert [len(r["piece_ids"]) for r in back if not r["text"]] == [0, 0]
    assert encode_column(docs.limit(0), vocab).count() == 0
    twice = encode_column(docs.selectExpr("*", "1 piece_ids", "2 PIECE_IDS_in"), vocab)
    assert [f.name for f in twice.schema][2:] == ["piece_ids_in", "PIECE_IDS_in_in", "piece_ids"] and twice.first()["piece_ids_in"] == 1


def test_broken_bytes_are_replaced(vocab):
    sizes = np.array([len(x) for x in vocab.surface])
    ids = np.array([vocab.byte_ids[0xC3], vocab.byte_ids[0x28]])
    assert decode(ids, np.array([2]), np.frombuffer(b"".join(vocab.surface), np.uint8), np.cumsum(sizes) - sizes, sizes) == ["�("]


def brute(docs, items, least):
    out, worded = set(), [(i, words_of(t)) for i, t in items]
    for d, t in docs:
        w = words_of(t)
        for i, v in worded:
            if not w or not v:
                continue
            size = min(5, len(v))
            shingles = lambda x: [tuple(x[k : k + size]) for k in range(max(1, len(x) - size + 1))]  # noqa: E731, B023
            h, c = shingles(w), Counter(shingles(v))
            width = max(1, min(len(v), len(w)) - size + 1)
            if not c.keys() & set(h):
                continue
            if any(weighted_similarity(Counter(h[k : k + width]), c) >= least for k in range(len(h) - width + 1)):
                out.add((d, i))
    return out


def test_items_are_found(spark):
    r = random.Random(7)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randint(15, 60))) for i in range(40)] + [(90, "ab"), (91, ""), (92, None), (93, "one two three"), (0, "again " * 30)]
    docs = []
    for i in range(120):
        words = items[i % 40][1].split()
        for _ in range(i // 40 * 2):
            words[r.randrange(len(words))] = r.choice(pool)
        docs.append((i, text(r.randint(0, 80)) + " " + " ".join(words).upper() + ". " + text(r.randint(0, 50))))
    docs += [(500, None), (501, ""), (502, "one two, three"), (504, "so one two three it is"), (503, text(3000)), (503, "again again " * 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id", "2 bits")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(d, b).collect()}
    by_row = brute([(k, t) for k, (_, t) in enumerate(docs)], items, 0.8)
    want = {(docs[k][0], i) for k, i in by_row}
    assert got == want and len(want) > 40
    kept = sorted(x["doc_id"] for x in clean_documents(d, b).collect())
    dirty = {k for k, _ in by_row}
    assert kept == sorted(i for k, (i, _) in enumerate(docs) if k not in dirty)
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
