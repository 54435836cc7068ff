import random
from collections import Counter

import pytest

from papertide.llm.suffix import repeated_windows, shortened, two_stage_suffix_array, without_repeats


def brute(texts, length):
    counts, out = Counter(), []
    for t in texts:
        b = (t or "").encode()
        counts.update(b[k : k + length] for k in range(len(b) - length + 1))
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), spans))
    return out


def corpus():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ijkl") for _ in range(n))
    shared, short = word(700), word(420)
    texts = [
        word(r.randint(0, 500)) + (shared[r.randint(0, 120) : 700 - r.randint(0, 120)] if r.random() < 0.6 else "") + word(r.randint(0, 300)) + (short if r.random() < 0.3 else "")
        for _ in range(40)
    ]
    return [*texts, "", None, "ab" * 900, "xyz " * 300, texts[3], "é" * 500, "ab" * 300, "\0" * 450]


@pytest.mark.parametrize("group", [256, 3, 1])
def test_removal_equals_brute_force(spark, group):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 kept", "2 id", "3 key", "'r' ranges")
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in without_repeats(docs, 400, None, group).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_two_stage_order():
    r = random.Random(2)
    for n in (0, 1, 2, 50, 300):
        s = bytes(r.choice(b"ab\0\xff") for _ in range(n))
        assert two_stage_suffix_array(s, n + 1) == sorted(range(n), key=lambda i: s[i:])


def test_window_classes():
    a, b = b"x" + b"0123456789" * 3, b"0123456789" * 3 + b"y"
    ca, cb = repeated_windows([a, b], 25)
    assert ca[1] == cb[0] >= 0 and ca[0] < 0 and cb[-1] < 0


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(9).choice("abcdef ") for _ in range(600))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "short")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in without_repeats(docs).collect()) == [0, 600, 600]
    left = shortened(docs.selectExpr("*", "'en' lang", "cast(0 as bigint) n_chars")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in left) == [("", 0), ("", 0), ("short", 5)]
    assert without_repeats(docs.limit(0)).count() == 0


def test_half_a_character_goes_whole(spark):
    same = "".join(random.Random(3).choice("abcdef ") for _ in range(399))
    docs = spark.createDataFrame([(1, "1é" + same + "A"), (2, "2ã" + same + "B")], "doc_id long, text string")  # é and ã differ in both bytes
    assert {r["text"] for r in shortened(docs, 399).collect()} == {"1éA", "2ãB"}
