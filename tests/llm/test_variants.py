import random
import re
import zlib
from collections import Counter

import pytest

from papertide.llm import variants
from papertide.llm.variants import Grams, marked_words, near_words, one_edit, variant_groups


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_counts(rows, least=7, every=31):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= least:
                found[w] += 1
    return found


def brute_groups(counts, times=2, ratio=10):
    counts = {w: n for w, n in counts.items() if n >= times}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def edited(r, w, letters="abcdeéþ"):
    k, c = r.randrange(len(w) + 1), r.choice(letters)
    return r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])


def vocabulary(n, seed, letters="abcé", least=7):
    r = random.Random(seed)
    syllables = ["".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(12)]
    words = {"".join(r.choice(syllables) for _ in range(r.randrange(3, 9)))[:30] for _ in range(n)}
    words |= {"a" * k for k in range(7, 60, 3)} | {"ab" * k for k in range(4, 40, 5)} | {"a" * 200, "a" * 201, "a" * 100 + "b" + "a" * 100}
    for _ in range(2):
        words |= {edited(r, w) for w in sorted(words)}
    return sorted(w for w in words if len(w) >= least)


@pytest.mark.parametrize("frequent,most", [(0, 10**6), (3, 10**6), (20, 400), (10**9, 10**6)])
def test_rarest_grams_meet_across_any_edit(frequent, most):
    """Every near pair shares one of the listed grams, at the same place or one further."""
    r = random.Random(frequent)
    words = vocabulary(150, 3)
    grams = Grams(words[::3], frequent, most)
    for w in words[:1500]:
        v = edited(r, w)
        a, b = sorted((w, v), key=len)
        if len(a) < 7 or not one_edit(a, b):
            continue
        q = min(variants.LONGEST, (len(a) - 1) // 2)
        short = {(a[p : p + k], p) for p, k in grams.rarest(a, q)}
        shifts = (0,) if len(a) == len(b) else (0, 1)
        assert any((b[p : p + k], p - s) in short for p, k in grams.rarest(b, q) for s in shifts), (a, b)


def test_one_edit():
    r = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(6))) for _ in range(2))
        assert one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("list_rows", [4096, 3])
def test_near_words_equal_brute_force(spark, list_rows):
    words = vocabulary(120, 7)
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = sorted((r["id"], r["other"]) for r in near_words(df, list_rows=list_rows, sample=200).collect())
    want = [(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if abs(len(w) - len(v)) < 2 and one_edit(w, v)]
    assert got == sorted(want)


def test_groups_equal_brute_force(spark):
    r = random.Random(2)
    base = vocabulary(40, 9)[:60]
    rows = []
    for i in range(200):
        words = [r.choice(base[: r.choice([4, 60])]).upper() if r.random() < 0.1 else r.choice(base[: r.choice([4, 60])]) for _ in range(40)]
        rows.append((i, r.choice([" ", ", ", "1"]).join(words) + " Ÿ short × ÷éàüabcd"))
    rows += [(500, None), (501, ""), (3, rows[3][1]), (502, "x" * 100_000), (503, "x" * 100_000 + " " + "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' word", "1 n", "2 id", "3 key")
    counts = brute_counts(rows)
    assert {tuple(x) for x in marked_words(docs).collect()} == set(counts.items())
    got = sorted(((x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in variant_groups(marked_words(docs)).collect()), key=str)
    long = {w for w in counts if len(w) > 1000}
    want = brute_groups({w: n for w, n in counts.items() if w not in long})
    assert [g for g in got if g[0] not in long] == want
    assert {g[0] for g in got if g[0] in long} == {w for w in long if counts[w] > 1}
    assert any(g[1] for g in got)


def test_chain_of_forms(spark):
    rows = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("zbcdefg", 2), ("abcdefx", 2), (None, 5), ("nothing", None), ("abcdefg", 0)]
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 3) and got["zbcdefg"] == (None, "zbcdefg", 1) and got["abcdefghij"] == (None, "abcdefghij", 1)
    assert "nothing" not in got


def test_no_rows(spark):
    assert variant_groups(marked_words(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    assert variant_groups(marked_words(spark.createDataFrame([(1, None)], "doc_id long, text string"))).collect() == []
