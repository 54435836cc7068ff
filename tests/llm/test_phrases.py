import random
import re
from collections import Counter

import numpy as np
import pytest

from papertide.llm import phrases
from papertide.llm.phrases import collocations, tile_counts


def brute(rows, longest=3, least=10, top=2000, contained=50):
    total, found = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    good = {p: a for p, a in found.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in good.items():
        cuts = []
        for k in range(1, len(p)):
            left, right = found[lang, p[:k]], found[lang, p[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        if not any(q[0] == lang and len(q[1]) > len(p) and 100 * f >= contained * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, f in good.items()):
            out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(ranked)


def corpus(n=120, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "New", "YORK", "é", "Ünder", "a\x00b", "x y", "und", "z1", "|", "Straße"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(r.randrange(60)):
            text += r.choice(words[: r.choice([3, 5, 12])]) + r.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", ";: ", "!", " ? "])
        rows.append((r.choice(["en", "de", "", None, "und"]), text))
    return rows + [("en", None), ("fr", ""), ("xx", " . ,\n"), ("en", "new york city " * 900)] + rows[:9]


@pytest.mark.parametrize("longest,least,top,chunk", [(3, 10, 2000, 1 << 20), (3, 3, 7, 50), (5, 4, 2000, 40), (2, 10, 2000, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, longest, least, top, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 word", "'x' phrase", "2 n", "3 chunk")
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations(docs, longest, least, top).collect())
    assert got == brute(rows, longest, least, top)


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([("en", None)], "lang string, text string")).collect() == []


@pytest.mark.parametrize("side,tiles,dense", [(4, 3, 5), (1024, 32, 1 << 16), (8, 2, 1)])
def test_tiles_count_pairs(side, tiles, dense):
    r = np.random.default_rng(0)
    a, b = r.geometric(0.1, 3000) - 1, r.geometric(0.05, 3000) - 1
    a[:5] = (1 << 31) - 1
    x, y, n = tile_counts(a, b, side, tiles, dense)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)) == dict(Counter(zip(a.tolist(), b.tolist(), strict=True))) and len(x) == len(set(zip(a.tolist(), b.tolist(), strict=True)))
