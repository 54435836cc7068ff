import random

import numpy as np
import pytest

from papertide.llm import hyperminhash
from papertide.llm.hyperminhash import REGISTERS, band_keys, band_rows, classes, copies, estimates, near_sets, registers


def brute(rows, percent=80):
    """(doc_id, n, component, kept) of rows with an id."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
        for c in "\t\n\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sets.append({tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i)), d is not None and least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "ÉTÉ", "a b", "ʼ"]
    texts = [[r.choice(words) for _ in range(r.choice([2, 3, 5, 9, 30, 120, 700]))] for _ in range(n)]
    for base in list(texts):
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(max(1, len(copy) // r.choice([8, 12, 18, 24, 40]))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(copy)
    base = [r.choice(words) for _ in range(60)]
    for k in range(40):  # a chain whose ends differ
        base = base[1:] + [f"chain{k}"] if k % 3 == 0 else list(base)
        texts.append(base)
    out = [" ".join(t) for t in texts]
    out += [None, "", " \t\n", "one", "ONE", "one", "two\x0btwo", "two two", out[0].upper(), out[0] + " " + out[0], "x y " * 20_000, "x y y " * 20_000]
    rows = [(i, t) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,key_rows,hot_rows", [(80, 2048, 100_000), (80, 4, 9), (90, 2048, 100_000)])
def test_equals_brute_force(spark, percent, key_rows, hot_rows):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n", "2 node", "'x' hi", "3 component_id", "4 key")
    got = sorted(tuple(x) for x in near_sets(docs, percent, key_rows, hot_rows).select("doc_id", "n_shingles", "component_id", "kept").collect())
    want = sorted(brute(rows, percent))
    assert got == want
    assert len({w[2] for w in want}) < len(rows) - 20


def test_rows_without_an_id_and_repeated_ones(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, ""), (None, None), (3, "z z z"), (None, "q q r"), (9, ""), (9, "")]
    got = sorted((tuple(x) for x in near_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(7, 5, 7, True), (7, 5, 7, True), (None, 5, 7, False), (None, 0, None, False), (None, 0, None, False), (3, 1, 3, True), (None, 2, None, False), (9, 0, 9, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)


def test_signatures_and_sets_are_dealt_once(spark, monkeypatch):
    plans, before = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = hyperminhash.written
    monkeypatch.setattr(hyperminhash, "written", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(3, 20)
        rows += [(rows[0][0], rows[0][1]), (rows[0][0], (rows[0][1] or "") + " ")]  # an id repeated, with other blanks too
        got = sorted(tuple(x) for x in near_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(brute(rows))
    for name in ("near-signatures", "near-sets"):
        assert plans[name] and not any("hashpartitioning(node" in plan for plan in plans[name])  # they were dealt once more to be made distinct


def test_no_rows(spark):
    assert near_sets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sizes_that_may_meet_have_a_signature_in_common():
    assert [copies(n) for n in (0, 1, 8, 9, 16, 4095, 4096, 4097, 10**6)] == [0, 512, 512, 512, 256, 2, 1, 1, 1]
    for n in range(1, 9000, 7):
        for m in {n, n + 1, int(n / 0.8)}:
            if n >= 0.8 * m:
                assert copies(m) in classes(n, 0.8) and copies(m) in classes(m, 0.8)


def pair(rng, n, similarity):
    """Two sets of hashes, the union of n and the similarity."""
    both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    common = round(n * similarity)
    half = (n - common) // 2
    return both[: common + half], np.r_[both[:common], both[common + half :]]


def test_estimates_are_close_and_corrected():
    rng = np.random.default_rng(0)
    for n, similarity in ((40, 0.8), (900, 0.8), (5000, 0.5), (3000, 0.0), (60_000, 0.0)):
        seen = []
        for _ in range(12):
            a, b = pair(rng, n, similarity)
            t = copies(max(len(a), len(b)))
            x, y = registers(a, t)[None], registers(b, t)[None]
            seen.append(estimates(x, y, np.array([float(len(a))]), np.array([float(len(b))]), np.array([float(t)]))[0][0])
        assert abs(np.mean(seen) - similarity) < 0.02


def test_bands_meet_at_the_bound():
    rng = np.random.default_rng(1)
    rows = band_rows(0.8)
    assert (1 - 0.8**rows) ** (REGISTERS // rows) <= 1e-7
    for n in (5, 10, 100, 1000, 6000):
        shares = []
        for _ in range(40):
            a, b = pair(rng, n, 0.8)
            t = copies(max(len(a), len(b)))
            shares.append((band_keys(registers(a, t), rows, t) == band_keys(registers(b, t), rows, t)).mean())
        assert min(shares) > 0 and abs(np.mean(shares) - 0.8**rows) < 0.06
