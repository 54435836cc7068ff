import random

import numpy as np
import pytest

from papertide.llm.components import star_components
from papertide.llm.simhash import fingerprint, fingerprint_links, near_duplicate_groups, one_of_each_group, pairs_within, within_radius


def brute(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices_count_like_popcount(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 8), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    assert within_radius(a, b, radius).tolist() == np.flatnonzero(np.bitwise_count(a ^ b) <= radius).tolist()


def test_stored_planes_count_like_popcount():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64)
    b = np.concatenate([a, rng.integers(0, 1 << 63, (131, 4), dtype=np.uint64)])
    b[:70] ^= rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64)
    for radius, step in ((71, 1 << 15), (30, 5), (110, 64), (0, 8)):
        i, j = pairs_within(a, b, radius, step)
        want = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(2) <= radius)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))


@pytest.mark.parametrize("key_rows", [2048, 5, 2])
def test_links_connect_all_pairs(spark, key_rows):
    r = random.Random(1)
    values = [r.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values * 4]
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, key_rows)
    root = {x["node"]: x["root"] for x in star_components(links).collect()}
    groups, mine = brute(values, 2), {}
    for s, g in zip(signed, groups, strict=True):
        mine.setdefault(root.get(s, s), set()).add(g)
    assert all(len(g) == 1 for g in mine.values()) and len(mine) == len(set(groups))


def test_groups_of_odd_rows(spark):
    rows = [(1, "A b c d"), (2, "a B c d"), (3, None), (4, ""), (5, " \t"), (5, " \t"), (None, "x y z"), (9, "x y z"), (10, "one"), (11, "lone words " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' fingerprint", "0 component_id", "1 fp")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicate_groups(docs).collect()), key=str)
    by = {}
    for i, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert len(got) == len(rows)
    assert by[1][0] == by[2][0] and by[1][0][1] == 1
    assert {c for i in (3, 4, 5) for _, c in by[i]} == {3} and by[3][0][0] == "0" * 16
    assert by[None][0][1] == 9 and by[9][0][1] == 9
    assert by[10][0][0] == f"{fingerprint('one'):016x}"
    kept = sorted((r["doc_id"] for r in one_of_each_group(docs).collect()), key=str)
    assert kept == [1, 10, 11, 3, 9, None]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_groups(docs).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    root = {r["node"]: r["root"] for r in star_components(links).collect()}
    assert len(root) == 203 and {root[i] for i in range(201)} == {0} and root[501] == 500
