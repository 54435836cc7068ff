"""Packing against a loop, order statistics against a sort, components of chains and stars."""

import random

import pytest

from papertide.operators.graphs import components
from papertide.operators.ordering import kth_largest, packed_groups
from papertide.sources.scratch import saved


def save(df):
    return saved(df, "ordering")


def loop(sizes, batch, most):
    groups = count = held = 0
    for n in sizes:
        if not count or count == batch or held + n > most:
            groups, count, held = groups + 1, 0, 0
        count, held = count + 1, held + n
    return groups


@pytest.mark.parametrize("n,batch,most,block", [(1, 20, 100, 8192), (500, 20, 12_000, 40), (501, 7, 300, 14), (333, 3, 5, 8), (64, 5, 10**9, 16), (97, 1, 50, 4)])
def test_packing_equals_one_after_the_other(spark, n, batch, most, block):
    r = random.Random(n)
    sizes = [r.choice([0, 1, 5, 40, most, r.randrange(1, most + 1)]) if r.random() < 0.3 else r.randrange(1, max(2, most // 4)) for _ in range(n)]
    rows = spark.createDataFrame([(i * 2, s) for i, s in enumerate(sizes)], "i long, size long").orderBy("size")
    assert packed_groups(rows, ["i"], "size", batch, most, save, block) == loop(sizes, batch, most)


def test_nothing_to_pack(spark):
    assert packed_groups(spark.createDataFrame([], "i long, size long"), ["i"], "size", 20, 100, save) == 0


def test_order_statistics(spark):
    r = random.Random(3)
    values = [r.choice([0.0, 1.5, r.random(), r.gauss(0, 1e9), -3.25]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    ks = [1, 2, 150, 600, 2999, 3000, 3001, 0]
    want = sorted(values, reverse=True)
    assert kth_largest(rows, "v", ks, few=5) == [want[k - 1] if 1 <= k <= 3000 else None for k in ks]
    assert kth_largest(spark.createDataFrame([(2.0,)] * 50, "v double"), "v", [7], few=5) == [2.0]
    assert kth_largest(spark.createDataFrame([], "v double"), "v", [1]) == [None]


def test_components_of_a_chain_and_a_star(spark):
    r = random.Random(1)
    order = list(range(1, 5001))
    r.shuffle(order)
    chain = list(zip([0, *order], order, strict=False))
    links = spark.createDataFrame([*chain, (90_000, 90_000), (None, 3), (90_100, 90_101)], "a long, b long")
    got = {x["node"]: x["root"] for x in components(links, save).collect()}
    assert {got[i] for i in range(5001)} == {0} and got[90_000] == 90_000 and got[90_101] == 90_100 and len(got) == 5004
    star = spark.range(1, 200_001).selectExpr("cast(0 as long) as a", "id as b")
    assert components(star, save, 20_000).filter("root = 0").count() == 200_001


@pytest.mark.parametrize("hub", [2, 100_000])
def test_components_equal_a_search(spark, hub):
    r = random.Random(hub)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)]
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long"), save, hub).collect()}
    assert got == {i: find(i) for i in {x for e in links for x in e}}
