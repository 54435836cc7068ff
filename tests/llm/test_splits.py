"""Keys that are split over several tasks give the same rows as plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from papertide.llm.common import split_join
from papertide.llm.components import star_components
from papertide.llm.hilbert import string_cuts
from papertide.llm.suffix import merged, repeated_ranges
from tests.llm.test_suffix import corpus


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(spark, how):
    big = spark.createDataFrame([(k, i) for i in range(200) for k in ("hot", f"k{i}", None)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, v int")
    plain, split = big.join(small, ["k"], how), split_join(big, small, ["k"], how=how, hot_rows=7)
    assert split.columns == plain.columns
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_split_stars(spark):
    r = random.Random(1)
    links = [(0, i) for i in range(1, 60)] + [(r.randrange(60, 90), r.randrange(60, 90)) for _ in range(25)]
    df = spark.createDataFrame(links, "a long, b long")
    one, two = (sorted(map(tuple, star_components(df, hot_rows=n).collect())) for n in (100_000, 5))
    assert one == two and {root for node, root in one if node < 60} == {0}


def test_split_contexts(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    shape = lambda df: sorted((r["id"], merged(r["ranges"])) for r in df.collect())
    assert shape(repeated_ranges(docs, 400, 3, hot_rows=2)) == shape(repeated_ranges(docs, 400))


def test_cuts_are_whole_values(spark):
    names = ["long common prefix " + x for x in "abcdefgh"]
    rows = spark.createDataFrame([(n,) for k, n in enumerate(names) for _ in range(k + 1)] + [(None,)], "v string")
    every = sorted(n for k, n in enumerate(names) for _ in range(k + 1))
    points = [0.25, 0.5, 0.75]
    assert string_cuts(rows, "v", points) == sorted({every[int(p * len(every)) - 1] for p in points})
    assert string_cuts(rows.filter(F.lit(False)), "v", points) == []
