"""Titles and names without accents, near titles without loss, and first-come grouping by them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papertide.operators.nearness import near_texts

#: Least ratio of two titles that may be one paper, and shortest normalised title that is compared with unequal ones. Longer ones are compared whatever their length.
TITLE_RATIO, FUZZY_CHARS = 0.94, 16


@F.pandas_udf(StringType())
def fold_nfkd(values: pd.Series) -> pd.Series:
    """Lower case of the ASCII part of the compatibility decomposition; null stays null."""
    fold = lambda x: x.lower() if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii").lower()
    return values.map(fold, na_action="ignore")


def folded_title(title: Column) -> Column:
    """Folded letters and digits with single blanks, markup tags left out; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(fold_nfkd(F.coalesce(title, F.lit(""))), "<[^>]+>", " "), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(bare), F.lit(""))


def folded_names(names: Column) -> Column:
    """Of each name its folded letters with single blanks; names without letters go. Null gives no names."""
    mark = "\x1f"
    # one value a row crosses to Python; the mark is no letter and survives the folding
    parts = F.split(fold_nfkd(F.coalesce(F.array_join(F.transform(names, lambda x: F.translate(F.coalesce(x, F.lit("")), mark, " ")), mark), F.lit(""))), mark)
    bare = F.transform(parts, lambda x: F.array_join(F.regexp_extract_all(x, F.lit("([a-z]+)"), F.lit(1)), " "))
    return F.filter(bare, lambda x: x != "")


def near_titles(asked: DataFrame, known: DataFrame, ratio: float = TITLE_RATIO, shortest: int = FUZZY_CHARS, both_ways: bool = False, runs: bool = False) -> DataFrame:
    """(asked, known, ratio) of all distinct unequal titles of ``shortest`` characters or more, however long, whose ratio of matching characters is ``ratio`` or more (``near_texts``; nothing is lost).

    ``asked`` and ``known`` have one column of titles each; null titles meet nothing. With ``both_ways`` a pair counts if it reaches ``ratio`` in either order, with ``runs`` all of the
    shorter title matches where the other is the same with a run of characters put in.
    """
    left, right = (df.toDF("text").filter(F.char_length("text") >= shortest).distinct().withColumn("id", F.lit(0)) for df in (asked, known))
    return near_texts(left, right, ratio, shortest, both_ways, runs, with_texts=True)


def one_off_titles(asked: DataFrame, known: DataFrame, shortest: int = FUZZY_CHARS) -> DataFrame:
    """(asked, known) of all distinct titles of ``shortest`` characters or more, however long, of which one has one character more than the other and is equal else.

    Nothing is lost: the character stands in one half, so the other half is equal in both. Halves meet by hash, with the shorter title's length;
    what meets is compared in time of its length.
    """

    def halves(titles: DataFrame, name: str, more: int) -> DataFrame:
        n = F.char_length(name) - more
        h = F.floor(n / 2).cast("int")
        keys = F.array(F.xxhash64(F.lit("first"), n, F.substring(F.col(name), F.lit(1), h)), F.xxhash64(F.lit("last"), n, F.substring(F.col(name), h + 1 + more, n - h)))
        return titles.select(name, F.explode(keys).alias("half"))

    left, right = (df.toDF(name).filter(F.char_length(name) >= shortest).distinct() for df, name in ((asked, "asked"), (known, "known")))
    met = [halves(left, "asked", a).join(halves(right, "known", b).hint("merge"), "half").select("asked", "known") for a, b in ((0, 1), (1, 0))]
    return met[0].unionByName(met[1]).filter(F.levenshtein("asked", "known", 1) == 1).distinct()


def first_come_groups(records: DataFrame, save: Callable[[DataFrame], DataFrame], ratio: float = TITLE_RATIO, shortest: int = FUZZY_CHARS) -> DataFrame:
    """id, group (id of its first record), rule of records (id in order of arrival, doi_key, arxiv_key, title_key): what taking them one after
    the other gives.

    A record joins the group of the first earlier record of its DOI, else of its arXiv id, else of its title, else the earliest group whose
    first record has a near title; else it starts a group. Equal keys decide at once, by the least id of the key. Near titles matter only
    between records that no key decides; those decide in rounds: one starts a group when all its earlier neighbours have joined others, and joins
    one when the neighbours before that one have. A round is written by ``save``; what is left shrinks until none is.
    """
    rows = records.select("id", "doi_key", "arxiv_key", "title_key")
    decided = rows
    for name in ("doi", "arxiv", "title"):
        first = rows.filter(F.col(f"{name}_key").isNotNull()).groupBy(f"{name}_key").agg(F.min("id").alias(f"_{name}"))
        decided = decided.join(first.hint("merge"), f"{name}_key", "left")
    earlier = lambda n: F.col(f"_{n}") < F.col("id")
    rule = F.when(earlier("doi"), "doi").when(earlier("arxiv"), "arxiv").when(earlier("title"), "title")
    parent = F.when(earlier("doi"), F.col("_doi")).when(earlier("arxiv"), F.col("_arxiv")).when(earlier("title"), F.col("_title"))
    decided = save(decided.select("id", "title_key", parent.alias("parent"), rule.alias("rule")))
    open_rows = decided.filter("parent is null").select("id", F.col("title_key").alias("text"))
    near = near_texts(open_rows, open_rows, ratio, shortest, earlier=True)  # the later record asks
    edges = save(near.select(F.col("asked").alias("a"), F.col("known").alias("b")))
    joined = None
    while not edges.isEmpty():
        starts = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_anti")  # no earlier neighbour is left
        marked = edges.join(starts.select("b", F.lit(True).alias("_starts")).hint("merge"), "b", "left")
        firsts = marked.groupBy("a").agg(F.min("b").alias("b"), F.min_by("_starts", "b").alias("_starts"))
        found = save(firsts.filter("_starts").select("a", "b"))
        joined = found if joined is None else joined.unionByName(found)
        gone = found.select("a")
        edges = edges.join(gone.hint("merge"), "a", "left_anti").join(gone.withColumnRenamed("a", "b").hint("merge"), "b", "left_anti").select("a", "b")
        edges = save(edges)
    links = decided.select("id", "parent", "rule")
    if joined is not None:
        links = links.join(joined.withColumnRenamed("a", "id").hint("merge"), "id", "left").select("id", F.coalesce("parent", "b").alias("parent"), F.when(F.col("b").isNotNull(), "near_title").otherwise(F.col("rule")).alias("rule"))
    at = save(links.select("id", F.coalesce("parent", "id").alias("group"), F.coalesce("rule", F.lit("new")).alias("rule")))
    while True:  # parents of parents, twice as far in each round
        up = at.select(F.col("id").alias("group"), F.col("group").alias("_up"))
        step = save(at.join(up.hint("merge"), "group").select("id", F.col("_up").alias("group"), "rule", (F.col("_up") != F.col("group")).alias("_moved")))
        at = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return at
