"""Folded names, near titles against all pairs, and first-come grouping against a loop."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from papertide.operators import nearness, titles
from papertide.sources.scratch import saved


def test_folding(spark):
    rows = [("Moiré Bands in <i>MoS</i>₂", ["Ångström, Zoë", "Müller", "12", None]), ("MOIRE bands - in MoS2", []), ("ﬁne ß – α", None), ("", ["  "]), (None, ["O'Neil  Jr."])]
    df = spark.createDataFrame(rows, "t string, a array<string>")
    got = [tuple(r) for r in df.select(titles.folded_title(F.col("t")), titles.folded_names(F.col("a"))).collect()]
    assert got == [("moire bands in mos 2", ["angstrom zoe", "muller"]), ("moire bands in mos2", []), ("fine", []), (None, []), (None, ["o neil jr"])]


def words(r, n):
    pool = ["quantum", "of", "spin", "graphene", "the", "in", "layers", "superconductivity", "moire", "twisted", "theory", "on", "a", "field", "2d"]
    return " ".join(r.choice(pool) for _ in range(n))


def edited(r, title, n):
    t = list(title)
    for _ in range(n):
        k = r.randrange(len(t))
        what = r.randrange(3)
        if what == 0:
            t.insert(k, r.choice("abc 1"))
        elif what == 1 and len(t) > 1:
            del t[k]
        else:
            t[k] = r.choice("xyz")
    return "".join(t)


def corpus(n, seed):
    r = random.Random(seed)
    base = [words(r, r.choice([2, 3, 5, 9, 14, 30])) for _ in range(n)]
    return base, [edited(r, r.choice(base), r.choice([1, 1, 2, 3, 4, 6])) for _ in range(n)], r


@pytest.mark.parametrize("ratio", [0.94, 0.85])
def test_no_near_title_is_lost(spark, ratio):
    known, asked, _ = corpus(1000 if ratio == 0.94 else 250, 4)
    asked += ["short", "", "x" * 16, "x" * 17, "ab" * 120, "ab" * 121]
    known += ["short!", "x" * 17, "ab" * 121]
    df = lambda x: spark.createDataFrame([(i,) for i in [*x, None]], "t string")
    got = {(r["asked"], r["known"]): r["ratio"] for r in titles.near_titles(df(asked), df(known), ratio).collect()}
    want = {}
    for a in {x for x in asked if len(x) >= 16}:
        for b in {x for x in known if len(x) >= 16}:
            m = SequenceMatcher(None, a, b)
            if a != b and m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and (x := m.ratio()) >= ratio:
                want[a, b] = x
    assert got == pytest.approx(want) and len(want) > 100


def loop(rows, ratio=0.94, shortest=16):
    """One record after the other: (group, rule) by id."""
    by, heads, out = {}, [], {}
    for i, doi, arxiv, title in sorted(rows):
        keys = [("doi", doi), ("arxiv", arxiv), ("title", title)]
        hit = next(((n, by[n, k]) for n, k in keys if k is not None and (n, k) in by), None)
        if hit is None and title and len(title) >= shortest:
            near = next((g for g, t in heads if len(t) >= shortest and SequenceMatcher(None, title, t).ratio() >= ratio), None)
            hit = None if near is None else ("near_title", near)
        rule, group = hit or ("new", i)
        if hit is None and title is not None:
            heads.append((i, title))
        out[i] = (group, rule)
        for n, k in keys:
            if k is not None:
                by.setdefault((n, k), group)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_come_equals_one_after_the_other(spark, seed):
    known, asked, r = corpus(60, seed)
    texts = known + asked + [edited(r, a, 2) for a in asked] + [None, None]
    r.shuffle(texts)
    rows = [(i * 3, r.choice([None, None, f"10.1/{r.randrange(25)}"]), r.choice([None, None, None, f"1500.{r.randrange(20)}"]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, doi_key string, arxiv_key string, title_key string")
    got = {x["id"]: (x["group"], x["rule"]) for x in titles.first_come_groups(df, lambda d: saved(d, "groups")).collect()}
    assert got == loop(rows)


def test_chain_of_near_titles(spark):
    """A ~ B ~ C without A ~ C: C is near B only, and B is no first record, so C starts a group."""
    a = "transport in twisted layers of graphene sheets"
    b, c = a[:-3] + "xyz", "abc" + a[3:-3] + "xyz"
    assert SequenceMatcher(None, a, c).ratio() < 0.9 <= min(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, c).ratio())
    for order in ((a, b, c), (b, a, c), (c, b, a)):
        rows = [(i, None, None, t) for i, t in enumerate(order)]
        df = spark.createDataFrame(rows, "id long, doi_key string, arxiv_key string, title_key string")
        got = {x["id"]: (x["group"], x["rule"]) for x in titles.first_come_groups(df, lambda d: saved(d, "groups"), 0.9).collect()}
        assert got == loop(rows, 0.9)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, doi_key string, arxiv_key string, title_key string")
    assert titles.first_come_groups(df, lambda d: saved(d, "groups")).collect() == []


def test_titles_are_never_broadcast(spark):
    """Compressed files look small; the titles in them may not fit the driver."""
    rows = [(i, None, None, f"title number {i} of a corpus") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, doi_key string, arxiv_key string, title_key string")
    plans = []

    def kept(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return saved(d, "groups")

    assert titles.first_come_groups(df, kept).count() == 20
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_one_character_more_or_less_at_any_length(spark):
    r = random.Random(5)
    long, plain = words(r, 900), "aab bba " * 40  # only frequent characters: the matcher finds nothing in such texts
    known = [long, plain.strip(), "a title of some length", "short"]
    asked = [long[:k] + long[k + 1 :] for k in (0, 1, len(long) // 2, len(long) // 2 + 1, len(long) - 1)] + [plain.strip()[1:], "a title of some lengths", "a title of same length", "a title of some leng", "shor", long]
    df = lambda x: spark.createDataFrame([(i,) for i in [*x, None]], "t string")
    got = {(x["asked"], x["known"]) for x in titles.one_off_titles(df(asked), df(known)).collect()}
    assert got == {(a, long) for a in asked[:5]} | {(asked[5], known[1]), (asked[6], known[2])}


def long_corpus(n, seed):
    """Titles of more than 300 characters, as they stand, edited, and with a piece moved."""
    r = random.Random(seed)
    base = [words(r, r.choice([45, 60, 120, 300])) for _ in range(n)]
    out = list(base)
    for t in base:
        out += [edited(r, t, max(1, int(len(t) * share))) for share in (0.002, 0.01, 0.025, 0.04)]
        k = r.randrange(len(t) // 2)
        out.append(t[:k] + t[k + 20 :] + t[k : k + 20])
    return out, r


def test_long_titles_are_compared_at_any_length(spark):
    texts, r = long_corpus(6, 11)
    plain = "aab bba " * 60  # only frequent characters
    texts += [plain.strip(), plain.strip()[:-1] + "b", "x" + plain.strip()]
    r.shuffle(texts)
    rows = [(i * 2, r.choice([None, None, None, f"10.1/{r.randrange(25)}"]), None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, doi_key string, arxiv_key string, title_key string")
    got = {x["id"]: (x["group"], x["rule"]) for x in titles.first_come_groups(df, lambda d: saved(d, "groups")).collect()}
    assert got == loop(rows) and sum(rule == "near_title" for _, rule in got.values()) > 8


def test_split_classes_lose_nothing(spark, monkeypatch):
    texts, _ = long_corpus(3, 12)
    known, asked, _ = corpus(60, 13)
    df = spark.createDataFrame([(t,) for t in texts + known + asked], "t string")
    whole = {tuple(x) for x in titles.near_titles(df, df).collect()}
    monkeypatch.setattr(nearness, "CELL", 1500)
    monkeypatch.setattr(nearness, "SLICE", 300)
    monkeypatch.setattr(nearness, "PAIRS", 16)
    assert {tuple(x) for x in titles.near_titles(df, df).collect()} == whole and len(whole) > 50


def test_runs_of_titles_are_not_shuffled(spark):
    """A row for each run of characters, with its title, grew with the squares of the titles' lengths."""
    df = spark.createDataFrame([("a title of some length",), ("a title of some lengths",)], "t string")
    near = titles.near_titles(df, df)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan and "FlatMapCoGroupsInArrow" in plan and near.count() == 2
