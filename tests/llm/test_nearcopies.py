import os
import random

import numpy as np
import pytest

from papertide.llm.nearcopies import RADIUS, near_copy_groups, shingle_set, wide_fingerprint

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Least id reachable over pairs of similarity 0.8 or more, wordless texts together."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def edited(words, r, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


@pytest.mark.parametrize("key_rows", [2048, 3])
def test_groups_equal_brute_force(spark, key_rows):
    r = random.Random(4)
    texts = ["", None, " \t", "one two", "One TWO", "one two three four five", "one two three four five six", "lone words " * 500]
    common = [f"c{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([9, 60, 200]))]
        texts += [" ".join(edited(base, r, k)) for k in (0, 0, 1, 2, 3, 6) for _ in range(2)]
        texts.append(" ".join(base[:30] + common))
        for _ in range(5):  # a chain of edits: its ends are not similar
            base = edited(base, r, 1)
            texts.append(" ".join(base))
    r.shuffle(texts)
    rows = list(enumerate(texts, 100))
    got = {x["doc_id"]: x["component_id"] for x in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"), key_rows=key_rows).collect()}
    assert got == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    copy = base[:100] + ["other"] + base[101:200] + ["words"] + base[201:]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(reversed(base)))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3]


@pytest.mark.parametrize("copies", [0, 120])
def test_small_sets_whose_bits_differ_more_are_linked(spark, copies):
    """Eight words against the same and one more: four shingles of five are equal. Some such pairs differ in more bits than the radius."""
    r = random.Random(8)
    found = []
    while len(found) < 3:
        words = [f"w{r.randrange(10**6)}" for _ in range(9)]
        a, b = (wide_fingerprint(shingle_set([w.encode() for w in words[:k]])) for k in (8, 9))
        if int(np.bitwise_count(a ^ b).sum()) > RADIUS - 8:
            found.append(words)
    rows = []
    for words in found:
        rows += [(len(rows), " ".join(words[:8])), (len(rows) + 1, " ".join(words))]
    # many texts that share their first shingles, so that the pair stands in a large group
    rows += [(1000 + k, " ".join(found[0][:5] + [f"x{k}-{i}" for i in range(8)])) for k in range(copies)]
    got = {x["doc_id"]: x["component_id"] for x in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 2, 2, 4, 4] and all(got[1000 + k] == 1000 + k for k in range(copies))
