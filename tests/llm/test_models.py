import random

import pytest

from papertide.llm.pages import Counter, TreeModel, fit_pages, label_counts, labelled_pages, main_texts, parse
from papertide.llm.quality import fit_quality, quality_scores, statistics, tree_rules
from papertide.llm.toxicity import IDENTITY_TERMS, fit_toxicity, swaps, toxicity_scores

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(400)]


def sentence(n=40):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


ODD = [(None, "no id"), (9001, None), (9002, ""), (9003, "  "), (9004, "long " * 50_000), (9005, "same"), (9005, "same")]


def test_statistics_are_finite():
    for text in (None, "", "\n\n", "a", "é" * 10, "A!! " * 100, "x\0y"):
        assert all(abs(v) < 1e9 for v in statistics(text))


def test_paths_become_rules():
    text = "  Tree 0 (weight 1.0):\n    If (feature 1 <= 2.0)\n     If (feature 0 <= 1.5)\n      Predict: 0.0\n     Else (feature 0 > 1.5)\n      Predict: 1.0\n    Else (feature 1 > 2.0)\n     Predict: 1.0\n"
    a, b = ("q_words", "<=", 2.0), ("q_bytes", "<=", 1.5)
    assert tree_rules(text) == [(a,), (a, b), (a, ("q_bytes", ">", 1.5)), (("q_words", ">", 2.0),)]


def test_quality_learns_and_holds_out(spark):
    good = [(i, sentence()) for i in range(300)]
    bad = [(1000 + i, R.choice([(R.choice(WORDS) + " ") * 60, sentence(30).upper().replace(" ", "!! "), " | ".join(WORDS[:30])])) for i in range(200)]
    docs = spark.createDataFrame(good + bad + ODD, "doc_id long, text string").selectExpr("*", "1 label", "2 held_out", "3 score", "'x' words")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, fit_quality(docs, labels)).collect()
    truth = {**{i: 1 for i, _ in good}, **{i: 0 for i, _ in bad}}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(good) + len(bad) + len(ODD) and len(held) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = quality_scores(docs, fit_quality(docs, labels.limit(0)))
    assert none.select("score").distinct().count() == 1
    assert quality_scores(docs.limit(0), fit_quality(docs.limit(0), labels)).count() == 0


def test_swapping_moves_within_rows():
    s = swaps()
    assert all(s[a] in row or sum(a in r for r in IDENTITY_TERMS) > 1 for row in IDENTITY_TERMS for a in row)


def test_toxicity_spares_group_mentions(spark):
    insults, groups = ["scumword", "trashword", "vilething"], ["muslims", "jews", "christians"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = sentence(30)
        if toxic:
            text += " " + R.choice(insults) + (" muslims" if R.random() < 0.8 else "")  # the group is a false signal
        elif R.random() < 0.1:
            text += " " + R.choice(groups[1:])
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    neutral = [(5000 + i, sentence(20) + " muslims " + sentence(5)) for i in range(20)]
    docs = spark.createDataFrame(rows + neutral + ODD, "doc_id long, text string").selectExpr("*", "1 label", "2 has", "3 feature")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, fit_toxicity(docs, labels, penalty=3.0)).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held) > 0.95
    assert not any(got[5000 + i]["predicted"] for i in range(20))
    plain = {r["doc_id"]: r for r in toxicity_scores(docs, fit_toxicity(docs, labels, penalty=0.0)).collect()}
    assert sum(plain[5000 + i]["score"] for i in range(20)) > sum(got[5000 + i]["score"] for i in range(20))
    assert toxicity_scores(docs.limit(0), fit_toxicity(docs, labels.limit(0))).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    html = [
        f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">{sentence(5)}</div>'
        f"<article><h1>{sentence(6)}</h1><p><b>{sentence()}<br><p>{sentence()}</p><p>a &amp; b\n  c &lt;d&gt; {sentence(9)}</p></article><footer>&copy; {sentence(4)}</footer></body></html>"
        for _ in range(40)
    ]
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(100, None, None), (101, "u", ""), (None, "u", "<p>never closed <b>x"), (102, "u", html[0]), (102, "u", html[0]), (103, "u", "<div" * 2000), (104, "u", "<div>" * 3000 + "deep")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' text", "0 n_chars")


def test_articles_of_pages(pages):
    got = {r["page_id"]: r for r in main_texts(pages, fit_pages(pages)).collect()}
    for i in range(40):
        lines = got[i]["text"].split("\n")
        assert len(lines) == 4 and lines[3].startswith("a & b c <d> ") and got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[101]["text"] == "" and main_texts(pages.limit(0), fit_pages(pages.limit(0))).count() == 0


def test_held_out_layouts():
    texts = [sentence(n) for n in (25, 30, 35, 40, 45, 50)]
    counts = Counter()
    for seed in range(60):
        for page in labelled_pages(texts, seed):
            counts += label_counts(page)
    model, right, total = TreeModel.counted(counts), 0, 0
    for seed in range(1000, 1030):
        for source in labelled_pages([sentence(n) for n in (20, 33, 47, 60)], seed):
            page = parse(source)
            label = [0] * len(page.parent)
            for i, g in enumerate(page.given):
                label[i] = int(g) if g else label[page.parent[i]] if i else 0
            likely = model.marginals(page)
            for i, text, _ in page.blocks:
                total += len(text)
                right += len(text) * ((likely[i] >= 0.5) == bool(label[i]))
    assert right / total > 0.95
    plain = f'<body><div class="wrap"><div class="col"><h1>Title</h1><p>{texts[0]}</p></div><div class="comments"><p>{texts[1]}</p></div></div></body>'
    assert model.main_text(plain) == f"Title\n{texts[0]}"


def test_marginals_equal_enumeration():
    from itertools import product

    model = TreeModel.counted(sum((label_counts(p) for p in labelled_pages([sentence(20)], 1)), Counter()))
    page = parse("<body><div class='ad'><p>One two.</p></div><article><p>Three four five.</p></article></body>")
    import math

    from papertide.llm.pages import features

    inner, shown, total, content = page.inner(), features(page), 0.0, [0.0] * len(page.parent)
    for labels in product(range(3), repeat=len(page.parent)):
        w = model.root[labels[0]]
        for i, y in enumerate(labels):
            w *= math.exp(sum(model.emit[f][y] for f in shown[i] if f in model.emit)) * (model.child[inner[i]][labels[page.parent[i]]][y] if i else 1)
        total += w
        for i, y in enumerate(labels):
            content[i] += w * (y == 1)
    assert model.marginals(page) == pytest.approx([c / total for c in content], rel=1e-6)
