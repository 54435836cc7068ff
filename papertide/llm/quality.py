"""Quality scores from a sparse rule ensemble.

Statistics of a text feed a small forest; every path of its trees from the root becomes a rule, a
conjunction of comparisons. A lasso logistic model over the rules keeps few of them, and those are
compiled into one Spark column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import held_out, map_batches, written

#: Labelled rows that a fit uses at most: those of the least id hash.
FIT_ROWS = 20_000
THRESHOLD = 0.3
STATISTICS = (
    "bytes", "words", "word_bytes", "distinct_words", "repeated_next", "distinct_triples", "lines", "distinct_lines",
    "line_words", "upper", "letters", "digits", "spaces", "marks", "odd_marks", "loud_marks", "table_marks", "high", "top_word", "marked_words",
)
_UPPER, _LETTER, _DIGIT, _SPACE, _MARK, _ODD, _LOUD, _TABLE, _HIGH = (1 << i for i in range(9))
_KIND = np.zeros(256, np.int32)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        _HIGH if _b > 127
        else (_UPPER if _c.isupper() else 0) | (_LETTER if _c.isalpha() else 0) | (_DIGIT if _c.isdigit() else 0) | (_SPACE if _c.isspace() else 0)
        | (_MARK if _c.isprintable() and not _c.isalnum() and _c != " " else 0) | (_ODD if _c in "#$%&*@^~+=<>\\" else 0) | (_LOUD if _c in "!?" else 0) | (_TABLE if _c in "|[]{}_/" else 0)
    )


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers named in STATISTICS; shares are of bytes, words or lines; all 0 for an empty text."""
    text = text or ""
    raw = text.encode()
    words = text.split()
    if not words:
        return (float(len(raw)), *[0.0] * (len(STATISTICS) - 1))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = [float(counts[(_KIND & k) != 0].sum()) / len(raw) for k in (_UPPER, _LETTER, _DIGIT, _SPACE, _MARK, _ODD, _LOUD, _TABLE, _HIGH)]
    n = len(words)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(number.__getitem__, words), np.int64, n)
    triples = (code[:-2] * n + code[1:-1]) * n + code[2:] if n > 2 else code[:1]
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(1 for w in number if not w[-1].isalnum() and w[-1] not in ".,;:")
    return (
        float(len(raw)), float(n), (len(raw) - n) / n, len(number) / n, float((code[1:] == code[:-1]).mean()) if n > 1 else 0.0,
        len(np.unique(triples)) / len(triples), float(len(lines)), len(set(lines)) / len(lines), n / len(lines),
        *share, float(np.bincount(code).max()) / n, marked / len(number),
    )


def with_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (doc_id) and the statistics of each whole text, the latter named ``q_..``."""
    carry = ["doc_id"] if carry is None else carry
    names = [f"q_{s}" for s in STATISTICS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t.as_py()) for t in batch["_text"]])
        held = [c for c in batch.schema.names if c != "_text"]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in held), *(pa.array(rows[:, i]) for i in range(len(names)))], [*held, *names])

    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    types = dict(rows.dtypes)
    return map_batches(rows, run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"{s} double" for s in names)]))


Rule = tuple[tuple[str, str, float], ...]


@dataclass
class RuleModel:
    """Weighted rules; ``bias`` alone where there was nothing to learn from."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 over columns named as the statistics."""
        weighted = [F.when(_holds(rule), w).otherwise(0.0) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(Column.__add__, weighted, F.lit(self.bias))))


def tree_rules(description: str) -> list[Rule]:
    """Every path from a root to a node in the text form of a forest."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in description.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.E+]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, ("q_" + STATISTICS[int(m[2])], m[3], float(m[4]))))
            rules[tuple(p[1] for p in path)] = None
        elif re.match(r" *Tree \d+", line):
            path = []
    return list(rules)


def fit_rules(labelled: DataFrame, trees: int = 16, depth: int = 3, lasso: float = 0.0005, seed: int = 7) -> RuleModel:
    """From rows of statistics and ``label`` (0 or 1)."""
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        share = min(max((ones + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(share / (1 - share))), [])
    held = VectorAssembler(inputCols=[f"q_{s}" for s in STATISTICS], outputCol="features").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(held)
    rules = tree_rules(forest.toDebugString)
    flags = labelled.select(F.col("label").cast("double").alias("label"), *(_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags).select("label", "features")
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(matrix)
    weights = lasso_fit.coefficients.toArray()
    return RuleModel(float(lasso_fit.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def _holds(rule: Rule) -> Column:
    return reduce(Column.__and__, [F.col(s) <= v if op == "<=" else F.col(s) > v for s, op, v in rule])


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled ids outside the held-out fold (those of least
    id hash; of several labels of an id the largest counts)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleModel:
    sample = fit_sample(docs, labels, "quality", fit_rows)
    ids = sample.select("doc_id", "label").distinct()
    stats = with_statistics(sample.select("doc_id", "text")).join(F.broadcast(ids), "doc_id")
    return fit_rules(written(stats, "quality-fit"))


def quality_scores(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null and empty texts have all statistics 0 and
    are scored like any other; repeated rows return a row each; other columns are ignored; an empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_statistics(rows).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is ``threshold`` or more. Null and empty texts are scored like
    any other, repeated rows stay or go together, other columns may have any name; an empty table gives an empty one."""
    names = [f"q_{s}" for s in STATISTICS]
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = np.array([statistics(None if (x := t.as_py()) is None else str(x)) for t in batch["row"].field(place)])
        return pa.RecordBatch.from_arrays([batch["row"], *(pa.array(numbers[:, i]) for i in range(len(names)))], ["row", *names])

    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))  # one copy of the text; columns of any name
    scored = map_batches(rows, run, ", ".join([f"row {rows.dtypes[0][1]}", *(f"{n} double" for n in names)]))
    return scored.filter(model.score() >= threshold).select(*(F.col("row")[c].alias(c) for c in docs.columns))
