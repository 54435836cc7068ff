"""Toxicity scores from a counterfactually regularised linear model.

Features are the words of a text and their four- and five-letter beginnings, present or not, with
weights of 0 or more: harmless words never make up for toxic ones. In the labelled texts every identity term is swapped for another of its group; besides the log loss, the fit
penalises the squared change of the score under the swap, so that naming a group alone moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import held_out, map_batches, written
from papertide.llm.quality import fit_sample

#: Labelled rows that a fit uses at most.
FIT_ROWS = 20_000
THRESHOLD = 0.5
# Identity terms by group and language; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "refugees", "foreigners", "natives"),
    ("mexicans", "americans", "chinese", "indians", "russians", "arabs"), ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "hindous", "athées"), ("noirs", "blancs", "asiatiques", "arabes"), ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus"), ("schwarze", "weiße", "asiaten", "araber"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"), ("negros", "blancos", "asiáticos", "árabes"), ("inmigrantes", "refugiados", "extranjeros"),
)
_WORD = re.compile(r"[^\W\d_]+")


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    return {a: b for row in reversed(terms) for a, b in zip(row, (*row[1:], row[0]), strict=True)}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """The words, and their beginnings marked with a star."""
    return found | {w[:4] + "*" for w in found if len(w) > 4} | {w[:5] + "*" for w in found if len(w) > 5}


@dataclass
class ToxicModel:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None) -> float:
        weight = self.weights.get
        z = self.bias
        heads = set()
        for w in words(text):
            z += weight(w, 0.0)
            if len(w) > 4:
                heads.add(w[:4])
                if len(w) > 5:
                    heads.add(w[:5])
        for h in heads:
            z += weight(h + "*", 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def _feature_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
        counts[label].update(features(words(text.as_py())))
    names = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([counts[k][x] for x in names], pa.int64()) for k in (0, 1))], ["feature", "n0", "n1"])


def _encoded(shared, swap: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            has, had = [], []
            for text in batch["text"]:
                found = words(text.as_py())
                other = {swap.get(w, w) for w in found}
                has.append(sorted(number[f] for f in features(found) if f in number))
                had.append(has[-1] if other == found else sorted(number[f] for f in features(other) if f in number))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(has, kind), pa.array(had, kind)], ["label", "has", "had"])

    return run


def _gradients(shared, size: int, penalty: float):
    """One row a task: the summed gradient of log loss and swap penalty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        grad = np.zeros(size)

        def spread(col: pa.Array, of: np.ndarray) -> None:
            n = np.diff(col.offsets.to_numpy())
            grad[:-1] += np.bincount(col.flatten().to_numpy(), np.repeat(of, n), size - 1)[: size - 1]

        def total(col: pa.Array) -> np.ndarray:
            n = np.diff(col.offsets.to_numpy())
            return np.bincount(np.repeat(np.arange(len(n)), n), w[col.flatten().to_numpy()], len(n))

        for b in batches:
            y = b["label"].to_numpy().astype(float)
            z, other = total(b["has"]), total(b["had"])
            loss = 1 / (1 + np.exp(-np.clip(z + w[-1], -500, 500))) - y
            change = 2 * penalty * (z - other)
            spread(b["has"], loss + change)
            spread(b["had"], -change)
            grad[-1] += loss.sum()
        yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()])], ["gradient"])

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = 1.0, ridge: float = 2e-4,
    support: float = 10, steps: int = 40, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> ToxicModel:
    """Fits on the bounded sample. Every feature whose share is greater among label 1 has a weight, and so have all identity
    terms; weights are 0 or more, so others would end at 0. The ridge is stronger for features of few texts (double at ``support``). Each of the ``steps`` sums gradients in Spark."""
    spark = docs.sparkSession
    sample = written(fit_sample(docs, labels, "toxic", fit_rows).select("text", "label"), "toxic-fit")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        share = min(max((ones + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
        return ToxicModel(float(np.log(share / (1 - share))), {})
    counts = map_batches(sample, _feature_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    kept = {r["feature"]: r["n"] for r in counts.filter(F.col("n1") * (n - ones) > F.col("n0") * ones).select("feature", (F.col("n0") + F.col("n1")).alias("n")).collect()}
    named = {t for row in terms for t in row}
    names = sorted(kept.keys() | features(named))
    shrink = ridge * (1 + (support / np.array([kept.get(f, 1) for f in names])) ** 2)
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    rows = written(sample.mapInArrow(_encoded(shared, swaps(terms)), "label int, has array<int>, had array<int>"), "toxic-features")
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(ones / (n - ones))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        now = spark.sparkContext.broadcast(w)
        parts = rows.mapInArrow(_gradients(now, len(w), penalty), "gradient binary").collect()
        grad = sum(np.frombuffer(bytes(r["gradient"])) for r in parts) / n
        grad[:-1] += shrink * w[:-1]
        first, second = 0.8 * first + 0.2 * grad, 0.95 * second + 0.05 * grad**2
        w = w - 0.25 * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
        now.destroy()
    return ToxicModel(float(w[-1]), {f: float(x) for f, x in zip(names, w, strict=False) if x})


def toxicity_scores(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null, empty and wordless texts have the score of
    the bias; repeated rows return a row each; other columns are ignored; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([own.score(t.as_py()) for t in b["text"]], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
