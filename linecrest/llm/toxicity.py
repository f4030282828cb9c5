"""Toxicity: a logistic classifier of words, regularised by counterfactuals.

Labelled sentences that name a group are copied with each other group of the same kind in its place. The classifier pays
for every change of its score between a text and its copies, so mentions of a group carry no weight of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, samples

#: Terms that name groups, by kind; those of a kind are swapped with one another (fixed values of this classifier).
IDENTITY_TERMS = {
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists sikh sikhs atheist atheists catholic catholics".split(),
    "origin": "african american asian european arab mexican chinese indian latino hispanic immigrant immigrants refugee refugees foreigner foreigners".split(),
    "colour": "black white brown".split(),
    "gender": "woman women man men girl girls boy boys female male transgender trans".split(),
    "orientation": "gay lesbian bisexual straight queer homosexual heterosexual".split(),
    "ability": "disabled blind deaf autistic paralyzed".split(),
    "age": "old young elderly teenage".split(),
}
_KIND = {t: k for k, terms in IDENTITY_TERMS.items() for t in terms}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


#: Word beginnings of so many characters count as terms of their own, as `begin*`.
BEGINNINGS = (3, 4, 5, 6, 7)


def words(text: str | None) -> Counter:
    """The words of a whole text, in lower case, and how often each stands there."""
    return Counter(_WORD.findall((text or "").lower()))


def terms(found: Iterable[str]) -> set[str]:
    """Words and their beginnings."""
    out = set(found)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in found if len(w) > n])
    return out


#: A term whose share of the words is this much or more counts as fully dense.
DENSE = 0.02


def numbers(word: str, index: dict[str, int]) -> list[int]:
    """The numbers of a word and of its beginnings, as far as they are terms."""
    return [i for t in (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)) if (i := index.get(t)) is not None]


def features(found: Counter, index: dict[str, int]) -> dict[int, float]:
    """By number: 1 for each term that is there, and how dense it is (0 to 1) at its number plus the number of terms."""
    counts: dict[int, int] = {}
    for w, n in found.items():
        for i in numbers(w, index):
            counts[i] = counts.get(i, 0) + n
    total = DENSE * max(1, found.total()) if counts else 1
    return {i: 1.0 for i in counts} | {len(index) + i: min(1.0, n / total) for i, n in counts.items()}


def swaps(text: str | None) -> list[tuple[str, str, int]]:
    """The counterfactuals of a text as (term, other, times): in a sentence that says an identity term so many times each
    other one of its kind is put in its place."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        said = words(sentence)
        for term in sorted(said.keys() & _KIND.keys()):
            out += [(term, other, said[term]) for other in IDENTITY_TERMS[_KIND[term]] if other != term]
    return out


def change(found: Counter, swap: tuple[str, str, int], index: dict[str, int]) -> dict[int, float]:
    """By how much a swap moves the features of a text of these words; only those of the two words can move."""
    term, other, times = swap
    total, out = DENSE * max(1, found.total()), {}
    stems = {f"{w[:k]}*" for w in (term, other) for k in BEGINNINGS if len(w) > k}
    for t in {term, other, *stems}:
        i = index.get(t)
        if i is None:
            continue
        has = (lambda w: w == t) if not t.endswith("*") else (lambda w: len(w) > len(t) - 1 and w.startswith(t[:-1]))
        moved = times * (has(other) - has(term))
        if moved:
            old = sum(n for w, n in found.items() if has(w))
            new = old + moved
            for at, delta in ((i, float(new > 0) - float(old > 0)), (len(index) + i, min(1.0, new / total) - min(1.0, old / total))):
                if delta:
                    out[at] = delta
    return out


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray  # of terms, then of their densities
    bias: float

    def score(self, text: str | None) -> float:
        found = features(words(text), self.index)
        z = self.bias + sum(v * self.weights[i] for i, v in sorted(found.items()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _evidence(sample: DataFrame, least_documents: int, least_z: float, most_words: int) -> list[str]:
    """The terms whose rates in the two classes differ most, by a two-proportion z of at least least_z."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [sorted(terms(words(t))) for t in batch.column("text").to_pylist()]
            yield common.repeat_rows(batch, ["label"], np.array([len(x) for x in found], np.int64), word=pa.array([w for x in found for w in x], pa.string()))

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return []
    counts = sample.select("text", "label").mapInArrow(split, "label int, word string").groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k1"))
    rate = F.col("n") / (n0 + n1)
    z = (F.col("k1") / n1 - (F.col("n") - F.col("k1")) / n0) / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + F.lit(1e-12))
    best = counts.where(F.col("n") >= least_documents).withColumn("z", z).where(F.abs("z") >= least_z)
    found = [(r["word"], r["z"]) for r in best.orderBy(F.abs("z").desc(), "word").limit(most_words).collect()]
    # a word and its beginnings say much the same: the one that tells most stays, the longest among equals
    kept: dict[str, bool] = {}  # False: a longer or shorter form of it is kept
    for term, _ in sorted(found, key=lambda x: (-round(abs(x[1]), 6), -len(x[0].rstrip("*")), x[0])):
        stem = term.rstrip("*")
        shorter = any(kept.get(stem[:n] + "*") for n in range(1, len(stem) + 1))
        longer = term.endswith("*") and any(ok and t.startswith(stem) for t, ok in kept.items())
        kept[term] = not shorter and not longer
    return sorted(t for t, ok in kept.items() if ok)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, least_documents: int = 5, least_z: float = 4.0, most_words: int = 2000, swap_penalty: float = 1.0, ridge: float = 1e-3) -> Model:
    """Learn from at most per_class labelled documents of each class outside the held-out fold. Without examples of
    both classes every score is the share of label 1, or 0."""
    sample = samples.labelled(docs, labels, "toxic", per_class)
    told = labels.where(F.col("toxic").isin(0, 1) & (samples.fold(F.col("doc_id"), 5) != 0)).agg(F.avg(F.col("toxic").cast("double")).alias("p")).collect()[0]["p"]
    share = min(max(float(told or 0), 1e-6), 1 - 1e-6)
    vocabulary = _evidence(sample, least_documents, least_z, most_words)
    if not vocabulary:
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    vocabulary = sorted({*vocabulary, *_KIND})
    index = {w: i for i, w in enumerate(vocabulary)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [dict(sorted(features(words(t), index).items())) for t in batch.column("text").to_pylist()]
            yield common.with_columns(batch, ["place", "label"], at=pa.array([list(x) for x in found], pa.list_(pa.int32())), value=pa.array([list(x.values()) for x in found], pa.list_(pa.float64())))

    def pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of products of two features' changes over all counterfactuals of a task."""
        products: Counter = Counter()
        for batch in common.slices(batches):
            for text in batch.column("text").to_pylist():
                found, times = words(text), Counter(swaps(text))
                for swap, n in times.items():
                    moved = list(change(found, swap, index).items())
                    for i, x in moved:
                        for j, y in moved:
                            products[i, j] += n * x * y
        keys = list(products)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([products[k] for k in keys], pa.float64())], ["i", "j", "v"])

    rows = sample.select("place", "label", "text").mapInArrow(present, "place long, label int, at array<int>, value array<double>").collect()  # 2 * per_class rows of features
    rows.sort(key=lambda x: (x["place"], x["label"], x["at"], x["value"]))
    # features of identity terms and their beginnings only, whatever the texts say
    pairs = sample.select("text").mapInArrow(pulled, "i int, j int, v double").groupBy("i", "j").agg(F.round(F.sum("v"), 9).alias("v")).collect()
    pairs.sort()
    y = np.array([r["label"] for r in rows], float)
    n = len(y)
    r = np.repeat(np.arange(n), [len(x["at"]) for x in rows])
    c, v = (np.array([z for x in rows for z in x[key]], kind) for key, kind in (("at", np.int64), ("value", float)))
    gi, gj, gv = (np.array([p[k] for p in pairs], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, float)))
    weight = np.where(y == 1, n / 2 / max(y.sum(), 1), n / 2 / max(n - y.sum(), 1))  # both classes weigh the same
    w, bias = np.zeros(2 * len(vocabulary)), 0.0
    speed, bias_speed = np.zeros_like(w), 0.0
    # the step is one over a bound of the curvature
    size = np.bincount(r, v * v, n) + 1
    moved = float(gv[gi == gj].sum())
    step = 1 / (0.25 * float((weight * size).mean()) + ridge + 2 * swap_penalty * moved / n)
    for _ in range(800):  # gradient descent with momentum
        z = np.bincount(r, v * w[c], n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        down = np.bincount(c, v * error[r], len(w)) + ridge * w
        if len(gi):  # of swap_penalty / n times the sum of squared changes
            down += 2 * swap_penalty / n * np.bincount(gi, gv * w[gj], len(w))
        speed, bias_speed = 0.9 * speed - step * down, 0.9 * bias_speed - step * error.sum()
        w, bias = w + speed, bias + bias_speed
    return Model(index, w, float(bias))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text. Null and empty texts have no words, so
    their score is that of the bias; repeated rows get the same values; texts count whole, however long; other columns are
    not used; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_words and the identity terms at most

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.slices(batches):
            s = np.array([model.score(t) for t in batch.column("text").to_pylist()], float)
            yield common.with_columns(batch, ["doc_id", "held_out"], score=s, predicted=(s >= threshold).astype(np.int32))

    held = F.coalesce(samples.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    return score(docs, train(docs, labels, **parameters))
