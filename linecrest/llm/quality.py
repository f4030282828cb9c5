"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted as its words, whatever their case, and as n-grams of character classes: runs of lower-case letters,
capitals and digits count as one class each, every punctuation mark as itself; with these goes how often a word follows
itself. Both kinds of counts are weighted by tf-idf, made equally long, and projected on the leading singular vectors of
the labelled sample. A document's score is the share of label 1 among its
nearest labelled vectors, each weighted by a power of its cosine, and by how frequent its class is among the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, samples

#: Buckets of n-grams of classes, then of words.
SHAPES, WORDS = 2048, 2048
TERMS = SHAPES + WORDS
_REPEATS = np.array([0, 0.02, 0.1, 0.3, 0.6])
_BLOCK = 256


def _classes() -> bytes:
    table = bytearray(256)
    for b in range(256):
        c = chr(b)
        if 0x80 <= b < 0xC0:
            table[b] = 0  # continuation bytes belong to the byte before
        elif b >= 0xC0 or c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c in " \t\v\f\r":
            table[b] = 4
        elif c == "\n":
            table[b] = 5
        elif b > 32 and b < 127:
            table[b] = 6 + sum(1 for x in range(33, b) if not chr(x).isalnum())
        else:
            table[b] = 38
    return bytes(table)


_CLASSES = _classes()
#: Letters by byte (lower case, every byte of other alphabets); other bytes are 0 and part words.
_LETTERS = np.array([ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() else b if b >= 0x80 else 0 for b in range(256)], np.uint32)
_POWERS = np.cumprod(np.r_[1, np.full(1023, 0x01000193)].astype(np.uint32), dtype=np.uint32)


def word_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of every word, by a polynomial hash of its bytes."""
    letters = _LETTERS[data]
    inside = letters > 0
    if not inside.any():
        return np.empty(0, np.int64)
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    at = np.flatnonzero(inside)
    word = np.searchsorted(starts, at, "right") - 1
    values = letters[at] * _POWERS[(at - starts[word]) % len(_POWERS)]
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    return ((np.add.reduceat(values, heads, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)


def term_counts(texts: list[str | None]) -> np.ndarray:
    """A row of TERMS counts per text, over the whole text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        c = np.frombuffer(raw.translate(_CLASSES, bytes(range(0x80, 0xC0))), np.uint8)
        if not len(c):
            continue
        c = c[np.concatenate([[True], c[1:] != c[:-1]])].astype(np.uint32)
        total = np.zeros(SHAPES, np.int64)
        gram = c
        for n in range(4):
            if n:
                gram = gram[:-1] * np.uint32(64) + c[n:]
            if len(gram):
                total += np.bincount(((gram + np.uint32(n << 27)) * np.uint32(2654435761)) >> np.uint32(21), minlength=SHAPES)
        w = text.split()
        share = sum(map(eq, w, w[1:])) / max(1, len(w))
        total[int(np.searchsorted(_REPEATS, share, "right"))] += len(w) * 4
        out[i, :SHAPES] = total
        out[i, SHAPES:] = np.bincount(word_buckets(np.frombuffer(raw, np.uint8)), minlength=WORDS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithms of counts by idf, rows of length 1: shapes and words have the same share of it."""
    x = np.log1p(counts) * idf
    for part in (x[:, :SHAPES], x[:, SHAPES:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms by dimensions
    vectors: np.ndarray  # labelled documents by dimensions, of length 1
    votes: np.ndarray  # label of each, times its class weight
    weights: np.ndarray
    share: float
    neighbours: int
    power: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = weighted(counts, self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Exact cosines of a block of texts with all labelled vectors. Texts without terms get the share of label 1."""
        counts = term_counts(texts)
        if not len(self.vectors):
            return np.full(len(texts), self.share)
        near = self.project(counts) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        if k < near.shape[1]:
            # of equal cosines at place k the labelled vectors that come first in their fixed order count
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            rank = np.where(near > least, 2, np.where(near == least, 1, 0)) * near.shape[1] - np.arange(near.shape[1])
            best = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        else:
            best = np.tile(np.arange(k), (len(texts), 1))
        pull = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** self.power
        out = (pull * self.votes[best]).sum(1) / (pull * self.weights[best]).sum(1)
        return np.where(counts.any(1), np.clip(out, 0, 1), self.share).astype(float)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, dimensions: int = 64, neighbours: int = 25, power: float = 8.0) -> Model:
    """Learn from at most per_class labelled documents of each class outside the held-out fold; their term counts come
    to the driver (2 * per_class * TERMS numbers at most)."""
    sample = samples.labelled(docs, labels, label, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(a, _BLOCK)
                yield common.with_columns(part, ["place", "label"], counts=pa.array([r.tobytes() for r in term_counts(part.column("text").to_pylist())], pa.binary()))

    rows = sample.mapInArrow(count, "place long, label int, counts binary").toPandas().sort_values(["place", "label", "counts"])
    told = labels.where(F.col(label).isin(0, 1) & (samples.fold(F.col("doc_id"), 5) != 0)).agg(F.avg(F.col(label).cast("double")).alias("p")).collect()[0]["p"]
    share = float(told) if told is not None else 0.0
    y = rows["label"].to_numpy(np.float32)
    x = np.stack([np.frombuffer(c, np.float32) for c in rows["counts"]]) if len(rows) else np.zeros((0, TERMS), np.float32)
    keep = x.any(1)
    x, y = x[keep], y[keep]
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    z = weighted(x, idf)
    axes = np.random.default_rng(7).standard_normal((TERMS, dimensions + 8)).astype(np.float32)
    for _ in range(6 if len(z) else 0):  # subspace iteration
        axes, _ = np.linalg.qr(z.T @ (z @ axes))
    if len(z):
        _, _, vt = np.linalg.svd(z @ axes, full_matrices=False)
        axes = axes @ vt[:dimensions].T
    n1 = max(float(y.sum()), 1)
    n0 = max(float(len(y) - y.sum()), 1)
    weights = np.where(y == 1, share / n1, (1 - share) / n0).astype(np.float32)
    model = Model(idf, axes.astype(np.float32), np.zeros((0, dimensions), np.float32), y * weights, weights, share, neighbours, power)
    return Model(**(model.__dict__ | {"vectors": model.project(x) if len(x) else model.vectors}))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text, and the columns named by keep. Null and
    empty texts, and all texts where nothing could be learned, get the share of label 1; repeated rows get the same values;
    an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * per_class vectors, and the axes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(a, _BLOCK)
                s = model.score(part.column("text").to_pylist())
                yield common.with_columns(part, kept, score=s, predicted=(s >= threshold).astype(np.int32))

    held = F.coalesce(samples.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    kept = ["doc_id", "held_out", *(f"_keep_{c}" for c in keep)]
    rows = docs.select("doc_id", held, F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields) + ", score double, predicted int"
    out = rows.mapInArrow(apply, schema)
    return out.select("doc_id", "held_out", "score", "predicted", *(F.col(f"_keep_{c}").alias(c) for c in keep))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    return score(docs, train(docs, labels, **parameters))
