"""Language identification by a string kernel.

Two texts are as alike as the n-grams (of 1 to 3 characters) that are present in both, over the geometric mean of those
in each. Landmark texts give the Nyström features of this kernel, and a ridge regression for each language against the
rest is solved on them. Texts are scored in blocks: presence matrix times landmark matrix times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, samples

ORDERS = 3
#: n-grams are told apart by a hash of so many bits.
HASH_BITS = 14
_BLOCK = 128
UNDETERMINED = "und"


def presence(texts: list[str | None]) -> np.ndarray:
    """A row of 0 and 1 per text: which n-grams its whole text has. Case does not count."""
    out = np.zeros((len(texts), 1 << HASH_BITS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        gram = c
        for n in range(ORDERS):
            if n:
                gram = gram[:-1] * np.uint32(0x01000193) + c[n:]
            x = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            out[i, x >> np.uint32(32 - HASH_BITS)] = 1
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # n-grams by landmarks, over the root of each one's count
    weights: np.ndarray  # landmarks by languages

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = presence(texts)
        kernel = (p @ self.landmarks) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
        s = kernel @ self.weights
        best = s.argmax(1)
        value = np.where(letters, np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0.0).astype(float)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], value


def train(docs: DataFrame, per_language: int = 300, landmarks: int = 64, most: int = 3000, ridge: float = 1e-2, folds: int = 3, held: int = 1) -> Model:
    """Learn from about per_language texts of each language outside the held-out fold, `most` in all. Only text and lang
    are used. Rows without text, lang or doc_id are no examples, and repeated rows are one; of several texts of a doc_id and
    language the one with the least hash counts. Of more than `most` languages the most frequent are learned, and each has
    a landmark at least."""
    rows = docs.where(F.col("lang").isNotNull() & (samples.fold(F.col("doc_id"), folds) != held) & (F.length("text") > 0)).select("doc_id", F.col("lang").cast("string").alias("lang")).distinct()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}  # `most` texts have no more languages
    if not counts:
        return Model([], np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros((0, 0)))
    landmarks = max(landmarks, len(counts))
    part = docs.sparkSession.createDataFrame([(lang, min(1.0, min(per_language, most / len(counts)) / n)) for lang, n in counts.items()], "lang string, part double")
    place = F.xxhash64("doc_id")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = rows.join(F.broadcast(part), "lang").withColumn("place", place).where((F.pmod("place", F.lit(1 << 30)) < F.col("part") * (1 << 30)) | (F.col("part") >= 1))
    picked = picked.withColumn("turn", turn).orderBy("turn", "place", "doc_id").limit(most).select("doc_id", "lang", "place")  # languages go round, so the limit leaves out none
    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0).join(F.broadcast(picked), ["doc_id", "lang"])  # `most` rows are broadcast
    texts = texts.groupBy("place", "doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                b = batch.slice(a, _BLOCK)
                yield common.with_columns(b, ["place", "lang"], bits=pa.array([r.tobytes() for r in np.packbits(presence(b.column("text").to_pylist()) > 0, axis=1)], pa.binary()))

    found = texts.select("place", "lang", "text").mapInArrow(bits, "place long, lang string, bits binary").toPandas().sort_values(["place", "lang", "bits"])
    if not len(found):
        return Model([], np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros((0, 0)))
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in found["bits"]]), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    lang = found["lang"].to_numpy()
    languages = sorted(set(lang))
    # landmarks go round the languages
    turn = found.groupby("lang").cumcount().to_numpy()
    marks = x[np.lexsort((lang, turn))[:landmarks]]
    among = (marks @ marks.T).astype(float)
    value, vector = np.linalg.eigh(among)
    good = value > value.max() * 1e-6
    root = vector[:, good] / np.sqrt(value[good])  # Nyström: features are kernel with landmarks times this
    z = (x @ marks.T).astype(float) @ root
    y = np.where(lang[:, None] == np.array(languages), 1.0, -1.0)
    solved = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]) / z.shape[1], z.T @ y)
    return Model(languages, np.ascontiguousarray(marks.T), root @ solved)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text. Texts that are null or without a letter
    are `und` with score 0; of languages with equal scores the first by name is taken; repeated rows get the same values;
    texts count whole, however long; other columns are not used; an empty table gives no rows, and where nothing could be
    learned all texts are `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**HASH_BITS times landmarks

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(a, _BLOCK)
                lang, value = model.score(part.column("text").to_pylist())
                yield common.with_columns(part, ["doc_id", "held_out"], lang_pred=pa.array(lang, pa.string()), score=value)

    held = F.coalesce(samples.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **parameters) -> DataFrame:
    return predict(docs, train(docs, **parameters))
