"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams of 1 to 3 that both have, over the square root of the numbers that
each has: a blended-spectrum presence kernel. Landmarks are training texts, drawn evenly from the languages; an n-gram that no
landmark has adds nothing to a kernel value, so only theirs are looked at. Kernel ridge regression in the landmarks' Nyström
space, one language against the rest, gives the weights. Scoring multiplies a batch's presence matrix with the landmarks' and
the result with the weights.

Null text or no letter: `und`, score 0. Texts without a known n-gram: the first language in order, with an even score. No training
row at all: everything is `und`. A null doc_id keeps its row and isn't held out; repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, few_of_each, held_out, per_text

#: Training rows for each language, at most, and landmarks among them.
ROWS_A_LANGUAGE, LANDMARKS_A_LANGUAGE = 600, 40
LONGEST, BUCKET_BITS, RIDGE, SHARPNESS = 3, 20, 1.0, 6.0
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a lower-cased whole text, with repeats; 2**20 buckets, so that two n-grams seldom share one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    code, out = points + np.uint64(1), []
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = code[:-1] * np.uint64(1 << 21) + points[n - 1 :] + np.uint64(1) if len(code) else code
        out.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS))
        if len(code) < 2:
            break
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each bucket; the last column gathers the n-grams that no landmark has
    landmarks: np.ndarray  # presence over the root of its sum: n-grams x landmarks
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def presence(self, texts: list[str]) -> np.ndarray:
        n = len(self.landmarks)
        out = np.zeros((len(texts), n + 1), np.float32)
        for row, t in zip(out, texts):
            row[self.column[grams(t)]] = 1
        return out[:, :n]

    def kernel(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def probabilities(self, texts: list[str], batch: int = 256) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for i in range(0, len(texts), batch):
            z = SHARPNESS * (self.kernel(texts[i : i + batch]) @ self.weights + self.bias)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS_A_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Texts in a fixed order; the first `landmarks` of each language with a letter are the landmarks."""
    languages = sorted(set(langs))
    chosen = [t for lang in languages for t in [t for t, x in zip(texts, langs) if x == lang][:landmarks]]
    seen = [np.unique(grams(t)) for t in chosen]
    known = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
    column = np.full(1 << BUCKET_BITS, len(known), np.int32)
    column[known] = np.arange(len(known))
    marks = np.zeros((len(known), len(chosen)), np.float32)
    for j, g in enumerate(seen):
        marks[column[g], j] = 1 / np.sqrt(max(len(g), 1))
    model = Model(languages, column, marks, np.zeros((len(chosen), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    if not chosen:
        return model
    k = np.concatenate([model.kernel(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(float)
    among = model.kernel(chosen).astype(float)
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
    # languages weigh alike, whatever their shares
    share = np.array([1 / langs.count(x) for x in langs])[:, None] * len(langs) / len(languages)
    mean = (share * y).sum(axis=0) / share.sum()
    left = k.T @ (share * k) + ridge * among + 1e-6 * np.eye(len(chosen))
    model.weights[:] = np.linalg.solve(left, k.T @ (share * (y - mean)))
    model.bias[:] = mean
    return model


def trained(docs: DataFrame, rows: int = ROWS_A_LANGUAGE) -> Model:
    """From documents with a language that aren't held out: for each language at most `rows`, by a hash of their ids."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    chosen = few_of_each(known, "lang", ["doc_id"], rows).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").rlike(r"\p{L}"))
    got = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "lang").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' n-grams

    def measure(texts: list[bytes]) -> list:
        m, decoded = shared.value, [t.decode("utf-8", "replace") for t in texts]
        told = [any(map(str.isalpha, t)) and bool(m.languages) for t in decoded]
        p = m.probabilities([t for t, x in zip(decoded, told) if x])
        best = iter([(m.languages[i], float(min(1.0, max(0.0, row[i])))) for row, i in zip(p, p.argmax(axis=1) if len(p) else [])])
        return list(zip(*[next(best) if x else (UNKNOWN, 0.0) for x in told]))

    return per_text(docs, measure, "lang_pred string, score double", keep, text)


def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs, trained(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
