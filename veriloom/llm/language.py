"""Language of texts by string kernels: shared n-grams with landmark texts and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, held_out

#: Labelled rows learnt from at most (those whose id hashes lowest), and the landmarks among them.
SAMPLE_ROWS, LANDMARKS = 3000, 128
#: n-grams of 1 to ORDERS characters are hashed to 2^BITS places.
ORDERS, BITS = 4, 15
UNKNOWN = "und"

_LETTER = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16)
_ROWS = 256


def presence(text: str | None) -> np.ndarray | None:
    """Which hashed n-grams a whole text has, or None if it has no letter.

    Letters are lower-cased; what stands between words counts as one space,
    so n-grams know where words begin and end.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
    for c in np.unique(code[code > 0xFFFF]).tolist():
        if not chr(c).isalpha():
            letter &= code != c
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    space = np.array([32], dtype=np.uint64)
    code = np.concatenate([space, code, space[:0] if code[-1] == 32 else space])
    out = np.zeros(1 << BITS, dtype=np.uint8)
    gram = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, min(ORDERS, len(code)) + 1):
        gram = gram[:len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1:] + np.uint64(n)
        out[((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)] = 1
    return out


@dataclass
class Model:
    """Landmark presences scaled by their norms, and what turns kernel values into a value per language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """One value per language for rows of presences: one product with the landmarks and one with the weights."""
        return kernel(x, self.landmarks) @ self.weights + self.bias

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i in range(0, len(texts), _ROWS):
            rows = [(j, p) for j, p in enumerate(map(presence, texts[i:i + _ROWS]), i) if p is not None]
            if not rows or not self.languages:
                continue
            value = self.values(np.stack([p for _, p in rows]))
            odds = np.exp(5 * (value - value.max(1, keepdims=True)))
            best = value.argmax(1)
            for (j, _), b, o in zip(rows, best, odds):
                names[j], scores[j] = self.languages[b], o[b] / o.sum()
        return names, scores


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the root of the product of both counts; the landmarks are scaled already."""
    return (x.astype(np.float32) @ landmarks.T) / np.sqrt(np.maximum(1, x.sum(1, dtype=np.int64)))[:, None]


def fit_model(packed: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """One-versus-rest ridge regression on the Nyström map of the landmarks, which are spread over the languages."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros((0, 0)), np.zeros(0))
    bits = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    label = np.array([names.index(x) for x in languages])
    turn = np.zeros(len(label), dtype=np.int64)
    for c in range(len(names)):
        turn[label == c] = np.arange((label == c).sum())
    chosen = np.lexsort((label, turn))[:landmarks]
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(1, marks.sum(1)))[:, None]
    own, turned = np.linalg.eigh((marks @ marks.T).astype(float))
    root = turned @ np.diag(1 / np.sqrt(np.maximum(own, 1e-6))) @ turned.T
    z = np.concatenate([kernel(np.unpackbits(bits[i:i + _ROWS], axis=1), marks) for i in range(0, len(bits), _ROWS)]) @ root
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = len(label) / (len(names) * np.bincount(label, minlength=len(names)))[label]
    middle, level = np.average(z, axis=0, weights=share), np.average(y, axis=0, weights=share)
    zc = (z - middle) * share[:, None]
    coef = np.linalg.solve(zc.T @ (z - middle) + ridge * len(label) / landmarks * np.eye(z.shape[1]), zc.T @ (y - level))
    return Model(names, marks, (root @ coef).astype(np.float32), (level - middle @ coef).astype(np.float32))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model:
    """A model from at most ``sample_rows`` rows with a language that are not held out, four kilobytes of each."""
    bound_batches(docs.sparkSession)
    packed = F.pandas_udf(lambda texts: pd.Series([None if p is None else np.packbits(p).tobytes() for p in map(presence, texts)], dtype=object),
                          "binary")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), "text", "lang")
    chosen = known.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)  # ids first, so no text is moved
    sample = (known.join(F.broadcast(chosen), "_id").select("_id", "lang", packed("text").alias("p")).where("p is not null")
              .orderBy(F.xxhash64("_id"), "_id", "lang", "p").limit(sample_rows).toPandas())
    return fit_model(sample["p"].tolist(), sample["lang"].tolist(), landmarks)


def language(text: str | Column, model: Model) -> Column:
    """A struct (lang, score) for a text. Null texts and texts without a letter are ``und`` with score 0."""
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})

    return F.pandas_udf(predict, "lang string, score double")(text)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, repeated rows and null ids included.

    Whole texts are classified where they lie. Without a labelled row all are ``und``.
    """
    found = language("text", fit(docs, sample_rows, landmarks)).alias("found")
    return (docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), found)
            .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score"))
