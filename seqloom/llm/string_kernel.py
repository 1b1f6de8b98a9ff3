"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams for several n (presence, not counts), hashed to ``2 ** bits`` places. The
kernel of two texts is the size of the common set, normalised to 1 for equal texts. ``m`` landmark texts per language
span the feature space (Nyström): a text becomes its kernel values against the landmarks, whitened by their own kernel
matrix, and one ridge regression per language gives the scores. Batches of texts are scored by two matrix products.

The classifier is fitted on a bounded sample: the ``per_language`` labelled texts of each language with the smallest
hashed id (repeated rows are one text), of which the first ``landmarks`` are landmarks; at most ``languages`` languages, the most frequent ones.
Tasks send the driver packed n-gram sets of ``2 ** bits / 8`` bytes, whatever the length of a text. Prediction reads
whole texts and nothing else.

Texts are read lower-cased, with runs of anything but letters as one space. Null texts and texts without a letter are
``und`` with score 0, as are all if nothing could be learned. Repeated rows get equal results; ties go to the language
that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OTHER = regex.compile(r"\P{L}+")
_STEP = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Spectrum:
    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 15

    def places(self, text: str | None) -> np.ndarray | None:
        """Places of the n-grams of a text, with repeats; None without a letter."""
        letters = _OTHER.sub(" ", text.lower()).strip() if text else ""
        if not letters:
            return None
        c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        out = []
        for n in range(1, max(self.orders) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] + c[n - 1 :]) * _STEP
            h ^= h >> np.uint32(15)
            if n in self.orders:
                out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.bits))
        return np.concatenate(out)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Presence matrix and which texts have a letter."""
        out, known = np.zeros((len(texts), 1 << self.bits), np.uint8), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            p = self.places(t)
            if p is not None:
                out[i, p] = 1
                known[i] = True
        return out, known


@dataclass
class Model:
    """Landmark sets on the places they use, and the regression weights of their kernel values."""

    spectrum: Spectrum
    langs: list[str]
    used: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    sharpness: float = 8.0

    def kernel(self, sets: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(sets.sum(axis=1, dtype=np.int64), 1))
        common = sets[:, self.used].astype(np.float32) @ self.landmarks.T
        return common / np.outer(own, self.norms)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sets, known = self.spectrum.sets(texts)
        k = self.kernel(sets)
        raw = np.hstack([k, np.ones((len(k), 1))]) @ self.weights
        e = np.exp(self.sharpness * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        score = np.where(known, e[np.arange(len(e)), best] / e.sum(axis=1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], score


def fit_sets(spectrum: Spectrum, sets: np.ndarray, langs: list[str], landmarks: int, ridge: float) -> Model:
    """Nyström features of packed sets, then one ridge regression per language."""
    names = sorted(set(langs))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    chosen: list[int] = []
    for name in names:
        chosen += [i for i, a in enumerate(langs) if a == name][:landmarks]
    marks = np.unpackbits(sets[chosen], axis=1)
    used = np.flatnonzero(marks.any(axis=0))
    norms = np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.int64), 1))
    model = Model(spectrum, names, used, marks[:, used].astype(np.float32), norms, np.zeros(0))
    k = np.vstack([model.kernel(np.unpackbits(sets[i : i + 64], axis=1)) for i in range(0, len(sets), 64)])
    values, vectors = np.linalg.eigh(k[chosen])
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    x = np.hstack([k @ white, np.ones((len(k), 1))])
    # each language weighs the same, however many texts it has
    w = 1.0 / np.array([langs.count(a) for a in langs])
    w *= len(langs) / w.sum()
    solved = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
    model.weights = np.vstack([white @ solved[:-1], solved[-1:]])
    return model


def fit(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    spectrum: Spectrum = Spectrum(),
    per_language: int = 300,
    landmarks: int = 24,
    languages: int = 200,
    ridge: float = 1.0,
) -> Model | None:
    """A model of the labelled rows, or None if there are none."""
    named = rows.filter(F.col(lang).isNotNull() & F.col(key).isNotNull())
    top = named.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(languages)
    named = named.select(F.col(key).alias("_k"), F.col(text).alias("_x"), F.col(lang).alias("_l"), F.xxhash64(text).alias("_t"))
    top = top.select(F.col(lang).alias("_l"))
    # texts are ranked, not ids: rows that repeat an id, a language and a text are one, and one id may have several
    order = Window.partitionBy("_l").orderBy(F.xxhash64("_k"), "_k", "_t")
    ids = named.select("_k", "_l", "_t").distinct().join(F.broadcast(top), "_l")
    ids = ids.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language)
    # at most languages * per_language ids, and as many texts
    sample = named.join(F.broadcast(ids), ["_k", "_l", "_t"]).groupBy("_l", "_rank").agg(F.first("_x").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets, known = spectrum.sets(part.column(0).to_pylist())
                packed = [bytes(s) if k else None for s, k in zip(np.packbits(sets, axis=1), known)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(packed, pa.binary())], ["lang", "rank", "set"]
                )

    found = sample.select("_x", "_l", F.col("_rank").cast("long")).mapInArrow(run, "lang string, rank long, set binary")
    rows_ = found.filter(F.col("set").isNotNull()).toArrow().to_pylist()
    per: dict[str, list] = {}
    for r in sorted(rows_, key=lambda r: (r["lang"], r["rank"], r["set"])):
        if len(per.setdefault(r["lang"], [])) < per_language:
            per[r["lang"]].append(r["set"])
    langs = [a for a, s in per.items() for _ in s]
    if not langs:
        return None
    sets = np.frombuffer(b"".join(s for v in per.values() for s in v), np.uint8).reshape(len(langs), -1)
    return fit_sets(spectrum, sets, langs, landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = part.column(2).to_pylist()
                langs, score = sent.value.predict(texts) if sent.value else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs), pa.array(score, pa.float64())],
                    [key, "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(key), held_out.alias("held_out"), F.col(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
