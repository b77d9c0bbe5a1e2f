"""Language identification with a string kernel.

A text is the set of its character n-grams of lengths 1 to ``MAX_N`` (blended spectrum, presence
only), taken from lower-cased text in which everything but letters is one blank, and hashed
into ``BUCKETS`` places. The kernel of two texts is the number of shared places over the root of the product of
their set sizes. Nystrom features come from landmark texts, and a ridge regression per language
is solved on them in closed form. Scoring is two matrix products per batch: presence matrix times
landmarks, kernel times weights.

Whether a text is in a learned language at all is not told by the scores, which only share out 1 among the languages. Its evidence is the
mean logarithm, over its places, of the share of a language's sample texts that have the place, for the language where that is highest. The least evidence is
calibrated on the sample, each text against the others: one and a quarter times as far below the lowest hundredth as that lies below the median.

The model is fitted on a bounded sample: about ``SAMPLE_PER_LANGUAGE`` training rows of each language,
chosen by a hash of text and id, so the same rows whatever the cluster does. All counts behind
the choice cover all rows, and every row is scored on its whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any usable training row
every text is ``und``; rows with a null language or id are not trained on (a null id is not held out);
one language only gives that language everywhere; of a language with a single sample text no evidence is calibrated; equal scores go to the first language in sorted
order; a repeated row gives a row each time; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.words import slices

MAX_N = 3
BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-3
SHARPNESS = 8.0
UNSEEN = 0.01
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint32(0x9E3779B1)


def _letters(text: bytes | None) -> str:
    if not text:
        return ""
    plain = _NO_LETTERS.sub(" ", text.decode("utf-8", "replace").lower()).strip()
    return f" {plain} " if any(c.isalpha() for c in plain[:64]) or any(c.isalpha() for c in plain) else ""


def presence(texts: list[bytes | None], max_n: int = MAX_N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows of ``buckets`` places, and which texts have letters."""
    plain = [_letters(t) for t in texts]
    out = np.zeros((len(texts), buckets), np.float32)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(plain), dtype=np.int64), sizes)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, max_n + 1):
        count = len(codes) - n + 1
        if count <= 0:
            break
        gram = (gram[:count] + codes[n - 1 :] + np.uint32(n)) * _MIX
        gram ^= gram >> np.uint32(15)
        same = row[:count] == row[n - 1 :]
        place = ((gram * _MIX) >> shift).astype(np.int64)
        out.ravel()[(row[:count] * buckets + place)[same]] = 1.0
    return out, sizes > 0


def training_rows(documents: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language, and a checksum of the id that is not held out."""
    return documents.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


class Model:
    """Landmarks, weights, shares of places and least evidence; ``score`` gives language indices and scores of a batch of texts."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, shares: np.ndarray, least: float):
        self.languages, self.landmarks, self.weights, self.shares, self.least = languages, landmarks, weights, shares, least

    def parts(self) -> tuple:
        return self.languages, self.landmarks, self.weights, self.shares, self.least

    @staticmethod
    def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(rows.sum(1, dtype=np.float64))[:, None] * np.sqrt(landmarks.sum(1, dtype=np.float64))[None, :]
        return (rows @ landmarks.T) / np.maximum(sizes, 1.0)

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list[str], per_language: int, ridge: float) -> Model:
        languages = sorted(set(labels))
        index = np.array([languages.index(x) for x in labels], np.int64)
        chosen = np.concatenate([np.flatnonzero(index == k)[:per_language] for k in range(len(languages))])
        landmarks = rows[chosen]
        among = cls.kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        good = values > 1e-6 * values[-1]
        to_features = vectors[:, good] / np.sqrt(values[good])
        features = cls.kernel(rows, landmarks) @ to_features
        targets = np.where(index[:, None] == np.arange(len(languages)), 1.0, -1.0)
        # Each language weighs the same, however many rows of it were drawn.
        weight = 1.0 / np.bincount(index, minlength=len(languages))[index]
        gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
        solved = np.linalg.solve(gram, features.T @ (targets * weight[:, None]))
        model = cls(languages, landmarks, to_features @ solved, np.stack([rows[index == k].mean(0) for k in range(len(languages))]), -np.inf)
        model.least = model._least(rows, index)
        return model

    def _least(self, rows: np.ndarray, index: np.ndarray) -> float:
        counts = np.bincount(index, minlength=len(self.languages))
        own = np.full(len(rows), -np.inf)
        for k in np.flatnonzero(counts > 1):
            # Each row against the others of its language: a place that it has itself counts one row less.
            seen = np.log((self.shares[k] * counts[k] - 1).clip(0) / (counts[k] - 1) + UNSEEN)
            own[index == k] = rows[index == k] @ seen / rows[index == k].sum(1)
        own = own[np.isfinite(own)]
        if not len(own):
            return -np.inf
        low, median = np.quantile(own, [0.01, 0.5])
        return float(low - 1.25 * (median - low))

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ np.log(self.shares + UNSEEN).T / np.maximum(rows.sum(1, keepdims=True), 1.0)).max(1)

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = self.kernel(rows, self.landmarks) @ self.weights
        best = margins.argmax(1)
        e = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)) / 2)
        return best, e.max(1) / e.sum(1)


def fit_language_model(
    documents: DataFrame,
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
    ridge: float = RIDGE,
) -> Model | None:
    """Fit on at most about ``sample_per_language`` rows per language; None without any."""
    rows = training_rows(documents).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_language / n))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, budget=256 << 10):
            found, lettered = presence(texts)
            keep = np.flatnonzero(lettered)
            bits = [x.tobytes() for x in np.packbits(found[keep].astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(bits, pa.binary())],
                names=["lang", "draw", "bits"],
            )

    drawn = (
        rows.withColumn("draw", draw)
        .filter(F.col("draw") < share[F.col("lang")])
        .select("lang", "draw", "text")
        .mapInArrow(pack, "lang string, draw double, bits binary")
        .toPandas()
        .sort_values(["draw", "bits"])
    )
    if drawn.empty:
        return None
    sample = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in drawn["bits"]]).astype(np.float32)
    return Model.fit(sample, drawn["lang"].tolist(), landmarks_per_language, ridge)


def identify_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    model = model or fit_language_model(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model and model.parts())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value) if shared.value else None
        names = np.array(fitted.languages + [UNKNOWN], object) if fitted else np.array([UNKNOWN], object)
        for batch, texts in slices(batches, budget=512 << 10):
            for start in range(0, len(texts), 512):
                part = batch.slice(start, 512)
                rows, lettered = presence(texts[start : start + 512])
                if fitted:
                    best, score = fitted.score(rows)
                    best, score = np.where(lettered, best, len(names) - 1), np.where(lettered, score, 0.0)
                else:
                    best, score = np.zeros(len(rows), np.int64), np.zeros(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return (
        documents.select("doc_id", F.col("text").cast("string").alias("text"))
        .mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")
        .select(
            "doc_id",
            F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
            "lang_pred",
            "score",
        )
    )


def with_known_language(documents: DataFrame) -> DataFrame:
    """``documents`` without the rows whose language cannot be told; ``lang`` is the recognised one, the other columns are unchanged.

    Rejected are texts without a letter (``und``) and those with less than the least evidence of a learned language. Where no
    model could be fitted, only texts without a letter go, and ``lang`` stays.
    """
    model = fit_language_model(documents)
    place = [c.lower() for c in documents.columns].index("lang")
    shared = documents.sparkSession.sparkContext.broadcast(model and model.parts())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value) if shared.value else None
        for batch, texts in slices(batches, budget=512 << 10):
            for start in range(0, len(texts), 512):
                rows, good = presence(texts[start : start + 512])
                part = batch.slice(start, 512)
                if fitted:
                    good = good & (fitted.evidence(rows) >= fitted.least)
                    names = pa.array([fitted.languages[k] for k in fitted.score(rows)[0]], pa.string())
                    part = part.set_column(place, part.schema.field(place), names.cast(part.schema.field(place).type))
                yield part.take(pa.array(np.flatnonzero(good)))

    return documents.mapInArrow(keep, documents.schema)


def accuracy(predicted: DataFrame, documents: DataFrame) -> pd.Series:
    """Share of right predictions among held-out and other rows with a language (for tests and reports)."""
    both = predicted.join(documents.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL")
    return both.groupBy("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right")).toPandas().set_index("held_out")["right"]
