"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3-, 4- and 5-grams of the lower-cased text, present or absent. Each is scaled by the log ratio of its
smoothed document frequencies in either class, and a logistic regression is fitted on the scaled features. Fitting uses a bounded
sample of labelled rows (`per_class` of either label, those of least hash); scoring covers every whole text.

Defined results: null and empty texts have no features and so the intercept's score; a document with several labels counts as
toxic if one says so, and null labels are none; without labelled rows of both kinds every score is the share of toxic ones (0
without any); rows with a null id are scored and are not held out; rows that share an id are scored each by its own text, and each of
them is a sample of that id's label (at most per_class rows of a label are fitted).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import apart, arrow_map, crc_bucket

BITS, SIZES = 20, (3, 4, 5)
PER_CLASS = 2000
#: Features of fewer sampled documents, or with a smaller absolute log ratio, are left out.
LEAST_DOCS, LEAST_RATIO = 3, 1.0
HELD_OUT_PARTS = 5
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 16


class Grams:
    """The distinct hashed n-grams of a text."""

    def __init__(self) -> None:
        self.slot = np.zeros(1 << BITS, np.int32)

    def _distinct(self, hashes: np.ndarray) -> np.ndarray:
        at = np.arange(len(hashes), dtype=np.int32)
        self.slot[hashes] = at
        return hashes[self.slot[hashes] == at]

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[codes < 33] = 32
        found, reach = [], max(SIZES) - 1
        for start in range(0, max(1, len(codes) - reach), _PIECE):
            piece = codes[start : start + _PIECE + reach]
            hashes, parts = piece, []
            for n in range(2, max(SIZES) + 1):
                hashes = hashes[:-1] * _MULTIPLY + piece[n - 1 :]
                if n in SIZES:
                    parts.append((((hashes ^ (hashes >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64))
            found.append(self._distinct(np.concatenate(parts)))
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def fit(features: list[np.ndarray], labels: np.ndarray, rounds: int = 100, ridge: float = 0.01, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights by hashed feature (log-count ratio times fitted coefficient) and the intercept."""
    size = 1 << BITS
    weights, toxic = np.zeros(size, np.float32), labels == 1
    if not len(labels) or toxic.all() or not toxic.any():
        share = toxic.mean() if len(labels) else 0.0
        return weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    positive, negative = np.zeros(size), np.zeros(size)
    for found, is_toxic in zip(features, toxic, strict=True):  # features of a text are distinct
        (positive if is_toxic else negative)[found] += 1
    ratio = np.log((positive + 1) / (toxic.sum() + 2)) - np.log((negative + 1) / ((~toxic).sum() + 2))
    ratio[(positive + negative < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    live = np.flatnonzero(ratio)
    place = np.full(size, -1, np.int32)
    place[live] = np.arange(len(live))
    used = [(x := place[found])[x >= 0] for found in features]
    owner, at = np.repeat(np.arange(len(used)), [len(x) for x in used]), np.concatenate(used)
    scale, n = ratio[live], len(labels)
    balance = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    coefficients, momentum = np.zeros(len(live) + 1), np.zeros(len(live) + 1)
    for step in range(1, rounds + 1):
        effective = coefficients[:-1] * scale
        margin = np.bincount(owner, weights=effective[at], minlength=n) + coefficients[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic) * balance
        gradient = np.empty(len(live) + 1)
        gradient[:-1] = np.bincount(at, weights=error[owner], minlength=len(live)) * scale + ridge * coefficients[:-1]
        gradient[-1] = error.sum()
        momentum = 0.9 * momentum + 0.1 * gradient
        coefficients -= rate * momentum / (1 - 0.9**step)
    intercept = float(coefficients[-1])
    weights[live] = (coefficients[:-1] * scale).astype(np.float32)
    return weights, intercept


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Fits on the labelled rows that are not held out, at most per_class of each label, in one task."""
    known = labels.where("doc_id is not null and toxic is not null").where(crc_bucket(F.col("doc_id"), HELD_OUT_PARTS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("toxic") == label).orderBy(*order).limit(per_class) for label in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "labelled_id"))  # 2 * per_class rows at most
    rows_of = docs.join(chosen, F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("h"))
    first = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))  # an id may repeat in docs; each task keeps per_class rows of a label
    sample = rows_of.withColumn("nth", first).where(F.col("nth") <= per_class).select("doc_id", "text", "toxic").repartition(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams, seen = Grams(), []
        for batch in batches:
            for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                seen.append((doc_id, toxic, grams.of(text).astype(np.int32)))
        seen.sort(key=lambda x: (x[0], x[1], len(x[2])))
        weights, intercept = fit([x[2] for x in seen], np.array([x[1] for x in seen]))
        yield {"weights": [weights.tobytes()], "intercept": [intercept]}

    model = arrow_map(sample, rows, "weights binary, intercept double", pa.schema([("weights", pa.binary()), ("intercept", pa.float64())])).first()
    if model is None:  # no labelled rows, no task
        return fit([], np.zeros(0))
    return np.frombuffer(bytes(model.weights), np.float32), model.intercept


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """docs (with doc_id and text) and the column __score, in one pass that carries every row: no join, so rows may share an id."""
    weights, intercept = train(docs, labels.select("doc_id", "toxic"), per_class)
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, w = Grams(), model.value
        for batch in batches:
            margins = np.array([float(w[grams.of(text)].sum(dtype=np.float64)) for text in batch.column("text").to_pylist()]) + intercept
            score = pa.array(1 / (1 + np.exp(-np.clip(margins, -40, 40))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "__score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels has doc_id and toxic."""
    made = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels, per_class)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), HELD_OUT_PARTS) == 0, F.lit(False))
    return made.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic, with all columns. Rows are judged one by one, whatever ids they share or lack."""
    docs, back = apart(docs, ["doc_id", "text"])
    return back(scored(docs, labels).where("__score < 0.5"))
