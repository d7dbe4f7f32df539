"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk
from .ftrl import Ftrl, Row, platt
from .langid import learnable

FEATURES = 1 << 20
#: Bounds of the labelled sample, by class: rows, and bytes of text; but at least so many rows.
SAMPLE_PER_CLASS, SAMPLE_BYTES, LEAST_ROWS = 4000, 24 << 20, 64
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def gram_buffers(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(feature numbers of words, pairs of neighbours and pairs with one word between, words' offsets).

    Words are lower-cased runs without white space or ASCII punctuation. Of the three arrays, the
    i-th entry belongs to the i-th word; a pair that would leave its document has the number FEATURES.
    """
    plain = np.where(_PUNCTUATION[data], np.uint8(0x20), data)
    words = bk.words_of(plain, offsets)
    h = bk.span_hashes(words.lower, words.starts, words.ends)
    n, out = len(h), []
    shift = np.uint64(64 - 20)
    for gap in range(3):
        g = np.full(n, FEATURES, dtype=np.int64)
        if gap == 0:
            g[:] = (h >> shift).astype(np.int64)
        elif n > gap:
            pair = bk.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(2 * gap + 1))
            g[:-gap] = (pair >> shift).astype(np.int64)
            for j in range(1, gap + 1):  # the last words of a document have no partner
                tail = words.first[1:] - j
                g[tail[tail >= words.first[:-1]]] = FEATURES
        out.append(g)
    return out, words.first


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights only: feature numbers in order, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(FEATURES + 1, dtype=np.float32)
        full[self.features] = self.weights
        return full


def score_buffers(table: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of class 1 of each document; a feature counts once however often it occurs."""
    n = len(offsets) - 1
    logit = np.full(n, bias)
    grams, first = gram_buffers(data, offsets)
    if len(grams[0]):
        keys = []
        for g in grams:
            at = np.flatnonzero(table[g])
            keys.append((np.searchsorted(first, at, side="right") - 1) * (FEATURES + 1) + g[at])
        unique = np.unique(np.concatenate(keys))
        np.add.at(logit, unique // (FEATURES + 1), table[unique % (FEATURES + 1)])
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def _features(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(0))
            out = []
            for i in range(len(off) - 1):
                grams, _ = gram_buffers(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                u = np.unique(np.concatenate(grams))
                out.append(u[u < FEATURES].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["y", "f"])
        bk.release_memory()

    got = [(r["y"], bytes(r["f"])) for r in rows.select("text", "y").mapInArrow(run, "y int, f binary").collect()]
    return [(y, np.frombuffer(f, np.int32).astype(np.int64)) for y, f in sorted(got)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, text_bytes: int = SAMPLE_BYTES, epochs: int = 2, l1: float = 4.0) -> ToxicityModel | None:
    """Learn from ``docs(id, text)`` and ``labels(id, y)`` (one row per id, y 0 or 1); None without labels.

    A sample of about ``per_class`` labels of each class is chosen by a hash of the id, fewer (down to
    LEAST_ROWS) if their texts have more than ``text_bytes``, and only its texts are gathered. Every fifth is kept back, and a logistic fit to those, weighted by the classes'
    shares among all labels, turns the model's sums into probabilities.
    """
    counts = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = {y: min(1.0, per_class / n) for y, n in counts.items()}
    rate = F.when(F.col("y") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    # about 2 * per_class pairs of an id and a class, whatever the corpus
    chosen = labels.where(unit < rate).select("id", "y").collect()
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in chosen], T.StructType([docs.schema["id"], T.StructField("y", T.IntegerType())]))
    sample = docs.join(F.broadcast(chosen), "id").select("id", "text", "y")
    for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect():
        if (r["bytes"] or 0) > text_bytes:
            share = max(LEAST_ROWS / r["n"], text_bytes / r["bytes"])
            rates[r["y"]] *= min(1.0, share)
            sample = sample.where((F.col("y") != r["y"]) | (unit < rates[r["y"]]))
    rows: list[Row] = [(f, np.full(len(f), 1.0), y) for y, f in _features(sample)]
    if not rows:
        return None
    held = rows[::5] if len(rows) >= 50 else []
    kept = [r for i, r in enumerate(rows) if i % 5] if held else rows
    w, bias = Ftrl(FEATURES, 2, alpha=0.3, l1=l1).learn(kept, epochs).weights()
    classes = np.array([y for _, _, y in held], dtype=int)
    logits = np.array([w[f, 0].sum() + bias[0] for f, _, _ in held])
    slope, shift = platt(logits, classes, np.where(classes == 1, 1 / rates.get(1, 1.0), 1 / rates.get(0, 1.0))) if held else (1.0, 0.0)
    at = np.flatnonzero(w[:, 0])
    return ToxicityModel(at, (slope * w[at, 0]).astype(np.float32), float(slope * bias[0] + shift))


def predict(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``docs(id, text)`` with ``score``; null and empty texts are scored by the bias, 0 without a model."""
    source = docs.select("id", "text")
    schema = T.StructType([source.schema["id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table() if model else None
        for batch in batches:
            data, off = bk.text_buffers(batch.column(1))
            scores = np.zeros(len(off) - 1)
            for a, b in bk.doc_chunks(off) if model else ():
                scores[a:b] = score_buffers(table, model.bias, data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])
        bk.release_memory()

    return source.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """``(id, score)`` for every row of ``docs``, learned from the labels that are not held out.

    Labels with a null id or class take no part; repeated labels of an id count once, 1 winning.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    y = F.when(F.col(label_col) == 1, 1).when(F.col(label_col) == 0, 0)
    known = labels.select(F.col(id_col).alias("id"), y.alias("y")).where(learnable("id") & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    return predict(rows, fit(rows, known, **options))
