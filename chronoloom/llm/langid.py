"""Language identification: FTRL multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from . import bytekernel as bk
from .ftrl import Ftrl, Row, probabilities, temperature
from .storage import ARROW_ROWS, arrow_rows

UNDETERMINED = "und"
ORDERS = 3
FEATURES = 1 << 15
#: Features are term frequencies times this, so that steps have a usual size.
SCALE = 30.0
#: Bounds of the sample that the weights are fitted on, for each language: rows, and bytes of text; but at
#: least so many rows. Document frequencies cover all learnable rows.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES, LEAST_ROWS = 700, 8 << 20, 8

_tables: dict[str, np.ndarray] = {}


def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or a space for what is no letter (all of Unicode)."""
    if "fold" not in _tables:
        fold = np.full(0x110000, 0x20, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                fold[i] = ord(low) if len(low) == 1 else i
        _tables["fold"] = fold
    return _tables["fold"]


def ngram_buffers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram numbers of shape orders x characters, character offsets, has a letter).

    An n-gram that would leave its document has the number FEATURES.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    c = _folded()[codes]
    letters = np.zeros(len(c) + 1, dtype=np.int64)
    np.cumsum(c != 0x20, out=letters[1:])
    out = np.empty((ORDERS, len(c)), dtype=np.int32)
    h = np.zeros(len(c), dtype=np.uint32)
    for k in range(ORDERS):
        if k < len(c):
            h[: len(c) - k] = (h[: len(c) - k] ^ c[k:]) * np.uint32(0x9E3779B1)
        g = h ^ (h >> np.uint32(15))
        g = g * np.uint32(0x85EBCA77 + 2 * k)
        out[k] = g >> np.uint32(32 - 15)
        for j in range(1, k + 1):  # the last k characters of a document begin no such n-gram
            tail = at[1:] - j
            out[k][tail[tail >= at[:-1]]] = FEATURES
    return out, at, letters[at[1:]] > letters[at[:-1]]


def _segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        total[full] = np.add.reduceat(values, at[:-1][full])
    return total


def _document_frequency(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each n-gram) over all of ``rows(text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 2, dtype=np.int64)
        seen = np.zeros(FEATURES + 1, dtype=np.int8)
        for batch in batches:
            data, off = bk.text_buffers(batch.column(0))
            for a, b in bk.doc_chunks(off):
                grams, at, _ = ngram_buffers(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for i in range(b - a):
                    if at[i + 1] > at[i]:
                        seen[grams[:, at[i] : at[i + 1]]] = 1
                        total[:-1] += seen
                        seen[:] = 0
                total[-1] += b - a
        total[FEATURES] = 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["f", "n"])
        bk.release_memory()

    got = rows.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    out = np.zeros(FEATURES + 2)
    for r in got:
        out[r["f"]] = r["n"]
    return int(out[-1]), out[:FEATURES]


def _sample_rows(rows: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, n-gram numbers, term frequencies) of each row of ``rows(text, lang)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(0))
            idx, val = [], []
            for i in range(len(off) - 1):
                grams, _, _ = ngram_buffers(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                f, n = np.unique(grams[grams < FEATURES], return_counts=True)
                idx.append(f.astype(np.uint16).tobytes())
                val.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["lang", "idx", "val"])
        bk.release_memory()

    got = rows.select("text", "lang").mapInArrow(run, "lang string, idx binary, val binary").collect()
    out = [(r["lang"], np.frombuffer(bytes(r["idx"]), np.uint16).astype(np.int64), np.frombuffer(bytes(r["val"]), np.float32).astype(float)) for r in got]
    return sorted(out, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # columns x (FEATURES + 1), the idf and the scale folded in
    bias: np.ndarray
    temperature: float

    def score_buffers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, probability) of each document."""
        grams, at, letter = ngram_buffers(data, offsets)
        n = np.maximum(_segment_sums((grams < FEATURES).sum(axis=0, dtype=np.int64).astype(float), at), 1)
        logits = np.empty((len(at) - 1, len(self.weights)))
        for c, w in enumerate(self.weights):
            logits[:, c] = _segment_sums(w[grams].sum(axis=0), at) / n + self.bias[c]
        p = probabilities(logits / self.temperature)
        if len(self.languages) == 1:
            p = np.ones((len(p), 1))
        elif p.shape[1] == 1:
            p = np.hstack([1 - p, p])
        best = p.argmax(axis=1)
        return np.where(letter, best, -1), np.where(letter, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame, learnable: Column, per_language: int = SAMPLE_PER_LANGUAGE, text_bytes: int = SAMPLE_BYTES, epochs: int = 3, l1: float = 0.02, l2: float = 0.001) -> LanguageModel | None:
    """Learn from ``docs(id, text, lang)`` where ``learnable`` and lang is not null; None if there is nothing.

    Document frequencies count every learnable row, and every value of lang is learned: the model takes
    128 KB for each. The weights are fitted on a sample of about ``per_language`` rows of a language,
    fewer (down to LEAST_ROWS) if those have more than ``text_bytes`` of text, chosen by a hash of the
    id and the text; every fifth sampled row is kept back to fit the temperature.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each language
    if not counts:
        return None
    languages = tuple(sorted(r["lang"] for r in counts))
    number = {lang: i for i, lang in enumerate(languages)}
    wanted = {r["lang"]: max(LEAST_ROWS, min(per_language, text_bytes * r["n"] // max(r["bytes"] or 0, 1))) / r["n"] for r in counts}
    rates = docs.sparkSession.createDataFrame(list(wanted.items()), "lang string, rate double")
    unit = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        sample = _sample_rows(rows.join(F.broadcast(rates), "lang").where(unit < F.col("rate")))
        n_docs, df = _document_frequency(rows.select("text"))
    idf = np.where(df > 0, np.log((1 + n_docs) / (1 + df)) + 1.0, 0.0) * SCALE
    data: list[Row] = [(idx, val * idf[idx], number[lang]) for lang, idx, val in sample]
    if len(languages) == 1:
        return LanguageModel(languages, np.zeros((1, FEATURES + 1), np.float32), np.zeros(1), 1.0)
    held = data[::5] if len(data) >= 50 else []
    kept = [r for i, r in enumerate(data) if i % 5] if held else data
    w, bias = Ftrl(FEATURES, len(languages), alpha=0.5, l1=l1, l2=l2).learn(kept, epochs).weights()
    logits = np.array([val @ w[idx] + bias for idx, val, _ in held]).reshape(len(held), w.shape[1])
    t = temperature(logits, np.array([y for _, _, y in held], dtype=int))
    full = np.zeros((w.shape[1], FEATURES + 1), dtype=np.float32)
    full[:, :FEATURES] = (w * idf[:, None]).T
    return LanguageModel(languages, full, bias, t)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs(id, text)`` with ``lang_pred`` and ``score``; a text without a letter, and every text
    where there is no model, is ``und`` with score 0."""
    source = docs.select("id", "text")
    schema = T.StructType([source.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = bk.text_buffers(batch.column(1))
            names, scores = [UNDETERMINED] * (len(off) - 1), np.zeros(len(off) - 1)
            for a, b in bk.doc_chunks(off) if m is not None else ():
                best, score = m.score_buffers(data[off[a] : off[b]], off[a : b + 1] - off[a])
                scores[a:b] = score
                names[a:b] = [m.languages[i] if i >= 0 else UNDETERMINED for i in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])
        bk.release_memory()

    return source.mapInArrow(run, schema)


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo ``folds`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def learnable(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``(id, lang_pred, score)`` for every row, learned from the folds that are not held out.

    Rows with a null id are predicted but never learned from. An empty or unlabelled table gives
    ``und`` throughout.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return predict(rows, fit(rows, learnable("id"), **options))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score above ``least``, all columns kept.

    Rejected are null texts, texts without a letter, and every text if no row has a language to
    learn from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, learnable("id"), **options))

    def sure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for text in texts:
            data, off = bk.text_buffers(text)
            keep = np.zeros(len(text), dtype=bool)
            for a, b in bk.doc_chunks(off) if m is not None else ():
                best, score = m.score_buffers(data[off[a] : off[b]], off[a : b + 1] - off[a])
                keep[a:b] = (best >= 0) & (score > least)
            yield pa.array(keep)
        bk.release_memory()

    # only the texts go to Python; a verdict per row comes back
    return docs.where(F.arrow_udf(sure, "boolean", ArrowUDFType.SCALAR_ITER)(F.col(text_col).cast("string")))
