"""Sampled signals from WAV and NPZ files, as long tables."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def parse_wav(data: bytes) -> tuple[int, np.ndarray] | None:
    """(sample rate, mono samples) of PCM 16/32 or float 32/64 in a RIFF file; None if it is anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if form[0] == 0xFFFE and size >= 26:
                form = (struct.unpack("<H", data[at + 32 : at + 34])[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or body is None:
        return None
    kinds = {(1, 16): ("<i2", 32768.0), (1, 32): ("<i4", 2147483648.0), (3, 32): ("<f4", 1.0), (3, 64): ("<f8", 1.0)}
    if (form[0], form[5]) not in kinds or not form[1]:
        return None
    kind, scale = kinds[form[0], form[5]]
    frame = np.dtype(kind).itemsize * form[1]
    x = np.frombuffer(body[: len(body) // frame * frame], dtype=kind).astype(float).reshape(-1, form[1])
    return form[2], x.mean(axis=1) / scale


def parse_f0(data: bytes, times: str = "times", values: str = "f0", hop: str = "hop_seconds") -> tuple[np.ndarray, np.ndarray]:
    """(times, frequencies) of an NPZ file: its times, else the frame numbers by its hop."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        f0 = np.asarray(z[values if values in z else "f0_hz"], dtype=float)
        if times in z:
            t = np.asarray(z[times], dtype=float)
        elif hop in z:
            t = np.arange(len(f0)) * float(z[hop])
        else:
            raise ValueError("neither times nor a hop")
    if t.shape != f0.shape:
        raise ValueError(f"{t.shape} times for {f0.shape} values")
    return t, f0


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono RIFF file of 16-bit PCM; samples beyond -1 to 1 are cut."""
    pcm = np.clip(np.rint(np.asarray(samples, dtype=float) * 32768), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + head + b"data" + struct.pack("<I", len(pcm)) + pcm


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``samples`` at another rate: a windowed-sinc filter at the lower of both half rates, evaluated at
    the new times only. The first sample stays at time 0."""
    if rate == to or not len(samples):
        return np.asarray(samples, dtype=float)
    low = min(rate, to) / rate
    half = 16 / low
    n = -(-len(samples) * to // rate)
    out = np.empty(n)
    for a in range(0, n, 1 << 14):
        t = np.arange(a, min(a + (1 << 14), n)) * (rate / to)
        near = np.floor(t).astype(np.int64)[:, None] + np.arange(-int(half), int(half) + 2)
        x = near - t[:, None]
        weight = np.sinc(x * low) * np.where(np.abs(x) < half, 0.5 + 0.5 * np.cos(np.pi * x / half), 0.0)
        inside = (near >= 0) & (near < len(samples))
        weight = np.where(inside, weight, 0.0)
        out[a : a + len(t)] = (weight * np.asarray(samples)[np.clip(near, 0, len(samples) - 1)]).sum(axis=1) * low
    return out


def _parts(files: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows_of(name, body)

    return files.select("path", "content").mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def samples_of(files: DataFrame, chunk: int = 1 << 16, to: int | None = None) -> DataFrame:
    """``(path, rate, i, y)``: the samples of every readable WAV file of ``files(path, content)``, at the rate ``to`` if given."""

    def rows(name: str, body: bytes) -> Iterator[pa.RecordBatch]:
        got = parse_wav(body)
        if got is None:
            return
        rate, all_ = got if to is None else (to, resampled(got[1], got[0], to))
        for a in range(0, len(all_), chunk):
            y = all_[a : a + chunk]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), pa.array(np.full(len(y), rate, np.int32)), pa.array(np.arange(a, a + len(y))), pa.array(y)], names=["path", "rate", "i", "y"])

    return _parts(files, "path string, rate int, i long, y double", rows)


def read_wav(spark: SparkSession, path: str, chunk: int = 1 << 16, to: int | None = None) -> DataFrame:
    """``samples_of`` the files under ``path``; others than WAV give no rows."""
    return samples_of(_files(spark, path), chunk, to)


def frequencies_of(files: DataFrame) -> DataFrame:
    """``(path, frame, t, f0)`` of NPZ ``files(path, content)``; unvoiced and non-finite frequencies are null."""

    def rows(name: str, body: bytes) -> Iterator[pa.RecordBatch]:
        t, f0 = parse_f0(body)
        known = np.isfinite(f0) & (f0 > 0)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(np.arange(len(t))), pa.array(t), pa.array(f0, mask=~known)], names=["path", "frame", "t", "f0"])

    return _parts(files, "path string, frame long, t double, f0 double", rows)


def read_f0(spark: SparkSession, path: str) -> DataFrame:
    """``frequencies_of`` the files under ``path``."""
    return frequencies_of(_files(spark, path))
