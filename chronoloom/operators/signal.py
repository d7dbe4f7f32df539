"""Framed statistics over sampled signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bridge_gaps(frames: DataFrame, value: str, max_gap: int, tolerance: float, key: str = "track_id", frame: str = "frame") -> DataFrame:
    """Short inner gaps between close values filled linearly."""
    from .asof import fill_linear

    return fill_linear(frames, value, key, frame, max_gap, tolerance)


def median_smooth(frames: DataFrame, value: str, window: int, out: str, key: str = "track_id", frame: str = "frame") -> DataFrame:
    """Centred median of the known values, only where a value is known."""
    r = window // 2
    w = W.partitionBy(key).orderBy(frame).rowsBetween(-r, r)
    return frames.withColumn(out, F.when(F.col(value).isNotNull(), F.percentile(value, 0.5).over(w)))


def smooth_voiced(frames: DataFrame, value: str, out: str, key: str = "track_id", frame: str = "frame") -> DataFrame:
    """Median of three with unknown values counted as 0, kept where known and positive; edges repeat."""
    order = W.partitionBy(key).orderBy(frame)
    v = F.coalesce(F.col(value), F.lit(0.0))
    a, b = F.coalesce(F.lag(v).over(order), v), F.coalesce(F.lead(v).over(order), v)
    mid = F.greatest(F.least(a, v), F.least(F.greatest(a, v), b))
    return frames.withColumn(out, F.when(F.col(value).isNotNull() & (mid > 0), mid))


def frame_rms_db(samples: DataFrame, size: int, hop: int, value: str = "y", key: str = "track_id", index: str = "frame", reference: float = 0.95) -> DataFrame:
    """``(key, start, rms, db)``: RMS of sliding frames in dB against a percentile of the frames' RMS.

    A signal shorter than a frame is one frame, zero-padded.
    """
    order = W.partitionBy(key).orderBy(index)
    n = F.count("*").over(W.partitionBy(key))
    energy = F.sum(F.col(value) * F.col(value)).over(order.rowsBetween(0, size - 1))
    at = samples.withColumn("_i", F.row_number().over(order) - 1).withColumn("_e", energy).withColumn("_n", n)
    heads = at.where((F.col("_i") % hop == 0) & ((F.col("_i") + size <= F.col("_n")) | ((F.col("_i") == 0) & (F.col("_n") < size))))
    rms = heads.select(key, F.col(index).alias("start"), F.sqrt(F.col("_e") / size).alias("rms"))
    ref = rms.groupBy(key).agg(F.percentile("rms", reference).alias("ref"))
    return rms.join(ref, key).select(key, "start", "rms", (20.0 * F.log10(F.greatest("rms", F.lit(1e-9)) / F.greatest("ref", F.lit(1e-9)))).alias("db"))


def longest_run(frames: DataFrame, groups: list[str], t: str, hop: float, slack: float = 1.75) -> DataFrame:
    """Longest run of rows no more than ``slack`` hops apart: ``(groups, n_frames, start)``, first of equals."""
    order = W.partitionBy(*groups).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(order) > slack * hop).cast("int"), F.lit(1))
    runs = frames.withColumn("_n", new).withColumn("_g", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    sized = runs.groupBy(*groups, "_g").agg(F.count("*").alias("n"), F.min(t).alias("s"))
    best = F.max_by(F.struct(F.col("n").alias("n_frames"), F.col("s").alias("start")), F.struct("n", -F.col("s")))
    return sized.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def plateau_pitch(frames: DataFrame, groups: list[str], value: str, t: str, hop: float) -> DataFrame:
    """Per group, the rounded value whose longest contiguous run is longest (the smaller of equals)."""
    rounded = frames.where(F.col(value).isNotNull()).withColumn("_p", F.rint(value).cast("int"))
    runs = longest_run(rounded, [*groups, "_p"], t, hop)
    best = F.max_by(F.struct(F.col("_p").alias("pitch"), F.col("n_frames")), F.struct("n_frames", -F.col("_p")))
    return runs.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def mode_pitch(frames: DataFrame, groups: list[str], value: str, quantile: float = 0.5) -> DataFrame:
    """Per group, the most frequent rounded value; of equals the one nearest the quantile, then the smaller."""
    known = frames.where(F.col(value).isNotNull())
    centre = known.groupBy(*groups).agg(F.percentile(value, quantile).alias("q"))
    counts = known.groupBy(*groups, F.rint(value).cast("int").alias("pitch")).agg(F.count("*").alias("n")).join(centre, groups)
    best = F.max_by(F.struct("pitch", "n", "q"), F.struct(F.col("n"), -F.abs(F.col("pitch") - F.col("q")), -F.col("pitch")))
    return counts.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.pitch", "b.n", "b.q")


def chroma_frames(notes: DataFrame, hop: float, pitch: str = "pitch", key: str = "track_id") -> DataFrame:
    """``(key, frame, pc, weight)``: notes counted per frame and pitch class, each frame of unit length."""
    first = F.floor(F.col("start") / hop)
    last = F.greatest(F.ceil(F.col("end") / hop) - 1, first)
    cells = notes.select(key, F.explode(F.sequence(first, last)).alias("frame"), F.pmod(F.col(pitch), F.lit(12)).alias("pc"))
    counts = cells.groupBy(key, "frame", "pc").agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key, "frame")))
    return counts.select(key, "frame", "pc", (F.col("n") / norm).alias("weight"))


def edge_trimmed(start: Column, end: Column, edge: float = 0.05) -> tuple[Column, Column]:
    """Both ends moved in by the lesser of ``edge`` and a quarter of the span."""
    cut = F.least(F.lit(edge), 0.25 * (end - start))
    return start + cut, end - cut


def pitch_class_profile(samples: np.ndarray, rate: int, frame: int = 8192, hop: int = 4096, band: tuple[float, float] = (80.0, 2000.0), top: int = 10) -> np.ndarray | None:
    """Shares of the twelve pitch classes in a signal; None if no frame has a peak.

    A frame votes with its ``top`` strongest local maxima in the band, weighted by the root of their
    size, after the common detuning of all peaks (a circular mean) is taken off.
    """
    x = np.asarray(samples, dtype=float)
    if len(x) <= frame:
        return None
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    inside = np.flatnonzero((hertz >= band[0]) & (hertz <= band[1]))
    window = np.hanning(frame)
    found: list[np.ndarray] = []
    starts = np.arange(0, len(x) - frame, hop)
    for part in np.array_split(starts, -(-len(starts) // 64)):  # a few frames at a time
        size = np.abs(np.fft.rfft(x[part[:, None] + np.arange(frame)] * window, axis=1))[:, inside]
        peak = np.zeros(size.shape, dtype=bool)
        peak[:, 1:-1] = (size[:, 1:-1] > size[:, :-2]) & (size[:, 1:-1] > size[:, 2:])
        ranked = np.where(peak, size, -1.0)
        best = np.argsort(ranked, axis=1)[:, -top:]
        value = np.take_along_axis(ranked, best, axis=1)
        found.append(np.stack([hertz[inside[best[value > 0]]], value[value > 0]]))
    hz, weight = np.concatenate(found, axis=1)
    if not len(hz):
        return None
    midi = 69 + 12 * np.log2(hz / 440.0)
    detuned = np.angle(np.sum(weight * np.exp(2j * np.pi * midi))) / (2 * np.pi)
    votes = np.bincount(np.rint(midi - detuned).astype(int) % 12, np.sqrt(weight), minlength=12)
    return votes / votes.sum()


def quiet_chunks(samples: np.ndarray, rate: int, longest: float, reach: float = 5.0, margin: float = 1.0, step: float = 0.02) -> list[tuple[int, int]]:
    """Spans of samples of about ``longest`` seconds, cut at the quietest ``step`` within ``reach`` of
    where each would end, at least ``margin`` from its start and from the signal's end."""
    x = np.asarray(samples, dtype=float)
    size, cell = int(longest * rate), int(step * rate)
    cuts = [0]
    while len(x) > cuts[-1] + size and cell:
        nominal = cuts[-1] + size
        low, high = max(cuts[-1] + int(margin * rate), nominal - int(reach * rate)), min(len(x) - int(margin * rate), nominal + int(reach * rate))
        cells = max(high - low, 0) // cell
        if not cells:
            break
        power = np.square(x[low : low + cells * cell]).reshape(cells, cell).mean(axis=1)
        cuts.append(low + int(np.argmin(power)) * cell)
    return list(zip(cuts, [*cuts[1:], len(x)], strict=True))
