"""Queries of the curve-based corrections and detectors: rows only, checked by unit tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import cleanup, folds, refine, techniques
from . import views as V
from .registry import query

#: The views run over months and the rules over seconds: one second of a rule is a day of the data.
DAY = 86400.0


def _each(spark, d, fn, schema="start double, end double, p int"):
    """``fn(notes, curve, windows)`` over every track, in days; a track without clicks has no windows."""
    n = V.notes(spark, d)
    days = [(F.col("start") / DAY).alias("start"), (F.col("end") / DAY).alias("end")]
    notes = n.select("track_id", *days, "p")
    frames = V.frames(spark, d).select("track_id", (F.col("t") / DAY).alias("t"), (36 + F.col("f0") / 10).alias("m"))
    windows = n.where("event_type = 'click'").select("track_id", days[0], (F.col("end") / DAY + 2).alias("end"))

    def run(note_rows, frame_rows, window_rows):
        return fn(note_rows, refine.curve([t for t, _ in frame_rows], [m for _, m in frame_rows]), window_rows)

    return folds.together([(notes, ("start", "end", "p")), (frames, ("t", "m")), (windows, ("start", "end"))], run, schema)


@query()
def postfix_chain(spark, d):
    """Fill, refine, snap, capture and extend, in that order."""

    def chain(notes, f0, windows):
        weights = np.bincount([p % 12 for _, _, p in notes], minlength=12) + 1.0
        x = refine.fill_missing(notes, windows, f0)
        x = refine.refine_joints(x, f0, search=2.0, gap=2.0)
        x = refine.snap_to_classes(x, f0, weights)
        x = refine.capture_falls(x, f0, most=5.0)
        return refine.extend_held(x, f0, tolerance=5.0, most=3.0)

    return _each(spark, d, chain)


@query()
def chosen_pitches(spark, d):
    """Per window the pitch by quantile, mode and longest plateau."""
    rules = ("median", "mode", "plateau")
    return _each(spark, d, lambda n, f0, w: [(s, e, *(refine.choose_pitch(f0, s, e, r, least=2, widen=2.0) for r in rules)) for s, e in w], "start double, end double, by_median int, by_mode int, by_plateau int")


@query()
def weak_notes(spark, d):
    """Notes without steady evidence take a neighbour's pitch."""
    return _each(spark, d, lambda n, f0, w: refine.settle_weak(n, f0, short=1.0, hard_short=0.3, plateau=0.5))


@query()
def mora_cleanup(spark, d):
    """All cleaning rules over every track, each click window being a slot and two of them a character."""
    n = V.notes(spark, d)
    notes = n.select("track_id", (F.col("start") / DAY).alias("start"), (F.col("end") / DAY).alias("end"), F.col("p").alias("pitch"))
    number = F.row_number().over(W.partitionBy("track_id").orderBy("start", "end", "note_id")) - 1
    clicks = n.where("event_type = 'click'").withColumn("char", F.floor(number / 2).cast("int"))
    slots = clicks.select("track_id", (F.col("start") / DAY).alias("start"), (F.col("end") / DAY + 2).alias("end"), "char")
    midi = 36 + F.col("f0") / 10
    frames = V.frames(spark, d).select("track_id", (F.col("t") / DAY).alias("t"), (midi - 60).alias("db"), midi.alias("first"), midi.alias("second"))
    return cleanup.clean(notes, slots, frames, hop=0.5)


@query()
def patched_notes(spark, d):
    """Every window is a patch at its start; what finds no note is added, and onsets in the last tenth of the windows go."""

    def run(notes, f0, windows):
        patches = [{"at": s, "pitch": 60, "start": s, "end": s + 0.05} for s, _ in windows]
        return cleanup.drop_onsets(cleanup.patch_pitches(notes, patches)[0], [(e - (e - s) / 10, e) for s, e in windows])

    return _each(spark, d, run)


@query()
def techniques_found(spark, d):
    """Ornaments in the daily price curve against a constant note per hundred days, the last one shorter."""
    x = V.daily(spark, d)

    def run(rows):
        price = np.array([r[1] for r in rows]) / 5000 + 50
        notes = [(a / 100, min(a + 100, len(price)) / 100, round(float(np.median(price[a : a + 100])))) for a in range(0, len(price), 100)]
        return techniques.detect(price, 0.01, notes)

    return folds.by_key(x, run, ("frame", "price"), ("frame",), "kind string, note int, t double, measure double")
