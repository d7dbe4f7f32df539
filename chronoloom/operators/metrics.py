"""Quality metrics and per-key statistics: range join, then two-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.pitch import folded_cents, hz_to_midi, key_name, octave_like
from .intervals import overlap_join, points_in, points_masked
from .segments import NOTE_ORDER, aba_jitter, tiny_gaps

#: The major and minor key profiles of Krumhansl and Kessler (1982), from the tonic up.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def note_frames(notes: DataFrame, frames: DataFrame, windows: DataFrame | None = None, key: str = "track_id", pitch: str = "p", skip_own: str | None = None) -> DataFrame:
    """Voiced frames inside notes with ``cents``, their difference from the note."""
    voiced = frames.withColumn("midi", hz_to_midi(F.col("f0"))).where("midi is not null")
    if windows is not None:
        voiced = points_masked(voiced, windows, key)
    pairs = points_in(voiced, notes.select(key, "note_id", "start", "end", pitch), key)
    if skip_own:
        pairs = pairs.where(F.col(skip_own) != F.col("w_note_id"))
    return pairs.select(key, F.col("w_note_id").alias("note_id"), "t", ((F.col("midi") - F.col(f"w_{pitch}")) * 100).alias("cents"))


def _share(hit: Column) -> Column:
    return F.avg(F.when(hit, 1.0).otherwise(0.0).cast("double"))


def pitch_metrics(pairs: DataFrame, key: str = "track_id") -> DataFrame:
    """Accuracy of ``pairs(key, note_id, cents)``: one row per key that has any pair.

    Shares among non-octave frames are 0 where there are none; the two quantiles are null then.
    """
    d, folded = F.col("cents"), F.abs(folded_cents(F.col("cents")))
    octave = octave_like(d)
    plain = F.when(~octave, folded)

    def plain_share(hit: Column) -> Column:
        return F.coalesce(F.avg(F.when(~octave, hit.cast("double"))), F.lit(0.0))

    frame = pairs.groupBy(key).agg(
        F.count("*").alias("frames"), _share(F.abs(d) <= 50).alias("rpa"), _share(folded <= 50).alias("rca"), F.count_if(octave).alias("octave_frames"), _share(octave).alias("octave_rate"),
        plain_share(folded <= 50).alias("non_octave_within_50c"), plain_share((folded > 50) & (folded <= 150)).alias("non_octave_50_150c"),
        plain_share((folded > 150) & (folded <= 250)).alias("non_octave_150_250c"), plain_share(folded > 250).alias("non_octave_gt_250c"),
        F.percentile(plain, 0.5).alias("folded_median_abs_cents"), F.percentile(plain, 0.9).alias("folded_p90_abs_cents"),
    )
    per_note = pairs.groupBy(key, "note_id").agg(F.percentile("cents", 0.5).alias("cents"))
    off = ~octave
    note = per_note.groupBy(key).agg(
        F.count("*").alias("note_cmp"), F.count_if(octave).alias("note_octave"), F.count_if(off & (folded > 50) & (folded <= 150)).alias("note_1_semitone"),
        F.count_if(off & (folded > 150) & (folded <= 250)).alias("note_2_semitone"), F.count_if(off & (folded > 250)).alias("note_gt_250c"),
    )
    return frame.join(note, key).withColumn("octave_proxy", F.greatest(F.lit(0.0), F.col("rca") - F.col("rpa")))


def overall_pitch_metrics(pairs: DataFrame) -> DataFrame:
    """As ``pitch_metrics`` over everything: always one row, zeros and two nulls if there is no pair."""
    one = pitch_metrics(pairs.withColumn("_all", F.lit(1)), "_all")
    kept = ("folded_median_abs_cents", "folded_p90_abs_cents")
    frame = pairs.sparkSession.range(1).select(F.lit(1).alias("_all")).join(one, "_all", "left")
    return frame.select(*[F.col(c) if c in kept else F.coalesce(F.col(c), F.lit(0).cast(one.schema[c].dataType)).alias(c) for c in one.columns if c != "_all"])


def pitch_spans(windows: DataFrame, notes: DataFrame, key: str = "track_id", pitch: str = "p", least: float = 0.03) -> DataFrame:
    """``windows(key, start, end)`` with ``span``: how far apart the pitches of the notes are that overlap
    a window by ``least``; 0 for fewer than two."""
    pairs = overlap_join(windows.select(key, "start", "end"), notes.select(key, "start", "end", pitch), key)
    held = pairs.where(F.least("end", "r_end") - F.greatest("start", "r_start") >= least)
    wide = held.groupBy(key, "start", "end").agg((F.max(f"r_{pitch}") - F.min(f"r_{pitch}")).alias("span"))
    return windows.join(wide, [key, "start", "end"], "left").withColumn("span", F.coalesce("span", F.lit(0)))


def _widening(moves: DataFrame, notes: DataFrame, windows: DataFrame, key: str, pitch: str, least: float) -> DataFrame:
    """The ``moves(key, note_id, start, end, pitch, to)`` that make any window's span wider.

    Every window that a move touches is met by its notes once; the span after the move is that of the
    other notes and, if the moved one counts there, of its new pitch.
    """
    w = windows.select(key, "start", "end").distinct()
    touched = overlap_join(moves, w, key).select(key, "note_id", "to", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    pairs = overlap_join(touched, notes.select(key, "start", "end", pitch, F.col("note_id").alias("other")), key)
    held = pairs.where(F.least("end", "r_end") - F.greatest("start", "r_start") >= least)
    after = F.when(F.col("r_other") == F.col("note_id"), F.col("to")).otherwise(F.col(f"r_{pitch}"))
    spans = held.groupBy(key, "note_id", "start", "end").agg(F.count("*").alias("n"), (F.max(after) - F.min(after)).alias("after"), (F.max(f"r_{pitch}") - F.min(f"r_{pitch}")).alias("before"))
    return spans.where("n >= 2 and after > before").select(key, "note_id").distinct()


def shift_octaves_by_evidence(notes: DataFrame, primary: DataFrame, veto: DataFrame, pitch: str = "p", key: str = "track_id", veto_cents: float = 250.0, guard: DataFrame | None = None, long: float = 0.45, least: float = 0.03) -> DataFrame:
    """Notes whose primary median is an octave off move by it, unless the second median agrees with them.

    With ``guard(key, start, end)`` a note stays if its move would spread the pitches of any window of
    at least ``long`` that it touches further apart. Every move is judged on the notes as they come in.
    """
    a = primary.groupBy(key, "note_id").agg(F.percentile("cents", 0.5).alias("a"))
    b = veto.groupBy(key, "note_id").agg(F.percentile("cents", 0.5).alias("b"))
    joined = notes.join(a, [key, "note_id"], "left").join(b, [key, "note_id"], "left")
    move = octave_like(F.col("a")) & F.coalesce(F.abs("b") > veto_cents, F.lit(True))
    to = F.when(move, F.col(pitch) + F.when(F.col("a") > 0, 12).otherwise(-12)).cast(notes.schema[pitch].dataType)
    joined = joined.withColumn("to", to).drop("a", "b")
    if guard is not None:
        moves = joined.where("to is not null").select(key, "note_id", "start", "end", pitch, "to")
        bad = _widening(moves, notes, guard.where(F.col("end") - F.col("start") >= long), key, pitch, least).withColumn("kept", F.lit(True))
        joined = joined.join(bad, [key, "note_id"], "left").withColumn("to", F.when(F.col("kept").isNull(), F.col("to"))).drop("kept")
    return joined.withColumn(pitch, F.coalesce("to", pitch)).drop("to")


def fragmentation(notes: DataFrame, windows: DataFrame, spans: DataFrame, key: str = "track_id", pitch: str = "pc", tiny: float = 0.08, jitter: tuple[float, float, int] = (0.80, 0.12, 3), least: float = 0.03, span: float = 0.45) -> DataFrame:
    """Per key: notes, notes outside all windows, tiny gaps, A-B-A triples, long spans in pieces."""
    total = notes.groupBy(key).agg(F.count("*").alias("notes"))
    outside = overlap_join(notes, windows.select(key, "start", "end"), key, how="left_anti").groupBy(key).agg(F.count("*").alias("outside"))
    pieces = split_spans(spans, notes, key, pitch, least, span).groupBy(key).agg(F.count("*").alias("split_spans"))
    out = total
    for part in (outside, tiny_gaps(notes, tiny, key, pitch), aba_jitter(notes, *jitter, key=key, pitch=pitch), pieces):
        out = out.join(part, key, "left")
    return out.na.fill(0)


def split_spans(spans: DataFrame, notes: DataFrame, key: str = "track_id", pitch: str = "pc", least: float = 0.03, long: float = 0.45, count: int = 2, spread: int = 2) -> DataFrame:
    """Spans of at least ``long`` that overlap ``count`` notes (each by ``least``) spread over ``spread`` semitones."""
    pairs = overlap_join(spans.where(F.col("end") - F.col("start") >= long), notes.select(key, "start", "end", pitch), key)
    held = pairs.where(F.least("end", "r_end") - F.greatest("start", "r_start") >= least)
    names = spans.columns
    out = held.groupBy(*names).agg(F.count("*").alias("n_notes"), (F.max(f"r_{pitch}") - F.min(f"r_{pitch}")).alias("spread"))
    return out.where((F.col("n_notes") >= count) & (F.col("spread") >= spread))


def weighted_median(df: DataFrame, value: str, weight: Column, key: str = "track_id") -> DataFrame:
    """``(key, weighted_median)``: the first value in order at which half the weight is reached."""
    order = W.partitionBy(key).orderBy(value, "_w").rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumn("_w", weight).withColumn("_c", F.sum("_w").over(order)).withColumn("_t", F.sum("_w").over(W.partitionBy(key)))
    plain = F.percentile(value, 0.5)
    return run.groupBy(key).agg(F.when(F.max("_t") == 0, plain).otherwise(F.min(F.when(F.col("_c") >= F.col("_t") / 2, F.col(value)))).cast("double").alias("weighted_median"))


def song_stats(notes: DataFrame, key: str = "track_id", pitch: str = "p", leap: int = 7, order: tuple[str, ...] = NOTE_ORDER) -> DataFrame:
    """Per key: count, range, high notes, upward and downward leaps, long notes (over the 90th percentile)."""
    step = F.lead(pitch).over(W.partitionBy(key).orderBy(*order)) - F.col(pitch)
    whole = notes.groupBy(key).agg(F.max(pitch).alias("pmax"), F.min(pitch).alias("pmin"), F.percentile(F.col("end") - F.col("start"), 0.9).alias("p90"))
    rows = notes.withColumn("_step", step).join(whole, key)
    return rows.groupBy(key).agg(
        F.count("*").alias("count"), F.max("pmin").alias("pmin"), F.max("pmax").alias("pmax"), (F.max("pmax") - F.max("pmin")).alias("span"), F.count_if(F.col(pitch) >= F.col("pmax") - 2).alias("high"),
        F.count_if(F.col("_step") >= leap).alias("up"), F.count_if(F.col("_step") <= -leap).alias("down"), F.count_if(F.col("end") - F.col("start") > F.col("p90")).alias("long"),
    )


def pitch_class_weights(notes: DataFrame, key: str = "track_id", pitch: str = "p") -> DataFrame:
    """Duration by pitch class, all twelve present."""
    dur = F.col("end") - F.col("start")
    pc = F.pmod(F.col(pitch), F.lit(12))
    return notes.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.when(pc == i, dur)), F.lit(0.0)) for i in range(12)]).alias("w"))


def detect_key(weights: DataFrame, key: str = "track_id", top: int = 3) -> DataFrame:
    """``(key, rank, tonic, mode, name, r)``: the best keys by correlation with the 24 rotated profiles.

    Ties go to the higher tonic, then minor. A flat weight vector has no key.
    """
    spark = weights.sparkSession
    # 24 rows, whatever the input
    profiles = spark.createDataFrame([(t, m, [float(prof[(i - t) % 12]) for i in range(12)]) for m, prof in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)) for t in range(12)], "tonic int, mode string, prof array<double>")
    cells = weights.select(key, F.posexplode("w").alias("pc", "w"))
    shape = profiles.select("tonic", "mode", F.posexplode("prof").alias("pc", "x"))
    r = cells.join(F.broadcast(shape), "pc").groupBy(key, "tonic", "mode").agg(F.corr("x", "w").alias("r"), F.stddev_pop("w").alias("sd"))
    known = r.where("sd > 0 and r is not null")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("r"), F.desc("tonic"), F.desc("mode")))
    return known.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "rank", "tonic", "mode", key_name(F.col("tonic"), F.col("mode")).alias("name"), "r")


def rank_quantile(values: Column, q: float, rounding: str = "half_even") -> Column:
    """sorted(values)[round(q * (n - 1))] of a collected array; ``floor`` truncates the rank instead."""
    n = F.size(values) - 1
    at = F.rint(n * q) if rounding == "half_even" else F.floor(n * q)
    return F.try_element_at(F.sort_array(values), at.cast("int") + 1)


def stretched_lines(lines: DataFrame, value: str, key: str = "track_id", factor: float = 3.0, floor: float = 1.0) -> DataFrame:
    """Lines whose value is over ``factor`` times the key's 90th percentile (nearest rank), and over ``floor``."""
    limits = lines.groupBy(key).agg(rank_quantile(F.collect_list(value), 0.9).alias("p90"))
    return lines.join(limits, key).where(F.col(value) > F.greatest(F.col("p90") * factor, F.lit(floor)))


def relabel_by_second_opinion(notes: DataFrame, events: DataFrame, pitch: str = "p", key: str = "track_id", far: int = 1, least: float = 0.02, ratio: float = 1.2) -> DataFrame:
    """Notes take the pitch of the strongest event nearby if it beats the events that agree with them.

    An event counts if it overlaps at least 0.3 of the shorter duration; its score is its confidence
    times the covered share of the note, all of it if the note has no length. Ties go to the earliest event.
    """
    pairs = overlap_join(notes, events.select(key, "start", "end", "event_pitch", "conf", "event_no"), key)
    ov = F.least("end", "r_end") - F.greatest("start", "r_start")
    dur, edur = F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start")
    share = F.when(dur == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(ov, dur)))
    scored = pairs.where(ov >= 0.3 * F.least(dur, edur)).withColumn("s", F.col("r_conf") * share).withColumn("d", F.abs(F.col("r_event_pitch") - F.col(pitch)))
    other = (F.col("d") >= 1) & (F.col("d") <= far)
    names = notes.columns
    best = scored.groupBy(*names).agg(
        F.max(F.when(other, F.struct("s", (-F.col("r_start")).alias("t"), (-F.col("r_event_no")).alias("n"), F.col("r_event_pitch").alias("to")))).alias("b"),
        F.coalesce(F.max(F.when(F.col("d") == 0, F.col("s"))), F.lit(0.0)).alias("support"),
    )
    wins = (F.col("b.s") >= least) & (F.col("b.s") > F.col("support") * ratio)
    moved = best.where(wins).select(key, "note_id", F.col("b.to").alias("to"))
    return notes.join(moved, [key, "note_id"], "left").withColumn(pitch, F.coalesce("to", pitch).cast(notes.schema[pitch].dataType)).drop("to")
