"""Gaps and islands, and rewrites that look at neighbouring rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NOTE_ORDER = ("start", "end", "note_id")


def islands(df: DataFrame, new: Column, key: str, order: Sequence[str], name: str = "island") -> DataFrame:
    """Numbers the runs that begin where ``new`` holds; the first row of a key begins one."""
    w = W.partitionBy(key).orderBy(*order)
    flag = F.when(F.lag(F.lit(1)).over(w).isNull() | F.coalesce(new, F.lit(False)), 1).otherwise(0)
    return df.withColumn("_new", flag).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge_same_pitch(notes: DataFrame, key: str = "track_id", pitch: str = "pitch", max_gap: float = 0.08, also: str | None = None, order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Neighbouring notes of one pitch (and equal ``also``, -1 never) joined over gaps up to ``max_gap``."""
    w = W.partitionBy(key).orderBy(*order)
    new = F.lag(pitch).over(w) != F.col(pitch)
    if also:
        new = new | (F.lag(also).over(w) != F.col(also)) | (F.col(also) == -1)
    # within a run of one pitch the gap is to the greatest end so far
    runs = islands(notes, new, key, order, "run")
    inner = W.partitionBy(key, "run").orderBy(*order)
    edge = F.max("end").over(inner.rowsBetween(W.unboundedPreceding, -1))
    cut = F.coalesce((F.col("start") - edge > max_gap).cast("int"), F.lit(0))
    part = runs.withColumn("_c", cut).withColumn("part", F.sum("_c").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    extra = [also] if also else []
    return part.groupBy(key, "run", "part", pitch, *extra).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged")).drop("run", "part")


def absorb_wiggles(notes: DataFrame, mode: str = "static", longest: float = 0.22, near: int = 2, touch: float = 0.15, key: str = "track_id", pitch: str = "pitch", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Short notes between two of one pitch take that pitch.

    static: every decision is made on the input; noalt: so too, but a pitch that recurs two notes away
    stays; cascade: a decision sees the pitches already changed (``folds.absorb_wiggles``, one pass
    per key); off: nothing changes.
    """
    if mode == "off":
        return notes
    if mode == "cascade":
        from .folds import absorb_wiggles as fold
        from .folds import by_key

        pitch_type = notes.schema[pitch].dataType.simpleString()
        return by_key(notes, lambda rows: fold(rows, longest, near, touch), ("start", "end", pitch), order, f"start double, end double, {pitch} {pitch_type}", key)
    if mode not in ("static", "noalt"):
        raise ValueError(f"unknown mode {mode!r}")
    w = W.partitionBy(key).orderBy(*order)
    outer, own = F.lag(pitch).over(w), F.col(pitch)
    held = (outer == F.lead(pitch).over(w)) & (outer != own) & (F.abs(own - outer) <= near)
    close = (F.col("start") - F.lag("end").over(w) < touch) & (F.lead("start").over(w) - F.col("end") < touch)
    taken = (F.col("end") - F.col("start") <= longest) & held & close
    if mode == "noalt":
        recurs = [F.coalesce(f(pitch, 2).over(w) == own, F.lit(False)) for f in (F.lag, F.lead)]
        taken = taken & ~recurs[0] & ~recurs[1]
    return notes.withColumn("_p", F.when(taken, outer).otherwise(own)).withColumn(pitch, F.col("_p")).drop("_p")


def run_lengths(frames: DataFrame, value: str, key: str = "track_id", frame: str = "frame") -> DataFrame:
    """Run-length encoding: ``(key, value, start, end)`` with end exclusive; a null is a value of its own."""
    w = W.partitionBy(key).orderBy(frame)
    runs = islands(frames, ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.lag(frame).over(w) != F.col(frame) - 1), key, [frame])
    return runs.groupBy(key, "island", value).agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("end")).drop("island")


def active_runs(frames: DataFrame, active: Column, hop: float, least: float, key: str = "track_id", frame: str = "frame", t: str = "t") -> DataFrame:
    """Runs of consecutive rows where ``active`` holds, from the first time to the last plus ``hop``."""
    w = W.partitionBy(key).orderBy(frame)
    numbered = frames.withColumn("_n", F.row_number().over(w)).withColumn("_a", F.coalesce(active, F.lit(False)))
    on = numbered.where("_a").withColumn("_g", F.col("_n") - F.row_number().over(w))
    runs = on.groupBy(key, "_g").agg(F.min(t).alias("start"), (F.max(t) + hop).alias("end"), F.count("*").alias("n_frames"))
    return runs.where(F.col("end") - F.col("start") >= least).drop("_g")


def phrases(notes: DataFrame, gap: float = 0.8, key: str = "track_id", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Notes numbered by phrase: a new one begins over ``gap`` after the previous note's end."""
    w = W.partitionBy(key).orderBy(*order)
    return islands(notes, F.col("start") - F.lag("end").over(w) > gap, key, order, "phrase")


def linked_chains(pairs: DataFrame, key: str = "track_id", slack: float = 1e-6) -> DataFrame:
    """Pairs numbered by chain: a pair goes on where the previous one ended."""
    w = W.partitionBy(key).orderBy("start", "end")
    return islands(pairs, F.abs(F.lag("end").over(w) - F.col("start")) >= slack, key, ["start", "end"], "chain")


def held_note_fill(notes: DataFrame, gap: float = 8.0, tolerance: int = 0, key: str = "track_id", pitch: str = "pitch", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Adds a note over every gap of at least ``gap`` between notes within ``tolerance`` of pitch."""
    w = W.partitionBy(key).orderBy(*order)
    ahead = notes.withColumn("_s", F.lead("start").over(w)).withColumn("_p", F.lead(pitch).over(w))
    bridges = ahead.where((F.col("_s") - F.col("end") >= gap) & (F.abs(F.col("_p") - F.col(pitch)) <= tolerance))
    made = bridges.select(key, F.col("end").alias("start"), F.col("_s").alias("end"), F.rint((F.col(pitch) + F.col("_p")) / 2).cast(notes.schema[pitch].dataType).alias(pitch), F.lit(True).alias("added"))
    return notes.select(key, "start", "end", pitch, F.lit(False).alias("added")).unionByName(made)


def tiny_gaps(notes: DataFrame, max_gap: float = 0.08, key: str = "track_id", pitch: str = "pitch", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Per key, neighbours of one pitch with a gap of 0 to ``max_gap``."""
    w = W.partitionBy(key).orderBy(*order)
    gap = F.col("start") - F.lag("end").over(w)
    hit = (F.lag(pitch).over(w) == F.col(pitch)) & (gap >= 0) & (gap <= max_gap)
    return notes.withColumn("_h", F.coalesce(hit, F.lit(False))).groupBy(key).agg(F.count_if("_h").alias("tiny_gaps"))


def aba_jitter(notes: DataFrame, span: float = 0.80, gap: float = 0.12, jump: int = 3, key: str = "track_id", pitch: str = "pitch", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Per key, triples A-B-A: equal outer pitches, a middle at most ``jump`` away, short gaps and span."""
    w = W.partitionBy(key).orderBy(*order)
    b = {c: F.lead(c, 1).over(w) for c in ("start", "end", pitch)}
    c = {c: F.lead(c, 2).over(w) for c in ("start", "end", pitch)}
    step = F.abs(b[pitch] - F.col(pitch))
    hit = (c[pitch] == F.col(pitch)) & (step > 0) & (step <= jump) & (c["end"] - F.col("start") <= span) & (b["start"] - F.col("end") <= gap) & (c["start"] - b["end"] <= gap)
    return notes.withColumn("_h", F.coalesce(hit, F.lit(False))).groupBy(key).agg(F.count_if("_h").alias("aba"))


def visual_gap(notes: DataFrame, gap: float, least: float = 0.05, key: str = "track_id", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Ends pulled back so that the next start is at least ``gap`` away, but no note under ``least``."""
    following = F.lead("start").over(W.partitionBy(key).orderBy(*order))
    short = F.greatest(F.col("start") + least, following - gap)
    return notes.withColumn("end", F.when(following - F.col("end") < gap, short).otherwise(F.col("end")))


def adjacent_overlaps(notes: DataFrame, slack: float = 1e-6, key: str = "track_id", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    following = F.lead("start").over(W.partitionBy(key).orderBy(*order))
    return notes.withColumn("_h", F.coalesce(following < F.col("end") - slack, F.lit(False))).groupBy(key).agg(F.count_if("_h").alias("overlaps"))


def quantise_to_beats(notes: DataFrame, beat: float, grid: Sequence[float] = (0.5, 1.0, 2.0), key: str = "track_id", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Durations snapped to beats by plain distance, never past the next onset, at least 1 ms; empty notes go."""
    from ..functions.pitch import nearest_multiple

    kept = notes.where("end > start")
    following = F.lead("start").over(W.partitionBy(key).orderBy(*order))
    snapped = nearest_multiple(F.col("end") - F.col("start"), beat, tuple(grid), log=False)
    end = F.col("start") + F.col("snapped")
    out = kept.withColumn("snapped", snapped).withColumn("_next", following)
    return out.withColumn("end", F.greatest(F.least(end, F.coalesce("_next", end)), F.col("start") + 0.001)).drop("_next")


def line_timing(lines: DataFrame, lead_max: float = 5.0, linger: float = 4.0, key: str = "track_id") -> DataFrame:
    """When each line of rows A and B is shown, turned to its successor and replaced.

    flip = min(max(end, next start), end + linger); the next line of the row previews at
    max(flip, its start - lead_max); a line is replaced at min(its flip, that preview).
    """
    every, own = W.partitionBy(key).orderBy("line"), W.partitionBy(key, "row").orderBy("line")
    following = F.lead("start").over(every)
    successor = F.when(following.isNull() | (following == 0.0), F.col("end")).otherwise(following)
    out = lines.withColumn("flip", F.least(F.greatest(F.col("end"), successor), F.col("end") + linger))
    preview = F.greatest(F.lag("flip").over(own), F.col("start") - lead_max)
    out = out.withColumn("shown", F.coalesce(preview, F.greatest(F.lit(0.0), F.col("start") - lead_max)))
    return out.withColumn("replace", F.least("flip", F.coalesce(F.lead("shown").over(own), F.col("flip"))))


def running_counts(events: DataFrame, points: DataFrame, category: str, values: Sequence[str], key: str = "track_id", t: str = "t") -> DataFrame:
    """Per point and category of ``values``, how many events have ended at or before it."""
    from .asof import asof_backward

    order = W.partitionBy(key, category).orderBy("end", "note_id")
    counted = events.select(key, category, F.col("end").alias("t"), F.row_number().over(order).alias("n"))
    steps = counted.withColumn("k", F.concat_ws("|", key, category))
    asked = points.withColumn(category, F.explode(F.array(*[F.lit(v) for v in values])))
    asked = asked.withColumn("k", F.concat_ws("|", key, category)).withColumnRenamed(t, "at")
    found = asof_backward(asked, steps.select("k", "t", "n"), "k", "at", "t", tie="n")
    return found.select(*[c for c in asked.columns if c not in ("k", "at")], F.col("at").alias(t), F.coalesce(F.col("mark.n"), F.lit(0)).alias("done"))


def onset_ligatures(notes: DataFrame, max_gap: float = 0.15, mora: str = "mora", key: str = "track_id", pitch: str = "pitch", order: Sequence[str] = NOTE_ORDER) -> DataFrame:
    """Pairs of neighbours in one mora that change pitch across a gap of at most ``max_gap``."""
    w = W.partitionBy(key).orderBy(*order)
    nxt = {c: F.lead(c).over(w) for c in ("start", pitch, mora)}
    hit = (nxt[mora] == F.col(mora)) & (F.col(mora) >= 0) & (nxt[pitch] != F.col(pitch)) & (nxt["start"] - F.col("end") <= max_gap)
    return notes.withColumn("_h", hit).withColumn("t_b", nxt["start"]).where("_h").select(key, F.col("start").alias("t_a"), "t_b")
