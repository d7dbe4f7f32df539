"""Pitch and time arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4_HZ, A4_MIDI = 440.0, 69.0
#: Quarter-note multiples that durations snap to, by distance of logarithms.
LOG_GRID = (0.25, 0.5, 1.0, 2.0, 4.0)
#: Beat multiples that durations snap to, by plain distance.
BEAT_GRID = (0.5, 1.0, 2.0)
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
#: Pitch classes of the major keys that are written with flats.
FLAT_MAJORS = (1, 3, 5, 8, 10)


def hz_to_midi(f0: Column) -> Column:
    """Fractional MIDI number of a frequency; null where it is not positive or not finite."""
    finite = f0.isNotNull() & ~F.isnan(f0) & (f0 > 0) & (f0 < float("inf"))
    return F.when(finite, F.lit(A4_MIDI) + 12.0 * F.log2(f0 / A4_HZ))


def folded_cents(cents: Column) -> Column:
    """The difference folded into [-600, 600), octaves ignored."""
    return F.pmod(cents + 600.0, F.lit(1200.0)) - 600.0


def octave_like(cents: Column, tolerance: float = 120.0) -> Column:
    return F.abs(F.abs(cents) - 1200.0) <= tolerance


def octave_folded(semitones: Column) -> Column:
    """Deviation from the nearest octave, ties of the rounding to even."""
    return semitones - 12.0 * F.rint(semitones / 12.0)


def ticks_of(seconds: Column, tempo_us: int = 500_000, per_beat: int = 480) -> Column:
    # one factor, as in the files: with several steps times halfway between two ticks round otherwise
    return F.rint(seconds * (1e6 * per_beat / tempo_us)).cast("long")


def seconds_of(ticks: Column, tempo_us: int = 500_000, per_beat: int = 480) -> Column:
    return ticks * float(tempo_us) / (per_beat * 1e6)


def nearest_multiple(value: Column, unit: Column | float, grid: tuple[float, ...], log: bool) -> Column:
    """The member of ``grid`` times ``unit`` nearest to ``value``; the first of equals."""
    unit = F.lit(unit) if isinstance(unit, int | float) else unit

    def distance(g: float) -> Column:
        return F.abs(F.ln(value / (unit * g))) if log else F.abs(value - unit * g)

    ranked = F.array_min(F.array(*[F.struct(distance(g).alias("d"), F.lit(i).alias("i")) for i, g in enumerate(grid)]))
    return unit * F.element_at(F.array(*[F.lit(g) for g in grid]), ranked["i"] + 1)


def quantised_duration(start: Column, end: Column, quarter: Column | float, first_if_empty: bool = False, floor: float = 0.001) -> Column:
    """Duration snapped to the grid of quarters by log distance.

    Durations below ``floor`` count as ``floor``, or as the grid's first step with ``first_if_empty``
    where they are not positive.
    """
    duration = end - start
    snapped = nearest_multiple(F.greatest(duration, F.lit(floor)), quarter, LOG_GRID, log=True)
    if not first_if_empty:
        return snapped
    unit = F.lit(quarter) if isinstance(quarter, int | float) else quarter
    return F.when(duration <= 0, unit * LOG_GRID[0]).otherwise(nearest_multiple(duration, quarter, LOG_GRID, log=True))


def pitch_name(pitch: Column, flats: bool = False) -> Column:
    """Name with octave; 60 is C4."""
    names = F.array(*[F.lit(n) for n in (FLATS if flats else SHARPS)])
    return F.concat(F.element_at(names, F.pmod(pitch, F.lit(12)).cast("int") + 1), (F.floor(pitch / 12) - 1).cast("string"))


def key_name(tonic: Column, mode: Column) -> Column:
    """Spelling of a key; flats where the relative major is a flat key."""
    relative = F.when(mode == "minor", F.pmod(tonic + 3, F.lit(12))).otherwise(tonic)
    at = tonic.cast("int") + 1
    name = F.when(relative.isin(*FLAT_MAJORS), F.element_at(F.array(*[F.lit(n) for n in FLATS]), at)).otherwise(F.element_at(F.array(*[F.lit(n) for n in SHARPS]), at))
    return F.concat_ws(" ", name, mode)


def consensus_pitch(midi: Column, f0: Column, octave_slack: float = 1.0, far: float = 5.0) -> Column:
    """One pitch from a note number and a measured one.

    About an octave apart: the note moved by that octave. Far apart: the measured pitch, rounded.
    Else the note; where one is null, the other.
    """
    d = f0 - midi
    moved = F.when(d > 0, midi + 12).otherwise(midi - 12)
    both = F.when(F.abs(F.abs(d) - 12.0) <= octave_slack, moved).when(F.abs(d) >= far, F.rint(f0)).otherwise(midi)
    return F.when(midi.isNull(), F.rint(f0)).when(f0.isNull(), midi).otherwise(both).cast("int")


def even_share(n: Column, parts: Column, index: Column) -> Column:
    """How many of ``n`` things part ``index`` (from 0) of ``parts`` gets; the first parts get the rest."""
    return F.floor(n / parts) + (index < n % parts).cast("long")


def clamped_ramp(t: Column, start: Column, end: Column, fade: float) -> Column:
    """Opacity of something visible in [start, end) that fades in and out over ``fade`` seconds."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - start) / fade, (end - t) / fade))


def stable_window(start: Column, end: Column, trim: float = 0.05, least: float = 0.16) -> Column:
    """The window without its edges, as struct(start, end); null if the window is too short."""
    edge = F.least(F.lit(trim), 0.25 * (end - start))
    return F.when(end - start >= least, F.struct((start + edge).alias("start"), (end - edge).alias("end")))


def transition_windows(start: Column, end: Column, trim: float = 0.05, least: float = 0.16) -> Column:
    """What the stable window leaves: a short window whole, else its two edges, as an array of structs."""
    edge = F.least(F.lit(trim), 0.25 * (end - start))
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    two = F.array(F.struct(start.alias("start"), (start + edge).alias("end")), F.struct((end - edge).alias("start"), end.alias("end")))
    return F.when(end <= start, F.slice(whole, 1, 0)).when(end - start < least, whole).otherwise(two)
