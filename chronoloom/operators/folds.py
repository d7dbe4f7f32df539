"""Rules whose next decision depends on rows they have already rewritten: one pass per key.

The per-key functions take and return plain lists in order, so that they can be tested without
Spark; ``by_key`` runs them over a DataFrame. A key is a song: its rows fit a task by definition.
"""

from __future__ import annotations

import bisect
import statistics
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from .intervals import points_in

Note = tuple[float, float, int]
NOTE_SCHEMA = "start double, end double, pitch int"


def by_key(df: DataFrame, fn: Callable[[list[tuple]], Sequence[tuple]], inputs: Sequence[str], order: Sequence[str], schema: str, key: str = "track_id") -> DataFrame:
    """``fn`` over each key's rows of ``inputs``, sorted by ``order``; its tuples follow ``schema``.

    Rows are dealt by key and sorted, and each task streams through its keys: only one key's rows
    are held at a time, and many small keys cost no more than their rows. Nulls arrive as None.
    """
    wanted = list(dict.fromkeys([key, *inputs, *order]))
    out = T.StructType.fromDDL(f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
    fields = to_arrow_schema(out)
    # an explicit number of partitions, as run-time coalescing goes by bytes and these rules cost time
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: object = None
        ready: list[tuple] = []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, row in zip(keys, zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True), strict=True):
                if held and k != now:
                    ready += [(now, *r) for r in fn(held)]
                    held = []
                now = k
                held.append(row)
            if len(ready) >= 10_000:
                yield made(ready)
                ready = []
        if held:
            ready += [(now, *r) for r in fn(held)]
        yield made(ready)

    return df.select(*wanted).repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def together(parts: Sequence[tuple[DataFrame, Sequence[str]]], fn: Callable[..., Sequence[tuple]], schema: str, key: str = "track_id") -> DataFrame:
    """``fn`` over each key's rows of several tables, one list of tuples for each.

    ``parts`` are tables with the columns to hand over, which also say the rows' order. A key that a
    table lacks has an empty list there. Rows travel one by one as in ``by_key``; none is repeated for
    the rows of another table.
    """
    rows = None
    for i, (df, columns) in enumerate(parts):
        side = [F.struct(*columns).alias(f"p{j}") if i == j else F.lit(None).cast(other.select(F.struct(*names)).schema[0].dataType).alias(f"p{j}") for j, (other, names) in enumerate(parts)]
        one = df.select(key, F.lit(i).alias("part"), *side)
        rows = one if rows is None else rows.unionByName(one)
    names = [f"p{j}" for j in range(len(parts))]

    def run(held: list[tuple]) -> Sequence[tuple]:
        lists: list[list[tuple]] = [[] for _ in parts_range]
        for part, *sides in held:
            lists[part].append(tuple(sides[part].values()))
        return fn(*lists)

    parts_range = range(len(parts))
    return by_key(rows, run, ("part", *names), ("part", *names), schema, key)


def drop_fragments(notes: list[Note], least: float, touch: float = 0.05, near: int = 2) -> list[Note]:
    """Notes shorter than ``least`` lengthen the last kept note they touch (close in pitch), or go."""
    kept: list[Note] = []
    for s, e, p in notes:
        if e - s >= least:
            kept.append((s, e, p))
        elif kept:
            ks, ke, kp = kept[-1]
            if s - ke <= touch and abs(p - kp) <= near:
                kept[-1] = (ks, max(ke, e), kp)
    return kept


def _sandwiched(a: Note, b: Note, c: Note, longest: float, near: int, touch: float) -> bool:
    """Whether ``b`` is a short note between two of one pitch close to its own."""
    return b[1] - b[0] <= longest and a[2] == c[2] and 0 < abs(b[2] - a[2]) <= near and b[0] - a[1] < touch and c[0] - b[1] < touch


def absorb_wiggles(notes: list[Note], longest: float = 0.22, near: int = 2, touch: float = 0.15) -> list[Note]:
    """Short notes between two of one pitch take that pitch; a decision sees the pitches already changed."""
    out = list(notes)
    for i in range(1, len(notes) - 1):
        if _sandwiched(*out[i - 1 : i + 2], longest, near, touch):
            out[i] = (*out[i][:2], out[i - 1][2])
    return out


def weighted_median(values: Sequence[float], weights: Sequence[float]) -> float:
    """The first value, in order of (value, weight), at which half of all weight is reached."""
    total = sum(weights)
    if total == 0:
        return float(statistics.median(values))
    pairs = sorted(zip(values, weights, strict=True))
    reached = np.cumsum([w for _, w in pairs])
    at = np.flatnonzero(reached >= total / 2)
    return float(pairs[at[0]][0]) if len(at) else float(values[-1])


def raise_phrase_octaves(notes: DataFrame, key: str = "track_id", pitch: str = "pitch", jump: tuple[int, int] = (10, 15), near: int = 4, passes: int = 5) -> DataFrame:
    """Notes that lie an octave under their key's duration-weighted median go up, pass by pass.

    A pass is one window and one aggregate per key; no rows are gathered. Passes without an effect
    change nothing, so all of them are in the plan.
    """
    out = notes
    for _ in range(passes):
        dur = F.col("end") - F.col("start")
        order = W.partitionBy(key).orderBy(pitch, dur).rowsBetween(W.unboundedPreceding, 0)
        reached = out.withColumn("_c", F.sum(dur).over(order)).withColumn("_t", F.sum(dur).over(W.partitionBy(key)))
        least = F.min(F.when(F.col("_c") >= F.col("_t") / 2, F.col(pitch))).over(W.partitionBy(key))
        under = F.col("_a") - F.col(pitch)
        lift = (under >= jump[0]) & (under <= jump[1] + 2) & (F.abs(F.col(pitch) + 12 - F.col("_a")) <= near)
        out = reached.withColumn("_a", least).withColumn(pitch, F.when(lift, F.col(pitch) + 12).otherwise(F.col(pitch)).cast(notes.schema[pitch].dataType)).drop("_c", "_t", "_a")
    return out


def raise_local_octaves(notes: list[Note], jump: tuple[int, int] = (10, 15), window: int = 5, near: int = 4) -> list[Note]:
    """Notes an octave under the median of their neighbours go up; earlier neighbours count as corrected."""
    if len(notes) < 3:
        return list(notes)
    pitches = [p for _, _, p in notes]
    for i, p in enumerate(pitches):
        around = pitches[max(0, i - window) : i] + pitches[i + 1 : i + 1 + window]
        middle = int(statistics.median(around))
        if jump[0] <= middle - p <= jump[1] + 2 and abs(p + 12 - middle) <= near:
            pitches[i] = p + 12
    return [(s, e, p) for (s, e, _), p in zip(notes, pitches, strict=True)]


Run = tuple[int, int, int]  # value (negative: rest), start, end


def _joined(runs: Sequence[Run]) -> list[Run]:
    return [(v, g[0][1], g[-1][2]) for v, it in groupby(runs, key=lambda r: max(r[0], -1)) if (g := list(it))]


def settle_runs(runs: Sequence[Run], least: int, gap: int) -> list[Run]:
    """Short runs are merged into their neighbours until nothing changes.

    A short rest between equal pitches joins them. A short note, by the first rule that fits: joins
    equal pitches around it; goes to a long note before it within a semitone; goes to a long note
    after it; becomes a rest. The note before counts as already merged.
    """
    now = _joined(runs)
    while True:
        done: list[Run] = []
        todo = list(reversed(now))
        changed = False
        while todo:
            value, start, end = todo.pop()
            before = done[-1] if done and done[-1][0] >= 0 else None
            after = todo[-1] if todo and todo[-1][0] >= 0 else None
            long = {id(r): r[2] - r[1] >= least for r in (before, after) if r}
            bridge = before and after and before[0] == after[0]
            if value < 0:
                act = "bridge" if bridge and end - start <= gap else "keep"
            elif end - start >= least:
                act = "keep"
            elif bridge:
                act = "bridge"
            elif before and long[id(before)] and abs(before[0] - value) <= 1:
                act = "before"
            elif after and long[id(after)]:
                act = "after"
            else:
                act = "rest"
            changed |= act != "keep"
            if act == "bridge":
                done[-1] = (before[0], before[1], todo.pop()[2])
            elif act == "before":
                done[-1] = (before[0], before[1], end)
            elif act == "after":
                done.append((after[0], start, todo.pop()[2]))
            else:
                done.append((-1 if act == "rest" else value, start, end))
        now = _joined(done)
        if not changed:
            return now


def merge_scoops(notes: list[tuple], longest: float = 0.25, rise: int = 3, gap: float = 0.04, ratio: float = 1.5) -> list[tuple]:
    """``(start, end, pitch, mora)``: a mora's short first note that rises into a longer one is folded into it.

    After a fold the lengthened note is tested again against its successor.
    """
    out: list[tuple] = []
    seen: set = set()
    rest = list(reversed(notes))
    while rest:
        s, e, p, m = rest.pop()
        if rest and m is not None and m >= 0 and m not in seen:
            ns, ne, np_, nm = rest[-1]
            if nm == m and e - s <= longest and ne - ns >= ratio * (e - s) and 1 <= np_ - p <= rise and ns - e <= gap:
                rest[-1] = (s, ne, np_, nm)
                continue
        seen.add(m)
        out.append((s, e, p, m))
    return out


def split_at(notes: list[Note], onsets: Sequence[float], least: float = 0.12) -> list[Note]:
    """Notes cut at onsets at least ``least`` from both ends and from the cut before."""
    out: list[Note] = []
    onsets = sorted(onsets)
    for s, e, p in notes:
        last = s
        for t in onsets[bisect.bisect_left(onsets, s + least) : bisect.bisect_right(onsets, e - least)]:
            if t - last >= least:
                out.append((last, t, p))
                last = t
        out.append((last, e, p))
    return out


def split_at_onsets(notes: DataFrame, onsets: DataFrame, least: float = 0.12, key: str = "track_id", pitch: str = "pc") -> DataFrame:
    """``split_at`` for ``notes(key, note_id, start, end, pitch)`` and ``onsets(key, start)``.

    Onsets meet the notes in a range join, so that a note sees its own alone; note_id tells notes apart.
    """
    wide = notes.select(key, "note_id", F.col("start"), F.col("end"))
    inside = points_in(onsets.select(key, F.col("start").alias("t")), wide, key).where((F.col("t") >= F.col("w_start") + least) & (F.col("t") <= F.col("w_end") - least))
    kind = notes.schema[pitch].dataType.simpleString()
    parts = [(notes, ("start", "end", pitch)), (inside.select(F.col("w_note_id").alias("note_id"), "t"), ("t",))]
    return together(parts, lambda n, t: split_at(n, [x for (x,) in t], least), f"start double, end double, {pitch} {kind}", "note_id")


def cut_long(spans: list[tuple[float, float]], times: Sequence[float], levels: Sequence[float], longest: float, least_share: float = 0.4) -> list[tuple[float, float]]:
    """Spans over ``longest`` cut, again and again, at the quietest frame in the later part of the allowance."""
    t = np.asarray(times, dtype=float)
    v = np.asarray(levels, dtype=float)
    out = []
    for s, e in spans:
        while e - s > longest:
            a, b = np.searchsorted(t, s + least_share * longest, "left"), np.searchsorted(t, s + longest, "right")
            cut = float(t[a + int(np.argmin(v[a:b]))]) if b > a else s + longest
            cut = cut if cut > s else s + longest
            out.append((s, cut))
            s = cut
        out.append((s, e))
    return out


def cluster_onsets(notes: list[Note], tolerance: float) -> list[Note]:
    """Of notes that start within ``tolerance`` of a cluster's first, the highest (the longer of equals)."""
    out: list[Note] = []
    group: list[Note] = []
    for n in notes:
        if group and n[0] - group[0][0] > tolerance:
            out.append(max(group, key=lambda x: (x[2], x[1] - x[0])))
            group = []
        group.append(n)
    return out + ([max(group, key=lambda x: (x[2], x[1] - x[0]))] if group else [])


def tail_end(end: float, next_start: float | None, times: Sequence[float], active: Sequence[bool], hop: float, tail_gap: float = 0.25, guard: float = 0.12, most: float = 3.0) -> float:
    """How far a line's end may follow a sounding tail: over silences up to ``tail_gap``, at most
    ``most`` seconds, and to ``guard`` before the next start. Never earlier than ``end``."""
    limit = end + most if next_start is None else min(end + most, next_start - guard)
    reached = end
    for t, on in zip(times, active, strict=True):
        if t < end:
            continue
        if t > limit or t - reached > tail_gap:
            break
        if on:
            reached = t + hop
    return max(end, min(reached, limit))
