"""Set operations and joins on half-open intervals, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _buckets(start: Column, end: Column, width: float) -> Column:
    """Numbers of the buckets of ``width`` that [start, end] touches."""
    return F.sequence(F.floor(start / width), F.greatest(F.floor(end / width), F.floor(start / width)))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "track_id", bucket: float = 86400.0, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals of a key: ``left`` columns, and ``right`` ones prefixed ``r_``.

    Overlap is strict (touching doesn't count). Both sides are dealt over time buckets, so a hot key
    is spread over tasks; a pair that meets in several buckets counts in that of the later start.
    ``how`` is inner, left_semi or left_anti; the last two need ``left`` rows to be distinct in
    (key, start, end, note_id) and add no columns.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    if how != "inner":
        r = r.select(f"r_{key}", "r_start", "r_end").distinct()
    r = r.withColumn("b", F.explode(_buckets(F.col("r_start"), F.col("r_end"), bucket)))
    l_ = left.withColumn("b", F.explode(_buckets(F.col("start"), F.col("end"), bucket)))
    on = (l_[key] == r[f"r_{key}"]) & (l_["b"] == r["b"]) & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    pairs = l_.join(r, on).where(F.floor(F.greatest("start", "r_start") / bucket) == l_["b"]).drop("b")
    if how == "inner":
        return pairs
    names = [c for c in (key, "note_id", "start", "end") if c in left.columns]
    seen = pairs.select(*names).distinct()
    return left.join(seen, names, how)


def points_in(points: DataFrame, windows: DataFrame, key: str = "track_id", t: str = "t", bucket: float = 86400.0) -> DataFrame:
    """Every pair of a point and a window [start, end) that holds it; window columns prefixed ``w_``."""
    w = windows.select(*[F.col(c).alias(f"w_{c}") for c in windows.columns]).where("w_end > w_start")
    w = w.withColumn("b", F.explode(_buckets(F.col("w_start"), F.col("w_end"), bucket)))
    p = points.withColumn("b", F.floor(F.col(t) / bucket))
    on = (p[key] == w[f"w_{key}"]) & (p["b"] == w["b"]) & (F.col(t) >= F.col("w_start")) & (F.col(t) < F.col("w_end"))
    return p.join(w, on).drop("b")


def points_masked(points: DataFrame, windows: DataFrame, key: str = "track_id", t: str = "t", bucket: float = 86400.0) -> DataFrame:
    """The points that lie in any window (semi join)."""
    w = windows.where("end > start").select(F.col(key).alias("w_key"), F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    w = w.withColumn("b", F.explode(_buckets(F.col("w_start"), F.col("w_end"), bucket)))
    p = points.withColumn("b", F.floor(F.col(t) / bucket))
    on = (p[key] == w["w_key"]) & (p["b"] == w["b"]) & (F.col(t) >= F.col("w_start")) & (F.col(t) < F.col("w_end"))
    return p.join(w, on, "left_semi").drop("b")


def merge_windows(df: DataFrame, key: str = "track_id", gap: float = 0.0, keep_last_end: bool = False) -> DataFrame:
    """Windows merged where the next starts at most ``gap`` after the running end.

    ``keep_last_end`` gives a merged window the end of its last member instead of the greatest.
    """
    order = W.partitionBy(key).orderBy("start", "end")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    edge = F.lag("end").over(order) if keep_last_end else F.max("end").over(before)
    marked = df.withColumn("new", F.coalesce((F.col("start") - edge > gap).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    end = F.max_by("end", F.struct("start", "end")) if keep_last_end else F.max("end")
    return numbered.groupBy(key, "island").agg(F.min("start").alias("start"), end.alias("end")).drop("island")


def union_windows(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    return merge_windows(a.select(key, "start", "end").unionByName(b.select(key, "start", "end")), key)


def intersect_windows(a: DataFrame, b: DataFrame, key: str = "track_id", bucket: float = 86400.0) -> DataFrame:
    """Overlaps of two lists that are each merged."""
    pairs = overlap_join(a.select(key, "start", "end"), b.select(key, "start", "end"), key, bucket)
    return pairs.select(key, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


def pad_clamp(df: DataFrame, pad: float, low: float | None = 0.0, high: Column | float | None = None, key: str = "track_id", merge: bool = True) -> DataFrame:
    """Windows grown by ``pad`` on both sides, clamped to [low, high], touching ones merged."""
    start, end = F.col("start") - pad, F.col("end") + pad
    start = start if low is None else F.greatest(F.lit(low), start)
    end = end if high is None else F.least(end, high if isinstance(high, Column) else F.lit(high))
    out = df.select(key, start.alias("start"), end.alias("end")).where("end > start")
    return merge_windows(out, key) if merge else out


def gaps_between(df: DataFrame, key: str = "track_id") -> DataFrame:
    """The spans that no window covers, open at both sides (null start or end)."""
    m = merge_windows(df, key)
    order = W.partitionBy(key).orderBy("start")
    inner = m.select(key, F.lag("end").over(order).alias("start"), F.col("start").alias("end"))
    last = m.groupBy(key).agg(F.max("end").alias("start")).select(key, "start", F.lit(None).cast("double").alias("end"))
    return inner.unionByName(last)


def fill_from(primary: DataFrame, fallback: DataFrame, key: str = "track_id", least: float = 0.08, guard: float = 0.02, bucket: float = 86400.0) -> DataFrame:
    """``fallback`` intervals minus ``primary`` ones: pieces shrunk by ``guard`` on sides that were cut
    or not, kept if they were at least ``least + 2 * guard`` long. Other fallback columns are carried."""
    bounds = fallback.groupBy(key).agg((F.min("start") - 1).alias("lo"), (F.max("end") + 1).alias("hi"))
    gaps = gaps_between(primary.select(key, "start", "end"), key).join(bounds, key)
    gaps = gaps.select(key, F.coalesce("start", "lo").alias("start"), F.coalesce("end", "hi").alias("end")).where("end > start")
    pairs = overlap_join(fallback, gaps, key, bucket)
    cut = pairs.withColumn("s", F.greatest("start", "r_start")).withColumn("e", F.least("end", "r_end"))
    lone = fallback.join(primary.select(F.col(key).alias("p_key")).distinct(), F.col(key) == F.col("p_key"), "left_anti")
    rest = [c for c in fallback.columns if c not in (key, "start", "end")]
    pieces = cut.select(key, F.col("s").alias("start"), F.col("e").alias("end"), *rest).unionByName(lone.select(key, "start", "end", *rest))
    long_enough = pieces.where(F.col("end") - F.col("start") >= least + 2 * guard)
    return long_enough.withColumn("start", F.col("start") + guard).withColumn("end", F.col("end") - guard)


def covered_fraction(spans: DataFrame, segments: DataFrame, key: str = "track_id", bucket: float = 86400.0) -> DataFrame:
    """Share of each span that segments cover; overlapping segments count each."""
    pairs = overlap_join(spans, segments.select(key, "start", "end"), key, bucket)
    names = spans.columns
    summed = pairs.groupBy(*names).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("c"))
    out = spans.join(summed, names, "left")
    return out.withColumn("covered", F.when(F.col("end") > F.col("start"), F.coalesce("c", F.lit(0.0)) / (F.col("end") - F.col("start"))).otherwise(0.0)).drop("c")


def lyric_windows(lines: DataFrame, key: str = "track_id", margin: float = 0.3, tail: float = 0.0, guard: float = 0.05) -> DataFrame:
    """Windows of lines: the end may follow the tail up to shortly before the next start; padded, merged."""
    order = W.partitionBy(key).orderBy("start", "end")
    following = F.lead("start").over(order)
    grown = F.when(following.isNull(), F.col("end") + tail).otherwise(F.greatest(F.col("end"), F.least(F.col("end") + tail, following - guard)))
    out = lines.where("end > start").withColumn("end", grown)
    return merge_windows(out.select(key, F.greatest(F.lit(0.0), F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end")), key)


def largest_gap(windows: DataFrame, notes: DataFrame, key: str = "track_id", id_col: str = "window_id", bucket: float = 86400.0) -> DataFrame:
    """``(key, window_id, start, end)``: the longest part of each window that no note covers, first of equals."""
    pairs = overlap_join(windows, notes.select(key, "start", "end"), key, bucket)
    clipped = pairs.select(key, id_col, F.col("start").alias("ws"), F.col("end").alias("we"), F.greatest("start", "r_start").alias("s"), F.least("end", "r_end").alias("e"))
    ends = windows.select(key, id_col, F.col("start").alias("ws"), F.col("end").alias("we"), F.col("end").alias("s"), F.col("end").alias("e"))
    order = W.partitionBy(key, id_col).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    swept = clipped.unionByName(ends).withColumn("from", F.coalesce(F.greatest(F.max("e").over(order), F.col("ws")), F.col("ws")))
    best = F.max_by(F.struct(F.col("from").alias("start"), F.col("s").alias("end")), F.struct(F.col("s") - F.col("from"), -F.col("from")))
    return swept.groupBy(key, id_col).agg(best.alias("g")).select(key, id_col, "g.*")


def argmax_overlap(left: DataFrame, right: DataFrame, right_id: str, key: str = "track_id", near: float | None = None, bucket: float = 86400.0) -> DataFrame:
    """``left`` with ``match``: the right interval of the largest overlap, the first (start, id) of equals.

    Without overlap, the nearest within ``near`` (strictly less); else null.
    """
    names = left.columns
    pairs = overlap_join(left, right.select(key, "start", "end", right_id), key, bucket)
    found = pairs.withColumn("rank", F.struct((F.least("end", "r_end") - F.greatest("start", "r_start")).alias("o"), (-F.col("r_start")).alias("s"), (-F.col(f"r_{right_id}")).alias("i")))
    best = found.groupBy(*names).agg(F.max_by(f"r_{right_id}", "rank").alias("match"))
    out = left.join(best, names, "left")
    if near is None:
        return out
    alone = out.where("match is null").select(*names)
    grown = overlap_join(alone.withColumn("s0", F.col("start")).withColumn("e0", F.col("end")).withColumn("start", F.col("start") - near).withColumn("end", F.col("end") + near), right.select(key, "start", "end", right_id), key, bucket)
    gap = F.greatest(F.col("r_start") - F.col("e0"), F.col("s0") - F.col("r_end"), F.lit(0.0))
    close = grown.withColumn("gap", gap).where(F.col("gap") < near).withColumn("start", F.col("s0")).withColumn("end", F.col("e0"))
    nearest = close.groupBy(*names).agg(F.min_by(f"r_{right_id}", F.struct("gap", "r_start", f"r_{right_id}")).alias("close"))
    return out.join(nearest, names, "left").select(*names, F.coalesce("match", "close").alias("match"))


def latest_covering(points: DataFrame, windows: DataFrame, value: str, key: str = "track_id", t: str = "t", bucket: float = 86400.0) -> DataFrame:
    """Per point the window holding it that starts last (the later id of equals), as ``{value}``; null if none."""
    hit = points_in(points, windows, key, t, bucket)
    best = hit.groupBy(*points.columns).agg(F.max_by(f"w_{value}", F.struct("w_start", f"w_{value}")).alias(value))
    return points.join(best, points.columns, "left")
