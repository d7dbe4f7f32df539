"""As-of, nearest and interpolating lookups: one sort per key, no self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _stacked(points: DataFrame, marks: DataFrame, key: str, t: str, mark_t: str, marks_first: bool) -> DataFrame:
    """Points and marks of a key in one column ``_at``; ``_side`` orders equals."""
    p = points.select(F.col(key).alias("_k"), F.col(t).alias("_at"), F.lit(1 if marks_first else 0).alias("_side"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(marks.select(F.struct(*marks.columns)).schema[0].dataType).alias("_m"))
    m = marks.select(F.col(key).alias("_k"), F.col(mark_t).alias("_at"), F.lit(0 if marks_first else 1).alias("_side"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"), F.struct(*marks.columns).alias("_m"))
    return p.unionByName(m)


def asof_backward(points: DataFrame, marks: DataFrame, key: str = "track_id", t: str = "t", mark_t: str = "t", tolerance: float = 0.0, tie: str | None = None) -> DataFrame:
    """Each point with ``mark``: the last mark at or before ``t + tolerance`` (null if there is none)."""
    shifted = points.withColumn("_t", F.col(t) + tolerance)
    order = W.partitionBy("_k").orderBy("_at", "_side", *([F.col(f"_m.{tie}")] if tie else []))
    stacked = _stacked(shifted, marks, key, "_t", mark_t, marks_first=True)
    found = stacked.withColumn("mark", F.last("_m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return found.where("_p is not null").select(*[F.col(f"_p.{c}").alias(c) for c in points.columns], "mark")


def asof_forward(points: DataFrame, marks: DataFrame, key: str = "track_id", t: str = "t", mark_t: str = "t") -> DataFrame:
    """Each point with ``mark``: the first mark at or after it; past the end, the last mark."""
    order = W.partitionBy("_k").orderBy("_at", "_side")
    stacked = _stacked(points, marks, key, t, mark_t, marks_first=False)
    ahead = F.first("_m", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    behind = F.last("_m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return stacked.withColumn("mark", F.coalesce(ahead, behind)).where("_p is not null").select(*[F.col(f"_p.{c}").alias(c) for c in points.columns], "mark")


def nearest(points: DataFrame, marks: DataFrame, key: str = "track_id", t: str = "t", mark_t: str = "t", beyond: float | None = None, within: float | None = None) -> DataFrame:
    """Each point with ``mark``: the nearest mark at a distance over ``beyond`` and at most ``within``.

    The earlier of equals. With ``beyond`` the nearest mark outside the dead zone is looked for on
    either side.
    """
    dead = 0.0 if beyond is None else beyond
    p = points.withColumn("_lo", F.col(t) - dead).withColumn("_hi", F.col(t) + dead)
    back = _stacked(p, marks, key, "_lo", mark_t, marks_first=beyond is None)
    before = W.partitionBy("_k").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    got = back.withColumn("b", F.last("_m", ignorenulls=True).over(before)).where("_p is not null").select(*[F.col(f"_p.{c}").alias(c) for c in p.columns], "b")
    ahead = _stacked(got, marks, key, "_hi", mark_t, marks_first=beyond is not None)
    after = W.partitionBy("_k").orderBy("_at", "_side").rowsBetween(0, W.unboundedFollowing)
    both = ahead.withColumn("f", F.first("_m", ignorenulls=True).over(after)).where("_p is not null").select(*[F.col(f"_p.{c}").alias(c) for c in points.columns], F.col("_p.b").alias("b"), "f")
    db, df = F.col(t) - F.col(f"b.{mark_t}"), F.col(f"f.{mark_t}") - F.col(t)
    mark = F.when(F.col("f").isNull() | (db <= df), F.col("b")).otherwise(F.col("f"))
    out = both.withColumn("mark", mark).drop("b", "f")
    if within is not None:
        out = out.withColumn("mark", F.when(F.abs(F.col(f"mark.{mark_t}") - F.col(t)) <= within, F.col("mark")))
    return out


def fill_nearest(df: DataFrame, value: str, key: str = "track_id", index: str = "frame") -> DataFrame:
    """Nulls of ``value`` replaced by the known value nearest in ``index``, the earlier of equals."""
    order = W.partitionBy(key).orderBy(index)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    marked = df.withColumn("_k", known)
    marked = marked.withColumn("_b", F.last("_k", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_f", F.first("_k", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    pick = F.when(F.col("_f").isNull() | (F.col(index) - F.col("_b.i") <= F.col("_f.i") - F.col(index)), F.col("_b.v")).otherwise(F.col("_f.v"))
    return marked.withColumn(value, pick).drop("_k", "_b", "_f")


def fill_linear(df: DataFrame, value: str, key: str = "track_id", index: str = "frame", max_gap: int | None = None, max_step: float | None = None, one_sided: bool = False) -> DataFrame:
    """Inner runs of nulls replaced by linear interpolation in ``index``.

    ``max_gap``: only runs of at most so many nulls; ``max_step``: only between values that differ by
    at most that. ``one_sided``: leading and trailing nulls take the nearest value.
    """
    order = W.partitionBy(key).orderBy(index)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    marked = df.withColumn("_k", known)
    marked = marked.withColumn("_b", F.last("_k", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_f", F.first("_k", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    span = F.col("_f.i") - F.col("_b.i")
    line = F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * ((F.col(index) - F.col("_b.i")) / span)
    allowed = F.col("_b").isNotNull() & F.col("_f").isNotNull()
    if max_gap is not None:
        allowed = allowed & (span - 1 <= max_gap)
    if max_step is not None:
        allowed = allowed & (F.abs(F.col("_f.v") - F.col("_b.v")) <= max_step)
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(allowed, line)
    if one_sided:
        filled = filled.when(F.col("_b").isNull(), F.col("_f.v")).when(F.col("_f").isNull(), F.col("_b.v"))
    return marked.withColumn(value, filled).drop("_k", "_b", "_f")


def warp(points: DataFrame, anchors: DataFrame, t: str, source: str, target: str, out: str, key: str = "track_id") -> DataFrame:
    """``out``: the piecewise-linear image of ``t`` under the anchors (source -> target), clamped at both ends."""
    order = W.partitionBy(key).orderBy(source)
    a = anchors.select(key, F.col(source).alias("s0"), F.col(target).alias("d0"), F.lead(source).over(order).alias("s1"), F.lead(target).over(order).alias("d1"))
    low = F.first("d0").over(W.partitionBy(key).orderBy("s0").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    a = a.withColumn("low", low)
    found = asof_backward(points, a, key, t, "s0")
    firsts = a.groupBy(key).agg(F.min_by("d0", "s0").alias("_low"))
    m = F.col("mark")
    inside = m["d0"] + (F.col(t) - m["s0"]) * ((m["d1"] - m["d0"]) / (m["s1"] - m["s0"]))
    image = F.when(m.isNull(), F.col("_low")).when(m["s1"].isNull(), m["d0"]).otherwise(inside)
    return found.join(firsts, key, "left").withColumn(out, image).drop("mark", "_low")


def warp_notes(notes: DataFrame, anchors: DataFrame, source: str, target: str, key: str = "track_id", least: float = 0.01) -> DataFrame:
    """Notes with both ends mapped through the anchors; pieces of at most ``least`` are dropped."""
    starts = warp(notes, anchors, "start", source, target, "_s", key)
    both = warp(starts, anchors, "end", source, target, "_e", key)
    return both.where(F.col("_e") - F.col("_s") > least).withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_s", "_e")


def bar_cursor(points: DataFrame, bars: DataFrame, key: str = "track_id", t: str = "t") -> DataFrame:
    """``q``: the cursor over bars(start, end, x0, x1): linear inside, gliding across rests, clamped."""
    left = bars.select(key, F.col("start").alias("r"), F.col("x0").alias("x"))
    right = bars.select(key, F.col("end").alias("r"), F.col("x1").alias("x"))
    anchors = left.unionByName(right).groupBy(key, "r").agg(F.max("x").alias("x"))
    return warp(points, anchors, t, "r", "x", "q", key)

