"""Pages and rows: greedy packing, splitting and periodic pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def next_fit(widths: Sequence[float], span: float, lead: float = 0.0, between: float = 0.0, slack: float = 0.0) -> list[int]:
    """The page of each item: an item that doesn't fit begins a page; an oversized one has its own."""
    pages: list[int] = []
    used = lead
    for w in widths:
        fresh = not pages
        add = w if fresh else between + w
        if not fresh and used + add > span - slack:
            pages.append(pages[-1] + 1)
            used = lead + w
        else:
            pages.append(pages[-1] if pages else 0)
            used += add
    return pages


def split_oversized(group: Sequence[int], width: Callable[[Sequence[int]], float], budget: float, starts: Sequence[float], ends: Sequence[float], line_of: Sequence[int]) -> list[list[int]]:
    """A group over ``budget`` is cut in two until all parts fit.

    Cuts at line changes come first, else any; of those the one at the largest gap (to the
    millisecond), then nearest the middle, then the first.
    """
    parts, todo = [], [list(group)]
    while todo:
        g = todo.pop()
        if width(g) <= budget or len(g) < 2:
            parts.append(g)
            continue
        joints = [k for k in range(len(g) - 1) if line_of[g[k]] != line_of[g[k + 1]]] or range(len(g) - 1)
        cut = min(joints, key=lambda k: (-round(starts[g[k + 1]] - ends[g[k]], 3), abs(k - (len(g) - 1) / 2), k))
        todo += [g[cut + 1 :], g[: cut + 1]]
    return parts


def balanced_split(widths: Sequence[float], budget: float) -> list[int]:
    """Consecutive items over as few pages as next-fit needs, page loads evened out in two passes."""
    page = next_fit(widths, budget)
    for _ in range(2):
        for k in range(len(widths) - 2, -1, -1):
            if page[k + 1] == page[k] + 1:
                load = sum(w for w, p in zip(widths, page, strict=True) if p == page[k])
                after = sum(w for w, p in zip(widths, page, strict=True) if p == page[k + 1])
                if load - widths[k] >= after + widths[k] and after + widths[k] <= budget and page.count(page[k]) > 1:
                    page[k] += 1
    return page


def layout(pages: Sequence[Sequence[Sequence[int]]], notes: Sequence[tuple[float, float, int]], slots: Sequence[float], span: float, lead: float, gap: float, between: float, quarter: float, count_in: float = 4.0, flip: float = 0.5, breath: float = 0.0, breath_gap: float = 0.25) -> tuple[list[tuple[float, float, int]], list[tuple[float, float]]]:
    """(display notes, anchors of the map from real to display time, strictly increasing).

    A slot is as wide as its note's snapped duration and its bar ends ``gap`` before the slot. Before
    a page that follows a long rest the page is turned ``flip`` seconds after the last note and the
    cursor waits at the edge until ``count_in`` quarters before the first note; before a shorter
    rest (over 0.12 s) it is turned early in the rest.
    """
    bars: list[tuple[float, float, int]] = []
    anchors = [(0.0, 0.0)]

    def mark(real: float, shown: float) -> None:
        r, d = anchors[-1]
        anchors.append((real if real > r + 1e-6 else r + 1e-4, shown if shown > d + 1e-6 else d + 1e-4))

    for number, page in enumerate(pages):
        edge, before, onset = number * span, anchors[-1][0], notes[page[0][0]][0]
        ready = onset - count_in * quarter
        if ready - (before + flip) > 0.25:
            mark(before + flip, edge)
            mark(ready, edge + 1e-3)
        elif onset - before > 0.12:
            mark(before + max(0.08, 0.25 * (onset - before)), edge)
        x = edge + lead
        for k, phrase in enumerate(page):
            x += between if k else 0.0
            for i, after in zip(phrase, [*phrase[1:], None], strict=True):
                s, e, p = notes[i]
                bars.append((x, x + slots[i] - gap, p))
                mark(s, x)
                mark(e, x + slots[i] - gap)
                x += slots[i] + (breath if after is not None and notes[after][0] - e > breath_gap else 0.0)
    mark(anchors[-1][0] + 30.0, anchors[-1][1] + 30.0)
    return bars, anchors


def line_pages(lines: DataFrame, size: int, key: str = "track_id", tail: float = 1.0) -> DataFrame:
    """``(key, page, start, end, first_line, n_lines)``: blocks of ``size`` lines in order.

    A page starts no earlier than the latest end before it; ``end`` is its last line's latest end.
    """
    n = F.row_number().over(W.partitionBy(key).orderBy("start", "end", "line"))
    blocks = lines.withColumn("page", F.floor((n - 1) / size).cast("int")).groupBy(key, "page").agg(F.min("start").alias("raw"), F.max("end").alias("end"), F.min("line").alias("first_line"), F.count("*").alias("n_lines"))
    before = F.max("end").over(W.partitionBy(key).orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    return blocks.select(key, "page", F.greatest("raw", F.coalesce(before, F.col("raw"))).alias("start"), "end", "first_line", "n_lines")


def filler_pages(spans: DataFrame, interval: float = 4.0, key: str = "track_id", tail: float = 1.0) -> DataFrame:
    """``(key, page, start, label)`` for keys without lines: a page every ``interval`` seconds from 0 up to
    the end of ``spans(key, end)``, and a last mark ``tail`` after that."""
    pages = spans.select(key, "end", F.ceil(F.greatest(F.col("end"), F.lit(0.0)) / interval).cast("int").alias("n")).select(key, "end", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("page"))
    last = F.col("page") == F.col("n")
    label = F.when(last, "END").otherwise(F.format_string("P%02d", F.col("page") + 1))
    return pages.select(key, "page", F.when(last, F.col("end") + tail).otherwise(F.col("page") * interval).alias("start"), label.alias("label"))


def beat_pages(notes: DataFrame, page: float, key: str = "track_id") -> DataFrame:
    """Fixed-period pages over each key's whole span, with the notes that start on each."""
    span = notes.groupBy(key).agg(F.min("start").alias("from"), F.max("end").alias("to"))
    count = F.greatest(F.ceil((F.col("to") - F.col("from")) / page), F.lit(1)).cast("long")
    pages = span.select(key, "from", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("page"))
    hits = notes.join(span, key).select(key, F.least(F.floor((F.col("start") - F.col("from")) / page), count - 1).alias("page")).groupBy(key, "page").agg(F.count("*").alias("n"))
    return pages.join(hits, [key, "page"], "left").select(key, "page", (F.col("from") + F.col("page") * page).alias("start"), (F.col("from") + (F.col("page") + 1) * page).alias("end"), F.coalesce("n", F.lit(0)).alias("n_notes"))


def row_of(df: DataFrame, order: Sequence[str], rows: int = 2, key: str = "track_id") -> DataFrame:
    """``row``: place in the order modulo ``rows``."""
    return df.withColumn("row", ((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) % rows).cast("int"))


def slot_positions(items: DataFrame, order: Sequence[str], gap: float, key: str = "track_id", width: str = "width", out: str = "x") -> DataFrame:
    """``x``: where each item starts if items are laid end to end with ``gap`` between."""
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn(out, F.coalesce(F.sum(F.col(width) + gap).over(before), F.lit(0.0)))


def place_marks(wanted: Sequence[float], step: float) -> list[float]:
    """Each mark at its place, or moved right by ``step`` until it is that far from all placed marks."""
    placed: list[float] = []
    for x in wanted:
        while any(abs(x - y) < step - 1e-9 for y in placed):
            x += step
        placed.append(x)
    return placed
