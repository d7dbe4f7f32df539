"""Nested timed text: lines of tokens of characters, and what is written from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import clock, furigana

BOUND_POS = ("particle", "auxiliary", "suffix")


def nest_lines(chars: DataFrame, key: str = "track_id", line: str = "line", order: str = "ch", fields: Sequence[str] = ("label", "from", "to")) -> DataFrame:
    """``(key, line, text, start, end, chars)``: the characters of a line in order as an array of structs."""
    item = F.struct(order, *fields)
    packed = chars.groupBy(key, line).agg(F.sort_array(F.collect_list(item)).alias("chars"))
    return packed.select(key, line, F.array_join(F.transform("chars", lambda c: c[fields[0]]), "").alias("text"), F.array_min(F.transform("chars", lambda c: c[fields[1]])).alias("start"), F.array_max(F.transform("chars", lambda c: c[fields[2]])).alias("end"), "chars")


def unnest_chars(lines: DataFrame, key: str = "track_id", line: str = "line") -> DataFrame:
    return lines.select(key, line, F.explode("chars").alias("c")).select(key, line, "c.*")


def enhanced_lrc(lines: DataFrame, key: str = "track_id", line: str = "line", text: str = "label", at: str = "from") -> DataFrame:
    """``lrc``: the line's clock in brackets, then every character after its own clock in angles."""
    body = F.array_join(F.transform("chars", lambda c: F.concat(clock(c[at], "<", ">", "."), c[text])), "")
    return lines.select(key, line, F.concat(clock(F.col("start"), "[", "]", "."), body).alias("lrc"))


def line_spans(chars: DataFrame, key: str = "track_id", line: str = "line", sung: Column | None = None) -> DataFrame:
    """First start and last end of each line's sung characters."""
    kept = chars if sung is None else chars.where(sung)
    return kept.groupBy(key, line).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def first_and_last(chars: DataFrame, key: str = "track_id", line: str = "line", order: str = "ch", value: str = "label") -> DataFrame:
    """First and last character of each line in order."""
    return chars.groupBy(key, line).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def pin_unsung(chars: DataFrame, sung: Column, key: str = "track_id", order: Sequence[str] = ("line", "ch")) -> DataFrame:
    """Characters that aren't sung sit, without length, at the end of the sung one before, else at the next start."""
    w = W.partitionBy(key).orderBy(*order)
    marked = chars.withColumn("_s", sung)
    before = F.last(F.when(F.col("_s"), F.col("end")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(F.col("_s"), F.col("start")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    at = F.coalesce(before, after, F.lit(0.0))
    out = marked.withColumn("_at", at)
    return out.withColumn("start", F.round(F.when(F.col("_s"), F.col("start")).otherwise(F.col("_at")), 3)).withColumn("end", F.round(F.when(F.col("_s"), F.col("end")).otherwise(F.col("_at")), 3)).drop("_s", "_at")


def even_morae(chars: DataFrame, count: Column, key: str = "track_id") -> DataFrame:
    """Each character's span in ``count`` equal parts: ``mora``, ``start``, ``end``."""
    parts = chars.withColumn("_n", count).where("_n > 0").withColumn("mora", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = (F.col("end") - F.col("start")) / F.col("_n")
    return parts.withColumn("_s", F.col("start") + step * F.col("mora")).withColumn("end", F.col("start") + step * (F.col("mora") + 1)).withColumn("start", F.col("_s")).drop("_s", "_n")


def pages_of_tokens(tokens: DataFrame, pages: DataFrame, key: str = "track_id", order: Sequence[str] = ("line", "tok")) -> DataFrame:
    """Tokens with ``page`` (that on show at the token's middle, -1 before the first) and ``chunk``,
    which grows within a line where the page changes."""
    from .asof import asof_backward

    mid = tokens.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    found = asof_backward(mid, pages.select(key, "page", F.col("start").alias("at")), key, "_mid", "at", tie="page")
    paged = found.withColumn("page", F.coalesce(F.col("mark.page"), F.lit(-1))).drop("mark", "_mid")
    w = W.partitionBy(key, order[0]).orderBy(*order[1:])
    turn = F.coalesce((F.lag("page").over(w) != F.col("page")).cast("int"), F.lit(0))
    return paged.withColumn("_t", turn).withColumn("chunk", F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_t")


def settle_chunks(tokens: Sequence[tuple], least: int = 4, bound: Sequence[str] = BOUND_POS) -> list[int]:
    """Chunk of each token ``(chunk, start, end, chars, pos, is_punct)`` of one line.

    Punctuation and bound words at the head of a chunk go back to the chunk before. Then, from the
    front, a chunk of fewer than ``least`` characters joins the neighbour that is closer in time, the
    one before of equals.
    """
    groups: list[list[int]] = []
    for i, t in enumerate(tokens):
        if not groups or tokens[groups[-1][0]][0] != t[0]:
            groups.append([])
        groups[-1].append(i)
    for before, g in zip(groups, groups[1:], strict=False):
        while g and (tokens[g[0]][5] or tokens[g[0]][4] in bound):
            before.append(g.pop(0))
    groups = [g for g in groups if g]
    while len(groups) > 1:
        small = next((k for k, g in enumerate(groups) if sum(tokens[i][3] for i in g if not tokens[i][5]) < least), None)
        if small is None:
            break
        gaps = {}
        if small:
            gaps[small - 1] = tokens[groups[small][0]][1] - tokens[groups[small - 1][-1]][2]
        if small + 1 < len(groups):
            gaps[small + 1] = tokens[groups[small + 1][0]][1] - tokens[groups[small][-1]][2]
        other = min(gaps, key=lambda k: (gaps[k], k))
        a, b = sorted((small, other))
        groups[a : b + 1] = [groups[a] + groups[b]]
    out = [0] * len(tokens)
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out


def manual_breaks(tokens: DataFrame, breaks: DataFrame, key: str = "track_id", line: str = "line", order: str = "tok", width: str = "n_chars") -> DataFrame:
    """Tokens with ``part``: lines cut where the running count of characters reaches a stated count.

    ``breaks(key, line, at)`` lists the counts. A count inside a token is an error.
    """
    w = W.partitionBy(key, line).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    cuts = breaks.groupBy(key, line).agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    run = tokens.withColumn("upto", F.sum(width).over(w)).join(cuts, [key, line], "left")
    begin = F.col("upto") - F.col(width)
    inside = F.exists(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: (c > begin) & (c < F.col("upto")))
    part = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c <= begin))
    return run.withColumn("part", F.when(inside, F.raise_error(F.lit("a break lies inside a token"))).otherwise(part)).drop("upto", "cuts")


def fill_spans(pairs: DataFrame, key: str = "track_id", unit: str = "ch") -> DataFrame:
    """Characters whose units were aligned get the union of their spans; others sit between neighbours.

    ``pairs(key, unit, start, end)`` has several rows per unit, nulls where none was aligned. A unit
    without a span is at the linear place, by number, between the end before and the start after.
    """
    spans = pairs.groupBy(key, unit).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    w = W.partitionBy(key).orderBy(unit)
    before = F.last(F.when(F.col("start").isNotNull(), F.struct(F.col(unit).alias("i"), F.col("end").alias("t"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(F.when(F.col("start").isNotNull(), F.struct(F.col(unit).alias("i"), F.col("start").alias("t"))), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    s = spans.withColumn("_b", before).withColumn("_a", after)
    line = F.col("_b.t") + (F.col("_a.t") - F.col("_b.t")) * ((F.col(unit) - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i")))
    at = F.when(F.col("_b").isNull(), F.coalesce("_a.t", F.lit(0.0))).when(F.col("_a").isNull(), F.col("_b.t")).otherwise(line)
    return s.select(key, unit, F.coalesce("start", at).alias("start"), F.coalesce("end", at).alias("end"))


def stamp(seconds: float) -> str:
    """``[mm:ss:cc]``, as ``clock``."""
    cs = round(max(seconds, 0.0) * 100)
    return f"[{cs // 6000:02d}:{cs // 100 % 60:02d}:{cs % 100:02d}]"


def ruby_lines(lines: Sequence[Sequence[dict]], block: int = 2) -> str:
    """A song's lyric file: readings of kanji runs, then timed lines with a blank line every ``block``.

    ``lines`` are lists of tokens with surface, reading, kana_only, start, end and chars of (char,
    start, end). A reading's time ends 0.05 s after the tag of the character that follows it.
    """
    from ..functions.text import furigana

    if block not in (1, 2, 3, 4):
        raise ValueError(f"blocks have 1 to 4 lines, not {block}")
    readings: list[str] = []
    body: list[str] = []
    shown = 0
    for tokens in lines:
        chars = [c for t in tokens for c in t["chars"]]
        if not chars:
            continue
        at, end = 0, tokens[0]["start"]
        for t in tokens:
            end = max([end, *(c[2] for c in t["chars"])])
            wanted = furigana(t["surface"], t["reading"]) if t["reading"] and not t["kana_only"] and t["surface"] and t["chars"] else []
            for text, reading, a, b in wanted:
                if reading is None:
                    continue
                if b > len(t["chars"]):
                    start, stop = t["start"], t["end"]
                else:
                    start = t["chars"][a][1]
                    stop = chars[at + b][1] if at + b < len(chars) else max(t["chars"][b - 1][2], end)
                readings.append(f"@Ruby{len(readings) + 1}={text},{reading},{stamp(start)},{stamp(stop + 0.05)}")
            at += len(t["chars"])
        body.append("".join(stamp(c[1]) + c[0] for c in chars) + stamp(end))
        shown += 1
        if shown % block == 0:
            body.append("")
    return "\n".join([*readings, *([""] if readings else []), *body, ""])


def line_chars(tokens: Sequence[dict]) -> list[dict]:
    """The characters of a line's tokens with their times; the first of each run of kanji has the run's
    reading (``ruby``) and how many characters it covers (``ruby_span``)."""
    out: list[dict] = []
    for token in tokens:
        chars = [{"char": c["char"], "start": c["start"], "end": c["end"]} for c in token.get("chars") or ()]
        if token.get("reading") and not token.get("kana_only", True):
            for _, ruby, a, b in furigana("".join(c["char"] for c in chars), token["reading"]):
                if ruby:
                    chars[a] |= {"ruby": ruby, "ruby_span": b - a}
        out += chars
    return out


def lyric_rows(lines: DataFrame, backing: DataFrame, key: str = "track_id", line: str = "line") -> DataFrame:
    """``lines(key, line, text, chars)`` that have characters, with ``row`` (A and B in turn), the first start,
    the last end, and the ``backing`` text of the same source line, empty ones left out."""
    kept = lines.where(F.size("chars") > 0)
    n = F.row_number().over(W.partitionBy(key).orderBy(line))
    spans = kept.withColumn("row", F.when(n % 2 == 1, "A").otherwise("B")).withColumn("start", F.element_at("chars", 1)["start"]).withColumn("end", F.element_at("chars", -1)["end"])
    said = backing.where("backing <> ''").select(key, line, "backing")
    return spans.join(said, [key, line], "left")
