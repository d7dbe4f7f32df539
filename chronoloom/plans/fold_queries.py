"""Queries of the sequential rules, packing and alignment. Twins are recursive where SQL can say them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import align, folds, packing, segments
from . import views as V
from .registry import query
from .views import twin

_NOTE = ("start", "end", "pc")
_ORDER = ("start", "end", "note_id")
_SEQ = 'o as (select *, row_number() over (partition by track_id order by start, "end", note_id) as n, count(*) over (partition by track_id) as c from notes)'
_OUT = "start double, end double, pc int"


def _fold(spark, d, fn, schema=_OUT, inputs=_NOTE):
    return folds.by_key(V.notes(spark, d), fn, inputs, _ORDER, schema)


@query(twin(f""", {_SEQ}, r as (
  select track_id, n, case when "end" - start >= 6000 then n end as kid, start as ks, "end" as ke, pc as kp from o where n = 1
  union all select o.track_id, o.n, case when o."end" - o.start >= 6000 then o.n else r.kid end,
    case when o."end" - o.start >= 6000 then o.start else r.ks end,
    case when o."end" - o.start >= 6000 then o."end" when r.kid is not null and o.start - r.ke <= 7200 and abs(o.pc - r.kp) <= 4 then greatest(r.ke, o."end") else r.ke end,
    case when o."end" - o.start >= 6000 then o.pc else r.kp end from r join o on o.track_id = r.track_id and o.n = r.n + 1)
select track_id, min(ks) as start, max(ke) as "end", min(kp) as pc from r where kid is not null group by track_id, kid""", "notes", recursive=True))
def drop_fragments(spark, d):
    return _fold(spark, d, lambda notes: folds.drop_fragments(notes, 6000.0, 7200.0, 4))


_L = 'lag({0}) over w as a_{0}, lead({0}) over w as c_{0}'
_SANDWICH = 'o."end" - o.start <= 20000 and {a} = o.c_pc and o.pc <> {a} and abs(o.pc - {a}) <= 4 and o.start - o.a_end < 86400 and o.c_start - o."end" < 86400'
_AROUND = """, o as (select *, row_number() over w as n, lag("end") over w as a_end, lag(pc) over w as a_pc, lead(start) over w as c_start, lead(pc) over w as c_pc, lag(pc, 2) over w as a2, lead(pc, 2) over w as c2
  from notes window w as (partition by track_id order by start, "end", note_id))"""
_WIGGLE = dict(longest=20000.0, near=4, touch=86400.0, pitch="pc")


@query(twin(_AROUND + """, r as (select track_id, n, note_id, pc as now from o where n = 1
  union all select o.track_id, o.n, o.note_id, case when """ + _SANDWICH.format(a="r.now") + """ then r.now else o.pc end from r join o on o.track_id = r.track_id and o.n = r.n + 1)
select o.track_id, o.start, o."end", r.now as pc from r join o on o.track_id = r.track_id and o.n = r.n""", "notes", recursive=True))
def wiggles_cascade(spark, d):
    return segments.absorb_wiggles(V.notes(spark, d), "cascade", **_WIGGLE)


@query(twin(_AROUND + " select track_id, start, \"end\", case when " + _SANDWICH.format(a="o.a_pc") + " then a_pc else pc end as pc from o", "notes"))
def wiggles_static(spark, d):
    return segments.absorb_wiggles(V.notes(spark, d), "static", **_WIGGLE).select("track_id", "start", "end", "pc")


@query(twin(_AROUND + " select track_id, start, \"end\", case when " + _SANDWICH.format(a="o.a_pc") + " and not coalesce(a2 = pc, false) and not coalesce(c2 = pc, false) then a_pc else pc end as pc from o", "notes"))
def wiggles_noalt(spark, d):
    return segments.absorb_wiggles(V.notes(spark, d), "noalt", **_WIGGLE).select("track_id", "start", "end", "pc")


_PASS = """, c{k} as (select *, sum("end" - start) over (partition by track_id order by p{k}, "end" - start rows unbounded preceding) as run, sum("end" - start) over (partition by track_id) as total from p{k}),
a{k} as (select track_id, min(p{k}) filter (where run >= total / 2) as a from c{k} group by track_id),
p{m} as (select t.track_id, note_id, start, "end", case when a - p{k} between 10 and 17 and abs(p{k} + 12 - a) <= 4 then p{k} + 12 else p{k} end as p{m} from p{k} t join a{k} using (track_id))"""


@query(twin(', p0 as (select track_id, note_id, start, "end", p as p0 from notes)' + "".join(_PASS.format(k=k, m=k + 1) for k in range(5)) + " select note_id, p5 as p from p5", "notes"))
def octave_phrase(spark, d):
    return folds.raise_phrase_octaves(V.notes(spark, d), pitch="p").select("note_id", "p")


@query(twin(f""", {_SEQ}, x as (select *, list(p) over (partition by track_id order by n rows between 1 following and 5 following) as ahead from o),
r as (select track_id, n, note_id, [p] as done, p as now, c from x where n = 0
  union all select track_id, 0, null, []::integer[], null, min(c) from o group by track_id
  union all select x.track_id, x.n, x.note_id, (list_concat(r.done, [q.v]))[-5:], q.v, x.c from r join x on x.track_id = r.track_id and x.n = r.n + 1,
    lateral (select case when m - x.p between 10 and 17 and abs(x.p + 12 - m) <= 4 then x.p + 12 else x.p end as v
      from (select cast(trunc(list_median(list_concat(r.done, coalesce(x.ahead, []::integer[])))) as integer) as m)) q)
select note_id, now as p from r where n > 0""", "notes", recursive=True).replace("list_median(", "list_aggregate(").replace("coalesce(x.ahead, []::integer[])))) as", "coalesce(x.ahead, []::integer[])), 'median')) as"))
def octave_local(spark, d):
    return folds.by_key(V.notes(spark, d), lambda rows: [(i, p) for (*_, i), (_, _, p) in zip(rows, folds.raise_local_octaves([r[:3] for r in rows]), strict=True)], ("start", "end", "p", "note_id"), _ORDER, "note_id long, p int").select("note_id", "p")


@query(twin(f""", {_SEQ}, r as (select track_id, n, 1 as g, start as cs, "end" as ce, p as cp, pc as cm, []::integer[] as seen from o where n = 1
  union all select o.track_id, o.n, case when f.y then r.g else r.g + 1 end, case when f.y then r.cs else o.start end, o."end", o.p, o.pc, case when f.y then r.seen else list_append(r.seen, r.cm) end
  from r join o on o.track_id = r.track_id and o.n = r.n + 1,
    lateral (select not list_contains(r.seen, r.cm) and o.pc = r.cm and r.ce - r.cs <= 40000 and o."end" - o.start >= 0.5 * (r.ce - r.cs) and o.p - r.cp between 1 and 24 and o.start - r.ce <= 864000 as y) f)
select track_id, min(cs) as start, max_by(ce, n) as "end", max_by(cp, n) as p, min(cm) as mora from r group by track_id, g""", "notes", recursive=True))
def merge_scoops(spark, d):
    n = V.notes(spark, d).withColumn("mora", F.col("pc"))
    return folds.by_key(n, lambda rows: folds.merge_scoops(rows, 40000.0, 24, 864000.0, 0.5), ("start", "end", "p", "mora"), _ORDER, "start double, end double, p int, mora int")


@query(twin(f""", {_SEQ}, r as (select track_id, n, 1 as g, start as a from o where n = 1
  union all select o.track_id, o.n, case when o.start - r.a > 43200 then r.g + 1 else r.g end, case when o.start - r.a > 43200 then o.start else r.a end from r join o on o.track_id = r.track_id and o.n = r.n + 1),
k as (select o.*, r.g, row_number() over (partition by o.track_id, g order by o.p desc, o."end" - o.start desc, o.n) as i from r join o on o.track_id = r.track_id and o.n = r.n)
select track_id, start, "end", p from k where i = 1""", "notes", recursive=True))
def top_voice(spark, d):
    return folds.by_key(V.notes(spark, d), lambda rows: folds.cluster_onsets(rows, 43200.0), ("start", "end", "p"), _ORDER, "start double, end double, p int")


@query()
def settled_runs(spark, d):
    runs = segments.run_lengths(V.frames(spark, d).withColumn("v", F.coalesce(F.floor(F.col("f0") / 60).cast("int"), F.lit(-1))), "v")
    return folds.by_key(runs, lambda rows: folds.settle_runs(rows, 2, 1), ("v", "start", "end"), ("start",), "v int, start int, end int")


@query(twin(""", c as (select n.note_id, k.start as t, row_number() over (partition by n.note_id order by k.start, k.note_id) as i from notes n join clicks k on k.track_id = n.track_id and k.start >= n.start + 600 and k.start <= n."end" - 600),
r as (select note_id, 0::bigint as i, 0 as cut, start as last, start as begin, cast(null as double) as stop from notes
  union all select c.note_id, c.i, case when c.t - r.last >= 600 then 1 else 0 end, case when c.t - r.last >= 600 then c.t else r.last end, r.last, c.t from r join c on c.note_id = r.note_id and c.i = r.i + 1),
p as (select note_id, begin as start, stop as "end" from r where cut = 1 union all select note_id, arg_max(last, i), cast(null as double) from r group by note_id)
select p.note_id, p.start, coalesce(p."end", n."end") as "end", n.pc from p join notes n using (note_id)""", "notes", "clicks", recursive=True))
def split_at_onsets(spark, d):
    return folds.split_at_onsets(V.notes(spark, d), V.clicks(spark, d), 600.0).select("note_id", "start", "end", "pc")


@query(twin(""", g as (select *, row_number() over (partition by track_id order by frame) - row_number() over (partition by track_id, price > 30000 order by frame) as g from daily),
spans as (select track_id, cast(min(frame) as double) as start, max(frame) + 1.0::double as "end" from g where price > 30000 group by track_id, g having max(frame) + 1 - min(frame) >= 3),
r as (select track_id, start as begin, start as s, "end" as e, false as done from spans
  union all select r.track_id, r.begin, case when r.e - r.s > 28 then q.cut else r.e end, r.e, r.e - r.s <= 28 from r,
    lateral (select coalesce(case when c > r.s then c end, r.s + 28) as cut from (select min_by(d.frame, (d.price, d.frame)) as c from daily d where d.track_id = r.track_id and d.frame >= r.s + 0.4 * 28 and d.frame <= r.s + 28)) q where not r.done)
select track_id, s as start, "end" from (select track_id, s, lead(s) over (partition by track_id, begin order by s) as "end" from r) where "end" is not null""", "daily", recursive=True))
def cut_long(spark, d):
    frames = V.daily(spark, d).withColumn("t", F.col("frame").cast("double"))
    runs = segments.active_runs(frames, F.col("price") > 30000, 1.0, 3.0)

    def cut(span_rows, level_rows):
        return folds.cut_long(span_rows, [t for t, _ in level_rows], [v for _, v in level_rows], 28.0)

    return folds.together([(runs, ("start", "end")), (frames, ("t", "price"))], cut, "start double, end double")


@query(twin(""", r as (select track_id, seq, 0 as page, 10 + width as used from items where seq = 1
  union all select i.track_id, i.seq, case when r.used + 2 + i.width > 196 then r.page + 1 else r.page end, case when r.used + 2 + i.width > 196 then 10 + i.width else r.used + 2 + i.width end
  from r join items i on i.track_id = r.track_id and i.seq = r.seq + 1) select track_id, cast(seq as integer) as seq, page from r""", "items", recursive=True))
def pack_pages(spark, d):
    return folds.by_key(V.items(spark, d), lambda rows: list(zip([r[0] for r in rows], packing.next_fit([r[1] for r in rows], 200.0, 10.0, 2.0, 4.0), strict=True)), ("seq", "width"), ("seq",), "seq int, page int")


@query()
def balanced_pages(spark, d):
    return folds.by_key(V.items(spark, d), lambda rows: list(zip([r[0] for r in rows], packing.balanced_split([r[1] for r in rows], 200.0), strict=True)), ("seq", "width"), ("seq",), "seq int, page int")


@query()
def split_oversized(spark, d):
    def split(rows):
        s, e, line, no = ([r[i] for r in rows] for i in range(4))
        parts = packing.split_oversized(range(len(rows)), lambda g: sum(e[i] - s[i] for i in g), 100_000.0, s, e, line)
        return [(no[i], k) for k, g in enumerate(parts) for i in g]

    n = V.notes(spark, d).withColumn("line", F.floor(F.col("start") / 604800).cast("int"))
    return folds.by_key(n, split, ("start", "end", "line", "note_id"), _ORDER, "note_id long, part int")


@query()
def page_layout(spark, d):
    def lay(rows):
        notes, slots = [r[:3] for r in rows], [max(r[1] - r[0], 60.0) for r in rows]
        pages = packing.next_fit(slots, 400_000.0, 1000.0)
        grouped = [[[i for i in range(len(rows)) if pages[i] == p]] for p in range(pages[-1] + 1)]
        bars, _ = packing.layout(grouped, notes, slots, 400_000.0, 1000.0, 30.0, 600.0, 3600.0)
        return [(r[3], *b) for r, b in zip(rows, bars, strict=True)]

    return folds.by_key(V.notes(spark, d), lay, (*_NOTE, "note_id"), _ORDER, "note_id long, x0 double, x1 double, pc int")


@query(twin(""", n as (select *, (row_number() over (partition by track_id order by start, "end", line) - 1) // 4 as page from lines),
b as (select track_id, cast(page as integer) as page, min(start) as raw, max("end") as "end", min(line) as first_line, count(*) as n_lines from n group by track_id, page)
select track_id, page, greatest(raw, coalesce(max("end") over (partition by track_id order by page rows between unbounded preceding and 1 preceding), raw)) as start, "end", first_line, n_lines from b""", "lines"))
def line_pages(spark, d):
    return packing.line_pages(V.lines(spark, d), 4)


@query(twin(""", s as (select track_id, min(start) as f, max("end") as t from notes group by track_id), p as (select track_id, f, t, unnest(range(greatest(cast(ceil((t - f) / 86400) as bigint), 1))) as page from s),
h as (select n.track_id, least(cast(floor((n.start - f) / 86400) as bigint), greatest(cast(ceil((t - f) / 86400) as bigint), 1) - 1) as page, count(*) as n from notes n join s using (track_id) group by 1, 2)
select p.track_id, p.page, f + p.page * 86400.0::double as start, f + (p.page + 1) * 86400.0::double as "end", coalesce(h.n, 0) as n_notes from p left join h on h.track_id = p.track_id and h.page = p.page""", "notes"))
def beat_pages(spark, d):
    return packing.beat_pages(V.notes(spark, d), 86400.0)


@query(twin(""" select track_id, seq, (seq - 1) % 2 as row, coalesce(sum(width + 1.5) over (partition by track_id order by seq rows between unbounded preceding and 1 preceding), 0) as x from items""", "items"))
def bar_rows(spark, d):
    return packing.slot_positions(packing.row_of(V.items(spark, d), ["seq"]), ["seq"], 1.5).select("track_id", "seq", "row", "x")


def _turn_pairs(spark, d):
    c = V.table(spark, d, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).where("before is not null").select(F.col("conv_id").alias("track_id"), "turn", "before", "text")


# DuckDB counts bytes: the table's letters beyond ASCII, fewer than 27, stand in as control characters, a byte each
_BYTES = "chr(" + ") || chr(".join(str(i) for i in range(1, 32) if i not in (9, 10, 13, 27)) + ")"


@query(f"""with a as (select coalesce(string_agg(ch, '' order by ch), '') as f from (select distinct unnest(string_split(text, '')) as ch from conversations) where ch > '~'),
x as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, cast(levenshtein(translate(before, f, {_BYTES}), translate(text, f, {_BYTES})) as bigint) as distance from x, a where before is not null""")
def edit_distance(spark, d):
    """Edits between the characters of neighbouring turns."""
    return _turn_pairs(spark, d).select(F.col("track_id").alias("conv_id"), "turn", F.levenshtein("before", "text").cast("long").alias("distance"))


@query()
def edit_alignment(spark, d):
    """Aligned words of neighbouring turns: matches, substitutions and one-sided words."""

    def count(rows):
        out = []
        for t, a, b in rows:
            x, y = (a or "").split(), (b or "").split()
            pairs = align.edit_alignment(x, y)
            same = sum(i is not None and j is not None and x[i] == y[j] for i, j in pairs)
            both = sum(i is not None and j is not None for i, j in pairs)
            out.append((t, same, both - same, len(pairs) - both))
        return out

    return folds.by_key(_turn_pairs(spark, d), count, ("turn", "before", "text"), ("turn",), "turn long, matches int, substitutions int, one_sided int")


def _allocated(spark, d, fn):
    """Every track's hints; a track without notes keeps them."""
    hints = V.clicks(spark, d).select("track_id", F.col("start").alias("t"))
    notes = V.notes(spark, d).where("event_type <> 'click'").select("track_id", "start", "end")

    def run(note_rows, hint_rows):
        h = [t for (t,) in hint_rows]
        spans, last = fn(note_rows, h)
        return [(t, s, e, last) for t, (s, e) in zip(h, spans, strict=True)]

    return folds.together([(notes, ("start", "end")), (hints, ("t",))], run, "hint double, start double, end double, last int")


@query()
def alloc_dp(spark, d):
    return _allocated(spark, d, align.allocate_best)


@query()
def partition_dp(spark, d):
    def run(rows):
        return [(r[3], k) for r, k in zip(rows, align.partition_notes([r[:3] for r in rows], 4), strict=True)]

    return folds.by_key(V.notes(spark, d), run, (*_NOTE, "note_id"), _ORDER, "note_id long, part int")


@query()
def dtw_frames(spark, d):
    """Each embedding's first half warped onto its second: the mapped frame of every frame."""

    def run(rows):
        y = np.array([r[1] for r in rows])
        half = len(y) // 2
        if not half:
            return []
        a, b = (np.stack([part, np.ones(len(part))], axis=1) for part in (y[:half], y[half:]))
        return list(enumerate(align.frame_map(align.warp_path(a, b), half).tolist()))

    return folds.by_key(V.wave(spark, d), run, ("frame", "y"), ("frame",), "frame int, mapped double")
