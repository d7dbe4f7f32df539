"""Queries of the interval algebra and of the interval, as-of and nearest joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch as P
from ..operators import asof, intervals, metrics
from . import views as V
from .registry import query
from .views import twin

_TOL = 6


@query(twin(" select track_id, frame, round(case when f0 > 0 then 69 + 12 * log2(f0 / 440) end, 6) as midi from frames", "frames"))
def hz_to_midi(spark, d):
    return V.frames(spark, d).select("track_id", "frame", F.round(P.hz_to_midi(F.col("f0")), _TOL).alias("midi"))


_CENTS = "select note_id, (p - 60) * 100.0::double + (start - floor(start / 37) * 37) as c from notes"


def _cents(spark, d):
    return V.notes(spark, d).select("note_id", ((F.col("p") - 60) * 100.0 + (F.col("start") - F.floor(F.col("start") / 37) * 37)).alias("c"))


@query(twin(f", x as ({_CENTS}) select note_id, round((c + 600) - 1200 * floor((c + 600) / 1200) - 600, 6) as folded from x", "notes"))
def fold_cents(spark, d):
    return _cents(spark, d).select("note_id", F.round(P.folded_cents(F.col("c")), _TOL).alias("folded"))


@query(twin(f", x as ({_CENTS}) select note_id, abs(abs(c) - 1200) <= 120 as octave from x", "notes"))
def octave_like(spark, d):
    return _cents(spark, d).select("note_id", P.octave_like(F.col("c")).alias("octave"))


@query(twin(""", g as (select * from (values (0, 0.25::double), (1, 0.5), (2, 1.0), (3, 2.0), (4, 4.0)) t(i, m)),
r as (select note_id, start, m, row_number() over (partition by note_id order by abs(ln(greatest("end" - start, 0.001) / (3600.0::double * m))), i) as n from notes, g)
select note_id, round(3600.0::double * m, 6) as snapped from r where n = 1""", "notes"))
def quantize_log(spark, d):
    return V.notes(spark, d).select("note_id", F.round(P.quantised_duration(F.col("start"), F.col("end"), 3600.0), _TOL).alias("snapped"))


@query(twin(""", g as (select * from (values (0, 0.5::double), (1, 1.0), (2, 2.0)) t(i, m)),
r as (select note_id, track_id, start, "end", m, row_number() over (partition by note_id order by abs("end" - start - 7200.0::double * m), i) as n from notes, g where "end" > start),
s as (select *, lead(start) over (partition by track_id order by start, "end", note_id) as following from r where n = 1)
select note_id, start, greatest(least(start + 7200.0::double * m, coalesce(following, start + 7200.0::double * m)), start + 0.001) as "end" from s""", "notes"))
def quantize_linear(spark, d):
    from ..operators.segments import quantise_to_beats

    return quantise_to_beats(V.notes(spark, d), 7200.0).select("note_id", "start", "end")


@query(twin(""" select note_id, start + least(600.0::double, 0.25 * ("end" - start)) as start, "end" - least(600.0::double, 0.25 * ("end" - start)) as "end" from notes where "end" - start >= 1800""", "notes"))
def stable_windows(spark, d):
    w = P.stable_window(F.col("start"), F.col("end"), 600.0, 1800.0)
    return V.notes(spark, d).withColumn("w", w).where("w is not null").select("note_id", "w.start", "w.end")


@query(twin(""", x as (select note_id, start, "end", least(600.0::double, 0.25 * ("end" - start)) as e from notes where "end" > start)
select note_id, start, "end" from x where "end" - start < 1800
union all select note_id, start, start + e from x where "end" - start >= 1800
union all select note_id, "end" - e, "end" from x where "end" - start >= 1800""", "notes"))
def transition_windows(spark, d):
    w = P.transition_windows(F.col("start"), F.col("end"), 600.0, 1800.0)
    return V.notes(spark, d).select("note_id", F.explode(w).alias("w")).select("note_id", "w.start", "w.end")


@query(twin(""", x as (select n.note_id, n.p, f.f0 from notes n join frames f using (note_id)), y as (select note_id, p, case when f0 > 0 then 69 + 12 * log2(f0 / 440) end as m from x)
select note_id, cast(case when m is null then p when abs(abs(m - p) - 12) <= 1 then case when m > p then p + 12 else p - 12 end when abs(m - p) >= 5 then round_even(m, 0) else p end as integer) as pitch from y""", "notes", "frames"))
def choose_pitch(spark, d):
    f = V.frames(spark, d).select("note_id", P.hz_to_midi(F.col("f0")).alias("m"))
    return V.notes(spark, d).join(f, "note_id").select("note_id", P.consensus_pitch(F.col("p"), F.col("m")).alias("pitch"))


_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query(twin(f" select note_id, ({_NAMES})[(p % 12) + 1] || cast(p // 12 - 1 as varchar) as name, cast(round_even(start * 960, 0) as bigint) as tick from notes", "notes"))
def names_and_ticks(spark, d):
    return V.notes(spark, d).select("note_id", P.pitch_name(F.col("p")).alias("name"), P.ticks_of(F.col("start")).alias("tick"))


@query(twin(" select line, i as part, cast(n // 3 + case when i < n % 3 then 1 else 0 end as bigint) as share from lines, range(3) r(i)", "lines"))
def even_split(spark, d):
    return V.lines(spark, d).select("line", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("part")).select("line", "part", P.even_share(F.col("n"), F.lit(3), F.col("part")).alias("share"))


@query(twin(' select track_id, start, "end" from merged', "merged"))
def merge_windows(spark, d):
    return intervals.merge_windows(V.windows(spark, d))


_ISLANDS = """, u as ({0}), m as (select *, coalesce(cast(start > max("end") over (partition by track_id order by start, "end" rows between unbounded preceding and 1 preceding) as integer), 1) as new from u),
g as (select *, sum(new) over (partition by track_id order by start, "end" rows unbounded preceding) as isl from m), z as (select track_id, min(start) as start, max("end") as "end" from g group by track_id, isl)"""


@query(twin(_ISLANDS.format('select track_id, start, "end" from windows union all select track_id, start, "end" from clicks') + ' select track_id, start, "end" from z', "windows", "clicks"))
def union_windows(spark, d):
    return intervals.union_windows(V.windows(spark, d), V.clicks(spark, d))


@query(twin(_ISLANDS.format('select track_id, start, "end" from clicks') + ' select a.track_id, greatest(a.start, b.start) as start, least(a."end", b."end") as "end" from merged a join z b on a.track_id = b.track_id and a.start < b."end" and a."end" > b.start', "merged", "clicks"))
def intersect_windows(spark, d):
    return intervals.intersect_windows(intervals.merge_windows(V.windows(spark, d)), intervals.merge_windows(V.clicks(spark, d)))


@query(twin(""", gaps as (select track_id, lag("end", 1, -1e18) over (partition by track_id order by start) as s, start as e from merged
  union all select track_id, max("end"), 1e18 from merged group by track_id),
f as (select n.track_id, n.note_id, n.p, greatest(n.start, coalesce(g.s, -1e18)) as s, least(n."end", coalesce(g.e, 1e18)) as e
  from notes n left join gaps g on n.track_id = g.track_id where n.event_type <> 'view' and (g.track_id is null or (n.start < g.e and n."end" > g.s)))
select track_id, note_id, s + 300 as start, e - 300 as "end" from f where e - s >= 1800""", "merged"))
def interval_difference(spark, d):
    other = V.notes(spark, d).where("event_type <> 'view'").select("track_id", "start", "end", "note_id")
    return intervals.fill_from(V.windows(spark, d), other, least=1200.0, guard=300.0).select("track_id", "note_id", "start", "end")


@query(twin(' select track_id, frame, t from frames f where exists (select 1 from windows w where w.track_id = f.track_id and f.t >= w.start and f.t < w."end")', "frames", "windows"))
def mask_semi(spark, d):
    return intervals.points_masked(V.frames(spark, d), V.windows(spark, d)).select("track_id", "frame", "t")


@query(twin(' select n.track_id, n.note_id from notes n where not exists (select 1 from windows w where w.track_id = n.track_id and n.start < w."end" and n."end" > w.start)', "windows"))
def outside_anti(spark, d):
    return intervals.overlap_join(V.notes(spark, d), V.windows(spark, d), how="left_anti").select("track_id", "note_id")


@query(twin(' select n.track_id, n.note_id from notes n semi join windows w on w.track_id = n.track_id and n.start < w."end" and n."end" > w.start', "windows"))
def overlap_semi(spark, d):
    return intervals.overlap_join(V.notes(spark, d), V.windows(spark, d), how="left_semi").select("track_id", "note_id")


@query(twin(_ISLANDS.format('select track_id, greatest(0, start - 900) as start, least("end" + 900, 1000000) as "end" from clicks where least("end" + 900, 1000000) > greatest(0, start - 900)') + ' select track_id, start, "end" from z', "clicks"))
def pad_clamp(spark, d):
    return intervals.pad_clamp(V.clicks(spark, d), 900.0, 0.0, 1000000.0)


@query(twin(""" select n.note_id, round(case when n."end" > n.start then coalesce(sum(least(n."end", w."end") - greatest(n.start, w.start)) filter (where w.start is not null), 0) / (n."end" - n.start) else 0 end, 6) as covered
from notes n left join windows w on n.track_id = w.track_id and n.start < w."end" and n."end" > w.start group by n.note_id, n.start, n."end" """, "windows"))
def coverage(spark, d):
    return intervals.covered_fraction(V.notes(spark, d), V.windows(spark, d)).select("note_id", F.round("covered", _TOL).alias("covered"))


@query(twin(_ISLANDS.format("""select track_id, greatest(0, start - 1800) as start, e + 1800 as "end" from (select track_id, start, case when following is null then "end" + 600 else greatest("end", least("end" + 600, following - 60)) end as e
  from (select *, lead(start) over (partition by track_id order by start, "end") as following from clicks where "end" > start))""") + ' select track_id, start, "end" from z', "clicks"))
def lyric_windows(spark, d):
    return intervals.lyric_windows(V.clicks(spark, d), margin=1800.0, tail=600.0, guard=60.0)


@query(twin(""", c as (select w.track_id, w.note_id, w.start as ws, w."end" as we, greatest(w.start, n.start) as s, least(w."end", n."end") as e from windows w join clicks n on w.track_id = n.track_id and n.start < w."end" and n."end" > w.start
  union all select track_id, note_id, start, "end", "end", "end" from windows),
g as (select *, greatest(ws, coalesce(max(e) over (partition by note_id order by s, e rows between unbounded preceding and 1 preceding), ws)) as f from c),
r as (select *, row_number() over (partition by note_id order by s - f desc, f) as n from g) select track_id, note_id as window_id, f as start, s as "end" from r where n = 1""", "windows", "clicks"))
def largest_gap(spark, d):
    return intervals.largest_gap(V.windows(spark, d).withColumnRenamed("note_id", "window_id"), V.clicks(spark, d))


@query(twin(""", o as (select n.note_id, c.note_id as m, row_number() over (partition by n.note_id order by least(n."end", c."end") - greatest(n.start, c.start) desc, c.start, c.note_id) as r
  from notes n join clicks c on c.track_id = n.track_id and c.start < n."end" and c."end" > n.start),
f as (select n.note_id, c.note_id as m, row_number() over (partition by n.note_id order by greatest(c.start - n."end", n.start - c."end", 0), c.start, c.note_id) as r
  from notes n join clicks c on c.track_id = n.track_id and greatest(c.start - n."end", n.start - c."end", 0) < 7200 where n.note_id not in (select note_id from o))
select n.note_id, coalesce(o.m, f.m) as match from notes n left join o on n.note_id = o.note_id and o.r = 1 left join f on n.note_id = f.note_id and f.r = 1""", "notes", "clicks"))
def overlap_argmax(spark, d):
    notes = V.notes(spark, d).select("track_id", "note_id", "start", "end")
    return intervals.argmax_overlap(notes, V.clicks(spark, d), "note_id", near=7200.0).select("note_id", "match")


@query(twin(""" select w.note_id, count(*) as n_notes, max(n.pc) - min(n.pc) as spread from windows w join notes n on w.track_id = n.track_id and n.start < w."end" and n."end" > w.start
where w."end" - w.start >= 9000 and least(n."end", w."end") - greatest(n.start, w.start) >= 600 group by w.note_id having count(*) >= 2 and max(n.pc) - min(n.pc) >= 2""", "windows"))
def overlap_threshold(spark, d):
    return metrics.split_spans(V.windows(spark, d), V.notes(spark, d), least=600.0, long=9000.0).select("note_id", "n_notes", "spread")


_EVENTS = """e as (select track_id, start, "end", p as event_pitch, ((note_id * 37) % 128) / 127.0::double as conf, note_id as event_no from notes where event_type <> 'view')"""


@query(twin(f""", {_EVENTS},
j as (select n.note_id, e.event_pitch, e.start as es, e.event_no, e.conf * least(1, (least(n."end", e."end") - greatest(n.start, e.start)) / (n."end" - n.start)) as s, abs(e.event_pitch - n.p) as dist
  from notes n join e on n.track_id = e.track_id and e.start < n."end" and e."end" > n.start
  where n.event_type = 'view' and least(n."end", e."end") - greatest(n.start, e.start) >= 0.3 * least(n."end" - n.start, e."end" - e.start)),
b as (select *, row_number() over (partition by note_id order by s desc, es, event_no) as r from j where dist between 1 and 12),
u as (select note_id, max(s) as s from j where dist = 0 group by note_id)
select n.note_id, case when b.s >= 0.02 and b.s > coalesce(u.s, 0) * 1.2 then b.event_pitch else n.p end as p
from notes n left join b on n.note_id = b.note_id and b.r = 1 left join u on n.note_id = u.note_id where n.event_type = 'view'""", "notes"))
def second_opinion_relabel(spark, d):
    n = V.notes(spark, d)
    conf = ((F.col("note_id") * 37) % 128) / F.lit(127.0)
    events = n.where("event_type <> 'view'").select("track_id", "start", "end", F.col("p").alias("event_pitch"), conf.alias("conf"), F.col("note_id").alias("event_no"))
    return metrics.relabel_by_second_opinion(n.where("event_type = 'view'"), events, far=12).select("note_id", "p")


@query(twin(" select f.track_id, f.frame, w.note_id as mark from frames f asof left join (select * from windows) w on f.track_id = w.track_id and f.t >= w.start", "frames", "windows"))
def asof_backward(spark, d):
    out = asof.asof_backward(V.frames(spark, d), V.windows(spark, d).select("track_id", "note_id", F.col("start").alias("at")), mark_t="at", tie="note_id")
    return out.select("track_id", "frame", F.col("mark.note_id").alias("mark"))


@query(twin(", s as (select *, t + 1800 as t2 from frames) select s.track_id, s.frame, c.note_id as mark from s asof left join clicks c on s.track_id = c.track_id and s.t2 >= c.start", "frames", "clicks"))
def asof_tolerance(spark, d):
    out = asof.asof_backward(V.frames(spark, d), V.clicks(spark, d).select("track_id", "note_id", "start"), mark_t="start", tolerance=1800.0, tie="note_id")
    return out.select("track_id", "frame", F.col("mark.note_id").alias("mark"))


@query(twin(""" select f.track_id, f.frame, coalesce(min(c.note_id) filter (where c.start = a.s), l.note_id) as mark from frames f
left join lateral (select min(start) as s from clicks c where c.track_id = f.track_id and c.start >= f.t) a on true
left join clicks c on c.track_id = f.track_id and c.start = a.s
left join (select track_id, max_by(note_id, start) as note_id from clicks group by track_id) l on l.track_id = f.track_id group by f.track_id, f.frame, l.note_id""", "frames", "clicks"))
def asof_forward(spark, d):
    out = asof.asof_forward(V.frames(spark, d), V.clicks(spark, d).select("track_id", "note_id", "start"), mark_t="start")
    return out.select("track_id", "frame", F.col("mark.note_id").alias("mark"))


@query(twin(""", x as (select n.note_id, c.start as cs, abs(c.start - n.start) as dist, row_number() over (partition by n.note_id order by abs(c.start - n.start), c.start) as r
  from notes n join clicks c on n.track_id = c.track_id and abs(c.start - n.start) > 900 where n.event_type = 'view')
select n.note_id, x.cs as onset from notes n left join x on x.note_id = n.note_id and x.r = 1 and x.dist <= 43200 where n.event_type = 'view'""", "notes", "clicks"))
def nearest_within(spark, d):
    n = V.notes(spark, d).where("event_type = 'view'").select("track_id", "note_id", "start")
    marks = V.clicks(spark, d).select("track_id", F.col("start").alias("onset"))
    out = asof.nearest(n, marks, t="start", mark_t="onset", beyond=900.0, within=43200.0)
    return out.select("note_id", F.col("mark.onset").alias("onset"))


@query(twin(""", x as (select f.track_id, f.frame, w.note_id, row_number() over (partition by f.track_id, f.frame order by w.start desc, w.note_id desc) as r
  from frames f left join windows w on w.track_id = f.track_id and f.t >= w.start and f.t < w."end") select track_id, frame, note_id from x where r = 1""", "frames", "windows"))
def latest_covering(spark, d):
    return intervals.latest_covering(V.frames(spark, d).select("track_id", "frame", "t"), V.windows(spark, d), "note_id").select("track_id", "frame", "note_id")


@query(twin(""", a as (select *, lead(real) over (partition by track_id order by real) as r1, lead(display) over (partition by track_id order by real) as d1, min(real) over (partition by track_id) as r0 from anchors)
select f.track_id, f.frame, round(case when a.real is null then l.display when a.r1 is null then a.display else a.display + (f.t - a.real) * ((a.d1 - a.display) / (a.r1 - a.real)) end, 4) as shown
from frames f asof left join a on f.track_id = a.track_id and f.t >= a.real left join (select track_id, min_by(display, real) as display from anchors group by track_id) l on l.track_id = f.track_id""", "frames", "anchors"))
def warp_forward(spark, d):
    out = asof.warp(V.frames(spark, d), V.warp_anchors(spark, d), "t", "real", "display", "shown")
    return out.select("track_id", "frame", F.round("shown", 4).alias("shown"))


@query(twin(""", a as (select *, lead(real) over (partition by track_id order by display) as r1, lead(display) over (partition by track_id order by display) as d1 from anchors),
p as (select track_id, frame, cast(frame * 700 as double) as x from frames)
select p.track_id, p.frame, round(case when a.display is null then l.real when a.d1 is null then a.real else a.real + (p.x - a.display) * ((a.r1 - a.real) / (a.d1 - a.display)) end, 3) as at
from p asof left join a on p.track_id = a.track_id and p.x >= a.display left join (select track_id, min_by(real, display) as real from anchors group by track_id) l on l.track_id = p.track_id""", "frames", "anchors"))
def warp_inverse(spark, d):
    p = V.frames(spark, d).select("track_id", "frame", (F.col("frame") * 700).cast("double").alias("x"))
    return asof.warp(p, V.warp_anchors(spark, d), "x", "display", "real", "at").select("track_id", "frame", F.round("at", 3).alias("at"))
