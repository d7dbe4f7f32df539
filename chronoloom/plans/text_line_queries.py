"""Queries of line spans, cursors, overrides, labels, mask boxes, filler pages, guarded moves and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions import text as X
from ..operators import align, asof, cleanup, document, metrics, packing
from ..sources import tables
from . import views as V
from .fold_queries import _allocated
from .registry import query
from .views import twin


@query(twin(""" select track_id, line, min("from") as start, max("to") as "end" from chars where label <> 'R' and "to" > "from" group by track_id, line""", "chars"))
def sung_line_spans(spark, d):
    """First start and last end of each line's sung characters."""
    c = V.chars(spark, d).where("to > from").withColumnsRenamed({"from": "start", "to": "end"})
    return document.line_spans(c, sung=F.col("label") != "R")


@query(twin(""", b as (select track_id, line, min("from") as s, max("to") as e from chars group by track_id, line) select track_id, count(*) as n_lines, max(e) as until from b where e > s group by track_id""", "chars"))
def line_starts(spark, d):
    """Lines with a length, and when a track ends."""
    c = V.chars(spark, d).withColumnsRenamed({"from": "start", "to": "end"})
    return document.line_spans(c).where(F.col("end") > F.col("start")).groupBy("track_id").agg(F.count("*").alias("n_lines"), F.max("end").alias("until"))


@query(twin(""", b as (select track_id, start, "end", start / 1000 as x0, start / 1000 + 5 as x1 from notes where event_type = 'view'),
a as (select track_id, r, max(x) as x from (select track_id, start as r, x0 as x from b union all select track_id, "end", x1 from b) group by track_id, r),
s as (select track_id, r as s0, x as d0, lead(r) over w as s1, lead(x) over w as d1, first_value(x) over w as low from a window w as (partition by track_id order by r)),
m as (select f.track_id, f.note_id, f.t, s.*, row_number() over (partition by f.note_id order by s.s0 desc) as i from frames f left join s on s.track_id = f.track_id and s.s0 <= f.t)
select note_id, round(coalesce(case when s0 is null then (select x from a where a.track_id = m.track_id order by r limit 1) when s1 is null then d0 else d0 + (t - s0) * ((d1 - d0) / (s1 - s0)) end, null), 6) as q from m where i = 1""", "notes", "frames").replace("select f.track_id, f.note_id, f.t, s.*,", "select f.track_id, f.note_id, f.t, s.s0, s.d0, s.s1, s.d1,"))
def bar_cursor(spark, d):
    """The cursor over bars at every sample."""
    bars = V.notes(spark, d).where("event_type = 'view'").select("track_id", "start", "end", (F.col("start") / 1000).alias("x0"), (F.col("start") / 1000 + 5).alias("x1"))
    return asof.bar_cursor(V.frames(spark, d).select("track_id", "note_id", "t"), bars).select("note_id", F.round("q", 6).alias("q"))


@query(twin(' select note_id, greatest(0.0, least(1.0, (start + 600 - start) / 900, ("end" - start - 600) / 900)) as alpha from notes', "notes"))
def page_alpha(spark, d):
    """Opacity ten minutes into every note, fading over a quarter of an hour."""
    return V.notes(spark, d).select("note_id", P.clamped_ramp(F.col("start") + 600, F.col("start"), F.col("end"), 900.0).alias("alpha"))


@query("""with o as (select c_name as surface, min('r' || c_custkey) as reading from customer where c_custkey % 3 = 0 group by c_name)
select c_custkey, coalesce(o.reading, c_mktsegment) as reading from customer left join o on o.surface = c_name""")
def overridden_readings(spark, d):
    c = V.table(spark, d, "customer")
    other = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("surface"), F.concat(F.lit("r"), F.col("c_custkey")).alias("reading"))
    tokens = c.select("c_custkey", F.col("c_name").alias("surface"), F.col("c_mktsegment").alias("reading"))
    return tables.apply_overrides(tokens, other).select("c_custkey", "reading")


@query("""with r as (select p_name as surface, p_brand as reading from part), g as (select surface, list_sort(list(distinct reading)) as readings from r group by surface)
select surface, len(readings) as n, readings[1] as first, len(readings) > 1 as review from g""")
def candidate_readings(spark, d):
    """The different readings of every surface; more than one needs a look."""
    p = V.table(spark, d, "part").groupBy(F.col("p_name").alias("surface")).agg(F.sort_array(F.collect_set("p_brand")).alias("readings"))
    return p.select("surface", F.size("readings").cast("long").alias("n"), F.element_at("readings", 1).alias("first"), (F.size("readings") > 1).alias("review"))


@query("""with e as (select s_suppkey, cast(s_suppkey % 23 as double) + 0.5 as e from supplier)
select s_suppkey as track_id, cast(p as integer) as page, p * 4.0::double as start, format('P{:02d}', p + 1) as label from e, range(20) r(p) where p < ceil(e / 4)
union all select s_suppkey, cast(ceil(e / 4) as integer), e + 1.0, 'END' from e""")
def filler_pages(spark, d):
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("track_id"), ((F.col("s_suppkey") % 23).cast("double") + 0.5).alias("end"))
    return packing.filler_pages(s)


@query("""select n_nationkey, '音符 ' || n_nationkey || '　音域 C' || n_regionkey || '〜G5（' || (n_nationkey + 1) || '半音）　高音 1　跳躍 ↑2 ↓3　長音 4' as label from nation""")
def song_labels(spark, d):
    n = V.table(spark, d, "nation")
    return n.select("n_nationkey", X.song_label(F.col("n_nationkey"), F.concat(F.lit("C"), F.col("n_regionkey")), F.lit("G5"), F.col("n_nationkey") + 1, F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("label"))


@query("""select n_nationkey, cast(k as integer) as box, cast(n_nationkey + k as integer) as x, cast(2 as integer) as y, cast(30 as integer) as w, cast(4 as integer) as h, case when k = 1 then 1.5::double end as "from", case when k = 1 then 2.0::double + n_nationkey end as "to"
from nation, range(2) r(k) where k = 0 or n_nationkey % 2 = 0""")
def mask_box_rows(spark, d):
    n = V.table(spark, d, "nation")
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit(",2,30.9,4"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(";"), F.col("n_nationkey") + 1, F.lit(", 2,30,4@1.5-"), F.col("n_nationkey") + 2)).otherwise(""))
    return n.select("n_nationkey", F.posexplode(X.mask_boxes(text)).alias("box", "b")).select("n_nationkey", "box", "b.*")


@query("""select n_nationkey, case when n_nationkey % 3 = 0 then '/home/x/f' || n_nationkey when n_nationkey % 3 = 1 then '~f' else '/~/f' end as path from nation""")
def font_paths(spark, d):
    k = F.col("n_nationkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("~/f"), k)).when(k % 3 == 1, "~f").otherwise("/~/f")
    return V.table(spark, d, "nation").select("n_nationkey", X.expanded_home(path, F.lit("/home/x")).alias("path"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, case when l_returnflag = 'R' and l_linestatus = 'O' then 'wa' when l_returnflag = 'A' and l_linestatus = 'O' then 'e' else lower(l_returnflag) end as sound from lineitem""")
def particle_sounds(spark, d):
    li = V.table(spark, d, "lineitem")
    kana = F.when(F.col("l_returnflag") == "R", "は").when(F.col("l_returnflag") == "A", "へ").otherwise("の")
    pos = F.when(F.col("l_linestatus") == "O", "助詞-係助詞").otherwise("名詞")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", X.particle_romaji(kana, F.lower("l_returnflag"), pos).alias("sound"))


_MOVES = """, g as (select track_id, start, "end" from windows), m as (select note_id, track_id, start, "end", p, p + case when note_id % 2 = 0 then 12 else -12 end as moved from notes where note_id % 5 < 2),
h as (select m.note_id, g.start as ws, g."end" as we, count(*) as n, max(o.p) - min(o.p) as before, max(case when o.note_id = m.note_id then m.moved else o.p end) - min(case when o.note_id = m.note_id then m.moved else o.p end) as after
  from m join (select distinct * from g) g on g.track_id = m.track_id and m.start < g."end" and m."end" > g.start
  join notes o on o.track_id = m.track_id and least(o."end", g."end") - greatest(o.start, g.start) >= 0.03 where g."end" - g.start >= 0.45 group by m.note_id, g.start, g."end"),
b as (select distinct note_id from h where n >= 2 and after > before)
select n.note_id, case when m.note_id is not null and b.note_id is null then m.moved else n.p end as p from notes n left join m using (note_id) left join b using (note_id)"""


@query(twin(_MOVES, "notes", "windows").replace("select n.note_id, case when m.note_id is not null", "select note_id, case when m.moved is not null").replace("and b.note_id is null then", "and b.bad is null then").replace("b as (select distinct note_id from h", "b as (select distinct note_id, true as bad from h"))
def guarded_octaves(spark, d):
    """Octave moves that would widen a window's range of pitches are held back."""
    n = V.notes(spark, d)
    off = n.where("note_id % 5 < 2").select("track_id", "note_id", F.when(F.col("note_id") % 2 == 0, 1200.0).otherwise(-1200.0).alias("cents"))
    return metrics.shift_octaves_by_evidence(n, off, off.where("false"), guard=V.windows(spark, d)).select("note_id", "p")


_GREEDY = """, h as (select track_id, start as t, row_number() over w - 1 as k, count(*) over (partition by track_id) as h from clicks window w as (partition by track_id order by start)),
m as (select track_id, start as s, "end" as e, row_number() over w - 1 as i, count(*) over (partition by track_id) as n from notes where event_type <> 'click' window w as (partition by track_id order by start, "end")),
z as (select h.*, coalesce(q.n, 0) as n from h left join (select distinct track_id, n from m) q using (track_id)),
r as (select track_id, cast(-1 as bigint) as k, cast(-1 as bigint) as i from z where k = 0 and n >= h
  union all select z.track_id, z.k, p.i from r join z on z.track_id = r.track_id and z.k = r.k + 1, lateral (select min_by(m.i, (abs(m.s - z.t), m.i)) as i from m where m.track_id = r.track_id and m.i > r.i and m.i <= z.n - (z.h - z.k)) p),
e as (select z.track_id, z.t, a.s as start, least(a.e, coalesce(b.s, a.e)) as "end", max(r.i) over (partition by z.track_id) as last from r join z using (track_id, k) join m a on a.track_id = r.track_id and a.i = r.i
  left join r f on f.track_id = r.track_id and f.k = r.k + 1 left join m b on b.track_id = f.track_id and b.i = f.i),
o as (select *, least(cast(floor(k / (h / cast(n as double))) as bigint), n - 1) as o from z where n < h and n > 0),
p as (select *, count(*) over (partition by track_id, o) as share, k - min(k) over (partition by track_id, o) as place from o),
y as (select p.track_id, p.t, a.s as s, greatest(coalesce(b.s, a.e) - a.s, 0.0) as len, place, share, p.n - 1 as last from p join m a on a.track_id = p.track_id and a.i = p.o left join m b on b.track_id = p.track_id and b.i = p.o + 1)
select track_id, t as hint, start, "end", cast(last as integer) as last from e union all select track_id, t, s + len * place / share, s + len * (place + 1) / share, cast(last as integer) from y
union all select track_id, t, t, t, cast(-1 as integer) from z where n = 0"""


@query(twin(_GREEDY, "notes", "clicks", recursive=True))
def alloc_greedy(spark, d):
    return _allocated(spark, d, align.allocate_greedy)


@query(twin(""", x as (select track_id, note_id, start, "end", pc from notes), w as (select track_id, start, "end" from notes where event_type = 'view' and note_id % 10 = 0)
select note_id, pc from x where not exists (select 1 from w where w.track_id = x.track_id and x.start between w.start and w."end")""", "notes"))
def dropped_onsets(spark, d):
    """Notes that start in a closed range go."""
    n = V.notes(spark, d)
    ranges = n.where("event_type = 'view' and note_id % 10 = 0").select("track_id", "start", "end")
    return cleanup.drop_onsets_in(n, ranges).select("note_id", "pc")


@query(twin(""", l as (select track_id, line, min("from") as s, max("to") as e from chars group by track_id, line), p as (select track_id, line, s, e, s + 100 as t0, s + 110 as t1 from l where line % 3 = 0)
select c.line, c.ch, case when p.line is null then c."from" else t0 + (c."from" - s) * ((t1 - t0) / (e - s)) end as start, case when p.line is null then c."to" else t0 + (c."to" - s) * ((t1 - t0) / (e - s)) end as "end"
from chars c left join p on p.line = c.line""", "chars"))
def retimed_lines(spark, d):
    """Every third line is mapped linearly onto ten seconds a while later."""
    c = V.chars(spark, d).withColumnsRenamed({"from": "start", "to": "end"})
    spans = document.line_spans(c).where("line % 3 = 0")
    to = spans.select("track_id", F.col("start").alias("low"), F.col("start").alias("high"), (F.col("start") + 100).alias("t0"), (F.col("start") + 110).alias("t1"))
    return cleanup.retime_lines(c, to).select("line", "ch", "start", "end")
