"""Queries of the mora-wise cleaning rules, with made-up evidence in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleanup, refine
from . import views as V
from .registry import query
from .views import twin

#: The rules run over seconds, the views over months: a second of a rule is a day of the data.
DAY = 86400.0
_SUNG = """, sung as (select track_id, note_id, start / 86400 as start, "end" / 86400 as "end", {pitch} as pitch, case when note_id % 11 = 0 then -1 else cast(floor(start / 259200) as integer) end as mora,
  floor(start / 259200) * 3.0::double as slot_start, floor(start / 259200) * 3.0::double + 2.0 as slot_end, -cast(note_id % 41 as double) as level, (note_id % 10) / 9.0::double as first,
  (note_id % 5) / 8.0::double as second, (note_id % 3) / 2.0::double as second_below, (note_id % 7) / 6.0::double as support from notes)"""


def _sung(spark, d, pitch):
    n = V.notes(spark, d)
    mora = F.floor(F.col("start") / 259200)
    share = lambda m, by: (F.col("note_id") % m) / F.lit(by)
    return n.select(
        "track_id", "note_id", (F.col("start") / DAY).alias("start"), (F.col("end") / DAY).alias("end"), pitch.cast("int").alias("pitch"),
        F.when(F.col("note_id") % 11 == 0, -1).otherwise(mora).cast("int").alias("mora"), (mora * 3.0).alias("slot_start"), (mora * 3.0 + 2.0).alias("slot_end"),
        (-(F.col("note_id") % 41).cast("double")).alias("level"), share(10, 9.0).alias("first"), share(5, 8.0).alias("second"), share(3, 2.0).alias("second_below"), share(7, 6.0).alias("support"),
    )


_ORDER = 'order by start, "end", pitch'
_MAIN = "first_value(struct_pack(start := start, \"end\" := \"end\", pitch := pitch, level := level, nth := nth)) over (partition by track_id, mora order by {best}, start, \"end\", pitch)"
_PLACED = f", placed as (select *, row_number() over (partition by track_id, mora {_ORDER}) as nth from {{source}}), led as (select *, {_MAIN} as main from placed)"


@query(twin(_SUNG.format(pitch="p") + f""", ranked as (select *, row_number() over (partition by track_id order by pitch, start, "end") - 1 as rank, count(*) over (partition by track_id) as n from sung),
seen as (select *, max(pitch) filter (where rank = floor(0.95::double * (n - 1))) over (partition by track_id) + 3 as ceiling, lag("end") over w as ae, lag(pitch) over w as ap, lead(start) over w as bs, lead(pitch) over w as bp from ranked window w as (partition by track_id {_ORDER}))
select note_id, case when (pitch > ceiling or coalesce(start - ae <= 0.30 and bs - "end" <= 0.30 and greatest(abs(ap - pitch + 12), abs(bp - pitch + 12)) <= 3 and least(abs(ap - pitch), abs(bp - pitch)) >= 8, false))
  and second < 0.2 and second_below >= 0.5 and first >= 0.3 then pitch - 12 else pitch end as pitch from seen""", "notes"))
def lowered_octaves(spark, d):
    return cleanup.lower_octaves(_sung(spark, d, F.col("p"))).select("note_id", "pitch")


_ONE = """, o as (select *, case when mora <> -1 then greatest(0, least("end", slot_end) - greatest(start, slot_start)) end as overlap from sung)""" + _PLACED.format(source="o", best="{best}") + """,
v as (select *, mora <> -1 and nth <> main.nth and abs(pitch - main.pitch) <= 3 as variant, nth < main.nth as ahead from led),
s as (select *, variant and pitch <> main.pitch and not ahead and overlap / greatest("end" - start, 1e-6) < 0.50 as spilt from v),
n as (select *, variant and not spilt as near from s),
p as (select *, near and ahead and coalesce(main.start - max(case when near and ahead then "end" end) over w <= 0.12, false) as opens from n window w as (partition by track_id, mora order by nth rows unbounded preceding)),
q as (select *, greatest(main."end", coalesce(max(case when opens or (near and not ahead) then "end" end) over (partition by track_id, mora order by nth rows between unbounded preceding and 1 preceding), main."end")) as reach from p),
t as (select *, opens or (near and not ahead and sum(case when near and not ahead and start - reach > 0.12 then 1 else 0 end) over (partition by track_id, mora order by nth rows unbounded preceding) = 0) as taken from q),
u as (select *, min(case when taken then start end) over m as low, max(case when taken then "end" end) over m as high from t window m as (partition by track_id, mora))
select note_id, case when mora <> -1 and nth = main.nth then least(start, coalesce(low, start)) else start end as start, case when mora <> -1 and nth = main.nth then greatest("end", coalesce(high, "end")) else "end" end as "end", pitch from u where not taken and not spilt"""


@query(twin(_SUNG.format(pitch="60 + k9") .replace("from notes)", "from (select *, pc % 9 as k9 from notes))") + _ONE.replace("{best}", '("end" - start) * greatest(support, 0.05::double) desc, overlap desc'), "notes"))
def one_pitch_by_support(spark, d):
    return cleanup.one_pitch_each(_sung(spark, d, 60 + F.col("pc") % 9)).select("note_id", "start", "end", "pitch")


@query(twin(_SUNG.format(pitch="60 + k9").replace("from notes)", "from (select *, pc % 9 as k9 from notes))") + _ONE.replace("{best}", 'overlap desc, "end" - start desc'), "notes"))
def one_pitch_by_overlap(spark, d):
    return cleanup.one_pitch_each(_sung(spark, d, 60 + F.col("pc") % 9), supported=False).select("note_id", "start", "end", "pitch")


@query(twin(_SUNG.format(pitch="pc") + _PLACED.format(source="sung", best='support desc, "end" - start desc') + """, x as (select *, max(pitch) over m - min(pitch) over m as span from led window m as (partition by track_id, mora))
select note_id, pitch from x where mora = -1 or span <= 3 or nth = main.nth or (support >= 0.30 and level >= main.level - 25.0)""", "notes"))
def real_melismas(spark, d):
    return cleanup.real_melismas(_sung(spark, d, F.col("pc"))).select("note_id", "pitch")


@query(twin(_SUNG.format(pitch="pc") + _PLACED.format(source="sung", best='"end" - start desc') + f""", x as (select *, lag("end") over (partition by track_id {_ORDER}) as before from led)
select note_id, pitch from x where mora <> -1 and not (coalesce(nth <> main.nth and "end" - start <= 0.35 and start >= main."end" and start - before > 0.10, false) and not (support >= 0.30 and level >= main.level - 25.0))""", "notes"))
def dropped_phantoms(spark, d):
    return cleanup.drop_phantoms(_sung(spark, d, F.col("pc"))).select("note_id", "pitch")


@query(twin(_SUNG.format(pitch="pc") + """, v as (select track_id, start / 86400 as start, "end" / 86400 as "end" from clicks),
f as (select s.*, exists (select 1 from v where v.track_id = s.track_id and s.start < v."end" and s."end" > v.start) as voiced from sung s)
select note_id from f where voiced or exists (select 1 from f g where g.track_id = f.track_id and g.voiced and ((g."end" <= f.start and f.start - g."end" <= 1.0) or (g.start >= f."end" and g.start - f."end" <= 1.0)))""", "notes", "clicks"))
def drop_isolated(spark, d):
    voiced = V.clicks(spark, d).select("track_id", (F.col("start") / DAY).alias("start"), (F.col("end") / DAY).alias("end"))
    return refine.drop_isolated(_sung(spark, d, F.col("pc")), voiced).select("note_id")


@query(twin(_SUNG.format(pitch="pc") + """, f as (select track_id, t / 86400 as t, 36 + f0 / 10 as midi from frames), l as (select track_id, min(start) as start, max("end") as "end" from sung group by track_id),
b as (select *, lead(start) over w as bs, lead("end") over w as be, lead(pitch) over w as target from sung window w as (partition by track_id order by start, "end", note_id)),
c as (select b.* from b join l using (track_id) where bs - b."end" <= 0.10 and b."end" - b.start < 1.0 and be - bs >= 1.3 * (b."end" - b.start) and target - pitch between 1 and 3 and l.start - 0.05 <= b.start and be <= l."end" + 0.05),
h as (select c.note_id, c.target, f.midi, row_number() over w as i, count(*) over (partition by c.note_id) as n from c join f on f.track_id = c.track_id and f.midi is not null and f.t >= c.start and f.t < c."end" window w as (partition by c.note_id order by f.t)),
e as (select note_id, target, median(midi) filter (where i <= greatest(n // 3, 1)) as head, median(midi) filter (where i > n - greatest(n // 3, 1)) as tail from h where n >= 3 group by note_id, target)
select s.note_id, coalesce(e.target, s.pitch) as pitch from sung s left join e on e.note_id = s.note_id and (tail - head > 0.5 or abs(tail - e.target) <= 0.8)""", "notes", "frames"))
def folded_onsets(spark, d):
    n = _sung(spark, d, F.col("pc"))
    frames = V.frames(spark, d).select("track_id", (F.col("t") / DAY).alias("t"), (36 + F.col("f0") / 10).alias("midi"))
    lines = n.groupBy("track_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return refine.fold_onsets(n, frames, lines, longest=1.0).select("note_id", "pitch")
