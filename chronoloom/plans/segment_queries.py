"""Queries of gaps and islands, framed statistics, metrics and per-key aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import pitch as P
from ..operators import asof, metrics, segments, signal
from . import views as V
from .registry import query
from .views import twin

_F0 = "case when f0 > 0 then 69 + 12 * log2(f0 / 440) end"


def _midi(spark, d):
    return V.frames(spark, d).select("track_id", "frame", "t", "note_id", P.hz_to_midi(F.col("f0")).alias("midi"))


@query(twin(f""", q as (select track_id, frame, cast(round_even({_F0} / 12, 0) as integer) as v from frames),
m as (select *, case when v is not distinct from lag(v) over w and row_number() over w > 1 then 0 else 1 end as new from q window w as (partition by track_id order by frame)),
g as (select *, sum(new) over (partition by track_id order by frame rows unbounded preceding) as g from m)
select track_id, v, min(frame) as start, max(frame) + 1 as "end" from g group by track_id, g, v""", "frames"))
def rle_runs(spark, d):
    q = _midi(spark, d).withColumn("v", F.rint(F.col("midi") / 12).cast("int"))
    return segments.run_lengths(q, "v").select("track_id", "v", "start", "end")


@query(twin(""", d2 as (select *, row_number() over (partition by track_id order by frame) as rn from daily), o as (select *, rn - row_number() over (partition by track_id order by frame) as g from d2 where price > 36000)
select track_id, cast(min(frame) as double) as start, cast(max(frame) + 1 as double) as "end", count(*) as n_frames from o group by track_id, g having max(frame) + 1 - min(frame) >= 3""", "daily"))
def voiced_runs(spark, d):
    x = V.daily(spark, d).withColumn("t", F.col("frame").cast("double"))
    return segments.active_runs(x, F.col("price") > 36000, 1.0, 3.0)


_MERGE = """, o as (select *, row_number() over (partition by track_id order by start, "end", note_id) as n from notes),
r as (select track_id, n, pc, start, "end", 1 as g from o where n = 1
  union all select o.track_id, o.n, o.pc, case when o.pc = r.pc and o.start - r."end" <= 7200 then r.start else o.start end,
    case when o.pc = r.pc and o.start - r."end" <= 7200 then greatest(r."end", o."end") else o."end" end,
    case when o.pc = r.pc and o.start - r."end" <= 7200 then r.g else r.g + 1 end from r join o on o.track_id = r.track_id and o.n = r.n + 1)
select track_id, pc, min(start) as start, max("end") as "end", count(*) as n_merged from r group by track_id, g, pc"""


@query(twin(_MERGE, "notes", recursive=True))
def merge_same_pitch(spark, d):
    return segments.merge_same_pitch(V.notes(spark, d), pitch="pc", max_gap=7200.0).select("track_id", "pc", "start", "end", "n_merged")


@query(twin(""", m as (select *, coalesce(cast(start - lag("end") over w > 28800 as integer), 1) as new from notes window w as (partition by track_id order by start, "end", note_id))
select note_id, cast(sum(new) over (partition by track_id order by start, "end", note_id rows unbounded preceding) as bigint) as phrase from m""", "notes"))
def phrases(spark, d):
    return segments.phrases(V.notes(spark, d), 28800.0).select("note_id", "phrase")


_KNOWN = """, q as (select track_id, frame, {0} as v from {1}),
k as (select *, last_value(case when v is not null then frame end ignore nulls) over (partition by track_id order by frame rows unbounded preceding) as b,
  first_value(case when v is not null then frame end ignore nulls) over (partition by track_id order by frame rows between current row and unbounded following) as f from q),
z as (select k.*, x.v as bv, y.v as fv from k left join q x on x.track_id = k.track_id and x.frame = k.b left join q y on y.track_id = k.track_id and y.frame = k.f)"""


@query(twin(_KNOWN.format(_F0, "frames") + """ select track_id, frame, round(case when v is not null then v when f - b - 1 <= 2 and abs(fv - bv) <= 6 then bv + (fv - bv) * ((frame - b) / (f - b)::double) end, 6) as midi from z""", "frames"))
def bridge_gaps(spark, d):
    return signal.bridge_gaps(_midi(spark, d), "midi", 2, 6.0).select("track_id", "frame", F.round("midi", 6).alias("midi"))


@query(twin(f""", q as (select track_id, frame, {_F0} as v from frames)
select track_id, frame, round(case when v is not null then quantile_cont(v, 0.5) over (partition by track_id order by frame rows between 2 preceding and 2 following) end, 6) as smooth from q""", "frames"))
def median_smooth(spark, d):
    return signal.median_smooth(_midi(spark, d), "midi", 5, "smooth").select("track_id", "frame", F.round("smooth", 6).alias("smooth"))


@query(twin(f""", q as (select track_id, frame, {_F0} as v, coalesce({_F0}, 0) as z from frames),
n as (select *, coalesce(lag(z) over w, z) as a, coalesce(lead(z) over w, z) as c from q window w as (partition by track_id order by frame))
select track_id, frame, round(case when v is not null and list_sort([a, z, c])[2] > 0 then list_sort([a, z, c])[2] end, 6) as smooth from n""", "frames"))
def smooth_voiced(spark, d):
    return signal.smooth_voiced(_midi(spark, d), "midi", "smooth").select("track_id", "frame", F.round("smooth", 6).alias("smooth"))


@query(twin(""", g as (select track_id, pc, start, lag(pc) over w as q, start - lag("end") over w as gap from notes window w as (partition by track_id order by start, "end", note_id))
select track_id, count(*) filter (where q = pc and gap between 0 and 7200) as tiny_gaps from g group by track_id""", "notes"))
def tiny_gaps(spark, d):
    return segments.tiny_gaps(V.notes(spark, d), 7200.0, pitch="pc")


@query(twin(""", g as (select track_id, pc, start, "end", lead(pc) over w as bp, lead(start) over w as bs, lead("end") over w as be, lead(pc, 2) over w as cp, lead(start, 2) over w as cs, lead("end", 2) over w as ce
  from notes window w as (partition by track_id order by start, "end", note_id))
select track_id, count(*) filter (where cp = pc and abs(bp - pc) between 1 and 3 and ce - start <= 259200 and bs - "end" <= 86400 and cs - be <= 86400) as aba from g group by track_id""", "notes"))
def aba_jitter(spark, d):
    return segments.aba_jitter(V.notes(spark, d), 259200.0, 86400.0, 3, pitch="pc")


@query(twin(""", g as (select track_id, start, "end", pc, lead(start) over w as ns, lead(pc) over w as np from notes window w as (partition by track_id order by start, "end", note_id))
select track_id, start, "end", pc, false as added from notes union all select track_id, "end", ns, cast(round_even((pc + np) / 2.0, 0) as integer), true from g where ns - "end" >= 28800 and abs(np - pc) <= 1""", "notes"))
def held_note_fill(spark, d):
    return segments.held_note_fill(V.notes(spark, d), 28800.0, 1, pitch="pc")


@query(twin(""", a as (select *, row_number() over (partition by track_id order by line) % 2 as row from lines),
b as (select *, coalesce(nullif(lead(start) over (partition by track_id order by line), 0), "end") as succ from a),
c as (select *, least(greatest("end", succ), "end" + 36000) as flip from b),
e as (select *, coalesce(greatest(lag(flip) over (partition by track_id, row order by line), start - 18000), greatest(0, start - 18000)) as shown from c)
select line, flip, shown, least(flip, coalesce(lead(shown) over (partition by track_id, row order by line), flip)) as replace from e""", "lines"))
def line_timing(spark, d):
    n = F.row_number().over(W.partitionBy("track_id").orderBy("line"))
    return segments.line_timing(V.lines(spark, d).withColumn("row", n % 2), 18000.0, 36000.0).select("line", "flip", "shown", "replace")


@query(twin(""", g as (select *, lead(start) over (partition by track_id order by start, "end", note_id) as ns from notes)
select note_id, case when ns - "end" < 900 then greatest(start + 60, ns - 900) else "end" end as "end" from g""", "notes"))
def visual_gap(spark, d):
    return segments.visual_gap(V.notes(spark, d), 900.0, 60.0).select("note_id", "end")


@query(twin(""", g as (select *, lead(start) over (partition by track_id order by start, "end", note_id) as ns from notes) select track_id, count(*) filter (where ns < "end" - 1e-6) as overlaps from g group by track_id""", "notes"))
def overlap_counts(spark, d):
    return segments.adjacent_overlaps(V.notes(spark, d))


@query(twin(_KNOWN.format("case when n % 7 <> 0 then price end", "daily") + """ select track_id, frame, round(case when v is not null then v when b is not null and f is not null then bv + (fv - bv) * ((frame - b) / (f - b)::double) else coalesce(bv, fv) end, 4) as price from z""", "daily"))
def interp_missing(spark, d):
    x = V.daily(spark, d).withColumn("price", F.when(F.col("n") % 7 != 0, F.col("price")))
    return asof.fill_linear(x, "price", one_sided=True).select("track_id", "frame", F.round("price", 4).alias("price"))


@query(twin(_KNOWN.format("case when n % 3 <> 0 then price end", "daily") + """ select track_id, frame, case when f is null or frame - b <= f - frame then bv else fv end as price from z""", "daily"))
def nearest_known(spark, d):
    x = V.daily(spark, d).withColumn("price", F.when(F.col("n") % 3 != 0, F.col("price")))
    return asof.fill_nearest(x, "price").select("track_id", "frame", "price")


@query(twin(""" select f.track_id, f.frame, t.event_type, (select count(*) from notes n where n.track_id = f.track_id and n.event_type = t.event_type and n."end" <= f.t) as done
from frames f, (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)""", "frames", "notes"))
def hud_counts(spark, d):
    p = V.frames(spark, d).select("track_id", "frame", "t")
    return segments.running_counts(V.notes(spark, d), p, "event_type", ("click", "error", "purchase", "signup", "view")).select("track_id", "frame", "event_type", F.col("done").cast("long").alias("done"))


_PAIRS = f"""pairs as (select n.track_id, n.note_id, ({_F0} - n.p) * 100 as c from frames f join notes n on n.track_id = f.track_id and f.t >= n.start and f.t < n."end" and f.note_id <> n.note_id where f0 > 0 {{0}})"""
_METRICS = """, {0}, x as (select *, abs(abs(c) - 1200) <= 120 as oct, abs((c + 600) - 1200 * floor((c + 600) / 1200) - 600) as a from pairs),
fr as (select track_id, count(*) as frames, avg(case when abs(c) <= 50 then 1 else 0 end) as rpa, avg(case when a <= 50 then 1 else 0 end) as rca, count(*) filter (where oct) as octave_frames, avg(case when oct then 1 else 0 end) as octave_rate,
  coalesce(avg(case when a <= 50 then 1 else 0 end) filter (where not oct), 0) as w50, coalesce(avg(case when a > 50 and a <= 150 then 1 else 0 end) filter (where not oct), 0) as w150,
  coalesce(avg(case when a > 150 and a <= 250 then 1 else 0 end) filter (where not oct), 0) as w250, coalesce(avg(case when a > 250 then 1 else 0 end) filter (where not oct), 0) as wgt,
  quantile_cont(a, 0.5) filter (where not oct) as med, quantile_cont(a, 0.9) filter (where not oct) as p90 from x group by track_id),
m as (select track_id, note_id, quantile_cont(c, 0.5) as c from pairs group by track_id, note_id),
y as (select *, abs(abs(c) - 1200) <= 120 as oct, abs((c + 600) - 1200 * floor((c + 600) / 1200) - 600) as a from m),
nt as (select track_id, count(*) as note_cmp, count(*) filter (where oct) as note_octave, count(*) filter (where not oct and a > 50 and a <= 150) as note_1_semitone,
  count(*) filter (where not oct and a > 150 and a <= 250) as note_2_semitone, count(*) filter (where not oct and a > 250) as note_gt_250c from y group by track_id)
select track_id, frames, round(rpa, 6) as rpa, round(rca, 6) as rca, round(greatest(0, rca - rpa), 6) as octave_proxy, octave_frames, round(octave_rate, 6) as octave_rate, round(w50, 6) as non_octave_within_50c, round(w150, 6) as non_octave_50_150c,
  round(w250, 6) as non_octave_150_250c, round(wgt, 6) as non_octave_gt_250c, round(med, 6) as folded_median_abs_cents, round(p90, 6) as folded_p90_abs_cents, note_cmp, note_octave, note_1_semitone, note_2_semitone, note_gt_250c from fr join nt using (track_id)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(twin(_METRICS.format(_PAIRS.format("")), "frames", "notes"))
def pitch_metrics(spark, d):
    pairs = metrics.note_frames(V.notes(spark, d), V.frames(spark, d), skip_own="note_id")
    return _rounded(metrics.pitch_metrics(pairs))


@query(twin(_METRICS.format(_PAIRS.format('and exists (select 1 from clicks w where w.track_id = f.track_id and f.t >= w.start and f.t < w."end")')), "frames", "clicks"))
def pitch_metrics_windowed(spark, d):
    pairs = metrics.note_frames(V.notes(spark, d), V.frames(spark, d), V.clicks(spark, d), skip_own="note_id")
    return _rounded(metrics.pitch_metrics(pairs))


@query(twin(f""", {_PAIRS.format('')}, a as (select note_id, quantile_cont(c, 0.5) as a from pairs group by note_id), b as (select note_id, quantile_cont(c / 2, 0.5) as b from pairs group by note_id)
select n.note_id, case when abs(abs(a) - 1200) <= 120 and coalesce(abs(b) > 250, true) then n.p + case when a > 0 then 12 else -12 end else n.p end as p from notes n left join a using (note_id) left join b using (note_id)""", "frames", "notes"))
def octave_by_evidence(spark, d):
    pairs = metrics.note_frames(V.notes(spark, d), V.frames(spark, d), skip_own="note_id")
    return metrics.shift_octaves_by_evidence(V.notes(spark, d), pairs, pairs.withColumn("cents", F.col("cents") / 2)).select("note_id", "p")


@query(twin(""", o as (select track_id, count(*) as c from notes n where not exists (select 1 from windows w where w.track_id = n.track_id and n.start < w."end" and n."end" > w.start) group by track_id),
g as (select track_id, pc, start, "end", lag(pc) over w as q, start - lag("end") over w as gap, lead(pc) over w as bp, lead(start) over w as bs, lead("end") over w as be, lead(pc, 2) over w as cp, lead(start, 2) over w as cs, lead("end", 2) over w as ce
  from notes window w as (partition by track_id order by start, "end", note_id)),
t as (select track_id, count(*) as notes, count(*) filter (where q = pc and gap between 0 and 7200) as tiny_gaps, count(*) filter (where cp = pc and abs(bp - pc) between 1 and 3 and ce - start <= 259200 and bs - "end" <= 86400 and cs - be <= 86400) as aba from g group by track_id),
s as (select track_id, count(*) as c from (select w.track_id, w.note_id from windows w join notes n on w.track_id = n.track_id and n.start < w."end" and n."end" > w.start
  where w."end" - w.start >= 9000 and least(n."end", w."end") - greatest(n.start, w.start) >= 600 group by all having count(*) >= 2 and max(n.pc) - min(n.pc) >= 2) group by track_id)
select t.track_id, notes, coalesce(o.c, 0) as outside, tiny_gaps, aba, coalesce(s.c, 0) as split_spans from t left join o using (track_id) left join s using (track_id)""", "windows"))
def fragmentation(spark, d):
    return metrics.fragmentation(V.notes(spark, d), V.windows(spark, d), V.windows(spark, d), tiny=7200.0, jitter=(259200.0, 86400.0, 3), least=600.0, span=9000.0)


@query(twin(""", c as (select *, "end" - start as w, sum("end" - start) over (partition by track_id order by p, "end" - start rows unbounded preceding) as run, sum("end" - start) over (partition by track_id) as total from notes)
select track_id, cast(min(p) filter (where run >= total / 2) as double) as weighted_median from c group by track_id""", "notes"))
def weighted_median(spark, d):
    return metrics.weighted_median(V.notes(spark, d), "p", F.col("end") - F.col("start"))


@query(twin(""", s as (select *, lead(p) over (partition by track_id order by start, "end", note_id) - p as step from notes),
g as (select track_id, max(p) as hi, min(p) as lo, quantile_cont("end" - start, 0.9) as p90 from notes group by track_id)
select track_id, count(*) as count, min(lo) as pmin, max(hi) as pmax, max(hi) - min(lo) as span, count(*) filter (where p >= hi - 2) as high, count(*) filter (where step >= 7) as up, count(*) filter (where step <= -7) as down,
  count(*) filter (where "end" - start > p90) as long from s join g using (track_id) group by track_id""", "notes"))
def song_stats(spark, d):
    return metrics.song_stats(V.notes(spark, d))


_PROFILE_ROWS = ", ".join(f"({t}, '{m}', {i}, {prof[(i - t) % 12]}::double)" for m, prof in (("major", metrics.MAJOR_PROFILE), ("minor", metrics.MINOR_PROFILE)) for t in range(12) for i in range(12))


@query(twin(f""", pr(tonic, mode, pc, x) as (values {_PROFILE_ROWS}),
w as (select t.track_id, s.pc, coalesce(sum(n."end" - n.start), 0) as w from (select distinct track_id from notes) t cross join range(12) s(pc) left join notes n on n.track_id = t.track_id and n.p % 12 = s.pc group by 1, 2),
r as (select track_id, tonic, mode, corr(x, w) as r, stddev_pop(w) as sd from w join pr using (pc) group by 1, 2, 3),
k as (select *, row_number() over (partition by track_id order by round(r, 9) desc, tonic desc, mode desc) as rank from r where sd > 0 and r is not null)
select track_id, cast(rank as integer) as rank, cast(tonic as integer) as tonic, mode, round(r, 6) as r from k where rank <= 3""", "notes"))
def key_detect(spark, d):
    w = metrics.pitch_class_weights(V.notes(spark, d))
    return metrics.detect_key(w).select("track_id", "rank", "tonic", "mode", F.round("r", 6).alias("r"))


@query(twin(""", x as (select track_id, note_id, "end" - start as v from notes), g as (select track_id, list_sort(list(v)) as l from x group by track_id),
p as (select track_id, l[cast(round_even((len(l) - 1) * 0.9, 0) as integer) + 1] as p90 from g) select note_id, v, p90 from x join p using (track_id) where v > greatest(p90 * 1.05, 60)""", "notes"))
def stretch_outliers(spark, d):
    x = V.notes(spark, d).select("track_id", "note_id", (F.col("end") - F.col("start")).alias("v"))
    return metrics.stretched_lines(x, "v", factor=1.05, floor=60.0).select("note_id", "v", "p90")


@query(twin(f""", m as (select track_id, {_F0} as v from frames where f0 > 0), q as (select track_id, quantile_cont(v, 0.5) as q from m group by 1),
c as (select track_id, cast(round_even(v, 0) as integer) as pitch, count(*) as n from m group by 1, 2),
r as (select track_id, pitch, n, row_number() over (partition by track_id order by n desc, abs(pitch - q), pitch) as k from c join q using (track_id)) select track_id, pitch, n from r where k = 1""", "frames"))
def mode_pitch(spark, d):
    return signal.mode_pitch(_midi(spark, d), ["track_id"], "midi").select("track_id", "pitch", "n")


@query(twin(f""", m as (select track_id, t, cast(round_even({_F0} / 6, 0) as integer) as v from frames where f0 > 0),
b as (select *, coalesce(cast(t - lag(t) over (partition by track_id, v order by t) > 172800 * 1.75 as integer), 1) as new from m),
g as (select *, sum(new) over (partition by track_id, v order by t rows unbounded preceding) as g from b), s as (select track_id, v, g, count(*) as n from g group by 1, 2, 3),
r as (select *, row_number() over (partition by track_id order by n desc, v) as k from s) select track_id, v as pitch, n as n_frames from r where k = 1""", "frames"))
def plateau_pitch(spark, d):
    x = _midi(spark, d).withColumn("m", F.col("midi") / 6)
    return signal.plateau_pitch(x, ["track_id"], "m", "t", 172800.0).select("track_id", "pitch", "n_frames")


@query(twin(""", e as (select track_id, frame, sum(y * y) over (partition by track_id order by frame rows between current row and 15 following) as e, count(*) over (partition by track_id) as n from wave),
h as (select track_id, frame as start, sqrt(e / 16) as rms from e where frame % 8 = 0 and frame + 16 <= n), q as (select track_id, quantile_cont(rms, 0.95) as q from h group by 1)
select track_id, start, round(20 * log10(greatest(rms, 1e-9) / greatest(q, 1e-9)), 5) as db from h join q using (track_id)""", "wave"))
def rms_db(spark, d):
    return signal.frame_rms_db(V.wave(spark, d), 16, 8).select("track_id", "start", F.round("db", 5).alias("db"))


@query(twin(""", c as (select track_id, unnest(range(cast(floor(start / 3600) as bigint), greatest(cast(ceil("end" / 3600) as bigint), cast(floor(start / 3600) as bigint) + 1))) as frame, p % 12 as pc from notes),
n as (select track_id, frame, pc, count(*) as n from c group by 1, 2, 3) select track_id, frame, pc, round(n / sqrt(sum(n * n) over (partition by track_id, frame)), 6) as weight from n""", "notes"))
def chroma_frames(spark, d):
    return signal.chroma_frames(V.notes(spark, d), 3600.0, "p").select("track_id", "frame", "pc", F.round("weight", 6).alias("weight"))


@query(twin(""", l as (select track_id, start as t_a, "end", p, pc, lead(start) over w as t_b, lead(p) over w as np, lead(pc) over w as npc from notes window w as (partition by track_id order by start, "end", note_id))
select track_id, t_a, t_b from l where npc = pc and np <> p and t_b - "end" <= 86400""", "notes"))
def ligatures(spark, d):
    return segments.onset_ligatures(V.notes(spark, d), 86400.0, mora="pc", pitch="p")
