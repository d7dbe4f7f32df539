"""Queries over text lines and nested timed text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import document, folds
from . import views as V
from .registry import query
from .views import twin

_STRIP = r"regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', '', 'g')"


@query(twin(f""", t as (select doc_id, line_no, {_STRIP} as t from doc_lines) select doc_id, line_no from t
where (len(t) >= 30 and len(list_distinct(string_split(t, ''))) < 0.15 * len(t))
  or len(list_filter(range(1, greatest(len(t) - 18, 1)), lambda i: substr(t, i, 20) = repeat(substr(t, i, 2), 10))) > 0
  or len(list_filter(range(1, greatest(len(t) - 28, 1)), lambda i: substr(t, i, 30) = repeat(substr(t, i, 3), 10))) > 0""", "doc_lines"))
def repetition_filter(spark, d):
    return V.doc_lines(spark, d).where(X.is_repetitive(F.col("text"))).select("doc_id", "line_no")


@query(twin(" select doc_id, line_no from doc_lines where contains(text, 'idiot') or contains(text, 'token')", "doc_lines"))
def stock_phrase_filter(spark, d):
    return V.doc_lines(spark, d).where(X.has_any(F.col("text"), ("idiot", "token"))).select("doc_id", "line_no")


@query(twin(r" select doc_id, line_no, cast(length(regexp_replace(text, '[\p{P}\p{S}\s\x0b\x{85}\p{Z}]', '', 'g')) as integer) as sung from doc_lines", "doc_lines"))
def sung_chars(spark, d):
    lines = V.doc_lines(spark, d)
    chars = F.filter(F.split("text", ""), lambda c: (c != "") & X.is_sung(c))
    return lines.select("doc_id", "line_no", F.size(chars).alias("sung"))


@query(twin(f" select doc_id, line_no, substr({_STRIP}, 1, 150) as head from doc_lines", "doc_lines"))
def prompt_head(spark, d):
    return V.doc_lines(spark, d).select("doc_id", "line_no", X.prompt_head(F.col("text")).alias("head"))


@query(twin(" select doc_id, translate(text, 'ァアィイウカキクー', 'ぁあぃいうかきくー') as hiragana, regexp_matches(text, '[㐀-䶿一-鿿豈-﫿々]') as kanji from documents").replace("with  select", "select"))
def kana_convert(spark, d):
    t = V.table(spark, d, "documents")
    return t.select("doc_id", X.katakana_to_hiragana(F.col("text")).alias("hiragana"), X.has_kanji(F.col("text")).alias("kanji"))


@query(twin(r""" select page_id, trim(regexp_replace(lower(trim(url)), '[^\p{L}\p{N}]+', '-', 'g'), '-') as slug, nullif(regexp_extract(url, '(?:youtu\.be/|[?&]v=|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1), '') as video from pages""").replace("with  select", "select"))
def url_slugs(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.video_id(F.col("url")).alias("video"))


@query(twin(""" select event_id, list_sort(list_filter(json_keys(props), lambda k: k not in ('k'))) as extra from events""").replace("with  select", "select").replace("list_sort(list_filter(json_keys(props), lambda k: k not in ('k'))) as extra", "array_to_string(list_sort(list_filter(json_keys(props), lambda k: k not in ('k'))), ',') as extra"))
def unknown_keys(spark, d):
    return V.table(spark, d, "events").select("event_id", F.array_join(X.unknown_keys(F.col("props"), ("k",)), ",").alias("extra"))


@query(twin(""" select line, string_agg(label, '' order by ch) as text, min("from") as start, max("to") as "end", count(*) as n_chars from chars group by line""", "chars"))
def nest_lines(spark, d):
    return document.nest_lines(V.chars(spark, d)).select("line", "text", "start", "end", F.size("chars").cast("long").alias("n_chars"))


@query(twin(' select line, ch, label, "from", "to" from chars', "chars"))
def unnest_chars(spark, d):
    return document.unnest_chars(document.nest_lines(V.chars(spark, d))).select("line", "ch", "label", "from", "to")


_CLOCK = "printf('{o}%02d:%02d.%02d{c}', cast(cast(round_even({v} * 100, 0) as bigint) // 6000 as integer), cast((cast(round_even({v} * 100, 0) as bigint) // 100) % 60 as integer), cast(cast(round_even({v} * 100, 0) as bigint) % 100 as integer))"


@query(twin(f""" select line, {_CLOCK.format(o='[', c=']', v='min("from")')} || string_agg({_CLOCK.format(o='<', c='>', v='"from"')} || label, '' order by ch) as lrc from chars group by line""", "chars"))
def lrc_format(spark, d):
    return document.enhanced_lrc(document.nest_lines(V.chars(spark, d))).select("line", "lrc")


@query(twin(' select line, min_by(label, ch) as first, max_by(label, ch) as last from chars group by line', "chars"))
def first_and_last(spark, d):
    return document.first_and_last(V.chars(spark, d)).select("line", "first", "last")


def _timed(spark, d):
    return V.chars(spark, d).select(F.col("line").alias("track_id"), "line", "ch", "label", (F.col("from") * 1.0).alias("start"), (F.col("to") * 1.0).alias("end"), "width")


@query(twin(""", m as (select *, max(case when label <> 'N' then ch end) over (partition by line order by ch rows between unbounded preceding and 1 preceding) as b, min(case when label <> 'N' then ch end) over (partition by line order by ch rows between 1 following and unbounded following) as f from chars)
select m.line, m.ch, case when m.label <> 'N' then m."from" else coalesce(x."to", y."from", 0) end as start, case when m.label <> 'N' then m."to" else coalesce(x."to", y."from", 0) end as "end"
from m left join chars x on x.line = m.line and x.ch = m.b left join chars y on y.line = m.line and y.ch = m.f""", "chars"))
def pin_unsung(spark, d):
    return document.pin_unsung(_timed(spark, d), F.col("label") != "N").select("line", "ch", "start", "end")


@query(twin(' select line, ch, cast(m as integer) as mora, round("from" + (("to" - "from") / (1 + ch % 3)) * m, 6) as start, round("from" + (("to" - "from") / (1 + ch % 3)) * (m + 1), 6) as "end" from chars, range(3) r(m) where m < 1 + ch % 3', "chars"))
def even_morae(spark, d):
    out = document.even_morae(_timed(spark, d), 1 + F.col("ch") % 3)
    return out.select("line", "ch", "mora", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(twin(""", p as (select *, ("from" + "to") / 2 // 60 as page from chars), t as (select *, coalesce(cast(page <> lag(page) over (partition by line order by ch) as integer), 0) as t from p)
select line, ch, cast(page as integer) as page, cast(sum(t) over (partition by line order by ch rows unbounded preceding) as bigint) as chunk from t""", "chars").replace('("from" + "to") / 2 // 60 as page', 'floor(("from" + "to") / 2 / 60) as page'))
def page_split(spark, d):
    tokens = _timed(spark, d).withColumnRenamed("ch", "tok")
    pages = tokens.groupBy("track_id").agg(F.max("end").alias("e")).select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / 60).cast("int"))).alias("page")).withColumn("start", F.col("page") * 60.0)
    out = document.pages_of_tokens(tokens, pages)
    return out.select("line", F.col("tok").alias("ch"), "page", "chunk")


@query()
def page_chunks(spark, d):
    tokens = _timed(spark, d).withColumn("chunk", F.floor((F.col("start") + F.col("end")) / 120).cast("int")).withColumn("n", F.col("width").cast("int"))
    tokens = tokens.withColumn("pos", F.when(F.col("label") == "N", "particle").otherwise("noun")).withColumn("punct", F.lit(False))
    return folds.by_key(tokens, lambda rows: list(zip([r[6] for r in rows], document.settle_chunks(rows, 40), strict=True)), ("chunk", "start", "end", "n", "pos", "punct", "ch"), ("ch",), "ch int, part int")


@query(twin(""", b as (select line, list(upto) as cuts from (select line, sum(width) over (partition by line order by ch rows unbounded preceding) as upto, ch from chars) where ch % 3 = 0 group by line),
u as (select *, sum(width) over (partition by line order by ch rows unbounded preceding) - width as f from chars) select u.line, u.ch, cast(coalesce(len(list_filter(cuts, lambda c: c <= f)), 0) as integer) as part from u left join b using (line)""", "chars"))
def manual_breaks(spark, d):
    tokens = _timed(spark, d).withColumn("n_chars", F.col("width").cast("long"))
    breaks = tokens.where("ch % 3 = 0").select("track_id", "line", F.col("end").cast("long").alias("at"))
    return document.manual_breaks(tokens, breaks, order="ch").select("line", "ch", "part")


@query(twin(""", s as (select line, ch, case when width > 10 then "from" end as s, case when width > 10 then "to" end as e from chars),
k as (select *, max(case when s is not null then ch end) over (partition by line order by ch rows unbounded preceding) as b, min(case when s is not null then ch end) over (partition by line order by ch rows between current row and unbounded following) as f from s)
select k.line, k.ch, round(coalesce(k.s, case when b is null then coalesce(y.s, 0) when f is null then x.e else x.e + (y.s - x.e) * ((k.ch - b) / (f - b)::double) end), 6) as start
from k left join s x on x.line = k.line and x.ch = k.b left join s y on y.line = k.line and y.ch = k.f""", "chars"))
def interpolated_spans(spark, d):
    t = _timed(spark, d)
    known = t.select("track_id", "ch", F.when(F.col("width") > 10, F.col("start")).alias("start"), F.when(F.col("width") > 10, F.col("end")).alias("end"))
    return document.fill_spans(known).select(F.col("track_id").alias("line"), "ch", F.round("start", 6).alias("start"))
