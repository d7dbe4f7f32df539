"""Views over the driver's tables that stand in for notes, frames, lines and pages.

Each view exists twice: as a DataFrame and, under the same name, as DuckDB text for the oracles.
Times are whole microseconds divided by a million, so that both engines hold equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ts)")
    return e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("note_id"), us.alias("us"), "value", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, note_id, start, end (``value`` minutes long), p, pc, event_type."""
    end = (F.col("us") + F.round(F.col("value") * 100).cast("long") * 600000) / F.lit(1e6)
    return _event_base(spark, sf_dir).select("track_id", "note_id", (F.col("us") / F.lit(1e6)).alias("start"), end.alias("end"), (36 + F.col("k") % 48).alias("p"), (60 + F.col("k") % 12).alias("pc"), "event_type")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a sample: f0 is its value, null for errors; ``frame`` numbers a track's samples."""
    f0 = F.when(F.col("event_type") != "error", F.col("value"))
    number = F.row_number().over(W.partitionBy("track_id").orderBy("us", "note_id"))
    return _event_base(spark, sf_dir).select("track_id", number.alias("frame"), (F.col("us") / F.lit(1e6)).alias("t"), f0.alias("f0"), "note_id")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of type view, an hour wider on both sides."""
    return notes(spark, sf_dir).where("event_type = 'view'").select("track_id", "note_id", (F.col("start") - 3600).alias("start"), (F.col("end") + 3600).alias("end"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of type click, as a second list of windows."""
    return notes(spark, sf_dir).where("event_type = 'click'").select("track_id", "note_id", "start", "end", "p", "pc")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense signal per (return flag, line status): mean price by day number."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    price = F.floor(F.avg(F.round(F.col("l_extendedprice") * 100).cast("long"))) / 100
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("track_id"), day.alias("frame")).agg(price.alias("price"), F.count("*").alias("n"))


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order is a line and a track of its own; its items are characters laid end to end by quantity."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    total = F.sum("l_quantity").over(order.rowsBetween(W.unboundedPreceding, 0))
    return li.select(F.col("l_orderkey").alias("track_id"), F.col("l_orderkey").alias("line"), F.row_number().over(order).alias("ch"), (total - F.col("l_quantity")).alias("from"), total.alias("to"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("width"), F.col("l_suppkey").alias("supp"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of their customer: start = order number in hours, end by total quantity in minutes."""
    c = chars(spark, sf_dir).groupBy("line").agg(F.max("to").alias("w"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("line"))
    start = F.col("line") * F.lit(3600.0)
    return o.join(c, "line").select("track_id", "line", start.alias("start"), (start + F.col("w") * 60.0).alias("end"), "n")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a supplier in date order, as wide as their quantity."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_suppkey").alias("track_id"), F.row_number().over(order).alias("seq"), F.col("l_quantity").alias("width"))


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as short signals, in thousandths."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("frame", "x")).select("track_id", "frame", (F.floor(F.col("x").cast("double") * 1000) / 1000).alias("y"))


def warp_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track, the windows' starts as anchors; display time gives each a page of 1 000 s."""
    w = windows(spark, sf_dir).groupBy("track_id", F.col("start").alias("real")).agg(F.count("*").alias("n"))
    seq = F.row_number().over(W.partitionBy("track_id").orderBy("real"))
    return w.select("track_id", seq.alias("seq"), "real", (seq * 1000.0).alias("display"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


#: DuckDB twins, in an order in which later ones may use earlier ones.
SQL = {
    "base": """base as (select user_id as track_id, event_id as note_id, epoch_us(ts) - 1704067200000000 as us, value, event_type,
  cast(regexp_extract(props, '"k"\\s*:\\s*(-?[0-9]+)', 1) as integer) as k from events)""",
    "notes": """notes as (select track_id, note_id, us / 1e6 as start, (us + cast(round(value * 100) as bigint) * 600000) / 1e6 as "end",
  36 + k % 48 as p, 60 + k % 12 as pc, event_type from base)""",
    "frames": """frames as (select track_id, cast(row_number() over (partition by track_id order by us, note_id) as integer) as frame, us / 1e6 as t,
  case when event_type <> 'error' then value end as f0, note_id from base)""",
    "windows": """windows as (select track_id, note_id, start - 3600 as start, "end" + 3600 as "end" from notes where event_type = 'view')""",
    "clicks": """clicks as (select track_id, note_id, start, "end", p, pc from notes where event_type = 'click')""",
    "merged": """marked as (select *, case when start > max("end") over (partition by track_id order by start, "end" rows between unbounded preceding and 1 preceding)
    then 1 when row_number() over (partition by track_id order by start, "end") = 1 then 1 else 0 end as new from windows),
  grouped as (select *, sum(new) over (partition by track_id order by start, "end" rows unbounded preceding) as g from marked),
  merged as (select track_id, min(start) as start, max("end") as "end" from grouped group by track_id, g)""",
    "daily": """daily as (select l_returnflag || l_linestatus as track_id, cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as integer) as frame,
  floor(avg(cast(round(l_extendedprice * 100) as bigint))) / 100 as price, count(*) as n from lineitem group by 1, 2)""",
    "chars": """chars as (select l_orderkey as track_id, l_orderkey as line,
  cast(row_number() over o as integer) as ch, sum(l_quantity) over (o rows unbounded preceding) - l_quantity as "from", sum(l_quantity) over (o rows unbounded preceding) as "to",
  l_returnflag as label, l_quantity as width, l_suppkey as supp from lineitem
  window o as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))""",
    "lines": """lines as (select o_custkey as track_id, o_orderkey as line, o_orderkey * 3600.0::double as start, o_orderkey * 3600.0::double + w * 60.0::double as "end", n
  from orders join (select line, max("to") as w, count(*) as n from chars group by line) c on c.line = o_orderkey)""",
    "items": """items as (select l_suppkey as track_id, cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as integer) as seq,
  l_quantity as width from lineitem)""",
    "wave": """wave as (select vec_id as track_id, cast(i - 1 as integer) as frame, floor(cast(embedding[i] as double) * 1000) / 1000 as y from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))""",
    "anchors": """anchors as (select track_id, cast(row_number() over (partition by track_id order by real) as integer) as seq, real,
  row_number() over (partition by track_id order by real) * 1000.0::double as display from (select distinct track_id, start as real from windows))""",
    "doc_lines": """doc_lines as (select doc_id, cast(i - 1 as integer) as line_no, string_split(text, chr(10))[i] as text from documents, generate_series(1, 100000) s(i) where i <= len(string_split(text, chr(10))))""",
}
_NEEDS = {"notes": ["base"], "frames": ["base"], "windows": ["base", "notes"], "clicks": ["base", "notes"], "merged": ["base", "notes", "windows"], "lines": ["chars"], "anchors": ["base", "notes", "windows"]}


def twin(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text: the views ``names`` and what they rest on, then ``body`` (``, cte as (...) select ...``)."""
    wanted = {n for name in names for n in (*_NEEDS.get(name, []), name)}
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL[n] for n in SQL if n in wanted) + body
