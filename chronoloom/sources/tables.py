"""Readers of JSON, CSV and text sidecars, all with explicit schemas."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SEGMENT_BLACKLIST, has_any

WORD = "struct<start:double,end:double,word:string,probability:double>"
ASR = f"struct<segments:array<struct<id:bigint,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<{WORD}>>>>"
CHAR = "struct<char:string,start:double,end:double>"
TOKEN = f"struct<surface:string,reading:string,kana_only:boolean,pos:string,is_punct:boolean,start:double,end:double,chars:array<{CHAR}>>"
ALIGNED = f"array<struct<text:string,start:double,end:double,tokens:array<{TOKEN}>>>"
SEGMENTS = "struct<segments:array<struct<start:double,end:double>>>"
PATCH = "array<struct<at:double,`from`:int,pitch:int,start:double,end:double>>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_asr_chars(spark: SparkSession, path: str) -> DataFrame:
    """``(path, segment, word, ch, char, start, end)``: words' times shared evenly by their characters.

    Segments with a blacklisted phrase are dropped; white space takes a share but gives no row.
    """
    segments = _documents(spark, path).select("path", F.from_json("value", ASR).alias("d")).select("path", F.posexplode("d.segments").alias("segment", "s"))
    words = segments.where(~has_any(F.coalesce("s.text", F.lit("")), SEGMENT_BLACKLIST)).select("path", "segment", F.posexplode("s.words").alias("word", "w"))
    chars = words.withColumn("n", F.length("w.word")).where("n > 0").select("path", "segment", "word", "w", "n", F.posexplode(F.split("w.word", "")).alias("ch", "char")).where("ch < n")
    step = (F.col("w.end") - F.col("w.start")) / F.col("n")
    out = chars.select("path", "segment", "word", "ch", "char", (F.col("w.start") + step * F.col("ch")).alias("start"), (F.col("w.start") + step * (F.col("ch") + 1)).alias("end"))
    return out.where(~F.col("char").rlike(r"(?U)\s"))


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, tok, ch, char, surface, is_punct, start, end)`` of aligned documents."""
    lines = _documents(spark, path).select("path", F.from_json("value", ALIGNED).alias("d")).select("path", F.posexplode("d").alias("line", "l"))
    tokens = lines.select("path", "line", F.posexplode("l.tokens").alias("tok", "t"))
    return tokens.select("path", "line", "tok", "t.surface", "t.is_punct", F.posexplode("t.chars").alias("ch", "c")).select("path", "line", "tok", "ch", F.col("c.char").alias("char"), "surface", "is_punct", F.col("c.start").alias("start"), F.col("c.end").alias("end"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``(path, start, end)`` of a segments file, bare list or object; empty spans are dropped."""
    d = _documents(spark, path)
    bare = F.ltrim("value").startswith("[")
    listed = F.when(bare, F.from_json("value", "array<struct<start:double,end:double>>")).otherwise(F.from_json("value", SEGMENTS)["segments"])
    return d.select("path", F.explode(listed).alias("s")).select("path", "s.start", "s.end").where("end > start")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """``(path, seq, at, from, pitch, start, end)``; an empty or null document has no rows."""
    return _documents(spark, path).select("path", F.posexplode(F.from_json("value", PATCH)).alias("seq", "p")).select("path", "seq", "p.*")


def read_second_opinion(spark: SparkSession, path: str, low: int = 40, high: int = 90) -> DataFrame:
    """``(start, end, pitch, conf)`` of CSV rows start,end,pitch,velocity; short rows and far pitches go."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("start", "end", "pitch", "velocity")])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path).where("velocity is not null")
    return rows.where(F.col("pitch").between(low, high)).select("start", "end", F.col("pitch").cast("int").alias("pitch"), (F.col("velocity") / 127.0).alias("conf"))


def normal_form(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``column`` in a Unicode normal form (no builtin does this)."""
    at = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pc.all(pc.string_is_ascii(batch.column(at)), min_count=0).as_py():
                yield batch
                continue
            text = pa.array([None if x is None else unicodedata.normalize(form, x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, text)``: lines in NFKC, outer white space gone, blank lines left out."""
    d = normal_form(_documents(spark, path), "value")
    lines = d.select("path", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "text"))
    return lines.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")


def apply_overrides(tokens: DataFrame, overrides: DataFrame, surface: str = "surface", reading: str = "reading") -> DataFrame:
    """Readings from ``overrides(surface, reading)`` first, then the token's own."""
    o = overrides.groupBy(F.col("surface").alias("_s")).agg(F.min("reading").alias("_r"))
    return tokens.join(o, F.col(surface) == F.col("_s"), "left").withColumn(reading, F.coalesce("_r", reading)).drop("_s", "_r")


def pick_sources(files: DataFrame, path: str = "path", priority: tuple[str, ...] = ("wav", "mp3", "m4a", "flac")) -> DataFrame:
    """``(song, path)``: of the files of a stem, that of the first extension in ``priority``; names with ``_`` first are skipped."""
    name = F.regexp_extract(F.col(path), r"([^/]+)\.([^./]+)$", 1)
    ext = F.lower(F.regexp_extract(F.col(path), r"([^/]+)\.([^./]+)$", 2))
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), ext)
    kept = files.select(F.col(path).alias("path"), name.alias("song"), rank.alias("rank")).where("rank > 0 and song <> '' and not startswith(song, '_')")
    return kept.groupBy("song").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
