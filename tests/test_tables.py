"""DataFrame operators on small tables, readers, streams, and every query against its DuckDB twin."""

import json
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronoloom.functions import pitch as P
from chronoloom.functions import tables as table_functions
from chronoloom.functions import text as X
from chronoloom.operators import asof, document, folds, intervals, metrics, segments, signal
from chronoloom.plans import queries as library
from chronoloom.sources import midi, tables
from chronoloom.streaming import windows as stream

ROOT = os.path.dirname(__spark_entry__.__file__)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spans(spark, rows, names="track_id long, start double, end double"):
    return spark.createDataFrame(rows, names)


def pairs_of(df):
    return sorted((round(r.start, 6), round(r.end, 6)) for r in df.collect())


def test_interval_algebra(spark):
    a = spans(spark, [(1, 1.0, 2.0), (1, 2.4, 3.0), (1, 10.0, 12.0)])
    assert pairs_of(intervals.pad_clamp(a, 0.3)) == [(0.7, 3.3), (9.7, 12.3)]
    x, y = spans(spark, [(1, 90.0, 106.0)]), spans(spark, [(1, 87.0, 92.0), (1, 95.2, 97.0), (1, 106.2, 116.0)])
    assert pairs_of(intervals.intersect_windows(x, y, bucket=5.0)) == [(90.0, 92.0), (95.2, 97.0)]
    left = intervals.fill_from(spans(spark, [(1, 1.0, 2.0), (1, 3.0, 4.0)]), spans(spark, [(1, 0.0, 5.0)]))
    assert pairs_of(left) == [(0.02, 0.98), (2.02, 2.98), (4.02, 4.98)]
    narrow = intervals.fill_from(spans(spark, [(1, 0.0, 1.0), (1, 1.05, 2.0)]), spans(spark, [(1, 0.9, 1.2)]))
    assert pairs_of(narrow) == []
    nested = spans(spark, [(1, 0.0, 9.0), (1, 1.0, 2.0), (1, 2.5, 3.0)])
    assert pairs_of(intervals.merge_windows(nested)) == [(0.0, 9.0)]
    assert pairs_of(intervals.merge_windows(nested, gap=0.5, keep_last_end=True)) == [(0.0, 3.0)]
    assert intervals.merge_windows(a.where("false")).count() == 0


@pytest.mark.parametrize("bucket", [0.5, 3.0, 1000.0])
def test_overlap_join_counts_each_pair_once(spark, bucket):
    left = [(1, float(i), i + 2.5) for i in range(8)]
    right = [(1, i * 1.5, i * 1.5 + 4) for i in range(6)] + [(2, 0.0, 99.0)]
    got = intervals.overlap_join(spans(spark, left), spans(spark, right), bucket=bucket).count()
    assert got == sum(a < d and b > c for _, a, b in left for k, c, d in right if k == 1)


def test_asof_and_nearest(spark):
    points = spark.createDataFrame([(1, 9.95), (1, 0.0), (1, -1.0), (2, 5.0)], "track_id long, t double")
    marks = spark.createDataFrame([(1, 0.0), (1, 10.0)], "track_id long, at double")
    got = {(r.track_id, r.t): r.mark and r.mark.at for r in asof.asof_backward(points, marks, mark_t="at", tolerance=0.1).collect()}
    assert got == {(1, 9.95): 10.0, (1, 0.0): 0.0, (1, -1.0): None, (2, 5.0): None}
    near = {r.t: r.mark.at for r in asof.nearest(points.where("track_id = 1"), marks, mark_t="at").collect()}
    assert near == {9.95: 10.0, 0.0: 0.0, -1.0: 0.0}
    far = {r.t: r.mark and r.mark.at for r in asof.nearest(points.where("track_id = 1"), marks, mark_t="at", beyond=0.25, within=9.0).collect()}
    assert far == {9.95: None, 0.0: None, -1.0: 0.0}
    warped = asof.warp(points, marks.withColumn("d", F.col("at") * 2), "t", "at", "d", "x")
    assert {(r.track_id, r.t): r.x for r in warped.collect()}[1, 9.95] == pytest.approx(19.9)


def test_segments_and_signal(spark):
    f = [(1, i, i * 0.01, 440.0 if i < 10 or i >= 12 else None) for i in range(22)]
    frames = spark.createDataFrame(f, "track_id long, frame long, t double, f0 double").withColumn("midi", P.hz_to_midi(F.col("f0")))
    assert signal.bridge_gaps(frames, "midi", 5, 0.75).where("midi is null").count() == 0
    assert signal.bridge_gaps(frames, "midi", 1, 0.75).where("midi is null").count() == 2
    runs = segments.active_runs(frames, F.col("f0").isNotNull(), 0.01, 0.05)
    assert pairs_of(runs) == [(0.0, 0.1), (0.12, 0.22)]
    notes = spark.createDataFrame([(1, 0, 0.0, 1.0, 63), (1, 1, 11.0, 12.0, 63), (1, 2, 16.0, 17.0, 63)], "track_id long, note_id long, start double, end double, pitch int")
    assert (1.0, 11.0) in pairs_of(segments.held_note_fill(notes)) and segments.held_note_fill(notes).count() == 4
    anchor = [(1, i, i * 0.2, i * 0.2 + 0.2, p) for i, p in enumerate([65] * 25 + [63] * 25 + [53] * 20 + [55] * 10)]
    raised = folds.raise_phrase_octaves(spark.createDataFrame(anchor, notes.schema))
    assert {r.pitch for r in raised.collect()} == {63, 65, 67}


def test_metrics_on_nothing(spark):
    notes = spark.createDataFrame([], "track_id long, note_id long, start double, end double, p int")
    frames = spark.createDataFrame([], "track_id long, frame int, t double, f0 double")
    row = metrics.overall_pitch_metrics(metrics.note_frames(notes, frames)).collect()[0]
    assert row.frames == 0 and row.rpa == 0 and row.folded_median_abs_cents is None


def test_text_and_clock(spark):
    rows = [("ねえ" * 10, True), ("ねえ" * 9, False), ("ラララ" * 10, True), ("ご視聴ありがとうございました", True), ("きらり きらり 夜空の星", False), ("ab　" * 10, True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(X.is_hallucinated(F.col("t")) != F.col("want")).count() == 0
    assert spark.range(1).select(X.clock(F.lit(61.005))).first()[0] == "[01:01:00]" and spark.range(1).select(X.clock(F.lit(-1.0))).first()[0] == "[00:00:00]"
    kana = spark.createDataFrame([("カタカナa",)], "t string").select(X.katakana_to_hiragana(F.col("t"))).first()[0]
    assert kana == "かたかなa"


def test_nested_round_trip_and_breaks(spark):
    chars = spark.createDataFrame([(1, 1, i, c, i * 1.0, i + 1.0) for i, c in enumerate("abcd")], "track_id long, line long, ch int, label string, from double, to double")
    nested = document.nest_lines(chars)
    assert nested.first().text == "abcd" and sorted(map(tuple, document.unnest_chars(nested).select("ch", "label").collect())) == [(i, c) for i, c in enumerate("abcd")]
    assert document.enhanced_lrc(nested).first().lrc.startswith("[00:00.00]<00:00.00>a<00:01.00>b")
    tokens = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 1, 3)], "track_id long, line long, tok int, n_chars long")
    cut = lambda at: document.manual_breaks(tokens, spark.createDataFrame([(1, 1, at)], "track_id long, line long, at long"))
    assert [r.part for r in cut(2).orderBy("tok").collect()] == [0, 1]
    with pytest.raises(Exception, match="inside a token"):
        cut(3).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(midi.write([(0.0, 1.0, 60), (1.0, 2.0, 62)]))
    events = midi.read_events(spark, str(tmp_path / "a.mid"))
    assert [(r.pitch, round(r.end, 3)) for r in midi.pair_notes(events).orderBy("note_id").collect()] == [(60, 1.0), (62, 2.0)]
    assert midi.first_tempo_bpm(events).first().bpm == 120.0
    (tmp_path / "asr.json").write_text(json.dumps({"segments": [{"id": 0, "text": "ab c", "words": [{"word": "a b", "start": 0.0, "end": 3.0}]}, {"id": 1, "text": "Thanks for watching", "words": [{"word": "x", "start": 0.0, "end": 1.0}]}]}))
    assert sorted((r.char, r.start) for r in tables.read_asr_chars(spark, str(tmp_path / "asr.json")).collect()) == [("a", 0.0), ("b", 2.0)]
    (tmp_path / "seg.json").write_text('{"segments": [{"start": 1, "end": 2}, {"start": 3, "end": 3}]}')
    (tmp_path / "bare.json").write_text('[{"start": 1, "end": 2}]')
    assert tables.read_segments(spark, str(tmp_path / "seg.json")).count() == tables.read_segments(spark, str(tmp_path / "bare.json")).count() == 1
    (tmp_path / "e.csv").write_text("start,end,pitch,velocity\n0,1,60,127\n0,1,20,127\n0,1\n")
    assert [tuple(r) for r in tables.read_second_opinion(spark, str(tmp_path / "e.csv")).collect()] == [(0.0, 1.0, 60, 1.0)]
    (tmp_path / "l.txt").write_text("ｶﾅ \n\n  b　")
    assert [r.text for r in tables.read_lyrics(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == ["カナ", "b"]
    files = spark.createDataFrame([("x/s.mp3",), ("x/s.wav",), ("x/_t.wav",), ("x/u.txt",)], "path string")
    assert [tuple(r) for r in tables.pick_sources(files).collect()] == [("s", "x/s.wav")]


def test_streams(spark, tiny, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{tiny}/events.parquet").repartition(3).write.parquet(str(src))
    events = stream.event_stream(spark, str(src))

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    pages = drained(stream.pages(events, late="4000 days"), "pages", "update")
    assert pages.groupBy("user_id", "start").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == spark.read.parquet(str(src)).count()
    assert drained(stream.running_merge(events, 3600.0), "merged", "append").where("end < start or n < 1").count() == 0


def test_running_merge_takes_late_events_in_order(spark, tmp_path):
    src = tmp_path / "in"
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    batches = [[(1, 0), (1, 100), (2, 50)], [(1, 60), (1, 400)], [(2, 60), (1, 5000)], [(3, 20000)], [(3, 20001)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, u, s) for k, (u, s) in enumerate(rows)], "event_id long, user_id long, s int")
        df = df.selectExpr("event_id", f"{base} + make_interval(0,0,0,0,0,0,s) as ts", "user_id", "'x' as event_type", "1.0D as value", "'' as props")
        df.coalesce(1).write.mode("append").parquet(str(src))
    q = stream.running_merge(stream.event_stream(spark, str(src)), 100.0, "10 minutes").writeStream.format("memory").queryName("late_merge").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    zero = spark.sql(f"select unix_timestamp({base})").first()[0]
    got = sorted((r.user_id, round(r.start - zero), round(r.end - zero), r.n) for r in spark.table("late_merge").collect())
    assert [g for g in got if g[1] < 4000] == [(1, 0, 100, 3), (1, 400, 400, 1), (2, 50, 60, 2)]


def test_table_functions(spark):
    table_functions.register(spark)
    assert [tuple(r) for r in spark.sql("select * from furigana('待ち', 'まち')").collect()] == [("待", "ま", 0, 1), ("ち", None, 1, 2)]
    rows = spark.sql("select t.id, m.* from values (1, 'きょう'), (2, '') as t(id, kana), lateral morae(t.kana) as m").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "きょ"), (1, 1, "う")]


def _normal(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_twin(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, tiny)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(repr([_normal(r[c]) for c in sorted(columns)]) for r in got.collect())
    b = sorted(repr([_normal(r[columns.index(c)]) for c in sorted(columns)]) for r in want.fetchall())
    assert a == b


def same_as_twin(spark, folder, name, events):
    """``events``: (event_id, microseconds after 2024, user_id, event_type, value, k)."""
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    for i, us, user, kind, value, k in events:
        con.execute("insert into events values (?, make_timestamp(1704067200000000 + ?::bigint), ?, ?, ?, ?)", [i, us, user, kind, value, json.dumps({"k": k})])
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = sorted(repr([_normal(v) for v in r]) for r in want.fetchall())
    assert sorted(repr([_normal(r[c]) for c in columns]) for r in got.collect()) == rows
    return rows


def test_a_note_without_length_is_relabelled(spark, tmp_path):
    minute = 60_000_000
    events = [(0, 0, 1, "error", 50.0, 5), (1, 10 * minute, 1, "view", 0.0, 1), (2, 10 * minute, 2, "view", 0.0, 1), (100, 0, 1, "click", 30.0, 9), (3, 20 * minute, 1, "view", 0.004, 5)]
    assert same_as_twin(spark, tmp_path, "second_opinion_relabel", events) == ["[1, 45]", "[2, 37]", "[3, 45]"]


@pytest.mark.parametrize("name", ["midi_deltas", "midi_fifo"])
def test_ticks_round_as_in_sql(spark, tmp_path, name):
    half = 45_000_000  # half a tick
    events = [(i, half * (2 * i + 1), i % 3, "view", (i % 5) * 3.75, i) for i in range(400)] + [(400 + i, -half * 7 * i, 7, "view", 60.0 * i, i) for i in range(1, 5)]
    assert len(same_as_twin(spark, tmp_path, name, events)) == len(events)


def test_deltas_of_notes_without_times(spark, tmp_path):
    events = [(0, None, 1, "view", 5.0, 1), (1, 10**9, 1, "view", 5.0, 1), (2, 2 * 10**9, 1, "view", None, 1), (3, 2 * 10**9, 1, "view", 5.0, 1), (None, 3 * 10**9, 1, "view", 5.0, 1)]
    assert len(same_as_twin(spark, tmp_path, "midi_deltas", events)) == 4


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_query_without_twin_runs(spark, tiny, name):
    rows = __spark_entry__.queries()[name](spark, tiny).collect()
    assert rows or name == "techniques_found"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else [])))
    assert not (copy / "chronoloom" / "llm").exists()
    say = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names, twins = json.loads(subprocess.run([sys.executable, "-c", say], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.splitlines()[-1])
    assert set(names) == set(library.queries()) and set(twins) == set(library.oracle_sql())
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-500:]
