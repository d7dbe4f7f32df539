"""Romanised lines, labels, mask boxes, spectra and quiet cuts on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import document, metrics, packing, romaji, signal
from chronoloom.sources import signals


def word(surface, reading=None, punct=False):
    return {"surface": surface, "reading": reading, "is_punct": punct}


def test_lines_pair_with_what_is_spoken():
    lines = [[word("君", "キミ"), word("は")], [word("なにも")], [word("明日", "アシタ"), word("へ"), word("行", "イ"), word("く")], [word("OK", None), word("空", "ソラ")], [word("海", "ウミ")]]
    spoken = ["きみわ", "x", "あすえいく", "おけそら", "やま"]
    got = romaji.pair_lines(lines, [X.hiragana(s) for s in spoken])
    assert got[0] == (0, 0, None)
    assert got[1] == (2, 2, {0: "あす", 2: "い"})
    assert got[2][:2] == (3, 3) and got[3] == (4, 4, {0: "やま"})
    assert romaji.pair_lines([[word("海", "ウミ"), word("よ")]], ["そら"]) == [(0, None, {})]
    p = romaji.line_pattern([word("今日", "キョウ"), word("空", "ソラ"), word("」", punct=True), word("青", "アオ")])
    assert p.tokens == (0, 1, 3) and p.unsure == {0, 1}
    assert romaji.line_pattern([word("かな")]) is None and romaji.pair_lines([], []) == []


def test_hiragana_agrees_with_the_column(spark):
    texts = ["カード", "ガッー", "ーき", "ラーーメン", "ゔーa", "ﾃｽﾄ", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t != "ﾃｽﾄ"], "i int, s string")
    assert {r.i: r.k for r in df.select("i", X.normal_kana(F.col("s")).alias("k")).collect()} == {i: X.hiragana(t) for i, t in enumerate(texts) if t != "ﾃｽﾄ"}
    assert X.hiragana("ﾃｽﾄ") == "てすと"


def test_labels_paths_and_boxes(spark):
    df = spark.createDataFrame([("~/a/b", "1,2,3.7,4;5,6,7,8@1.5-2", 3), ("~x", "", 4), ("~", None, 5), ("/a~", ";", 6)], "p string, m string, n int")
    assert [r[0] for r in df.select(X.expanded_home(F.col("p"), F.lit("/h$"))).collect()] == ["/h$/a/b", "~x", "/h$", "/a~"]
    boxes = [[tuple(b) for b in r[0]] for r in df.select(X.mask_boxes(F.col("m"))).collect()]
    assert boxes == [[(1, 2, 3, 4, None, None), (5, 6, 7, 8, 1.5, 2.0)], [], [], []]
    with pytest.raises(Exception, match="a box must be"):
        df.select(X.mask_boxes(F.lit("1,2,3"))).collect()
    n = F.col("n")
    assert df.select(X.song_label(n, F.lit("C4"), F.lit("G5"), n, n, n, n, n)).first()[0] == "音符 3　音域 C4〜G5（3半音）　高音 3　跳躍 ↑3 ↓3　長音 3"


def test_spectra_and_cuts():
    rate = 16000
    t = np.arange(3 * rate) / rate
    chord = sum(np.sin(2 * np.pi * f * t) for f in (261.63, 329.63, 392.0))
    got = signal.pitch_class_profile(chord, rate)
    assert set(np.argsort(got)[-3:].tolist()) == {0, 4, 7} and got.sum() == pytest.approx(1)
    assert signal.pitch_class_profile(np.zeros(100), rate) is None and signal.pitch_class_profile(np.zeros(3 * rate), rate) is None
    loud = np.ones(40 * 100)
    loud[1790:1810] = 0
    spans = signal.quiet_chunks(loud, 100, 20.0)
    assert spans[0][0] == 0 and spans[-1][1] == 4000 and 1788 <= spans[0][1] <= 1810 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert signal.quiet_chunks(loud, 100, 60.0) == [(0, 4000)]


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 440 * t)
    for to in (4000, 16000, 11025):
        y = signals.resampled(x, 8000, to)
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
        assert len(y) == to and np.abs(y[200:-200] - want[200:-200]).max() < 0.01
    assert len(signals.resampled(np.zeros(0), 8000, 4000)) == 0
    high = signals.resampled(np.sin(2 * np.pi * 3000 * t), 8000, 4000)
    assert np.abs(high[100:-100]).max() < 0.05


def test_filler_pages_and_rows(spark):
    spans = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 0.0)], "track_id long, end double")
    got = {}
    for r in packing.filler_pages(spans).orderBy("track_id", "page").collect():
        got.setdefault(r.track_id, []).append((r.start, r.label))
    assert got == {1: [(0.0, "P01"), (4.0, "P02"), (8.0, "P03"), (10.0, "END")], 2: [(0.0, "P01"), (4.0, "P02"), (9.0, "END")], 3: [(1.0, "END")]}
    chars = document.line_chars([{"reading": "あしぶみ", "kana_only": False, "chars": [{"char": c, "start": i, "end": i + 1} for i, c in enumerate("足踏み")]}, {"chars": []}])
    assert [(c["char"], c.get("ruby"), c.get("ruby_span")) for c in chars] == [("足", "あしぶ", 2), ("踏", None, None), ("み", None, None)]
    one = "array<struct<start:double,end:double>>"
    lines = spark.createDataFrame([(1, 0, "a", [(0.0, 1.0)]), (1, 1, "b", []), (1, 2, "c", [(2.0, 3.0), (3.0, 4.0)])], f"track_id long, line int, text string, chars {one}")
    back = spark.createDataFrame([(1, 2, "oh"), (1, 0, "")], "track_id long, line int, backing string")
    assert [(r.text, r.row, r.start, r.end, r.backing) for r in document.lyric_rows(lines, back).orderBy("line").collect()] == [("a", "A", 0.0, 1.0, None), ("c", "B", 2.0, 4.0, "oh")]


def test_moves_that_widen_a_window_are_held_back(spark):
    notes = spark.createDataFrame([(1, 1, 0.0, 1.0, 60), (1, 2, 1.0, 2.0, 62), (1, 3, 5.0, 6.0, 60)], "track_id long, note_id long, start double, end double, p int")
    off = spark.createDataFrame([(1, 1, 1200.0), (1, 3, 1200.0)], "track_id long, note_id long, cents double")
    guard = spark.createDataFrame([(1, 0.0, 2.0), (1, 5.0, 5.2)], "track_id long, start double, end double")
    none = off.where("false")
    pitches = lambda df: {r.note_id: r.p for r in df.collect()}
    assert pitches(metrics.shift_octaves_by_evidence(notes, off, none)) == {1: 72, 2: 62, 3: 72}
    assert pitches(metrics.shift_octaves_by_evidence(notes, off, none, guard=guard)) == {1: 60, 2: 62, 3: 72}
    assert {r.start: r.span for r in metrics.pitch_spans(guard, notes).collect()} == {0.0: 2, 5.0: 0}
