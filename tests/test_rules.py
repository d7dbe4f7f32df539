"""The sequential rules, alignment, packing and text functions on small cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import align, cleanup, document, folds, packing, refine, segments, techniques
from chronoloom.sources import midi, signals


def test_fragments_fold_or_drop():
    assert folds.drop_fragments([(1.0, 1.5, 60), (1.52, 1.57, 60)], 0.1) == [(1.0, 1.57, 60)]
    assert folds.drop_fragments([(1.0, 1.5, 60), (1.7, 1.75, 60)], 0.1) == [(1.0, 1.5, 60)]
    assert folds.drop_fragments([(1.0, 1.5, 60), (1.52, 1.57, 64)], 0.1) == [(1.0, 1.5, 60)]


def test_wiggle_modes(spark):
    n = [(i * 0.2, i * 0.2 + 0.2, p) for i, p in enumerate([60, 62, 60, 62, 60])]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(n)], "track_id long, note_id long, start double, end double, pitch int")
    pitches = lambda mode: [r.pitch for r in segments.absorb_wiggles(df, mode).orderBy("start").collect()]
    assert pitches("cascade") == [60] * 5
    assert pitches("static") == [60, 60, 62, 60, 60]
    assert pitches("noalt") == pitches("off") == [60, 62, 60, 62, 60]
    with pytest.raises(ValueError):
        segments.absorb_wiggles(df, "x")


def test_runs_settle():
    assert folds.settle_runs([(60, 0, 10), (61, 10, 12), (60, 12, 22)], 8, 5) == [(60, 0, 22)]
    assert folds.settle_runs([(60, 0, 10), (-1, 10, 12), (60, 12, 22)], 8, 5) == [(60, 0, 22)]
    assert folds.settle_runs([(60, 0, 10), (62, 10, 20)], 8, 5) == [(60, 0, 10), (62, 10, 20)]
    assert folds.settle_runs([(-1, 0, 5), (60, 5, 7), (-1, 7, 12)], 8, 5) == [(-1, 0, 12)]


def test_local_octaves():
    n = [(i, i + 1, p) for i, p in enumerate([63, 64, 63, 51, 63, 64])]
    assert [p for _, _, p in folds.raise_local_octaves(n)] == [63, 64, 63, 63, 63, 64]
    assert folds.raise_local_octaves(n[:2]) == n[:2]


def test_scoops_splits_cuts_and_clusters():
    assert folds.merge_scoops([(1.02, 1.21, 65, 0), (1.21, 1.79, 67, 0)]) == [(1.02, 1.79, 67, 0)]
    falling = [(1.02, 1.21, 69, 0), (1.21, 1.79, 67, 0)]
    assert folds.merge_scoops(falling) == falling
    assert folds.split_at([(0, 1, 60)], [0.05, 0.5, 0.55, 0.95]) == [(0, 0.5, 60), (0.5, 1, 60)]
    t = np.arange(0, 40, 0.1)
    level = np.where(np.abs(t - 20) < 0.05, -60.0, -10.0)
    cuts = folds.cut_long([(0.0, 40.0)], t, level, 28.0)
    assert cuts[0][0] == 0 and math.isclose(cuts[0][1], 20.0, abs_tol=0.1) and cuts[-1][1] == 40.0
    assert folds.cluster_onsets([(0, 1, 60), (0.05, 1, 64), (0.09, 2, 62), (0.12, 1, 70)], 0.1) == [(0.05, 1, 64), (0.12, 1, 70)]


def test_tail_end():
    t = np.arange(0, 3, 0.1)
    on = [x < 1.6 for x in t]
    assert math.isclose(folds.tail_end(1.0, None, t, on, 0.1), 1.6, abs_tol=0.11)
    assert math.isclose(folds.tail_end(1.0, 1.25, t, on, 0.1), 1.13)
    assert folds.tail_end(1.0, None, t, [False] * 30, 0.1) == 1.0


def test_allocation():
    spans, last = align.allocate_greedy([(1.0, 2.0)], [1.0, 1.2, 1.4])
    assert last == 0 and np.allclose(spans, [(1, 4 / 3), (4 / 3, 5 / 3), (5 / 3, 2)])
    assert align.allocate_best([(10.0, 10.2), (10.2, 10.5), (10.8, 11.0)], [10.0, 10.8]) == ([(10.0, 10.5), (10.8, 11.0)], 2)
    assert align.allocate_greedy([], [1.0]) == ([(1.0, 1.0)], -1)
    assert align.allocate_greedy([(0.0, 0.5), (1.0, 3.0), (2.0, 3.0)], [0.9, 2.0])[0] == [(1.0, 2.0), (2.0, 3.0)]


def test_partition_and_warp():
    notes = [(0, 0.3, 60), (0.3, 0.6, 67), (0.6, 1.0, 69)]
    assert align.partition_notes(notes, 2) == [0, 1, 1]
    assert align.partition_notes(notes, 5) == [0, 1, 2] and align.partition_notes(notes, 1) == [0, 0, 0]
    x = np.eye(4)
    assert align.warp_path(x, np.repeat(x, 2, axis=0))[-1] == (3, 7)
    assert align.frame_map([(0, 0), (0, 1), (2, 4)], 3).tolist() == [0.5, 2.25, 4.0]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_edit_alignment_is_optimal_and_monotone(a, b):
    pairs = align.edit_alignment(a, b)
    cost = sum(i is None or j is None or a[i] != b[j] for i, j in pairs)

    def slow(i, j):
        return max(i, j) if not i or not j else min(slow(i - 1, j - 1) + (a[i - 1] != b[j - 1]), slow(i - 1, j) + 1, slow(i, j - 1) + 1)

    assert cost == slow(len(a), len(b)) if len(a) + len(b) < 12 else cost == align.edit_table(a, b)[-1, -1]
    assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_packing():
    assert packing.next_fit([7, 7, 7], 16) == [0, 0, 1] and packing.next_fit([99, 1], 16) == [0, 1]
    starts, ends = [0, 1, 2, 3.2], [1, 2, 3, 4]
    width = len
    assert packing.split_oversized(range(4), width, 2, starts, ends, [0, 0, 1, 1]) == [[0, 1], [2, 3]]
    assert packing.split_oversized(range(4), width, 3, starts, ends, [0] * 4) == [[0, 1, 2], [3]]
    assert packing.place_marks([1.0, 1.05, 1.02], 0.1) == pytest.approx([1.0, 1.15, 1.32])
    notes = [(1.0, 1.5, 60), (1.6, 2.0, 62), (20.0, 21.0, 64)]
    bars, anchors = packing.layout([[[0, 1]], [[2]]], notes, [0.5, 0.5, 1.0], 8.0, 1.0, 0.05, 0.2, 0.5)
    assert len(bars) == 3 and bars[2][0] == 9.0
    assert all(b[0] > a[0] and b[1] > a[1] for a, b in zip(anchors, anchors[1:], strict=False))


def curve_of(*parts, hop=0.01):
    m = np.concatenate([np.full(n, np.nan if p is None else p, dtype=float) for p, n in parts])
    return refine.Curve(np.arange(len(m)) * hop, m)


def test_curve_corrections():
    f = curve_of((60, 30), (67, 50))
    moved = refine.refine_joints([(0.0, 0.4, 60), (0.4, 0.8, 67)], f)
    assert moved[0][1] == pytest.approx(0.30, abs=0.02) and moved[1][0] == moved[0][1]
    same = [(0.0, 0.4, 60), (0.4, 0.8, 61)]
    assert refine.refine_joints(same, curve_of((60, 80))) == same
    filled = refine.fill_missing([(0.45, 0.50, 60)], [(0.30, 0.70)], curve_of((62, 80)))
    assert (0.5, 0.70, 62) in filled
    assert refine.fill_missing([], [(0.30, 0.70)], curve_of((None, 80))) == []
    assert refine.extend_held([(0.0, 0.4, 60)], curve_of((60, 70), (None, 30)))[0][1] == pytest.approx(0.70, abs=0.011)
    assert refine.extend_held([(0.0, 0.4, 60), (0.5, 0.6, 60)], curve_of((60, 70)))[0][1] == 0.5
    got = refine.capture_falls([(0.0, 0.4, 60)], curve_of((60, 40), (58, 40), (None, 20)))
    assert got[1][2] == 58 and got[1][0] == pytest.approx(0.4)
    assert refine.snap_to_classes([(0.0, 0.4, 60)], curve_of((60.4, 40)), [1.0, 2.0] + [1.0] * 10) == [(0.0, 0.4, 61)]
    assert refine.choose_pitch(curve_of((60, 15), (65, 25), (60, 15)), 0, 0.55, "plateau", edge=0) == 65
    assert refine.choose_pitch(curve_of((60, 15), (65, 25), (60, 15)), 0, 0.55, "mode", edge=0) == 60
    assert refine.choose_pitch(curve_of((None, 50)), 0, 0.5) is None
    assert refine.reentry_start(1.0, curve_of((None, 70), (60, 60))) == pytest.approx(0.7)


def test_techniques():
    t = np.arange(0, 2, 0.01)
    wave = 60 + 0.3 * np.sin(2 * np.pi * 6 * t)
    kinds = [e[0] for e in techniques.detect(wave, 0.01, [(0.0, 2.0, 60)])]
    assert "vibrato" in kinds and "fall" not in kinds
    fall = np.concatenate([np.full(60, 60.0), np.linspace(60, 56, 25), np.full(20, np.nan)])
    assert [e[0] for e in techniques.detect(fall, 0.01, [(0.0, 0.85, 60)])] == ["fall"]
    scoop = np.concatenate([np.full(20, np.nan), np.full(6, 58.5), np.linspace(58.5, 60, 10), np.full(60, 60.0)])
    assert "shakuri" in [e[0] for e in techniques.detect(scoop, 0.01, [(0.2, 0.96, 60)])]
    assert techniques.detect(np.full(100, 60.0), 0.01, [(0.0, 1.0, 60)]) == [] and techniques.detect(wave, 0.01, []) == []


SUNG = "track_id long, note_id long, start double, end double, pitch int"


def sung(spark, rows, *extra):
    """Notes of one track; ``extra`` are (name, type, value for all)."""
    df = spark.createDataFrame([(1, i, *map(float, r[:2]), r[2]) for i, r in enumerate(rows)], SUNG)
    for name, kind, value in extra:
        df = df.withColumn(name, F.lit(value).cast(kind))
    return df


def listed(df):
    return sorted((r.start, r.end, r.pitch) for r in df.collect())


def test_onsets_fold_and_isolated_notes_go(spark):
    frames = spark.createDataFrame([(1, i * 0.01, 60.0 if i < 5 else 62.0) for i in range(50)], "track_id long, t double, midi double")
    lines = spark.createDataFrame([(1, 0.0, 1.0)], "track_id long, start double, end double")
    got = refine.fold_onsets(sung(spark, [(0, 0.1, 60), (0.1, 0.5, 62)]), frames, lines)
    assert listed(got) == [(0.0, 0.1, 62), (0.1, 0.5, 62)]
    assert listed(refine.fold_onsets(sung(spark, [(0, 0.1, 60), (0.1, 0.5, 62)]), frames, lines.where("false"))) == [(0.0, 0.1, 60), (0.1, 0.5, 62)]
    notes = sung(spark, [(0, 1, 60), (1.5, 2, 60), (9, 10, 60)])
    assert listed(refine.drop_isolated(notes, lines)) == [(0.0, 1.0, 60), (1.5, 2.0, 60)]
    assert listed(refine.drop_isolated(notes, lines.where("false"))) == []


def voice(spark, first, second=None, db=0.0, n=3000):
    rows = [(1, i * 0.01, db, float(first), float(first if second is None else second)) for i in range(n)]
    return spark.createDataFrame(rows, "track_id long, t double, db double, first double, second double")


def test_cleanup_rules(spark):
    slots = [cleanup.Slot(1.0, 2.0, 0), cleanup.Slot(2.0, 3.0, 1)]
    assert cleanup.assign_moras([(1.1, 1.5, 60), (2.1, 2.9, 62), (3.1, 3.2, 60), (9, 10, 60)], slots) == [0, 1, 1, -1]
    in_mora = [("mora", "int", 0), ("slot_start", "double", 1.0), ("slot_end", "double", 2.0), ("support", "double", 1.0), ("level", "double", 0.0)]
    one = lambda rows, supported=False: listed(cleanup.one_pitch_each(sung(spark, rows, *in_mora), supported))
    assert one([(1.0, 1.6, 60), (1.62, 1.9, 62)]) == [(1.0, 1.9, 60)]
    assert one([(1.0, 1.6, 60), (1.62, 1.9, 66)]) == [(1.0, 1.6, 60), (1.62, 1.9, 66)]
    assert one([(1.0, 1.9, 60), (1.95, 2.9, 62)]) == [(1.0, 1.9, 60)]
    assert one([(1.0, 1.1, 61), (1.15, 1.2, 61), (1.25, 1.8, 60), (1.85, 1.95, 59), (1.99, 2.0, 60)], True) == [(1.0, 1.1, 61), (1.15, 2.0, 60)]
    low = [(i * 1.0, i + 0.9, 60) for i in range(20)]
    high = sung(spark, [*low, (25, 25.5, 84)])
    assert (25.0, 25.5, 72) in listed(cleanup.lower_octaves(cleanup.evidence_of(high, voice(spark, 84, 72), 0.01)))
    assert (25.0, 25.5, 84) in listed(cleanup.lower_octaves(cleanup.evidence_of(high, voice(spark, 84), 0.01)))
    weak = [("mora", "int", -1), ("support", "double", 1.0), ("level", "double", 0.0)]
    assert listed(cleanup.drop_phantoms(sung(spark, [(9, 9.5, 60)], *weak))) == []
    known = cleanup.evidence_of(sung(spark, [(1, 1.5, 60), (1.5, 1.9, 70)]), voice(spark, 60), 0.01).withColumn("mora", F.lit(0))
    assert listed(cleanup.real_melismas(known)) == [(1.0, 1.5, 60)]
    table = spark.createDataFrame([(1, *s) for s in slots], "track_id long, start double, end double, char int")
    assert listed(cleanup.clean(sung(spark, [(1, 1.9, 60), (9, 9.5, 50)]), table, voice(spark, 60))) == [(1.0, 1.9, 60)]
    assert listed(cleanup.clean(sung(spark, [(1, 1.9, 60), (9, 9.5, 50)]), table, None)) == [(1.0, 1.9, 60), (9.0, 9.5, 50)]


def growing_span(notes, slot, supported):
    """Variants absorbed one after the other, for comparison."""
    weight = [((e - s), max(0.0, min(e, slot[1]) - max(s, slot[0]))) for s, e, _ in notes]
    main = max(range(len(notes)), key=lambda i: weight[i] if supported else weight[i][::-1])
    lo, hi, p = notes[main]
    out = []
    for i, (s, e, q) in enumerate(notes):
        if i == main or abs(q - p) > 3:
            out += [(s, e, q)] if i != main else []
        elif q != p and i > main and weight[i][1] / max(e - s, 1e-6) < 0.5:
            pass
        elif max(s - hi, lo - e, 0.0) <= 0.12:
            lo, hi = min(lo, s), max(hi, e)
        else:
            out.append((s, e, q))
    return sorted([*out, (lo, hi, p)])


def test_windows_grow_spans_like_a_walk(spark):
    r = random.Random(6)
    cases = []
    for _ in range(150):
        notes = sorted({(round(s := r.uniform(0.5, 2.6), 2), round(s + r.uniform(0.02, 0.7), 2), 60 + r.randrange(6)) for _ in range(r.randrange(1, 8))})
        cases.append(notes)
    rows = [(k, i, *n, 0, 1.0, 2.0, 1.0, 0.0) for k, notes in enumerate(cases) for i, n in enumerate(notes)]
    df = spark.createDataFrame(rows, SUNG + ", mora int, slot_start double, slot_end double, support double, level double")
    for supported in (True, False):
        got = {}
        for x in cleanup.one_pitch_each(df, supported).collect():
            got.setdefault(x.track_id, []).append((x.start, x.end, x.pitch))
        assert {k: sorted(v) for k, v in got.items()} == {k: growing_span(notes, (1.0, 2.0), supported) for k, notes in enumerate(cases)}


def test_patches():
    notes = [(52.0, 52.3, 63), (53.0, 54.0, 60)]
    assert cleanup.patch_pitches(notes, [{"at": 52.1, "from": 63, "pitch": 51}])[0][0] == (52.0, 52.3, 51)
    assert cleanup.patch_pitches(notes, [{"at": 52.4, "pitch": 51, "start": 52.36, "end": 52.54}])[0][1] == (52.36, 52.54, 51)
    assert cleanup.patch_pitches(notes, [{"at": 52.1, "from": 1, "pitch": 51}])[1] == [52.1]
    assert cleanup.patch_pitches(notes, [{"melisma_split": [1, 2]}]) == (notes, [])
    assert cleanup.replace_inside(notes, 52, 52.3, [(52.0, 52.1, 1), (52.1, 52.3, 2)])[:2] == [(52.0, 52.1, 1), (52.1, 52.3, 2)]
    assert cleanup.drop_onsets(notes, [(53.0, 53.0)]) == notes[:1]
    with pytest.raises(ValueError):
        cleanup.recut([("a", 1.0, 2.0)], 1.2, [])
    assert cleanup.retime([("a", 1.0, 2.0)], 0, 2, (10, 12)) == [("a", 10.0, 12.0)]


def test_text_functions():
    for romaji, kana in [("tokyo", "ときょ"), ("kitte", "きって"), ("shin'ya", "しんや"), ("ganbatte", "がんばって"), ("chotto", "ちょっと"), ("tsuki", "つき"), ("fuji", "ふじ"), ("disuko", "でぃすこ"), ("x!", ""), ("konnichiha", "こんにちは"), ("hon wo", "ほを"), ("hon", "ほん"), ("san-ji", "さじ"), ("konna", "こんな")]:
        assert X.romaji_to_kana(romaji) == kana
    assert X.furigana("待ち続け", "まちつづけ") == [("待", "ま", 0, 1), ("ち", None, 1, 2), ("続", "つづ", 2, 3), ("け", None, 3, 4)]
    assert X.furigana("青い", "ブルー") == [("青い", "ブルー", 0, 2)] and X.furigana("青", None) == [("青", None, 0, 1)]
    assert X.is_odd_token("abc!") and not X.is_odd_token("カ")


def test_normal_kana(spark):
    texts = ["カード abc ガッー", "ーきーーょー", "んーヴー", "ラーーメン", "", None, "ゔーa"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    assert [r[0] for r in df.select(X.normal_kana(F.col("s"))).collect()] == ["かあどがっう", "きいいょお", "んんゔあ", "らああめん", "", None, "ゔあ"]


def test_chunks_settle():
    tok = lambda c, s, n, pos="noun", punct=False: (c, s, s + 0.5, n, pos, punct)
    assert document.settle_chunks([tok(0, 0, 5), tok(1, 1, 1, "particle"), tok(1, 2, 5)]) == [0, 0, 1]
    assert document.settle_chunks([tok(0, 0, 5), tok(1, 1.0, 2), tok(2, 9, 5)]) == [0, 0, 1]
    assert document.settle_chunks([tok(0, 0, 5)]) == [0]


def test_midi_round_trip_and_tempo():
    notes = [(0.0, 1.0, 60), (0.5, 1.5, 62), (1.5, 1.5, 60)]
    per_beat, events = midi.parse(midi.write(notes, markers=[(0.2, "P01")]))
    assert per_beat == 480 and [e[8] for e in events if e[2:4][1] == "marker"] == ["P01"]
    rows = [(e[2], e[3], e[4], e[5], e[7]) for e in events]
    got = midi._pair(rows, per_beat, "fifo")
    assert [(round(s, 3), p) for s, _, p, _ in got] == [(0.0, 60), (0.5, 62), (1.5, 60)]
    two = [(0, "note_on", 0, 60, None), (480, "set_tempo", None, None, 1_000_000), (960, "note_off", 0, 60, None)]
    assert midi._pair(two, 480, "fifo")[0][1] == pytest.approx(1.5)
    assert midi._pair(two, 480, "last_tempo")[0][1] == pytest.approx(2.0)
    again = [(0, "note_on", 0, 60, None), (480, "note_on", 0, 60, None), (960, "note_off", 0, 60, None), (1440, "note_off", 0, 60, None)]
    assert len(midi._pair(again, 480, "fifo")) == 2 and len(midi._pair(again, 480, "last_tempo")) == 1
    with pytest.raises(ValueError):
        midi.parse(b"xxxx" + b"\0" * 20)


def test_wav_and_npz():
    import io
    import struct

    y = (np.sin(np.arange(400)) * 20000).astype("<i2")
    body = np.stack([y, y], axis=1).tobytes()
    wav = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16) + b"data" + struct.pack("<I", len(body)) + body
    rate, x = signals.parse_wav(wav)
    assert rate == 16000 and len(x) == 400 and np.allclose(x * 32768, y)
    assert signals.parse_wav(b"nope") is None
    out = io.BytesIO()
    np.savez(out, f0=np.array([0.0, 440.0]), hop_seconds=0.01)
    t, f0 = signals.parse_f0(out.getvalue())
    assert t.tolist() == [0.0, 0.01] and f0[1] == 440
    out = io.BytesIO()
    np.savez(out, f0=np.zeros(2), times=np.zeros(3))
    with pytest.raises(ValueError):
        signals.parse_f0(out.getvalue())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=12), st.integers(0, 30), st.integers(1, 40))
def test_free_parts_are_the_complement(taken, start, length):
    spans = [(a, a + n) for a, n in taken]
    free = refine.free_parts(start, start + length, spans)
    for x in range(start, start + length):
        inside = any(a <= x < b for a, b in spans)
        assert inside != any(a <= x < b for a, b in free)


def test_weighted_median():
    assert folds.weighted_median([60, 62, 70], [1.0, 1.0, 5.0]) == 70 and folds.weighted_median([60, 64], [0, 0]) == 62
    random.seed(1)


def test_weak_notes_settle():
    steady = curve_of((60, 100), (62, 100))
    assert refine.settle_weak([(0, 0.5, 60), (0.5, 0.54, 65), (0.54, 1.0, 60)], steady) == [(0, 0.5, 60), (0.5, 0.54, 60), (0.54, 1.0, 60)]
    sure = [(0, 1.0, 60), (1.0, 2.0, 62)]
    assert refine.settle_weak(sure, steady) == sure
    assert refine.settle_weak([(0, 0.5, 60), (0.5, 0.52, 66), (0.52, 1.0, 64)], steady)[1][2] == 60
    assert [p for _, _, p in refine.settle_weak([(0, 0.5, 60), (0.5, 0.9, 70), (0.9, 1.0, 60)], steady)] == [60, 60, 60]


def test_ruby_lines():
    token = {"surface": "青い", "reading": "あおい", "kana_only": False, "start": 1.0, "end": 2.0, "chars": [("青", 1.0, 1.5), ("い", 1.5, 2.0)]}
    assert document.ruby_lines([[token]], 1) == "@Ruby1=青,あお,[00:01:00],[00:01:55]\n\n[00:01:00]青[00:01:50]い[00:02:00]\n\n"
    with pytest.raises(ValueError):
        document.ruby_lines([], 5)


def test_lines_take_notes_in_order():
    lines = [(0.0, 1.0, [0.0, 0.5]), (1.0, 2.0, [1.0])]
    notes = [(0.0, 0.4), (0.5, 0.9), (0.95, 1.2), (1.3, 2.0)]
    assert align.allocate_lines(lines, notes) == [[(0.0, 0.4), (0.5, 0.9)], [(0.95, 1.2)]]
    assert align.allocate_lines(lines, notes, first_delay=0.2)[1] == [(1.3, 2.0)]
    assert align.allocate_lines(lines, notes, absorb=True, next_guard=0.0)[0][-1] == (0.5, 1.2)
    assert align.allocate_lines([(9.0, 9.5, [9.1])], notes) == [[(9.1, 9.1)]]


def test_morae():
    assert X.morae("きょうがっこう") == ["きょ", "う", "が", "っ", "こ", "う"]
    got = X.expand_morae([{"surface": "今日", "reading": "きょう"}, {"surface": "、", "is_punct": True}, {"surface": "食べる", "reading": "たべる"}])
    assert got == [("きょ", 0, 0), ("う", 0, 1), ("た", 2, 0), ("べ", 2, 1), ("る", 2, 2)]


def test_bars_tokens_and_cursor():
    bars = [(0.0, 1.0), (1.0, 2.0), (3.0, 4.0)]
    assert techniques.bar_of("shakuri", 0.95, bars) == 1 and techniques.bar_of("fall", 0.95, bars) == 1
    assert techniques.bar_of("kobushi", 2.2, bars) == 1 and techniques.bar_of("vibrato", 3.5, bars) == 2 and techniques.bar_of("shakuri", 9, bars) == 2
    words = {"君のため": [("君", "くん", "接尾辞"), ("の", "の", "助詞"), ("ため", "ため", "名詞")], "君": [("君", "きみ", "代名詞")], "僕君": [("僕", "ぼく", "代名詞"), ("君", "くん", "接尾辞")]}
    tagger = lambda s: [{"surface": a, "reading": b, "pos": c} for a, b, c in words[s]]
    assert [t["reading"] for t in X.read_tokens("君のため　僕君", tagger)] == ["きみ", "の", "ため", "ぼく", "くん"]
    assert X.read_tokens("君のため", tagger, {"君": "キミ"})[0]["reading"] == "キミ"
    assert midi.cursor_ticks([(0.0, 0.5, 60.4), (0.5, 1.0, 0), (0.5, 0.5, 61)]) == [(0, 479, 60), (1, 1, 61)]


def test_kana_units():
    units = X.kana_units([{"surface": "今日", "reading": "キョウ"}, {"surface": "　は", "reading": None}])
    assert units == [("き", 0, 2), ("ょ", 0, 2), ("う", 0, 2), ("は", 2, 3)]
    timed = X.timed_kana(units, [(0.0, 1.0), (1.0, 3.0), (3.0, 4.0)])
    assert timed == [("き", 0.0, 1.0), ("ょ", 1.0, 2.0), ("う", 2.0, 3.0), ("は", 3.0, 4.0)]


def test_aligner_words():
    assert X.aligner_words(list("きょうは")) == (["kyo", "u", "ha"], [[0, 1], [2], [3], [4, 5]])
    assert X.aligner_words(list("がっこう")) == (["ga", "kko", "u"], [[0, 1], [2], [3, 4], [5]])
    assert X.aligner_words(list("カード")) == (["ka", "a", "do"], [[0, 1], [2], [3, 4]])
    assert X.aligner_words(list("あゃ"))[0] == ["a", "ya"] and X.aligner_words(list("ゅ"))[0] == ["yu"]
    assert X.aligner_words(list("OKっ")) == (["ok"], [[0], [1], []])
    assert X.aligner_words(["し", "ゅ", "ふ", "ぁ", "つ"])[0] == ["shu", "fa", "tsu"]
