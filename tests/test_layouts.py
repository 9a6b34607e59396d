import math
import struct
import zlib
from collections import Counter

import numpy as np

from stavelake import functions as N
from stavelake import sources as S
from stavelake.operators import audio, geometry, meter, parts, scoring
from pyspark.sql import functions as F


def png(path, pixels):
    """A PNG of (height, width, 3) bytes."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_page_features(spark, tmp_path):
    staff = np.full((300, 90, 3), 255)
    for y in range(30, 80, 10):
        staff[y] = 0
    photo = np.full((300, 90, 3), 255)
    photo[:, :, 0] = 10
    png(tmp_path / "staff.png", staff)
    png(tmp_path / "photo.png", photo)
    png(tmp_path / "blank.png", np.full((300, 90, 3), 255))
    got = {r.origin.rsplit("/", 1)[-1]: r for r in geometry.page_gate(geometry.page_features(S.read_page_images(spark, str(tmp_path)))).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"staff.png": "music", "photo.png": "photo", "blank.png": "other"}
    assert got["staff.png"].bands == 5 and math.isclose(got["staff.png"].ink, 5 / 300) and got["staff.png"].shares[4] == 0 and math.isclose(got["staff.png"].shares[0], 0.05)


def test_lines_merge_and_slivers_go(spark):
    rows = [(1, 10.0, 0, 100, 2), (1, 12.0, 130, 400, 2), (1, 12.0, 900, 950, 2), (1, 30.0, 0, 400, 2), (2, 5.0, 0, 10, 1)]
    lines = spark.createDataFrame(rows, "page int, y double, x0 int, x1 int, th int")
    got = Counter((r.page, r.y, r.x0, r.x1, r.n) for r in geometry.merge_collinear(lines).collect())
    assert got == Counter([(1, 11.0, 0, 400, 2), (1, 12.0, 900, 950, 1), (1, 30.0, 0, 400, 1), (2, 5.0, 0, 10, 1)])
    spacing = spark.createDataFrame([(1, 20.0)], "page int, spacing double")
    assert sorted((r.page, r.y, r.x1) for r in geometry.drop_slivers(lines, spacing).collect()) == [(1, 12.0, 400), (1, 30.0, 400), (2, 5.0, 10)]
    assert geometry.merge_collinear(lines.where("false")).count() == 0


def brute_heads(a, b, tol):
    free, out = sorted(b), []
    for x, y in sorted(a):
        near = [f for f in free if abs(f[0] - x) <= tol]
        if near:
            best = min(near, key=lambda f: (abs(f[0] - x), free.index(f)))
            free.remove(best)
            out.append((x, y, *best))
    return out


def test_noteheads_against_brute_force(spark):
    rng = np.random.default_rng(4)
    a = [(k, float(x), int(y)) for k in range(4) for x, y in zip(rng.random(30), rng.integers(0, 9, 30))]
    b = [(k, float(x), int(y)) for k in range(1, 5) for x, y in zip(rng.random(40), rng.integers(0, 9, 40))]
    frame = lambda rows: spark.createDataFrame(rows, "k int, x double, y int")
    got = Counter(map(tuple, geometry.match_noteheads(frame(a), frame(b), ["k"]).collect()))
    want = Counter((k, *m) for k in range(5) for m in brute_heads([(x, y) for q, x, y in a if q == k], [(x, y) for q, x, y in b if q == k], 0.02))
    assert got == want
    one = frame([(1, 0.5, 3), (1, 0.9, 4)])
    moved = geometry.displacements(geometry.match_noteheads(one, one.withColumn("y", F.col("y") + 7), ["k"]), ["k"]).collect()
    assert [(r.moved, r.n, r.x_shift) for r in moved] == [(7, 2, 0.0)]


def test_lonely_staves_join_a_larger_system(spark):
    sizes = {1: [1, 2, 1, 1, 3, 1], 2: [1, 1], 3: [2, 2]}
    df = spark.createDataFrame([(p, i + 1, n) for p, s in sizes.items() for i, n in enumerate(s)], "page int, system int, n_staves int")
    got = {(r.page, r.system): r.target for r in geometry.attach_lonely(df).collect()}
    assert [got[1, i] for i in range(1, 7)] == [2, 2, 2, 5, 5, 5] and [got[2, i] for i in (1, 2)] == [1, 2] and [got[3, i] for i in (1, 2)] == [1, 2]


def test_tones_and_noise():
    at = np.arange(2048) / 8000
    for hz in (82.4, 220.0, 440.0, 987.8):
        found, clarity = audio.tone(np.sin(2 * np.pi * hz * at), 8000, 65, 1400, 0.9, 0.01)
        assert abs(found - hz) < hz * 0.005 and clarity > 0.9
    assert audio.tone(np.zeros(2048), 8000, 65, 1400, 0.9, 0.01) == (None, 0.0)
    assert audio.tone(np.zeros(0), 8000, 65, 1400, 0.9, 0.01) == (None, 0.0)


def test_frame_notes_absorb_one_gap(spark):
    track = [60, 60, None, 60, 60, None, 60, 60, 60, None, None, None, 62, 62]
    df = spark.createDataFrame([(1, i, m, 440.0, 1.0) for i, m in enumerate(track)], "doc_id int, frame long, midi int, hz double, clarity double")
    got = sorted((r.midi, r.start, r.stop, r.frames) for r in audio.frame_notes(df).collect())
    assert got == [(60, 0, 4, 4), (60, 6, 8, 3)]
    gates = spark.createDataFrame([(1, 0.01), (2, 0.02)], "doc_id int, gate double")
    assert {r.doc_id: r.notes and len(r.notes) for r in audio.melody_records(audio.frame_notes(df), gates).collect()} == {1: 2, 2: None}


def test_written_lengths(spark):
    df = spark.createDataFrame([(24,), (18,), (45,), (15,), (8,), (144,), (200,), (0,), (None,)], "t int")
    got = {r.t: r.w for r in df.select("t", N.written_ratio("t").alias("w")).collect()}
    assert (got[24].type, got[24].dots, got[24].actual, got[24].normal) == ("quarter", 0, 1, 1) and got[0] is None and got[None] is None
    assert (got[45].type, got[45].dots, got[45].actual, got[45].normal) == ("quarter", 1, 4, 5)
    pieces = {r.t: r.p for r in df.select("t", N.split_plain("t").alias("p")).collect()}
    assert pieces[144] == [144] and pieces[0] == [] and sum(pieces[200]) <= 200 and pieces[200][0] == 192


def test_trimmed_voice(spark):
    rows = [(1, 0, 24, 60), (2, 0, 24, 64), (3, 12, 24, 62), (4, 30, 4, 65), (5, 90, 24, 67), (6, 96, 6, 69)]
    notes = spark.createDataFrame([(e, 1, 1, 1, 1, o, d, False, m) for e, o, d, m in rows], "event_id long, page int, staff int, voice int, measure int, onset int, dur int, is_rest boolean, midi int")
    bars = spark.createDataFrame([(1, 1, 4, 4)], "page int, measure int, beats int, beat_type int")
    got = sorted((r.event_id, r.onset, r.dur, r.touched) for r in meter.trim_overlaps(notes, bars).collect())
    assert got == [(1, 0, 24, 0), (2, 0, 24, 0), (3, 24, 12, 1), (5, 90, 6, 1)]
    assert tuple(meter.trim_losses(notes, bars).first()) == (1, 2, 2)
    assert meter.trim_overlaps(notes.where("false"), bars).count() == 0


def test_scored_notes(spark):
    schema = "k int, t int, midi int, letter string, dur int, is_rest boolean"
    truth = spark.createDataFrame([(1, 0, 60, "C", 24, False), (1, 1, 62, "D", 24, False), (1, 2, 64, "E", 24, False), (1, 3, None, None, 24, True), (1, 4, 65, "F", 12, False), (2, 0, 60, "C", 24, False)], schema)
    pred = spark.createDataFrame([(1, 0, 60, "C", 24, False), (1, 1, 62, "D", 12, False), (1, 2, 63, "E", 24, False), (1, 3, None, None, 24, True), (1, 4, 70, "A", 24, False), (3, 0, 61, "C", 24, False)], schema)
    got = {r.k: r.asDict() for r in scoring.score_notes(truth, pred, ["k"], ["t"]).collect()}
    assert {c: got[1][c] for c in ("truth_notes", "pred_notes", "exact", "duration_wrong", "pitch_wrong", "both_wrong", "letter_only")} == {"truth_notes": 4, "pred_notes": 4, "exact": 1, "duration_wrong": 1, "pitch_wrong": 1, "both_wrong": 1, "letter_only": 1}
    assert (got[2]["missed"], got[2]["spurious"], got[3]["missed"], got[3]["spurious"]) == (1, 0, 0, 1)


def test_braces(spark):
    schema = "page int, system int, staff int, brace int, sign string, line int"
    staves = spark.createDataFrame([(1, 1, 1, None, "G", 2), (1, 1, 2, 7, "G", 2), (1, 1, 3, 7, "F", 4), (1, 2, 1, None, "G", 2), (1, 2, 2, None, "G", 2), (1, 2, 3, None, "F", 4), (2, 1, 1, 5, "G", 2), (2, 1, 2, None, "G", 2), (2, 1, 3, 5, "F", 4)], schema)
    got = {(r.page, r.system, r["first"]): (r.size, r.braced, r.ordinal, r["rank"], r.contiguous) for r in parts.brace_groups(staves).collect()}
    assert got[1, 1, 1] == (1, 0, 0, 0, 1) and got[1, 1, 2] == (2, 1, 0, 1, 1) and got[2, 1, 1][4] == 0
    mended = {(r.system, r.staff): r.brace for r in parts.brace_fallback(staves.where("page = 1")).collect()}
    assert mended == {(1, 1): None, (1, 2): 7, (1, 3): 7, (2, 1): None, (2, 2): 1, (2, 3): 1}
    paired = {(r.system, r.staff): r.brace for r in parts.clef_pairs(staves.where("page = 1")).collect()}
    assert paired == {(s, t): (2 if t > 1 else None) for s in (1, 2) for t in (1, 2, 3)}
    order = [(r.name, r.place) for r in parts.part_order(parts.brace_fallback(staves.where("page = 1"))).orderBy("place").collect()]
    assert order == [("Voice", 0), ("Piano", 1)]


def test_levels_and_tones_of_many_frames_at_once(spark):
    wave = lambda hz, size, rate=8000: (0.5 * np.sin(2 * np.pi * hz * np.arange(size) / rate)).tolist()
    rows = [
        (1, 0, 0.0, 8000, wave(440, 512)), (1, 1, 0.1, 8000, wave(220, 512)), (1, 2, 0.2, 8000, []), (1, 3, 0.3, 8000, None), (1, 4, 0.4, 8000, [0.0] * 512), (1, 5, 0.5, 16000, wave(440, 1024, 16000)),
        (1, 6, 0.6, 8000, [3.0, None, -4.0]), (1, 7, 0.7, 8000, [None]), (1, 8, 0.8, 8000, [3.0, -4.0]), (1, 9, 0.9, 8000, [float("nan"), 1.0]), (1, 10, 1.0, 8000, wave(330, 255)),
    ]
    df = spark.createDataFrame(rows, "doc_id int, frame int, t double, rate int, samples array<double>").coalesce(1)
    level = audio.signal_level(df)
    got = {r.frame: (r.peak, r.rms) for r in level.collect()}
    assert got[2] == got[3] == got[7] == (None, None) and got[4] == (0.0, 0.0) and got[6] == (4.0, None) and got[8] == (4.0, 12.5**0.5) and np.isnan(got[9]).all()
    assert abs(got[0][1] - 0.125**0.5) < 0.01
    assert {r.frame: r.midi for r in audio.frame_pitch(df).collect()} == {0: 69, 1: 57, 5: 69} | dict.fromkeys([2, 3, 4, 6, 7, 8, 9, 10])
    # a sample is a step of a lambda no longer, in the operator or in what the queries read
    assert "aggregate(" not in level._jdf.queryExecution().executedPlan().toString()


def test_waves_are_made_once_for_each_pitch(spark, sf):
    from stavelake.plans import layouts, views

    frames = layouts.tones(views.view(spark, sf, "notes_v"))
    plan = frames._jdf.queryExecution().optimizedPlan().toString()
    made = [line.lstrip(" :+-") for line in plan.splitlines() if "lambdafunction" in line]
    assert len(made) == 1 and made[0].startswith("Aggregate [")  # by group, not by frame
    assert frames.count() == 1000 and frames.select("samples").distinct().count() <= 37
