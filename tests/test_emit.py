from collections import Counter

from stavelake import sources as S
from stavelake.operators import emit, validate

NOTE = "doc_id string, part_idx int, staff int, voice int, measure int, onset int, dur int, is_rest boolean, midi int, step string, alter int, octave int, event_id long"
METER = "doc_id string, measure int, beats int, beat_type int"


def documents(spark, rows, meters):
    return emit.score_documents(spark.createDataFrame(rows, NOTE), spark.createDataFrame(meters, METER))


def test_documents_read_back_clean(spark):
    rows = [
        ("a", 0, 1, 1, 1, 24, 24, False, 61, "C", 1, 4, 1), ("a", 0, 1, 1, 1, 24, 24, False, 65, "F", None, 4, 2),  # a chord behind a beat of silence
        ("a", 0, 1, 1, 1, 36, 30, False, 67, "G", 0, 4, 3),  # starts inside the chord
        ("a", 0, 2, 1, 1, 0, 500, False, 40, "E", 0, 2, 4),  # goes beyond the bar
        ("a", 0, 1, 2, 1, 0, 8, False, 72, "C", 0, 5, 5), ("a", 0, 1, 2, 1, 0, 8, True, None, None, None, None, 6),  # a rest at the onset of a note
        ("a", 1, 1, 1, 3, 0, 72, False, 60, "C", 0, 4, 7),
        ("b.c/d", 0, 1, 1, 1, 0, 96, True, None, None, None, None, 8),
    ]
    texts = documents(spark, rows, [("a", 1, 4, 4), ("a", 2, 4, 4), ("a", 3, 3, 4), ("b.c/d", 1, 4, 4)]).cache()
    raw = S.shred_texts(texts).cache()
    assert validate.validate(raw).collect() == []
    assert {r.doc_id for r in raw.collect()} == {"a", "b.c/d"}
    notes = raw.where("tag = 'note' and not is_rest").collect()
    got = Counter((r.part_idx, r.staff, r.voice, r.measure_label, r.duration_raw, r.is_chord, r.step, r.alter_raw, r.type, r.tup_actual) for r in notes)
    assert got == Counter([
        (0, 1, 1, "1", 24, False, "C", "1", "quarter", None), (0, 1, 1, "1", 24, True, "F", None, "quarter", None), (0, 1, 1, "1", 18, False, "G", None, "eighth", None),
        (0, 2, 1, "1", 96, False, "E", None, "whole", None), (0, 1, 2, "1", 8, False, "C", None, "eighth", 3), (1, 1, 1, "3", 72, False, "C", None, "half", None),
    ])
    meters = raw.where("tag = 'attributes' and doc_id = 'a' and part_idx = 1").orderBy("measure_ord").collect()
    assert [(r.measure_label, r.beats, r.beat_type, r.staves) for r in meters] == [("1", 4, 4, 1), ("3", 3, 4, None)]
    clefs = raw.where("tag = 'attributes' and doc_id = 'a' and part_idx = 0 and measure_ord = 0").first().clefs
    assert [(c.staff, c.sign, c.line) for c in clefs] == [(1, "G", 2), (2, "G", 2)]


def test_documents_of_empty_tables(spark):
    assert documents(spark, [], []).count() == 0


def test_melody_in_bars(spark):
    rows = [("x", 1, 72, 60), ("x", 2, 48, 62), ("x", 3, 48, 64), ("x", 4, 200, 65), ("y", 1, 6, 50)]
    melody = spark.createDataFrame(rows, "doc string, place int, dur int, midi int")
    got = Counter(tuple(r) for r in emit.lay_out(melody, ["doc"], ["place"]).collect())
    assert got == Counter([
        ("x", 1, 0, 72, 60, False), ("x", 1, 72, 24, None, True), ("x", 2, 0, 48, 62, False), ("x", 2, 48, 48, 64, False), ("x", 3, 0, 96, 65, False),
        ("y", 1, 0, 6, 50, False), ("y", 1, 6, 90, None, True),
    ])
    assert emit.lay_out(melody.where("false"), ["doc"], ["place"]).count() == 0


def test_marks_names_and_keys_read_back(spark):
    n = lambda m, onset, midi, i, tie=None, slur=None, lyric=None, dur=24, rest=False: ("a", 0, 1, 1, m, onset, dur, rest, midi, "C", 0, 4, i, tie, slur, lyric)
    rows = [
        n(1, 0, 60, 1, "start", "start", "la"), n(1, 24, 60, 2, "both", None, "a < b & c"), n(1, 48, 60, 3, "stop", "stop", "  "), n(1, 72, 62, 4, "start", "stop"),  # nothing takes up the last tie, no slur is open
        n(2, 0, 60, 5, "stop"), n(2, 24, 64, 6, None, "start"), n(2, 48, None, 7, "start", "stop", "no", rest=True), n(3, 0, 65, 8, None, None, "di", 96),
    ]
    notes = spark.createDataFrame(rows, NOTE + ", tie string, slur string, lyric string")
    meters = spark.createDataFrame([("a", 1, 4, 4, None), ("a", 2, 4, 4, 2), ("a", 3, 4, 4, None)], METER + ", fifths int")
    names = spark.createDataFrame([("a", 0, " Voice & <flute> "), ("a", 0, "  "), ("z", 0, "x")], "doc_id string, part_idx int, name string")
    texts = emit.score_documents(notes, meters, names).cache()
    raw = S.shred_texts(texts).cache()
    assert validate.validate(raw).collect() == [] and validate.content_model(raw).collect() == []
    got = [(r.tie, r.slur) for r in raw.where("tag = 'note' and not is_rest").orderBy("measure_ord", "seq").collect()]
    assert got == [("start", "start"), ("stop", None), ("stop", "stop"), (None, None), (None, None), (None, None), (None, None)]
    text = texts.first().text
    assert text.count('<tied type="start"/>') == 2 == text.count('<tie type="stop"/>') and "<tie type=\"stop\"/><tie type=\"start\"/>" in text
    assert [text.count(f"<text>{x}</text>") for x in ("la", "a &lt; b &amp; c", "di")] == [1, 1, 1] and text.count("<lyric>") == 3
    assert {r.part_name for r in raw.where("tag = 'note'").collect()} == {"Voice & <flute>"}
    keys = raw.where("tag = 'attributes'").orderBy("measure_ord").collect()
    assert [(r.measure_label, r.fifths, r.beats) for r in keys] == [("1", 0, 4), ("2", 2, None)]


def test_a_rest_with_a_pitch_ends_no_tie(spark):
    n = lambda m, onset, i, tie, rest=False: ("a", 0, 1, 1, m, onset, 24, rest, 60, "C", 0, 4, i, tie, None, None)
    rows = [n(1, 0, 1, "start"), n(1, 24, 2, None, True), n(1, 48, 3, "both"), n(1, 72, 4, "stop", True), n(2, 0, 5, "stop")]
    notes = spark.createDataFrame(rows, NOTE + ", tie string, slur string, lyric string")
    text = emit.score_documents(notes, spark.createDataFrame([("a", 1, 4, 4), ("a", 2, 4, 4)], METER)).first().text
    assert text.count('<tied type="start"/>') == 2 == text.count('<tied type="stop"/>')


def test_shredded_columns_that_are_wanted(spark):
    rows = [("a", 0, 1, 1, 1, 0, 24, False, 61, "C", 1, 4, 1), ("b", 0, 1, 1, 1, 0, 96, True, None, None, None, None, 2)]
    texts = documents(spark, rows, [("a", 1, 4, 4), ("b", 1, 3, 4)]).unionAll(spark.createDataFrame([("c", "<x")], "doc_id string, text string")).cache()
    raw = S.shred_texts(texts).cache()
    for columns in ("doc_id, seq, tag, beats, clefs, error", "doc_id, seq, tag, children"):
        names = columns.split(", ")
        assert sorted(map(str, S.shred_texts(texts, columns).collect())) == sorted(map(str, raw.select(*names).collect())) and raw.count() > 4


def test_excerpt_reads_each_text_once(spark, sf):
    from stavelake.plans import emit as plans
    from stavelake.plans import views

    found = plans.excerpt_blocks(views.view(spark, sf, "notes_v"), views.view(spark, sf, "measures_v"))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
