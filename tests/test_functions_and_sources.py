import random
import struct
import time
import wave
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stavelake import functions as N
from stavelake import sources as S
from stavelake import streaming
from stavelake.operators import meter, normalise
from stavelake.operators.align import align, lcs_ops, short_way, table_ops

SCORE = """<score-partwise><part-list><score-part id="P1"><part-name>Voice</part-name></score-part></part-list><part id="P1">
<measure number="1"><attributes><divisions>2</divisions><time><beats>4</beats><beat-type>4</beat-type></time><clef><sign>G</sign><line>2</line></clef></attributes>
<note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration></note>
<note><chord/><pitch><step>A</step><octave>4</octave></pitch><duration>4</duration></note>
<backup><duration>4</duration></backup><note><rest/><duration>8</duration><voice>2</voice></note></measure><measure number="2"/></part></score-partwise>"""


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_pitch_functions(spark):
    texts = {"F#4": 66, "C": None, "Cb4": 59, "C##04": None, "H4": None, "C10": 132, "": None}
    got = one(spark, *[N.midi_from_text(F.lit(t)).alias(f"x{i}") for i, t in enumerate(texts)])
    assert list(got) == list(texts.values())
    names = {"f#4": 66, "c": 60, "Bb3": 58, "": 0}
    assert list(one(spark, *[N.midi_from_name(F.lit(t)).alias(f"x{i}") for i, t in enumerate(names)])) == list(names.values())
    got = one(spark, N.midi_name(F.lit(60.5)).alias("a"), N.pitch_name(F.lit("C"), F.lit(3), F.lit(4)).alias("b"), N.hz_to_midi(F.lit(440.0)).alias("c"), N.hz_to_midi_live(F.lit(50.0)).alias("d"), N.diatonic(F.lit("c"), F.lit(4)).alias("e"))
    assert tuple(got) == ("C4", "C?34", 69.0, None, 28)


def test_duration_functions(spark):
    got = one(spark, N.to_q(F.lit(3), F.lit(2)).alias("a"), N.to_q(F.lit(3), F.lit(11)).alias("b"), N.to_ticks(F.lit(None).cast("int"), F.lit(1), F.lit("eighth")).alias("c"), N.plain_floor(F.lit(2)).alias("d"), N.tuplet_type(F.lit(3), F.lit(2)).alias("e"), N.tuplet_type(F.lit(11), F.lit(8)).alias("f"), N.bar_length(F.lit(6), F.lit(8)).alias("g"))
    assert (got.a, got.b, got.c, tuple(got.e), got.f, got.g) == (15120, None, 12, ("eighth", False), None, 72)
    assert got.d is None or got.d <= 2


def test_keys(spark):
    labels = ["10", "X1", "2", "1"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    assert [r.x for r in df.orderBy(N.measure_key("x")).collect()] == ["1", "2", "10", "X1"]
    df = spark.createDataFrame([("s10",), ("s2",)], "x string")
    assert [r.x for r in df.orderBy(N.natural_key("x")).collect()] == ["s2", "s10"]


def test_scores_to_onsets(spark, tmp_path):
    (tmp_path / "p0001.xml").write_text(SCORE)
    (tmp_path / "bad.xml").write_text("<score")
    raw = S.read_scores(spark, str(tmp_path))
    assert raw.where("error is not null").count() == 1
    own = raw.where("error is null")
    assert own.count() == 5 and {r.part_name for r in own.collect()} == {"Voice"}
    events = own.where("tag <> 'attributes'").select("doc_id", F.col("measure_ord").alias("measure"), "seq", "tag", F.col("duration_raw").alias("dur"), F.coalesce("is_chord", F.lit(False)).alias("is_chord"))
    assert {r.seq: r.local for r in normalise.onsets_exact(events, ["doc_id"]).collect()} == {1: 0, 2: 0, 4: 0}


def test_small_readers(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"stem": "p1", "ok": true}\nbroken\n{"stem": "p2", "ok": false}\n')
    journal = S.read_journal(spark, str(tmp_path / "j.jsonl"))
    work = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "stem string")
    assert sorted(r.stem for r in S.pending(work, journal).collect()) == ["p2", "p3"]
    assert [r.stem for r in S.pending(work, journal, retry_failed=False).collect()] == ["p3"]
    (tmp_path / "log.txt").write_text("note F4 a b c d\nrest a b c d\ntoo few\n")
    assert Counter((r.symbol, r.pitch) for r in S.read_symbol_logs(spark, str(tmp_path / "log.txt")).collect()) == Counter([("note", "F4"), ("rest", None)])
    (tmp_path / "songs.json").write_text('[{"title": "A", "pages": [3, 1]}]')
    assert [(r.place, r.page) for r in S.read_song_index(spark, str(tmp_path / "songs.json")).orderBy("place").collect()] == [(0, 3), (1, 1)]
    pages = spark.range(1, 30).withColumnRenamed("id", "page")
    assert [r.page for r in S.select_pages(pages, "3-5,16, 28-40").orderBy("page").collect()] == [3, 4, 5, 16, 28, 29]
    manifest = spark.createDataFrame([(1, "ok", 5), (2, "failed", 7)], "page int, status string, notes int")
    with pytest.raises(ValueError, match="1 pages and 7 notes"):
        S.join_gate(manifest)
    assert S.join_gate(manifest, True).count() == 1


def test_audio_frames(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<4096h", *range(4096)))
    rows = S.read_audio_frames(spark, str(tmp_path / "a.wav"), 2048, 1024).collect()
    assert [r.frame for r in rows] == [0, 1, 2] and rows[1].samples[0] == 1024 / 32768


def test_alignment(spark):
    assert [o for o, _, _ in lcs_ops(list("abcd"), list("bxd"))] == ["d", "m", "d", "i", "m"]
    assert all(o == "m" for o, _, _ in lcs_ops(list("abc") * 9, list("abc") * 9))
    for ops in (lcs_ops, table_ops):
        got = ops(list("abcabcab"), list("abxcabab"))
        assert [i for o, i, _ in got if o != "i"] == list(range(8)) and [j for o, _, j in got if o != "d"] == list(range(8))
    a = spark.createDataFrame([(1, i, x) for i, x in enumerate("abc")] + [(2, 0, "q")], "k int, t int, x string")
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate("ac")] + [(3, 0, "z")], "k int, t int, x string")
    assert Counter((r.k, r.op) for r in align(a, b, ["k"], "x", ["t"]).collect()) == Counter({(1, "m"): 2, (1, "d"): 1, (2, "d"): 1, (3, "i"): 1})


def test_slurs_are_flat_and_balanced(spark):
    kinds = "stop start start stop stop start".split()
    out = meter.pair_slurs(spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "p int, t int, kind string"), ["p"], ["t"]).orderBy("t").collect()
    assert [(r.t, r.kind) for r in out] == [(1, "start"), (3, "stop")]


def test_running_tally_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.running_tally(stream, late="40 days").writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert Counter(map(tuple, spark.table("tally").collect())) == Counter(map(tuple, streaming.running_tally_batch(events).collect()))


def test_alignment_is_exact_at_every_size(monkeypatch):
    from stavelake.operators import align as A

    rng = random.Random(8)
    cases = [([rng.choice("abcd") for _ in range(rng.randint(0, 40))], [rng.choice("abcd") for _ in range(rng.randint(0, 40))]) for _ in range(200)]
    whole = [A.lcs_ops(a, b) for a, b in cases]
    monkeypatch.setattr(A, "MOST_CELLS", 0)
    assert [A.lcs_ops(a, b) for a, b in cases] == whole
    monkeypatch.undo()
    notes = [str(i) for i in range(1400)]
    ops = A.lcs_ops(notes, notes[:300] + notes[330:])  # a gap of 30 notes in a table of 1.9 million cells
    assert [sum(o == op for o, _, _ in ops) for op in "mdi"] == [1370, 30, 0]


@pytest.mark.parametrize("seed", range(4))
def test_short_way_keeps_the_ties_of_the_table(seed):
    rng = random.Random(seed)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        whole = table_ops(a, b)
        differences = sum(o != "m" for o, _, _ in whole)
        assert short_way(a, b, 60) == short_way(a, b, differences) == whole
        assert differences == 0 or short_way(a, b, differences - 1) is None


def test_long_streams_with_few_differences_take_seconds():
    rng = random.Random(9)
    a = [str(rng.randint(40, 90)) for _ in range(100_000)]
    b = list(a)
    for at in sorted(rng.sample(range(100_000), 100), reverse=True):
        b[at : at + 1] = rng.choice([[], ["x"], [b[at], "y"]])
    began = time.process_time()
    ops = lcs_ops(a, b)
    assert time.process_time() - began < 20
    n = Counter(o for o, _, _ in ops)
    assert n["m"] + n["d"] == 100_000 and n["m"] + n["i"] == len(b) and n["d"] + n["i"] <= 200
    assert all(a[i] == b[j] for o, i, j in ops if o == "m") and [i for o, i, _ in ops if o != "i"] == list(range(100_000))
