from collections import Counter

import pytest
from pyspark.sql import functions as F

from stavelake import sources as S
from stavelake import streaming
from stavelake.operators import pattern, reconcile, review, scoring
from stavelake.operators.align import lcs_ops


def run(query, seconds=120):
    q = query.trigger(availableNow=True).start()
    assert q.awaitTermination(seconds)
    return q


def test_live_pitch_stream(spark, tmp_path):
    rows = [(0.5, 440.0, 9.0, 1.0), (0.01, 440.0, 9.0, 1.0), (0.5, 60.0, 9.0, 1.0), (0.5, 440.0, 3.0, 1.0), (0.5, 261.63, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "amplitude double, peak_hz double, peak double, mean double")
    df.write.parquet(str(tmp_path / "in"))
    run(streaming.live_pitch(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live"))
    assert sorted(r.note for r in spark.table("live").collect()) == ["A4", "C4"] == sorted(r.note for r in streaming.live_pitch(df).collect())


def test_note_sessions_and_runs(spark, tmp_path):
    """Silences inside a note are absorbed up to the gap; short notes go; runs live on across batches."""
    pitches = [60, 60, None, 60, 60, None, None, None, 60, 60, 62, 64, 64, 64, None, None, None, None]
    df = spark.createDataFrame([("a", i / 10, p) for i, p in enumerate(pitches)] + [("b", 0.0, 50), ("b", 0.1, 50), ("b", 2.0, 51)], "source string, t double, midi int")
    for k in range(3):
        df.where(f"t >= {k * 0.65} and t < {(k + 1) * 0.65 if k < 2 else 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(streaming.note_runs(stream, 0.1, 0.2, 0.15).writeStream.format("memory").queryName("runs"))
    got = Counter((r.source, r.midi, round(r.start, 2), round(r.end, 2), r.frames) for r in spark.table("runs").collect())
    assert got == Counter([("a", 60, 0.0, 0.5, 4), ("a", 60, 0.8, 1.0, 2), ("a", 64, 1.1, 1.4, 3), ("b", 50, 0.0, 0.2, 2)])
    timed = df.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long")))
    coarse = {(r.source, r.midi): 0 for r in streaming.note_sessions(timed, gap="250 milliseconds").collect()}
    assert set(coarse) == {("a", 60), ("a", 62), ("a", 64), ("b", 50), ("b", 51)}


def test_journal_batches_count_once(spark, tmp_path):
    schema, path = "stem string, ok boolean", str(tmp_path / "journal")
    work = lambda *stems: spark.createDataFrame([(s, i) for i, s in enumerate(stems)], "stem string, n int")
    process = lambda rows: rows.select("stem", (F.col("n") % 2 == 0).alias("ok"))
    streaming.journal_batch(work("p1", "p2", "p2"), 0, process, path, schema)
    for _ in range(3):  # a batch that is run again
        streaming.journal_batch(work("p2", "p3", "p4"), 1, process, path, schema)
    got = Counter((r.stem, r.ok, r.batch) for r in spark.read.schema(f"{schema}, batch long").json(path).collect())
    assert got == Counter([("p1", True, 0), ("p2", False, 0), ("p3", False, 1), ("p4", True, 1)])
    df = work("p4", "p5")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(streaming.journal_stream(stream, process, str(tmp_path / "second"), str(tmp_path / "checkpoint")))
    assert {r.stem for r in spark.read.schema(schema).json(str(tmp_path / "second")).collect()} == {"p4", "p5"}


def test_sample_trace_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "props")
    ids = [r.event_id for r in events.orderBy("event_id").collect()]
    for lo, hi in ((0, len(ids) // 2), (len(ids) // 2, len(ids))):
        events.where(F.col("event_id").between(ids[lo], ids[hi - 1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(streaming.sample_trace_stream(stream, ["cl*", "error"], "1", 3, 20).writeStream.format("memory").queryName("trace"))
    got = Counter((r.event_type, r.hit) for r in spark.table("trace").collect())
    assert got == Counter((r.event_type, r.hit) for r in streaming.sample_trace(events, ["cl*", "error"], "1", 3, 20).collect()) and got


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"page": 1, "status": "ok"}, {"page": 2, "status": "failed"}]')
    assert [r.page for r in S.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [1]
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes/p1.json").write_text('{"page": 1, "n_staves": 8, "n_systems": 3}')
    (tmp_path / "boxes/p2.json").write_text("{broken")
    assert [tuple(r) for r in S.read_layout(spark, str(tmp_path / "boxes")).collect()] == [(1, 8, 3)]
    (tmp_path / "v.jsonl").write_text('{"name": "a", "verdict": "ok"}\n{"name": "a", "verdict": "ok"}\n{"name": "b", "verdict": "ok"}\n{"name": "b", "verdict": "bad"}\nbroken\n')
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "name string")
    assert {r.name: r.verdict for r in S.read_verdicts(spark, str(tmp_path / "v.jsonl"), names).collect()} == {"a": "ok", "b": "error", "c": "error"}
    found = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "check string, page int")
    S.write_report(found, str(tmp_path / "report"))
    assert Counter(r.check for r in spark.read.json(str(tmp_path / "report")).collect()) == Counter(x=2, y=1)
    with pytest.raises(Exception, match="already exists"):
        S.write_report(found, str(tmp_path / "report"))
    songs = spark.createDataFrame([("A Song!", 1, 1), ("A Song!", 1, 2), ("A Song!", 2, 1)], "title string, part int, measure int")
    assert [tuple(r) for r in S.song_index(songs).collect()] == [("A Song!", 2, 2, 3, "a-song")]


def test_melody_diff_against_plain_alignment(spark):
    truth = {1: [60, 62, 64, 65], 2: [60], 3: [], 4: [60, 61, 60, 61, 62]}
    pred = {1: [60, 63, 64, 65, 67], 2: [], 3: [55], 4: [61, 60, 62, 62]}
    frame = lambda d: spark.createDataFrame([(k, i, m, False) for k, v in d.items() for i, m in enumerate(v)] + [(1, 9, 0, True)], "page int, at int, midi int, is_rest boolean")
    got = {r.page: r for r in scoring.melody_diff(frame(truth), frame(pred), ["page"], ["at"]).collect()}
    for k in truth:
        ops = Counter(op for op, _, _ in lcs_ops(truth[k], pred[k]))
        exact, d, i = ops["m"], ops["d"], ops["i"]
        want = (len(truth[k]), len(pred[k]), exact, min(d, i), max(0, d - i), max(0, i - d))
        assert tuple(got[k][1:7]) == want
    assert (got[1].precision, got[1].recall, got[1].f1) == (600, 750, 666) and (got[2].recall, got[3].precision) == (0, 0)


def test_signatures_with_unknown_meters_and_clefs(spark):
    """A page without any meter repeats one pattern; a system without clefs keeps its row and shows them as unknown."""
    notes = spark.createDataFrame([(p, s, st, 2 * s - 1) for p in (1, 2) for s in (1, 2, 3) for st in (1, 2)], "page int, system int, staff int, measure int")
    measures = spark.createDataFrame([(p, m, (m + 1) // 2, None if p == 1 else 4, None if p == 1 else 4) for p in (1, 2) for m in range(1, 7)], "page int, measure int, system int, beats int, beat_type int")
    clefs = spark.createDataFrame([(p, s, st, "GF"[st - 1], 2 * st) for p in (1, 2) for s in (1, 2) for st in (1, 2)], "page int, system int, staff int, sign string, line int")
    sigs = pattern.signatures(notes, measures, clefs)
    got = {(r.page, r.system): tuple(r)[2:] for r in sigs.collect()}
    assert got[1, 1] == (2, None, "G2,F4", "1,1", "?;?") and got[2, 1] == (2, "4/4", "G2,F4", "1,1", "96;96") and got[2, 3] == (2, "4/4", "?0,?0", "1,1", "96;96")
    assert sorted((r.page, r.system) for r in pattern.deviations(sigs).collect()) == [(1, 3), (2, 3)]
    near = {r.page: (r.k_clefs, r.differ) for r in pattern.nearest(pattern.deviations(sigs), pattern.known_patterns(sigs)).collect()}
    assert near == {1: ("G2,F4", 1), 2: ("G2,F4", 1)}
    half = sigs.withColumn("meter", F.when(F.col("system") > 1, F.col("meter")).otherwise("3/4"))
    assert {(r.page, r.system): r.phrases for r in review.differences(pattern.deviations(half, reference=half.where("system = 1")), pattern.known_patterns(half, reference=half.where("system = 1"))).where("page = 1").collect()} == {
        (1, 2): "meter none (expected 3/4)", (1, 3): "meter none (expected 3/4); clefs ?0 ?0 (expected G2 F4)"}


def test_fragments_in_natural_order(spark):
    files = ["sys10.s1", "sys2.s10", "sys2.s9", "sys1.s1", "sys02.s1", "sys100000000000000000000.s1"]
    got = review.systems_from_fragments(spark.createDataFrame([(1, f) for f in files], "page int, file string")).orderBy("system").collect()
    assert [r.file for r in got] == ["sys1.s1", "sys02.s1", "sys2.s9", "sys2.s10", "sys10.s1", "sys100000000000000000000.s1"]


def test_patterns_and_review_of_small_pages(spark):
    sigs = spark.createDataFrame([(1, 1, 3, "4/4", "G2,G2,F4", ""), (1, 2, 3, "4/4", "G2,G2,F4", ""), (1, 3, 2, "3/4", "G2,F4", ""), (2, 1, 2, "4/4", "G2,F4", ""), (2, 2, 1, "4/4", "G2", ""), (2, 3, 1, "2/4", "F4", "")], "page int, system int, staves long, meter string, clefs string, notes string")
    key = lambda df: sorted((r.page, r.system) for r in df.collect())
    assert key(pattern.deviations(sigs)) == [(1, 3), (2, 3)]
    ref = spark.createDataFrame([(1, 3), (2, 3)], "page int, system int")
    assert key(pattern.deviations(sigs, reference=ref)) == [(1, 3), (2, 1), (2, 2)]
    assert key(pattern.deviations(sigs, reference=ref.where("page = 1"))) == [(1, 3), (2, 2), (2, 3)]
    said = {(r.page, r.system): (r.phrases, r.described) for r in review.differences(pattern.deviations(sigs), pattern.known_patterns(sigs)).collect()}
    assert said[1, 3] == ("staff count 2 (expected 3); meter 3/4 (expected 4/4); clefs G2 F4 (expected G2 G2 F4)", "2 staff(s), 3/4, G2 F4")
    note = lambda page, midi, rest=False: (page, 1, midi, rest)
    cols = "page int, measure int, midi int, is_rest boolean"
    left = spark.createDataFrame([note(1, 60), note(1, 62), note(2, 60), note(3, 60)], cols)
    right = spark.createDataFrame([note(1, 60), note(1, 63), note(2, 60)], cols)
    cover = review.coverage_flags(spark.createDataFrame([(1, 1)], "page int, n int"), spark.createDataFrame([(1, 3), (2, 0)], "page int, n int"), "run B", "staves")
    got = Counter((r.page, r.check, r.severity) for r in review.review(left, right, sigs, cover).collect())
    assert got == Counter({(1, "coverage_miss", 3): 1, (1, "pitch_disagreement", 3): 2, (1, "pattern_deviation", 2): 1, (2, "weak_pattern", 1): 1, (2, "pattern_deviation", 2): 1, (3, "missing_fragment", 3): 1, (3, "count_disagreement", 3): 3, (3, "pitch_disagreement", 3): 2})
    assert all("coverage_miss" in r.detail for r in review.review(left, right, sigs, cover).where("page = 1 and check = 'pitch_disagreement'").collect())
    same = spark.createDataFrame([("A", ["notes", "rests"]), ("A", ["rests"]), ("B", None)], "run string, comparable array<string>")
    assert {r.run: r.comparable for r in reconcile.comparable_fields(same, ["run"]).collect()} == {"A": "rests", "B": ""}
