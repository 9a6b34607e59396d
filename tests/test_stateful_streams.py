import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stavelake import streaming
from stavelake.operators import audio, audit
from stavelake.plans.views import view
from stavelake.streaming import stateful

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(query):
    q = query.trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return q


def run_until(query, done, seconds=60):
    """A query that never ends by itself, stopped when its output is there."""
    q = query.start()
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert q.exception() is None
        time.sleep(0.3)
    q.stop()


def in_files(spark, rows, schema, path, parts):
    """One file for each batch of a stream."""
    for part in parts:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


FRAME = "source string, frame long, ts timestamp, midi int, clarity double"


def frames_of(tracks, hop=100):
    return [(s, i, START + timedelta(milliseconds=hop * i), m, (i % 4) / 4) for s, track in tracks.items() for i, m in enumerate(track)]


def by_note(rows, source):
    return Counter((r[source], r.midi, r.start, r.stop, r.frames, round(r.clarity, 9)) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_followed_notes_equal_the_table(spark, tmp_path, seed):
    """Frames of three sources in any split and order within the lateness; a last frame far ahead moves the watermark on."""
    rng = random.Random(seed)
    tracks = {s: [rng.choice([60, 60, 60, 62, None]) for _ in range(60)] for s in "abc"} | {"d": [60, 60, 60], "e": [None, 60, None, 60, 60]}
    rows = frames_of(tracks)
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[1] + rng.randint(0, 4))
    table = spark.createDataFrame(rows, FRAME)
    want = audio.frame_notes(table.withColumnRenamed("source", "doc_id").withColumn("hz", F.lit(1.0))).collect()
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    rows.append(("z", 10**6, START + timedelta(hours=1), 50, 0.0))
    parts = [range(a, b) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    q = run(stateful.follow_notes(in_files(spark, rows, FRAME, f"{tmp_path}/in", parts), 100).writeStream.format("memory").queryName(f"followed{seed}").option("checkpointLocation", f"{tmp_path}/c"))
    got = spark.table(f"followed{seed}").collect()
    assert by_note(got, "source") == by_note(want, "doc_id") and any(r.source == "d" for r in got)
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # the waiting frame of source z alone


def test_late_frames_are_left_out(spark, tmp_path):
    rows = frames_of({"a": [60] * 5}) + [("a", 100, START + timedelta(seconds=10), 62, 0.0), ("a", 5, START + timedelta(milliseconds=500), 60, 0.0), ("a", 900, START + timedelta(seconds=90), 64, 0.0)]
    run(stateful.follow_notes(in_files(spark, rows, FRAME, f"{tmp_path}/in", [range(5), [5], [6], [7]]), 100, least=1).writeStream.format("memory").queryName("late"))
    assert [(r.midi, r.start, r.stop) for r in spark.table("late").orderBy("start").collect()] == [(60, 0, 4), (62, 100, 100)]


@pytest.mark.parametrize("ttl", [None, 3_600_000])
def test_sampled_trace_with_typed_state(spark, sf, tmp_path, ttl):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "props")
    rows = sorted(map(tuple, events.collect()))
    stream = in_files(spark, rows, events.schema, f"{tmp_path}/in", [range(len(rows) // 3), range(len(rows) // 3, len(rows))])
    want = streaming.sample_trace(events, ["cl*", "error"], "1", 3, 20).collect()
    query = stateful.sample_trace_with_ttl(stream, ["cl*", "error"], "1", 3, 20, ttl).writeStream.format("memory").queryName(f"sampled{ttl}")
    run_until(query, lambda: spark.table(f"sampled{ttl}").count() >= len(want)) if ttl else run(query)
    assert Counter((r.event_type, r.hit, r.event_id) for r in spark.table(f"sampled{ttl}").collect()) == Counter((r.event_type, r.hit, r.event_id) for r in want)


@pytest.mark.parametrize("seed", range(2))
def test_tally_of_arriving_pages_equals_the_batch(spark, sf, tmp_path, seed):
    """Rows of all kinds in any order and any split into batches."""
    rng = random.Random(seed)
    notes, measures, clefs = (view(spark, sf, v).where("page < 6") for v in ("notes_v", "measures_v", "clefs_v"))
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page") * 60))
    rows = [tuple(r) for r in stateful.page_rows(note=timed(notes), measure=timed(measures), clef=timed(clefs)).collect()]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    stream = in_files(spark, rows, stateful.ROW, f"{tmp_path}/in", [range(a, b) for a, b in zip([0, *cuts], [*cuts, len(rows)])])
    run(stateful.audit_stream(stream, f"{tmp_path}/found", f"{tmp_path}/c"))
    want = audit.tally(audit.flags(notes, measures, clefs)).collect()
    assert list(map(tuple, stateful.page_tally(spark, f"{tmp_path}/found").collect())) == list(map(tuple, want)) and want


def test_late_pages_and_second_visits(spark, tmp_path):
    """A page that comes again after it was forgotten is a page by itself; rows behind the watermark are counted as late."""
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    row = lambda page, h, measure: (page, "measure", at(h), None, 1, None, None, measure, *[None] * 7, 4, 4, None, None)
    rows = [row(1, 0, 1), row(2, 50, 1), row(1, 1, 2), row(1, 60, 3), row(2, 50.5, 2)]
    run(stateful.audit_stream(in_files(spark, rows, stateful.ROW, f"{tmp_path}/in", [[i] for i in range(5)]), f"{tmp_path}/found", f"{tmp_path}/c", "10 hours", 3_600_000))
    found = spark.read.schema("page string, check string, n long, batch long").parquet(f"{tmp_path}/found").where("check = 'empty_measure'").collect()
    assert Counter(r.page.split("@")[0] for r in found) == {"1": 2, "2": 2} and len({r.page for r in found}) == 3
    assert {r.check: (r.n, r.pages) for r in stateful.page_tally(spark, f"{tmp_path}/found").collect()}["empty_measure"] == (4, 3)
    assert [tuple(r) for r in stateful.late_pages(spark, f"{tmp_path}/found").collect()] == [("1", 1)]
