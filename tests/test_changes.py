import random
from collections import Counter

from pyspark.sql import functions as F
from stavelake.operators import assemble, audit, geometry, reconcile, scoring


def notes(spark, rows):
    return spark.createDataFrame(rows, "page int, staff int, voice int, measure int, onset int, dur int, is_rest boolean, midi int")


def test_repair_reports_against_counters(spark):
    rng = random.Random(5)
    row = lambda: (rng.randrange(4), rng.randrange(1, 3), rng.randrange(1, 3), rng.randrange(1, 4), 0, rng.choice([6, 12]), rng.random() < 0.3, rng.randrange(60, 63))
    before = [row() for _ in range(150)]
    after = [r for r in before if rng.random() < 0.9] + [row() for _ in range(20)] + [(1, 3, 1, 1, 0, 12, True, None)] * 2
    before += [(7, 1, 1, 1, 0, 12, False, 60)]
    got = {r.page: r for r in reconcile.repair_reports(notes(spark, before), notes(spark, after), ["page"]).collect()}
    content = lambda rows, p: Counter((m, v, d, "rest" if rest else midi) for page, _, v, m, _, d, rest, midi in rows if page == p)
    for p, r in got.items():
        b, a = content(before, p), content(after, p)
        put_in = {k: n for k, n in (a - b).items() if k[3] == "rest"}
        assert (r.rests_added, r.voices_padded) == (sum(put_in.values()), len({k[:2] for k in put_in}))
        assert (r.content_lost, r.content_gained) == ((b - a).total(), (a - b).total())
    assert (got[1].staves_before, got[1].staves_after, got[1].staves_differ) == (2, 3, 1)
    assert (got[7].staves_before, got[7].staves_after, got[7].staves_differ, got[7].content_lost) == (1, None, 0, 1)


def test_a_chord_with_another_root_is_no_change(spark):
    before = [(1, 1, 1, 1, 0, 12, False, 60), (1, 1, 1, 1, 0, 12, False, 64)]
    got = reconcile.repair_reports(notes(spark, before), notes(spark, before[::-1]), ["page"]).first()
    assert got[1:] == (1, 1, 0, 0, 0, 0, 0)
    empty = notes(spark, [])
    assert reconcile.repair_reports(empty, empty, ["page"]).count() == 0


def test_shift_verdicts(spark):
    heights = lambda moved: spark.createDataFrame([(p, y + m) for p, m in moved.items() for y in (0, 0, 1, 4, 9)] + [(9, 0)], "page int, midi int")
    got = scoring.shift_verdicts(heights({1: 0, 2: 0, 3: 0, 4: 0}), heights({1: 0, 2: 7, 3: -7, 4: 2}), ["page"], 2)
    assert {r.page: (r.shift, r.support, r.verdict) for r in got.collect()} == {1: (0, 5, "none"), 2: (7, 5, "octave"), 3: (-7, 5, "octave"), 4: (2, 5, "shifted"), 9: (0, 1, "thin")}


def test_pages_that_stand_out(spark):
    rows = [("a", p, 1.0, 2.0, 0.01) for p in range(4)] + [("a", 4, 1.6, 2.0, 0.13), ("a", 5, 0.5, None, 0.12)] + [("b", p, 9.0 ** p, 1.0, 0.5) for p in range(3)] + [("c", p, 0.0, 1.0, 0.0) for p in range(4)]
    features = spark.createDataFrame(rows, "book string, page int, ink double, staves double, deviance double")
    got = scoring.page_outliers(features, ["ink", "staves"], {"deviance": 0.12}).collect()
    assert sorted((r.book, r.page, r.feature, r.value, r.median) for r in got) == [("a", 4, "deviance", 0.13, None), ("a", 4, "ink", 1.6, 1.0)]


def test_heads_far_from_the_staff_count_for_the_shift_only(spark):
    frame = lambda rows: spark.createDataFrame(rows, "staff int, x double, y int")
    render = frame([(1, 0.1, 0), (1, 0.2, 2), (1, 0.3, 5), (1, 0.4, 6), (1, 0.5, 9), (2, 0.1, 0)])
    scan = frame([(1, 0.1, 1), (1, 0.2, 3), (1, 0.3, 6), (1, 0.4, 7), (1, 0.5, 10), (3, 0.1, 0)])
    got = geometry.staff_traces(scan, render, ["staff"]).collect()
    assert [r.asDict() for r in got] == [{"staff": 1, "page_events": 2, "engraved_events": 3, "engraved_events_wide": 5, "x_matched": 2, "same_height": 0, "shift": 1, "support": 5}]


def test_roles_that_were_given_twice(spark):
    roles = spark.createDataFrame([(1, 1, "voice"), (1, 2, "piano"), (1, 3, "piano"), (2, 1, "voice"), (2, 1, "voice"), (3, 1, "silent")], "page int, staff int, role string")
    assert [tuple(r) for r in assemble.duplicate_roles(roles).collect()] == [(1, "piano", "2,3")]
    rows = [(1, 1, 1, 1, 8 * i, 8, False, 60, "3:2", i) for i in range(3)] + [(1, 1, 1, 1, 24, 24, True, None, None, 3), (1, 1, 1, 1, 48, 8, False, 60, "3:2", 4), (2, 1, 1, 1, 0, 24, False, 60, None, 5), (4, 1, 1, 1, 0, 24, False, 60, "3:2", 6)]
    df = spark.createDataFrame(rows, "page int, staff int, voice int, measure int, onset int, dur int, is_rest boolean, midi int, ratio string, event_id int")
    got = {(r.page, r.role): tuple(r)[2:] for r in assemble.role_totals(df, roles).collect()}
    assert got == {(1, "voice"): (1, 5, 4, 2), (1, "piano"): (2, 0, 0, 0), (2, "voice"): (1, 1, 1, 0), (3, "silent"): (1, 0, 0, 0)}


def test_stats_of_fragments(spark):
    schema = "doc_id string, part_idx int, measure_ord int, tag string, is_rest boolean, is_chord boolean, staves int, error string"
    rows = [("a", 0, 1, "attributes", None, None, 2, None), ("a", 0, 1, "note", False, False, None, None), ("a", 0, 2, "note", False, True, None, None), ("a", 1, 1, "note", True, True, None, None), ("b", None, None, None, None, None, None, "no end"), ("c", 0, 1, "attributes", None, None, None, None)]
    got = {r.doc_id: tuple(r)[1:] for r in audit.fragment_stats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (None, 2, 3, 2, 2, 3, 1, 1, 1), "b": ("no end", *[None] * 8), "c": (None, 1, 1, 1, 1, 0, 0, 0, 0)}


def test_a_measure_index_is_neither_shuffled_nor_read_whole(spark, tmp_path):
    measures = spark.range(40).selectExpr("explode(sequence(1, 30)) as measure", "cast(id as int) as page").select("page", "measure")
    played = measures.where((F.col("measure") * 7 + F.col("page")) % 4 == 0).withColumn("event_id", F.lit(1))
    index = audit.save_measure_index(measures, "measure_index_test", 5, str(tmp_path / "index"))
    want = Counter(map(tuple, audit.silence_run(played, measures, 2).collect()))
    found = audit.indexed_silence_run(played, index, 2)
    assert Counter(map(tuple, found.collect())) == want and want
    assert Counter(map(tuple, audit.indexed_silence_run(played, index.where("page = 3"), 2).collect())) == Counter({k: n for k, n in want.items() if k[0] == 3})
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "measure_index_test" in x)
    # Up the tree from the index to the join: nothing but filters, projections and sorts.
    own = [x for x in lines[:at] if len(x) - len(x.lstrip(" :+-")) < len(lines[at]) - len(lines[at].lstrip(" :+-"))]
    below = own[max(i for i, x in enumerate(own) if "Join" in x) + 1 :]
    assert below and not any("Exchange" in x for x in below)
    pruned = audit.indexed_silence_run(played, index.where("page = 3"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 5" in pruned
    spark.sql("drop table measure_index_test")
