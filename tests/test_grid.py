from stavelake.operators import geometry, parts

STAFF = "page int, system int, staff int, brace int, sign string, line int"
FRAGMENT = "event_id long, page int, system int, staff int, measure int, onset int, dur int, is_rest boolean, midi int"


def staves(spark, *systems, page=1):
    """One system for each list of (brace, clef) from the top."""
    rows = [(page, k + 1, i + 1, brace, clef[0], int(clef[1])) for k, s in enumerate(systems) for i, (brace, clef) in enumerate(s)]
    return spark.createDataFrame(rows, STAFF)


PIANO, VOICE = [(1, "G2"), (1, "F4")], [(None, "G2")]


def rows_of(df):
    return sorted((r["from_bottom"], r["part"], r["staff"]) for r in parts.grid_rows(df).collect())


def test_grid_has_a_row_for_the_singer(spark):
    low = [(0, "A1", 2), (1, "A1", 1)]
    assert rows_of(staves(spark, PIANO, VOICE + PIANO, VOICE + PIANO)) == [*low, (2, "S1", 1)]
    assert rows_of(staves(spark, PIANO, PIANO)) == low
    assert rows_of(staves(spark, PIANO, VOICE)) == [*low, (2, "S1", 1)]  # parts of one height take turns
    assert rows_of(staves(spark, VOICE + VOICE + PIANO)) == [*low, (2, "S2", 1), (3, "S1", 1)]
    assert rows_of(staves(spark).where("false")) == []


def test_notes_and_clefs_of_the_grid(spark):
    df = staves(spark, PIANO, VOICE + [(1, "G2"), (1, "G2")])
    notes = spark.createDataFrame([(1, 1, 1, 1, 2, 0, 24, False, 60), (2, 1, 1, 2, 1, 0, 24, False, 40), (3, 1, 2, 1, 1, 0, 24, False, 70), (4, 1, 2, 3, 1, 0, 24, True, 0)], FRAGMENT)
    got = {r.event_id: (r.part, r.staff, r.measure) for r in parts.page_grid(notes, df).collect()}
    assert got == {1: ("A1", 1, 2), 2: ("A1", 2, 1), 3: ("S1", 1, 3), 4: ("A1", 2, 3)}
    clefs = lambda **k: sorted((r.part, r.staff, r.measure, r.sign, r.line) for r in parts.grid_clefs(notes, df, **k).collect())
    assert clefs() == [("A1", 1, 1, "G", 2), ("A1", 2, 1, "F", 4), ("A1", 2, 3, "G", 2), ("S1", 1, 1, "G", 2)]
    forced = spark.createDataFrame([(1, 0, "F", 4), (1, 9, "C", 3)], "page int, from_bottom int, sign string, line int")
    assert clefs(overrides=forced) == [("A1", 1, 1, "G", 2), ("A1", 2, 1, "F", 4), ("S1", 1, 1, "G", 2)]


def test_report_of_a_corpus(spark):
    df = staves(spark, PIANO).union(staves(spark, [(1, "G2"), (None, "G2"), (1, "F4")], page=2)).union(staves(spark, PIANO, page=3))
    notes = spark.createDataFrame([(1, 1, 1, 1, 1, 80, 24, False, 60), (2, 2, 1, 1, 1, 0, 24, False, 60), (3, 3, 1, 1, 1, 0, 0, False, 60)], FRAGMENT)
    meters = spark.createDataFrame([(p, 1, 4, 4) for p in (1, 2, 3)], "page int, measure int, beats int, beat_type int")
    got = {r.page: (r.status, r.clamped, r.problems) for r in parts.corpus_report(notes, df, meters).collect()}
    assert got == {1: ("ok", 1, ""), 2: ("fail", 0, ""), 3: ("invariant", 0, "length")}
    assert parts.corpus_report(notes.where("false"), df.where("false"), meters.where("false")).count() == 0


def test_page_edges_by_the_caller(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 20.0, 100, 900), (1, 2, 60.0, 80.0, 100, 900)], "page int, staff int, y_top double, y_center double, x0 int, x1 int")
    rules = spark.createDataFrame([(1, 95, 0.0, 200.0)], "page int, x int, top double, bottom double")
    systems = lambda **k: [r.system for r in geometry.linked_systems(rows, rules, **k).orderBy("staff").collect()]
    edge = lambda left: spark.createDataFrame([(1, left, 1000)], "page int, left int, right int")
    assert systems() == [1, 1]
    assert systems(edges=edge(95)) == [1, 2] and systems(edges=edge(94)) == [1, 1]
