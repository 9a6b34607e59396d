from stavelake.operators import assemble, audit, reconcile

COLUMNS = "book int, page int, system int, part int, staff int, is_rest boolean"


def scan(spark, rows):
    return {(r.level, r.book, r.page): tuple(r)[3:] for r in assemble.grid_scan(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_pages_books_and_the_whole(spark):
    note = lambda book, page, system, part, staff, rest=False: (book, page, system, part, staff, rest)
    rows = [
        # a voice above a piano, and a system of the piano alone whose lower staff rests
        *[note(1, 1, 1, *x) for x in ((0, 1), (1, 1), (1, 2))], note(1, 1, 2, 1, 1), note(1, 1, 2, 1, 2, True),
        # a piano alone: no singer is added
        *[note(1, 2, s, 1, k) for s in (1, 2) for k in (1, 2)],
        # two parts that never stand together: the tallest system is one part, so a row is added
        note(2, 3, 1, 0, 1), note(2, 3, 2, 1, 1), note(2, 3, 2, 1, 1, True),
    ]
    assert scan(spark, rows) == {
        ("page", 1, 1): (1, 1, 3, 2, 2, 1, 3),
        ("page", 1, 2): (1, 0, 2, 2, 2, 0, 2),
        ("page", 2, 3): (1, 0, 2, 1, 1, 1, 1),
        ("book", 1, None): (2, 1, 3, 2, 2, 1, 3),
        ("book", 2, None): (1, 0, 2, 1, 1, 1, 1),
        ("all", None, None): (3, 1, 3, 1, 2, 1, 3),
    }


def test_no_notes(spark):
    assert scan(spark, []) == {}


def test_control_gate(spark):
    """Findings on pages that are known to be good shut the gate; findings elsewhere, or none, don't."""
    found = spark.createDataFrame([("broken_measure", 1), ("broken_measure", 2)], "check string, page int")
    pages = lambda *p: spark.createDataFrame([(x,) for x in p], "page int")
    assert audit.control_gate(found, pages(3, 4)) and audit.control_gate(found.where("false"), pages(1)) and audit.control_gate(found, pages())
    assert not audit.control_gate(found, pages(2, 3))


def test_runs_by_file_and_by_totals(spark):
    cols = "file string, page int, system int, staff int, measure int, midi int, is_rest boolean"
    left = spark.createDataFrame([("a", 1, 1, 1, 1, 60, False), ("a", 1, 1, 1, 2, 62, False), ("b", 1, 2, 1, 1, 60, False), ("c", 1, 2, 2, 1, 60, True)], cols)
    right = spark.createDataFrame([("a", 1, 1, 1, 1, 60, False), ("a", 1, 1, 1, 2, 64, False), ("c", 1, 2, 2, 1, 60, True), ("d", 1, 2, 2, 1, 60, True)], cols)
    got = sorted((r.file, r.field, r.left, r.right) for r in reconcile.reconcile_files(left, right, ["file"]).collect())
    assert got == [("a", "pitch 62", 1, 0), ("a", "pitch 64", 0, 1), ("b", "file present", 1, 0), ("d", "file present", 0, 1)]
    totals = reconcile.reconcile_totals(left, right, ["system"], ["system", "staff"], ["page"]).collect()
    assert sorted((r.field, r.left, r.right) for r in totals) == [("pitched", 3, 2), ("rests", 1, 2)]
    assert sorted(r.field for r in reconcile.reconcile_totals(left, right.where("false"), ["system"], ["staff"], ["page"]).collect()) == ["notes", "pitched", "rests"]
