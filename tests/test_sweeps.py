import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from stavelake.operators import geometry, meter
from stavelake.operators.scan import Spans

LINES = "page int, y double, x0 int, x1 int, th int"


def plain_merge(rows, tol, reach):
    out = []
    for page, y, x0, x1, th in sorted(rows):
        for m in out:
            if m[0] == page and abs(m[1] - y) <= tol and x0 <= m[3] + reach and x1 >= m[2] - reach:
                m[1:] = [(m[1] * m[5] + y) / (m[5] + 1), min(m[2], x0), max(m[3], x1), m[4], m[5] + 1]
                break
        else:
            out.append([page, y, x0, x1, th, 1])
    return Counter(map(tuple, out))


def plain_thin(rows, least):
    out = []
    for r in sorted(rows):
        at = next((i for i, k in enumerate(out) if k[0] == r[0] and abs(k[1] - r[1]) < least.get(r[0], 0)), None)
        if at is None:
            out.append(r)
        elif r[3] - r[2] > out[at][3] - out[at][2]:
            out[at] = r
    return Counter(out)


def pieces(rng, n, height, width):
    rows = []
    for _ in range(n):
        x = rng.randrange(width)
        rows.append((rng.randrange(3), float(rng.randrange(height)) / rng.choice([1, 1, 3]), x, x + rng.randrange(60), rng.randrange(1, 4)))
    return rows


def test_spans_against_a_plain_list():
    rng = random.Random(1)
    for _ in range(60):
        spans, held, n = Spans(), {}, 0
        for _ in range(60):
            if rng.random() < 0.5:
                k, n, low = (n if not held or rng.random() < 0.6 else rng.choice(list(held))), n + 1, rng.randrange(-50, 200)
                held.setdefault(k, []).append((low, low + rng.randrange(30)))
                spans.add(k, *held[k][-1])
            elif held and rng.random() < 0.4:
                spans.drop(k := rng.choice(list(held)))
                del held[k]
            low = rng.randrange(-50, 200)
            high = low + rng.randrange(30)
            assert spans.first(low, high) == min((k for k, v in held.items() if any(a <= high and b >= low for a, b in v)), default=None)
        for k in list(held):
            spans.drop(k)
        assert not spans.least


@pytest.mark.parametrize("height, width", [(40, 2000), (400, 500), (3000, 3000)])
def test_merging_and_thinning_against_scans_of_all_lines(spark, height, width):
    rows = pieces(random.Random(height), 400, height, width)
    rows += rows[:9]
    lines = spark.createDataFrame(rows, LINES)
    assert Counter(map(tuple, geometry.merge_collinear(lines).collect())) == plain_merge(rows, 6, 40)
    spacing = spark.createDataFrame([(0, 20.0), (1, 3.5)], "page int, spacing double")
    got = geometry.drop_slivers(lines, spacing)
    # Equal places with another thickness may change places in the order, and only these.
    assert Counter((r.page, r.y, r.x0, r.x1) for r in got.collect()) == Counter(r[:4] for r in plain_thin(rows, {0: 9.0, 1: 1.575}).elements())


def test_a_piece_joins_the_first_of_two_lines(spark):
    rows = [(1, 10.0, 0, 100, 2), (1, 10.0, 300, 400, 2), (1, 11.0, 90, 310, 2), (1, 12.0, 200, 210, 2)]
    got = geometry.merge_collinear(spark.createDataFrame(rows, LINES)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 11.0, 0, 310, 2, 3), (1, 10.0, 300, 400, 2, 1)])


def test_a_page_with_very_many_pieces(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("page"), (F.floor(F.col("id") / 50) * 10).cast("double").alias("y"), (F.col("id") % 50 * 100).cast("int").alias("x0"), (F.col("id") % 50 * 100 + 90).cast("int").alias("x1"), F.lit(2).alias("th"))
    lines = geometry.merge_collinear(rows)
    assert lines.agg(F.count("*"), F.min("n"), F.min("x0"), F.max("x1")).first()[:] == (n // 50, 50, 0, 4990)
    apart = spark.range(n).select(F.lit(1).alias("page"), (F.lit(5.0) + F.col("id") % 5).alias("y"), (F.col("id") * 100).cast("int").alias("x0"), (F.col("id") * 100 + 10).cast("int").alias("x1"), F.lit(2).alias("th"))
    assert geometry.merge_collinear(apart).agg(F.count("*"), F.max("n")).first()[:] == (n, 1)
    assert geometry.drop_slivers(rows, spark.createDataFrame([(1, 10.0)], "page int, spacing double")).count() == n // 50


def test_slivers_do_not_lower_the_settled_spacing(spark):
    rows = [(1, 100.0 * s + 20.0 * k, 0, 900, 2) for s in range(0, 6, 2) for k in range(5)] + [(1, 213.0 + 20 * k, 100, 160, 2) for k in range(4)] + [(2, 5.0, 0, 9, 2)]
    lines, spacing = geometry.settled_lines(spark.createDataFrame(rows, LINES), rough_low=8)
    assert [tuple(r) for r in spacing.collect()] == [(1, 20.0)]
    staves = geometry.group_lines(lines, spacing).orderBy("staff").collect()
    assert [(r.n_lines, r.spread) for r in staves] == [(5, 0.0)] * 3
    assert lines.where("page = 2").count() == 1


def test_odd_lines(spark):
    empty = spark.createDataFrame([], LINES)
    assert geometry.merge_collinear(empty).count() == 0 and geometry.settled_lines(empty)[1].count() == 0
    rows = [(None, 1.0, 0, 5, 1), (None, 2.0, 0, 5, 1), (1, None, 0, 5, 1), (1, 3.0, None, 5, 1), (1, 4.0, 0, 5, None)]
    assert Counter(map(tuple, geometry.merge_collinear(spark.createDataFrame(rows, LINES)).collect())) == Counter([(None, 1.5, 0, 5, 1, 2), (1, 4.0, 0, 5, None, 1)])


def test_a_bar_with_very_many_notes(spark):
    n = 100_000
    notes = spark.range(n).select(F.col("id").alias("event_id"), *[F.lit(1).alias(c) for c in ("page", "staff", "voice", "measure")], (F.col("id") * 2).alias("onset"), F.lit(3).alias("dur"), F.lit(False).alias("is_rest"), F.lit(60).alias("midi"))
    bars = spark.createDataFrame([(1, 1, 2_000_000, 4)], "page int, measure int, beats int, beat_type int")
    got = meter.trim_overlaps(notes, bars).agg(F.count("*"), F.sum("dur"), F.sum("touched")).first()
    assert got[:] == (n, 2 * n + 1, n - 1)
