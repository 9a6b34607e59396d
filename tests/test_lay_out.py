import random
from collections import Counter

import pytest

from stavelake.operators import emit


def plain(rows, bar):
    """One melody after another, note by note."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(r[0], []).append(r)
    out = Counter()
    for key, notes in by.items():
        number, used = 1, 0
        for _, _, dur, midi in notes:
            dur = min(dur, bar)
            if used + dur > bar:
                if used < bar:
                    out[key, number, used, bar - used, None, True] += 1
                number, used = number + 1, 0
            out[key, number, used, dur, midi, False] += 1
            used += dur
        if used < bar:
            out[key, number, used, bar - used, None, True] += 1
    return out


def laid(df, bar, partitions):
    return Counter(map(tuple, emit.lay_out(df, ["doc"], ["at"], bar, partitions).collect()))


@pytest.mark.parametrize("bar,partitions", [(96, 1), (96, 7), (10, 40)])
def test_against_note_by_note(spark, bar, partitions):
    rng = random.Random(bar + partitions)
    rows = [(d, i, rng.choice([0, 1, 3, 6, 24, 48, 96, 200]), 60 + i % 9) for d in range(12) for i in range(rng.choice([1, 2, 30, 150]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, at int, dur int, midi int")
    assert laid(df, bar, partitions) == plain(rows, bar)
    assert laid(df.where("false"), bar, partitions) == Counter()


def test_a_melody_with_most_rows_stays_spread(spark):
    """20,000 notes of one melody in 16 ranges: no task gets more than a few of them, and the bars go on across all."""
    df = emit.melodies(spark, 1, 20_000).unionByName(emit.melodies(spark, 30, 20).selectExpr("doc_id + 1 as doc_id", "at", "dur", "midi")).withColumnRenamed("doc_id", "doc")
    rows = [tuple(r) for r in df.select("doc", "at", "dur", "midi").collect()]
    assert laid(df, 96, 16) == plain(rows, 96)
    sizes = df.repartitionByRange(16, "doc", "at").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert max(sizes) < 4000


def test_passages_put_together():
    rng = random.Random(4)
    durs = [rng.randint(0, 12) for _ in range(40)]
    used, bars = emit.passage(durs, 10)
    (u1, n1), (u2, n2) = emit.passage(durs[:17], 10), emit.passage(durs[17:], 10)
    assert (u2[u1] == used).all() and (n1 + n2[u1] == bars).all()


def test_known_melodies(spark):
    a, b, other = (sorted(map(tuple, emit.melodies(spark, 2, 50, s).collect())) for s in (1, 1, 2))
    assert a == b != other and len(a) == 100 and {x[2] for x in a} <= {6, 12, 18, 24, 36, 48, 96}
