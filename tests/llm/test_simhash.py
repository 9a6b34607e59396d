import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from stavelake.llm.components import components, with_key_values
from stavelake.llm.simhash import allocate, fingerprint, links, simhash_components


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius=4):
    """Brute force: all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def test_documents_against_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain(t) for i, t in texts.items()}
    root = groups(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_components(docs).collect()}
    assert got == {i: (f, least[root[f]]) for i, f in fps.items()}


def test_odd_rows(odd, none):
    rows = simhash_components(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 2)} == {1}
    assert {(by[i].fp, by[i].component_id) for i in (3, 4, 5)} == {(0, 3)}
    assert by[None].component_id is None
    assert simhash_components(none).count() == 0


def edges_of(spark, fps, **more):
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    got = components(links(spark.createDataFrame(signed, "fp long"), **more)).collect()
    label = {f: f for f in fps} | {r.node % 2**64: r.root for r in got}
    return label


@pytest.mark.parametrize("radius,hot", [(4, 1024), (4, 3), (2, 3), (3, 3), (1, 2), (1, 1024)])
def test_links_and_crowded_buckets(spark, radius, hot):
    rng, fps = random.Random(radius * hot), set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(20):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    label, want = edges_of(spark, fps, radius=radius, hot=hot), groups(fps, radius)
    parts = lambda of: {frozenset(f for f in fps if of[f] == x) for x in set(of.values())}
    assert parts(label) == parts(want)


def test_thresholds_meet_the_pigeonhole():
    sample = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for n in (100, 10**5, 10**8):
        plan = allocate(sample, n, 4)
        bits = [b for p, _ in plan for b in p]
        assert len(bits) == len(set(bits)) and all(t >= 0 for _, t in plan)


def tasks_of(df):
    """Rows that come out of each task."""
    return sorted((r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)


def test_hot_keys_stay_spread(spark):
    """One component holds most rows and one fingerprint a third of them; no task gets more than its share."""
    rows = spark.range(0, 40_000, 1, 64).select(F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id") % 500 + 10).alias("k"), "id")
    small = rows.groupBy("k").agg(F.min("id").alias("v"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = with_key_values(rows, small, "k", 40_000)
        assert max(tasks_of(out)) < 40_000 / 64 + 800
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(out.collect()) == Counter(rows.join(small.drop("n"), "k").select("k", "id", "v").collect())
    star = spark.range(1, 6000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert Counter(r.root for r in components(star.union(star.select(F.col("a"), F.col("a") + 10_000))).collect()) == Counter({0: 11_999})


def test_components_of_a_path(spark):
    n = 60
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(path).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components(path.where("false")).count() == 0


def test_short_texts():
    assert fingerprint("One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    assert fingerprint(None) == fingerprint(" \n") == 0
