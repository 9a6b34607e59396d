"""Near copies by SimHash fingerprints: generalised pigeonhole with unequal thresholds, probe and verify."""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, field, map_texts, stored, table
from .components import components, with_key_values

BITS = 64
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over the XXH64 of all word shingles of a whole text; zero without words."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + 65536], stops[at : at + 65536])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", width: int = 4) -> DataFrame:
    """`df` with the fingerprint of its whole text as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))]

    return map_texts(df, make, [field(out, T.LongType())], text)


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bits 0 to 63 in m parts of near equal size, each grown by the bit that is most correlated with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    scale = np.sqrt((bits**2).sum(0)) + 1e-9
    corr = np.abs(bits.T @ bits / scale[:, None] / scale)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        part = [max(rest, key=lambda i: (corr[i, rest].sum(), -i))]
        while len(part) < size:
            part.append(max(sorted(left - set(part)), key=lambda i: (corr[i, part].mean(), -i)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def _near(sample: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most t of the part's bits, for t from 0 to most.

    The larger of a count over sampled pairs and the figure for independent bits, which has no floor.
    """
    mask = np.uint64(sum(1 << b for b in part))
    a = sample & mask
    seen = np.zeros(most + 1)
    for shift in range(1, min(200, len(a))):
        seen += np.bincount(np.bitwise_count(a ^ np.roll(a, shift)), minlength=BITS + 1)[: most + 1]
    seen = np.cumsum(seen) / max(1, len(a) * (min(200, len(a)) - 1))
    p = np.array([((sample >> np.uint64(b)) & np.uint64(1)).mean() for b in part])
    dist = np.zeros(most + 1)
    dist[0] = 1
    for differ in 2 * p * (1 - p):
        dist = dist * (1 - differ) + np.concatenate([[0], dist[:-1]]) * differ
    return np.maximum(seen, np.cumsum(dist))


def allocate(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds with the least estimated work: (bits, threshold) for each part that is probed.

    By the generalised pigeonhole principle two fingerprints within `radius` agree to within t_i in some part i when
    the t_i, each -1 or more, sum to radius - m + 1. Dynamic programming over the parts picks the t_i that minimise
    probes plus candidates; the number of parts with the least total wins. The plan changes cost, never results.
    """
    best = (float("inf"), [])
    for m in range(2, radius + 2):
        parts, goal = grouped_bits(sample, m), radius - m + 1
        reach = {0: (0.0, [])}  # thresholds so far, counted from -1 each
        for part in parts:
            near = _near(sample, part, radius)
            cost = [0.0, *[1 + sum(comb(len(part), d) for d in range(1, t + 1)) / 2 + 0.1 * n * near[t] for t in range(goal + m)]]
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, ts) in reach.items():
                for up, c in enumerate(cost):
                    if used + up <= goal + m and spent + c < step.get(used + up, (float("inf"),))[0]:
                        step[used + up] = (spent + c, [*ts, up - 1])
            reach = step
        spent, ts = reach[goal + m]
        if spent < best[0]:
            best = (spent, [(p, t) for p, t in zip(parts, ts) if t >= 0])
    return best[1]


def _midpoint_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Edges that connect the pairs of `fps` within the radius, in linear space.

    Two of them share a pattern that is at most radius // 2 flips from one and (radius + 1) // 2 from the other, and all
    that share a pattern so are within the radius of its least near one. An even radius makes no difference of the two.
    """
    flips = [sum(1 << b for b in c) for d in range((radius + 1) // 2 + 1) for c in combinations(range(BITS), d)]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    masks = fps.sparkSession.createDataFrame([(signed,)], "masks array<long>")
    spread = fps.join(F.broadcast(masks)).select("fp", F.explode("masks").alias("x")).select("fp", F.expr("fp ^ x").alias("mid"), (F.bit_count("x") <= radius // 2).alias("near"))
    least = spread.groupBy("mid").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("low"), F.count("*").alias("n")).where("n > 1 and low is not null")
    return spread.join(least, "mid").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(fps: DataFrame, radius: int = 4, sample_rows: int = 4000, hot: int = 1024) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of all pairs within `radius` bits.

    A bucket is one value of one part. Buckets of at most `hot` members are joined with their probes and verified
    inside the join. Members and probes of larger buckets are connected by shared midpoints instead, so no bucket emits
    all its pairs. `sample_rows` bounds the rows that the plan is estimated on.
    """
    if not 1 <= radius <= 4:
        raise ValueError("radius is 1 to 4")
    spark, n = fps.sparkSession, fps.count()
    rows = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // sample_rows))) == 0).limit(sample_rows).collect()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    sample = np.array([r.fp for r in rows] or [0, -1], np.int64).view(np.uint64)
    plan = allocate(sample, n, radius)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def probes(part: list[int], t: int) -> list[int]:
        return [signed(sum(1 << b for b in c)) for d in range(1, t + 1) for c in combinations(part, d)]

    masks = [F.struct(F.lit(i).alias("i"), F.lit(signed(sum(1 << b for b in p))).alias("mask")) for i, (p, _) in enumerate(plan)]
    index = fps.select("fp", F.explode(F.array(*masks)).alias("p")).select(F.col("p.i").alias("i"), F.expr("fp & p.mask").alias("key"), "fp")
    flips = spark.createDataFrame([(i, probes(p, t)) for i, (p, t) in enumerate(plan) if t], "i int, flips array<long>")
    moved = index.join(F.broadcast(flips), "i").select("i", "fp", "key", F.explode("flips").alias("x"))
    moved = moved.select("i", F.expr("key ^ x").alias("key"), "fp", F.expr("key ^ x < key").alias("down")).where("down").drop("down")
    probe = moved.withColumn("same", F.lit(False)).union(index.select("i", "key", "fp", F.lit(True)))
    large = index.groupBy("i", "key").count().where(F.col("count") > hot).select("i", "key")
    crowded = not large.isEmpty()
    extra = None
    if crowded:
        large = stored(large, "hot")
        crowd = index.join(large, ["i", "key"], "left_semi").select("fp").union(probe.join(large, ["i", "key"], "left_semi").select("fp")).distinct()
        extra = _midpoint_edges(stored(crowd, "crowd"), radius)
        index, probe = index.join(large, ["i", "key"], "left_anti"), probe.join(large, ["i", "key"], "left_anti")
    right = index.withColumnRenamed("fp", "b")
    found = probe.withColumnRenamed("fp", "a").alias("p").join(
        right.alias("q"),
        F.expr(f"p.i = q.i and p.key = q.key and bit_count(p.a ^ q.b) <= {radius} and (not p.same or p.a < q.b)"),
    )
    found = found.select("a", "b")
    return found.union(extra) if extra is not None else found


def simhash_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, **plan) -> DataFrame:
    """(id_col, fp, component_id) for every row: classes of texts whose fingerprints link, named by their least id.

    Rows with one fingerprint are one node, so copies are never paired. Null and blank texts have fingerprint zero and
    link like any other; long texts are read whole. Rows without an id keep a fingerprint; they do not name a component
    unless no row of it has an id, and then the name is null. Repeated ids are kept row by row. Other columns are
    dropped. Empty tables give none. Copies and components with a large share of all rows stay spread over tasks.
    """
    docs = stored(fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", "fp", width).select("doc_id", "fp"), "fingerprints")
    classes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    found = stored(components(links(classes.select("fp"), radius, **plan)), "components")
    rooted = stored(classes.join(found.hint("merge"), classes.fp == found.node, "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "least")
    named = stored(with_key_values(rooted, least, "root", rooted.count()).select("fp", "component_id", F.col("copies").alias("n")), "named")
    return with_key_values(docs, named, "fp", docs.count()).select(F.col("doc_id").alias(id_col), "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
