"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WORDS = 8  # 64-bit words in a block: one cache line
MOST_BITS = 1 << 29
MOST_LISTED = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path: after the first `://`; both empty if there is none or the URL is null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 64-bit hash, four words of its block and the bit to look at in each."""
    h = h.astype(np.int64).view(np.uint64)
    base = (h % np.uint64(blocks)) * np.uint64(WORDS)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    shifts = np.uint64(9) * np.arange(4, dtype=np.uint64) + np.uint64(24)
    nine = (mixed[:, None] >> shifts) & np.uint64(511)
    return base[:, None] + (nine >> np.uint64(6)), np.uint64(1) << (nine & np.uint64(63))


def bloom_words(hashes: DataFrame, n: int, bits_each: int = 16) -> np.ndarray:
    """The filter's words for a column `h` of hashes of n keys. Its size is bounded by MOST_BITS, whatever the list's.

    Tasks set bits in their own part and Spark merges the words with bit_or; only set words come to the driver.
    """
    bits = min(MOST_BITS, max(1, n) * bits_each)
    blocks = -(-bits // (64 * WORDS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words, masks = _places(f["h"].to_numpy(), blocks)
            yield pd.DataFrame({"w": words.ravel().astype(np.int64), "m": masks.ravel().view(np.int64)})

    set_words = hashes.select("h").mapInPandas(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    words = np.zeros(blocks * WORDS, np.uint64)
    words[set_words["w"].to_numpy(np.int64)] = set_words["m"].to_numpy(np.int64).view(np.uint64)
    return words


def may_contain(spark: SparkSession, words: np.ndarray):
    """Arrow function from hashes to whether the filter may hold them; there are no false negatives."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        words = shared.value
        at, masks = _places(h.to_numpy(), len(words) // WORDS)
        return pd.Series((words[at] & masks == masks).all(axis=1))

    return test


def those_it_may_contain(spark: SparkSession, words: np.ndarray):
    """As `may_contain`, from an array of hashes to an array of those that the filter may hold."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<long>")
    def test(hs: pd.Series) -> pd.Series:
        words, sizes = shared.value, hs.map(len).to_numpy(np.int64)
        h = np.concatenate([np.empty(0, np.int64), *hs])
        at, masks = _places(h, len(words) // WORDS)
        hit = (words[at] & masks == masks).all(axis=1)
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes)))
        return pd.Series(np.split(h[hit], ends[:-1]) if len(sizes) else [], index=hs.index, dtype=object)

    return test


#: A URL's key for each shape (labels of host, characters of path) in the list that it has room for.
KEYS = """filter(transform(shapes, s -> if(size(split(host, '[.]', -1)) >= s.labels and length(path) >= s.chars,
  named_struct('labels', s.labels, 'chars', s.chars, 'key', concat(substring_index(host, '.', -s.labels), substring(path, 1, s.chars))), null)), k -> k is not null)"""


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row: the longest listed host and path prefix that fits, or `default`.

    `rules` has host, path and verdict. A rule fits its host and all subdomains when the path starts with the rule's.
    Each URL gives one key for every shape in the list, at most one for each label count and path length; the Bloom
    filter passes possible hits. A URL without one gets `default` where it is and moves nowhere; the others meet the
    list in an exact join on the key, which drops the false hits, and the longest rule of each row is taken by its row
    number. Up to MOST_LISTED rules are broadcast; a longer list is joined by shuffle, where skewed keys are split by AQE.
    Null or odd URLs have empty host and path and get `default`; long ones are read whole. Repeated rows are judged
    each; a rule listed twice counts once, `block` before `allow`. Other columns are dropped. Empty tables give none.
    """
    spark = pages.sparkSession
    labels = F.size(F.split("host", r"[.]", -1))
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null")
    listed = rules.groupBy(F.concat("host", "path").alias("key"), labels.alias("labels"), F.length("path").alias("chars")).agg(F.max("verdict").alias("verdict"))
    listed = listed.withColumn("h", F.xxhash64("key"))
    n = listed.count()
    passed = those_it_may_contain(spark, bloom_words(listed, n))
    shapes = listed.agg(F.array_sort(F.collect_set(F.struct("labels", "chars"))).alias("shapes"))
    host, path = host_path(F.col(url))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    keyed = base.join(F.broadcast(shapes)).select("id", "row", "host", "path", F.expr(KEYS).alias("keys"))
    keyed = keyed.withColumn("passed", passed(F.transform("keys", lambda k: F.xxhash64(k.key))))
    cols = ["id", "host", "path"]
    none = keyed.where(F.size("passed") == 0).select(*cols, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    tried = keyed.where(F.size("passed") > 0).select("row", *cols, F.explode(F.filter("keys", lambda k: F.array_contains("passed", F.xxhash64(k.key)))).alias("k"))
    tried = tried.select("row", *cols, "k.labels", "k.chars", "k.key")
    exact = listed.select("labels", "chars", "key", "verdict")
    hits = tried.join(F.broadcast(exact) if n <= MOST_LISTED else exact, ["labels", "chars", "key"], "left").withColumn("rule", F.when(F.col("verdict").isNotNull(), F.col("key")))
    best = hits.groupBy("row").agg(*[F.first(c).alias(c) for c in cols], F.max(F.struct(F.length("rule").alias("size"), F.col("rule"), F.col("verdict"))).alias("b"))
    out = none.unionByName(best.select(*cols, F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP3_SQL = """
with r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
c as (select row_number() over () as n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
d as (select c.*, r.h || r.p as rule, r.v, row_number() over (partition by n order by length(r.h || r.p) desc nulls last) as k
  from c left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from d where k = 1
"""
