from collections import Counter

import duckdb
import numpy as np
import pytest

from stavelake.llm.quality import COLUMNS, OP4_SQL, RULES, Text, judge_quality, op4_quality, rule_order
from stavelake.llm.topk import OP2_SQL, op2_top_k, top_k, weighted_terms, whole_vector
from stavelake.llm.url_filter import OP3_SQL, bloom_words, judge_urls, may_contain, op3_url_filter
from pyspark.sql import functions as F


def duck(sf, sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return Counter(tuple(r) for r in c.sql(sql).fetchall())


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_top_k_against_sql(spark, sf):
    assert rows(op2_top_k(spark, sf), "query_id", "rank", "vec_id", "score") == duck(sf, OP2_SQL, "embeddings")


@pytest.mark.parametrize("top", [3, 2**40])
def test_top_k_against_brute_force(spark, top):
    rng = np.random.default_rng(5)
    vecs = {i: [int(x) if rng.random() < 0.5 else 0 for x in rng.integers(-top, top, 6)] for i in range(300)}
    df = spark.createDataFrame(list(vecs.items()), "vec_id long, w array<long>")
    terms = weighted_terms(df, "vec_id", F.col("w"))
    got = rows(top_k(terms.where("vec_id % 50 = 0"), terms, 5, query_rows=4, cand_rows=64), "query_id", "rank", "vec_id", "score")
    want = Counter()
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in range(0, 300, 50):
        best = sorted(((clip(sum(a * b for a, b in zip(vecs[q], v))), -i) for i, v in vecs.items() if i != q), reverse=True)[:5]
        want.update((q, k + 1, -i, s) for k, (s, i) in enumerate(best))
    assert got == want


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [2.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    good = weighted_terms(df.where(whole_vector(F.col("embedding"))), "vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    assert rows(top_k(good.where("vec_id = 0"), good), "query_id", "rank", "vec_id", "score") == Counter([(0, 1, 6, 256 * 512), (0, 2, 5, 0)])
    assert top_k(good.where("false"), good).count() == 0 == top_k(good, good.where("false")).count()


def test_top_k_repeated_ids_against_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows_ = [(int(i), [float(x) for x in rng.integers(-3, 4, 4)]) for i in [0, 0, 0, 50, 50, 7, 7, *range(1, 40), *[8] * 30]] + [(None, [1.0] * 4), (3, None), (0, [1.0, None, 0.0, 0.0])]
    spark.createDataFrame(rows_, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = rows(op2_top_k(spark, str(tmp_path)), "query_id", "rank", "vec_id", "score")
    assert got == Counter(c.sql(OP2_SQL).fetchall()) and sum(got.values()) == 25


def test_urls_against_sql(spark, sf):
    assert rows(op3_url_filter(spark, sf), "page_id", "host", "path", "rule", "verdict") == duck(sf, OP3_SQL, "pages")


def test_odd_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?y#z"), (4, "http://A.Example.ORG/es/x?y#z"), (5, "x://example.org?/es/"), (6, "http://notexample.org/es/"), (None, "http://org/"), (7, "http://org"), (8, "http://b.c.d.e.org/" + "p" * 50_000)]
    pages = spark.createDataFrame([(i, u, "n") for i, u in urls], "page_id long, url string, n string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in judge_urls(pages, rules).collect())
    assert got == Counter({
        (1, "", "", None, "allow"): 1, (2, "", "", None, "allow"): 1, (3, "", "", None, "allow"): 1, (4, "a.example.org", "/es/x", "example.org/es/", "block"): 2,
        (5, "example.org", "", None, "allow"): 1, (6, "notexample.org", "/es/", "org/", "allow"): 1, (None, "org", "/", "org/", "allow"): 1, (7, "org", "", None, "allow"): 1,
        (8, "b.c.d.e.org", "/pppppppp", "org/", "allow"): 1,
    })
    assert judge_urls(pages.where("false"), rules).count() == 0
    assert judge_urls(pages, rules.where("false")).count() == len(urls)


@pytest.mark.parametrize("most", [100_000, 10])
def test_long_lists_broadcast_or_not(spark, monkeypatch, most):
    """The same rows on either side of the bound; few URLs move, as most have no possible hit."""
    monkeypatch.setattr("stavelake.llm.url_filter.MOST_LISTED", most)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 97, F.lit(".net/a/b"), F.col("id") % 10, F.lit("/c")).alias("url"))
    rules = spark.range(60).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.expr("substring('/a/b3/c', 1, cast(1 + id % 7 as int))").alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    listed = {r.host: (r.path, r.verdict) for r in rules.collect()}
    want = Counter()
    for i in range(3000):
        host, path = f"h{i % 97}.net", f"/a/b{i % 10}/c"
        rule = listed.get(host, ("-", None))
        want[i, host, path, *((host + rule[0], rule[1]) if path.startswith(rule[0]) else (None, "allow"))] += 1
    assert rows(judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict") == want


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    test = may_contain(spark, bloom_words(keys, 5000))
    assert keys.where(test("h")).count() == 5000
    assert spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).where(test("h")).count() < 400


def brute(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.sub(r"[\x20\x09-\x0D]", "", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (*base, failed, not failed and not any(rule(Text(text)) for rule in RULES.values()))


def test_quality_against_brute_force(docs, odd, none):
    for df in (docs, odd):
        got = Counter(tuple(r) for r in judge_quality(df).select("doc_id", *[c.name for c in COLUMNS]).collect())
        assert got == Counter((r.doc_id, *brute(r.text)) for r in df.collect())
    assert judge_quality(none).count() == 0
    assert "lang" in judge_quality(odd).columns


def test_quality_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(op4_quality(spark, sf), *[x for x in ["doc_id", *[c.name for c in COLUMNS]]]) == duck(sf, OP4_SQL, "documents")


def test_each_rule_against_sql(spark, tmp_path):
    """Texts that one rule each rejects, and texts just inside its bound."""
    words = [f"{a}{b}{c}a" for a in "bcdfg" for b in "aeiou" for c in "klmn"]
    prose, join = " ".join(words), " ".join
    texts = [
        prose, join(f"{w} #" for w in words[:60]), join(f"{w}{' #' * (i % 4 == 0)}" for i, w in enumerate(words)), join(x * 20 for x in words), join("abcdefghijklmnopqrstuvwxyz"[i % 26] + "é" * (i // 26 % 3) for i in range(78)),
        "\n".join(join(words[:20]) for _ in range(4)), "\n".join(words * 2), join(f"{w} {i}" for i, w in enumerate(words)), join(f"{w}{f' {i}' * (i % 4 == 0)}" for i, w in enumerate(words)), "\n".join(f" - {w} {w[::-1]}" for w in words), "\n".join(f"• {w} {i}x" for i, w in enumerate(words)),
        "\n".join(f"{w} {w[::-1]}...  " for w in words), "\n".join(f"{w} {w[::-1]}{'…' * (i % 4 == 0)}" for i, w in enumerate(words)), prose.upper(), join(w.upper() if i % 3 == 0 else w for i, w in enumerate(words)), join(f"the {w}" for w in words), join(f"the {w} the" for w in words),
        None, "", " \n ", join(words[:49]), join(words[:50]), join(words[:30] * 2),
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(op4_quality(spark, str(tmp_path)), "doc_id", *[c.name for c in COLUMNS])
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(c.sql(OP4_SQL).fetchall())
    assert 6 <= sum(not r[6] and not r[7] for r in got) < sum(not r[6] for r in got)


def test_quality_agrees_with_labels(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = judge_quality(docs).groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((0, True), 0) == 0
    assert judge_quality(docs).where("quality = 1 and not base_failed and not kept").count() == 0


def test_rule_order_puts_cheap_rejecting_rules_first(spark):
    texts = [" ".join(f"w{i}x{j}" for i in range(60)) + (" ###" if j % 2 else "") for j in range(60)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *["short"] * 500]], "text string")
    slow = lambda t: sum(i * i for i in range(20_000)) < 0
    short = lambda t: t.n_words < 10
    same, other = (lambda t: "###" in t.text), (lambda t: "w1x4 " in t.text)
    # the base rejects what `short` would; `copy` has nothing left once `marks` went
    assert rule_order(docs, {"slow": slow, "short": short, "copy": lambda t: same(t) and sum(range(2000)), "other": other, "marks": same})[:2] == ["marks", "other"]
