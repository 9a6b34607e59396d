import gzip
import io
import random
from collections import Counter
from hashlib import sha1

import duckdb
import pyarrow.fs as pafs

import corpus_pipeline
from stavelake.llm import warc as W
from stavelake.llm.common import shared_dir


def test_warc_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = Counter(c.sql(W.OP6_SQL).fetchall())
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in W.op6_warc(spark, sf).select(*cols).collect()) == want


def test_odd_pages_round_trip(spark):
    big = "é" * 600
    pages = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n" * 300), (None, "u", "x"), (7, "u", "short"), (8, "u", "short"), (9, "u", "y" * 3_000_000)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in W.archive_pages(df).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), sha1(raw).hexdigest())
        assert got[i].payload == (None if i in (1, 2) else raw)
    assert {i: got[i].refers_to for i in (1, 2, 3, 7, 8)} == {1: 3, 2: 3, 3: None, 7: None, 8: None}
    assert W.archive_pages(df.where("false")).count() == 0


def test_repeated_pages_and_bombs(spark):
    """Repeated rows give a record each; a payload of repeated bytes is inflated in steps."""
    big, huge = "z" * 2000, "ab" * 8_000_000
    rows = [(1, "u", big), (1, "u", big), (2, "u", big), (2, "u", big), (3, "u", huge), (None, "u", big)]
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter({(1, "revisit", 2, 2000): 2, (2, "response", None, 2000): 2, (3, "response", None, 16_000_000): 1, (None, "revisit", 2, 2000): 1})
    stream = W.Inflated(io.BytesIO(gzip.compress(b"\0" * 50_000_000)))
    assert stream.more() and len(stream.held) <= W.READ and len(stream.exactly(50_000_000)) == 50_000_000 and not stream.more()


def test_normaliser_takes_members_and_whole_streams(spark):
    folder = f"{shared_dir(spark)}/mixed"
    fs, root = W.open_fs(folder)
    fs.create_dir(root, recursive=True)
    one, two = (W.record(i, "u", b"p" * i, sha1(b"p" * i).hexdigest(), None) for i in (10, 20))
    with fs.open_output_stream(f"{root}/x.warc.gz", compression=None) as f:
        f.write(gzip.compress(one + two) + gzip.compress(one))
    index = W.normalise(spark.createDataFrame([(f"{root}/x.warc.gz",)], "path string"), f"{folder}/out").collect()
    assert [r.record for r in index] == [0, 1, 2] and index[1].offset == index[0].size
    raw = fs.open_input_file(index[0].path).read()
    assert [gzip.decompress(raw[r.offset : r.offset + r.size]) for r in index] == [one, two, one]
    assert isinstance(fs, pafs.LocalFileSystem)


def test_pipeline_stage_by_stage(spark, sf, docs):

    from stavelake.llm.quality import RULES, Text
    from stavelake.llm.secrets import base_spans
    from stavelake.llm.simhash import fingerprint

    kept = docs
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= before
        if name == "language_id":
            assert all(any(map(str.isalpha, r.text)) for r in rows)
        if name == "quality_rules":
            for r in kept.collect():
                t = Text(r.text)
                good = t.n_words >= 50 and 2 * t.n_repeat_words <= t.n_words and not any(rule(t) for rule in RULES.values())
                assert (r.doc_id in ids) == good
        if name == "simhash_near_dedup":
            fps = {r.doc_id: fingerprint(r.text) for r in kept.collect()}
            assert len({fps[i] for i in ids}) == len(ids)
            assert all(any((fps[i] ^ fps[j]).bit_count() <= 4 for j in fps if j != i) for i in before - ids)
            assert not any((fps[i] ^ fps[j]).bit_count() <= 4 for i in ids for j in ids if i < j)
        if name == "secret_scans":
            assert ids == before and all(not base_spans(r.text) and r.n_chars == len(r.text) for r in rows)
        kept, before = spark.createDataFrame(rows, docs.schema), ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in pieces.collect()} == before
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_near_copies_with_repeated_and_missing_ids(spark):
    def prose(name, n=120):
        return " ".join(f"{name}{(i * i) % 97}" for i in range(n))

    a, b, c, d, e, f = map(prose, ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"])
    near = c + " "  # blanks leave the fingerprint as it is
    rows = [
        (1, a), (1, b),  # one id, unrelated texts: both stay
        (3, c), (5, d), (5, near),  # a row of a repeated id copies another document
        (None, c), (None, e), (None, e + " "), (None, e), (None, None), (None, ""),  # copies among rows without an id
        (7, f), (7, f), (7, f),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, row string")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text and r.text.strip(), r.fp, r.row) for r in out.collect()]
    assert Counter(x[:2] for x in got if x[1]) == Counter([(1, a), (1, b), (3, c), (5, d), (None, e), (7, f)])
    assert sum(not x[1] for x in got) == 1 and {x[2:] for x in got} == {("x", "y")}
    assert corpus_pipeline.drop_near_copies(spark, df.where("false"), "").count() == 0


def test_stages_on_odd_tables(spark, sf):
    """Nulls, empty, blank and long texts, repeats, missing ids, extra columns that clash, and empty tables."""
    rng = random.Random(5)
    words = [w for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").limit(40).collect() for w in r.text.split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c = prose(150), prose(150), prose(20_000)
    texts = [(1, a), (1, b), (2, a + " "), (2, None), (3, ""), (4, " \n"), (None, c), (None, c), (None, None), (5, prose(90) + " token = 'q1w2e3r4t5y6u7i8'"), (5, prose(90))]
    df = spark.createDataFrame([(i, t, "en" if n % 2 else None, n, n, "y", n, n, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, n_chars long, Kept long, FP string, row long, may_go long, clean_text long")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == df.columns and stage(spark, df.where("false"), sf).count() == 0 and stage(spark, df.where("text is null"), sf).count() <= 4, name
        rows = out.collect()
        assert all(r.FP == "y" and r.Kept == r.row == r.may_go == r.clean_text for r in rows)
        docs = spark.createDataFrame(rows, df.schema)
    got = Counter((r.doc_id, r.text.split()[0]) for r in docs.collect())
    assert got == Counter((i, t.split()[0]) for i, t in ((1, a), (1, b), (None, c), texts[9], texts[10]))
    assert not any("q1w2e3r4t5y6u7i8" in r.text for r in docs.collect())
    for table in (docs, df):
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
        assert sum(r.start == 0 for r in pieces) == table.count()
    assert corpus_pipeline.STAGES[-1][1](spark, df.where("false"), sf).count() == 0
