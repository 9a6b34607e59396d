import json
import os
import random
import subprocess
import sys
import time
from collections import Counter
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from stavelake import sources as S
from stavelake.sources import files


def score(rng, parts=2, bars=3, notes=4):
    """A score with most of what a reader can meet: several attribute blocks, chords, backups, odd numbers, late names."""
    out = ["<?xml version='1.0'?><!-- c --><score-partwise><work><note/></work><part-list>"]
    out += [f"<score-part id='P{i}'>" + rng.choice(["<part-name>Voice &amp; more</part-name>", "<part-name/><part-abbreviation>V.</part-abbreviation>", ""]) + "</score-part>" for i in range(parts - 1)]
    out += ["</part-list>"]
    for i in range(parts):
        out.append(f"<part id='P{i}'>")
        for b in range(bars):
            out.append(f"<measure number='{b + 1}'>")
            if rng.random() < 0.6:
                out.append(f"<attributes><divisions>{rng.choice(['4', '--5', ' 12 ', ''])}</divisions><key><fifths>-2</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time><staves>2</staves><clef number='{rng.choice(['1', 'x'])}'><sign>G</sign><line>2</line></clef></attributes>")
            for _ in range(rng.randint(0, notes)):
                out.append(rng.choice([
                    "<note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration><voice>2</voice><type>quarter</type><dot/><staff>2</staff><notations><slur type='start'/></notations></note>",
                    "<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>4</duration><tie type='start'/></note>", "<note><rest/><duration>2</duration></note>", "<backup><duration>4</duration></backup>",
                    "<forward><duration>1</duration></forward>", "<note><time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification></note>", "<direction><words>dolce\n</words></direction>", "<barline/>"]))
            out.append("</measure>")
        out.append("</part>")
    out.append("<part-list><score-part id='P0'><part-name>Named late</part-name></score-part></part-list></score-partwise>")
    return "".join(out)


def plain(rows):
    return Counter(json.dumps({k: v for k, v in r.items() if v is not None}, sort_keys=True) for r in rows)


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_events_in_steps_equal_whole_documents(monkeypatch, step):
    monkeypatch.setattr(files, "STEP", step)
    rng = random.Random(step)
    texts = [score(rng) for _ in range(20)] + ["<a><part id='x'><measure/></part></a>", "", "<a", "<score><part><measure><note></measure></part></score>", "<a>&nope;</a>"]
    for text in texts:
        raw = text.encode()
        assert plain(files.score_events(lambda: BytesIO(raw), "d", set(S.ARROW.names))) == plain(S.shred("d", raw))


def test_score_format_in_batches(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "in/book").mkdir(parents=True)
    texts = {f"p{i}": score(rng) for i in range(25)} | {"bad": "<a><b></a>"}
    for name, text in texts.items():
        (tmp_path / f"in/book/{name}.musicxml").write_text(text)
    (tmp_path / "in/_temporary").mkdir()
    (tmp_path / "in/_temporary/x.xml").write_text("<a/>")
    raw = S.read_scores(spark, f"{tmp_path}/in")
    want = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    ordered = lambda df: Counter(json.dumps(r.asDict(True)) for r in df.select(*S.ARROW.names).collect())
    assert ordered(raw) == ordered(S.shred_texts(want)) == ordered(S.read_stored_scores(spark, f"{tmp_path}/in/book"))
    assert ordered(S.read_scores(spark, f"file://{tmp_path}/in")) == ordered(raw)
    few = S.read_scores(spark, f"{tmp_path}/in", "tag string, doc_id string, seq int")
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, raw.select("tag", "doc_id", "seq").collect())) and few.columns == ["tag", "doc_id", "seq"]
    split = spark.read.format("scores").option("splitBytes", 2000).load(f"{tmp_path}/in")
    assert split.rdd.getNumPartitions() > 5 and ordered(split) == ordered(raw)
    with pytest.raises(Exception, match="nowhere"):
        S.read_scores(spark, f"{tmp_path}/nowhere").count()


def test_partitions_follow_sizes(tmp_path):
    for i, n in enumerate([10, 10, 500, 10, 90, 900, 0]):
        (tmp_path / f"f{i}").write_bytes(b"x" * n)
    made = files.dealt(files.listed(str(tmp_path))[1], 100)
    assert [[p[-2:] for p in x.paths] for x in made] == [["f5"], ["f2"], ["f0", "f1", "f3"], ["f4", "f6"]]
    assert files.dealt([], 100) == []


def test_score_format_as_a_stream(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "in").mkdir()
    seen = []
    for batch in range(3):
        for i in range(4):
            (tmp_path / f"in/p{batch}{i}.xml").write_text(score(rng))
        seen.append(S.read_scores(spark, f"{tmp_path}/in").count())
        q = S.stream_scores(spark, f"{tmp_path}/in", settle_seconds=0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == seen[-1]
    key = lambda df: Counter((r.doc_id, r.part_idx, r.measure_ord, r.seq, r.tag) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(S.read_scores(spark, f"{tmp_path}/in"))
    young = files.FolderStream({"path": f"{tmp_path}/in", "settleSeconds": "3600"}, None, None)
    assert young.latestOffset() == young.initialOffset()
    at = files.FolderStream({"path": f"{tmp_path}/in", "settleSeconds": "0"}, None, None)
    low, high = at.initialOffset(), at.latestOffset()
    again = [[p.paths for p in at.partitions(low, high)] for _ in range(2)]
    (tmp_path / "in/late.xml").write_text("<a/>")
    os.utime(tmp_path / "in/late.xml", (time.time() + 1, time.time() + 1))
    assert again[0] == again[1] == [p.paths for p in at.partitions(low, high)] and at.partitions(high, high) == []


LARGE = """
import resource, sys
from stavelake.sources import files
n = 0
for row in files.score_events(lambda: open(sys.argv[1], "rb"), "d", {"tag", "duration_raw", "seq"}):
    n += 1
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_does_not_follow_the_file(tmp_path):
    """One measure of 100,000 notes, then one of 400,000: the second needs no more memory, though a tree of it has a hundred million bytes."""
    peaks = []
    for k in (100_000, 400_000):
        with open(tmp_path / "x.xml", "w") as f:
            f.write("<s><part id='P1'><measure number='1'>")
            for _ in range(k // 1000):
                f.write("<note><duration>4</duration></note>" * 1000)
            f.write("</measure></part></s>")
        done = subprocess.run([sys.executable, "-c", LARGE, str(tmp_path / "x.xml")], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
        n, peak = map(int, done.stdout.split())
        assert n == k
        peaks.append(peak)
    assert peaks[1] < peaks[0] + 20


def log_symbols(text):
    """By the rule: whatever lies between the first opening mark and the last closing one, in pieces at commas."""
    import re

    m = re.search(r"Writing XML\s*\[\[(.*)\]\]", text, re.DOTALL)
    out = []
    for piece in m[1].split(",") if m else []:
        f = piece.split()
        if len(f) >= 5:
            out.append((f[0], f[1] if len(f) > 5 else "_", *f[-4:]))
    return out


@pytest.mark.parametrize("step", [1, 3, 50, 1 << 20])
def test_recogniser_logs(monkeypatch, step):
    monkeypatch.setattr(files, "STEP", step)
    rng = random.Random(step)
    parts = ["Writing XML", " ", "\n", "[[", "]]", "]", "note_8 B4 b _ _ upper", "clef_G2 _ _ _ _ upper", "rest _ _ _ lower", ",", "x y", "Writing XML [[", "a b c d e f g h"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got = [(r["symbol"], r["pitch"], r["lift"], r["articulation"], r["slur"], r["position"]) for r in files.symbols(lambda: BytesIO(text.encode()), "d", set())]
        assert got == log_symbols(text), text


def test_recogniser_log_format(spark, tmp_path):
    (tmp_path / "s1.log").write_text("noise\nWriting XML [[clef_G2 _ _ _ _ upper, note_8 B4 b _ _ upper,\n short, rest_4 _ _ _ _ upper]]\nbye")
    (tmp_path / "s2.log").write_text("nothing here [[a b c d e]]")
    rows = [tuple(r) for r in S.read_recogniser_logs(spark, str(tmp_path)).orderBy("n").collect()]
    assert rows == [("s1", 0, "clef_G2", "_", "_", "_", "_", "upper"), ("s1", 1, "note_8", "B4", "b", "_", "_", "upper"), ("s1", 2, "rest_4", "_", "_", "_", "_", "upper")]
    q = S.stream_recogniser_logs(spark, str(tmp_path), 0).writeStream.format("memory").queryName("logs").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.table("logs").count() == 3


def test_layout_records_of_two_places(spark, tmp_path):
    staff = {"y_top": 10.5, "y_bot": 30, "y_center": 20, "x0": 1, "x1": 90, "n_lines": 5, "ys": [1], "spacing": 5.0, "spread": 0, "resid": 0, "width": 89}
    record = lambda n: json.dumps({"page": "any", "n_staves": n, "n_systems": 1, "grouping": [n], "staff_space": 5.0, "staves": [staff] * n}, indent=2)
    (tmp_path / "b1/homr").mkdir(parents=True)
    (tmp_path / "b2").mkdir()
    (tmp_path / "b1/p0001.boxes.json").write_text(record(3))
    (tmp_path / "b1/homr/p0001.boxes.json").write_text(record(9))
    (tmp_path / "b1/homr/p0002.boxes.json").write_text(record(2))
    (tmp_path / "b1/p0003.boxes.json").write_text("{broken")
    (tmp_path / "b1/homr/p0003.boxes.json").write_text(record(4))
    (tmp_path / "b2/p0001.boxes.json").write_text('{"n_systems": 2}')
    (tmp_path / "b2/other.json").write_text(record(7))
    layout = S.read_boxes(spark, str(tmp_path))
    got = {(r.folder[-2:], r.page): (r.n_staves, r.n_systems, r.grouping) for r in layout.collect()}
    assert got == {("b1", "p0001"): (3, 1, [3]), ("b1", "p0002"): (2, 1, [2]), ("b2", "p0001"): (None, 2, None)}
    staves = S.layout_staves(layout).where("page = 'p0002'").orderBy("staff").collect()
    assert [(r.staff, r.y_top, r.x1, r.n_lines) for r in staves] == [(1, 10.5, 90, 5), (2, 10.5, 90, 5)]
    assert {r.page: r.n for r in S.layout_counts(layout.where(F.col("folder").endswith("b1"))).collect()} == {"p0001": 3, "p0002": 2}
    assert {r.n for r in S.layout_counts(layout, "n_systems").collect()} == {1, 2}
