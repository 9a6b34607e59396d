import random

from pyspark.sql import functions as F

from stavelake import sources as S
from stavelake.operators import excerpts, validate


def score(rng, bars=9):
    """Two staves in one part: meters and clefs change, are repeated, and some bars are silent."""
    out, beats, change = ["<score-partwise><part-list><score-part id='P1'><part-name>A</part-name></score-part></part-list><part id='P1'>"], 4, True
    state = []
    for b in range(1, bars + 1):
        out.append(f"<measure number='{b}'>")
        if b == 1:
            out.append("<attributes><divisions>2</divisions><key><fifths>1</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time><staves>2</staves><clef number='1'><sign>G</sign><line>2</line></clef><clef number='2'><sign>F</sign><line>4</line></clef></attributes>")
            clef = "F"
        elif rng.random() < 0.6:
            beats, clef = rng.choice([3, 4]), rng.choice("FG")
            out.append(f"<attributes><time><beats>{beats}</beats><beat-type>4</beat-type></time><clef number='2'><sign>{clef}</sign><line>4</line></clef></attributes>")
        if b == 1 or rng.random() < 0.8:
            out.append(f"<note><pitch><step>C</step><octave>4</octave></pitch><duration>{2 * beats}</duration><staff>1</staff></note><backup><duration>{2 * beats}</duration></backup><note><rest/><duration>{2 * beats}</duration><staff>2</staff></note>")
            sounds = True
        else:
            out.append(f"<forward><duration>{2 * beats}</duration></forward>")
            sounds = False
        state.append((b, beats, clef, sounds))
        out.append("</measure>")
    return "".join(out) + "</part></score-partwise>", state


def in_force(df):
    """Meter and second clef at each note of an excerpt, by its own blocks alone."""
    rows = excerpts.with_state(df).where("tag = 'note' and staff = 1").select("doc_id", "measure_ord", "before.*").collect()
    return {(r.doc_id, r.measure_ord): (r.divisions, r.beats, r.fifths, r.staves, *[(c.staff, c.sign) for c in r.clefs]) for r in rows}


def test_excerpts_of_any_range_keep_what_is_in_force(spark):
    rng = random.Random(4)
    made = {f"d{i}": score(rng) for i in range(6)}
    raw = S.shred_texts(spark.createDataFrame([(d, t) for d, (t, _) in made.items()] + [("bad", "<a")], "doc_id string, text string")).persist()
    for lo, hi in ((1, 9), (1, 1), (4, 9), (3, 5), (9, 20)):
        cut = excerpts.excerpt_events(raw, lo, hi).persist()
        want = {(d, b - lo): (2, beats, 1, 2, (1, "G"), (2, clef)) for d, (_, state) in made.items() for b, beats, clef, sounds in state if lo <= b <= hi and sounds}
        assert in_force(cut) == want
        assert [r.check for r in validate.validate(cut, [validate.missing_context, validate.undeclared_staff, validate.bar_fit, validate.late_attributes]).collect()] == []
        blocks = cut.where("tag = 'attributes'").groupBy("doc_id").count().collect()
        changes = {d: 1 + sum((a[1], a[2]) != (b[1], b[2]) for a, b in zip(own, own[1:])) for d, (_, state) in made.items() if (own := [s for s in state if lo <= s[0] <= hi])}
        assert {r.doc_id: r["count"] for r in blocks} == changes
        assert cut.where("seq = 0 and measure_ord = 0 and tag = 'attributes' and measure_label = '1'").count() == len(made)
    assert excerpts.excerpt_events(raw, 50, 60).count() == 0 and cut.dtypes == raw.dtypes


def test_cleaned_fragments(spark):
    rng = random.Random(5)
    made = {f"d{i}": score(rng) for i in range(6)}
    raw = S.shred_texts(spark.createDataFrame([(d, t) for d, (t, _) in made.items()], "doc_id string, text string"))
    want = {(d, k): (2, beats, 1, 2, (1, "G"), (2, clef)) for d, (_, state) in made.items() for k, (_, beats, clef, _) in enumerate(s for s in state if s[3])}
    clean = excerpts.clean_events(raw)
    assert in_force(clean) == want
    assert clean.groupBy("doc_id", "measure_ord").agg(F.max((F.col("tag") == "note").cast("int")).alias("n")).where("n = 0").count() == 0


def test_repeated_blocks_go(spark):
    block = "<attributes><divisions>1</divisions><clef><sign>G</sign><line>2</line></clef></attributes>"
    text = f"<s><part id='a'><measure number='1'>{block}{block}<note/>{block.replace('G', 'F')}</measure><measure number='2'>{block.replace('G', 'F')}<note/>{block}</measure></part></s>"
    raw = S.shred_texts(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert [(r.measure_ord, r.seq) for r in excerpts.change_points(raw).where("tag = 'attributes'").orderBy("measure_ord", "seq").collect()] == [(0, 0), (0, 3), (1, 2)]
