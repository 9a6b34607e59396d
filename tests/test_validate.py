from collections import Counter

from stavelake import sources as S
from stavelake.operators import validate as V

HEAD = "<attributes><divisions>1</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>"


def doc(*measures):
    return "<score-partwise><part-list><score-part id='P1'/></part-list><part id='P1'>" + "".join(f"<measure number='{i + 1}'>{m}</measure>" for i, m in enumerate(measures)) + "</part></score-partwise>"


def note(duration, extra=""):
    return f"<note><pitch><step>C</step><octave>4</octave></pitch><duration>{duration}</duration>{extra}</note>"


def test_checks_on_small_scores(spark, tmp_path):
    texts = {
        "good": doc(HEAD + note(4), note(2) + note(2)),
        "short": doc(HEAD + note(3), note(5)),
        "late": doc(note(4) + HEAD),
        "staff": doc(HEAD + note(4, "<staff>2</staff>")),
        "two": doc(HEAD.replace("</time>", "</time><staves>2</staves>") + note(4, "<staff>2</staff>")),
        "back": doc(HEAD + note(2) + "<backup><duration>3</duration></backup>" + note(5)),
        "bare": doc(HEAD + "<note><duration>4</duration></note>"),
        "tuplet": doc(HEAD + note(4, "<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification>")),
        "slur": doc(HEAD + note(4, "<notations><slur type='start'/></notations>")),
        "stray": doc(HEAD + note(4)).replace("<part id='P1'>", "<part id='P2'>"),
        "order": doc(HEAD + "<note><duration>4</duration><pitch><step>C</step><octave>4</octave></pitch></note>"),
        "broken": "<score",
        "empty": doc(HEAD),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text)
    raw = S.read_scores(spark, str(tmp_path))
    found = V.validate(raw)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, Counter())[r.check] += 1
    assert {k: set(v) for k, v in got.items()} == {
        "short": {"bar_short", "bar_overflow"}, "late": {"missing_context", "late_attributes"}, "staff": {"undeclared_staff"}, "back": {"backup_overshoot"},
        "bare": {"bare_note"}, "tuplet": {"untyped_tuplet"}, "slur": {"slur_balance"}, "broken": {"parse_error"}, "empty": {"no_notes", "bar_short"}, "stray": {"undeclared_part"}, "order": {"child_order"},
    }
    assert tuple(V.validity_rate(found, raw).first()) == (13, 11, 2)
    folded = Counter((r.doc_id, r.check, r.detail) for r in found.collect())
    assert {(r.doc_id, r.check, r.detail): r.n for r in V.collapse(found).collect()} == folded
    assert {r.n for r in V.collapse(found.union(found)).collect()} == {2}
