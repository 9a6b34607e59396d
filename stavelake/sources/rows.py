"""Columns of raw events, and those of one event's element."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

EVENT = """doc_id string, part_idx int, part_id string, part_name string, measure_ord int, measure_label string, seq int, tag string,
duration_raw int, type string, dots int, is_chord boolean, is_rest boolean, staff int, voice int, step string, alter_raw string, octave int,
tie string, slur string, tup_actual int, tup_normal int, divisions int, beats int, beat_type int, fifths int, staves int,
clefs array<struct<staff:int,sign:string,line:int>>, error string, declared boolean, children array<string>"""

#: Columns that need a look inside a note, or another event but attributes.
OF_NOTE = set("duration_raw type dots is_chord is_rest staff voice step alter_raw octave tie slur tup_actual tup_normal children".split())
#: Children of a note whose own children are columns.
NESTED = {"pitch", "notations", "time-modification"}
INT = re.compile(r"\s*(-?[0-9]{1,9})\s*")


def whole(text: str | None) -> int | None:
    """A whole number of up to nine digits; null for anything else."""
    found = INT.fullmatch(text or "")
    return int(found[1]) if found else None


def _int(node: ET.Element, path: str) -> int | None:
    return whole(node.findtext(path))


def event_fields(e: ET.Element) -> dict:
    """Columns of one child of a measure, by its tag."""
    if e.tag == "attributes":
        clefs = [{"staff": whole(c.get("number")) or 1, "sign": c.findtext("sign"), "line": _int(c, "line")} for c in e.findall("clef")]
        own = {"divisions": _int(e, "divisions"), "beats": _int(e, "time/beats"), "beat_type": _int(e, "time/beat-type"), "fifths": _int(e, "key/fifths"), "staves": _int(e, "staves"), "clefs": clefs}
        return own | {"children": [c.tag for c in e]}
    if e.tag != "note":
        return {"duration_raw": _int(e, "duration")}
    # One walk over the children: a path search for each column costs several times as much.
    first: dict[str, ET.Element] = {}
    inner: dict[tuple[str, str], ET.Element] = {}
    children = [c.tag for c in e]
    for tag, c in zip(children, e):
        first.setdefault(tag, c)
        if tag in NESTED:
            for x in c:
                inner.setdefault((tag, x.tag), x)
    text = lambda nodes, name: (nodes[name].text or "") if name in nodes else None
    kind = lambda nodes, name: nodes[name].get("type") if name in nodes else None
    return {
        "duration_raw": whole(text(first, "duration")), "type": text(first, "type"), "dots": children.count("dot"), "is_chord": "chord" in first, "is_rest": "rest" in first,
        "staff": whole(text(first, "staff")) or 1, "voice": whole(text(first, "voice")) or 1, "step": text(inner, ("pitch", "step")), "alter_raw": text(inner, ("pitch", "alter")), "octave": whole(text(inner, ("pitch", "octave"))),
        "tie": kind(first, "tie"), "slur": kind(inner, ("notations", "slur")), "tup_actual": whole(text(inner, ("time-modification", "actual-notes"))), "tup_normal": whole(text(inner, ("time-modification", "normal-notes"))),
        "children": children,
    }
