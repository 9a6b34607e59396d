import random
import re

import pytest
from pyspark.sql import functions as F

from stavelake import sources as S
from stavelake.operators import validate


def faults(spark, model, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "i int, children array<string>")
    return {r.i: r.f for r in df.select("i", validate.model_fault(F.col("children"), validate.MODELS[model]).alias("f")).collect()}


@pytest.mark.parametrize("model", list(validate.MODELS))
def test_against_a_regular_expression(spark, model):
    """A list fits exactly if the expression of the model matches it."""
    rng = random.Random(len(model))
    slots = validate.MODELS[model]
    pattern = "".join(f"(?:(?:{'|'.join(names.split())}) ){{{low},{'' if high is None else high}}}" for names, low, high in slots)
    names = [x for n, _, _ in slots for x in n.split()] + ["foreign"]
    lists = []
    for _ in range(300):
        own = [rng.choice(n.split()) for n, low, high in slots for _ in range(rng.choice([low, low, low, min(high or 3, 2)]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            how = rng.randint(0, 2)
            if how == 0:
                own.insert(rng.randint(0, len(own)), rng.choice(names))
            elif own and how == 1:
                own.pop(rng.randrange(len(own)))
            else:
                rng.shuffle(own)
        lists.append(own)
    got = faults(spark, model, lists)
    want = {i: bool(re.fullmatch(pattern, "".join(f"{x} " for x in own))) for i, own in enumerate(lists)}
    assert {i: f is None for i, f in got.items()} == want and len(set(want.values())) == 2


def test_faults_in_words(spark):
    lists = [["pitch", "duration", "tie", "voice"], ["tie", "pitch", "duration"], ["pitch", "duration", "type", "voice"], ["duration"], ["pitch", "rest", "duration"], ["chord", "pitch"], [], ["pitch", "duration", "x"]]
    assert faults(spark, "note", lists) == {0: None, 1: "no pitch or unpitched or rest", 2: "voice too late", 3: "no pitch or unpitched or rest", 4: "too many rest", 5: "no duration", 6: "no pitch or unpitched or rest", 7: "a foreign x"}
    assert faults(spark, "grace", [["grace", "pitch"], ["grace", "pitch", "duration"]]) == {0: None, 1: "a foreign duration"}
    assert faults(spark, "cue", [["cue", "pitch", "duration"], ["cue", "pitch", "duration", "tie"]]) == {0: None, 1: "a foreign tie"}
    assert faults(spark, "attributes", [["divisions", "clef", "clef"], ["clef", "staves"], []]) == {0: None, 1: "staves too late", 2: None}


def test_notes_and_attributes_of_texts(spark):
    text = "<score-partwise><part-list/><part id='a'><measure number='1'><attributes><clef/><staves>2</staves></attributes><note><grace/><pitch/></note><note><rest/></note><note><cue/><rest/><duration>1</duration></note><backup><duration>1</duration></backup></measure></part></score-partwise>"
    raw = S.shred_texts(spark.createDataFrame([("d", text), ("e", "<a")], "doc_id string, text string"))
    assert sorted((r.doc_id, r.measure_ord, r.detail) for r in validate.content_model(raw).collect()) == [("d", 0, "0: staves too late"), ("d", 0, "2: no duration")]


def test_facts_of_whole_documents(spark):
    texts = {
        "good": "<score-partwise><part-list/><part id='a'><measure><note/></measure></part></score-partwise>", "cut": "<score-partwise><part-list/>", "root": "<opus><part id='a'/></opus>", "none": None,
        "bare": "<score-timewise/>", "empty": "<score-partwise><part-list/><part id='a'><measure><note/></measure></part><part id='b'/><part/></score-partwise>", "prefix": "<score-partwise><xlink:a/></score-partwise>",
    }
    found = validate.document_checks(S.document_facts(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.check if r.check == "parse_error" else (r.check, r.detail))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        "cut": ["parse_error"], "none": ["parse_error"], "root": [("unexpected_root", "opus")], "bare": [("no_notes", "0"), ("no_part_list", "part-list"), ("no_parts", "0")],
        "empty": [("empty_part", ""), ("empty_part", "b")], "prefix": [("unbound_prefix", "xlink"), "parse_error"],
    }
