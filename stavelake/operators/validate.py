"""Structural checks of raw score events; each gives (doc_id, check, part_idx, measure_ord, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as N
from .normalise import fill_attributes

ATTRIBUTES = ["divisions", "beats", "beat_type", "staves"]


def _found(rows: DataFrame, check: str, detail: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(check).alias("check"), "part_idx", "measure_ord", detail.cast("string").alias("detail"))


def parse_errors(raw: DataFrame) -> DataFrame:
    return _found(raw.where("error is not null"), "parse_error", F.col("error"))


def no_notes(raw: DataFrame) -> DataFrame:
    """Documents that parse and hold no note."""
    n = raw.where("error is null").groupBy("doc_id").agg(F.sum((F.col("tag") == "note").cast("int")).alias("n")).where("n = 0")
    return n.select("doc_id", F.lit("no_notes").alias("check"), F.lit(None).cast("int").alias("part_idx"), F.lit(None).cast("int").alias("measure_ord"), F.lit("0").alias("detail"))


def bare_notes(raw: DataFrame) -> DataFrame:
    """Notes with neither pitch nor rest, and tuplets without a written type."""
    notes = raw.where("tag = 'note'")
    bare = _found(notes.where("step is null and not is_rest"), "bare_note", F.col("seq"))
    return bare.union(_found(notes.where("tup_actual is not null and type is null"), "untyped_tuplet", F.col("seq")))


def slur_balance(raw: DataFrame) -> DataFrame:
    kind = lambda k: F.coalesce(F.sum((F.col("slur") == k).cast("int")), F.lit(0))
    n = raw.groupBy("doc_id").agg(kind("start").alias("starts"), kind("stop").alias("stops")).where("starts <> stops")
    return n.select("doc_id", F.lit("slur_balance").alias("check"), F.lit(None).cast("int").alias("part_idx"), F.lit(None).cast("int").alias("measure_ord"), F.concat_ws("/", "starts", "stops").alias("detail"))


def filled(raw: DataFrame) -> DataFrame:
    """Events with the attributes in force."""
    return fill_attributes(raw.where("error is null"), ATTRIBUTES, ["doc_id", "part_idx"], ["measure_ord", "seq"])


def missing_context(raw: DataFrame) -> DataFrame:
    """The first note of each part that has no divisions or no meter in force."""
    w = Window.partitionBy("doc_id", "part_idx").orderBy("measure_ord", "seq")
    bad = filled(raw).where("tag = 'note' and (divisions is null or beats is null)")
    return _found(bad.withColumn("k", F.row_number().over(w)).where("k = 1"), "missing_context", F.col("seq"))


def late_attributes(raw: DataFrame) -> DataFrame:
    """Measures whose attributes come after a note."""
    first = raw.groupBy("doc_id", "part_idx", "measure_ord").agg(F.max(F.when(F.col("tag") == "attributes", F.col("seq"))).alias("a"), F.min(F.when(F.col("tag") == "note", F.col("seq"))).alias("n"))
    return _found(first.where("a > n"), "late_attributes", F.col("a"))


def undeclared_staff(raw: DataFrame) -> DataFrame:
    """Notes on a staff above the number in force, which is 1 if none was given."""
    return _found(filled(raw).where("tag = 'note' and staff > coalesce(staves, 1)"), "undeclared_staff", F.col("staff"))


def cursor(raw: DataFrame) -> DataFrame:
    """Events with the cursor in front of and behind them, in exact units."""
    w = Window.partitionBy("doc_id", "part_idx", "measure_ord").orderBy("seq")
    units = N.to_q("duration_raw", "divisions")
    move = F.when(F.col("tag") == "backup", -units).when((F.col("tag") == "forward") | ((F.col("tag") == "note") & ~F.coalesce("is_chord", F.lit(False))), units).otherwise(0)
    return filled(raw).withColumn("move", F.coalesce(move, F.lit(0))).withColumn("after", F.sum("move").over(w)).withColumn("before", F.col("after") - F.col("move"))


def backup_overshoot(raw: DataFrame) -> DataFrame:
    """Backups that go behind the start of the measure, with the cursor before them."""
    return _found(cursor(raw).where("tag = 'backup' and after < 0 and before >= 0"), "backup_overshoot", F.col("before"))


def bar_fit(raw: DataFrame) -> DataFrame:
    """Measures whose last cursor lies behind or before the bar's end; without divisions for a note there is no telling."""
    lost = F.bool_or((F.col("tag") == "note") & F.col("divisions").isNull()).alias("lost")
    last = cursor(raw).groupBy("doc_id", "part_idx", "measure_ord").agg(F.max_by(F.struct("after", "beats", "beat_type"), "seq").alias("e"), lost)
    rows = last.where("not lost").select("doc_id", "part_idx", "measure_ord", "e.*").withColumn("bar", N.bar_length("beats", "beat_type", N.Q)).where("after <> bar")
    return _found(rows.where("after > bar"), "bar_overflow", F.col("after")).union(_found(rows.where("after < bar"), "bar_short", F.col("after")))


# The order of children that MusicXML gives.
CHILDREN = {
    "note": "grace cue chord pitch unpitched rest duration tie instrument footnote level voice type dot accidental time-modification stem notehead notehead-text staff beam notations lyric play listen",
    "attributes": "footnote level divisions key time staves part-symbol instruments clef staff-details transpose directive measure-style",
}


def undeclared_parts(raw: DataFrame) -> DataFrame:
    """Parts with a body that the part list does not have."""
    n = raw.where("not declared").groupBy("doc_id", "part_idx").agg(F.min("measure_ord").alias("measure_ord"), F.min("part_id").alias("part_id"))
    return _found(n, "undeclared_part", F.col("part_id"))


def child_order(raw: DataFrame) -> DataFrame:
    """Notes and attributes whose known children are out of order; a cue, grace or chord mark may come in any order of these."""
    out = None
    for tag, names in CHILDREN.items():
        table = {name: max(i - 2, 0) if tag == "note" else i for i, name in enumerate(names.split())}
        ranks = F.filter(F.transform("children", lambda c: N.lookup(table, c)), lambda r: r.isNotNull())  # noqa: B023
        bad = _found(raw.where(F.col("tag") == tag).where(ranks != F.array_sort(ranks)), "child_order", F.col("seq"))
        out = bad if out is None else out.union(bad)
    return out


# Children of a note and of attributes in the order of the MusicXML content model, each with the names that
# may stand there, the least and the most of them; None: any number.
AFTER_NOTE = [
    ("instrument", 0, None), ("footnote", 0, 1), ("level", 0, 1), ("voice", 0, 1), ("type", 0, 1), ("dot", 0, None), ("accidental", 0, 1), ("time-modification", 0, 1), ("stem", 0, 1), ("notehead", 0, 1),
    ("notehead-text", 0, 1), ("staff", 0, 1), ("beam", 0, 8), ("notations", 0, None), ("lyric", 0, None), ("play", 0, 1), ("listen", 0, 1),
]
FULL_NOTE = [("chord", 0, 1), ("pitch unpitched rest", 1, 1)]
MODELS = {
    "note": [*FULL_NOTE, ("duration", 1, 1), ("tie", 0, 2), *AFTER_NOTE],
    "grace": [("grace", 1, 1), ("cue", 0, 1), *FULL_NOTE, ("tie", 0, 2), *AFTER_NOTE],
    "cue": [("cue", 1, 1), *FULL_NOTE, ("duration", 1, 1), *AFTER_NOTE],
    "attributes": [
        ("footnote", 0, 1), ("level", 0, 1), ("divisions", 0, 1), ("key", 0, None), ("time", 0, None), ("staves", 0, 1), ("part-symbol", 0, 1), ("instruments", 0, 1), ("clef", 0, None), ("staff-details", 0, None),
        ("transpose for-part", 0, None), ("directive", 0, None), ("measure-style", 0, None),
    ],
}


def model_fault(children: Column, model: list[tuple[str, int, int | None]]) -> Column:
    """The first place at which a list of children leaves a content model, in words; null where it fits.

    The model is an automaton whose states are its slots and how often each was filled: a child stays in its slot or moves on to
    a later one, past slots that may be empty.
    """
    place = {name: i for i, (names, _, _) in enumerate(model) for name in names.split()}
    most = {i: high for i, (_, _, high) in enumerate(model) if high is not None}
    needed = [i for i, (_, low, _) in enumerate(model) if low]
    named = {i: names.replace(" ", " or ") for i, (names, _, _) in enumerate(model)}

    def lacking(low: Column, high: Column) -> Column:
        """The first slot between two that must not be empty."""
        return F.coalesce(*[F.when((low < i) & (F.lit(i) < high), F.lit(f"no {named[i]}")) for i in needed], F.lit(None).cast("string"))

    def step(state: Column, child: Column) -> Column:
        at = N.lookup(place, child)
        n = F.when(at == state["at"], state["n"] + 1).otherwise(1)
        fault = F.when(at.isNull(), F.concat(F.lit("a foreign "), child)).when(at < state["at"], F.concat(child, F.lit(" too late"))).when(n > N.lookup(most, at), F.concat(F.lit("too many "), child)).otherwise(lacking(state["at"], at))
        return F.when(state["fault"].isNotNull(), state).otherwise(F.struct(F.coalesce(at, state["at"]).cast("int").alias("at"), n.cast("int").alias("n"), fault.alias("fault")))

    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("fault"))
    return F.aggregate(children, start, step, lambda s: F.coalesce(s["fault"], lacking(s["at"], F.lit(len(model)))))


def content_model(raw: DataFrame) -> DataFrame:
    """Notes and attributes whose children are no sequence of the content model: missing, repeated, excluded, foreign or out of
    place. A note with `grace` has no duration, one with `cue` no tie."""
    has = lambda name: F.array_contains("children", name)
    fault = F.when(F.col("tag") == "attributes", model_fault(F.col("children"), MODELS["attributes"])).when(has("grace"), model_fault(F.col("children"), MODELS["grace"]))
    fault = fault.when(has("cue"), model_fault(F.col("children"), MODELS["cue"])).otherwise(model_fault(F.col("children"), MODELS["note"]))
    rows = raw.where("tag in ('note', 'attributes') and children is not null").withColumn("fault", fault).where("fault is not null")
    return _found(rows, "content_model", F.concat_ws(": ", F.col("seq").cast("string"), "fault"))


def document_checks(facts: DataFrame) -> DataFrame:
    """(doc_id, check, part_idx, measure_ord, detail) of whole documents, from `sources.document_facts`.

    A document that does not parse, or whose root is none of a score, is not looked at further but for unbound prefixes.
    """
    score = F.col("root").isin("score-partwise", "score-timewise")
    one = lambda name, when, detail: F.when(when, F.array(F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail"))))
    each = lambda name, column: F.transform(column, lambda x: F.struct(F.lit(name).alias("check"), x.alias("detail")))
    found = [
        each("unbound_prefix", "prefixes"), one("parse_error", F.col("error").isNotNull(), F.col("error")), one("unexpected_root", ~score, F.col("root")), one("no_parts", score & (F.col("parts") == 0), F.lit("0")),
        one("no_notes", score & (F.col("notes") == 0), F.lit("0")), one("no_part_list", score & ~F.col("part_list"), F.lit("part-list")), F.when(score, each("empty_part", "empty_parts")),
    ]
    none = F.array().cast("array<struct<check:string,detail:string>>")
    rows = facts.select("doc_id", F.inline(F.concat(*[F.coalesce(f, none) for f in found])))
    return rows.select("doc_id", "check", F.lit(None).cast("int").alias("part_idx"), F.lit(None).cast("int").alias("measure_ord"), "detail")


CHECKS = [parse_errors, no_notes, bare_notes, slur_balance, missing_context, late_attributes, undeclared_staff, backup_overshoot, bar_fit, undeclared_parts, child_order]


def validate(raw: DataFrame, checks=CHECKS) -> DataFrame:
    out = None
    for check in checks:
        out = check(raw) if out is None else out.unionByName(check(raw))
    return out


def collapse(found: DataFrame) -> DataFrame:
    """Equal messages of a document as one, with their number."""
    return found.groupBy("doc_id", "check", "detail").agg(F.count("*").alias("n"))


def validity_rate(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents in all, with and without findings."""
    bad = found.select("doc_id").distinct().withColumn("bad", F.lit(1))
    return docs.select("doc_id").distinct().join(bad, "doc_id", "left").agg(F.count("*").alias("total"), F.count("bad").alias("failed")).withColumn("valid", F.col("total") - F.col("failed"))
