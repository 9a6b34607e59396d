"""Melodies laid out in bars, and whole score documents as one text each. All lengths are in ticks, 24 a quarter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as N
from ..shared import stored
from .audit import SK, long
from .meter import infer_clef, trim_overlaps

LINE = [*SK, "measure"]
PART = ["doc_id", "part_idx"]
#: What a note may carry beside its pitch and length.
MARKS = ["tie", "slur", "lyric"]


def _step(used: np.ndarray, dur: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(ticks used after a note, whether it opened a bar) from the ticks used before it."""
    over = used + dur > bar
    return np.where(over, dur, used + dur), over


def passage(durs: list[int], bar: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of notes does: for each number of ticks used before it, those used after it and the bars it opens."""
    used, bars = np.arange(bar + 1), np.zeros(bar + 1, np.int64)
    for dur in durs:
        used, over = _step(used, min(dur, bar), bar)
        bars += over
    return used, bars


def after_each(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """`stretches(keys, nth, used, bars)` with what all up to each one do together, by doubling: after r rounds each row
    holds 2^r stretches. Rows are as many as stretches, whatever the number of notes; each round is a written table."""
    most, reach = (stretches.agg(F.max("nth")).first()[0] or 0), 1
    while reach <= most:
        before = stretches.select(*keys, (F.col("nth") + reach).alias("nth"), F.col("used").alias("u"), F.col("bars").alias("n"))
        joined = stretches.join(before, [*keys, "nth"], "left")
        bars = F.zip_with("u", "n", lambda u, n: n + F.get("bars", u))
        used = F.transform("u", lambda u: F.get("used", u))
        stretches, reach = stored(joined.select(*keys, "nth", F.coalesce(used, "used").alias("used"), F.coalesce(bars, "bars").alias("bars")), "stretches"), 2 * reach
    return stretches


def lay_out(melody: DataFrame, keys: list[str], order: list[str], bar: int = 4 * N.TICKS, partitions: int | None = None) -> DataFrame:
    """(keys, measure, onset, dur, midi, is_rest): each melody in bars; a note that does not fit opens the next bar, and a
    rest fills what is left. A note longer than a bar is cut to it.

    Where a bar ends depends on all notes before it, but only through the ticks used so far, of which there are bar + 1. So
    rows are dealt by key and order into `partitions` ranges; each stretch of a melody in one is summed up as a function of
    these ticks, the functions are put together by doubling (`after_each`), and each stretch is laid out from where the one before it
    ends. No task gets more of a melody than one range holds. Keys must not be null; rows of equal order come as they lie.
    """
    kinds = {f.name: f.dataType.simpleString() for f in melody.schema}
    spark, cols = melody.sparkSession, list(dict.fromkeys([*keys, *order, "dur", "midi"]))
    many = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = melody.select(*cols).repartitionByRange(many, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(dealt.select(*keys, F.col("dur").cast("long").alias("dur"), F.col("midi").cast("int").alias("midi"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "melodies")
    place, typed = [*keys, "part"], ", ".join(f"{k} {kinds[k]}" for k in keys)

    def summed(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        used, bars = passage(group["dur"].to_pylist(), bar)
        first = group.select(place).slice(0, 1)
        return first.append_column("used", pa.array([used.tolist()], pa.list_(pa.int32()))).append_column("bars", pa.array([bars.tolist()], pa.list_(pa.int64())))

    stretches = stored(rows.groupBy(*place).applyInArrow(summed, f"{typed}, part int, used array<int>, bars array<long>"), "passages")
    by_key = Window.partitionBy(*keys)
    numbered = stretches.withColumns({"nth": F.row_number().over(by_key.orderBy("part")) - 1, "all": F.count("*").over(by_key)})
    done = after_each(stored(numbered.select(*keys, "nth", "used", "bars"), "stretches"), keys)
    ends = done.select(*keys, (F.col("nth") + 1).alias("nth"), F.col("used")[0].alias("used"), F.col("bars")[0].alias("bars"))
    starts = numbered.drop("used", "bars").join(ends, [*keys, "nth"], "left").select(*place, F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("bars", F.lit(0)).alias("bars"), (F.col("nth") == F.col("all") - 1).alias("last"))

    def laid(notes: pa.Table, start: pa.Table) -> pa.Table:
        notes, out = notes.sort_by("n"), []
        used, number = start["used"][0].as_py(), start["bars"][0].as_py() + 1
        for dur, midi in zip(notes["dur"].to_pylist(), notes["midi"].to_pylist()):
            dur = min(dur, bar)
            if used + dur > bar:
                if used < bar:
                    out.append((number, used, bar - used, None, True))
                number, used = number + 1, 0
            out.append((number, used, dur, midi, False))
            used += dur
        if start["last"][0].as_py() and used < bar:
            out.append((number, used, bar - used, None, True))
        made = {k: pa.chunked_array([pa.repeat(notes[k][0], len(out))]) for k in keys}
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.table(made | {c: pa.array(v, t) for c, v, t in zip(("measure", "onset", "dur", "midi", "is_rest"), zip(*out), types)})

    return rows.groupBy(*place).cogroup(starts.groupBy(*place)).applyInArrow(laid, f"{typed}, measure bigint, onset bigint, dur bigint, midi int, is_rest boolean")


def melodies(spark: SparkSession, docs: int, notes: int, seed: int = 1) -> DataFrame:
    """(doc_id, at, dur, midi): known melodies for labelled scores, the same for the same seed, made where Spark puts them."""
    h = lambda salt: F.pmod(F.xxhash64("doc_id", "at", F.lit(seed), F.lit(salt)), F.lit(1 << 20))
    rows = spark.range(docs * notes).select(F.floor(F.col("id") / notes).alias("doc_id"), (F.col("id") % notes).alias("at"))
    lengths = F.array(*[F.lit(n) for n in (6, 12, 18, 24, 36, 48, 96)])
    return rows.select("doc_id", "at", F.element_at(lengths, (h("dur") % 7 + 1).cast("int")).alias("dur"), (55 + h("midi") % 25).cast("int").alias("midi"))


def voice_events(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """(LINE, onset, dur, gap, bar, chord, ..): each voice's bar as chords that follow each other, with the silence behind each.

    Notes are trimmed to a line in time first. A note at the onset of a rest takes its place. All notes of a chord end
    together, at the latest end that the next onset leaves.
    """
    at = Window.partitionBy(*LINE, "onset")
    after = Window.partitionBy(*LINE).orderBy("onset").rangeBetween(1, Window.unboundedFollowing)
    marks = [F.col(c) if c in notes.columns else F.lit(None).cast("string").alias(c) for c in MARKS]
    rows = trim_overlaps(notes, bars).join(notes.select("event_id", "is_rest", "midi", "step", "alter", "octave", *marks), "event_id")
    rows = rows.withColumn("k", F.row_number().over(at.orderBy("is_rest", "midi", "event_id"))).withColumn("first_rest", F.min("is_rest").over(at))
    rows = rows.where("not is_rest or (first_rest and k = 1)").join(bars.select("page", "measure", long(N.bar_length("beats", "beat_type")).alias("bar")), ["page", "measure"])
    rows = rows.withColumns({"next": F.coalesce(F.min("onset").over(after), F.col("bar")), "dur": F.max("dur").over(at)})
    rows = rows.withColumn("dur", F.least("dur", F.col("next") - F.col("onset")))
    return rows.withColumns({"gap": F.col("next") - F.col("onset") - F.col("dur"), "chord": F.col("k") > 1}).drop("first_rest", "next", "touched")


def whole_marks(events: DataFrame, marked: set[str]) -> DataFrame:
    """`events` whose ties and slurs are whole, for those in `marked`; rests carry none.

    A tie starts at a note only if the next one of its pitch in the voice takes it up, and a note takes up only what the one
    before it starts. Slurs are paired across the notes that are left. Words stay.
    """
    events = events.withColumns({c: F.when(~F.col("is_rest"), F.col(c)) for c in MARKS})
    if "tie" in marked:
        # A rest has no pitch, whatever its column says, so it is not the next one of any note.
        w = Window.partitionBy(*SK, "is_rest", "midi").orderBy("measure", "onset", "event_id")
        starts, stops = F.coalesce(F.col("tie").isin("start", "both"), F.lit(False)), F.coalesce(F.col("tie").isin("stop", "both"), F.lit(False))
        events = events.withColumns({"to": starts & F.coalesce(F.lead(stops).over(w), F.lit(False)), "from": stops & F.coalesce(F.lag(starts).over(w), F.lit(False))})
        both = F.when(F.col("to") & F.col("from"), "both").when(F.col("to"), "start").when(F.col("from"), "stop")
        events = events.withColumn("tie", both).drop("to", "from")
    if "slur" in marked:
        # As `pair_slurs`, with the rows between left in: the first of each run of equal ends counts, but no stop in front and no start at the end.
        line = Window.partitionBy(*SK)
        w = line.orderBy("measure", "onset", "event_id")
        end = F.when(F.col("slur").isin("start", "stop"), F.col("slur"))
        turn = F.col("end").isNotNull() & ~F.col("end").eqNullSafe(F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        events = events.withColumn("end", end).withColumn("turn", turn.cast("int"))
        events = events.withColumns({"nth": F.sum("turn").over(w), "turns": F.sum("turn").over(line)})
        loose = ((F.col("end") == "stop") & (F.col("nth") == 1)) | ((F.col("end") == "start") & (F.col("nth") == F.col("turns")))
        events = events.withColumn("slur", F.when((F.col("turn") == 1) & ~loose, F.col("end"))).drop("end", "turn", "nth", "turns")
    return events


def escaped(c: Column) -> Column:
    """A text as the content of an element."""
    out = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def mark_elements(events: DataFrame) -> DataFrame:
    """With `held`, the elements that stand behind a note's length, and `tail`, those that stand at its end."""
    start, stop = F.col("tie").isin("start", "both"), F.col("tie").isin("stop", "both")
    text = lambda *parts: F.concat(*[F.coalesce(F.when(when, F.lit(x)), F.lit("")) for when, x in parts])
    held = text((stop, '<tie type="stop"/>'), (start, '<tie type="start"/>'))
    inner = text((stop, '<tied type="stop"/>'), (start, '<tied type="start"/>'), (F.col("slur") == "start", '<slur type="start" number="1"/>'), (F.col("slur") == "stop", '<slur type="stop" number="1"/>'))
    sung = F.when(F.trim("lyric") != "", F.concat(F.lit("<lyric><syllabic>single</syllabic>"), _tag("text", escaped(F.trim("lyric"))), F.lit("</lyric>")))
    return events.withColumn("held", held).withColumn("tail", F.concat(F.when(inner != "", _tag("notations", inner)).otherwise(""), F.coalesce(sung, F.lit(""))))


def _tag(name: str, body: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.col(body).cast("string") if isinstance(body, str) else body.cast("string"), F.lit(f"</{name}>"))


def _written(w: Column) -> Column:
    ratio = F.when(w["actual"] != w["normal"], _tag("time-modification", F.concat(_tag("actual-notes", w["actual"]), _tag("normal-notes", w["normal"])))).otherwise("")
    return F.concat(_tag("type", w["type"]), F.repeat(F.lit("<dot/>"), w["dots"]), ratio)


def note_elements(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """`rows` with a note element `x` from (chord, body, dur, held, voice, staff, tail); its written length comes from the tick count alone.

    Every length up to the longest bar is written once and joined back, so the list does not grow with the notes.
    """
    ticks = bars.agg(F.max(N.bar_length("beats", "beat_type")).alias("most")).select(F.explode(F.sequence(F.lit(1), "most")).alias("ticks"))
    lengths = ticks.select(F.col("ticks").cast("long").alias("dur"), F.transform(F.array(N.written_ratio("ticks")), _written)[0].alias("written"))
    mark = F.when(F.col("chord"), "<chord/>").otherwise("")
    x = _tag("note", F.concat(mark, "body", _tag("duration", "dur"), "held", _tag("voice", "voice"), "written", _tag("staff", "staff"), "tail"))
    return rows.join(F.broadcast(lengths), "dur").withColumn("x", x)


def _joined(order: list[str]) -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct(*order, "x")))["x"], "")


def measure_texts(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """(doc_id, part_idx, measure, beats, beat_type, staves, x): what sounds in every measure of every part.

    Every voice's bar is filled with rests; a staff without a note gets a rest of the whole measure.
    """
    page = F.struct(*PART).alias("page")
    notes = notes.withColumn("page", page)
    parts = notes.groupBy(*PART).agg(F.max("staff").alias("staves"))
    bars = measures.join(parts, "doc_id").withColumn("page", page)
    length = bars.select(*PART, "page", "measure", "staves", "beats", "beat_type", long(N.bar_length("beats", "beat_type")).alias("bar"))
    pitch = _tag("pitch", F.concat(_tag("step", "step"), F.when(F.coalesce("alter", F.lit(0)) != 0, _tag("alter", "alter")).otherwise(""), _tag("octave", "octave")))
    events = mark_elements(whole_marks(voice_events(notes, bars), set(MARKS) & set(notes.columns))).withColumn("body", F.when(F.col("is_rest"), "<rest/>").otherwise(pitch))
    first = Window.partitionBy(*LINE).orderBy("onset", "k")
    row = lambda onset, dur, k, chord, body, held=F.lit(""), tail=F.lit(""): F.struct(onset.cast("long").alias("onset"), dur.cast("long").alias("dur"), F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"), chord.alias("chord"), body.alias("body"), held.alias("held"), tail.alias("tail"))
    rest = lambda onset, dur: row(onset, dur, 0, F.lit(False), F.lit("<rest/>"))
    c = F.col
    front = F.when(c("nth") == 1, rest(F.lit(0), c("onset")))
    own = row(c("onset"), c("dur"), c("k"), c("chord"), c("body"), c("held"), c("tail"))
    behind = F.when(~c("chord"), rest(c("onset") + c("dur"), c("gap")))
    rows = events.withColumn("nth", F.row_number().over(first)).select(*LINE, F.inline(F.filter(F.array(front, own, behind), lambda r: r.dur > 0)))
    lines = note_elements(rows, bars).groupBy(*LINE).agg(_joined(["onset", "k"]).alias("x"))
    bar, none = F.col("bar").cast("string"), F.array().cast("array<struct<staff:int,voice:int,x:string>>")
    whole = lambda s: F.concat(F.lit('<note><rest measure="yes"/><duration>'), bar, F.lit("</duration><voice>1</voice><staff>"), s.cast("string"), F.lit("</staff></note>"))
    back = F.concat(F.lit("<backup><duration>"), bar, F.lit("</duration></backup>"))
    sounding = lines.groupBy("page", "measure").agg(F.collect_list(F.struct(c("staff").cast("int").alias("staff"), c("voice").cast("int").alias("voice"), "x")).alias("lines"))
    joined = length.join(sounding, ["page", "measure"], "left").withColumn("lines", F.coalesce("lines", none))
    silent = F.filter(F.sequence(F.lit(1), F.col("staves").cast("int")), lambda s: ~F.exists("lines", lambda r: r.staff == s))
    silent = F.transform(silent, lambda s: F.struct(s.alias("staff"), F.lit(1).alias("voice"), whole(s).alias("x")))
    joined = joined.withColumn("lines", F.sort_array(F.concat("lines", silent)))
    x = F.call_function("array_join", F.col("lines")["x"], back)
    return joined.select(*PART, "measure", "beats", "beat_type", "staves", x.alias("x"))


def score_documents(notes: DataFrame, measures: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): one MusicXML text for each document.

    `notes` has (doc_id, part_idx, staff, voice, measure, onset, dur, is_rest, midi, step, alter, octave, event_id), and may
    have `tie` (start, stop or both), `slur` (start or stop) and `lyric`: see `whole_marks`; a blank lyric is none. `measures`
    has (doc_id, measure, beats, beat_type), which all parts share, so all are equally wide, and may have `fifths`, where null
    is no change and the first key is none. A meter and a key are stated where they change, the clef is inferred from the
    pitches of each staff. `names` (doc_id, part_idx, name) names parts and their instruments; a part without a name, or with
    a blank one, is called by its number, and of several names the least counts. A document without notes gives none. The
    text of a document is one row; documents are made apart from each other.
    """
    clef = infer_clef(notes.withColumn("page", F.struct(*PART))).select("page.*", "staff", _tag("sign", "sign").alias("s"), _tag("line", "line").alias("l"))
    clef = clef.select(*PART, "staff", F.concat(F.lit('<clef number="'), F.col("staff").cast("string"), F.lit('">'), "s", "l", F.lit("</clef>")).alias("x")).groupBy(*PART).agg(_joined(["staff"]).alias("clefs"))
    w = Window.partitionBy(*PART).orderBy("measure")
    rows = measure_texts(notes, measures).join(clef, PART, "left")
    if "fifths" in measures.columns:
        rows = rows.join(measures.select("doc_id", "measure", "fifths"), ["doc_id", "measure"], "left")
    else:
        rows = rows.withColumn("fifths", F.lit(None).cast("int"))
    rows = rows.withColumn("fifths", F.coalesce(F.last("fifths", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumns({"number": F.row_number().over(w), "before": F.lag(F.struct("beats", "beat_type")).over(w), "key_before": F.lag("fifths").over(w)})
    time, key = _tag("time", F.concat(_tag("beats", "beats"), _tag("beat-type", "beat_type"))), _tag("key", _tag("fifths", "fifths"))
    first = _tag("attributes", F.concat(_tag("divisions", F.lit(N.TICKS)), key, time, _tag("staves", "staves"), F.coalesce("clefs", F.lit(""))))
    changed = F.concat(F.when(F.col("key_before") != F.col("fifths"), key).otherwise(""), F.when(F.col("before") != F.struct("beats", "beat_type"), time).otherwise(""))
    stated = F.when(F.col("number") == 1, first).when(changed != "", _tag("attributes", changed)).otherwise("")
    x = F.concat(F.lit('<measure number="'), F.col("number").cast("string"), F.lit('">'), stated, "x", F.lit("</measure>"))
    parts = rows.withColumn("x", x).groupBy(*PART).agg(_joined(["number"]).alias("x"))
    if names is None:
        parts = parts.withColumn("name", F.lit(None).cast("string"))
    else:
        known = names.where(F.trim("name") != "").groupBy(*PART).agg(F.min(F.trim("name")).alias("name"))
        parts = parts.join(known, PART, "left")
    number = F.concat(F.lit("P"), (F.col("part_idx") + 1).cast("string"))
    called = escaped(F.coalesce("name", F.concat(F.lit("Part "), (F.col("part_idx") + 1).cast("string"))))
    quoted = lambda tail="": F.concat(F.lit('"'), number, F.lit(f'{tail}">'))
    instrument = F.when(F.col("name").isNotNull(), F.concat(F.lit("<score-instrument id="), quoted("-I1"), _tag("instrument-name", called), F.lit("</score-instrument>"))).otherwise("")
    entry = F.concat(F.lit("<score-part id="), quoted(), _tag("part-name", called), instrument, F.lit("</score-part>"))
    parts = parts.select("doc_id", F.struct("part_idx", F.concat(F.lit("<part id="), quoted(), "x", F.lit("</part>")).alias("x"), entry.alias("entry")).alias("p"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    of = lambda field: F.array_join(F.transform("p", lambda r: r[field]), "")
    return whole.select("doc_id", F.concat(F.lit('<score-partwise version="4.0">'), _tag("part-list", of("entry")), of("x"), F.lit("</score-partwise>")).alias("text"))
