"""Checks of notes without labels. Each gives rows of findings; keys are page, staff and voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as N

SK = ["page", "staff", "voice"]


def stream():
    return Window.partitionBy(*SK).orderBy("measure", "onset", "event_id")


def long(c: Column) -> Column:
    return c.cast("long")


def measure_totals(notes: DataFrame) -> DataFrame:
    """Length of each stream's measure: durations without chord tones, rests included; and its pitched notes."""
    return notes.groupBy(*SK, "measure").agg(
        long(F.sum(F.when(~F.col("is_chord"), F.col("dur")).otherwise(0))).alias("total"), long(F.sum(F.when(F.col("is_rest"), 0).otherwise(1))).alias("pitched")
    )


def voice_collision(notes: DataFrame) -> DataFrame:
    """Pitched notes, not chord tones, at an onset that their stream's measure already has; with the note before."""
    at = Window.partitionBy(*SK, "measure", "onset").orderBy("event_id")
    own = notes.where("not is_rest and not is_chord").withColumn("previous", F.lag("midi").over(at))
    return own.where("previous is not null").select(*SK, "measure", "onset", "event_id", "previous", F.col("midi").alias("current"))


def empty_measure(notes: DataFrame, measures: DataFrame) -> DataFrame:
    return measures.join(notes.select("page", "measure"), ["page", "measure"], "left_anti").select("page", "measure")


def modal_total(totals: DataFrame) -> DataFrame:
    """The most frequent measure length of each page; of equals the one seen first in stream and measure order."""
    first = F.min(F.struct("staff", "voice", "measure")).alias("first")
    counts = totals.where("total > 0").groupBy("page", "total").agg(long(F.count("*")).alias("n"), first)
    rank = Window.partitionBy("page").orderBy(F.desc("n"), "first")
    return counts.withColumn("k", F.row_number().over(rank)).where("k = 1").select("page", F.col("total").alias("modal"), "n")


def declared(measures: DataFrame) -> DataFrame:
    return measures.select("page", "measure", long(N.bar_length("beats", "beat_type")).alias("declared"))


def wrong_meter(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Pages whose modal length is not the first declared one."""
    first = measures.groupBy("page").agg(F.min_by(long(N.bar_length("beats", "beat_type")), "measure").alias("declared"))
    return modal_total(measure_totals(notes)).join(first, "page").where("modal <> declared").select("page", "modal", "declared")


def broken_measure(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures that do not add up to the declared length: severity 3 if too long, 2 if too short."""
    off = measure_totals(notes).where("total > 0").join(declared(measures), ["page", "measure"]).where("total <> declared")
    return off.select(*SK, "measure", "total", "declared", F.when(F.col("total") > F.col("declared"), 3).otherwise(2).alias("severity"))


def broken_against_modal(notes: DataFrame) -> DataFrame:
    totals = measure_totals(notes)
    off = totals.where("total > 0").join(modal_total(totals).select("page", "modal"), "page").where("total <> modal")
    return off.select(*SK, "measure", "total", "modal", F.when(F.col("total") > F.col("modal"), 3).otherwise(2).alias("severity"))


def missing_meter(measures: DataFrame) -> DataFrame:
    return measures.groupBy("page").agg(F.count("beats").alias("n")).where("n = 0").select("page")


def placed(notes: DataFrame, clefs: DataFrame) -> DataFrame:
    """Pitched notes with their staff position and the bounds of the clef in force in their system."""
    own = notes.where("not is_rest").withColumn("position", N.diatonic("step", "octave"))
    return own.join(clefs.select("page", "system", "staff", N.clef_bounds("sign").alias("bounds")), ["page", "system", "staff"]).where("bounds is not null")


def outlier_pitch(notes: DataFrame, clefs: DataFrame, ledger: int = 4) -> DataFrame:
    """Streams with more than max(2, 5 %) notes outside the clef's bounds; up to four of their positions, in order."""
    out = (F.col("position") < F.col("bounds.low") - ledger) | (F.col("position") > F.col("bounds.high") + ledger)
    agg = placed(notes, clefs).groupBy(*SK).agg(
        long(F.sum(out.cast("int"))).alias("outside"), long(F.count("*")).alias("n"), F.slice(F.array_sort(F.collect_set(F.when(out, F.col("position")))), 1, 4).alias("sample")
    )
    return agg.where("outside > 2 and outside * 20 > n").select(*SK, "outside", "n", F.concat_ws(",", "sample").alias("sample"))


def clef_content(notes: DataFrame, clefs: DataFrame, slack: int = 2) -> DataFrame:
    """Streams of a system whose upper median position lies outside the clef's bounds."""
    med = placed(notes, clefs).groupBy(*SK, "system").agg(N.upper_median(F.collect_list("position")).alias("median"), F.first("bounds").alias("b"))
    return med.where(f"median < b.low - {slack} or median > b.high + {slack}").select(*SK, "system", "median")


def neighbours(notes: DataFrame) -> DataFrame:
    """Pitched notes with the one before in their stream."""
    return notes.where("not is_rest and not is_chord").withColumns({"before": F.lag("midi").over(stream()), "before_dur": F.lag("dur").over(stream())})


def dotted_eighth(notes: DataFrame) -> DataFrame:
    return neighbours(notes).where("dur = 18 and before_dur = 18").select(*SK, "measure", "event_id")


def duplicate_adjacent(notes: DataFrame) -> DataFrame:
    return neighbours(notes).where("midi = before and dur = before_dur").select(*SK, "measure", "event_id", "midi")


def duplicate_census(notes: DataFrame) -> DataFrame:
    """Per stream: adjacent notes of one pitch, and pairs that share an onset."""
    w = Window.partitionBy(*SK).orderBy("measure", "onset", "event_id")
    rows = notes.where("not is_rest").withColumns({"same": (F.col("midi") == F.lag("midi").over(w)).cast("int"), "together": ((F.col("measure") == F.lag("measure").over(w)) & (F.col("onset") == F.lag("onset").over(w))).cast("int")})
    return rows.groupBy(*SK).agg(long(F.coalesce(F.sum("same"), F.lit(0))).alias("adjacent"), long(F.coalesce(F.sum("together"), F.lit(0))).alias("same_onset"))


def melody_staff(notes: DataFrame) -> DataFrame:
    """The staff of each page with the highest upper median pitch; of equals the lower number."""
    med = notes.where("not is_rest").groupBy("page", "staff").agg(N.upper_median(F.collect_list("midi")).alias("median"))
    w = Window.partitionBy("page").orderBy(F.desc("median"), "staff")
    return med.withColumn("k", F.row_number().over(w)).where("k = 1").select("page", "staff", "median")


def vocal_leap(notes: DataFrame, most: int = 12) -> DataFrame:
    """Steps of more than an octave between neighbours on the melody staff."""
    w = Window.partitionBy("page", "staff").orderBy("measure", "onset", "event_id")
    own = notes.where("not is_rest").join(melody_staff(notes).select("page", "staff"), ["page", "staff"], "left_semi")
    return own.withColumn("leap", F.abs(F.col("midi") - F.lag("midi").over(w))).where(F.col("leap") > most).select("page", "staff", "measure", "event_id", "leap")


def out_of_range(notes: DataFrame, low: int = 21, high: int = 108) -> DataFrame:
    return notes.where(~F.col("is_rest") & ~F.col("midi").between(low, high)).select(*SK, "measure", "event_id", "midi")


def silence_run(notes: DataFrame, measures: DataFrame, least: int = 3) -> DataFrame:
    """Every measure from the third of a row of measures without any note element. Rests are notes here."""
    has = notes.select("page", "measure").distinct().withColumn("has", F.lit(1))
    w = Window.partitionBy("page").orderBy("measure")
    runs = measures.select("page", "measure").join(has, ["page", "measure"], "left").withColumn("island", F.sum(F.coalesce("has", F.lit(0))).over(w)).where("has is null")
    k = F.row_number().over(Window.partitionBy("page", "island").orderBy("measure"))
    return runs.withColumn("run", k).where(F.col("run") >= least).select("page", "measure", "run")


def save_measure_index(measures: DataFrame, name: str, buckets: int = 200, path: str | None = None) -> DataFrame:
    """Every measure of each page once, as the table `name`: in buckets by page, in order within, for `indexed_silence_run`.

    The one shuffle is paid here. A filter on pages reads only their buckets, and in these only row groups that hold them.
    """
    rows = measures.select("page", "measure").where("page is not null and measure is not null").distinct().repartition(buckets, "page")
    writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, "page").sortBy("page", "measure")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return measures.sparkSession.table(name)


def indexed_silence_run(notes: DataFrame, index: DataFrame, least: int = 3) -> DataFrame:
    """`silence_run` with the measures that a caller's index names, which is read in its buckets and never shuffled or sorted by page.

    Only the measures with notes travel, one row for each page. Pages of which the index names nothing have no run; those
    of a filtered index alone are looked at.
    """
    has = notes.where("measure is not null").groupBy("page").agg(F.collect_set(F.col("measure").cast("int")).alias("with_notes"))
    w = Window.partitionBy("page").orderBy("measure")
    rows = index.select("page", "measure").join(has.hint("merge"), "page", "left").withColumn("has", F.coalesce(F.array_contains("with_notes", F.col("measure").cast("int")), F.lit(False)).cast("int")).drop("with_notes")
    runs = rows.withColumn("island", F.sum("has").over(w)).where("has = 0")
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("page", "island").orderBy("measure"))).where(F.col("run") >= least).select("page", "measure", "run")


def bar_span(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Share of measures whose furthest note ends within the bar, for each page and, with a null page, in total."""
    ends = notes.groupBy("page", "measure").agg(F.max(F.col("onset") + F.col("dur")).alias("reach")).join(declared(measures), ["page", "measure"])
    return ends.rollup("page").agg(long(F.count("*")).alias("n"), long(F.sum((F.col("reach") <= F.col("declared")).cast("int"))).alias("clean"))


def ratio_census(notes: DataFrame, measures: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent ratios of notated to expected length, reduced; spellable if at most 4 over 8."""
    off = broken_measure(notes, measures)
    divisors = F.filter(F.sequence(F.lit(1), F.least("total", "declared")), lambda d: (F.col("total") % d == 0) & (F.col("declared") % d == 0))
    gcd = F.array_max(divisors)
    rows = off.groupBy("total", "declared").count().withColumn("g", gcd)
    rows = rows.groupBy(long(F.col("total") / F.col("g")).alias("num"), long(F.col("declared") / F.col("g")).alias("den")).agg(long(F.sum("count")).alias("n"))
    return rows.withColumn("spellable", ((F.col("num") <= 4) & (F.col("den") <= 8)).cast("int")).orderBy(F.desc("n"), "num", "den").limit(top)


def page_summary(notes: DataFrame) -> DataFrame:
    return notes.groupBy("page").agg(
        long(F.countDistinct("staff")).alias("staves"), long(F.countDistinct("staff", "voice")).alias("streams"), long(F.countDistinct("measure")).alias("measures"),
        long(F.count("*")).alias("notes"), long(F.sum(F.col("is_rest").cast("int"))).alias("rests"), long(F.sum(F.col("is_chord").cast("int"))).alias("chord_tones"),
    )


def fragment_stats(raw: DataFrame) -> DataFrame:
    """Per document of raw events: parts, measures, longest part, most staves declared, notes, those that sound, rests and chord tones.

    A rest is none that sounds, and a chord tone that is a rest is a rest. Without a number of staves there is one.
    A document that could not be read has its error and nulls; one without notes has zeros.
    """
    note = F.col("tag") == "note"
    rest, tone = F.coalesce("is_rest", F.lit(False)), F.coalesce("is_chord", F.lit(False))
    n = lambda c, name: long(F.sum(c.cast("int"))).alias(name)
    parts = raw.where("error is null").groupBy("doc_id", "part_idx").agg(
        long(F.countDistinct("measure_ord")).alias("length"), F.max("staves").alias("staves"), n(note, "notes"), n(note & ~rest & ~tone, "sounding"), n(note & rest, "rests"), n(note & ~rest & tone, "chord_tones"),
    )
    total = lambda c: long(F.coalesce(F.sum(c), F.lit(0))).alias(c)
    read = parts.groupBy("doc_id").agg(
        long(F.count("part_idx")).alias("parts"), long(F.sum("length")).alias("measures"), long(F.max("length")).alias("longest"),
        long(F.greatest(F.coalesce(F.max("staves"), F.lit(1)), F.lit(1))).alias("staves"), *[total(c) for c in ("notes", "sounding", "rests", "chord_tones")],
    )
    return raw.groupBy("doc_id").agg(F.max("error").alias("error")).join(read, "doc_id", "left")


def missing_context(notes: DataFrame, clefs: DataFrame) -> DataFrame:
    """Pages with notes for which no clef is known."""
    return notes.select("page").distinct().join(clefs.where("sign is not null").select("page"), "page", "left_anti")


def stream_flags(notes: DataFrame) -> DataFrame:
    """(check, severity, page, measure) of all checks that look at a note and the one before it, in one pass.

    Streams are in order of measure and onset, so a note collides with the one before if both stand at one onset.
    """
    before = {f"before_{c}": F.lag(c).over(stream()) for c in ("midi", "dur", "measure", "onset")}
    found = {
        "voice_collision": (3, "measure = before_measure and onset = before_onset"),
        "dotted_eighth": (1, "dur = 18 and before_dur = 18"),
        "duplicate_adjacent": (1, "midi = before_midi and dur = before_dur"),
    }
    hits = F.array(*[F.when(F.expr(when), F.struct(F.lit(name).alias("check"), F.lit(level).alias("severity"))) for name, (level, when) in found.items()])
    own = notes.where("not is_rest and not is_chord").withColumns(before)
    return own.select("page", "measure", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("f")).select("f.check", "f.severity", "page", "measure")


CHECKS = {
    "empty_measure": (3, lambda n, m, c: empty_measure(n, m)),
    "broken_measure": (2, lambda n, m, c: broken_measure(n, m)),
    "out_of_range": (1, lambda n, m, c: out_of_range(n)),
}
#: Checks of whole pages and streams, and those that need clefs. What has no measure of its own gets none.
PAGE_CHECKS = {
    "wrong_meter": (3, lambda n, m, c: wrong_meter(n, m)),
    "missing_meter": (2, lambda n, m, c: missing_meter(m)),
    "outlier_pitch": (2, lambda n, m, c: outlier_pitch(n, c)),
    "clef_content": (2, lambda n, m, c: clef_content(n, c)),
    "vocal_leap": (1, lambda n, m, c: vocal_leap(n)),
    "silence_run": (1, lambda n, m, c: silence_run(n, m)),
    "missing_context": (1, lambda n, m, c: missing_context(n, c)),
}


def flags(notes: DataFrame, measures: DataFrame, clefs: DataFrame | None = None, checks: dict | None = None) -> DataFrame:
    """(check, severity, page, measure) of all checks; with clefs, also of PAGE_CHECKS. Name others with a severity and a function."""
    out = stream_flags(notes)
    for name, (severity, check) in (checks or (CHECKS if clefs is None else CHECKS | PAGE_CHECKS)).items():
        found = check(notes, measures, clefs)
        level = F.col("severity") if "severity" in found.columns else F.lit(severity)
        measure = F.col("measure") if "measure" in found.columns else F.lit(None)
        out = out.unionByName(found.select(F.lit(name).alias("check"), level.cast("int").alias("severity"), "page", measure.cast("int").alias("measure")))
    return out


def page_reports(notes: DataFrame, measures: DataFrame, clefs: DataFrame, found: DataFrame) -> DataFrame:
    """Per page: the summary, its first meter, its clefs by staff, and how many flags of each severity it has."""
    meter = measures.groupBy("page").agg(F.min_by(F.concat("beats", F.lit("/"), "beat_type"), "measure").alias("time"))
    first = clefs.groupBy("page", "staff").agg(F.min_by(F.concat("sign", F.col("line").cast("string")), "system").alias("clef"))
    named = first.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("staff", "clef"))), lambda x: x.clef), ",").alias("clefs"))
    level = lambda k: long(F.sum((F.col("severity") == k).cast("int"))).alias(f"flags_{k}")
    out = page_summary(notes).join(meter, "page", "left").join(named, "page", "left").join(found.groupBy("page").agg(level(3), level(2), level(1)), "page", "left")
    return out.na.fill(0, ["flags_3", "flags_2", "flags_1"])


def tally(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(long(F.count("*")).alias("n"), long(F.countDistinct("page")).alias("pages")).orderBy(F.desc("n"), "check")


def suspects(found: DataFrame, n: int = 25) -> DataFrame:
    """The worst findings in page order; equal ones by measure and check."""
    return found.orderBy(F.desc("severity"), "page", "measure", "check").limit(n)


def control_gate(found: DataFrame, controls: DataFrame) -> bool:
    """True if no page that is known to be good has a finding."""
    return found.join(controls, "page", "left_semi").isEmpty()
