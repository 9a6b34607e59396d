"""Event normalisation: inherited attributes, onsets, chords, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as N
from .audit import SK, long


def fill_attributes(raw: DataFrame, cols: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Each attribute takes the last value given at or before a row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def _cursor(raw: DataFrame, keys: list[str]) -> DataFrame:
    """`raw` has seq, tag (note, backup, forward) and dur; a chord tone does not move the cursor."""
    w = Window.partitionBy(*keys, "measure").orderBy("seq")
    move = F.when(F.col("tag") == "backup", -F.col("dur")).when(F.col("is_chord"), 0).otherwise(F.col("dur"))
    before = F.coalesce(F.sum(move).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = raw.withColumn("cursor", long(before))
    own = F.when((F.col("tag") == "note") & ~F.col("is_chord"), F.col("cursor"))
    return at.withColumn("local", F.coalesce(F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("cursor"))).where("tag = 'note'")


def onsets_exact(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Onset of every note in its measure, exact and unclamped; a chord tone has the onset of the note before."""
    return _cursor(raw, keys).drop("cursor")


def onsets_ticks(raw: DataFrame, keys: list[str]) -> DataFrame:
    """As `onsets_exact`, but an onset below 0 becomes 0; the cursor itself does not."""
    return _cursor(raw, keys).drop("cursor").withColumn("local", F.greatest("local", F.lit(0)))


def absolute_onsets(notes: DataFrame) -> DataFrame:
    """Onset from the start of the page: measures are as long as their furthest note."""
    spans = notes.groupBy("page", "measure").agg(long(F.max(F.col("onset") + F.col("dur"))).alias("span"))
    w = Window.partitionBy("page").orderBy("measure")
    starts = spans.withColumn("start", F.sum("span").over(w) - F.col("span"))
    return notes.join(starts, ["page", "measure"]).select("event_id", "page", "measure", long(F.col("start") + F.col("onset")).alias("absolute"))


def doc_context(measures: DataFrame, clefs: DataFrame) -> DataFrame:
    """First declared meter of each page and first clef of each of its staves."""
    meter = measures.groupBy("page").agg(F.min_by(F.struct("beats", "beat_type"), "measure").alias("m"))
    clef = clefs.groupBy("page", "staff").agg(F.min_by(F.struct("sign", "line"), "system").alias("c"))
    return clef.join(meter, "page").select("page", "staff", "c.sign", "c.line", "m.beats", "m.beat_type")


def normalised_streams(notes: DataFrame) -> DataFrame:
    """Place of each note at its onset: pitched ones by step, alteration and octave, then rests."""
    w = Window.partitionBy(*SK, "measure", "onset").orderBy("is_rest", "step", "alter_", "octave", "event_id")
    return notes.select("event_id", *SK, "measure", "onset", F.row_number().over(w).alias("place"))


def chordify(notes: DataFrame, by_measure: bool = True) -> DataFrame:
    """Pitches that sound together on a staff, from low to high."""
    keys = ["page", "staff", *(["measure"] if by_measure else []), "onset"]
    own = notes.where("not is_rest").withColumn("d", N.diatonic("step", "octave"))
    return own.groupBy(*keys).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("d", "midi"))), lambda x: x.midi)).alias("chord"))


def voice_events(notes: DataFrame) -> DataFrame:
    """Notes of a voice at one onset as one event; a rest if all are; its length is that of the lowest note."""
    return notes.groupBy(*SK, "measure", "onset").agg(
        F.bool_and("is_rest").cast("int").alias("is_rest"), long(F.count("*")).alias("n"), F.min_by("dur", F.struct("midi", "event_id")).alias("dur"), F.min("midi").alias("lowest")
    )


def low_confidence(notes: DataFrame, least: float = 0.8) -> DataFrame:
    return notes.where(F.col("confidence") < least)


def doc_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("page").agg(
        long(F.countDistinct("voice")).alias("voices"), long(F.countDistinct("staff")).alias("staves"), long(F.countDistinct("system")).alias("systems"), F.concat_ws(",", F.array_sort(F.collect_set("system"))).alias("system_list")
    )


def rank_voices(notes: DataFrame) -> DataFrame:
    """Voices of each staff numbered by first appearance."""
    first = notes.groupBy(*SK).agg(F.min(F.struct("measure", "onset", "event_id")).alias("first"))
    return first.select(*SK, F.dense_rank().over(Window.partitionBy("page", "staff").orderBy("first")).alias("rank"))


def voice_map(notes: DataFrame) -> DataFrame:
    """One number for each (staff, voice) of a page."""
    return notes.select(*SK).distinct().withColumn("number", F.dense_rank().over(Window.partitionBy("page").orderBy("staff", "voice")))


def excerpt(notes: DataFrame, lo: int, hi: int) -> DataFrame:
    """Measures lo to hi, numbered from 1."""
    return notes.where(F.col("measure").between(lo, hi)).withColumn("measure", F.dense_rank().over(Window.partitionBy("page").orderBy("measure")))


def drop_silent_measures(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures that have a note, numbered anew."""
    kept = measures.join(notes.select("page", "measure"), ["page", "measure"], "left_semi")
    return kept.select("page", "measure", F.row_number().over(Window.partitionBy("page").orderBy("measure")).alias("number"))
