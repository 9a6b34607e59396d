"""Meter repair and barline rules that lose no notes without saying so."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as N
from .audit import SK, declared, long
from .scan import fold_in_order


def measure_extent(notes: DataFrame) -> DataFrame:
    return notes.groupBy("page", "measure").agg(long(F.max(F.col("onset") + F.col("dur"))).alias("extent"))


def page_meter(measures: DataFrame) -> DataFrame:
    """The most frequent meter of each page's measures; of equals 4/4, else the first seen."""
    counts = measures.groupBy("page", "beats", "beat_type").agg(long(F.count("*")).alias("n"), F.min("measure").alias("first"))
    common = (F.col("beats") == 4) & (F.col("beat_type") == 4)
    w = Window.partitionBy("page").orderBy(F.desc("n"), F.desc(common), "first")
    return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select("page", "beats", "beat_type", "n")


def reconcile_meter(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures whose content overruns their own meter and fits the page's: old and new meter."""
    page = page_meter(measures).select("page", F.col("beats").alias("new_beats"), F.col("beat_type").alias("new_type"))
    both = measures.join(page, "page").join(measure_extent(notes), ["page", "measure"])
    fits = (F.col("extent") > N.bar_length("beats", "beat_type")) & (F.col("extent") <= N.bar_length("new_beats", "new_type"))
    return both.where(fits).select("page", "measure", "beats", "beat_type", "new_beats", "new_type")


def extend_bars(notes: DataFrame, measures: DataFrame, max_factor: int = 2) -> DataFrame:
    """Overfull measures with the beats that they need; beyond `max_factor` times the bar they cannot be mended."""
    both = measures.join(measure_extent(notes), ["page", "measure"]).withColumn("bar", N.bar_length("beats", "beat_type")).where("extent > bar")
    needed = F.floor((F.col("extent") * F.col("beat_type") + 4 * N.TICKS - 1) / (4 * N.TICKS))
    return both.select("page", "measure", "beats", long(needed).alias("needed"), (F.col("extent") <= max_factor * F.col("bar")).cast("int").alias("extended"))


def _clamped(notes: DataFrame, measures: DataFrame) -> DataFrame:
    return notes.join(declared(measures), ["page", "measure"])


def clamp_bars(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Notes that start inside their bar, cut at its end."""
    return _clamped(notes, measures).where("onset < declared").withColumn("dur", long(F.least(F.col("dur"), F.col("declared") - F.col("onset")))).drop("declared")


def clamp_losses(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Per page: notes that `clamp_bars` drops and cuts."""
    cut = (F.col("onset") < F.col("declared")) & (F.col("onset") + F.col("dur") > F.col("declared"))
    return _clamped(notes, measures).groupBy("page").agg(long(F.sum((F.col("onset") >= F.col("declared")).cast("int"))).alias("dropped"), long(F.sum(cut.cast("int"))).alias("truncated"))


def note_beats_rest(notes: DataFrame) -> DataFrame:
    """Without rests where the same staff and voice has a note at that onset."""
    w = Window.partitionBy(*SK, "measure", "onset")
    sounds = F.max((~F.col("is_rest")).cast("int")).over(w)
    return notes.withColumn("sounds", sounds).where("not is_rest or sounds = 0").drop("sounds")


def pair_slurs(slurs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Starts and stops that alternate, without a stop in front or a start at the end; runs keep their first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    firsts = slurs.withColumn("turn", F.coalesce(F.col("kind") != F.lag("kind").over(w), F.lit(True))).where("turn").drop("turn")
    ends = firsts.withColumns({"k": F.row_number().over(w), "after": F.lead("kind").over(w)})
    return ends.where("not (kind = 'stop' and k = 1) and not (kind = 'start' and after is null)").drop("k", "after")


def infer_clef(notes: DataFrame, least: int = 4, split: int = 48) -> DataFrame:
    """F4 for staves with enough notes whose upper median lies below the split, else G2."""
    med = notes.where("not is_rest").groupBy("page", "staff").agg(N.upper_median(F.collect_list("midi")).alias("median"), long(F.count("*")).alias("n"))
    low = (F.col("n") >= least) & (F.col("median") < split)
    return med.select("page", "staff", F.when(low, "F").otherwise("G").alias("sign"), F.when(low, 4).otherwise(2).alias("line"))


def pad_parts(notes: DataFrame) -> DataFrame:
    """Measures after a staff's last one up to its page's last one."""
    last = notes.groupBy("page", "staff").agg(F.max("measure").alias("last"))
    width = notes.groupBy("page").agg(F.max("measure").alias("width"))
    return last.join(width, "page").where("last < width").select("page", "staff", F.explode(F.sequence(F.col("last") + 1, F.col("width"))).alias("measure"))


def clef_changes(clefs: DataFrame) -> DataFrame:
    """The first clef of each staff and every system in which it changes."""
    w = Window.partitionBy("page", "staff").orderBy("system")
    now = F.struct("sign", "line")
    return clefs.withColumn("new", F.coalesce(F.lag(now).over(w) != now, F.lit(True))).where("new").select("page", "staff", "system", "sign", "line")


def bar_rests(notes: DataFrame, measures: DataFrame, clefs: DataFrame) -> DataFrame:
    """A whole-measure rest for every staff of a measure in which it has no note."""
    grid = measures.join(clefs.select("page", "system", "staff"), ["page", "system"])
    return grid.join(notes.where("not is_rest").select("page", "measure", "staff"), ["page", "measure", "staff"], "left_anti").select("page", "measure", "staff", long(N.bar_length("beats", "beat_type")).alias("dur"))


def fill_gaps(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Silence between the events of a stream's measure and up to the bar's end, as (onset, dur)."""
    w = Window.partitionBy(*SK, "measure").orderBy("onset", "event_id")
    reach = F.max(F.col("onset") + F.col("dur")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = notes.withColumn("reach", F.coalesce(reach, F.lit(0)))
    inner = rows.where("onset > reach").select(*SK, "measure", long(F.col("reach")).alias("onset"), long(F.col("onset") - F.col("reach")).alias("dur"))
    ends = notes.groupBy(*SK, "measure").agg(F.max(F.col("onset") + F.col("dur")).alias("reach")).join(declared(measures), ["page", "measure"])
    return inner.unionByName(ends.where("reach < declared").select(*SK, "measure", long(F.col("reach")).alias("onset"), long(F.col("declared") - F.col("reach")).alias("dur")))


def ratio_runs(notes: DataFrame, ratio: str = "dur") -> DataFrame:
    """Runs of notes that follow each other without a gap and share one ratio."""
    w = Window.partitionBy(*SK, "measure").orderBy("onset", "event_id")
    new = F.coalesce((F.lag(ratio).over(w) != F.col(ratio)) | (F.lag(F.col("onset") + F.col("dur")).over(w) != F.col("onset")), F.lit(True))
    rows = notes.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy(*SK, "measure", "run").agg(F.min("onset").alias("start"), long(F.count("*")).alias("n"), F.min(ratio).alias("ratio"))


class Trimming:
    """Where the line of one voice's bar has got to, and the onset of its last note."""

    def __init__(self) -> None:
        self.reach, self.last = 0, -1

    def take(self, page: int, staff: int, voice: int, measure: int, onset: int, pitch: int, event_id: int, dur: int, bar: int) -> list[tuple]:
        start = onset if onset == self.last else max(onset, self.reach)
        stop = min(onset + dur, bar)
        if stop <= start or start >= bar:
            return []
        self.reach, self.last = stop, start
        return [(page, staff, voice, measure, event_id, start, stop - start, int(start != onset or stop != onset + dur))]

    def end(self) -> list[tuple]:
        return []


def trim_overlaps(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Notes of each voice's bar as one line in time: (SK, measure, event_id, onset, dur, touched).

    In order of (onset, pitch, event_id, dur) a note that starts inside the one before it starts at its end instead; notes at
    one onset are a chord and stay. Notes are cut at the bar's end; with nothing left they go. A bar is one sweep that
    remembers two numbers, so any number of notes in it takes linear time and no memory. Notes without onset, length or bar go.
    """
    bars = measures.select("page", "measure", long(N.bar_length("beats", "beat_type")).alias("bar"))
    pitch = F.when(F.col("is_rest"), 0).otherwise(F.col("midi"))
    rows = notes.join(bars, ["page", "measure"]).select(*SK, "measure", long(F.col("onset")).alias("onset"), pitch.alias("pitch"), "event_id", long(F.col("dur")).alias("dur"), "bar")
    known = rows.where("onset is not null and dur is not null and bar is not null")
    types = dict(rows.dtypes)
    keys = ", ".join(f"{k} {types[k]}" for k in [*SK, "measure"])
    return fold_in_order(known, [*SK, "measure"], ["onset", "pitch", "event_id", "dur"], Trimming, f"{keys}, event_id {types['event_id']}, onset bigint, dur bigint, touched int")


def trim_losses(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Per page: notes that `trim_overlaps` drops and those that it changes."""
    kept = trim_overlaps(notes, measures).groupBy("page").agg(F.count("*").alias("kept"), F.sum("touched").alias("touched"))
    all_ = notes.join(measures.select("page", "measure"), ["page", "measure"]).groupBy("page").agg(F.count("*").alias("n"))
    none = F.lit(0)
    return all_.join(kept, "page", "left").select("page", long(F.col("n") - F.coalesce("kept", none)).alias("dropped"), long(F.coalesce("touched", none)).alias("changed"))


def clean_voices(notes: DataFrame, measures: DataFrame, slurs: DataFrame) -> DataFrame:
    """Slurs (event_id, kind) paired across the notes that trimming leaves, in the order of their new onsets."""
    return pair_slurs(trim_overlaps(notes, measures).join(slurs, "event_id"), SK, ["measure", "onset", "event_id"])
