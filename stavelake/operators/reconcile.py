"""Counting twice: tallies of two runs, their differences, coverage against detected layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import long

FIELDS = ("measures", "notes", "rests", "pitched")


def tally(notes: DataFrame, keys: list[str]) -> DataFrame:
    pitched = F.sum(F.when(F.col("is_rest"), 0).otherwise(1))
    return notes.groupBy(*keys).agg(long(F.countDistinct("measure")).alias("measures"), long(F.count("*")).alias("notes"), long(F.sum(F.col("is_rest").cast("int"))).alias("rests"), long(pitched).alias("pitched"))


def combine(tallies: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of fragments' tallies."""
    return tallies.groupBy(*keys).agg(*[long(F.sum(f)).alias(f) for f in FIELDS])


def comparable_fields(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """The fields that every fragment of a key can be compared in; `comparable` is an array of names, null for none."""
    n = fragments.groupBy(*keys).agg(F.count("*").alias("all"))
    each = fragments.select(*keys, F.explode(F.array_distinct("comparable")).alias("field")).groupBy(*keys, "field").agg(F.count("*").alias("n"))
    shared = each.join(n, keys).where(F.col("n") == F.col("all")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("comparable"))
    return n.select(*keys).join(shared, keys, "left").na.fill("", ["comparable"])


def agree(differing: DataFrame, pages: DataFrame, field: str) -> DataFrame:
    """Whether each page agrees in a field, from the rows of `reconcile`."""
    off = differing.where(F.col("field") == field).select("page").distinct().withColumn("off", F.lit(1))
    return pages.select("page").distinct().join(off, "page", "left").select("page", F.col("off").isNull().cast("int").alias("agrees"))


def groupings(layout: DataFrame) -> DataFrame:
    """Staves of each page's systems from the top, as `2+2+3`, and on how many pages each grouping is.

    One grouping on all pages is a sign that the detector does not tell them apart: `alike` is 1 then.
    """
    each = layout.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("system", "n_staves_read"))).alias("s"), long(F.sum("n_staves_read")).alias("staves"))
    named = each.select("page", "staves", F.array_join(F.transform("s", lambda x: x.n_staves_read.cast("string")), "+").alias("grouping"))
    counts = named.groupBy("grouping").agg(long(F.count("*")).alias("pages"), long(F.sum("staves")).alias("staves"))
    return counts.join(F.broadcast(counts.agg((F.count("*") <= 1).cast("int").alias("alike"))))  # one row


def pitch_counts(notes: DataFrame, keys: list[str]) -> DataFrame:
    return notes.where("not is_rest").groupBy(*keys, "midi").agg(long(F.count("*")).alias("n"))


def pitch_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Signed difference of two pitch multisets, right less left; equal counts are left out."""
    both = pitch_counts(left, keys).withColumnRenamed("n", "a").join(pitch_counts(right, keys).withColumnRenamed("n", "b"), [*keys, "midi"], "full_outer")
    return both.select(*keys, "midi", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta")).where("delta <> 0")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Fields in which two tallies differ. A side that is absent differs in every field: absence is not agreement."""
    a, b = left.select(*keys, F.struct(*fields).alias("a")), right.select(*keys, F.struct(*fields).alias("b"))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("left"), F.col(f"b.{f}").alias("right")) for f in fields]))
    return a.join(b, keys, "full_outer").select(*keys, rows.alias("r")).select(*keys, "r.*").where("not (left <=> right)")


def reconcile_totals(left: DataFrame, right: DataFrame, by_left: list[str], by_right: list[str], keys: list[str], fields: tuple[str, ...] = FIELDS[1:]) -> DataFrame:
    """Two runs that cut a page differently, by its totals: each side's fragments are tallied and summed, then held together.

    Bars are left out by default, as a bar that lies in several fragments of one side counts in each.
    """
    total = lambda notes, by: combine(tally(notes, [*keys, *by]), keys)
    return reconcile(total(left, by_left), total(right, by_right), keys, fields)


def reconcile_files(left: DataFrame, right: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(keys, field, left, right): two runs that cut a page alike, file by file; `keys` name a file.

    A file of one side only is one row `file present`, with nothing else held against it. Others differ in counts, and in
    how often a pitch comes (`pitch 60`).
    """
    a, b = tally(left, keys), tally(right, keys)
    both = a.select(*keys).join(b.select(*keys), keys, "left_semi")
    here = lambda x: F.col(x).isNotNull().cast("long")
    found = a.select(*keys, F.lit(1).alias("l")).join(b.select(*keys, F.lit(1).alias("r")), keys, "full_outer").where("l is null or r is null")
    alone = found.select(*keys, F.lit("file present").alias("field"), here("l").alias("left"), here("r").alias("right"))
    counts = reconcile(a, b, keys, fields).join(both, keys, "left_semi")
    midi = pitch_counts(left, keys).withColumnRenamed("n", "left").join(pitch_counts(right, keys).withColumnRenamed("n", "right"), [*keys, "midi"], "full_outer").na.fill(0, ["left", "right"])
    pitches = midi.where("left <> right").join(both, keys, "left_semi").select(*keys, F.concat(F.lit("pitch "), F.col("midi").cast("string")).alias("field"), "left", "right")
    return alone.unionByName(counts).unionByName(pitches)


def verdicts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether both sides were measured, whether counts agree, whether pitches agree as well."""
    t = tally(left, keys).select(*keys, F.lit(1).alias("l")).join(tally(right, keys).select(*keys, F.lit(1).alias("r")), keys, "full_outer")
    counts = reconcile(tally(left, keys), tally(right, keys), keys).select(*keys).distinct().withColumn("c", F.lit(1))
    pitches = pitch_diff(left, right, keys).select(*keys).distinct().withColumn("p", F.lit(1))
    out = t.join(counts, keys, "left").join(pitches, keys, "left")
    measured = F.col("l").isNotNull() & F.col("r").isNotNull()
    return out.select(*keys, measured.cast("int").alias("measured"), (measured & F.col("c").isNull()).cast("int").alias("twin_counts"), (measured & F.col("c").isNull() & F.col("p").isNull()).cast("int").alias("twin_pitches"))


def common_docs(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("page").intersect(right.select("page"))


def coverage(layout: DataFrame) -> DataFrame:
    """Systems in which fewer staves were read than detected."""
    return layout.where("n_staves_read < n_staves_detected").select("page", "system", "n_staves_read", "n_staves_detected", F.lit(3).alias("severity"))


def layout_recovery(layout: DataFrame) -> DataFrame:
    """Per page: staves detected, read and lost, and the share read in percent."""
    return layout.groupBy("page").agg(long(F.sum("n_staves_detected")).alias("detected"), long(F.sum("n_staves_read")).alias("read")).withColumn("lost", F.col("detected") - F.col("read")).withColumn("percent", F.floor(100 * F.col("read") / F.col("detected")).cast("long"))


def content_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Notes lost and gained in each page and measure, as multisets of (staff, voice, onset, dur, pitch)."""
    cols = ["page", "measure", "staff", "voice", "onset", "dur", "is_rest", "midi"]
    lost = before.select(*cols).exceptAll(after.select(*cols)).groupBy("page", "measure").agg(long(F.count("*")).alias("lost"))
    gained = after.select(*cols).exceptAll(before.select(*cols)).groupBy("page", "measure").agg(long(F.count("*")).alias("gained"))
    return lost.join(gained, ["page", "measure"], "full_outer").na.fill(0)


def repair_reports(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per document of both sides: staves of either and whether they differ, rests put in, voices padded with them, content lost and gained.

    Content is a multiset of (measure, voice, length, pitch), where a rest is a pitch of its own; staff, onset and chord flag
    don't count, as another program writes the same chord around another root. A padded voice is one voice of one measure
    with more rests of a length than before. A side without the document has null staves. One shuffle by content, one by document.
    """
    pitch = F.when(~F.col("is_rest"), F.col("midi"))
    side = lambda df, b: df.select(*keys, "measure", "voice", "dur", "is_rest", pitch.alias("pitch"), "staff", F.lit(b).alias("b"), F.lit(1 - b).alias("a"))
    both = side(before, 1).unionByName(side(after, 0))
    content = both.groupBy(*keys, "measure", "voice", "dur", "is_rest", "pitch").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    more, less = F.greatest(F.col("a") - F.col("b"), F.lit(0)), F.greatest(F.col("b") - F.col("a"), F.lit(0))
    put_in = F.when(F.col("is_rest"), more).otherwise(0)
    padded = F.countDistinct(F.when(put_in > 0, F.struct(F.col("measure"), F.col("voice"))))
    diff = content.groupBy(*keys).agg(long(F.sum(put_in)).alias("rests_added"), long(padded).alias("voices_padded"), long(F.sum(less)).alias("content_lost"), long(F.sum(more)).alias("content_gained"))
    staves = both.groupBy(*keys).agg(*[long(F.countDistinct(F.when(F.col(c) == 1, F.col("staff")))).alias(n) for c, n in (("b", "staves_before"), ("a", "staves_after"))])
    none = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    differ = ((F.col("staves_before") > 0) & (F.col("staves_after") > 0) & (F.col("staves_before") != F.col("staves_after"))).cast("int").alias("staves_differ")
    return staves.join(diff, keys).select(*keys, none("staves_before"), none("staves_after"), differ, "rests_added", "voices_padded", "content_lost", "content_gained")


def repair_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy().agg(long(F.countDistinct("page")).alias("pages"), long(F.coalesce(F.sum("lost"), F.lit(0))).alias("lost"), long(F.coalesce(F.sum("gained"), F.lit(0))).alias("gained"))
