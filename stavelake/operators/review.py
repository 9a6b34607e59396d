"""The review of pages: what two runs, the layout, and a page's own pattern say, as flags with a severity and a detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import natural_order
from .assemble import bar_fill
from .audit import long
from .pattern import deviations, known_patterns, nearest, pattern_keys, recurring
from .reconcile import pitch_diff, reconcile, tally

SEVERITY = {"coverage_miss": 3, "count_disagreement": 3, "pitch_disagreement": 3, "missing_fragment": 3, "pattern_deviation": 2, "weak_pattern": 1}
CAVEAT = " (staves are missing on this page: coverage_miss)"


def described(staves: Column, meter: Column, clefs: Column) -> Column:
    """A signature in words; clefs are joined by commas."""
    shown = F.when(clefs != "", F.translate(clefs, ",", " "))
    return F.concat(staves.cast("string"), F.lit(" staff(s), "), F.coalesce(meter, F.lit("no meter")), F.lit(", "), F.coalesce(shown, F.lit("no clef")))


def differences(devs: DataFrame, known: DataFrame) -> DataFrame:
    """(page, system, phrases, described): each field in which a system departs from the nearest known pattern, as a phrase."""
    near = nearest(devs, known)

    def phrase(name: str, field: str, show=lambda c: c.cast("string")) -> Column:
        new, old = F.col(field), F.col(f"k_{field}")
        return F.when(~new.eqNullSafe(old), F.concat(F.lit(f"{name} "), F.coalesce(show(new), F.lit("none")), F.lit(" (expected "), F.coalesce(show(old), F.lit("none")), F.lit(")")))

    spaced = lambda c: F.translate(c, ",", " ")
    phrases = F.filter(F.array(phrase("staff count", "staves"), phrase("meter", "meter"), phrase("clefs", "clefs", spaced)), lambda p: p.isNotNull())
    return near.select("page", "system", F.concat_ws("; ", phrases).alias("phrases"), described(F.col("staves"), F.col("meter"), F.col("clefs")).alias("described"))


def bar_columns(notes: DataFrame) -> DataFrame:
    """Per page and staff: the bar length that most bars show (of equals the one met first), and the systems without it."""
    place = notes.select("page", "measure", "system").distinct()
    fills = bar_fill(notes).where("fill > 0").join(place, ["page", "measure"])
    votes = fills.groupBy("page", "staff", "fill").agg(long(F.count("*")).alias("votes"), F.min("measure").alias("first"), F.collect_set("system").alias("systems"))
    w = Window.partitionBy("page", "staff")
    ranked = votes.withColumns({"k": F.row_number().over(w.orderBy(F.desc("votes"), "first")), "all": F.array_distinct(F.flatten(F.collect_list("systems").over(w)))})
    out = F.array_sort(F.array_except("all", "systems"))
    return ranked.where("k = 1").select("page", "staff", F.col("fill").alias("agreed"), "votes", F.concat_ws(",", F.transform(out, lambda x: x.cast("string"))).alias("outliers"))


def systems_from_fragments(fragments: DataFrame, name: str = "file") -> DataFrame:
    """Fragments as one system each, numbered in the natural order of their names on the page: `sys2` before `sys10`."""
    return fragments.withColumn("system", F.dense_rank().over(Window.partitionBy("page").orderBy(natural_order(name), name)))


def coverage_flags(found: DataFrame, expected: DataFrame, label: str, what: str) -> DataFrame:
    """Pages on which a run has fewer fragments than the layout has staves or systems; both have (page, n)."""
    n, e = F.coalesce("n", F.lit(0)), F.col("expected")
    off = expected.withColumnRenamed("n", "expected").join(found, "page", "left").where(n < e)
    detail = F.concat(n.cast("string"), F.lit(" of "), e.cast("string"), F.lit(f" {what} found; "), (e - n).cast("string"), F.lit(" were never cut out, so their notes are in no count"))
    return off.select("page", F.lit("coverage_miss").alias("check"), F.lit(label).alias("where"), detail.alias("detail"))


def signed(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), c.cast("string"))


def review(left: DataFrame, right: DataFrame, sigs: DataFrame, coverage: DataFrame, least: int = 2) -> DataFrame:
    """(page, check, severity, where, detail) for every page of either run.

    left, right: notes of two runs, compared as totals of the page; sigs: signatures of the systems; coverage: flags of
    fragments that were never found, on whose pages each count carries a caveat. A page without signatures has its
    pattern check skipped and says so. A page whose systems share no pattern is weak; only what departs from the known
    patterns deviates. A page that one run lacks disagrees in every count.
    """
    missed = coverage.select("page").distinct().withColumn("caveat", F.lit(CAVEAT))
    fields = reconcile(tally(left, ["page"]), tally(right, ["page"]), ["page"])
    a, b = F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))
    counts = fields.select(
        "page", F.when(F.col("field") == "pitched", "pitch_disagreement").otherwise("count_disagreement").alias("check"),
        F.concat("field", F.lit(": left "), a.cast("string"), F.lit(" vs right "), b.cast("string"), F.lit(" ("), signed(b - a), F.lit(")")).alias("detail"),
    )
    pitches = pitch_diff(left, right, ["page"]).select(
        "page", F.lit("pitch_disagreement").alias("check"), F.concat(F.lit("pitch "), F.col("midi").cast("string"), F.lit(" differs by "), signed(F.col("delta")), F.lit(" between the two runs")).alias("detail")
    )
    runs = counts.unionByName(pitches).join(missed, "page", "left")
    runs = runs.select("page", "check", F.lit("two runs").alias("where"), F.concat("detail", F.coalesce("caveat", F.lit(""))).alias("detail"))
    seen = sigs.groupBy("page").agg(F.count("*").alias("n"))
    weak = seen.join(recurring(pattern_keys(sigs), least), "page", "left_anti").select(
        "page", F.lit("weak_pattern").alias("check"), F.lit("page").alias("where"),
        F.concat(F.lit("no pattern comes often enough to deviate from, among "), F.col("n").cast("string"), F.lit(" system(s)")).alias("detail"),
    )
    broke = differences(deviations(sigs, least), known_patterns(sigs, least)).select(
        "page", F.lit("pattern_deviation").alias("check"), F.concat(F.lit("system "), F.col("system").cast("string")).alias("where"),
        F.concat(F.when(F.col("phrases") == "", "like no other system here").otherwise(F.col("phrases")), F.lit(" ("), F.col("described"), F.lit(")")).alias("detail"),
    )
    pages = left.select("page").union(right.select("page")).distinct()
    gone = pages.join(seen, "page", "left_anti").select("page", F.lit("missing_fragment").alias("check"), F.lit("page").alias("where"), F.lit("no system was read, so patterns were not checked").alias("detail"))
    every = coverage.unionByName(runs).unionByName(weak).unionByName(broke).unionByName(gone)
    level = F.coalesce(*[F.when(F.col("check") == k, v) for k, v in SEVERITY.items()])
    return every.select("page", "check", level.alias("severity"), "where", "detail")
