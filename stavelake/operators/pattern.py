"""Systems that break their page's own pattern."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import long


UNKNOWN_CLEF = "?0"


def signatures(notes: DataFrame, measures: DataFrame, clefs: DataFrame) -> DataFrame:
    """Per system: staff count, meter of the first bar, and of each staff from top to bottom its clef, number of notes, and
    the lengths in ticks of the bars that it has notes in.

    A staff is one that has a note or a clef. A staff without a clef shows `?0`; a system whose first bar has no meter has
    a null meter, and a bar without one has the length `?`. bars: lengths joined by commas, staves by semicolons.
    """
    place, staff = ["page", "system"], ["page", "system", "staff"]
    length = F.coalesce(F.expr("cast(beats * 96 div beat_type as string)"), F.lit("?"))
    own = measures.groupBy("page", "system", "measure").agg(F.first(length).alias("length"))
    meter = measures.groupBy(*place).agg(F.min_by(F.concat("beats", F.lit("/"), "beat_type"), "measure").alias("meter"))
    named = clefs.groupBy(*staff).agg(F.min(F.concat("sign", F.col("line").cast("string"))).alias("clef"))
    bars = notes.groupBy(*staff, "measure").agg(F.count("*").alias("n")).join(own, [*place, "measure"], "left")
    bars = bars.groupBy(*staff).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("measure", F.coalesce("length", F.lit("?")).alias("length")))).alias("bars"))
    one = F.struct("staff", F.coalesce("clef", F.lit(UNKNOWN_CLEF)).alias("clef"), F.coalesce("n", F.lit(0)).cast("string").alias("n"), F.coalesce(F.concat_ws(",", F.col("bars.length")), F.lit("")).alias("bars"))
    rows = bars.join(named, staff, "full").groupBy(*place).agg(F.array_sort(F.collect_list(one)).alias("s")).join(meter, place, "left")
    joined = lambda field, sign: F.concat_ws(sign, F.col(f"s.{field}")).alias({"clef": "clefs", "n": "notes"}.get(field, field))
    return rows.select(*place, long(F.size("s")).alias("staves"), "meter", joined("clef", ","), joined("n", ","), joined("bars", ";"))


KEY = ["staves", "meter", "clefs"]


def same_pattern() -> Column:
    """Whether a row's pattern is the one of its `k_` columns, on one page; an unknown meter is like an unknown meter."""
    return reduce(and_, (F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY), F.col("page") == F.col("k_page"))


def pattern_keys(sigs: DataFrame) -> DataFrame:
    """Patterns of each page with the number of their systems and the first."""
    return sigs.groupBy("page", *KEY).agg(long(F.count("*")).alias("systems"), F.min("system").alias("first"))


def recurring(keys: DataFrame, least: int = 2) -> DataFrame:
    """Patterns that `least` systems of their page share."""
    return keys.where(F.col("systems") >= least)


def known_patterns(sigs: DataFrame, least: int = 2, opening: int = 2, reference: DataFrame | None = None) -> DataFrame:
    """Patterns that recur on their page; where none recurs, those of its reference systems.

    `reference` names them as (page, system); without it they are the first `opening` patterns, and on a page of which it
    names no system, the first one.
    """
    keys = pattern_keys(sigs).withColumn("recurs", F.col("systems") >= least)
    page = Window.partitionBy("page")
    if reference is None:
        chosen = F.row_number().over(page.orderBy("first")) <= opening
    else:
        named = sigs.join(reference.select("page", "system").distinct(), ["page", "system"], "left_semi").select("page", *KEY).distinct()
        named = named.toDF("k_page", *[f"k_{c}" for c in KEY]).withColumn("named", F.lit(1))
        keys = keys.join(named, same_pattern(), "left").drop("k_page", *[f"k_{c}" for c in KEY])
        chosen = F.coalesce(F.col("named") == 1, F.max("named").over(page).isNull() & (F.col("first") == F.min("first").over(page)))
    known = keys.withColumns({"any": F.max("recurs").over(page), "chosen": chosen})
    return known.where(F.when(F.col("any"), F.col("recurs")).otherwise(F.col("chosen"))).select("page", *KEY, "systems", "first")


def deviations(sigs: DataFrame, least: int = 2, opening: int = 2, reference: DataFrame | None = None) -> DataFrame:
    """Systems outside the known patterns of their page."""
    known = known_patterns(sigs, least, opening, reference).select("page", *KEY).toDF("k_page", *[f"k_{c}" for c in KEY])
    return sigs.join(known, same_pattern(), "left_anti").select("page", "system", *KEY)


def nearest(devs: DataFrame, known: DataFrame) -> DataFrame:
    """The known pattern of the same page with the fewest differing fields, then the first one.

    A field that only one of the two knows differs, and a staff count that differs counts twice.
    """
    k = known.select("page", *[F.col(c).alias(f"k_{c}") for c in KEY], "first")
    differ = sum(((~F.col(c).eqNullSafe(F.col(f"k_{c}"))).cast("int") for c in KEY), F.lit(0)) + (F.col("staves") != F.col("k_staves")).cast("int")
    rows = devs.join(k, "page").withColumn("differ", differ)
    w = Window.partitionBy("page", "system").orderBy("differ", "first")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "first")


def columns(clefs: DataFrame) -> DataFrame:
    """Majority clef of each staff position on a page, its votes, outlying systems, and whether it has over half."""
    name = F.concat("sign", F.col("line").cast("string"))
    votes = clefs.groupBy("page", "staff", name.alias("clef")).agg(long(F.count("*")).alias("votes"), F.min("system").alias("first"), F.collect_list("system").alias("systems"))
    w = Window.partitionBy("page", "staff")
    ranked = votes.withColumns({"k": F.row_number().over(w.orderBy(F.desc("votes"), "first")), "all": F.sum("votes").over(w)})
    others = ranked.groupBy("page", "staff").agg(F.concat_ws(",", F.array_sort(F.flatten(F.collect_list(F.when(F.col("k") > 1, F.col("systems")))))).alias("outliers"))
    return ranked.where("k = 1").join(others, ["page", "staff"]).select("page", "staff", "clef", "votes", "outliers", (2 * F.col("votes") > F.col("all")).cast("int").alias("established"))
