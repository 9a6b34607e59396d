"""Fragments to pages to songs: offsets, beats, grids, clefs by vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as N
from .audit import long
from .meter import ratio_runs


def system_offsets(notes: DataFrame) -> DataFrame:
    """Measures before each system: the widest staff of every system in front."""
    width = notes.groupBy("page", "system", "staff").agg(F.countDistinct("measure").alias("n")).groupBy("page", "system").agg(F.max("n").alias("width"))
    w = Window.partitionBy("page").orderBy("system")
    return width.select("page", "system", long(F.col("width")).alias("width"), long(F.sum("width").over(w) - F.col("width")).alias("offset"))


def bar_fill(notes: DataFrame) -> DataFrame:
    """Beats of each staff's measure: the longest note at each onset summed by voice, then the longest voice; no rests."""
    onset = notes.where("not is_rest").groupBy("page", "staff", "measure", "voice", "onset").agg(F.max("dur").alias("dur"))
    return onset.groupBy("page", "staff", "measure", "voice").agg(F.sum("dur").alias("fill")).groupBy("page", "staff", "measure").agg(long(F.max("fill")).alias("fill"))


def beat_table(notes: DataFrame) -> DataFrame:
    """Fill by system and row, with rows counted from the bottom."""
    systems = notes.select("page", "measure", "system").distinct()
    rows = notes.select("page", "system", "staff").distinct().withColumn("from_bottom", F.dense_rank().over(Window.partitionBy("page", "system").orderBy(F.desc("staff"))) - 1)
    return bar_fill(notes).join(systems, ["page", "measure"]).join(rows, ["page", "system", "staff"]).groupBy("page", "from_bottom").agg(long(F.sum("fill")).alias("fill"), long(F.count("*")).alias("bars"))


def short_bars(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Bars with some beats that do not fill the meter."""
    return bar_fill(notes).join(measures, ["page", "measure"]).withColumn("bar", long(N.bar_length("beats", "beat_type"))).where("fill > 0 and fill <> bar").select("page", "staff", "measure", "fill", "bar")


def grid_shape(notes: DataFrame) -> DataFrame:
    """Tallest and lowest system of each page, and whether all are as tall."""
    size = notes.groupBy("page", "system").agg(F.countDistinct("staff").alias("n"))
    return size.groupBy("page").agg(long(F.max("n")).alias("tallest"), long(F.min("n")).alias("lowest"), (F.max("n") == F.min("n")).cast("int").alias("uniform"))


def grid_scan(notes: DataFrame) -> DataFrame:
    """(level, book, page, pages, varies, rows, lowest, accompaniment, solo, content) for every page, every book and all of them.

    A row of a system is one staff of one part. rows: those of the tallest layout, on which every system has to fit;
    accompaniment: the most staves that one part has; where several parts fill the tallest system with one of them, a row is
    added, so that the solo is not lost; solo: the rows above. lowest: rows of the smallest system; varies: pages whose systems
    differ in their rows; content: the most rows of one system that have a note. Books and the whole take the largest of each.
    """
    staff = notes.groupBy("book", "page", "system", "part", "staff").agg(F.max((~F.col("is_rest")).cast("int")).alias("sounds"))
    part = staff.repartition("book", "page").groupBy("book", "page", "system", "part").agg(F.count("*").alias("n"), F.sum("sounds").alias("sounds"))
    system = part.groupBy("book", "page", "system").agg(F.sum("n").alias("n"), F.max("n").alias("braced"), F.sum("sounds").alias("sounds"), F.collect_set("part").alias("parts"))
    several = F.size(F.array_distinct(F.flatten(F.collect_list("parts")))) > 1
    page = system.groupBy("book", "page").agg(F.max("n").alias("tall"), F.min("n").alias("low"), F.max("braced").alias("braced"), F.max("sounds").alias("content"), several.alias("several"))
    page = page.withColumn("rows", F.col("tall") + (F.col("several") & (F.col("tall") == F.col("braced"))).cast("int"))
    level = F.when(F.grouping("book") == 1, "all").when(F.grouping("page") == 1, "book").otherwise("page")
    out = page.rollup("book", "page").agg(
        level.alias("level"), long(F.count("*")).alias("pages"), long(F.sum((F.col("tall") != F.col("low")).cast("int"))).alias("varies"), long(F.max("rows")).alias("rows"), long(F.min("low")).alias("lowest"),
        long(F.max("braced")).alias("accompaniment"), long(F.max(F.col("rows") - F.col("braced"))).alias("solo"), long(F.max("content")).alias("content"),
    )
    return out.where("pages > 0").select("level", "book", "page", "pages", "varies", "rows", "lowest", "accompaniment", "solo", "content")


def clef_votes(clefs: DataFrame) -> DataFrame:
    """The clef of each staff by majority of systems, ties to the first seen, with its votes and the others'."""
    votes = clefs.groupBy("page", "staff", "sign", "line").agg(long(F.count("*")).alias("n"), F.min("system").alias("first"))
    w = Window.partitionBy("page", "staff")
    ranked = votes.withColumns({"k": F.row_number().over(w.orderBy(F.desc("n"), "first")), "all": F.sum("n").over(w)})
    return ranked.where("k = 1").select("page", "staff", "sign", "line", "n", long(F.col("all") - F.col("n")).alias("against"))


def clef_conflicts(clefs: DataFrame) -> DataFrame:
    """Staves with more than one clef on a page."""
    return clefs.groupBy("page", "staff").agg(long(F.countDistinct("sign", "line")).alias("clefs"), F.concat_ws(",", F.array_sort(F.collect_set(F.concat("sign", F.col("line").cast("string"))))).alias("names")).where("clefs > 1")


def role_sets(notes: DataFrame) -> DataFrame:
    """Systems that lack a staff which their page has: the missing ones."""
    page = notes.groupBy("page").agg(F.collect_set("staff").alias("all"))
    own = notes.groupBy("page", "system").agg(F.collect_set("staff").alias("own"))
    return own.join(page, "page").select("page", "system", F.concat_ws(",", F.array_sort(F.array_except("all", "own"))).alias("missing")).where("missing <> ''")


def missing_pages(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of a song index that were not read."""
    return index.join(pages.select("page"), "page", "left_anti")


def measure_boundaries(measures: DataFrame) -> DataFrame:
    """First and last measure of each system when all are numbered through."""
    n = measures.groupBy("page", "system").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy("page").orderBy("system"))
    return n.select("page", "system", long(run - F.col("n") + 1).alias("first"), long(run).alias("last"))


def page_counts(notes: DataFrame) -> DataFrame:
    """Roles of each staff of a page by the number of staves, with notes and pitched notes."""
    w = Window.partitionBy("page")
    n = notes.groupBy("page", "staff").agg(long(F.count("*")).alias("notes"), long(F.sum((~F.col("is_rest")).cast("int"))).alias("pitched"))
    ranked = n.withColumns({"size": F.count("*").over(w), "depth": F.row_number().over(w.orderBy("staff")) - 1})
    return ranked.select("page", "staff", N.staff_role("size", "depth").alias("role"), "notes", "pitched")


def phantom_bars(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures that sound in no staff, and the number that the others get without them."""
    sounding = notes.where("not is_rest").select("page", "measure").distinct().withColumn("sounds", F.lit(1))
    rows = measures.select("page", "measure").join(sounding, ["page", "measure"], "left").withColumn("sounds", F.coalesce("sounds", F.lit(0)))
    number = F.sum("sounds").over(Window.partitionBy("page").orderBy("measure"))
    return rows.select("page", "measure", F.when(F.col("sounds") == 1, long(number)).alias("number"), (1 - F.col("sounds")).alias("phantom"))


def join_pages(notes: DataFrame, book: str = "book") -> DataFrame:
    """Measures of each book's pages in one part: numbered through in page order."""
    width = notes.groupBy(book, "page").agg(F.max("measure").alias("width"))
    before = F.sum("width").over(Window.partitionBy(book).orderBy("page")) - F.col("width")
    at = width.select(book, "page", before.alias("before"))
    return notes.join(at, [book, "page"]).select("event_id", book, "page", long(F.col("before") + F.col("measure")).alias("measure"))


def split_staves(notes: DataFrame, clefs: DataFrame, part: str = "part") -> DataFrame:
    """Each staff of each part as a row of its own: its name, its place in the system from the top, staff 1, and its clef.

    Rows are in order of part, then staff; a staff without a clef of its own has a treble clef.
    """
    at = F.dense_rank().over(Window.partitionBy("page", "system").orderBy(part, "staff"))
    clef = clefs.select("page", "system", "staff", F.concat("sign", F.col("line").cast("string")).alias("clef"))
    rows = notes.select("event_id", "page", "system", "staff", part).withColumns({"row": at, "id": F.concat(F.col(part).cast("string"), F.lit(".s"), F.col("staff").cast("string"))})
    return rows.join(clef, ["page", "system", "staff"], "left").select("event_id", "page", "system", "id", "row", F.lit(1).alias("staff"), F.coalesce("clef", F.lit("G2")).alias("clef"))


def assemble_fragments(notes: DataFrame, fragment: list[str], names: DataFrame | None = None) -> DataFrame:
    """Fragments of a page as a part each, in order, with measures numbered from 1; `names` has (number, name)."""
    number = F.dense_rank().over(Window.partitionBy("page").orderBy(*fragment))
    measure = F.dense_rank().over(Window.partitionBy("page", *fragment).orderBy("measure"))
    rows = notes.select("event_id", "page", number.alias("number"), measure.alias("measure"))
    rows = rows.withColumn("name", F.lit(None).cast("string")) if names is None else rows.join(names.select("number", "name"), "number", "left")
    return rows.select("event_id", "page", F.concat(F.lit("P"), F.col("number").cast("string")).alias("part"), F.coalesce("name", F.concat(F.lit("Staff "), F.col("number").cast("string"))).alias("name"), "measure")


def page_context(measures: DataFrame) -> DataFrame:
    """The meter and the key that most bars of a page have, each with its votes; of equals the one met first."""
    out = None
    for name, value in (("meter", F.concat("beats", F.lit("/"), "beat_type")), ("fifths", F.col("fifths"))):
        votes = measures.where(value.isNotNull()).groupBy("page", value.alias(name)).agg(long(F.count("*")).alias(f"{name}_votes"), F.min("measure").alias("first"))
        top = votes.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(F.desc(f"{name}_votes"), "first"))).where("k = 1").drop("k", "first")
        out = top if out is None else out.join(top, "page", "full_outer")
    return out


def join_parts(notes: DataFrame, book: str = "book", part: str = "part", first_staff: int = 3, voices: int = 10) -> DataFrame:
    """Pages of each book in one part: part 0 of a page, and each further part on a staff of its own, in voices of its own.

    Bars of part 0 are numbered through the book; the others' bars meet them by their place on the page, and what has no
    bar to meet goes. `staves` is 2 and one for each further part that any page has, or null without any; `new_page` marks
    the first bar of a page after the first.
    """
    bars = notes.where(F.col(part) == 0).select(book, "page", "measure").distinct()
    bars = bars.withColumn("at", F.row_number().over(Window.partitionBy(book, "page").orderBy("measure")))
    width = bars.groupBy(book, "page").agg(F.max("at").alias("width"))
    w = Window.partitionBy(book).orderBy("page")
    pages = width.select(book, "page", "width", (F.sum("width").over(w) - F.col("width")).alias("before"), F.row_number().over(w).alias("nth"))
    most = notes.groupBy(book).agg(F.max(part).alias("most"))
    own = notes.withColumn("at", F.dense_rank().over(Window.partitionBy(book, "page", part).orderBy("measure")))
    rows = own.join(pages, [book, "page"]).where("at <= width").join(most, book)
    extra = F.col(part) > 0
    return rows.select(
        "event_id", book, "page", long(F.col("before") + F.col("at")).alias("measure"), F.when(extra, F.col(part) + first_staff - 1).otherwise(F.col("staff")).alias("staff"),
        F.when(extra, F.col("voice") + voices).otherwise(F.col("voice")).alias("voice"), F.when(F.col("most") > 0, F.col("most") + first_staff - 1).alias("staves"), ((F.col("at") == 1) & (F.col("nth") > 1)).cast("int").alias("new_page"),
    )


def role_totals(notes: DataFrame, roles: DataFrame, ratio: str = "ratio") -> DataFrame:
    """(page, role, staves, notes, pitched, tuplets) of declared roles (page, staff, role).

    A role of several staves is one that was declared twice: `duplicate_roles` names it. Tuplets are runs of notes that
    follow each other in a voice's bar and share a `ratio`, which is null for plain notes. A role without notes has zeros;
    notes of staves without a role don't count.
    """
    named = notes.join(roles.select("page", "staff", "role").distinct(), ["page", "staff"])
    n = named.groupBy("page", "role").agg(long(F.count("*")).alias("notes"), long(F.sum((~F.col("is_rest")).cast("int"))).alias("pitched"))
    runs = ratio_runs(notes.where(F.col(ratio).isNotNull()), ratio).join(roles.select("page", "staff", "role").distinct(), ["page", "staff"])
    runs = runs.groupBy("page", "role").agg(long(F.count("*")).alias("tuplets"))
    declared = roles.groupBy("page", "role").agg(long(F.countDistinct("staff")).alias("staves"))
    return declared.join(n, ["page", "role"], "left").join(runs, ["page", "role"], "left").na.fill(0, ["notes", "pitched", "tuplets"])


def duplicate_roles(roles: DataFrame) -> DataFrame:
    """(page, role, staves): roles that more than one staff of a page was given. Such a page is not to be emitted."""
    n = roles.groupBy("page", "role").agg(F.sort_array(F.collect_set("staff")).alias("found"))
    return n.where(F.size("found") > 1).select("page", "role", F.array_join(F.col("found").cast("array<string>"), ",").alias("staves"))
