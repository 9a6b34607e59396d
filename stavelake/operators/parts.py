"""Staff fragments to instruments, pages and songs.

Staves have (page, system, staff, brace, sign, line), fragments (event_id, page, system, staff, measure, ...) with
measures counted from 1 in each system. A part is known by (braced, ordinal): the ordinal-th braced or unbraced group of
its system, from 0; braces are never compared across systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import functions as N
from .audit import long

PART = ["page", "braced", "ordinal"]


def in_system(*order: str | Column) -> WindowSpec:
    w = Window.partitionBy("page", "system")
    return w.orderBy(*order) if order else w


def brace_groups(staves: DataFrame) -> DataFrame:
    """(page, system, first, size, braced, ordinal, rank, contiguous): staves under one brace are a group, others stand alone."""
    group = F.coalesce(F.concat(F.lit("b"), F.col("brace").cast("string")), F.concat(F.lit("s"), F.col("staff").cast("string")))
    size = staves.groupBy("page", "system", group.alias("group"), F.col("brace").isNotNull().cast("int").alias("braced")).agg(F.min("staff").alias("first"), F.max("staff").alias("last"), long(F.count("*")).alias("size"))
    ordinal = F.row_number().over(Window.partitionBy("page", "system", "braced").orderBy("first")) - 1
    rank = F.row_number().over(in_system("first")) - 1
    return size.select("page", "system", "first", "size", "braced", ordinal.alias("ordinal"), rank.alias("rank"), (F.col("last") - F.col("first") + 1 == F.col("size")).cast("int").alias("contiguous"))


def clef_pairs(staves: DataFrame) -> DataFrame:
    """Staves with a brace for each treble staff right above a bass one; a pair is G2 over F4 or F3, so pairs cannot overlap."""
    w = in_system("staff")
    treble, bass = (F.col("sign") == "G") & (F.col("line") == 2), (F.col("sign") == "F") & F.col("line").isin(3, 4)
    top = F.coalesce(treble & F.lead(bass).over(w), F.lit(False))
    rows = staves.withColumn("top", top)
    brace = F.when(F.col("top"), F.col("staff")).when(F.lag("top").over(w), F.lag("staff").over(w))
    return rows.withColumn("brace", brace).drop("top")


def brace_fallback(staves: DataFrame) -> DataFrame:
    """Systems without a brace over two staves or more get one: over both of two, else over all but the top staff."""
    shared = F.count("*").over(Window.partitionBy("page", "system", "brace"))
    rows = staves.withColumn("under", F.when(F.col("brace").isNotNull(), shared))
    rows = rows.withColumns({"size": F.count("*").over(in_system()), "seen": F.coalesce(F.max("under").over(in_system()), F.lit(0)) > 1, "depth": F.row_number().over(in_system("staff"))})
    made = F.when((F.col("size") == 2) | ((F.col("size") > 2) & (F.col("depth") > 1)), 1)
    return rows.withColumn("brace", F.when(F.col("seen"), F.col("brace")).otherwise(made)).drop("under", "size", "seen", "depth")


def part_of_staff(staves: DataFrame) -> DataFrame:
    """(page, system, staff, braced, ordinal, local): the part of each staff, and its place in it from 1."""
    group = F.coalesce(F.concat(F.lit("b"), F.col("brace").cast("string")), F.concat(F.lit("s"), F.col("staff").cast("string")))
    rows = staves.select("page", "system", "staff", F.col("brace").isNotNull().cast("int").alias("braced"), group.alias("group"))
    rows = rows.withColumn("first", F.min("staff").over(Window.partitionBy("page", "system", "group")))
    kind = Window.partitionBy("page", "system", "braced").orderBy("first")
    local = F.row_number().over(Window.partitionBy("page", "system", "group").orderBy("staff"))
    return rows.select("page", "system", "staff", "braced", (F.dense_rank().over(kind) - 1).alias("ordinal"), local.alias("local"))


def fragment_offsets(fragments: DataFrame) -> DataFrame:
    """(page, system, width, offset): measures of the widest staff, and of all systems in front."""
    width = fragments.groupBy("page", "system").agg(F.max("measure").alias("width"))
    run = F.sum("width").over(Window.partitionBy("page").orderBy("system"))
    return width.select("page", "system", "width", long(run - F.col("width")).alias("offset"))


def assemble_parts(fragments: DataFrame, staves: DataFrame) -> DataFrame:
    """Fragments with their part, their staff in it and their measure on the page; no note is lost or changed."""
    own = part_of_staff(staves)
    rows = fragments.join(own, ["page", "system", "staff"]).join(fragment_offsets(fragments).drop("width"), ["page", "system"])
    return rows.withColumn("measure", long(F.col("measure") + F.col("offset"))).withColumn("staff", F.col("local")).drop("local", "offset")


def part_order(staves: DataFrame) -> DataFrame:
    """(page, braced, ordinal, place, name): parts by their median rank in systems of several parts, if every part has
    one; else by first appearance, which also breaks ties."""
    groups = brace_groups(staves).withColumn("parts", F.count("*").over(in_system()))
    votes = F.collect_list(F.when(F.col("parts") > 1, F.col("rank")))
    each = groups.groupBy(*PART).agg(N.upper_median(votes).alias("vote"), F.min(F.struct("system", "rank")).alias("seen"))
    all_ = F.bool_and(F.col("vote").isNotNull()).over(Window.partitionBy("page"))
    ranked = each.withColumn("vote", F.when(all_, F.col("vote")))
    place = F.row_number().over(Window.partitionBy("page").orderBy("vote", "seen")) - 1
    return ranked.select(*PART, place.alias("place"), N.part_label(F.col("braced") == 1, F.col("ordinal") + 1).alias("name"))


def part_bars(parts: DataFrame, staves: DataFrame) -> DataFrame:
    """Every measure of every part of a page up to the page's last: (.., measure, notes, is_empty)."""
    width = parts.groupBy("page").agg(F.max("measure").alias("width"))
    bars = part_order(staves).join(width, "page").select(*PART, F.explode(F.sequence(F.lit(1).cast("long"), F.col("width"))).alias("measure"))
    n = parts.where("not is_rest").groupBy(*PART, "measure").agg(F.count("*").alias("notes"))
    return bars.join(n, [*PART, "measure"], "left").select(*PART, "measure", long(F.coalesce("notes", F.lit(0))).alias("notes"), F.col("notes").isNull().cast("int").alias("is_empty"))


def role_systems(fragments: DataFrame, staves: DataFrame) -> DataFrame:
    """(page, system, role, width, short, absent): each role of a page in each of its systems; a system is as wide as its
    longest role, shorter ones say by how many measures, absent ones are silent throughout."""
    size = staves.groupBy("page", "system").agg(F.count("*").alias("size"))
    depth = F.row_number().over(in_system("staff")) - 1
    role = staves.withColumn("depth", depth).join(size, ["page", "system"]).select("page", "system", "staff", N.staff_role("size", "depth").alias("role"))
    own = fragments.join(role, ["page", "system", "staff"]).groupBy("page", "system", "role").agg(F.max("measure").alias("bars"))
    grid = own.select("page", "role").distinct().join(fragment_offsets(fragments).select("page", "system", "width"), "page")
    rows = grid.join(own, ["page", "system", "role"], "left")
    return rows.select("page", "system", "role", "width", (F.col("width") - F.coalesce("bars", F.col("width"))).alias("short"), F.col("bars").isNull().cast("int").alias("absent"))


def role_levels(staves: DataFrame) -> DataFrame:
    """(page, system, missing, level): roles of a page that a system lacks are a note; a system's role that only it has is a warning."""
    size = F.count("*").over(in_system())
    rows = staves.withColumns({"size": size, "depth": F.row_number().over(in_system("staff")) - 1}).select("page", "system", N.staff_role("size", "depth").alias("role"))
    tall = rows.withColumns({"n": F.count("*").over(in_system())}).withColumn("most", F.max("n").over(Window.partitionBy("page")))
    page = tall.where("n = most").groupBy("page").agg(F.collect_set("role").alias("all"))
    own = rows.groupBy("page", "system").agg(F.collect_set("role").alias("own"))
    missing, strange = F.array_sort(F.array_except("all", "own")), F.array_except("own", "all")
    out = own.join(page, "page").select("page", "system", F.concat_ws(",", missing).alias("missing"), F.when(F.size(strange) > 0, "warning").otherwise("note").alias("level"), F.size(strange).alias("n"))
    return out.where("missing <> '' or n > 0").drop("n")


def bottom_grid(fragments: DataFrame, staves: DataFrame) -> DataFrame:
    """(event_id, page, row, measure): all systems on one grid of as many rows as the tallest, aligned at the bottom; row 1 is on top."""
    depth = F.row_number().over(in_system(F.desc("staff"))) - 1
    rows = staves.withColumn("depth", depth).withColumn("tallest", F.max("depth").over(Window.partitionBy("page")) + 1)
    at = rows.select("page", "system", "staff", (F.col("tallest") - F.col("depth")).alias("row"))
    both = fragments.join(at, ["page", "system", "staff"]).join(fragment_offsets(fragments), ["page", "system"])
    return both.select("event_id", "page", "row", long(F.col("measure") + F.col("offset")).alias("measure"))


def grid_rows(staves: DataFrame) -> DataFrame:
    """(page, from_bottom, part, staff): the rows of each page's grid. The rows of the widest brace, from the bottom, are
    one part A1, whose staff 1 is on top; each row above is a part S1, S2, .. of its own. A page of several parts whose
    systems are all as tall as that brace gets one row more for the singer.
    """
    groups = brace_groups(staves)
    brace = groups.groupBy("page").agg(F.max("size").alias("accomp"), F.countDistinct("braced", "ordinal").alias("parts"))
    tall = staves.groupBy("page", "system").agg(F.count("*").alias("n")).groupBy("page").agg(F.max("n").alias("tallest"))
    shape = brace.join(tall, "page").withColumn("total", F.col("tallest") + ((F.col("parts") > 1) & (F.col("tallest") == F.col("accomp"))).cast("int"))
    rows = shape.select("page", "accomp", "total", F.explode(F.sequence(F.lit(0), (F.col("total") - 1).cast("int"))).alias("from_bottom"))
    low = F.col("from_bottom") < F.col("accomp")
    part = F.when(low, "A1").otherwise(F.concat(F.lit("S"), (F.col("total") - F.col("from_bottom")).cast("string")))
    return rows.select("page", "from_bottom", part.alias("part"), long(F.when(low, F.col("accomp") - F.col("from_bottom")).otherwise(1)).alias("staff"))


def _from_bottom(staves: DataFrame) -> DataFrame:
    return staves.withColumn("from_bottom", F.row_number().over(in_system(F.desc("staff"))) - 1)


def page_grid(fragments: DataFrame, staves: DataFrame) -> DataFrame:
    """(event_id, page, part, staff, measure): the notes of all systems on the page's grid, aligned at the bottom."""
    at = _from_bottom(staves).select("page", "system", F.col("staff").alias("old"), "from_bottom").join(grid_rows(staves), ["page", "from_bottom"])
    notes = fragments.withColumnRenamed("staff", "old").join(at, ["page", "system", "old"]).join(fragment_offsets(fragments), ["page", "system"])
    return notes.select("event_id", "page", "part", "staff", long(F.col("measure") + F.col("offset")).alias("measure"))


def grid_clefs(fragments: DataFrame, staves: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(page, part, staff, measure, sign, line): the clef that each grid row opens with, and the measures where it changes.

    The first system that prints a row gives its opening clef; a row that no system prints opens with G2. A clef of
    `overrides` (page, from_bottom, sign, line) holds for the whole row.
    """
    read = _from_bottom(staves).join(fragment_offsets(fragments), ["page", "system"]).select("page", "from_bottom", "sign", "line", (F.col("offset") + 1).alias("measure"))
    w = Window.partitionBy("page", "from_bottom").orderBy("measure")
    clef = F.struct("sign", "line")
    turns = read.withColumns({"nth": F.row_number().over(w), "same": F.lag(clef).over(w) == clef}).where("nth = 1 or not same")
    turns = turns.withColumn("measure", F.when(F.col("nth") == 1, 1).otherwise(F.col("measure"))).select("page", "from_bottom", "measure", "sign", "line")
    if overrides is not None:
        forced = overrides.select("page", "from_bottom", long(F.lit(1)).alias("measure"), "sign", "line")
        turns = turns.join(forced, ["page", "from_bottom"], "left_anti").unionByName(forced)
    rows = grid_rows(staves).join(turns, ["page", "from_bottom"], "left")
    return rows.select("page", "part", "staff", long(F.coalesce("measure", F.lit(1))).alias("measure"), F.coalesce("sign", F.lit("G")).alias("sign"), F.coalesce("line", F.lit(2)).alias("line"))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Part ids of a system's fragments renumbered P1 to Pn in order of fragment and part: (page, system, staff, part_id)."""
    own = fragments.select("page", "system", "staff").distinct()
    return own.withColumn("part_id", F.concat(F.lit("P"), F.row_number().over(in_system("staff")).cast("string")))


def stitch(parts: DataFrame, songs: DataFrame, meters: DataFrame) -> DataFrame:
    """(title, name, measure, page, notes, bar): every part of a song in every measure of its pages, in the song's order.

    `parts` has (page, name, measure, is_rest), `songs` (title, place, page), `meters` (page, measure, beats, beat_type).
    A part that a page lacks, or a silent measure, has no notes and the length of the meter at that position. Pages that
    were not read are left out here; `assemble.missing_pages` names them.
    """
    width = meters.groupBy("page").agg(F.max("measure").alias("width"))
    run = F.sum("width").over(Window.partitionBy("title").orderBy("place"))
    at = songs.join(width, "page").withColumn("offset", run - F.col("width"))
    names = parts.select("page", "name").distinct().join(songs, "page").select("title", "name").distinct()
    bars = at.join(meters, "page").select("title", "page", (F.col("offset") + F.col("measure")).alias("number"), "measure", long(N.bar_length("beats", "beat_type")).alias("bar"))
    n = parts.where("not is_rest").groupBy("page", "name", "measure").agg(F.count("*").alias("notes"))
    rows = bars.join(names, "title").join(n, ["page", "name", "measure"], "left")
    return rows.select("title", "name", long(F.col("number")).alias("measure"), "page", long(F.coalesce("notes", F.lit(0))).alias("notes"), "bar")


def invariants(parts: DataFrame, bars: DataFrame) -> DataFrame:
    """(page, problem, n): parts of unequal width, measures that are not 1 to N, notes in no part's measure, notes without a length."""
    width = bars.groupBy(*PART).agg(F.max("measure").alias("width"), F.count("*").alias("n"), F.countDistinct("measure").alias("own"))
    uneven = width.groupBy("page").agg(F.countDistinct("width").alias("n")).where("n > 1").select("page", F.lit("width").alias("problem"), "n")
    gaps = width.where("width <> n or own <> n").groupBy("page").agg(F.count("*").alias("n")).select("page", F.lit("numbers"), "n")
    lost = parts.join(bars, [*PART, "measure"], "left_anti").groupBy("page").agg(F.count("*").alias("n")).select("page", F.lit("lost"), "n")
    bare = parts.where("coalesce(dur, 0) <= 0").groupBy("page").agg(F.count("*").alias("n")).select("page", F.lit("length"), "n")
    return uneven.union(gaps).union(lost).union(bare)


def named(parts: DataFrame, staves: DataFrame) -> DataFrame:
    return parts.join(part_order(staves).select(*PART, "name"), PART)


def assembly_report(fragments: DataFrame, staves: DataFrame) -> DataFrame:
    """One row for each page: systems, parts, notes put in a part, notes without a staff, and broken braces."""
    groups = brace_groups(staves).groupBy("page").agg(long(F.countDistinct("system")).alias("systems"), long(F.countDistinct("braced", "ordinal")).alias("parts"), long(F.sum(1 - F.col("contiguous"))).alias("broken"))
    at = fragments.join(staves.select("page", "system", "staff", F.lit(1).alias("at")), ["page", "system", "staff"], "left")
    n = at.groupBy("page").agg(long(F.count("at")).alias("placed"), long(F.count("*") - F.count("at")).alias("lost"))
    return n.join(groups, "page", "left")


def corpus_report(fragments: DataFrame, staves: DataFrame, measures: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """(page, status, roles, warnings, clamped, problems): one row for each page with staves.

    status: `fail` where a brace is broken or no note has a staff, else `invariant` where an invariant of the assembled
    page fails, else `ok`. roles: names of its parts; warnings: systems with a role of their own; clamped: notes that
    cross a barline; problems: the first two invariants that fail. `bars` stands for the measures that were written, in
    the form of `part_bars`, which are taken where none are given.
    """
    own = assemble_parts(fragments, staves)
    bad = invariants(own, part_bars(own, staves) if bars is None else bars).groupBy("page").agg(F.concat_ws("; ", F.slice(F.array_sort(F.collect_set("problem")), 1, 2)).alias("problems"))
    bar = measures.select("page", "measure", N.bar_length("beats", "beat_type").alias("bar"))
    cut = own.join(bar, ["page", "measure"]).where("onset + dur > bar").groupBy("page").agg(F.count("*").alias("clamped"))
    warned = role_levels(staves).where("level = 'warning'").groupBy("page").agg(F.count("*").alias("warnings"))
    roles = part_order(staves).groupBy("page").agg(F.concat_ws(",", F.array_sort(F.collect_set("name"))).alias("roles"))
    broken = brace_groups(staves).groupBy("page").agg(F.sum(1 - F.col("contiguous")).alias("broken"))
    placed = own.groupBy("page").agg(F.count("*").alias("placed"))
    rows = roles.join(broken, "page")
    for df in (bad, cut, warned, placed):
        rows = rows.join(df, "page", "left")
    none = F.lit(0)
    status = F.when((F.col("broken") > 0) | F.col("placed").isNull(), "fail").when(F.col("problems").isNotNull(), "invariant").otherwise("ok")
    return rows.select("page", status.alias("status"), "roles", long(F.coalesce("warnings", none)).alias("warnings"), long(F.coalesce("clamped", none)).alias("clamped"), F.coalesce("problems", F.lit("")).alias("problems"))
