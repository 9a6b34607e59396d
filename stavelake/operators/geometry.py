"""Staff lines to staves to systems, and checks of what was found.

Tables are keyed by page. Lines have (page, y, x0, x1, th), vertical rules (page, x, top, bottom). A page without lines
has no row anywhere. The recurrences over a page's own lines are sweeps over stretches that no decision crosses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..shared import stored
from .audit import long
from .scan import Spans, fold_in_order, islands
from .scoring import position_shift


def down(c: str) -> WindowSpec:
    """The rows of a page from the top."""
    return Window.partitionBy("page").orderBy(c)


def placed(lines: DataFrame) -> DataFrame:
    """Lines without a missing height or end."""
    return lines.select("page", "y", "x0", "x1", "th").dropna(subset=["y", "x0", "x1"])


class Merging:
    """Lines that can still take a piece, by the stretch of the page's width that each covers."""

    def __init__(self, tol: float, reach: float) -> None:
        self.tol, self.reach, self.n = tol, reach, 0
        self.lines: dict[int, list] = {}
        self.heights: list[tuple[float, int]] = []
        self.spans = Spans()

    def _closed(self, y: float) -> Iterator[tuple]:
        """Lines that lie too far above `y`: their mean height only changes with a further piece, so they get none."""
        while self.heights and y - self.heights[0][0] > self.tol:
            _, k = heappop(self.heights)
            page, now, *rest = self.lines[k]
            if y - now > self.tol:
                self.spans.drop(k)
                del self.lines[k]
                yield page, now, *rest
            else:
                heappush(self.heights, (now, k))

    def take(self, page: int, island: int, y: float, x0: int, x1: int, th: int) -> list[tuple]:
        out = list(self._closed(y))
        k = self.spans.first(math.ceil(x0 - self.reach), math.floor(x1 + self.reach))
        if k is None:
            k, self.n = self.n, self.n + 1
            self.lines[k] = [page, y, x0, x1, th, 1]
            heappush(self.heights, (y, k))
            self.spans.add(k, x0, x1)
            return out
        line = self.lines[k]
        _, mean, left, right, _, n = line
        for low, high in ((x0, left - 1), (right + 1, x1)):
            if low <= high:
                self.spans.add(k, low, high)
        line[1:4], line[5] = [(mean * n + y) / (n + 1), min(left, x0), max(right, x1)], n + 1
        return out

    def end(self) -> list[tuple]:
        return [tuple(line) for line in self.lines.values()]


class Thinning:
    """The lowest line so far. Lines above it are too far away for any later one, as each came in at `share` of the spacing below them."""

    def __init__(self) -> None:
        self.kept: tuple | None = None

    def take(self, page: int, island: int, y: float, x0: int, x1: int, th: int, least: float) -> list[tuple]:
        before, now = self.kept, (page, y, x0, x1, th)
        if before is None or y - before[1] >= least:
            self.kept = now
            return [] if before is None else [before]
        if x1 - x0 > before[3] - before[2]:
            self.kept = now
        return []

    def end(self) -> list[tuple]:
        return [self.kept]


def merge_collinear(lines: DataFrame, tol: float = 6, reach: float = 40) -> DataFrame:
    """Pieces within `tol` of a line's running mean height and `reach` of its ends become part of the first such line, in (y, x0, x1, th) order.

    A page is cut where no piece lies for more than `tol`, and each stretch is a sweep from the top over the lines that can
    still take a piece: n log n for n pieces, in memory for these lines. Pieces of the same place are each a piece.
    """
    cut = islands(placed(lines), "page", "y", F.lit(float(tol)), lambda gap, least: gap > 1.01 * least)
    return fold_in_order(cut, ["page", "island"], ["y", "x0", "x1", "th"], lambda: Merging(tol, reach), "page int, y double, x0 int, x1 int, th int, n int")


def drop_slivers(lines: DataFrame, spacing: DataFrame, share: float = 0.45) -> DataFrame:
    """Of lines closer than `share` of the page's spacing the longer one stays, the upper of equal ones; pages without a spacing keep all.

    Pages are cut at gaps of at least that, and each stretch is one sweep that remembers one line.
    """
    both = placed(lines).join(spacing.select("page", (share * F.col("spacing")).alias("least")), "page", "left").na.fill(0.0, ["least"])
    cut = islands(both, "page", "y", F.col("least"), lambda gap, least: gap >= least)
    rows = cut.select("page", "island", "y", "x0", "x1", "th", "least")
    return fold_in_order(rows, ["page", "island"], ["y", "x0", "x1", "th"], Thinning, "page int, y double, x0 int, x1 int, th int")


def staff_spacing(lines: DataFrame, low: float | DataFrame = 3, high: float = 60) -> DataFrame:
    """Median gap between neighbouring lines of a page, of gaps from `low` to `high`; `low` may be a table (page, low)."""
    gaps = lines.withColumn("gap", F.col("y") - F.lag("y").over(down("y")))
    if isinstance(low, DataFrame):
        gaps = gaps.join(low.select("page", "low"), "page")
    else:
        gaps = gaps.withColumn("low", F.lit(low))
    return gaps.where(F.col("gap").between(F.col("low"), F.lit(high))).groupBy("page").agg(F.expr("percentile(gap, 0.5)").alias("spacing"))


def settled_lines(pieces: DataFrame, rough_low: float = 8, low: float = 3, share: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """Lines and spacing of pages from raw pieces: a rough spacing that slivers cannot lower, without slivers by it, then measured again.

    The second spacing takes gaps of half the rough one and more. Pages without a rough one keep all lines, and gaps from `low` count.
    Both tables of lines are stored, as each is read more than once.
    """
    merged = stored(merge_collinear(pieces).drop("n"), "merged-lines")
    rough = staff_spacing(merged, rough_low)
    lines = stored(drop_slivers(merged, rough, share), "settled-lines")
    half = lines.select("page").distinct().join(rough, "page", "left").select("page", F.coalesce(F.col("spacing") * 0.5, F.lit(float(low))).alias("low"))
    return lines, staff_spacing(lines, half)


def group_lines(lines: DataFrame, spacing: DataFrame, max_ratio: float = 1.9, least: int = 3) -> DataFrame:
    """Staves: lines whose gaps are at most `max_ratio` spacings, `least` lines or more, numbered from the top."""
    rows = lines.join(spacing, "page").withColumn("gap", F.col("y") - F.lag("y").over(down("y")))
    new = F.coalesce(F.col("gap") > max_ratio * F.col("spacing"), F.lit(True))
    rows = rows.withColumn("new", new).withColumn("group", F.sum(F.col("new").cast("int")).over(down("y"))).withColumn("gap", F.when(~F.col("new"), F.col("gap")))
    staves = rows.groupBy("page", "group").agg(
        (F.min("y") - F.min_by("th", "y") / 2).alias("y_top"), (F.max("y") + F.max_by("th", "y") / 2).alias("y_bot"), (F.sum("y") / F.count("*")).alias("y_center"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        long(F.count("*")).alias("n_lines"), (F.sum("gap") / F.count("gap")).alias("spacing"), F.max("gap").alias("most"), F.min("gap").alias("fewest"),
    ).where(F.col("n_lines") >= least)
    resid = F.greatest(F.col("most") - F.col("spacing"), F.col("spacing") - F.col("fewest"))
    return staves.select("page", F.row_number().over(down("y_top")).alias("staff"), "y_top", "y_bot", "y_center", "x0", "x1", "n_lines", "spacing", (F.col("most") - F.col("fewest")).alias("spread"), resid.alias("resid"), (F.col("x1") - F.col("x0")).alias("width"))


def group_systems(staves: DataFrame, spacing: DataFrame, max_gap: float = 7, min_overlap: float = 0.55) -> DataFrame:
    """(page, staff, system): a staff joins the one above if it is near enough and shares enough of its width."""
    above = lambda c: F.lag(c).over(down("y_top"))
    shared = F.greatest(F.least("x1", above("x1")) - F.greatest("x0", above("x0")), F.lit(0))
    narrow = F.least(F.col("x1") - F.col("x0"), above("x1") - above("x0"))
    near = (F.col("y_top") - above("y_bot") <= max_gap * F.col("page_spacing")) & (narrow > 0) & (shared >= min_overlap * narrow)
    rows = staves.join(spacing.select("page", F.col("spacing").alias("page_spacing")), "page").withColumn("new", F.coalesce(~near, F.lit(True)).cast("int"))
    return rows.select("page", "staff", long(F.sum("new").over(down("y_top"))).alias("system"))


def linked_systems(staves: DataFrame, rules: DataFrame, edge: float = 12, edges: DataFrame | None = None) -> DataFrame:
    """(page, staff, system) by vertical rules: a rule that spans two neighbours' centres links them.

    A rule covers a contiguous run of staves, so the components are runs of linked neighbours. Rules at or outside a
    page's edges are page borders and link nothing: those of `edges` (page, left, right), which has to name every page
    whose rules count, or else the staves' width and `edge` more on either side.
    """
    rows = staves.withColumn("below", F.lead("y_center").over(down("y_top")))
    if edges is None:
        edges = staves.groupBy("page").agg((F.min("x0") - edge).alias("left"), (F.max("x1") + edge).alias("right"))
    inner = rules.join(edges.select("page", "left", "right"), "page").where("x > left and x < right").select("page", "top", "bottom").distinct()
    links = rows.select("page", "staff", "y_center", "below").join(inner, "page").where("top <= y_center and bottom >= below").select("page", (F.col("staff") + 1).alias("staff")).distinct()
    joined = staves.join(links.withColumn("linked", F.lit(1)), ["page", "staff"], "left")
    return joined.select("page", "staff", long(F.sum(1 - F.coalesce("linked", F.lit(0))).over(Window.partitionBy("page").orderBy("staff"))).alias("system"))


def split_system(staves: DataFrame, rules: DataFrame, systems: DataFrame) -> DataFrame:
    """(page, system, staff, part): a system split at its braces; whole where no rule links two of its staves."""
    runs = linked_systems(staves, rules).withColumnRenamed("system", "run").join(systems, ["page", "staff"])
    w = Window.partitionBy("page", "system")
    size = F.count("*").over(Window.partitionBy("page", "system", "run"))
    rows = runs.withColumn("size", size).withColumn("any", F.max("size").over(w) > 1)
    return rows.select("page", "system", "staff", F.when(F.col("any"), F.dense_rank().over(w.orderBy("run"))).otherwise(1).alias("part"))


def attach_lonely(systems: DataFrame, most: int = 1) -> DataFrame:
    """(page, system, target) from (page, system, n_staves): a system of at most `most` staves joins the larger one
    right below, else the nearest larger one above, else stays."""
    w = Window.partitionBy("page").orderBy("system")
    large = F.col("n_staves") > most
    above = F.last(F.when(large, F.col("system")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.lead(F.when(large, F.col("system"))).over(w)
    return systems.select("page", "system", F.when(large, F.col("system")).otherwise(F.coalesce(below, above, F.col("system"))).alias("target"))


def staff_flags(staves: DataFrame, spacing: DataFrame, resid: float = 2, width: float = 500) -> DataFrame:
    """Staves with other than five lines, uneven or narrow ones, and those a quarter off the page's spacing: the reasons."""
    page = spacing.select("page", F.col("spacing").alias("page_spacing"))
    why = [("lines", F.col("n_lines") != 5), ("uneven", F.col("resid") > resid), ("narrow", F.col("width") < width), ("spacing", F.abs(F.col("spacing") - F.col("page_spacing")) > 0.25 * F.col("page_spacing"))]
    reasons = F.concat_ws(",", *[F.when(bad, name) for name, bad in why])
    return staves.join(page, "page").select("page", "staff", reasons.alias("reasons")).where("reasons <> ''")


def free_regions(regions: DataFrame, staves: DataFrame) -> DataFrame:
    """Regions (page, region, rx0, rx1, top, bottom) that touch no staff of their page."""
    touch = (F.col("r.page") == F.col("s.page")) & (F.col("r.rx0") <= F.col("s.x1")) & (F.col("r.rx1") >= F.col("s.x0")) & (F.col("r.top") <= F.col("s.y_bot")) & (F.col("r.bottom") >= F.col("s.y_top"))
    return regions.alias("r").join(staves.alias("s"), touch, "left_anti")


def row_groups(rows: DataFrame, gap: int = 3, even: float = 0.4, good: float = 0.6) -> DataFrame:
    """(page, rows, even): dark rows (page, y) within `gap` are one; even if `good` of the distances between them lie within `even` of their median."""
    groups = rows.withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(down("y")) > gap).cast("int"), F.lit(1))).withColumn("group", F.sum("new").over(down("y")))
    mids = groups.groupBy("page", "group").agg((F.sum("y") / F.count("*")).alias("y")).withColumn("gap", F.col("y") - F.lag("y").over(down("y")))
    page = mids.groupBy("page").agg(long(F.count("*")).alias("rows"), F.expr("percentile(gap, 0.5)").alias("median"))
    fit = mids.join(page, "page").groupBy("page", "rows").agg(F.sum((F.abs(F.col("gap") - F.col("median")) <= even * F.col("median")).cast("int")).alias("fit"), F.count("gap").alias("gaps"))
    return fit.select("page", "rows", F.coalesce((F.col("fit") >= good * F.col("gaps")) & (F.col("gaps") > 0), F.lit(False)).cast("int").alias("even"))


def page_pairs(scan: DataFrame, render: DataFrame) -> DataFrame:
    """Ratio of ink, staff bands of both and greatest deviation of ink shares, for pages (page, ink, bands, shares) in both."""
    r = render.select("page", F.col("ink").alias("r_ink"), F.col("bands").alias("r_bands"), F.col("shares").alias("r_shares"))
    off = F.array_max(F.zip_with("shares", "r_shares", lambda a, b: F.abs(a - b)))
    return scan.join(r, "page").select("page", F.when(F.col("ink") > 0, F.col("r_ink") / F.col("ink")).alias("ink_ratio"), "bands", "r_bands", off.alias("deviance"))


def match_noteheads(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 0.02) -> DataFrame:
    """(keys, ax, ay, bx, by): each head of `a` (x, y) in order of x takes the nearest unused head of `b` within `tol`.

    Each key's heads travel as one sorted array, so Python gets many keys in a batch. Keys of one side alone have no match.
    """
    heads = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias(name))
    both = heads(a, "a").join(heads(b, "b"), keys).select(*keys, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    types = dict(a.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", ax double, ay {types['y']}, bx double, by {types['y']}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, ax, ay, bx, by in batch.itertuples(index=False, name=None):
                out += [(*key, ax[i], ay[i], bx[j], by[j]) for i, j in nearest_free(ax, bx, tol)]
            yield pd.DataFrame(out, columns=[*keys, "ax", "ay", "bx", "by"])

    return both.mapInPandas(run, schema)


def nearest_free(left: np.ndarray, right: np.ndarray, tol: float) -> list[tuple[int, int]]:
    """Places in two sorted lists: each left value takes the nearest free right one within `tol`, the lower of two as near."""
    used, out = np.zeros(len(right), bool), []
    lows, highs = np.searchsorted(right, left - tol, "left"), np.searchsorted(right, left + tol, "right")
    for i, (lo, hi) in enumerate(zip(lows, highs)):
        off = np.where(used[lo:hi], np.inf, np.abs(right[lo:hi] - left[i]))
        if len(off) and np.isfinite(off.min()):
            j = lo + int(off.argmin())
            used[j] = True
            out.append((i, j))
    return out


def staff_traces(scan: DataFrame, render: DataFrame, keys: list[str], tol: float = 0.02, core: int = 5) -> DataFrame:
    """Per staff in both: heads of each side on the staff itself (`core` positions from its middle and fewer), how many pair by x, how
    many of these have one height, and the shift that explains most heads of the whole bands, with its support and the render's heads.

    Heads have (keys, x, y), y in staff positions from the middle line. Heads far above and below bind to neighbours and
    stems, so they count for the shift only, which is one of shapes and bears them.
    """
    near = F.abs("y") <= core
    count = lambda df, name: df.groupBy(*keys).agg(long(F.sum(near.cast("int"))).alias(name), long(F.count("*")).alias(f"{name}_wide"))
    staves = count(scan, "page_events").join(count(render, "engraved_events"), keys).drop("page_events_wide")
    same = F.sum((F.bround(F.col("ay") - F.col("by")) == 0).cast("int"))
    pairs = match_noteheads(scan.where(near), render.where(near), keys, tol).groupBy(*keys).agg(long(F.count("*")).alias("x_matched"), long(same).alias("same_height"))
    heights = lambda df: df.withColumn("midi", F.bround("y").cast("int"))
    shifts = position_shift(heights(render), heights(scan), keys)
    return staves.join(pairs, keys, "left").join(shifts, keys, "left").na.fill(0, ["x_matched", "same_height", "support"])


def displacements(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram of height differences of matched heads, with the median shift of x of all heads of the key."""
    shift = matches.groupBy(*keys).agg(F.expr("percentile(bx - ax, 0.5)").alias("x_shift"))
    hist = matches.groupBy(*keys, F.bround(F.col("by") - F.col("ay")).cast("int").alias("moved")).agg(long(F.count("*")).alias("n"))
    return hist.join(shift, keys)


def pair_staves(scan: DataFrame, render: DataFrame) -> DataFrame:
    """(page, system, depth, staff, r_staff): staves of both paired from the bottom of each system."""
    depth = F.row_number().over(Window.partitionBy("page", "system").orderBy(F.desc("staff"))) - 1
    return scan.withColumn("depth", depth).join(render.withColumn("depth", depth).withColumnRenamed("staff", "r_staff"), ["page", "system", "depth"]).select("page", "system", "depth", "staff", "r_staff")


def page_features(images: DataFrame, dark: int = 128, share: float = 0.1, gap: int = 6) -> DataFrame:
    """(origin, ink, shares, bands, colour) of page images, from Spark's image source.

    `ink` is the share of dark pixels, `shares` that of each of 3 x 3 fields in reading order, `bands` counts runs of rows
    with more than `share` dark pixels, where a break of at most `gap` rows ends none, and `colour` is the share of pixels
    whose channels differ by over a tenth of their range. An image that Spark could not read has nulls.
    """
    schema = "origin string, ink double, shares array<double>, bands int, colour double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(o, *pixel_features(d, h, w, c, dark, share, gap)) for o, h, w, c, d in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["origin", "ink", "shares", "bands", "colour"]).astype({"bands": "Int32"})

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, schema)


def pixel_features(data: bytes, height: int, width: int, channels: int, dark: int, share: float, gap: int) -> tuple:
    if height <= 0 or width <= 0:
        return None, None, None, None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3]
    grey = pixels.astype(float) @ ([0.114, 0.587, 0.299] if channels >= 3 else [1.0])
    ink = grey < dark
    shares = [float(field.mean()) if field.size else 0.0 for third in np.array_split(ink, 3) for field in np.array_split(third, 3, axis=1)]
    rows = np.flatnonzero(ink.mean(1) > share)
    bands = int((np.diff(rows) > gap + 1).sum()) + 1 if len(rows) else 0
    return float(ink.mean()), shares, bands, float((np.ptp(pixels, axis=2) > 25).mean())


def page_gate(features: DataFrame, graphic: float = 0.05, colour: float = 0.2, least_bands: int = 5, most_ink: float = 0.35) -> DataFrame:
    """Features with a verdict: graphic (by `graphic_share` where it is given), photo, music, thin (fewer bands than a staff has), or other."""
    pictured = F.col("graphic_share") >= graphic if "graphic_share" in features.columns else F.lit(False)
    music = (F.col("bands") >= least_bands) & (F.col("ink") <= most_ink)
    verdict = F.when(F.col("ink").isNull(), "other").when(pictured, "graphic").when(F.col("colour") >= colour, "photo").when(music, "music").when((F.col("bands") > 0) & (F.col("ink") <= most_ink), "thin").otherwise("other")
    return features.withColumn("verdict", verdict)
