"""Scores against truth, features against a book's own, and shifts between note lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import align
from .audit import SK, long


def match_counts(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: notes in both, missed and spurious, as multisets of (measure, onset, dur, midi)."""
    cols = [*keys, "measure", "onset", "dur", "midi"]
    a = truth.where("not is_rest").groupBy(*cols).agg(F.count("*").alias("a"))
    b = pred.where("not is_rest").groupBy(*cols).agg(F.count("*").alias("b"))
    both = a.join(b, cols, "full_outer").na.fill(0, ["a", "b"])
    return both.groupBy(*keys).agg(long(F.sum(F.least("a", "b"))).alias("matched"), long(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0)))).alias("missed"), long(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0)))).alias("spurious"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and their harmonic mean in thousandths; 0 where nothing was there."""
    ratio = lambda n, d: F.when(d == 0, 0).otherwise(F.floor(1000 * n / d)).cast("long")
    m, x, s = F.col("matched"), F.col("missed"), F.col("spurious")
    return counts.withColumns({"precision": ratio(m, m + s), "recall": ratio(m, m + x), "f1": ratio(2 * m, 2 * m + x + s)})


def melody(notes: DataFrame, staff: int | None = None) -> DataFrame:
    """Pitched notes of a page in order of measure, onset, staff and voice."""
    own = notes.where("not is_rest") if staff is None else notes.where(~F.col("is_rest") & (F.col("staff") == staff))
    w = Window.partitionBy("page").orderBy("measure", "onset", "staff", "voice", "event_id")
    return own.select("page", "event_id", "midi", F.row_number().over(w).alias("place"))


def corrupt(notes: DataFrame, kind: str) -> DataFrame:
    """A known fault in every stream: drop each fifth note, shift by a tone, double, flood by six, or turn to rests."""
    k = F.row_number().over(Window.partitionBy(*SK).orderBy("measure", "onset", "event_id"))
    if kind == "drop":
        return notes.withColumn("k", k).where("k % 5 <> 0").drop("k")
    if kind == "shift":
        return notes.withColumn("midi", F.col("midi") + 2)
    if kind in ("double", "flood"):
        return notes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2 if kind == "double" else 6)))).drop("copy")
    if kind == "rests":
        return notes.withColumn("is_rest", F.lit(True))
    raise ValueError(kind)


def position_shift(a: DataFrame, b: DataFrame, keys: list[str], span: int = 14) -> DataFrame:
    """The shift of positions, up to `span` either way, that makes two histograms agree best; ties to the lowest."""
    left = a.groupBy(*keys, "midi").agg(F.count("*").alias("x"))
    right = b.groupBy(*keys, "midi").agg(F.count("*").alias("y"))
    moved = left.select(*keys, F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("shift"), "midi", "x").withColumn("midi", F.col("midi") + F.col("shift"))
    support = moved.join(right, [*keys, "midi"]).groupBy(*keys, "shift").agg(long(F.sum(F.least("x", "y"))).alias("support"))
    w = Window.partitionBy(*keys).orderBy(F.desc("support"), "shift")
    return support.withColumn("k", F.row_number().over(w)).where("k = 1").select(*keys, "shift", "support")


def shift_verdicts(a: DataFrame, b: DataFrame, keys: list[str], least: int = 1, octave: int = 7) -> DataFrame:
    """`position_shift` of staff positions in words: none, octave (a whole octave up or down), shifted, or thin below `least` heads."""
    found = F.when(F.col("support") < least, "thin").when(F.col("shift") == 0, "none").when(F.abs("shift") == octave, "octave").otherwise("shifted")
    return position_shift(a, b, keys, 2 * octave).withColumn("verdict", found)


def page_outliers(features: DataFrame, relative: list[str], absolute: dict[str, float], least: int = 4) -> DataFrame:
    """(book, page, feature, value, median) of pages that stand out in their book.

    A `relative` feature stands out more than half off the book's median, where that is above zero; an `absolute` one above
    its bound, without a median. Books of fewer than `least` pages have no pages that stand out. A null value does not.
    """
    names = [*relative, *absolute]
    rows = features.select("book", "page", F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("nth", "value"))
    medians = rows.groupBy("book", "nth").agg(F.expr("percentile(value, 0.5)").alias("median"), F.count("*").alias("n")).where(F.col("n") >= least)
    far = (F.col("nth") < len(relative)) & (F.col("median") > 0) & (F.abs(F.col("value") - F.col("median")) > 0.5 * F.col("median"))
    for i, (name, bound) in enumerate(absolute.items(), len(relative)):
        far = far | ((F.col("nth") == i) & (F.col("value") > bound))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("nth") + 1)
    return rows.join(medians, ["book", "nth"]).where(far).select("book", "page", named.alias("feature"), "value", F.when(F.col("nth") < len(relative), F.col("median")).alias("median"))


def feature_outliers(features: DataFrame, feature: str, least: int = 4) -> DataFrame:
    """Rows more than half off the median of their book; books with fewer than `least` rows have none."""
    med = features.groupBy("book").agg(F.expr(f"percentile({feature}, 0.5)").alias("median"), F.count("*").alias("n")).where(F.col("n") >= least)
    return features.join(med, "book").where(F.abs(F.col(feature) - F.col("median")) * 2 > F.col("median")).select("book", "page", feature, "median")


def smoothed(frames: DataFrame, keys: list[str], order: list[str], k: int = 5, least: int = 2) -> DataFrame:
    """Upper median over k frames around each; null with fewer than `least` voiced ones."""
    from ..functions import upper_median

    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k // 2), k // 2)
    around = F.collect_list("midi").over(w)
    return frames.withColumn("smooth", F.when(F.size(around) >= least, upper_median(around)))


def pitch_runs(frames: DataFrame, keys: list[str], order: list[str], least: int = 2) -> DataFrame:
    """Runs of at least `least` frames of one pitch."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = frames.withColumn("new", F.coalesce((F.col("midi") != F.lag("midi").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("midi").alias("midi"), long(F.count("*")).alias("n")).where(F.col("n") >= least)


def score_notes(truth: DataFrame, pred: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: notes of both, exact, wrong in duration, pitch or both, of the right letter only, missed and spurious.

    Notes have (midi, letter, dur, is_rest). They are aligned by pitch; what stays loose is paired in order, and the rest
    of the longer side is missed or spurious. Rests are aligned and never counted.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    value = F.when(F.col("is_rest"), "rest").otherwise(F.col("midi").cast("string"))
    sides = {}
    for name, df in (("left", truth), ("right", pred)):
        sides[name] = df.select(*keys, "letter", "dur", "is_rest", value.alias("value"), place.alias("place"))
    ops = align(sides["left"], sides["right"], keys, "value", ["place"])
    t = sides["left"].select(*keys, F.col("place").alias("left"), F.col("letter").alias("t_letter"), F.col("dur").alias("t_dur"), F.col("is_rest").alias("t_rest"))
    p = sides["right"].select(*keys, F.col("place").alias("right"), F.col("letter").alias("p_letter"), F.col("dur").alias("p_dur"), F.col("is_rest").alias("p_rest"))
    rank = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    matched = ops.where("op = 'm'").join(t, [*keys, "left"]).join(p, [*keys, "right"]).where("not t_rest").withColumn("kind", F.when(F.col("t_dur") == F.col("p_dur"), "exact").otherwise("duration_wrong"))
    lost = ops.where("op = 'd'").join(t, [*keys, "left"]).where("not t_rest").select(*keys, rank("left").alias("nth_loose"), "t_letter", "t_dur")
    extra = ops.where("op = 'i'").join(p, [*keys, "right"]).where("not p_rest").select(*keys, rank("right").alias("nth_loose"), "p_letter", "p_dur")
    kind = F.when(F.col("p_dur").isNull(), "missed").when(F.col("t_dur").isNull(), "spurious").when(F.col("t_dur") == F.col("p_dur"), "pitch_wrong").otherwise("both_wrong")
    loose = lost.join(extra, [*keys, "nth_loose"], "full_outer").withColumn("kind", kind)
    rows = matched.select(*keys, "kind", F.lit(0).alias("letter")).union(loose.select(*keys, "kind", ((F.col("kind") == "pitch_wrong") & (F.col("t_letter") == F.col("p_letter"))).cast("int").alias("letter")))
    n = lambda *kinds: long(F.sum(F.col("kind").isin(*kinds).cast("int")))
    both = ("exact", "duration_wrong", "pitch_wrong", "both_wrong")
    return rows.groupBy(*keys).agg(n(*both, "missed").alias("truth_notes"), n(*both, "spurious").alias("pred_notes"), *[n(k).alias(k) for k in (*both, "missed", "spurious")], long(F.sum("letter")).alias("letter_only"))


def case_rows(scores: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """One row for each labelled case with its counts; a case without a score has zeros."""
    counts = [c for c in scores.columns if c != key]
    return cases.join(scores, key, "left").na.fill(0, counts)


def melody_diff(truth: DataFrame, pred: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key, by pitch alone: exact, wrong_pitch, missed and spurious notes, and precision, recall and f1 in thousandths.

    What the alignment leaves loose is paired in number: the lesser side is wrong_pitch, the rest missed or spurious.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    sides = [df.where("not is_rest").select(*keys, F.col("midi").cast("string").alias("value"), place.alias("place")) for df in (truth, pred)]
    ops = align(*sides, keys, "value", ["place"]).groupBy(*keys).agg(*[long(F.sum((F.col("op") == k).cast("int"))).alias(k) for k in "mdi"])
    loose = F.least("d", "i")
    counts = ops.select(
        *keys, (F.col("m") + F.col("d")).alias("truth_notes"), (F.col("m") + F.col("i")).alias("pred_notes"), F.col("m").alias("exact"),
        loose.alias("wrong_pitch"), (F.col("d") - loose).alias("missed"), (F.col("i") - loose).alias("spurious"),
    )
    ratio = lambda n, d: F.when(d == 0, 0).otherwise(F.floor(1000 * n / d)).cast("long")
    return counts.withColumns({"precision": ratio(F.col("exact"), F.col("pred_notes")), "recall": ratio(F.col("exact"), F.col("truth_notes")), "f1": ratio(2 * F.col("exact"), F.col("truth_notes") + F.col("pred_notes"))})


CORRUPTIONS = ("drop", "shift", "double", "flood", "rests")


def corrupted_cases(notes: DataFrame, kinds: tuple[str, ...] = CORRUPTIONS) -> DataFrame:
    """Each page as it is (kind `good`) and under each corruption, with `good` telling which."""
    out = notes.withColumns({"kind": F.lit("good"), "good": F.lit(True)})
    for kind in kinds:
        out = out.unionByName(corrupt(notes, kind).withColumns({"kind": F.lit(kind), "good": F.lit(False)}))
    return out


def flagged_cases(cases: DataFrame, baseline: DataFrame, off: float = 0.1) -> DataFrame:
    """(page, kind, good, flagged): a case is flagged if its sounding notes, or its ink, are off those of the page by more than a share."""
    measures = [long(F.sum((~F.col("is_rest")).cast("int"))).alias("sounding"), long(F.sum("dur")).alias("ink")]
    base = baseline.groupBy("page").agg(*measures).select("page", F.col("sounding").alias("b_sounding"), F.col("ink").alias("b_ink"))
    rows = cases.groupBy("page", "kind", "good").agg(*measures).join(base, "page")
    far = lambda c: F.abs(F.col(c) - F.col(f"b_{c}")) > off * F.col(f"b_{c}")
    return rows.select("page", "kind", "good", (far("sounding") | far("ink")).alias("flagged"))


def confusion(cases: DataFrame) -> DataFrame:
    """One row: broken cases that were flagged or not, good ones that were or not, recall and precision in thousandths."""
    n = lambda good, hit: long(F.coalesce(F.sum(((F.col("good") == good) & (F.col("flagged") == hit)).cast("int")), F.lit(0)))
    out = cases.agg(n(False, True).alias("tp"), n(False, False).alias("fn"), n(True, True).alias("fp"), n(True, False).alias("tn"))
    ratio = lambda d: F.floor(1000 * F.col("tp") / F.greatest(F.col("tp") + F.col(d), F.lit(1))).cast("long")
    return out.withColumns({"recall": ratio("fn"), "precision": ratio("fp")})


def catch_rates(cases: DataFrame) -> DataFrame:
    """Broken cases of each kind, and how many were flagged."""
    return cases.where("not good").groupBy("kind").agg(long(F.sum(F.col("flagged").cast("int"))).alias("caught"), long(F.count("*")).alias("cases"))
