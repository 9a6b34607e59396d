"""Excerpts and cleaned fragments of raw score events that keep what is in force: meter, divisions, key, staves and clefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ["doc_id", "part_idx"]
PLAIN = ["divisions", "beats", "beat_type", "fifths", "staves"]
#: Staves of a part whose clefs are followed.
STAVES = 8


def _state(clef: list[Column], plain: list[Column]) -> Column:
    clefs = F.filter(F.array(*clef), lambda c: c.isNotNull())
    return F.struct(*[c.alias(n) for n, c in zip(PLAIN, plain)], F.when(F.size(clefs) > 0, clefs).alias("clefs"))


def with_state(raw: DataFrame, staves: int = STAVES) -> DataFrame:
    """`raw` with `before` and `after`: all attributes in force in front of each event and behind it.

    A clef counts for its own staff until that staff gets another one. Documents that did not parse have no events.
    """
    w = Window.partitionBy(*PART).orderBy("measure_ord", "seq")
    of = lambda s: F.filter("clefs", lambda c: c.staff == s)
    named = raw.where("error is null").withColumns({f"clef_{s}": F.when(F.size(of(s)) > 0, F.element_at(of(s), -1)) for s in range(1, staves + 1)})
    to = w.rowsBetween(Window.unboundedPreceding, 0)
    held = _state([F.last(f"clef_{s}", True).over(to) for s in range(1, staves + 1)], [F.last(c, True).over(to) for c in PLAIN])
    # What is in force in front of an event is what the one before it left: one look back, not each attribute followed twice.
    rows = named.withColumn("after", held)
    none = F.lit(None).cast(rows.schema["after"].dataType.simpleString())
    nothing = F.struct(*[none[c].alias(c) for c in [*PLAIN, "clefs"]])
    return rows.withColumn("before", F.coalesce(F.lag("after").over(w), nothing)).drop(*[f"clef_{s}" for s in range(1, staves + 1)])


def change_points(raw: DataFrame) -> DataFrame:
    """`raw` without the attribute blocks that state only what is in force already."""
    return with_state(raw).where((F.col("tag") != "attributes") | ~F.col("before").eqNullSafe(F.col("after"))).drop("before", "after")


def kept_measures(raw: DataFrame, keep: Column | None = None, with_notes: bool = False) -> DataFrame:
    """`raw` cut to the measures for which `keep` holds, and that hold a note if so asked, numbered from 1 in each part.

    The first measure, and one behind a cut in which something changed, opens with a block of all that is in force there, which
    takes the place of its own opening blocks. Blocks that state nothing new go. So what is in force at each kept event is what
    was in force before.
    """
    measure = [*PART, "measure_ord"]
    rows = with_state(raw)
    if keep is not None:
        rows = rows.where(keep)
    if with_notes:
        rows = rows.withColumn("sounds", F.max((F.col("tag") == "note").cast("int")).over(Window.partitionBy(*measure))).where("sounds = 1").drop("sounds")
    other = F.when(F.col("tag") != "attributes", F.col("seq"))
    bars = rows.groupBy(*measure).agg(
        F.min_by("before", other).alias("opens"), F.max_by("after", "seq").alias("closes"), F.min(other).alias("first"), *[F.first(c, True).alias(c) for c in ("part_id", "part_name", "measure_label", "declared")],
    )
    order = Window.partitionBy(*PART).orderBy("measure_ord")
    bars = bars.withColumns({"opens": F.coalesce("opens", "closes"), "last": F.lag("closes").over(order), "cut": F.coalesce(F.lag("measure_ord").over(order) != F.col("measure_ord") - 1, F.lit(True))})
    known = F.exists(F.array(*[F.col(f"opens.{c}").isNotNull() for c in [*PLAIN, "clefs"]]), lambda x: x)
    stated = bars.where(F.col("cut") & known & ~F.col("opens").eqNullSafe(F.col("last")))
    kinds = {f.name: f.dataType for f in raw.schema}
    children = F.filter(F.array(*[F.when(F.col(f"opens.{c}").isNotNull(), n) for c, n in (("divisions", "divisions"), ("fifths", "key"), ("beats", "time"), ("staves", "staves"), ("clefs", "clef"))]), lambda x: x.isNotNull())
    given = {c: F.col(f"opens.{c}") for c in [*PLAIN, "clefs"]} | {"seq": F.lit(-1), "tag": F.lit("attributes"), "children": children} | {c: F.col(c) for c in [*measure, "part_id", "part_name", "measure_label", "declared"]}
    blocks = stated.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in raw.columns])
    leading = F.col("cut") & (F.col("seq") < F.coalesce("first", F.col("seq") + 1))
    new = ~F.col("before").eqNullSafe(F.col("after")) & ~leading
    fresh = rows.join(bars.select(*measure, "first", "cut"), measure).where((F.col("tag") != "attributes") | new).select(*raw.columns).unionByName(blocks)
    number = F.dense_rank().over(Window.partitionBy(*PART).orderBy("measure_ord")).cast("int")
    out = fresh.withColumns({"nth": number, "place": (F.row_number().over(Window.partitionBy(*measure).orderBy("seq")) - 1).cast("int")})
    return out.withColumns({"measure_ord": F.col("nth") - 1, "measure_label": F.col("nth").cast("string"), "seq": F.col("place")}).select(*raw.columns)


def excerpt_events(raw: DataFrame, lo: int, hi: int) -> DataFrame:
    """Measures numbered lo to hi of every part, and those without a whole number, as a score of its own."""
    number = F.col("measure_label").try_cast("int")
    return kept_measures(raw, number.isNull() | number.between(lo, hi))


def clean_events(raw: DataFrame) -> DataFrame:
    """Measures that hold a note, without repeated attribute blocks."""
    return kept_measures(raw, with_notes=True)
