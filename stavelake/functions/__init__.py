"""Column functions over pitches, durations and labels. All are built-in expressions; none runs Python in tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of an exact duration in a quarter note: 2^5 * 3^2 * 5 * 7.
Q = 10080
#: Ticks in a quarter note.
TICKS = 24

# Steps of the scale, semitones above C, note names, clef bounds as diatonic numbers, written values.
STEPS = "CDEFGAB"
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
CLEF_BOUNDS = {"G": (30, 38), "F": (18, 26), "C": (30, 38)}
ACCIDENTALS = {"-2": "bb", "-1": "b", "0": "", "1": "#", "2": "##", "": ""}
VALUES = {"whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25, "32nd": 0.125, "64th": 0.0625}
TUPLET_TYPES = {(2, 3): ("quarter", False), (3, 2): ("eighth", False), (3, 4): ("quarter", False), (5, 4): ("16th", False), (6, 4): ("eighth", True), (7, 4): ("16th", False), (9, 8): ("32nd", False)}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict, key: Column, kind: str = "int") -> Column:
    """A literal map; null for keys that it lacks."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key].cast(kind)


def diatonic(step: Column | str, octave: Column | str) -> Column:
    return _c(octave) * 7 + lookup({s: i for i, s in enumerate(STEPS)}, F.upper(_c(step)))


def midi(step: Column | str, alter: Column | str, octave: Column | str) -> Column:
    return (_c(octave) + 1) * 12 + lookup(SEMITONES, _c(step)) + _c(alter)


def midi_from_text(c: Column | str) -> Column:
    """`F#4` to 66; null unless step, accidentals and an octave of digits without leading zero make up the whole text."""
    m = lambda g: F.regexp_extract(_c(c), r"^([A-G])([#b]*)(0|[1-9][0-9]*)$", g)
    sharps, flats = F.length(F.translate(m(2), "b", "")), F.length(F.translate(m(2), "#", ""))
    return F.when(m(1) != "", (m(3).try_cast("int") + 1) * 12 + lookup(SEMITONES, m(1)) + sharps - flats)


def midi_from_name(c: Column | str) -> Column:
    """As a spoken name: any case, octave 4 if there is none; 0 for an empty name."""
    text = F.trim(_c(c))
    m = lambda g: F.regexp_extract(text, r"^(.)([#b]*)(-?[0-9]*)$", g)
    sharps, flats = F.length(F.translate(m(2), "b", "")), F.length(F.translate(m(2), "#", ""))
    octave = F.coalesce(m(3).try_cast("int"), F.lit(4))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(12 * (octave + 1) + F.coalesce(lookup(SEMITONES, F.upper(m(1))), F.lit(0)) + sharps - flats)


def midi_name(c: Column | str) -> Column:
    """Sharps only; halves round to even."""
    m = F.bround(_c(c).cast("double")).cast("int")
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(m, F.lit(12)) + 1), (F.floor(m / 12) - 1).cast("string"))


def hz_to_midi(c: Column | str) -> Column:
    return 69 + 12 * F.log2(_c(c) / 440)


def hz_to_midi_live(c: Column | str) -> Column:
    return F.when(_c(c) >= 80, hz_to_midi(c))


def midi_to_hz(c: Column | str) -> Column:
    return 440 * F.pow(F.lit(2.0), (_c(c) - 69) / 12)


def pitch_name(step: Column | str, alter: Column | str, octave: Column | str) -> Column:
    """Unknown alterations are marked with `?`."""
    text = F.coalesce(_c(alter).cast("string"), F.lit(""))
    return F.concat(_c(step), F.coalesce(lookup(ACCIDENTALS, text, "string"), F.concat(F.lit("?"), text)), _c(octave).cast("string"))


def transpose(c: Column | str, semitones: int) -> Column:
    """(step, alter, octave) of a MIDI number moved by semitones, spelled with sharps; null stays null."""
    m = _c(c) + semitones
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(m, F.lit(12)).cast("int") + 1)
    return F.when(m.isNotNull(), F.struct(F.substring(name, 1, 1).alias("step"), (F.length(name) - 1).alias("alter"), (F.floor(m / 12) - 1).cast("int").alias("octave")))


def to_q(duration: Column | str, divisions: Column | str) -> Column:
    """Exact duration; null where the divisions do not divide a quarter's units; no duration is 0."""
    d = _c(divisions).cast("long")
    return F.when(F.lit(Q) % d == 0, F.coalesce(_c(duration), F.lit(0)).cast("long") * (F.lit(Q) / d).cast("long"))


def to_ticks(duration: Column | str, divisions: Column | str, kind: Column | str) -> Column:
    """Ticks, halves to even; from the written type if there is no duration; else 0."""
    exact = F.bround(_c(duration) * TICKS / _c(divisions)).cast("int")
    return F.coalesce(exact, lookup({k: int(v * TICKS) for k, v in VALUES.items() if v * TICKS == int(v * TICKS)}, _c(kind)), F.lit(0))


def bar_length(beats: Column | str, beat_type: Column | str, divisions: int = TICKS) -> Column:
    return F.floor(_c(beats) * divisions * 4 / _c(beat_type)).cast("int")


def clef_bounds(sign: Column | str) -> Column:
    """(low, high) as diatonic numbers; no sign is treble, an unknown one null."""
    s = F.upper(F.coalesce(_c(sign), F.lit("G")))
    low, high = lookup({k: v[0] for k, v in CLEF_BOUNDS.items()}, s), lookup({k: v[1] for k, v in CLEF_BOUNDS.items()}, s)
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def plain_values(divisions: int = TICKS) -> dict[int, tuple[str, int]]:
    """Ticks of every written value with up to two dots that is whole; of equal lengths the one with fewer dots."""
    lengths = [(divisions * VALUES[name] * factor, name, dots) for dots, factor in ((2, 1.75), (1, 1.5), (0, 1.0)) for name in VALUES]
    return {int(ticks): (name, dots) for ticks, name, dots in lengths if ticks.is_integer()}


def divisors(n: int) -> list[int]:
    return [d for d in range(1, n + 1) if n % d == 0]


def written_ratio(ticks: Column | str) -> Column:
    """(type, dots, actual, normal) of any positive tick count: a plain value with the ratio that makes it exact.

    The ratio with the smallest greater term wins, then the nearest value, then the shorter one; a plain count has 1:1.
    """
    t = _c(ticks).cast("int")
    options = []
    for value, (name, dots) in sorted(plain_values().items()):
        common = F.array_max(F.filter(F.array(*map(F.lit, divisors(value))), lambda d: t % d == 0))
        actual, normal = (F.lit(value) / common).cast("int"), (t / common).cast("int")
        options.append(F.struct(F.greatest(actual, normal).alias("most"), F.abs(t - value).alias("off"), F.lit(value).alias("value"), F.lit(name).alias("type"), F.lit(dots).alias("dots"), actual.alias("actual"), normal.alias("normal")))
    best = F.array_min(F.array(*options))
    plain = F.struct(*[written_value(t)[k].alias(k) for k in ("type", "dots")], F.lit(1).alias("actual"), F.lit(1).alias("normal"))
    return F.when(t > 0, F.when(written_value(t).isNotNull(), plain).otherwise(F.struct(*[best[k].alias(k) for k in ("type", "dots", "actual", "normal")])))


def split_plain(ticks: Column | str, most: int = 12) -> Column:
    """At most `most` plain lengths or whole multiples of a whole note, the largest that fits first; what is left over is not in them."""
    whole = 4 * TICKS
    lengths = F.array(*map(F.lit, sorted({*plain_values(), *range(whole, 9 * whole, whole)})))
    start = F.struct(_c(ticks).cast("int").alias("left"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        fit = F.array_max(F.filter(lengths, lambda v: v <= state["left"]))
        more = F.struct((state["left"] - fit).alias("left"), F.concat(state["out"], F.array(fit)).alias("out"))
        return F.when(fit.isNull(), state).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda state: state["out"])


def written_value(ticks: Column | str) -> Column:
    """(type, dots) of a plain tick count, else null."""
    plain = plain_values()
    name = lookup({k: v[0] for k, v in plain.items()}, _c(ticks).cast("int"), "string")
    return F.when(name.isNotNull(), F.struct(name.alias("type"), lookup({k: v[1] for k, v in plain.items()}, _c(ticks).cast("int")).alias("dots")))


def plain_floor(ticks: Column | str) -> Column:
    """The largest plain tick count that fits; null if none does."""
    return F.array_max(F.filter(F.array(*map(F.lit, sorted(plain_values()))), lambda v: v <= _c(ticks)))


def tuplet_type(actual: Column | str, normal: Column | str) -> Column:
    """(type, dotted) for ratios in use, else null."""
    key = F.concat_ws(":", _c(actual).cast("string"), _c(normal).cast("string"))
    name = lookup({f"{a}:{b}": t for (a, b), (t, _) in TUPLET_TYPES.items()}, key, "string")
    return F.when(name.isNotNull(), F.struct(name.alias("type"), lookup({f"{a}:{b}": d for (a, b), (_, d) in TUPLET_TYPES.items()}, key, "boolean").alias("dotted")))


def written_q(q: Column | str, actual: Column | str, normal: Column | str) -> Column:
    return F.when(_c(actual).isNull(), _c(q)).otherwise((_c(q) * _c(actual) / _c(normal)).cast("long"))


def measure_key(label: Column | str) -> Column:
    """Sort key: labels of digits by number, others after them by text."""
    number = F.when(_c(label).rlike(r"^[0-9]+$"), _c(label).try_cast("long"))
    return F.struct(number.isNull().alias("other"), number.alias("number"), _c(label).alias("label"))


def natural_order(name: Column | str) -> Column:
    """An order key in which each number of a name counts as a number: `sys2.s10` before `sys10.s2`."""
    digits = lambda t: F.regexp_replace(t, "^0+(?=[0-9])", "")
    number = lambda t: F.concat(F.lpad(F.length(digits(t)).cast("string"), 3, "0"), digits(t))
    return F.transform(F.regexp_extract_all(_c(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda t: F.when(t.rlike("^[0-9]"), number(t)).otherwise(t))


def natural_key(name: Column | str) -> Column:
    """Sort key of a name by its last number, so s2 comes before s10."""
    return F.struct(F.regexp_extract(_c(name), r"^(.*?)[0-9]*$", 1).alias("stem"), F.regexp_extract(_c(name), r"([0-9]*)$", 1).try_cast("long").alias("number"))


def page_stem(n: Column | str) -> Column:
    return F.concat(F.lit("p"), F.lpad(_c(n).cast("string"), 4, "0"))


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-"), F.lit("-"))


def staff_role(size: Column | str, depth: Column | str) -> Column:
    """Role of the depth-th staff (from 0) of a system: voice over piano for three or more."""
    n, d = _c(size), _c(depth)
    return (
        F.when((n == 2) & (d == 0), "piano-treble").when((n == 2) & (d == 1), "piano-bass").when(n < 2, F.concat(F.lit("staff-"), d.cast("string")))
        .when(d == 0, "voice").when(d == 1, "piano-treble").when(d == n - 1, "piano-bass").otherwise("piano-upper")
    )


def part_label(braced: Column | str, ordinal: Column | str) -> Column:
    return F.when(_c(braced), "Piano").when(_c(ordinal) == 1, "Voice").otherwise(F.concat(F.lit("Voice "), _c(ordinal).cast("string")))


def upper_median(values: Column) -> Column:
    """The greater of the middle two of an even number."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))
