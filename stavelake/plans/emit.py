"""Queries of laid-out melodies and score documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import emit, excerpts, validate
from ..shared import stored
from .parts import KEYS, TRIM
from .registry import add


def texts_of(notes: DataFrame, measures: DataFrame) -> DataFrame:
    rows = notes.withColumnsRenamed({"page": "doc_id", "alter_": "alter"}).withColumn("part_idx", F.lit(0))
    return emit.score_documents(rows, measures.withColumnRenamed("page", "doc_id"))


def text_counts(notes: DataFrame, measures: DataFrame) -> DataFrame:
    count = lambda what: F.regexp_count("text", F.lit(what)).cast("long")
    return texts_of(notes, measures).select(F.col("doc_id").alias("page"), count("<pitch>").alias("notes"), count("<chord/>").alias("chord_notes"), count("<measure ").alias("bars"))


def validity(notes: DataFrame, measures: DataFrame) -> DataFrame:
    raw = stored(sources.shred_texts(texts_of(notes, measures)), "shredded")  # every check reads it
    return validate.validity_rate(validate.validate(raw), raw)


def with_faults(texts: DataFrame) -> DataFrame:
    """Score texts with a fault on some pages: every seventh is cut off, and every fifth lacks its first pitch."""
    bare = F.regexp_replace("text", "(?s)^(.*?)<pitch>.*?</pitch>", "$1")
    cut = F.expr("substring(text, 1, length(text) - 9)")
    return texts.withColumn("text", F.when(F.col("doc_id") % 7 == 0, cut).when(F.col("doc_id") % 5 == 0, bare).otherwise(F.col("text")))


def faults(notes: DataFrame, measures: DataFrame) -> DataFrame:
    raw = stored(sources.shred_texts(with_faults(texts_of(notes, measures))), "shredded")
    return validate.validate(raw).groupBy(F.col("doc_id").cast("int").alias("page"), "check").agg(F.count("*").alias("n"))


def damaged(texts: DataFrame) -> DataFrame:
    """Score texts with faults of each kind: a document on page p has the p-th modulo 12 of them, or none."""
    t, kind = F.col("text"), F.col("doc_id") % 12
    swap = lambda old, new: F.regexp_replace("text", old, new)
    made = {
        1: F.expr("substring(text, 1, length(text) - 9)"), 2: swap("score-partwise", "opus"), 3: swap("(?s)<part-list>.*?</part-list>", ""), 4: swap("</score-partwise>", '<part id="P9"></part></score-partwise>'),
        5: swap("</part-list>", "</part-list><xsi:x/>"), 6: swap("(?s)<part .*</part>", ""), 7: swap("(?s)^(.*?)<measure ", '$1<measure number="0"><note><duration>4</duration><rest/></note></measure><measure '),
        8: swap("(?s)^(.*?)<measure ", '$1<measure number="0"><note><rest/><rest/><duration>4</duration></note></measure><measure '),
        9: swap("(?s)^(.*?)<measure ", '$1<measure number="0"><note><grace/><rest/><duration>4</duration></note></measure><measure '),
        10: swap("(?s)^(.*?)<measure ", '$1<measure number="0"><attributes><clef/><staves>1</staves></attributes></measure><measure '),
    }
    out = t
    for k, made_text in made.items():
        out = F.when(kind == k, made_text).otherwise(out)
    return texts.withColumn("text", out)


def damage_found(notes: DataFrame, measures: DataFrame) -> DataFrame:
    texts = stored(damaged(texts_of(notes, measures)), "damaged")
    found = validate.document_checks(sources.document_facts(texts)).unionByName(validate.content_model(sources.shred_texts(texts, "doc_id, part_idx, measure_ord, seq, tag, children")))
    detail = F.when(F.col("check") == "parse_error", F.regexp_extract("detail", "^[a-z ]*", 0)).otherwise(F.regexp_replace("detail", "^[0-9]+: ", ""))
    return found.select(F.col("doc_id").cast("int").alias("page"), "check", detail.alias("detail"))


def excerpt_blocks(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Attribute blocks of the excerpt of bars 4 to 9 of each page's score, with the meter that they leave in force."""
    # Bars and their events are read apart, so what the texts say is stored, and only what an excerpt needs of it.
    wanted = ["doc_id", "part_idx", "part_id", "part_name", "measure_ord", "measure_label", "seq", "tag", "declared", "error", *excerpts.PLAIN, "clefs"]
    raw = stored(sources.shred_texts(texts_of(notes, measures), ", ".join(wanted)), "shredded")
    cut = excerpts.excerpt_events(raw, 4, 9)
    blocks = excerpts.with_state(cut).where("tag = 'attributes'")
    return blocks.select(F.col("doc_id").cast("int").alias("page"), (F.col("measure_ord") + 1).alias("measure"), F.col("after.beats").alias("beats"))


add("norm_excerpt_blocks", "notes_v measures_v", excerpt_blocks, """with b as (select page, measure, beats, lag(beats) over (partition by page order by measure) as p from measures_v where measure between 4 and 9)
select page, measure - 3 as measure, beats from b where p is null or p <> beats""")
add("emit_damage", "notes_v measures_v", damage_found, """with p as (select distinct page, page % 12 as k from measures_v)
select page, 'parse_error' as "check", 'unclosed token' as detail from p where k = 1 union all select page, 'unexpected_root', 'opus' from p where k = 2 union all select page, 'no_part_list', 'part-list' from p where k = 3
union all select page, 'empty_part', 'P9' from p where k = 4 union all select page, 'unbound_prefix', 'xsi' from p where k = 5 union all select page, 'parse_error', 'unbound prefix' from p where k = 5
union all select page, 'no_parts', '0' from p where k = 6 union all select page, 'no_notes', '0' from p where k = 6 union all select page, 'content_model', 'no pitch or unpitched or rest' from p where k = 7
union all select page, 'content_model', 'too many rest' from p where k = 8 union all select page, 'content_model', 'a foreign duration' from p where k = 9
union all select page, 'content_model', 'staves too late' from p where k = 10""")
add("emit_faults", "notes_v measures_v", faults, f"""with {TRIM}, p as (select distinct page from tm join notes_v using (event_id, page, staff, voice, measure) where kept and not is_rest)
select distinct page, 'parse_error' as "check", cast(1 as bigint) as n from measures_v where page % 7 = 0 union all select page, 'bare_note', 1 from p where page % 5 = 0 and page % 7 <> 0""")
add("emit_layout", "notes_v", lambda n: emit.lay_out(n.where("not is_rest"), ["page", "staff"], ["measure", "onset", "event_id"]).withColumn("is_rest", F.col("is_rest").cast("int")), """with n as (select page, staff, dur, midi, row_number() over (partition by page, staff order by measure, onset, event_id) as k from notes_v where not is_rest),
lo as (select * from (with recursive r as (select page, staff, cast(0 as bigint) as k, 1 as number, 0 as onset, 0 as used, 0 as midi, 0 as dur from n where k = 1
union all select page, staff, k, case when used + dur > 96 then number + 1 else number end, case when used + dur > 96 then 0 else used end, case when used + dur > 96 then 0 else used end + dur, midi, dur from (select n.page, n.staff, n.k, n.dur, n.midi, r.number, r.used from r join n on n.page = r.page and n.staff = r.staff and n.k = r.k + 1)) select * from r where k > 0))
select page, staff, cast(number as bigint) as measure, cast(onset as bigint) as onset, cast(dur as bigint) as dur, midi, 0 as is_rest from lo
union all select page, staff, number, max(used), 96 - max(used), null, 1 from lo group by page, staff, number having max(used) < 96""")
add("emit_scores", "notes_v measures_v", text_counts, f"""with {TRIM}, p as (select page, staff, voice, measure, start from tm join notes_v using (event_id, page, staff, voice, measure) where kept and not is_rest),
c as (select page, count(*) as notes, count(*) - count(distinct ({KEYS}, measure, start)) as chord_notes from p group by page), b as (select page, count(*) as bars from measures_v group by page)
select page, coalesce(notes, 0) as notes, coalesce(chord_notes, 0) as chord_notes, bars from b left join c using (page)""")
add("emit_validity", "notes_v measures_v", validity, "select count(distinct page) as total, cast(0 as bigint) as failed, count(distinct page) as valid from notes_v")


# marks: ties from every fourth event to the next of its pitch, slurs and words on some, a key for each five bars, and names of some parts
def marked_texts(notes: DataFrame, measures: DataFrame) -> DataFrame:
    e = F.col("event_id")
    rows = notes.withColumnsRenamed({"page": "doc_id", "alter_": "alter"}).withColumn("part_idx", F.lit(0))
    rows = rows.withColumns({"tie": F.when(e % 4 == 0, "start").when(e % 4 == 1, "stop").when(e % 4 == 2, "both"), "slur": F.when(e % 3 == 0, F.when(F.col("midi") % 2 == 0, "start").otherwise("stop")), "lyric": F.when(e % 5 == 0, "la & <li>")})
    bars = measures.withColumnRenamed("page", "doc_id").withColumn("fifths", F.when(F.col("measure") % 5 == 1, F.col("measure") % 3))
    names = rows.where("doc_id % 2 = 0").select("doc_id", "part_idx", F.lit("Voice & <flute>").alias("name")).distinct()
    return emit.score_documents(rows, bars, names)


def mark_counts(notes: DataFrame, measures: DataFrame) -> DataFrame:
    count = lambda what: F.regexp_count("text", F.lit(what)).cast("long")
    counts = {"ties": '<tied type="start"/>', "stops": '<tied type="stop"/>', "slurs": '<slur type="start"', "slur_stops": '<slur type="stop"', "words": "<lyric>", "keys": "<fifths>", "names": "<instrument-name>Voice &amp; &lt;flute&gt;<"}
    return marked_texts(notes, measures).select(F.col("doc_id").alias("page"), *[count(v).alias(k) for k, v in counts.items()])


add("emit_marks", "notes_v measures_v", mark_counts, f"""with {TRIM}, p as (select tm.page, tm.staff, tm.voice, tm.measure, start, event_id, midi, event_id % 4 in (0, 2) as s, event_id % 4 in (1, 2) as t, case when event_id % 3 = 0 then case when midi % 2 = 0 then 'start' else 'stop' end end as kind
  from tm join notes_v using (event_id) where kept and not is_rest),
ti as (select page, cast(sum((s and after)::int) as bigint) as ties, cast(sum((t and before)::int) as bigint) as stops, cast(sum((event_id % 5 = 0)::int) as bigint) as words
  from (select *, coalesce(lead(t) over w, false) as after, coalesce(lag(s) over w, false) as before from p window w as (partition by {KEYS}, midi order by measure, start, event_id)) group by page),
f as (select *, kind is distinct from lag(kind) over (partition by {KEYS} order by measure, start, event_id) as turn from p where kind is not null),
e as (select *, row_number() over (partition by {KEYS} order by measure, start, event_id) as k, lead(kind) over (partition by {KEYS} order by measure, start, event_id) as after from f where turn),
sl as (select page, count(*) filter (kind = 'start') as slurs, count(*) filter (kind = 'stop') as slur_stops from e where not (kind = 'stop' and k = 1) and not (kind = 'start' and after is null) group by page),
ke as (select page, count(*) filter (prev is null or prev <> key) as keys from (select page, measure, key, lag(key) over (partition by page order by measure) as prev from (select page, measure, measure % 3 as key from measures_v where measure % 5 = 1)) group by page)
select page, coalesce(ties, 0) as ties, coalesce(stops, 0) as stops, coalesce(slurs, 0) as slurs, coalesce(slur_stops, 0) as slur_stops, coalesce(words, 0) as words, keys, cast((page % 2 = 0)::int as bigint) as names
from ke left join ti using (page) left join sl using (page) where page in (select page from notes_v)""")
