"""Queries of repairs, outliers, staff traces, roles and measure indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assemble, audit, geometry, reconcile, scoring
from ..shared import shared_dir
from .layouts import MATCHED
from .registry import add

A, B = (lambda r: r.where("run = 'A'")), (lambda r: r.where("run = 'B'"))

# repairs: run B is the repaired one, with some notes made rests
add("rec_repair_reports", "runs_v", lambda r: reconcile.repair_reports(A(r), B(r).withColumn("is_rest", F.col("is_rest") | (F.col("event_id") % 17 == 0)), ["page"]), """with s as (
  select page, measure, voice, dur, staff, run, midi, is_rest or (run = 'B' and event_id % 17 = 0) as rest from runs_v),
c as (select page, measure, voice, dur, rest, case when not rest then midi end as pitch, count(*) filter (run = 'A') as b, count(*) filter (run = 'B') as a from s group by all),
d as (select page, cast(sum(case when rest then greatest(a - b, 0) else 0 end) as bigint) as rests_added, count(distinct case when rest and a > b then measure * 100 + voice end) as voices_padded,
  cast(sum(greatest(b - a, 0)) as bigint) as content_lost, cast(sum(greatest(a - b, 0)) as bigint) as content_gained from c group by page),
t as (select page, count(distinct staff) filter (run = 'A') as sb, count(distinct staff) filter (run = 'B') as sa from s group by page)
select page, nullif(sb, 0) as staves_before, nullif(sa, 0) as staves_after, (sa > 0 and sb > 0 and sa <> sb)::int as staves_differ, rests_added, voices_padded, content_lost, content_gained from d join t using (page)""")


# shifts and outliers
def lifted(runs: DataFrame) -> DataFrame:
    """Sounding notes, a third of the pages an octave of positions up and a third three positions."""
    return runs.where("not is_rest").withColumn("midi", F.col("midi") + F.when(F.col("page") % 3 == 0, 7).when(F.col("page") % 3 == 1, 3).otherwise(0))


add("score_shift_verdicts", "runs_v", lambda r: scoring.shift_verdicts(A(r).where("not is_rest"), lifted(A(r)), ["page"], 55), """with a as (select page, midi, count(*) as x from runs_v where run = 'A' and not is_rest group by all),
s as (select a.page, b.midi + case a.page % 3 when 0 then 7 when 1 then 3 else 0 end - a.midi as shift, cast(sum(least(a.x, b.x)) as bigint) as support from a join a b on a.page = b.page group by all)
select page, cast(shift as int) as shift, support, case when support < 55 then 'thin' when shift = 0 then 'none' when abs(shift) = 7 then 'octave' else 'shifted' end as verdict
from s where shift between -14 and 14 qualify row_number() over (partition by page order by support desc, shift) = 1""")


def system_features(notes: DataFrame) -> DataFrame:
    late = F.sum((F.col("measure") % 3 == 0).cast("int")) / F.count("*")
    return notes.groupBy(F.col("page").alias("book"), F.col("system").alias("page")).agg(F.sum("dur").alias("ink_ratio"), F.countDistinct("measure").alias("staff_ratio"), F.abs(late - 0.25).alias("deviance"))


add("score_page_outliers", "notes_v", lambda n: scoring.page_outliers(system_features(n), ["ink_ratio", "staff_ratio"], {"deviance": 0.12}), """with f as (
  select page as book, system as page, cast(sum(dur) as double) as ink_ratio, cast(count(distinct measure) as double) as staff_ratio, abs(cast(sum((measure % 3 = 0)::int) as double) / count(*) - 0.25) as deviance from notes_v group by all),
m as (select book, median(ink_ratio) as ink, median(staff_ratio) as staff from f group by book having count(*) >= 4)
select book, page, 'ink_ratio' as feature, ink_ratio as value, ink as median from f join m using (book) where ink > 0 and abs(ink_ratio - ink) > 0.5 * ink
union all select book, page, 'staff_ratio', staff_ratio, staff from f join m using (book) where staff > 0 and abs(staff_ratio - staff) > 0.5 * staff
union all select book, page, 'deviance', deviance, null from f join m using (book) where deviance > 0.12""")

# heads on and around the staff
def heads(r: DataFrame, run: str) -> DataFrame:
    x = F.col("event_id") % 997 / 997 + F.lit(0.001 if run == "B" else 0)
    return r.where(f"run = '{run}' and not is_rest").select("page", "staff", "measure", x.alias("x"), (F.col("midi") % 17 - 8).alias("y"))


CORE = MATCHED.replace("midi as y from runs_v where not is_rest", "midi % 17 - 8 as y from runs_v where not is_rest and abs(midi % 17 - 8) <= 5")
add("geo_staff_traces", "runs_v", lambda r: geometry.staff_traces(heads(r, "A"), heads(r, "B"), ["page", "staff", "measure"]), f"""with {CORE},
p as (select page, staff, measure, run, midi % 17 - 8 as y from runs_v where not is_rest),
c as (select page, staff, measure, count(*) filter (run = 'A' and abs(y) <= 5) as page_events, count(*) filter (run = 'B' and abs(y) <= 5) as engraved_events, count(*) filter (run = 'B') as engraved_events_wide
  from p group by page, staff, measure having count(distinct run) = 2),
x as (select page, staff, measure, count(*) as x_matched, cast(sum((ay = by_)::int) as bigint) as same_height from mt group by all),
hs as (select page, staff, measure, run, y, count(*) as n from p group by all),
sh as (select * from (select a.page, a.staff, a.measure, a.y - b.y as shift, cast(sum(least(a.n, b.n)) as bigint) as support from hs a join hs b on a.run = 'A' and b.run = 'B' and (a.page, a.staff, a.measure) = (b.page, b.staff, b.measure) group by all)
  where shift between -14 and 14 qualify row_number() over (partition by page, staff, measure order by support desc, shift) = 1)
select page, staff, measure, page_events, engraved_events, engraved_events_wide, coalesce(x_matched, 0) as x_matched, coalesce(same_height, 0) as same_height, cast(shift as int) as shift, coalesce(support, 0) as support
from c left join x using (page, staff, measure) left join sh using (page, staff, measure)""")


# roles: on every fourth page both staves are given one
def roles(notes: DataFrame) -> DataFrame:
    return notes.select("page", "staff", F.when(F.col("page") % 4 == 0, "piano").otherwise(F.concat(F.lit("staff-"), F.col("staff").cast("string"))).alias("role")).distinct()


def triplets(notes: DataFrame) -> DataFrame:
    return notes.withColumn("ratio", F.when(F.col("event_id") % 8 < 3, "3:2"))


ROLES = "ro as (select distinct page, staff, case when page % 4 = 0 then 'piano' else 'staff-' || staff end as role from notes_v)"
add("asm_role_totals", "notes_v", lambda n: assemble.role_totals(triplets(n), roles(n)), f"""with {ROLES}, t as (
  select page, staff, coalesce((lag(onset + dur) over (partition by page, staff, voice, measure order by onset, event_id) <> onset)::int, 1) as new from notes_v where event_id % 8 < 3),
u as (select page, role, cast(sum(new) as bigint) as tuplets from t join ro using (page, staff) group by all),
n as (select page, role, count(*) as notes, cast(sum((not is_rest)::int) as bigint) as pitched, count(distinct staff) as staves from notes_v join ro using (page, staff) group by all)
select page, role, staves, notes, pitched, coalesce(tuplets, 0) as tuplets from n left join u using (page, role)""")
add("asm_duplicate_roles", "notes_v", lambda n: assemble.duplicate_roles(roles(n)), f"with {ROLES} select page, role, array_to_string(list_sort(list(staff)), ',') as staves from ro group by page, role having count(*) > 1")


# fragments and measure indexes
def fragments(notes: DataFrame) -> DataFrame:
    mark = F.col("event_id") % 5 == 0
    return notes.select(
        F.col("page").alias("doc_id"), (F.col("staff") - 1).alias("part_idx"), F.col("measure").alias("measure_ord"), F.when(mark, "attributes").otherwise("note").alias("tag"),
        "is_rest", "is_chord", F.when(mark, (F.col("event_id") % 4).cast("int")).alias("staves"), F.when(F.col("page") % 9 == 0, "cut off").alias("error"),
    )


add("audit_fragment_stats", "notes_v", lambda n: audit.fragment_stats(fragments(n)), """with r as (select page as doc_id, staff, measure, event_id % 5 <> 0 as note, is_rest, is_chord, case when event_id % 5 = 0 then event_id % 4 end as staves, case when page % 9 = 0 then 'cut off' end as error from notes_v),
p as (select doc_id, staff, count(distinct measure) as length, max(staves) as staves, sum(note::int) as notes, sum((note and not is_rest and not is_chord)::int) as sounding, sum((note and is_rest)::int) as rests,
  sum((note and is_chord and not is_rest)::int) as chord_tones from r where error is null group by all),
q as (select doc_id, count(*) as parts, cast(sum(length) as bigint) as measures, max(length) as longest, cast(greatest(coalesce(max(staves), 1), 1) as bigint) as staves, cast(sum(notes) as bigint) as notes,
  cast(sum(sounding) as bigint) as sounding, cast(sum(rests) as bigint) as rests, cast(sum(chord_tones) as bigint) as chord_tones from p group by doc_id)
select * from (select distinct doc_id, error from r) left join q using (doc_id)""")


def indexed(measures: DataFrame) -> DataFrame:
    name = f"measure_index_{uuid.uuid4().hex}"
    return audit.save_measure_index(measures, name, 8, f"{shared_dir(measures.sparkSession)}/{name}")


add("audit_indexed_silence", "notes_v measures_v", lambda n, m: audit.indexed_silence_run(n, indexed(m), 2), """with x as (select m.page, m.measure, has, sum(coalesce(has, 0)) over (partition by m.page order by m.measure) as island from measures_v m
left join (select distinct page, measure, 1 as has from notes_v) h on m.page = h.page and m.measure = h.measure)
select page, measure, run from (select page, measure, cast(row_number() over (partition by page, island order by measure) as int) as run from x where has is null) where run >= 2""")
