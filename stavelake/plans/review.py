"""Queries of the review, of whole-page checks, of confusion and melody scores, and of joined parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assemble, audit, pattern, reconcile, review, scoring
from . import catalog as C
from .parts import aligned
from .registry import add

A, B = C.A, C.B

# audit over all checks
UNCLEFFED = "select page, system, staff, case when page % 10 <> 0 then sign end as sign, line from clefs_v"
SILENT = """si as (select page, measure from (select page, measure, row_number() over (partition by page, island order by measure) as run from (
  select m.page, m.measure, has, sum(coalesce(has, 0)) over (partition by m.page order by m.measure) as island from measures_v m
  left join (select distinct page, measure, 1 as has from notes_v) h on m.page = h.page and m.measure = h.measure) where has is null) where run >= 3)"""
EVERY = f"""{C.FLAGS}, {C.MODAL}, {C.PLACED}, {C.MELODY}, {SILENT},
fd as (select page, arg_min({C.BAR}, measure) as declared from measures_v group by page),
op as (select {C.SK} from (select {C.SK}, (position < low - 4 or position > high + 4)::int as o from pl) group by {C.SK} having sum(o) > 2 and sum(o) * 20 > count(*)),
cc as (select page, l[len(l) // 2 + 1] as med, low, high from (select {C.SK}, system, low, high, list_sort(list(position)) as l from pl group by all)),
vl as (select n.page, measure, abs(midi - lag(midi) over (partition by n.page, n.staff order by measure, onset, event_id)) as leap from notes_v n join me using (page, staff) where not is_rest),
al as (select * from fl union all select 'wrong_meter', 3, page, null from mo join fd using (page) where modal <> declared
  union all select 'missing_meter', 2, page, null from measures_v group by page having count(beats) = 0
  union all select 'outlier_pitch', 2, page, null from op union all select 'clef_content', 2, page, null from cc where med < low - 2 or med > high + 2
  union all select 'vocal_leap', 1, page, measure from vl where leap > 12 union all select 'silence_run', 1, page, measure from si
  union all select distinct 'missing_context', 1, page, null::int from notes_v where page % 10 = 0)"""


def without_clefs(clefs: DataFrame) -> DataFrame:
    """Clefs with those of every tenth page unknown, so that missing ones can be found."""
    return clefs.withColumn("sign", F.when(F.col("page") % 10 != 0, F.col("sign")))


def every_flag(notes: DataFrame, measures: DataFrame, clefs: DataFrame) -> DataFrame:
    known = audit.CHECKS | audit.PAGE_CHECKS | {"missing_context": (1, lambda n, m, c: audit.missing_context(n, without_clefs(c)))}
    return audit.flags(notes, measures, clefs, known)


add("audit_missing_context", "notes_v clefs_v", lambda n, c: audit.missing_context(n, without_clefs(c)), "select distinct page from notes_v where page % 10 = 0")
add("audit_tally_every", "notes_v measures_v clefs_v", lambda n, m, c: audit.tally(every_flag(n, m, c)), f'with {EVERY} select "check", count(*) as n, count(distinct page) as pages from al group by "check"')
add("audit_suspects_every", "notes_v measures_v clefs_v", lambda n, m, c: audit.suspects(every_flag(n, m, c)), f'with {EVERY} select * from al order by severity desc, page, measure nulls first, "check" limit 25')
add("audit_page_reports", "notes_v measures_v clefs_v", lambda n, m, c: audit.page_reports(n, m, c, every_flag(n, m, c)), f"""with {EVERY}, s as (select page, count(distinct staff) as staves, count(distinct staff * 10 + voice) as streams, count(distinct measure) as measures, count(*) as notes,
  cast(sum(is_rest::int) as bigint) as rests, cast(sum(is_chord::int) as bigint) as chord_tones from notes_v group by page),
t1 as (select page, arg_min(beats || '/' || beat_type, measure) as time from measures_v group by page),
c1 as (select page, array_to_string(list(clef order by staff), ',') as clefs from (select page, staff, arg_min(sign || line, system) as clef from clefs_v group by page, staff) group by page),
f1 as (select page, count(*) filter (severity = 3) as flags_3, count(*) filter (severity = 2) as flags_2, count(*) filter (severity = 1) as flags_1 from al group by page)
select s.*, time, clefs, coalesce(flags_3, 0) as flags_3, coalesce(flags_2, 0) as flags_2, coalesce(flags_1, 0) as flags_1 from s left join t1 using (page) left join c1 using (page) left join f1 using (page)""")

# patterns: phrases, given references, bar lengths, systems from fragments
PHRASES = f"""{C.NEAREST},
ph as (select page, system, array_to_string(list_filter([case when staves <> ks then 'staff count ' || staves || ' (expected ' || ks || ')' end,
  case when meter is distinct from km then 'meter ' || coalesce(meter, 'none') || ' (expected ' || coalesce(km, 'none') || ')' end,
  case when clefs <> kc then 'clefs ' || replace(clefs, ',', ' ') || ' (expected ' || replace(kc, ',', ' ') || ')' end], lambda x: x is not null), '; ') as phrases,
  staves || ' staff(s), ' || coalesce(meter, 'no meter') || ', ' || replace(clefs, ',', ' ') as described from ne)"""
NEAR = f"{C.SIGS}, {C.KNOWN}, {PHRASES}"
add("pat_differences", "notes_v measures_v clefs_v", lambda n, m, c: review.differences(pattern.deviations(C.SIG(n, m, c)), pattern.known_patterns(C.SIG(n, m, c))), f"with {NEAR} select page, system, phrases, described from ph")
GIVEN = """rf as (select distinct page, staves, meter, clefs, 1 as named from sg where system in (2, 5) and page % 3 <> 0),
kg as (select * from (select *, max(systems) over w as most, max(named) over w as any_, min(first) over w as lead_ from pk left join rf using (page, staves, meter, clefs) window w as (partition by page))
  where case when most >= 4 then systems >= 4 when any_ is null then first = lead_ else named = 1 end)"""


def given(sigs: DataFrame) -> DataFrame:
    """The second and the fifth system of two pages in three, as references that a caller gives."""
    return sigs.where("system in (2, 5) and page % 3 <> 0").select("page", "system")


add("pat_reference", "notes_v measures_v clefs_v", lambda n, m, c: pattern.deviations(C.SIG(n, m, c), 4, reference=given(C.SIG(n, m, c))), f"with {C.SIGS}, {GIVEN} {C.DEVIANT.replace('kn', 'kg')}")
add("pat_bar_columns", "notes_v", review.bar_columns, f"""with {C.FILL}, p as (select distinct page, measure, system from notes_v), v as (select page, staff, fill, count(*) as votes, min(measure) as first, list(distinct system) as sy from fill join p using (page, measure) where fill > 0 group by all),
a as (select page, staff, list_distinct(flatten(list(sy))) as alle from v group by page, staff),
k as (select * from v qualify row_number() over (partition by page, staff order by votes desc, first) = 1)
select page, staff, fill as agreed, votes, array_to_string(list_sort(list_filter(alle, lambda x: not list_contains(sy, x))), ',') as outliers from k join a using (page, staff)""")


def named_fragments(fragments: DataFrame) -> DataFrame:
    return fragments.withColumn("file", F.concat(F.lit("sys"), F.col("system").cast("string"), F.lit(".s"), F.col("staff").cast("string"), F.lit("_in.musicxml"))).drop("system")


NATURAL = "list_transform(regexp_extract_all(file, '[0-9]+|[^0-9]+'), lambda t: case when t[1] between '0' and '9' then lpad(cast(length(regexp_replace(t, '^0+([0-9])', '\\1')) as varchar), 3, '0') || regexp_replace(t, '^0+([0-9])', '\\1') else t end)"
FILES = f"select event_id, page, file, cast(dense_rank() over (partition by page order by {NATURAL}, file) as int) as system from f"
NAMED = "with f as (select event_id, page, 'sys' || system || '.s' || staff || '_in.musicxml' as file from {})"
add("pat_fragment_systems", "fragments_v", lambda f: review.systems_from_fragments(named_fragments(f)).select("event_id", "page", "file", "system"), f"{NAMED.format('fragments_v')} {FILES}")
# pages of up to sixteen systems, with unknown meters and clefs
OPEN = "slim_notes_v slim_measures_v slim_clefs_v"
OPEN_SIGS = C.signature_sql(*OPEN.split())
add("pat_open_fragment_systems", "slim_notes_v", lambda f: review.systems_from_fragments(named_fragments(f)).select("event_id", "page", "file", "system"), f"{NAMED.format('slim_notes_v')} {FILES}")
add("pat_open_signatures", OPEN, C.SIG, f"with {OPEN_SIGS} select * from sg")
add("pat_open_keys", OPEN, lambda n, m, c: pattern.pattern_keys(C.SIG(n, m, c)), f"with {OPEN_SIGS} select * from pk")
add("pat_open_deviations", OPEN, lambda n, m, c: pattern.deviations(C.SIG(n, m, c)), f"with {OPEN_SIGS}, {C.KNOWN} {C.DEVIANT}")
add("pat_open_nearest", OPEN, lambda n, m, c: C.NEAR_TO(C.SIG(n, m, c)), f"with {OPEN_SIGS}, {C.KNOWN}, {C.NEAREST} select page, system, kc as k_clefs, differ from ne")
add("pat_open_differences", OPEN, lambda n, m, c: review.differences(pattern.deviations(C.SIG(n, m, c)), pattern.known_patterns(C.SIG(n, m, c))), f"with {OPEN_SIGS}, {C.KNOWN}, {PHRASES} select page, system, phrases, described from ph")

# the review
DETECTED = "dt as (select page, cast(sum(2) as bigint) as expected from layout_v group by page), fo as (select page, count(distinct system * 10 + staff) as n from runs_b group by page)"
CAVEAT = "case when page in (select page from cv) then ' (staves are missing on this page: coverage_miss)' else '' end"


def page_review(runs: DataFrame, notes: DataFrame, measures: DataFrame, clefs: DataFrame, layout: DataFrame) -> DataFrame:
    """Run A against run B; staves that run B read with a note of 36 ticks or more, against those that the layout has."""
    place = notes.select("event_id", "system")
    found = B(runs).where("dur >= 36").join(place, "event_id").groupBy("page").agg(F.countDistinct("system", "staff").alias("n"))
    expected = layout.groupBy("page").agg(F.sum("n_staves_detected").alias("n"))
    return review.review(A(runs), B(runs), C.SIG(notes.where("page % 9 <> 0"), measures, clefs.where("page % 9 <> 0")), review.coverage_flags(found, expected, "run B", "staves"), 4)


PAGED = C.signature_sql("(select * from notes_v where page % 9 <> 0)", clefs="(select * from clefs_v where page % 9 <> 0)")
RV = f"""{C.TALLY}, {C.PITCH}, {C.FIELDS}, {PAGED}, {C.KNOWN.replace(">= 2", ">= 4")},
ex as (select page, sum(n_staves_detected) as e from layout_v group by page),
fo as (select r.page, count(distinct system * 10 + r.staff) as n from runs_v r join notes_v using (event_id) where run = 'B' and r.dur >= 36 group by r.page),
cv as (select page, coalesce(n, 0) || ' of ' || e || ' staves found; ' || (e - coalesce(n, 0)) || ' were never cut out, so their notes are in no count' as detail from ex left join fo using (page) where coalesce(n, 0) < e),
{PHRASES},
rv as (select page, 'coverage_miss' as "check", 3 as severity, 'run B' as "where", detail from cv
  union all select page, case field when 'pitched' then 'pitch_disagreement' else 'count_disagreement' end, 3, 'two runs', field || ': left ' || coalesce("left", 0) || ' vs right ' || coalesce("right", 0) || ' (' || case when coalesce("right", 0) >= coalesce("left", 0) then '+' else '' end || (coalesce("right", 0) - coalesce("left", 0)) || ')' || {CAVEAT} from fi
  union all select page, 'pitch_disagreement', 3, 'two runs', 'pitch ' || midi || ' differs by ' || case when delta >= 0 then '+' else '' end || delta || ' between the two runs' || {CAVEAT} from pd
  union all select page, 'weak_pattern', 1, 'page', 'no pattern comes often enough to deviate from, among ' || count(*) || ' system(s)' from sg where page not in (select page from pk where systems >= 4) group by page
  union all select page, 'pattern_deviation', 2, 'system ' || system, phrases || ' (' || described || ')' from ph
  union all select distinct page, 'missing_fragment', 3, 'page', 'no system was read, so patterns were not checked' from runs_v where page not in (select page from sg))"""
add("review_pages", "runs_v notes_v measures_v clefs_v layout_v", page_review, f"with {RV} select * from rv")
add("review_tally", "runs_v notes_v measures_v clefs_v layout_v", lambda *t: page_review(*t).groupBy("check", "severity").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages")), f'with {RV} select "check", severity, count(*) as n, count(distinct page) as pages from rv group by all')


# counting twice
def comparable(runs: DataFrame) -> DataFrame:
    """Pages as fragments; those of run B can't be compared in rests on every fifth page."""
    named = F.array(*[F.lit(f) for f in reconcile.FIELDS])
    return runs.select("run", "page").distinct().withColumn("comparable", F.when((F.col("run") == "B") & (F.col("page") % 5 == 0), F.array_remove(named, "rests")).otherwise(named))


add("rec_comparable", "runs_v", lambda r: reconcile.comparable_fields(comparable(r), ["run"]), "select distinct run, case when run = 'B' then 'measures,notes,pitched' else 'measures,notes,pitched,rests' end as comparable from runs_v")
def in_named_files(runs: DataFrame) -> DataFrame:
    """Notes by file; run B lacks the files of the second voice on every fifth page, and run A those of page 7."""
    kept = runs.where("case when run = 'A' then page <> 7 else voice = 1 or page % 5 <> 0 end")
    return kept.withColumn("file", F.concat(F.lit("s"), F.col("staff").cast("string"), F.lit(".v"), F.col("voice").cast("string")))


add("rec_files", "runs_v", lambda r: reconcile.reconcile_files(A(in_named_files(r)), B(in_named_files(r)), ["page", "file"]), """with n as (select *, 's' || staff || '.v' || voice as file from runs_v where case when run = 'A' then page <> 7 else voice = 1 or page % 5 <> 0 end),
t as (select run, page, file, count(distinct measure) as measures, count(*) as notes, cast(sum(is_rest::int) as bigint) as rests, cast(sum((not is_rest)::int) as bigint) as pitched from n group by run, page, file),
f as (select page, file, max((run = 'A')::int) as a, max((run = 'B')::int) as b from t group by page, file), u as (select * from (unpivot t on measures, notes, rests, pitched into name field value v) p),
x as (select page, file, field, max(v) filter (run = 'A') as l, max(v) filter (run = 'B') as r from u group by all), y as (select page, file, midi, count(*) filter (run = 'A') as l, count(*) filter (run = 'B') as r from n where not is_rest group by all)
select page, file, 'file present' as field, cast(a as bigint) as "left", cast(b as bigint) as "right" from f where a + b = 1
union all select page, file, field, l, r from x join f using (page, file) where a + b = 2 and l <> r union all select page, file, 'pitch ' || midi, l, r from y join f using (page, file) where a + b = 2 and l <> r""")
add("rec_totals", "runs_v", lambda r: reconcile.reconcile_totals(A(r), B(r), ["staff", "voice"], ["measure"], ["page"]), """with t as (select run, page, count(*) as notes, cast(sum(is_rest::int) as bigint) as rests, cast(sum((not is_rest)::int) as bigint) as pitched from runs_v group by run, page),
u as (select * from (unpivot t on notes, rests, pitched into name field value v) p), x as (select page, field, max(v) filter (run = 'A') as l, max(v) filter (run = 'B') as r from u group by all)
select page, field, l as "left", r as "right" from x where l is distinct from r""")
add("rec_agree", "runs_v", lambda r: reconcile.agree(reconcile.reconcile(reconcile.tally(A(r), ["page"]), reconcile.tally(B(r), ["page"]), ["page"]), r, "measures"), f"with {C.TALLY}, {C.FIELDS} select distinct page, (page not in (select page from fi where field = 'measures'))::int as agrees from runs_v")
add("rec_groupings", "layout_v", reconcile.groupings, "with g as (select page, cast(sum(n_staves_read) as bigint) as staves, array_to_string(list(n_staves_read order by system), '+') as grouping from layout_v group by page), c as (select grouping, count(*) as pages, cast(sum(staves) as bigint) as staves from g group by grouping) select *, ((select count(*) from c) <= 1)::int as alike from c")

# scores
ORDER = ["measure", "onset", "staff", "voice", "event_id"]
add("score_melody_diff", "runs_v", lambda r: scoring.melody_diff(A(r), B(r), ["page"], ORDER), f"""with {aligned("page", ", ".join(ORDER), "(select * from runs_v where not is_rest)")},
c as (select page, count(*) filter (op = 'm') as m, count(*) filter (op = 'd') as d, count(*) filter (op = 'i') as i from tb group by page)
select page, m + d as truth_notes, m + i as pred_notes, m as exact, least(d, i) as wrong_pitch, d - least(d, i) as missed, i - least(d, i) as spurious, case when m + i = 0 then 0 else 1000 * m // (m + i) end as "precision",
  case when m + d = 0 then 0 else 1000 * m // (m + d) end as recall, case when 2 * m + d + i = 0 then 0 else 2000 * m // (2 * m + d + i) end as f1 from c""")
CASES = f"""k as (select *, row_number() over (partition by {C.SK} order by measure, onset, event_id) as nth from notes_v),
b as (select page, sum((not is_rest)::int) as s, sum(dur) as i from notes_v group by page),
x as (select page, 'good' as kind, true as good, s as cs, i as ci from b union all select page, 'shift', false, s, i from b union all select page, 'double', false, 2 * s, 2 * i from b union all select page, 'flood', false, 6 * s, 6 * i from b
  union all select page, 'rests', false, 0, i from b union all select page, 'drop', false, sum((not is_rest)::int), sum(dur) from k where nth % 5 <> 0 group by page),
ca as (select page, kind, good, (abs(cs - s) > 0.1 * s or abs(ci - i) > 0.1 * i) as flagged from x join b using (page))"""


def cases(notes: DataFrame) -> DataFrame:
    return scoring.flagged_cases(scoring.corrupted_cases(notes), notes)


add("score_cases", "notes_v", lambda n: cases(n).select("page", "kind", F.col("good").cast("int").alias("good"), F.col("flagged").cast("int").alias("flagged")), f"with {CASES} select page, kind, good::int as good, flagged::int as flagged from ca")
add("score_confusion", "notes_v", lambda n: scoring.confusion(cases(n)), f"""with {CASES}, c as (select count(*) filter (not good and flagged) as tp, count(*) filter (not good and not flagged) as fn, count(*) filter (good and flagged) as fp, count(*) filter (good and not flagged) as tn from ca)
select *, 1000 * tp // greatest(tp + fn, 1) as recall, 1000 * tp // greatest(tp + fp, 1) as "precision" from c""")
add("score_catch_rates", "notes_v", lambda n: scoring.catch_rates(cases(n)), f"with {CASES} select kind, count(*) filter (flagged) as caught, count(*) as cases from ca where not good group by kind")


# assembly
def in_parts(notes: DataFrame) -> DataFrame:
    return notes.withColumns({"part": F.col("voice") - 1, "book": F.floor(F.col("page") / 16).cast("int")})


add("asm_split_staves", "notes_v clefs_v", lambda n, c: assemble.split_staves(in_parts(n), c.where("system <> 2 or staff <> 2")), """select event_id, n.page, n.system, (voice - 1) || '.s' || n.staff as id, cast(dense_rank() over (partition by n.page, n.system order by voice, n.staff) as int) as row, 1 as staff, coalesce(sign || line, 'G2') as clef
from notes_v n left join (select * from clefs_v where system <> 2 or staff <> 2) c on n.page = c.page and n.system = c.system and n.staff = c.staff""")
add("asm_fragments", "fragments_v", lambda f: assemble.assemble_fragments(f, ["system", "staff"]), "select event_id, page, 'P' || d as part, 'Staff ' || d as name, measure from (select event_id, page, dense_rank() over (partition by page order by system, staff) as d, cast(dense_rank() over (partition by page, system, staff order by measure) as int) as measure from fragments_v)")
add("asm_page_context", "measures_v", lambda m: assemble.page_context(m.withColumn("fifths", (F.col("page") + F.col("system")) % 3 - 1)), """with a0 as (select page, beats || '/' || beat_type as meter, count(*) as meter_votes, min(measure) as first from measures_v group by all), a as (select * from a0 qualify row_number() over (partition by page order by meter_votes desc, first) = 1),
b0 as (select page, (page + system) % 3 - 1 as fifths, count(*) as fifths_votes, min(measure) as first from measures_v group by all), b as (select * from b0 qualify row_number() over (partition by page order by fifths_votes desc, first) = 1)
select page, meter, meter_votes, fifths, fifths_votes from a join b using (page)""")
add("asm_grid_scan", "slim_notes_v", lambda n: assemble.grid_scan(in_parts(n)), """with st as (select page // 16 as book, page, system, voice - 1 as part, staff, max((not is_rest)::int) as sounds from slim_notes_v group by all),
pt as (select book, page, system, part, count(*) as n, sum(sounds) as sounds from st group by all), sy as (select book, page, system, sum(n) as n, max(n) as braced, sum(sounds) as sounds from pt group by all),
np as (select book, page, count(distinct part) as parts from st group by all),
pg as (select book, page, max(n) as tall, min(n) as low, max(braced) as braced, max(sounds) as content, max(n) + (any_value(parts) > 1 and max(n) = max(braced))::int as rows from sy join np using (book, page) group by book, page)
select case when grouping(book) = 1 then 'all' when grouping(page) = 1 then 'book' else 'page' end as level, cast(book as int) as book, page, count(*) as pages, cast(sum((tall <> low)::int) as bigint) as varies, cast(max(rows) as bigint) as rows,
  cast(min(low) as bigint) as lowest, cast(max(braced) as bigint) as accompaniment, cast(max(rows - braced) as bigint) as solo, cast(max(content) as bigint) as content from pg group by rollup (book, page)""")
add("asm_join_parts", "notes_v", lambda n: assemble.join_parts(in_parts(n)), """with p as (select *, voice - 1 as part, page // 16 as book from notes_v),
w as (select book, page, count(distinct measure) as width from p where part = 0 group by book, page), b as (select *, sum(width) over (partition by book order by page) - width as before, row_number() over (partition by book order by page) as nth from w),
m as (select book, max(part) as most from p group by book), o as (select *, dense_rank() over (partition by page, part order by measure) as at_ from p)
select event_id, o.book, o.page, cast(before + at_ as bigint) as measure, case when part > 0 then part + 2 else staff end as staff, case when part > 0 then voice + 10 else voice end as voice, case when most > 0 then most + 2 end as staves, (at_ = 1 and nth > 1)::int as new_page
from o join b using (book, page) join m using (book) where at_ <= width""")
