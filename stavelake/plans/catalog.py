"""Queries of the score operators over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as N
from ..operators import assemble, audit, meter, normalise, pattern, reconcile, scoring
from ..streaming import running_tally_batch, sample_trace
from . import changes, emit, layouts, parts  # noqa: F401  (they register theirs)
from .registry import ORACLES, QUERIES, add  # noqa: F401

SK = "page, staff, voice"

BAR = "cast(floor(beats * 96 / beat_type) as bigint)"
TOTALS = f"""t as (select {SK}, measure, cast(sum(case when is_chord then 0 else dur end) as bigint) as total,
  cast(sum(case when is_rest then 0 else 1 end) as bigint) as pitched from notes_v group by {SK}, measure)"""
DECLARED = f"d as (select page, measure, {BAR} as declared from measures_v)"
MODAL = """mo as (select page, total as modal, n from (select *, row_number() over (partition by page order by n desc, first) as k from (
  select page, total, count(*) as n, min({'staff': staff, 'voice': voice, 'measure': measure}) as first from t where total > 0 group by page, total)) where k = 1)"""
DIATONIC = "cast(octave * 7 + instr('CDEFGAB', step) - 1 as int)"
BROKEN = f"br as (select {SK}, t.measure, total, declared, case when total > declared then 3 else 2 end as severity from t join d using (page, measure) where total > 0 and total <> declared)"
COLLISION = f"""vc as (select {SK}, measure, onset, event_id, previous, midi as current from (select *, lag(midi) over (partition by {SK}, measure, onset order by event_id) as previous
  from notes_v where not is_rest and not is_chord) where previous is not null)"""
EMPTY = "em as (select page, measure from measures_v m where not exists (select 1 from notes_v n where n.page = m.page and n.measure = m.measure))"
NEXT = f"nx as (select *, lag(midi) over w as before, lag(dur) over w as before_dur from notes_v where not is_rest and not is_chord window w as (partition by {SK} order by measure, onset, event_id))"
FLAGS = f"""{TOTALS}, {DECLARED}, {BROKEN}, {COLLISION}, {EMPTY}, {NEXT}, fl as (
  select 'voice_collision' as "check", 3 as severity, page, measure from vc union all select 'empty_measure', 3, page, measure from em
  union all select 'broken_measure', severity, page, measure from br
  union all select 'out_of_range', 1, page, measure from notes_v where not is_rest and not midi between 21 and 108
  union all select 'dotted_eighth', 1, page, measure from nx where dur = 18 and before_dur = 18
  union all select 'duplicate_adjacent', 1, page, measure from nx where midi = before and dur = before_dur)"""
PLACED = f"""pl as (select n.*, {DIATONIC} as position, case sign when 'F' then 18 else 30 end as low, case sign when 'F' then 26 else 38 end as high
  from notes_v n join clefs_v using (page, system, staff) where not is_rest)"""

# functions
add("fn_pitch", "notes_v", lambda n: n.select("event_id", N.diatonic("step", "octave").alias("diatonic"), N.midi("step", "alter_", "octave").alias("midi"), N.midi_name("midi").alias("name"), N.pitch_name("step", "alter_", "octave").alias("pitch"), N.midi_from_text(N.midi_name("midi")).alias("back"), N.midi_from_name(F.lower(N.midi_name("midi"))).alias("spoken"), N.transpose("midi", 3).alias("t")).select("*", F.concat("t.step", F.col("t.alter").cast("string"), F.lit("/"), F.col("t.octave").cast("string")).alias("up3")).drop("t"),
    f"""with nm as (select *, substr('C C#D D#E F F#G G#A A#B ', midi % 12 * 2 + 1, 2) as raw, substr('C0C1D0D1E0F0F1G0G1A0A1B0', (midi + 3) % 12 * 2 + 1, 2) as up from notes_v)
select event_id, {DIATONIC} as diatonic, midi, trim(raw) || octave as name, step || case when alter_ = 1 then '#' else '' end || octave as pitch,
  case when octave >= 0 then midi end as back, midi as spoken, up || '/' || cast(floor((midi + 3) / 12) as int) - 1 as up3 from nm""".replace("|| cast(floor((midi + 3) / 12) as int) - 1", "|| (cast(floor((midi + 3) / 12) as int) - 1)"))  # fmt: skip
add("fn_duration", "notes_v", lambda n: n.select("event_id", N.to_q("dur", F.lit(24)).alias("q"), N.to_ticks("dur", F.lit(10), F.lit("half")).alias("ticks"), N.written_value("dur").alias("w"), N.plain_floor(F.col("dur") + 1).alias("fits"), N.written_q(F.col("dur").cast("long") * 420, F.lit(3), F.lit(2)).alias("written")).select("event_id", "q", "ticks", F.col("w.type").alias("value"), F.col("w.dots").alias("dots"), "fits", "written"),
    """with v as (select * from (values (6, '16th', 0), (12, 'eighth', 0), (18, 'eighth', 1), (24, 'quarter', 0), (36, 'quarter', 1), (48, 'half', 0), (72, 'half', 1), (96, 'whole', 0)) v(dur, value, dots))
select event_id, cast(dur as bigint) * 420 as q, cast(round_even(dur * 24 / 10, 0) as int) as ticks, value, dots, dur as fits, cast(dur as bigint) * 630 as written from notes_v join v using (dur)""")  # fmt: skip
add("fn_labels", "measures_v", lambda m: m.select("page", "measure", N.page_stem("page").alias("stem"), N.slug(F.concat(F.lit("Song No. "), F.col("page").cast("string"), F.lit(" / "), F.col("measure").cast("string"))).alias("slug"), N.bar_length("beats", "beat_type").alias("bar"), N.staff_role(F.lit(4), F.pmod("measure", F.lit(4))).alias("role"), N.part_label(F.col("measure") % 2 == 0, "measure").alias("part")),
    """select page, measure, 'p' || lpad(cast(page as varchar), 4, '0') as stem, 'song-no-' || page || '-' || measure as slug, beats * 24 as bar,
  case measure % 4 when 0 then 'voice' when 1 then 'piano-treble' when 2 then 'piano-upper' else 'piano-bass' end as role,
  case when measure % 2 = 0 then 'Piano' when measure = 1 then 'Voice' else 'Voice ' || measure end as part from measures_v""")  # fmt: skip

# audit
add("audit_measure_totals", "notes_v", audit.measure_totals, f"with {TOTALS} select * from t")
add("audit_voice_collision", "notes_v", audit.voice_collision, f"with {COLLISION} select * from vc")
add("audit_empty_measure", "notes_v measures_v", audit.empty_measure, f"with {EMPTY} select * from em")
add("audit_modal_total", "notes_v", lambda n: audit.modal_total(audit.measure_totals(n)), f"with {TOTALS}, {MODAL} select * from mo")
add("audit_wrong_meter", "notes_v measures_v", audit.wrong_meter, f"with {TOTALS}, {MODAL}, f as (select page, arg_min({BAR}, measure) as declared from measures_v group by page) select page, modal, declared from mo join f using (page) where modal <> declared")
add("audit_broken_measures", "notes_v measures_v", audit.broken_measure, f"with {TOTALS}, {DECLARED}, {BROKEN} select * from br")
add("audit_broken_against_modal", "notes_v", audit.broken_against_modal, f"with {TOTALS}, {MODAL} select {SK}, measure, total, modal, case when total > modal then 3 else 2 end as severity from t join mo using (page) where total > 0 and total <> modal")
add("audit_missing_meter", "measures_v", lambda m: audit.missing_meter(m.withColumn("beats", F.when(F.col("page") % 10 != 0, F.col("beats")))), "select page from measures_v group by page having count(case when page % 10 <> 0 then beats end) = 0")
add("audit_outlier_pitch", "notes_v clefs_v", audit.outlier_pitch, f"""with {PLACED}, o as (select *, position < low - 4 or position > high + 4 as out_ from pl)
select {SK}, cast(sum(out_::int) as bigint) as outside, count(*) as n, array_to_string(list_sort(list(distinct case when out_ then position end) filter (out_))[1:4], ',') as sample
from o group by {SK} having sum(out_::int) > 2 and sum(out_::int) * 20 > count(*)""")
add("audit_clef_content", "notes_v clefs_v", audit.clef_content, f"with {PLACED}, m as (select {SK}, system, low, high, list_sort(list(position)) as l from pl group by all) select {SK}, system, l[len(l) // 2 + 1] as median from m where l[len(l) // 2 + 1] < low - 2 or l[len(l) // 2 + 1] > high + 2")
add("audit_dotted_eighth", "notes_v", audit.dotted_eighth, f"with {NEXT} select {SK}, measure, event_id from nx where dur = 18 and before_dur = 18")
add("audit_duplicate_adjacent", "notes_v", audit.duplicate_adjacent, f"with {NEXT} select {SK}, measure, event_id, midi from nx where midi = before and dur = before_dur")
add("audit_duplicate_census", "notes_v", audit.duplicate_census, f"""with x as (select {SK}, midi = lag(midi) over w as same, measure = lag(measure) over w and onset = lag(onset) over w as tog from notes_v where not is_rest
window w as (partition by {SK} order by measure, onset, event_id)) select {SK}, cast(coalesce(sum(same::int), 0) as bigint) as adjacent, cast(coalesce(sum(tog::int), 0) as bigint) as same_onset from x group by {SK}""")
MELODY = "me as (select page, staff, l[len(l) // 2 + 1] as median from (select page, staff, list_sort(list(midi)) as l from notes_v where not is_rest group by page, staff) qualify row_number() over (partition by page order by l[len(l) // 2 + 1] desc, staff) = 1)"
add("audit_melody_staff", "notes_v", audit.melody_staff, f"with {MELODY} select * from me")
add("audit_vocal_leap", "notes_v", audit.vocal_leap, f"with {MELODY}, x as (select n.*, abs(midi - lag(midi) over (partition by n.page, n.staff order by measure, onset, event_id)) as leap from notes_v n join me using (page, staff) where not is_rest) select page, staff, measure, event_id, leap from x where leap > 12")
add("audit_out_of_range", "notes_v", audit.out_of_range, f"select {SK}, measure, event_id, midi from notes_v where not is_rest and not midi between 21 and 108")
add("audit_silence_run", "notes_v measures_v", lambda n, m: audit.silence_run(n, m, 2), """with x as (select m.page, m.measure, has, sum(coalesce(has, 0)) over (partition by m.page order by m.measure) as island from measures_v m
left join (select distinct page, measure, 1 as has from notes_v) h on m.page = h.page and m.measure = h.measure)
select page, measure, run from (select page, measure, cast(row_number() over (partition by page, island order by measure) as int) as run from x where has is null) where run >= 2""")
add("audit_bar_span", "notes_v measures_v", audit.bar_span, f"with {DECLARED}, r as (select page, measure, max(onset + dur) as reach from notes_v group by page, measure) select page, count(*) as n, cast(sum((reach <= declared)::int) as bigint) as clean from r join d using (page, measure) group by rollup(page)")
add("audit_ratio_census", "notes_v measures_v", audit.ratio_census, f"with {TOTALS}, {DECLARED}, {BROKEN}, x as (select total // gcd(total, declared) as num, declared // gcd(total, declared) as den, count(*) as n from br group by 1, 2) select num, den, n, (num <= 4 and den <= 8)::int as spellable from x order by n desc, num, den limit 15")
add("audit_page_summary", "notes_v", audit.page_summary, "select page, count(distinct staff) as staves, count(distinct staff * 10 + voice) as streams, count(distinct measure) as measures, count(*) as notes, cast(sum(is_rest::int) as bigint) as rests, cast(sum(is_chord::int) as bigint) as chord_tones from notes_v group by page")
add("audit_tally", "notes_v measures_v", lambda n, m: audit.tally(audit.flags(n, m)), f'with {FLAGS} select "check", count(*) as n, count(distinct page) as pages from fl group by "check"')
add("audit_suspects", "notes_v measures_v", lambda n, m: audit.suspects(audit.flags(n, m)), f'with {FLAGS} select * from fl order by severity desc, page, measure, "check" limit 25')

# event normalisation
RAW = lambda n: n.select("event_id", "page", "staff", "measure", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "backup").otherwise("note").alias("tag"), "dur", "is_chord")
CURSOR = """r as (select event_id, page, staff, measure, event_id as seq, case when event_id % 5 = 0 then 'backup' else 'note' end as tag, dur, is_chord from notes_v),
c as (select *, coalesce(sum(case when tag = 'backup' then -dur when is_chord then 0 else dur end) over (partition by page, staff, measure order by seq rows between unbounded preceding and 1 preceding), 0) as cur from r),
o as (select *, coalesce(last_value(case when tag = 'note' and not is_chord then cur end ignore nulls) over (partition by page, staff, measure order by seq rows between unbounded preceding and current row), cur) as local from c)"""
add("norm_onsets_exact", "notes_v", lambda n: normalise.onsets_exact(RAW(n), ["page", "staff"]).select("event_id", "local"), f"with {CURSOR} select event_id, cast(local as bigint) as local from o where tag = 'note'")
add("norm_onsets_ticks", "notes_v", lambda n: normalise.onsets_ticks(RAW(n), ["page", "staff"]).select("event_id", "local"), f"with {CURSOR} select event_id, cast(greatest(local, 0) as bigint) as local from o where tag = 'note'")
add("norm_fill_attributes", "measures_v", lambda m: normalise.fill_attributes(m.withColumn("beats", F.when(F.col("measure") % 3 == 1, F.col("beats"))), ["beats"], ["page"], ["measure"]).select("page", "measure", "beats"), "select page, measure, last_value(case when measure % 3 = 1 then beats end ignore nulls) over (partition by page order by measure) as beats from measures_v")
add("norm_absolute_onsets", "notes_v", normalise.absolute_onsets, "with s as (select page, measure, max(onset + dur) as span from notes_v group by page, measure), b as (select page, measure, sum(span) over (partition by page order by measure) - span as start from s) select event_id, page, measure, cast(start + onset as bigint) as absolute from notes_v join b using (page, measure)")
add("norm_doc_context", "measures_v clefs_v", normalise.doc_context, "with m as (select page, arg_min(beats, measure) as beats, arg_min(beat_type, measure) as beat_type from measures_v group by page) select page, staff, arg_min(sign, system) as sign, arg_min(line, system) as line, any_value(beats) as beats, any_value(beat_type) as beat_type from clefs_v join m using (page) group by page, staff")
add("norm_streams", "notes_v", normalise.normalised_streams, f"select event_id, {SK}, measure, onset, cast(row_number() over (partition by {SK}, measure, onset order by is_rest, step, alter_, octave, event_id) as int) as place from notes_v")
add("norm_chordify", "notes_v", normalise.chordify, f"select page, staff, measure, onset, array_to_string(list(midi order by {DIATONIC}, midi), ',') as chord from notes_v where not is_rest group by page, staff, measure, onset")
add("norm_voice_events", "notes_v", normalise.voice_events, f"select {SK}, measure, onset, bool_and(is_rest)::int as is_rest, count(*) as n, arg_min(dur, cast(midi as bigint) * 100000000000 + event_id) as dur, min(midi) as lowest from notes_v group by {SK}, measure, onset")
add("norm_doc_counts", "notes_v", normalise.doc_counts, "select page, count(distinct voice) as voices, count(distinct staff) as staves, count(distinct system) as systems, array_to_string(list_sort(list(distinct system)), ',') as system_list from notes_v group by page")
add("norm_rank_voices", "notes_v", normalise.rank_voices, f"with f as (select {SK}, min({{'m': measure, 'o': onset, 'e': event_id}}) as first from notes_v group by {SK}) select {SK}, cast(dense_rank() over (partition by page, staff order by first) as int) as rank from f")
add("norm_voice_map", "notes_v", normalise.voice_map, f"select {SK}, cast(dense_rank() over (partition by page order by staff, voice) as int) as number from (select distinct {SK} from notes_v)")
add("norm_excerpt", "notes_v", lambda n: normalise.excerpt(n, 4, 9).select("event_id", "page", "measure"), "select event_id, page, cast(dense_rank() over (partition by page order by measure) as int) as measure from notes_v where measure between 4 and 9")
add("norm_drop_silent", "notes_v measures_v", normalise.drop_silent_measures, "select page, measure, cast(row_number() over (partition by page order by measure) as int) as number from (select distinct page, measure from notes_v)")

# counting twice
A, B = (lambda r: r.where("run = 'A'")), (lambda r: r.where("run = 'B'"))
TALLY = "ta as (select run, page, count(distinct measure) as measures, count(*) as notes, cast(sum(is_rest::int) as bigint) as rests, cast(sum((not is_rest)::int) as bigint) as pitched from runs_v group by run, page)"
PITCH = "pd as (select page, midi, cast(sum(case when run = 'B' then 1 else -1 end) as bigint) as delta from runs_v where not is_rest group by page, midi having sum(case when run = 'B' then 1 else -1 end) <> 0)"
FIELDS = "fi as (" + " union all ".join(f"select coalesce(a.page, b.page) as page, '{f}' as field, a.{f} as \"left\", b.{f} as \"right\" from (select * from ta where run = 'A') a full join (select * from ta where run = 'B') b on a.page = b.page where a.{f} is distinct from b.{f}" for f in reconcile.FIELDS) + ")"
add("rec_tally", "runs_v", lambda r: reconcile.tally(r, ["run", "page"]), f"with {TALLY} select * from ta")
add("rec_combine", "runs_v", lambda r: reconcile.combine(reconcile.tally(r, ["run", "page"]), ["run"]), f"with {TALLY} select run, cast(sum(measures) as bigint) as measures, cast(sum(notes) as bigint) as notes, cast(sum(rests) as bigint) as rests, cast(sum(pitched) as bigint) as pitched from ta group by run")
add("rec_pitch_diff", "runs_v", lambda r: reconcile.pitch_diff(A(r), B(r), ["page"]), f"with {PITCH} select * from pd")
add("rec_fields", "runs_v", lambda r: reconcile.reconcile(reconcile.tally(A(r), ["page"]), reconcile.tally(B(r), ["page"]), ["page"]), f"with {TALLY}, {FIELDS} select * from fi")
add("rec_verdicts", "runs_v", lambda r: reconcile.verdicts(A(r), B(r), ["page"]), f"""with {TALLY}, {PITCH}, {FIELDS}, p as (select page, (count(distinct run) = 2) as m from ta group by page)
select page, m::int as measured, (m and page not in (select page from fi))::int as twin_counts, (m and page not in (select page from fi) and page not in (select page from pd))::int as twin_pitches from p""")
add("rec_common_docs", "runs_v", lambda r: reconcile.common_docs(A(r), B(r)), "select page from runs_v group by page having count(distinct run) = 2")
add("rec_coverage", "layout_v", reconcile.coverage, "select page, system, n_staves_read, n_staves_detected, 3 as severity from layout_v where n_staves_read < n_staves_detected")
add("rec_layout_recovery", "layout_v", reconcile.layout_recovery, "select page, cast(sum(n_staves_detected) as bigint) as detected, cast(sum(n_staves_read) as bigint) as read, cast(sum(n_staves_detected) - sum(n_staves_read) as bigint) as lost, cast(floor(100 * sum(n_staves_read) / sum(n_staves_detected)) as bigint) as percent from layout_v group by page")
DIFF = """c as (select page, measure, staff, voice, onset, dur, is_rest, midi, sum(case when run = 'A' then 1 else -1 end) as k from runs_v group by all),
df as (select page, measure, cast(sum(greatest(k, 0)) as bigint) as lost, cast(sum(greatest(-k, 0)) as bigint) as gained from c where k <> 0 group by page, measure)"""
add("rec_content_diff", "runs_v", lambda r: reconcile.content_diff(A(r), B(r)), f"with {DIFF} select * from df")
add("rec_repair_summary", "runs_v", lambda r: reconcile.repair_summary(reconcile.content_diff(A(r), B(r))), f"with {DIFF} select count(distinct page) as pages, cast(sum(lost) as bigint) as lost, cast(sum(gained) as bigint) as gained from df")

# meters and bars
EXTENT = "ex as (select page, measure, cast(max(onset + dur) as bigint) as extent from notes_v group by page, measure)"
PAGE_METER = "pm as (select page, beats, beat_type, n from (select page, beats, beat_type, count(*) as n, min(measure) as first from measures_v group by page, beats, beat_type) qualify row_number() over (partition by page order by n desc, (beats = 4 and beat_type = 4) desc, first) = 1)"
add("meter_extent", "notes_v", meter.measure_extent, f"with {EXTENT} select * from ex")
add("meter_page", "measures_v", meter.page_meter, f"with {PAGE_METER} select * from pm")
add("meter_reconcile", "notes_v measures_v", meter.reconcile_meter, f"with {EXTENT}, {PAGE_METER} select page, measure, m.beats, m.beat_type, pm.beats as new_beats, pm.beat_type as new_type from measures_v m join pm using (page) join ex using (page, measure) where extent > m.beats * 96 // m.beat_type and extent <= pm.beats * 96 // pm.beat_type")
add("meter_extend_bars", "notes_v measures_v", meter.extend_bars, f"with {EXTENT} select page, measure, beats, (extent * beat_type + 95) // 96 as needed, (extent <= 2 * {BAR})::int as extended from measures_v join ex using (page, measure) where extent > {BAR}")
add("meter_clamp_bars", "notes_v measures_v", lambda n, m: meter.clamp_bars(n, m).select("event_id", "dur"), f"with {DECLARED} select event_id, cast(least(dur, declared - onset) as bigint) as dur from notes_v join d using (page, measure) where onset < declared")
add("meter_clamp_losses", "notes_v measures_v", meter.clamp_losses, f"with {DECLARED} select page, cast(sum((onset >= declared)::int) as bigint) as dropped, cast(sum((onset < declared and onset + dur > declared)::int) as bigint) as truncated from notes_v join d using (page, measure) group by page")
add("meter_note_beats_rest", "notes_v", lambda n: meter.note_beats_rest(n).select("event_id"), f"select event_id from notes_v n where not is_rest or not exists (select 1 from notes_v o where not o.is_rest and (o.page, o.staff, o.voice, o.measure, o.onset) = (n.page, n.staff, n.voice, n.measure, n.onset))")
add("meter_pair_slurs", "notes_v", lambda n: meter.pair_slurs(n.where("event_id % 3 = 0").withColumn("kind", F.when(F.col("midi") % 2 == 0, "start").otherwise("stop")), audit.SK, ["measure", "onset", "event_id"]).select("event_id", "kind"), f"""with s as (select *, case when midi % 2 = 0 then 'start' else 'stop' end as kind from notes_v where event_id % 3 = 0),
f as (select *, row_number() over (partition by {SK} order by measure, onset, event_id) as k0, kind is distinct from lag(kind) over (partition by {SK} order by measure, onset, event_id) as turn from s),
e as (select *, row_number() over (partition by {SK} order by measure, onset, event_id) as k, lead(kind) over (partition by {SK} order by measure, onset, event_id) as after from f where turn)
select event_id, kind from e where not (kind = 'stop' and k = 1) and not (kind = 'start' and after is null)""")
add("meter_infer_clef", "notes_v", lambda n: meter.infer_clef(n, split=62), "with m as (select page, staff, list_sort(list(midi)) as l from notes_v where not is_rest group by page, staff) select page, staff, case when len(l) >= 4 and l[len(l) // 2 + 1] < 62 then 'F' else 'G' end as sign, case when len(l) >= 4 and l[len(l) // 2 + 1] < 62 then 4 else 2 end as line from m")
add("meter_pad_parts", "notes_v", meter.pad_parts, "with l as (select page, staff, max(measure) as last from notes_v group by page, staff), w as (select page, max(last) as width from l group by page) select page, staff, cast(unnest(generate_series(last + 1, width)) as int) as measure from l join w using (page) where last < width")
add("meter_clef_changes", "clefs_v", meter.clef_changes, "select page, staff, system, sign, line from clefs_v qualify sign is distinct from lag(sign) over (partition by page, staff order by system) or line is distinct from lag(line) over (partition by page, staff order by system)")
add("meter_bar_rests", "notes_v measures_v clefs_v", meter.bar_rests, f"select m.page, m.measure, c.staff, {BAR} as dur from measures_v m join clefs_v c using (page, system) where not exists (select 1 from notes_v n where not is_rest and n.page = m.page and n.measure = m.measure and n.staff = c.staff)")
add("meter_fill_gaps", "notes_v measures_v", meter.fill_gaps, f"""with {DECLARED}, r as (select *, coalesce(max(onset + dur) over (partition by {SK}, measure order by onset, event_id rows between unbounded preceding and 1 preceding), 0) as reach from notes_v),
e as (select {SK}, measure, max(onset + dur) as reach from notes_v group by {SK}, measure)
select {SK}, measure, cast(reach as bigint) as onset, cast(onset - reach as bigint) as dur from r where onset > reach
union all select {SK}, measure, cast(reach as bigint), cast(declared - reach as bigint) from e join d using (page, measure) where reach < declared""")
add("meter_ratio_runs", "notes_v", meter.ratio_runs, f"""with x as (select *, coalesce((lag(dur) over w <> dur or lag(onset + dur) over w <> onset)::int, 1) as new from notes_v window w as (partition by {SK}, measure order by onset, event_id)),
y as (select *, cast(sum(new) over (partition by {SK}, measure order by onset, event_id) as bigint) as run from x)
select {SK}, measure, run, min(onset) as start, count(*) as n, min(dur) as ratio from y group by {SK}, measure, run""")

# assembly
FILL = "fill as (select page, staff, measure, cast(max(f) as bigint) as fill from (select page, staff, measure, voice, sum(dur) as f from (select page, staff, measure, voice, onset, max(dur) as dur from notes_v where not is_rest group by all) group by all) group by page, staff, measure)"
add("asm_system_offsets", "notes_v", assemble.system_offsets, "with w as (select page, system, max(n) as width from (select page, system, staff, count(distinct measure) as n from notes_v group by all) group by page, system) select page, system, width, cast(sum(width) over (partition by page order by system) - width as bigint) as \"offset\" from w")
add("asm_bar_fill", "notes_v", assemble.bar_fill, f"with {FILL} select * from fill")
add("asm_beat_table", "notes_v", assemble.beat_table, f"with {FILL}, s as (select distinct page, measure, system from notes_v), b as (select page, system, staff, cast(dense_rank() over (partition by page, system order by staff desc) - 1 as int) as from_bottom from (select distinct page, system, staff from notes_v)) select page, from_bottom, cast(sum(fill) as bigint) as fill, count(*) as bars from fill join s using (page, measure) join b using (page, system, staff) group by page, from_bottom")
add("asm_short_bars", "notes_v measures_v", assemble.short_bars, f"with {FILL} select page, staff, measure, fill, {BAR} as bar from fill join measures_v using (page, measure) where fill > 0 and fill <> {BAR}")
add("asm_grid_shape", "notes_v", assemble.grid_shape, "with s as (select page, system, count(distinct staff) as n from notes_v group by page, system) select page, max(n) as tallest, min(n) as lowest, (max(n) = min(n))::int as uniform from s group by page")
add("asm_clef_votes", "clefs_v", assemble.clef_votes, "with v as (select page, staff, sign, line, count(*) as n, min(system) as first from clefs_v group by all) select page, staff, sign, line, n, cast(sum(n) over (partition by page, staff) - n as bigint) as against from v qualify row_number() over (partition by page, staff order by n desc, first) = 1")
add("asm_clef_conflicts", "clefs_v", assemble.clef_conflicts, "select page, staff, count(distinct sign || line) as clefs, array_to_string(list_sort(list(distinct sign || line)), ',') as names from clefs_v group by page, staff having count(distinct sign || line) > 1")
add("asm_role_sets", "notes_v", assemble.role_sets, "with a as (select distinct page, staff from notes_v), s as (select distinct page, system from notes_v), o as (select distinct page, system, staff from notes_v) select page, system, array_to_string(list_sort(list(staff)), ',') as missing from s join a using (page) where not exists (select 1 from o where o.page = s.page and o.system = s.system and o.staff = a.staff) group by page, system")
add("asm_missing_pages", "measures_v notes_v", lambda m, n: assemble.missing_pages(m.select(F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page")).distinct(), n), "select distinct page + 1 as page from measures_v where page + 1 not in (select page from notes_v)")
add("asm_boundaries", "measures_v", assemble.measure_boundaries, "with n as (select page, system, count(*) as n from measures_v group by page, system) select page, system, cast(sum(n) over w - n + 1 as bigint) as first, cast(sum(n) over w as bigint) as last from n window w as (partition by page order by system)")
add("asm_page_counts", "notes_v", assemble.page_counts, "with n as (select page, staff, count(*) as notes, cast(sum((not is_rest)::int) as bigint) as pitched from notes_v group by page, staff), r as (select *, count(*) over (partition by page) as size, row_number() over (partition by page order by staff) - 1 as depth from n) select page, staff, case when size = 2 then case depth when 0 then 'piano-treble' else 'piano-bass' end else 'staff-' || depth end as role, notes, pitched from r")
add("asm_phantom_bars", "notes_v measures_v", assemble.phantom_bars, "with s as (select m.page, m.measure, (exists (select 1 from notes_v n where not is_rest and n.page = m.page and n.measure = m.measure))::int as sounds from measures_v m) select page, measure, case when sounds = 1 then cast(sum(sounds) over (partition by page order by measure) as bigint) end as number, 1 - sounds as phantom from s")
add("asm_join_pages", "notes_v", lambda n: assemble.join_pages(n.withColumn("book", F.floor(F.col("page") / 16).cast("int"))), "with w as (select page // 16 as book, page, max(measure) as width from notes_v group by page), b as (select book, page, sum(width) over (partition by book order by page) - width as before from w) select event_id, cast(book as int) as book, page, cast(before + measure as bigint) as measure from notes_v join b using (page)")

# patterns
def signature_sql(notes: str = "notes_v", measures: str = "measures_v", clefs: str = "clefs_v") -> str:
    """Signatures (sg) and patterns (pk) of systems, as common table expressions."""
    return f"""me as (select page, system, arg_min_null(beats || '/' || beat_type, measure) as meter from {measures} group by page, system),
ln as (select page, system, measure, any_value(coalesce(cast(beats * 96 // beat_type as varchar), '?')) as length from {measures} group by page, system, measure),
bs as (select page, system, staff, sum(n) as n, array_to_string(list(coalesce(length, '?') order by measure), ',') as bars
  from (select page, system, staff, measure, count(*) as n from {notes} group by all) left join ln using (page, system, measure) group by page, system, staff),
cn as (select page, system, staff, min(sign || line) as clef from {clefs} group by all),
s0 as (select page, system, count(*) as staves, array_to_string(list(coalesce(clef, '?0') order by staff), ',') as clefs, array_to_string(list(coalesce(n, 0) order by staff), ',') as notes,
  array_to_string(list(coalesce(bars, '') order by staff), ';') as bars from bs full join cn using (page, system, staff) group by page, system),
sg as (select page, system, staves, meter, clefs, notes, bars from s0 left join me using (page, system)),
pk as (select page, staves, meter, clefs, count(*) as systems, min(system) as first from sg group by all)"""


SIGS = signature_sql()
KNOWN = "kn as (select * from (select *, max(systems) over (partition by page) as most, row_number() over (partition by page order by first) as nth from pk) where case when most >= 2 then systems >= 2 else nth <= 2 end)"
#: Systems of no known pattern; an unknown meter is like an unknown meter.
DEVIANT = "select sg.page, sg.system, sg.staves, sg.meter, sg.clefs from sg anti join kn on sg.page = kn.page and sg.staves = kn.staves and sg.meter is not distinct from kn.meter and sg.clefs = kn.clefs"
NEAREST = f"""dv as ({DEVIANT}), ne as (select dv.page, dv.system, dv.staves, dv.meter, dv.clefs, kn.staves as ks, kn.meter as km, kn.clefs as kc, first,
  (dv.staves <> kn.staves)::int * 2 + (dv.meter is distinct from kn.meter)::int + (dv.clefs <> kn.clefs)::int as differ from dv join kn using (page) qualify row_number() over (partition by dv.page, dv.system order by differ, first) = 1)"""
SIG = lambda n, m, c: pattern.signatures(n, m, c)
add("pat_signatures", "notes_v measures_v clefs_v", SIG, f"with {SIGS} select * from sg")
add("pat_keys", "notes_v measures_v clefs_v", lambda n, m, c: pattern.pattern_keys(SIG(n, m, c)), f"with {SIGS} select * from pk")
add("pat_deviations", "notes_v measures_v clefs_v", lambda n, m, c: pattern.deviations(SIG(n, m, c)), f"with {SIGS}, {KNOWN} {DEVIANT}")
NEAR_TO = lambda s: pattern.nearest(pattern.deviations(s), pattern.known_patterns(s)).select("page", "system", "k_clefs", "differ")
add("pat_nearest", "notes_v measures_v clefs_v", lambda n, m, c: NEAR_TO(SIG(n, m, c)), f"with {SIGS}, {KNOWN}, {NEAREST} select page, system, kc as k_clefs, differ from ne")
add("pat_columns", "clefs_v", pattern.columns, """with v as (select page, staff, sign || line as clef, count(*) as votes, min(system) as first, list(system) as systems from clefs_v group by all),
r as (select *, row_number() over (partition by page, staff order by votes desc, first) as k, sum(votes) over (partition by page, staff) as alle from v),
o as (select page, staff, array_to_string(list_sort(flatten(list(systems) filter (k > 1))), ',') as outliers from r group by page, staff)
select page, staff, clef, votes, coalesce(outliers, '') as outliers, (2 * votes > alle)::int as established from r join o using (page, staff) where k = 1""")

# scoring, shifts, frames
MATCH = """m0 as (select page, measure, onset, dur, midi, sum((run = 'A')::int) as a, sum((run = 'B')::int) as b from runs_v where not is_rest group by all),
mc as (select page, cast(sum(least(a, b)) as bigint) as matched, cast(sum(greatest(a - b, 0)) as bigint) as missed, cast(sum(greatest(b - a, 0)) as bigint) as spurious from m0 group by page)"""
add("score_match", "runs_v", lambda r: scoring.match_counts(A(r), B(r), ["page"]), f"with {MATCH} select * from mc")
add("score_prf", "runs_v", lambda r: scoring.prf(scoring.match_counts(A(r), B(r), ["page"])), f"""with {MATCH} select *, case when matched + spurious = 0 then 0 else 1000 * matched // (matched + spurious) end as "precision",
case when matched + missed = 0 then 0 else 1000 * matched // (matched + missed) end as recall, case when 2 * matched + missed + spurious = 0 then 0 else 2000 * matched // (2 * matched + missed + spurious) end as f1 from mc""")
add("score_melody", "notes_v", scoring.melody, "select page, event_id, midi, cast(row_number() over (partition by page order by measure, onset, staff, voice, event_id) as int) as place from notes_v where not is_rest")
add("score_corrupt_drop", "notes_v", lambda n: scoring.prf(scoring.match_counts(n, scoring.corrupt(n, "drop"), ["page"])), f"""with k as (select *, row_number() over (partition by {SK} order by measure, onset, event_id) as k from notes_v), mc as (select page, cast(sum((k % 5 <> 0)::int) as bigint) as matched, cast(sum((k % 5 = 0)::int) as bigint) as missed, cast(0 as bigint) as spurious from k where not is_rest group by page)
select *, case when matched + spurious = 0 then 0 else 1000 * matched // (matched + spurious) end as "precision", case when matched + missed = 0 then 0 else 1000 * matched // (matched + missed) end as recall, case when 2 * matched + missed = 0 then 0 else 2000 * matched // (2 * matched + missed) end as f1 from mc""")
add("score_position_shift", "runs_v", lambda r: scoring.position_shift(A(r).where("not is_rest"), B(r).where("not is_rest"), ["page"]), """with a as (select page, midi, count(*) as x from runs_v where run = 'A' and not is_rest group by all), b as (select page, midi, count(*) as y from runs_v where run = 'B' and not is_rest group by all),
s as (select a.page, b.midi - a.midi as shift, cast(sum(least(x, y)) as bigint) as support from a join b on a.page = b.page and b.midi - a.midi between -14 and 14 group by all)
select page, cast(shift as int) as shift, support from s qualify row_number() over (partition by page order by support desc, shift) = 1""")
add("score_feature_outliers", "notes_v", lambda n: scoring.feature_outliers(n.groupBy("page").agg(F.sum("dur").alias("ink")).withColumn("book", F.col("page") % 3), "ink", 4), "with f as (select page, page % 3 as book, cast(sum(dur) as bigint) as ink from notes_v group by page), m as (select book, median(ink) as median, count(*) as n from f group by book having count(*) >= 4) select book, page, ink, median from f join m using (book) where abs(ink - median) * 2 > median")
add("score_system_outliers", "notes_v", lambda n: scoring.feature_outliers(n.groupBy(F.col("page").alias("book"), F.col("system").alias("page")).agg(F.sum("dur").alias("ink")), "ink", 4), "with f as (select page as book, system as page, cast(sum(dur) as bigint) as ink from notes_v group by all), m as (select book, median(ink) as median, count(*) as n from f group by book having count(*) >= 4) select book, page, ink, median from f join m using (book) where abs(ink - median) * 2 > median")
add("score_smoothed", "notes_v", lambda n: scoring.smoothed(n.withColumn("midi", F.when(~F.col("is_rest"), F.col("midi"))), audit.SK, ["measure", "onset", "event_id"]).select("event_id", "smooth"), f"""with w as (select event_id, list_sort(list(midi) filter (not is_rest) over (partition by {SK} order by measure, onset, event_id rows between 2 preceding and 2 following)) as l from notes_v)
select event_id, case when len(l) >= 2 then l[len(l) // 2 + 1] end as smooth from w""")
add("score_pitch_runs", "notes_v", lambda n: scoring.pitch_runs(n.where("not is_rest"), audit.SK, ["measure", "onset", "event_id"]), f"""with x as (select *, coalesce((midi <> lag(midi) over (partition by {SK} order by measure, onset, event_id))::int, 1) as new from notes_v where not is_rest),
y as (select *, cast(sum(new) over (partition by {SK} order by measure, onset, event_id) as bigint) as run from x) select {SK}, run, min(midi) as midi, count(*) as n from y group by {SK}, run having count(*) >= 2""")

# streams, in batch form
add("stream_tally", "events", running_tally_batch, "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
add("stream_sample_trace", "events", lambda e: sample_trace(e, ["err*", "view"], "k", 3, 5), """with k as (select event_id, event_type, row_number() over (partition by event_type order by event_id) as hit from events where (event_type like 'err%' or event_type = 'view') and contains(props, 'k'))
select event_id, event_type, cast(hit as int) as hit from k where hit > 3 and hit <= 8""")

from . import review  # noqa: E402, F401  (registers its own, over the fragments above)
