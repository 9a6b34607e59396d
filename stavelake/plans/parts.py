"""Queries of parts, songs, written lengths, trimmed voices and scored notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as N
from ..operators import meter, parts, scoring
from ..operators.audit import SK
from .registry import add

KEYS = ", ".join(SK)
GROUPS = """gr as (select page, system, coalesce('b' || brace, 's' || staff) as grp, (brace is not null)::int as braced, min(staff) as first, max(staff) as last, count(*) as size from staves_v group by all),
bg as (select page, system, grp, first, last, size, braced, cast(row_number() over (partition by page, system, braced order by first) - 1 as int) as ordinal, cast(row_number() over (partition by page, system order by first) - 1 as int) as rank from gr)"""
OWN = """ow as (select s.page, s.system, s.staff, braced, ordinal, cast(row_number() over (partition by s.page, s.system, grp order by s.staff) as int) as local from staves_v s join bg on bg.page = s.page and bg.system = s.system and bg.grp = coalesce('b' || s.brace, 's' || s.staff))"""
WIDTH = "wi as (select page, system, width, cast(sum(width) over (partition by page order by system) - width as bigint) as before from (select page, system, max(measure) as width from fragments_v group by page, system))"
PARTS = f"{GROUPS}, {OWN}, {WIDTH}, pa as (select event_id, f.page, f.system, braced, ordinal, local as staff, measure + before as measure, is_rest, dur from fragments_v f join ow using (page, system, staff) join wi using (page, system))"
ORDER = """vo as (select *, count(*) over (partition by page, system) as parts from bg),
ea as (select page, braced, ordinal, list_sort(list(rank) filter (parts > 1)) as l, min(system * 100 + rank) as seen from vo group by all),
eb as (select *, case when bool_and(l is not null) over (partition by page) then l[len(l) // 2 + 1] end as vote from ea),
po as (select page, braced, ordinal, cast(row_number() over (partition by page order by vote, seen) - 1 as int) as place, case when braced = 1 then 'Piano' when ordinal = 0 then 'Voice' else 'Voice ' || (ordinal + 1) end as name from eb)"""
BARS = """ba as (select po.page, po.braced, po.ordinal, b.measure, coalesce(n, 0) as notes, (n is null)::int as is_empty from po join (select page, unnest(generate_series(1, max(measure))) as measure from pa group by page) b using (page)
left join (select page, braced, ordinal, measure, count(*) as n from pa where not is_rest group by all) c on c.page = po.page and c.braced = po.braced and c.ordinal = po.ordinal and c.measure = b.measure)"""
ROLE = """rs as (select *, count(*) over (partition by page, system) as size, row_number() over (partition by page, system order by staff) - 1 as depth from staves_v),
ro as (select page, system, staff, size, case when size < 2 then 'staff-' || depth when size = 2 then case depth when 0 then 'piano-treble' else 'piano-bass' end when depth = 0 then 'voice' when depth = 1 then 'piano-treble' when depth = size - 1 then 'piano-bass' else 'piano-upper' end as role from rs)"""


def part_rows(fragments: DataFrame, staves: DataFrame) -> DataFrame:
    return parts.assemble_parts(fragments, staves)


add("part_brace_groups", "staves_v", parts.brace_groups, f"with {GROUPS} select page, system, first, size, braced, ordinal, rank, (last - first + 1 = size)::int as contiguous from bg")
add("part_clef_pairs", "staves_v", lambda s: parts.clef_pairs(s).select("page", "system", "staff", "brace"), """with t as (select *, coalesce(sign = 'G' and line = 2 and lead(sign) over w = 'F' and lead(line) over w in (3, 4), false) as top from staves_v window w as (partition by page, system order by staff))
select page, system, staff, case when top then staff when lag(top) over w then lag(staff) over w end as brace from t window w as (partition by page, system order by staff)""")
add("part_brace_fallback", "staves_v", lambda s: parts.brace_fallback(s).select("page", "system", "staff", "brace"), """with t as (select page, system, staff, brace, count(*) over (partition by page, system) as size, row_number() over (partition by page, system order by staff) as depth, count(brace) over (partition by page, system, brace) as under from staves_v),
u as (select *, max(under) over (partition by page, system) > 1 as seen from t) select page, system, staff, case when seen then brace when size = 2 or (size > 2 and depth > 1) then 1 end as brace from u""")
add("part_assemble", "fragments_v staves_v", lambda f, s: part_rows(f, s).select("event_id", "page", "braced", "ordinal", "staff", "measure"), f"with {PARTS} select event_id, page, braced, ordinal, staff, measure from pa")
add("part_order", "staves_v", parts.part_order, f"with {GROUPS}, {ORDER} select * from po")
add("part_bars", "fragments_v staves_v", lambda f, s: parts.part_bars(part_rows(f, s), s), f"with {PARTS}, {ORDER}, {BARS} select * from ba")
add("part_role_systems", "fragments_v staves_v", parts.role_systems, f"""with {ROLE}, {WIDTH}, o as (select page, system, role, max(measure) as bars from fragments_v join ro using (page, system, staff) group by all), g as (select r.page, system, role, width from (select distinct page, role from o) r join wi using (page))
select page, system, role, width, width - coalesce(bars, width) as short, (bars is null)::int as absent from g left join o using (page, system, role)""")
add("part_role_levels", "staves_v", parts.role_levels, f"""with {ROLE}, al as (select distinct page, role from ro where (page, size) in (select page, max(size) from ro group by page)), sy as (select distinct page, system from ro),
mi as (select page, system, array_to_string(list_sort(list(role)), ',') as missing from (select sy.page, sy.system, al.role from sy join al using (page) except select page, system, role from ro) group by page, system),
sx as (select distinct page, system from ro where (page, role) not in (select page, role from al))
select page, system, coalesce(missing, '') as missing, case when sx.page is not null then 'warning' else 'note' end as level from sy left join mi using (page, system) left join sx using (page, system) where mi.page is not null or sx.page is not null""")
add("part_bottom_grid", "fragments_v staves_v", parts.bottom_grid, f"""with {WIDTH}, d as (select page, system, staff, row_number() over (partition by page, system order by staff desc) - 1 as depth from staves_v), t as (select *, max(depth) over (partition by page) + 1 as tallest from d)
select event_id, page, cast(tallest - depth as int) as "row", measure + before as measure from fragments_v join t using (page, system, staff) join wi using (page, system)""")
add("part_merge_fragments", "fragments_v", parts.merge_fragments, "select page, system, staff, 'P' || row_number() over (partition by page, system order by staff) as part_id from (select distinct page, system, staff from fragments_v)")
add("part_report", "fragments_v staves_v", lambda f, s: parts.assembly_report(f, s.where("staff <> 4")), """with s as (select * from staves_v where staff <> 4), n as (select page, count(s.staff) as placed, count(*) - count(s.staff) as lost from fragments_v f left join s using (page, system, staff) group by page),
k as (select page, system, coalesce('b' || brace, 's' || staff) as grp, (brace is not null)::int as braced, min(staff) as first, max(staff) - min(staff) + 1 <> count(*) as broken from s group by all),
o as (select *, row_number() over (partition by page, system, braced order by first) as ordinal from k)
select n.page, placed, lost, systems, parts, broken from n left join (select page, count(distinct system) as systems, count(distinct braced * 1000 + ordinal) as parts, cast(sum(broken::int) as bigint) as broken from o group by page) g on g.page = n.page""")
add("part_invariants", "fragments_v staves_v", lambda f, s: parts.invariants(part_rows(f, s), parts.part_bars(part_rows(f, s), s).where("measure <= 20 or braced = 0")), f"""with {PARTS}, {ORDER}, {BARS}, b as (select * from ba where measure <= 20 or braced = 0), w as (select page, braced, ordinal, max(measure) as width from b group by all)
select page, 'width' as problem, count(distinct width) as n from w group by page having count(distinct width) > 1
union all select page, 'lost', count(*) from pa where braced = 1 and measure > 20 group by page""")
GRID = f"""{GROUPS}, sh as (select *, tallest + (parts > 1 and tallest = accomp)::int as total from (select page, max(size) as accomp, count(distinct braced * 1000 + ordinal) as parts from bg group by page) join (select page, max(n) as tallest from (select page, system, count(*) as n from staves_v group by page, system) group by page) using (page)),
gw as (select page, from_bottom, case when from_bottom < accomp then 'A1' else 'S' || (total - from_bottom) end as part, cast(case when from_bottom < accomp then accomp - from_bottom else 1 end as bigint) as staff from (select *, unnest(generate_series(0, total - 1)) as from_bottom from sh)),
fb as (select *, row_number() over (partition by page, system order by staff desc) - 1 as from_bottom from staves_v), {WIDTH}"""
add("part_page_grid", "fragments_v staves_v", parts.page_grid, f"with {GRID} select event_id, f.page, part, gw.staff, cast(measure + before as bigint) as measure from fragments_v f join fb using (page, system, staff) join gw on gw.page = f.page and gw.from_bottom = fb.from_bottom join wi on wi.page = f.page and wi.system = f.system")
FORCED = lambda s: s.where("page % 3 = 0").select("page", F.lit(0).alias("from_bottom"), F.lit("F").alias("sign"), F.lit(4).alias("line")).distinct()
add("part_grid_clefs", "fragments_v staves_v", lambda f, s: parts.grid_clefs(f, s, FORCED(s)), f"""with {GRID}, rd as (select *, row_number() over w as nth, lag(sign || line) over w = sign || line as same from (select page, from_bottom, sign, line, before + 1 as measure from fb join wi using (page, system)) window w as (partition by page, from_bottom order by measure)),
tu as (select page, from_bottom, case when nth = 1 then 1 else measure end as measure, sign, line from rd where (nth = 1 or not same) and not (page % 3 = 0 and from_bottom = 0) union all select distinct page, 0, 1, 'F', 4 from staves_v where page % 3 = 0)
select page, part, staff, cast(coalesce(measure, 1) as bigint) as measure, coalesce(sign, 'G') as sign, coalesce(line, 2) as line from gw left join tu using (page, from_bottom)""")
LEVELS = f"""{ROLE}, al as (select distinct page, role from ro where (page, size) in (select page, max(size) from ro group by page)), wa as (select page, count(*) as warnings from (select distinct page, system from ro where (page, role) not in (select page, role from al)) group by page)"""
add("part_corpus_report", "fragments_v staves_v measures_v", lambda f, s, m: parts.corpus_report(f, s, m, parts.part_bars(part_rows(f, s), s).where("measure <= 20 or braced = 0 or page % 2 = 0")), f"""with {PARTS}, {ORDER}, {BARS}, {LEVELS}, b as (select * from ba where measure <= 20 or braced = 0 or page % 2 = 0), w as (select page, braced, ordinal, max(measure) as width from b group by all),
pr as (select page, array_to_string(list_sort(list(problem))[1:2], '; ') as problems from (select page, 'width' as problem from w group by page having count(distinct width) > 1 union select page, 'lost' from pa where braced = 1 and measure > 20 and page % 2 = 1) group by page),
cl as (select page, count(*) as clamped from (select pa.page, f.onset + f.dur > floor(beats * 96 / beat_type) as over from pa join fragments_v f using (event_id) join measures_v m on m.page = pa.page and m.measure = pa.measure) where over group by page),
br as (select page, max((last - first + 1 <> size)::int) as broken from bg group by page), nm as (select page, array_to_string(list_sort(list(distinct name)), ',') as roles from po group by page)
select page, case when broken = 1 then 'fail' when problems is not null then 'invariant' else 'ok' end as status, roles, coalesce(warnings, 0) as warnings, coalesce(clamped, 0) as clamped, coalesce(problems, '') as problems from nm join br using (page) left join pr using (page) left join cl using (page) left join wa using (page)""")
SONGS = lambda m: m.select("page").distinct().select(F.concat(F.lit("Song "), F.floor(F.col("page") / 4).cast("string")).alias("title"), (-F.col("page")).alias("place"), "page")
add("part_stitch", "fragments_v staves_v measures_v", lambda f, s, m: parts.stitch(parts.named(part_rows(f, s), s), SONGS(m), m), f"""with {PARTS}, {ORDER}, so as (select distinct 'Song ' || page // 4 as title, page from measures_v), wh as (select title, page, sum(w) over (partition by title order by page desc) - w as before from so join (select page, max(measure) as w from measures_v group by page) using (page)),
nm as (select distinct title, name from pa join po using (page, braced, ordinal) join so using (page)), c as (select page, name, measure, count(*) as n from pa join po using (page, braced, ordinal) where not is_rest group by all)
select title, nm.name, cast(before + m.measure as bigint) as measure, m.page, coalesce(n, 0) as notes, cast(beats * 96 // beat_type as bigint) as bar from wh join measures_v m using (page) join nm using (title) left join c on c.page = m.page and c.name = nm.name and c.measure = m.measure""")

# written lengths
PLAIN = "(values " + ", ".join(f"({t}, '{n}', {d})" for t, (n, d) in sorted(N.plain_values().items())) + ") v(value, type, dots)"
SUMS = f"t as (select {KEYS}, measure, cast(sum(dur) as int) as total from notes_v group by {KEYS}, measure)"
TOTAL = lambda n: n.groupBy(*SK, "measure").agg(F.sum("dur").cast("int").alias("total"))
add("fn_written_ratio", "notes_v", lambda n: TOTAL(n).withColumn("w", N.written_ratio("total")).select(*SK, "measure", "total", "w.*"), f"""with {SUMS}, o as (select distinct total, type, dots, value // gcd(total, value) as actual, total // gcd(total, value) as normal, abs(total - value) as off, value from (select distinct total from t), {PLAIN}),
b as (select *, row_number() over (partition by total order by (total <> value)::int, greatest(actual, normal), off, value) as k from o)
select {KEYS}, measure, total, type, dots, cast(actual as int) as actual, cast(normal as int) as normal from t join b using (total) where k = 1""")
LENGTHS = ", ".join(f"({v})" for v in sorted({*N.plain_values(), *range(96, 864, 96)}))
add("fn_split_plain", "notes_v", lambda n: TOTAL(n).select(*SK, "measure", F.concat_ws(" ", F.transform(N.split_plain("total"), lambda x: x.cast("string"))).alias("pieces")), f"""with {SUMS}, p as (select * from (with recursive r as (select total, total as rest, '' as pieces, 0 as k from (select distinct total from t)
union all select r.total, rest - v, pieces || ' ' || v, k + 1 from (select total, rest, pieces, k, max(v) as v from r join (values {LENGTHS}) l(v) on v <= rest where k < 12 group by all) r) select total, arg_max(pieces, k) as pieces from r group by total))
select {KEYS}, measure, trim(pieces) as pieces from t join p using (total)""")

# voices as lines in time
TRIM = f"""n1 as (select n.*, case when is_rest then 0 else n.midi end as pitch, floor(beats * 96 / beat_type) as bar from notes_v n join measures_v m on m.page = n.page and m.measure = n.measure),
n2 as (select *, row_number() over (partition by {KEYS}, measure order by onset, pitch, event_id) as k from n1),
tm as (select * from (with recursive r as (select {KEYS}, measure, cast(0 as bigint) as k, cast(0 as double) as cur, cast(-1 as double) as last, cast(null as bigint) as event_id, cast(0 as double) as start, cast(0 as double) as stop, false as kept, false as touched from n2 where k = 1
union all select {KEYS}, measure, k, case when ok then stop else cur end, case when ok then start else last end, event_id, start, stop, ok, touched from (
  select *, stop > start and start < bar as ok, start <> onset or stop <> onset + dur as touched from (
    select n2.page, n2.staff, n2.voice, n2.measure, n2.k, r.cur, r.last, n2.event_id, bar, onset, dur, case when onset = r.last then onset else greatest(onset, r.cur) end as start, least(onset + dur, bar) as stop
    from r join n2 on n2.page = r.page and n2.staff = r.staff and n2.voice = r.voice and n2.measure = r.measure and n2.k = r.k + 1))) select * from r where k > 0))"""
add("meter_trim_overlaps", "notes_v measures_v", meter.trim_overlaps, f"with {TRIM} select {KEYS}, measure, event_id, cast(start as bigint) as onset, cast(stop - start as bigint) as dur, touched::int as touched from tm where kept")
add("meter_trim_losses", "notes_v measures_v", meter.trim_losses, f"with {TRIM} select page, cast(sum((not kept)::int) as bigint) as dropped, cast(sum((kept and touched)::int) as bigint) as changed from tm group by page")
SLURS = lambda n: n.where("event_id % 3 = 0").select("event_id", F.when(F.col("midi") % 2 == 0, "start").otherwise("stop").alias("kind"))
add("meter_clean_voices", "notes_v measures_v", lambda n, m: meter.clean_voices(n, m, SLURS(n)).select("event_id", "kind"), f"""with {TRIM}, s as (select tm.page, tm.staff, tm.voice, tm.measure, start, tm.event_id, case when midi % 2 = 0 then 'start' else 'stop' end as kind from tm join notes_v using (event_id) where kept and event_id % 3 = 0),
f as (select *, kind is distinct from lag(kind) over (partition by {KEYS} order by measure, start, event_id) as turn from s),
e as (select *, row_number() over (partition by {KEYS} order by measure, start, event_id) as k, lead(kind) over (partition by {KEYS} order by measure, start, event_id) as after from f where turn)
select event_id, kind from e where not (kind = 'stop' and k = 1) and not (kind = 'start' and after is null)""")

# notes against truth
LETTERS = lambda r, run: r.where(f"run = '{run}'").withColumn("letter", F.expr("substr('CCDDEFFGGAAB', midi % 12 + 1, 1)"))
def aligned(keys: str, order: str, rows: str = "runs_v") -> str:
    """SQL of the longest common subsequence of both runs: tb has (keys, i, j, op), i and j counting what is behind."""
    return f"""nt as (select run, {keys}, substr('CCDDEFFGGAAB', midi % 12 + 1, 1) as letter, dur, is_rest, case when is_rest then 'rest' else cast(midi as varchar) end as value, row_number() over (partition by run, {keys} order by {order}) - 1 as place from {rows}),
kl as (select {keys}, coalesce(list(value order by place) filter (run = 'A'), []) as a, coalesce(list(value order by place) filter (run = 'B'), []) as b from nt group by {keys}),
rw as (select * from (with recursive r as (select {keys}, cast(len(a) as bigint) as i, list_transform(range(0, len(b) + 1), lambda x: cast(0 as bigint)) as best from kl
  union all select {keys}, i, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[j:])) from (
    select {keys}, i - 1 as i, list_transform(range(1, len(b) + 2), lambda j: case when j <= len(b) and b[j] = a[i] then greatest(best[j], best[j + 1] + 1) else best[j] end) as cand from r join kl using ({keys}) where i > 0)) select * from r)),
tb as (select * from (with recursive t as (select {keys}, cast(0 as bigint) as i, cast(0 as bigint) as j, cast(null as varchar) as op from kl
  union all select {keys}, case when op = 'i' then i else i + 1 end, case when op = 'd' then j else j + 1 end, op from (
    select {keys}, i, j, case when i < len(a) and j < len(b) and a[i + 1] = b[j + 1] then 'm' when i < len(a) and (j = len(b) or under[j + 1] >= best[j + 2]) then 'd' else 'i' end as op
    from t join kl using ({keys}) left join rw using ({keys}, i) left join (select {keys}, i - 1 as i, best as under from rw) using ({keys}, i) where i < len(a) or j < len(b))) select * from t where op is not null))"""


ALIGNED = f"""{aligned(KEYS, 'measure, onset, event_id')},
ta as (select {KEYS}, place + 1 as i, letter, dur, is_rest from nt where run = 'A'), pb as (select {KEYS}, place + 1 as j, letter as p_letter, dur as p_dur, is_rest as p_rest from nt where run = 'B'),
lo as (select {KEYS}, letter, dur, row_number() over (partition by {KEYS} order by i) as nth from tb join ta using ({KEYS}, i) where op = 'd' and not is_rest),
ex as (select {KEYS}, p_letter, p_dur, row_number() over (partition by {KEYS} order by j) as nth from tb join pb using ({KEYS}, j) where op = 'i' and not p_rest),
kd as (select {KEYS}, case when dur = p_dur then 'exact' else 'duration_wrong' end as kind, false as same from tb join ta using ({KEYS}, i) join pb using ({KEYS}, j) where op = 'm' and not is_rest
  union all select {KEYS}, case when p_dur is null then 'missed' when dur is null then 'spurious' when dur = p_dur then 'pitch_wrong' else 'both_wrong' end, coalesce(dur = p_dur and letter = p_letter, false) from lo full join ex using ({KEYS}, nth))"""
add("score_notes", "runs_v", lambda r: scoring.score_notes(LETTERS(r, "A"), LETTERS(r, "B"), SK, ["measure", "onset", "event_id"]), f"""with {ALIGNED} select {KEYS}, count(*) filter (kind <> 'spurious') as truth_notes, count(*) filter (kind <> 'missed') as pred_notes, count(*) filter (kind = 'exact') as exact, count(*) filter (kind = 'duration_wrong') as duration_wrong,
count(*) filter (kind = 'pitch_wrong') as pitch_wrong, count(*) filter (kind = 'both_wrong') as both_wrong, count(*) filter (kind = 'missed') as missed, count(*) filter (kind = 'spurious') as spurious, count(*) filter (same) as letter_only from kd group by {KEYS}""")
add("score_cases", "runs_v", lambda r: scoring.case_rows(scoring.match_counts(r.where("run = 'A'"), r.where("run = 'B'"), ["page"]), r.select("page").distinct().withColumn("kind", F.lit("misread")), "page"), """with m as (select page, measure, onset, dur, midi, sum((run = 'A')::int) as a, sum((run = 'B')::int) as b from runs_v where not is_rest group by all),
c as (select page, cast(sum(least(a, b)) as bigint) as matched, cast(sum(greatest(a - b, 0)) as bigint) as missed, cast(sum(greatest(b - a, 0)) as bigint) as spurious from m group by page)
select p.page, 'misread' as kind, coalesce(matched, 0) as matched, coalesce(missed, 0) as missed, coalesce(spurious, 0) as spurious from (select distinct page from runs_v) p left join c on c.page = p.page""")
