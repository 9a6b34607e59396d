"""Queries of page geometry and audio frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audio, geometry
from ..operators.audit import long
from .registry import add

GAPS = "g0 as (select *, y - lag(y) over (partition by page order by y) as gap from lines_v)"
SPACE = f"{GAPS}, sp as (select page, median(gap) as space from g0 where gap between 3 and 60 group by page)"
GROUPED = """g1 as (select g0.*, space, coalesce(gap > 1.9 * space, true) as new from g0 join sp using (page)),
g2 as (select *, sum(new::int) over (partition by page order by y) as grp from g1),
g3 as (select page, min(y) - 1.0 as y_top, max(y) + 1.0 as y_bot, sum(y) / count(*) as y_center, min(x0) as x0, max(x1) as x1, count(*) as n_lines,
  sum(gap) filter (not new) / (count(*) - 1) as spacing, max(gap) filter (not new) as most, min(gap) filter (not new) as fewest from g2 group by page, grp having count(*) >= 3),
st as (select page, cast(row_number() over (partition by page order by y_top) as int) as staff, y_top, y_bot, y_center, x0, x1, n_lines, spacing, most - fewest as spread, greatest(most - spacing, spacing - fewest) as resid, x1 - x0 as width from g3)"""
STAVES = f"{SPACE}, {GROUPED}"
LINKED = """li as (select st.*, coalesce((select count(*) from rules_v r where r.page = st.page and r.x > b.l - 12 and r.x < b.r + 12 and r.top <= prev and r.bottom >= y_center), 0) > 0 as linked
  from (select *, lag(y_center) over (partition by page order by y_top) as prev from st) st join (select page, min(x0) as l, max(x1) as r from st group by page) b using (page)),
ls as (select page, staff, cast(sum((not linked)::int) over (partition by page order by staff) as bigint) as system from li)"""
SYSTEMS = """sy as (select page, staff, cast(sum(new) over (partition by page order by y_top) as bigint) as system from (
  select st.*, coalesce((not (y_top - lag(y_bot) over w <= 7 * space and greatest(least(x1, lag(x1) over w) - greatest(x0, lag(x0) over w), 0) >= 0.55 * least(width, lag(width) over w)))::int, 1) as new
  from st join sp using (page) window w as (partition by page order by y_top)))"""


MERGED = """s as (select *, row_number() over (partition by page order by y, x0, x1) as k from pieces_v),
m as (select * from (with recursive r as (select page, k, [struct_pack(y := y, x0 := x0, x1 := x1, th := th, n := cast(1 as int))] as kept from s where k = 1
union all select page, k, case when hit is null then list_append(kept, struct_pack(y := y, x0 := x0, x1 := x1, th := th, n := cast(1 as int)))
  else list_transform(kept, lambda q, i: case when i = hit then struct_pack(y := (q.y * q.n + y) / (q.n + 1), x0 := least(q.x0, x0), x1 := greatest(q.x1, x1), th := q.th, n := cast(q.n + 1 as int)) else q end) end
  from (select s.*, kept, list_min(list_filter(range(1, len(kept) + 1), lambda i: abs(kept[i].y - s.y) <= 6 and s.x0 <= kept[i].x1 + 40 and s.x1 >= kept[i].x0 - 40)) as hit from r join s on s.page = r.page and s.k = r.k + 1)) select * from r)),
u as (select page, unnest(kept) as q from (select * from m qualify row_number() over (partition by page order by k desc) = 1))"""
THINNED = f"""{SPACE.replace('lines_v', 'pieces_v')}, s as (select pieces_v.*, 0.45 * coalesce(space, 0) as near, row_number() over (partition by page order by y, x0, x1) as k from pieces_v left join sp using (page)),
m as (select * from (with recursive r as (select page, k, [struct_pack(y := y, x0 := x0, x1 := x1, th := th)] as kept from s where k = 1
union all select page, k, case when hit is null then list_append(kept, struct_pack(y := y, x0 := x0, x1 := x1, th := th))
  when x1 - x0 > kept[hit].x1 - kept[hit].x0 then list_transform(kept, lambda q, i: case when i = hit then struct_pack(y := y, x0 := x0, x1 := x1, th := th) else q end) else kept end
  from (select s.*, kept, list_min(list_filter(range(1, len(kept) + 1), lambda i: abs(kept[i].y - s.y) < s.near)) as hit from r join s on s.page = r.page and s.k = r.k + 1)) select * from r)),
u as (select page, unnest(kept) as q from (select * from m qualify row_number() over (partition by page order by k desc) = 1))"""
SETTLED = f"""{MERGED}, ml as (select page, q.y, q.x0, q.x1, q.th from u),
rg as (select page, median(gap) as rough from (select page, y - lag(y) over (partition by page order by y) as gap from ml) where gap between 8 and 60 group by page),
s2 as (select ml.*, 0.45 * coalesce(rough, 0) as near, row_number() over (partition by page order by y, x0, x1) as k from ml left join rg using (page)),
m2 as (select * from (with recursive r as (select page, k, [struct_pack(y := y, x0 := x0, x1 := x1, th := th)] as kept from s2 where k = 1
union all select page, k, case when hit is null then list_append(kept, struct_pack(y := y, x0 := x0, x1 := x1, th := th))
  when x1 - x0 > kept[hit].x1 - kept[hit].x0 then list_transform(kept, lambda q, i: case when i = hit then struct_pack(y := y, x0 := x0, x1 := x1, th := th) else q end) else kept end
  from (select s2.*, kept, list_min(list_filter(range(1, len(kept) + 1), lambda i: abs(kept[i].y - s2.y) < s2.near)) as hit from r join s2 on s2.page = r.page and s2.k = r.k + 1)) select * from r)),
u2 as (select page, unnest(kept) as q from (select * from m2 qualify row_number() over (partition by page order by k desc) = 1)),
tl as (select page, q.y, q.x0, q.x1, q.th from u2),
g0 as (select *, y - lag(y) over (partition by page order by y) as gap from tl),
sp as (select page, median(gap) as space from g0 left join rg using (page) where gap between coalesce(0.5 * rough, 3) and 60 group by page)"""
MATCHED = """h as (select run, page, staff, measure, event_id % 997 / 997 + case run when 'B' then cast(0.001 as double) else 0 end as x, midi as y from runs_v where not is_rest),
b as (select page, staff, measure, list(struct_pack(x := x, y := y) order by x, y) as heads from h where run = 'B' group by all),
a as (select h.*, heads, row_number() over (partition by page, staff, measure order by x, h.y) as k from h join b using (page, staff, measure) where run = 'A'),
mt as (select * from (with recursive r as (select distinct page, staff, measure, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(0 as double) as ax, 0 as ay, cast(0 as double) as bx, 0 as by_ from a
union all select page, staff, measure, k, case when j is null then used else list_append(used, j) end, x, y, heads[j].x, heads[j].y
  from (select a.*, used, list_sort(list_transform(list_filter(range(1, len(heads) + 1), lambda i: heads[i].x >= a.x - 0.02 and heads[i].x <= a.x + 0.02 and not list_contains(used, i)), lambda i: struct_pack(off := abs(heads[i].x - a.x), i := i)))[1].i as j
    from r join a on a.page = r.page and a.staff = r.staff and a.measure = r.measure and a.k = r.k + 1)) select * from r where k > 0 and bx is not null))"""


def staves_of(lines: DataFrame) -> DataFrame:
    return geometry.group_lines(lines, geometry.staff_spacing(lines))


add("geo_spacing", "lines_v", geometry.staff_spacing, f"with {SPACE} select page, space as spacing from sp")
add("geo_staves", "lines_v", staves_of, f"with {STAVES} select * from st")
add("geo_systems", "lines_v", lambda n: geometry.group_systems(staves_of(n), geometry.staff_spacing(n)), f"with {STAVES}, {SYSTEMS} select * from sy")
add("geo_linked_systems", "lines_v rules_v", lambda n, r: geometry.linked_systems(staves_of(n), r), f"with {STAVES}, {LINKED} select * from ls")
add("geo_split_system", "lines_v rules_v", lambda n, r: geometry.split_system(staves_of(n), r, geometry.group_systems(staves_of(n), geometry.staff_spacing(n))), f"""with {STAVES}, {LINKED}, {SYSTEMS},
j as (select page, staff, sy.system, ls.system as run, count(*) over (partition by page, sy.system, ls.system) as size from sy join ls using (page, staff))
select page, system, staff, case when max(size) over (partition by page, system) > 1 then cast(dense_rank() over (partition by page, system order by run) as int) else 1 end as part from j""")
add("geo_attach_lonely", "lines_v rules_v", lambda n, r: geometry.attach_lonely(geometry.linked_systems(staves_of(n), r).groupBy("page", "system").agg(F.count("*").alias("n_staves"))), f"""with {STAVES}, {LINKED}, z as (select page, system, count(*) as n from ls group by page, system)
select page, system, case when n > 1 then system else coalesce((select z2.system from z z2 where z2.page = z.page and z2.system = z.system + 1 and z2.n > 1), (select max(z3.system) from z z3 where z3.page = z.page and z3.system < z.system and z3.n > 1), system) end as target from z""")
add("geo_staff_flags", "lines_v", lambda n: geometry.staff_flags(staves_of(n), geometry.staff_spacing(n), width=910), f"""with {STAVES}, f as (select page, staff, concat_ws(',', case when n_lines <> 5 then 'lines' end, case when resid > 2 then 'uneven' end, case when width < 910 then 'narrow' end,
  case when abs(spacing - space) > 0.25 * space then 'spacing' end) as reasons from st join sp using (page)) select * from f where reasons <> ''""")
add("geo_free_regions", "lines_v rules_v", lambda n, r: geometry.free_regions(r.select("page", F.col("x").alias("rx0"), (F.col("x") + 40).alias("rx1"), (F.col("top") + 40).alias("top"), (F.col("bottom") + 20).alias("bottom")), staves_of(n)), f"""with {STAVES}, r as (select page, x as rx0, x + 40 as rx1, top + 40 as top, bottom + 20 as bottom from rules_v)
select * from r where not exists (select 1 from st where st.page = r.page and rx0 <= x1 and rx1 >= x0 and top <= y_bot and bottom >= y_top)""")
add("geo_row_groups", "lines_v", geometry.row_groups, f"""with {GAPS}, a as (select page, y, sum(coalesce((gap > 3)::int, 1)) over (partition by page order by y) as grp from g0), m as (select page, sum(y) / count(*) as y from a group by page, grp),
d as (select page, y - lag(y) over (partition by page order by y) as gap from m), p as (select page, count(*) as n, median(gap) as med from d group by page)
select page, any_value(n) as rows, coalesce(sum((abs(gap - med) <= 0.4 * med)::int) >= 0.6 * count(gap) and count(gap) > 0, false)::int as even from d join p using (page) group by page""")


def page_features(notes: DataFrame) -> DataFrame:
    """A page's sounding length, number of systems and share of notes in three thirds of a page."""
    third = lambda i: F.sum((F.col("measure") % 3 == i).cast("int")) / F.count("*")
    return notes.groupBy("page").agg(long(F.sum("dur")).alias("ink"), F.countDistinct("system").alias("bands"), F.array(*map(third, range(3))).alias("shares"))


def run_pairs(runs: DataFrame) -> DataFrame:
    rows = runs.withColumn("system", F.floor((F.col("measure") - 1) / 5))
    return geometry.page_pairs(page_features(rows.where("run = 'A'")), page_features(rows.where("run = 'B'")))


add("geo_page_pairs", "runs_v", run_pairs, """with f as (select run, page, sum(dur) as ink, count(distinct floor((measure - 1) / 5)) as bands, sum((measure % 3 = 0)::int) / count(*) as s0, sum((measure % 3 = 1)::int) / count(*) as s1, sum((measure % 3 = 2)::int) / count(*) as s2 from runs_v group by run, page)
select a.page, cast(b.ink as double) / cast(a.ink as double) as ink_ratio, a.bands, b.bands as r_bands, greatest(abs(a.s0 - b.s0), abs(a.s1 - b.s1), abs(a.s2 - b.s2)) as deviance from f a join f b on a.page = b.page and a.run = 'A' and b.run = 'B'""")
add("geo_pair_staves", "staves_v", lambda s: geometry.pair_staves(s, s.where("staff <> 3")), """with a as (select page, system, staff, cast(row_number() over (partition by page, system order by staff desc) - 1 as int) as depth from staves_v), b as (select page, system, staff as r_staff, cast(row_number() over (partition by page, system order by staff desc) - 1 as int) as depth from staves_v where staff <> 3)
select * from a join b using (page, system, depth)""")

HEADS = lambda r, run: r.where(f"run = '{run}' and not is_rest").select("page", "staff", "measure", (F.col("event_id") % 997 / 997 + F.lit(0.001 if run == "B" else 0)).alias("x"), F.col("midi").alias("y"))
add("geo_noteheads", "runs_v", lambda r: geometry.match_noteheads(HEADS(r, "A"), HEADS(r, "B"), ["page", "staff", "measure"]), f'with {MATCHED} select page, staff, measure, ax, ay, bx, by_ as "by" from mt')
add("geo_displacements", "runs_v", lambda r: geometry.displacements(geometry.match_noteheads(HEADS(r, "A"), HEADS(r, "B"), ["page", "staff", "measure"]), ["page"]), f"""with {MATCHED}, d as (select page, list(bx - ax order by bx - ax) as l, count(*) as c from mt group by page),
e as (select page, case when c % 2 = 1 then l[(c + 1) // 2] else 0.5 * l[c // 2] + 0.5 * l[c // 2 + 1] end as x_shift from d)
select page, cast(by_ - ay as int) as moved, count(*) as n, x_shift from mt join e using (page) group by page, moved, x_shift""")
add("geo_merge_collinear", "pieces_v", lambda n: geometry.merge_collinear(n), f"with {MERGED} select page, q.y, q.x0, q.x1, q.th, q.n from u")
add("geo_drop_slivers", "pieces_v", lambda n: geometry.drop_slivers(n, geometry.staff_spacing(n)), f"with {THINNED} select page, q.y, q.x0, q.x1, q.th from u")


def staves_of_pieces(pieces: DataFrame) -> DataFrame:
    staves = geometry.group_lines(*geometry.settled_lines(pieces))
    return staves.withColumns({c: F.round(c, 6) for c in ("y_top", "y_bot", "y_center", "spacing", "spread", "resid")})


add("geo_settled_lines", "pieces_v", lambda n: geometry.settled_lines(n)[0], f"with {SETTLED} select * from tl")
add("geo_settled_spacing", "pieces_v", lambda n: geometry.settled_lines(n)[1].withColumn("spacing", F.round("spacing", 6)), f"with {SETTLED} select page, round(space, 6) as spacing from sp")
add("geo_settled_staves", "pieces_v", staves_of_pieces, f"""with {SETTLED}, {GROUPED} select page, staff, round(y_top, 6) as y_top, round(y_bot, 6) as y_bot, round(y_center, 6) as y_center,
  x0, x1, n_lines, round(spacing, 6) as spacing, round(spread, 6) as spread, round(resid, 6) as resid, width from st""")

RATE, SIZE = 8000, 512


def tones(notes: DataFrame) -> DataFrame:
    """Frames of plain tones at the pitches of notes, three octaves from 48 up; rests are silent.

    A wave follows from its step in these octaves and from whether it is a rest, so each is made once and joined back. A frame
    costs far more than the row it is made of, so rows are dealt out first.
    """
    rows = notes.select("page", "event_id", "is_rest", (F.col("midi") % 36).alias("at")).repartition("event_id")
    hz = 440 * F.pow(F.lit(2.0), (48 + F.col("at") - 69) / 12)
    wave = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.sin(i * hz * (2 * math.pi / RATE)) * F.when(F.col("is_rest"), 0.0).otherwise(0.5))
    waves = notes.select("is_rest", (F.col("midi") % 36).alias("at")).distinct().select(F.col("is_rest").alias("silent"), F.col("at").alias("step"), wave.alias("samples"))
    both = rows.join(F.broadcast(waves), F.col("is_rest").eqNullSafe(F.col("silent")) & F.col("at").eqNullSafe(F.col("step")))
    return both.select(F.col("page").alias("doc_id"), F.col("event_id").alias("frame"), (F.col("event_id") * 0.01).alias("t"), F.lit(RATE).alias("rate"), "samples")


def track(notes: DataFrame) -> DataFrame:
    """A frame track of each page: its notes in order, each for as many frames as its ticks divide by six; rests are unvoiced."""
    order = Window.partitionBy("page").orderBy("event_id")
    rows = notes.withColumn("n", F.floor(F.col("dur") / 6)).withColumn("start", F.sum("n").over(order) - F.col("n"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select(F.col("page").alias("doc_id"), (F.col("start") + F.col("k")).alias("frame"), F.when(~F.col("is_rest"), 60 + F.col("midi") % 2).alias("midi"), F.lit(440.0).alias("hz"), F.lit(1.0).alias("clarity"))


add("audio_frame_pitch", "notes_v", lambda n: audio.frame_pitch(tones(n)).select("doc_id", "frame", "midi"), "select page as doc_id, event_id as frame, case when not is_rest then 48 + midi % 36 end as midi from notes_v")
add("audio_signal_level", "notes_v", lambda n: audio.signal_level(tones(n)).select("doc_id", "frame", F.bround(F.col("rms") * 20).cast("int").alias("loud")), "select page as doc_id, event_id as frame, case when is_rest then 0 else 7 end as loud from notes_v")
add("audio_silence_gate", "notes_v", lambda n: audio.silence_gate(tones(n), 0.5).select("doc_id", (F.col("gate") * 1000).cast("int").alias("gate")), "select page as doc_id, case when 2 * sum(is_rest::int) > count(*) then 10 else 50 end as gate from notes_v group by page")
add("audio_frame_notes", "notes_v", lambda n: audio.frame_notes(track(n)), """with s as (select page, midi, is_rest, dur // 6 as n, sum(dur // 6) over (partition by page order by event_id) - dur // 6 as start from notes_v),
f as (select page, cast(start + unnest(generate_series(0, n - 1)) as bigint) as frame, 60 + midi % 2 as midi, is_rest from s),
a as (select *, coalesce((midi <> lag(midi) over w or frame <> lag(frame) over w + 1)::int, 1) as new from f where not is_rest window w as (partition by page order by frame)),
b as (select *, sum(new) over (partition by page order by frame) as run from a),
c as (select page, midi, run, min(frame) as first, max(frame) as last, count(*) as n from b group by page, midi, run),
d as (select *, sum(far) over (partition by page order by first) as chain from (select *, coalesce((midi <> lag(midi) over o or first - lag(last) over o - 1 > 2)::int, 1) as far from c window o as (partition by page order by first))),
e as (select *, (row_number() over (partition by page, chain order by first) - 1) // 2 as note from d)
select page as doc_id, midi, min(first) as start, max(last) as stop, cast(sum(n) as bigint) as frames, 440.0::double as hz, 1.0::double as clarity from e group by page, midi, chain, note having max(last) - min(first) + 1 >= 3""")
