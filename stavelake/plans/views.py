"""The score tables as views over `events`, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "notes_v": """select event_id, cast(user_id as int) as page,
  cast(event_id % 2 as int) + 1 as staff, cast(cast(floor(event_id / 2) as bigint) % 2 as int) + 1 as voice,
  cast(day(ts) as int) as measure, cast(floor((day(ts) - 1) / 5) as int) + 1 as system,
  cast(floor(hour(ts) / 3) as int) * 12 as onset,
  case k % 8 when 0 then 6 when 1 then 12 when 2 then 18 when 3 then 24 when 4 then 36 when 5 then 48 when 6 then 72 else 96 end as dur,
  event_type = 'error' as is_rest, event_id % 7 = 0 as is_chord, 12 + k as midi,
  substr('CCDDEFFGGAAB', (12 + k) % 12 + 1, 1) as step,
  case when (12 + k) % 12 in (1, 3, 6, 8, 10) then 1 else 0 end as alter_, cast(floor((12 + k) / 12) as int) - 1 as octave
from (select event_id, user_id, ts, event_type, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) b""",
    "measures_v": """select p.page, m.measure, cast(floor((m.measure - 1) / 5) as int) + 1 as system,
  case when (p.page + cast(floor((m.measure - 1) / 5) as int) + 1) % 5 = 0 then 3 else 4 end as beats, 4 as beat_type
from (select distinct page from {notes_v}) p cross join (select distinct measure from {notes_v}) m""",
    "clefs_v": """select distinct m.page, m.system, s.staff,
  case when s.staff = 2 and (m.page + m.system) % 7 <> 0 then 'F' else 'G' end as sign,
  case when s.staff = 2 and (m.page + m.system) % 7 <> 0 then 4 else 2 end as line
from {measures_v} m cross join (select distinct staff from {notes_v}) s""",
    "runs_v": """select 'A' as run, event_id, page, staff, voice, measure, onset, dur, is_rest, is_chord, midi from {notes_v}
union all select 'B', event_id, page, staff, voice, measure, onset, dur, is_rest, is_chord,
  midi + case when event_id % 13 = 0 then 1 else 0 end from {notes_v} where event_id % 11 <> 0""",
    "layout_v": """select page, system, cast(count(distinct staff) as int) as n_staves_read, 2 as n_staves_detected
from {notes_v} where not is_rest group by page, system""",
    "staves_v": """select page, system, row_ as staff, case when row_ = 1 or (page + system) % 3 = 0 then null else 1 end as brace,
  case when row_ in (2, 4) and (page + system) % 4 <> 0 then 'F' else 'G' end as sign, case when row_ in (2, 4) and (page + system) % 4 <> 0 then 4 else 2 end as line
from (select distinct page, system, (staff - 1) * 2 + voice as row_ from {notes_v}) s""",
    "fragments_v": """select event_id, page, system, (staff - 1) * 2 + voice as staff, measure - (system - 1) * 5 as measure, onset, dur, is_rest, midi from {notes_v}""",
    "lines_v": """select page, cast(y as double) as y, min(x0) as x0, max(x1) as x1, 2 as th
from (select page, system * 400 + (staff - 1) * 100 + event_id % 5 * 10 as y, onset as x0, 900 + dur as x1 from {notes_v}) l group by page, y""",
    "pieces_v": """select page, cast(system * 400 + (staff - 1) * 100 + event_id % 5 * 10 + event_id % 3 * 2 as double) as y, onset * 10 as x0, onset * 10 + dur as x1, 2 as th from {notes_v}""",
    "rules_v": """select distinct page, 20 + onset as x, cast(system * 400 as double) as top, cast(system * 400 + case when dur > 48 then 140 else 40 end as double) as bottom from {notes_v} where dur > 36""",
    "slim_notes_v": """select event_id, page, cast(floor((measure - 1) / 2) as int) + 1 as system, staff, voice, measure, onset, dur, is_rest, is_chord, midi from {notes_v}""",
    "slim_measures_v": """select page, measure, cast(floor((measure - 1) / 2) as int) + 1 as system, case when page % 4 = 0 then null when (page + measure) % 11 = 0 then 3 else 4 end as beats,
  case when page % 4 = 0 then null else 4 end as beat_type from {measures_v}""",
    "slim_clefs_v": """select page, system, 1 as staff, case when (page + system) % 6 <> 0 then 'G' end as sign, 2 as line from (select distinct page, system from {slim_measures_v}) a where page % 3 <> 0 or system % 5 <> 3
union all select page, system, 2, case when (page * system) % 7 = 0 then 'G' else 'F' end, case when (page * system) % 7 = 0 then 2 else 4 end from (select distinct page, system from {slim_measures_v}) b where page % 3 <> 0 or system % 5 <> 3""",
}
NEEDS = {"notes_v": ["events"], "measures_v": ["notes_v"], "clefs_v": ["notes_v", "measures_v"], "runs_v": ["notes_v"], "layout_v": ["notes_v"], "staves_v": ["notes_v"], "fragments_v": ["notes_v"], "lines_v": ["notes_v"], "pieces_v": ["notes_v"], "rules_v": ["notes_v"], "slim_notes_v": ["notes_v"], "slim_measures_v": ["measures_v"], "slim_clefs_v": ["slim_measures_v"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


def with_views(sql: str) -> str:
    """The query after all views, for DuckDB."""
    names = {n: n for n in [*VIEWS, "events"]}
    return "with " + ",\n".join(f"{n} as ({q.format(**names)})" for n, q in VIEWS.items()) + ",\n" + sql.strip().removeprefix("with ") if sql.strip().startswith("with ") else "with " + ",\n".join(f"{n} as ({q.format(**names)})" for n, q in VIEWS.items()) + "\n" + sql
