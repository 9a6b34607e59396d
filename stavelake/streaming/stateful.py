"""Streams with typed state and event-time timers: notes of a live track, audits of arriving pages, sampled traces.

They keep state in RocksDB: call `use_state_store` once in a session before a query is started.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import audit

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Let queries that start from now on keep their state in RocksDB, as typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# ---------------------------------------------------------------- notes of a live track

NOTE = "source string, midi int, start long, stop long, frames long, clarity double"


class NoteFollower(StatefulProcessor):
    """Notes of one source's frames, in order of frame number however the frames come in.

    waiting: voiced frames that the watermark has not passed, so that others may still come in before them; note: the note
    that sounds. A timer is set for whatever comes next: the first waiting frame, or the end of the gap after the note.
    """

    def __init__(self, hop_ms: int, most_gap: int, least: int) -> None:
        self.hop_ms, self.most_gap, self.least = hop_ms, most_gap, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.note = handle.getValueState("note", "midi int, start long, stop long, frames long, clarity double, absorbed boolean, ms long")
        self.waiting = handle.getListState("waiting", "frame long, ms long, midi int, clarity double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["midi"].notna()]
        ms = new["ts"].dt.tz_localize(None).astype("datetime64[ms]").astype("int64")
        found = zip(new["frame"].astype(int).tolist(), ms.tolist(), new["midi"].astype(int).tolist(), new["clarity"].astype(float).tolist())
        if found := [f for f in found if f[1] > timerValues.getCurrentWatermarkInMs()]:
            self.waiting.appendList(found)
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key: tuple, passed: int) -> pd.DataFrame:
        """Follow the frames that the watermark has passed; give the notes that have ended."""
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        note, out = list(self.note.get()) if self.note.exists() else None, []

        def ended(note: list) -> None:
            if note[2] - note[1] + 1 >= self.least:
                out.append((key[0], note[0], note[1], note[2], note[3], note[4] / note[3]))

        left = [w for w in waiting if w[1] > passed]
        for frame, ms, midi, clarity in (w for w in waiting if w[1] <= passed):
            gap = frame - note[2] - 1 if note else 0
            if note and midi == note[0] and (gap == 0 or gap <= self.most_gap and not note[5]):
                note = [midi, note[1], frame, note[3] + 1, note[4] + clarity, note[5] or gap > 0, ms]
            else:
                if note:
                    ended(note)
                note = [midi, frame, frame, 1, clarity, False, ms]
        if note and note[6] + self._gap_ms() <= passed:
            ended(note)
            note = None
        self._keep(note, left)
        return pd.DataFrame(out, columns=["source", "midi", "start", "stop", "frames", "clarity"])

    def _gap_ms(self) -> int:
        """How long after its last frame nothing can join a note any more."""
        return (self.most_gap + 1) * self.hop_ms

    def _keep(self, note: list | None, left: list[tuple]) -> None:
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if note:
            self.note.update(tuple(note))
        else:
            self.note.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [w[1] for w in left] + ([note[6] + self._gap_ms()] if note else [])
        if due:
            self.handle.registerTimer(min(due))

    def close(self) -> None:
        return None


def follow_notes(frames: DataFrame, hop_ms: int, most_gap: int = 2, least: int = 3, late: str = "1 second") -> DataFrame:
    """Notes of a stream of frames (source, frame, ts, midi, clarity), as `audio.frame_notes` finds them in a table.

    ts is the time of the frame, `hop_ms` from one to the next; a null pitch is silence. A note is given out when a frame
    of another note comes, or when the watermark is past the gap that it could still absorb: no further frame is needed.
    Nothing of a source is kept after its last note. Frames may come in any order; those that the watermark has
    passed are left out.
    """
    rows = frames.select("source", "frame", "ts", "midi", "clarity").withWatermark("ts", late)
    return rows.groupBy("source").transformWithStateInPandas(NoteFollower(hop_ms, most_gap, least), NOTE, "Append", "EventTime")


# ---------------------------------------------------------------- sampled traces


class TraceCounter(StatefulProcessor):
    """Counts the hits of one label. A label that rests for longer than the time to live starts anew."""

    def __init__(self, skip: int, times: int, ttl_ms: int | None) -> None:
        self.skip, self.times, self.ttl_ms = skip, times, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        own = pd.concat([f[["event_id"]] for f in rows]).sort_values("event_id", ignore_index=True)
        self.seen.update((before + len(own),))
        own["event_type"], own["hit"] = key[0], range(before + 1, before + len(own) + 1)
        yield own[(own["hit"] > self.skip) & (own["hit"] <= self.skip + self.times)]

    def close(self) -> None:
        return None


def sample_trace_with_ttl(events: DataFrame, labels: list[str], match: str, skip: int, times: int, ttl_ms: int | None = None) -> DataFrame:
    """As `sample_trace_stream`, with one number of typed state for each label, which goes after `ttl_ms` without a hit.

    With a time to live the query looks at its state again and again, so it does not end by itself under `availableNow`.
    """
    from . import armed

    rows = events.where(armed(labels) & F.col("props").contains(match)).select("event_id", "event_type")
    mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("event_type").transformWithStateInPandas(TraceCounter(skip, times, ttl_ms), "event_id long, event_type string, hit int", "Append", mode)


# ---------------------------------------------------------------- audits of arriving pages

NOTE_COLUMNS = "event_id long, system int, staff int, voice int, measure int, onset int, dur int, is_rest boolean, is_chord boolean, midi int, step string, octave int"
OWN = {"note": [c.split()[0] for c in NOTE_COLUMNS.split(", ")], "measure": ["measure", "system", "beats", "beat_type"], "clef": ["system", "staff", "sign", "line"]}
ROW = f"page long, kind string, ts timestamp, {NOTE_COLUMNS}, beats int, beat_type int, sign string, line int"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
#: pandas holds whole numbers beside nulls as floats.
MAKE = [{"int": int, "long": int, "boolean": bool}.get(c.split()[1], lambda v: v) for c in ROW.split(", ")[1:]]


class PageKeeper(StatefulProcessor):
    """All rows of one page so far, given out whole whenever some come in, until the page has rested for `rest_ms`."""

    def __init__(self, rest_ms: int) -> None:
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ", ".join(c for c in ROW.split(", ")[1:]))
        self.visit = handle.getValueState("visit", "since long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[COLUMNS[1:]]
        ms = new["ts"].dt.tz_localize(None).astype("datetime64[ms]").astype("int64")
        late = ms <= timerValues.getCurrentWatermarkInMs()
        if late.any():
            said = new[late].assign(kind="late")
            said.insert(0, "visit", None)
            said.insert(0, "page", key[0])
            yield said
            new, ms = new[~late], ms[~late]
        if not len(new):
            return
        since, last = self.visit.get() if self.visit.exists() else (int(ms.min()), 0)
        last = max(last, int(ms.max()))
        self.visit.update((since, last))
        self.rows.appendList([tuple(None if pd.isna(v) else make(v) for v, make in zip(r, MAKE)) for r in new.astype(object).itertuples(index=False)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.rest_ms)
        whole = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=COLUMNS[1:])
        whole.insert(0, "visit", since)
        whole.insert(0, "page", key[0])
        yield whole

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.visit.clear()
        yield pd.DataFrame(columns=["page", "visit", *COLUMNS[1:]])

    def close(self) -> None:
        return None


def page_rows(**streams: DataFrame) -> DataFrame:
    """Streams of notes, measures and clefs (each with page and ts) as one stream of tagged rows."""
    kinds = {k: t for k, t in (c.split() for c in ROW.split(", "))}
    out = None
    for kind, df in streams.items():
        own = {"page", "ts", *OWN[kind]}
        rows = df.select(*[F.lit(kind).alias("kind") if c == "kind" else (F.col(c) if c in own else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])
        out = rows if out is None else out.unionByName(rows)
    return out


def arriving_pages(rows: DataFrame, late: str = "1 hour", rest_ms: int = 3_600_000) -> DataFrame:
    """For each page with new rows, all its rows so far, from a stream of `page_rows`.

    A page is forgotten when the watermark is `rest_ms` past its newest row; what comes after that is a new visit, a page by
    itself. Rows that the watermark has passed are in no page: they come out with the kind `late` and no visit.
    """
    return rows.withWatermark("ts", late).groupBy("page").transformWithStateInPandas(PageKeeper(rest_ms), ROW.replace("page long,", "page long, visit long,"), "Update", "EventTime")


def audit_pages(pages: DataFrame, batch_id: int, path: str) -> None:
    """Audit the pages of a batch and write how many findings each has of each check; a batch that is run again writes the same
    folder anew. A page without findings has one row with a null check, as it may have had some before. Rows that came late
    are a row `late` with their number."""
    pages = pages.persist()
    key = F.concat_ws("@", "page", "visit")
    part = lambda kind: pages.where(F.col("kind") == kind).select(key.alias("page"), *OWN[kind])
    found = audit.flags(part("note"), part("measure"), part("clef").where("staff is not null")).groupBy("page", "check").agg(F.count("*").alias("n"))
    every = pages.where("kind <> 'late'").select(key.alias("page")).distinct().join(found, "page", "left")
    late = pages.where("kind = 'late'").groupBy(F.col("page").cast("string").alias("page")).agg(F.lit("late").alias("check"), F.count("*").alias("n"))
    every.select("page", "check", "n").unionByName(late).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    pages.unpersist()


def audit_stream(rows: DataFrame, path: str, checkpoint: str, late: str = "1 hour", rest_ms: int = 3_600_000):
    """Keep the findings of arriving pages under `path`, updated with every batch; `page_tally` reads them."""
    pages = arriving_pages(rows, late, rest_ms)
    return pages.writeStream.outputMode("update").foreachBatch(lambda batch, n: audit_pages(batch, n, path)).option("checkpointLocation", checkpoint)


def late_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, n): how many rows of which pages came too late to be audited."""
    rows = spark.read.schema("page string, check string, n long, batch long").parquet(path)
    return rows.where("check = 'late'").groupBy("page").agg(F.sum("n").alias("n"))


def page_tally(spark: SparkSession, path: str) -> DataFrame:
    """(check, n, pages) over what each page's newest batch found, as `audit.tally` gives it for whole tables."""
    rows = spark.read.schema("page string, check string, n long, batch long").parquet(path)
    rows = rows.where("check is null or check <> 'late'")
    newest = rows.withColumn("newest", F.max("batch").over(Window.partitionBy("page"))).where("batch = newest and check is not null")
    return newest.groupBy("check").agg(F.sum("n").alias("n"), F.countDistinct("page").alias("pages")).orderBy(F.desc("n"), "check")
