"""Streams: running tallies, live pitch, journals that skip finished work, and sampled traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .. import functions as N


def running_tally(events: DataFrame, by: str = "event_type", ts: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts in event-time windows; events later than `late` behind the newest one are left out."""
    counts = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def running_tally_batch(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def live_pitch(blocks: DataFrame, least: float = 0.05, low: float = 80, high: float = 1500, clear: float = 4) -> DataFrame:
    """Note name of each block (amplitude, peak_hz, peak, mean) that passes all three guards; stateless."""
    sure = (F.col("amplitude") >= least) & F.col("peak_hz").between(low, high) & (F.col("peak") >= clear * F.col("mean"))
    return blocks.where(sure).withColumn("note", N.midi_name(N.hz_to_midi("peak_hz")))


def note_sessions(frames: DataFrame, ts: str = "ts", gap: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """Notes as sessions of frames of one pitch."""
    voiced = frames.where("midi is not null").withWatermark(ts, late)
    return voiced.groupBy(F.session_window(ts, gap).alias("w"), "source", "midi").agg(F.count("*").alias("frames")).select("source", "midi", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def journal_batch(batch: DataFrame, batch_id: int, process: Callable[[DataFrame], DataFrame], path: str, schema: str, key: str = "stem") -> None:
    """Process the keys of a batch that no other batch has in the journal; the outcomes are the batch's own folder.

    A batch that is run again writes the same folder anew, so an outcome is there once. Of rows with one key the least
    one is taken. `schema` is that of the journal's lines.
    """
    spark = batch.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").json(f"{path}/batch=-1")
    done = spark.read.schema(f"{schema}, batch long").json(path).where(F.col("batch") != batch_id)
    rest = [c for c in batch.columns if c != key]
    rows = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else batch.select(key).distinct()
    process(rows.join(done.select(key), key, "left_anti")).write.mode("overwrite").json(f"{path}/batch={batch_id}")


def journal_stream(work: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, schema: str = "stem string, ok boolean", key: str = "stem"):
    """`journal_batch` for every batch of a stream; the checkpoint makes it resumable."""
    return work.writeStream.foreachBatch(lambda batch, n: journal_batch(batch, n, process, path, schema, key)).option("checkpointLocation", checkpoint)


def armed(labels: list[str]) -> Column:
    """Whether an event is of one of these labels; a trailing * matches any rest."""
    out = F.lit(False)
    for x in labels:
        out = out | (F.col("event_type").startswith(x[:-1]) if x.endswith("*") else F.col("event_type") == x)
    return out


def sample_trace(events: DataFrame, labels: list[str], match: str, skip: int, times: int) -> DataFrame:
    """Hits of labels (a trailing * matches any rest) whose properties hold `match`: after `skip`, at most `times` per label."""
    hits = events.where(armed(labels) & F.col("props").contains(match)).withColumn("hit", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    return hits.where((F.col("hit") > skip) & (F.col("hit") <= skip + times)).select("event_id", "event_type", "hit")


def sample_trace_stream(events: DataFrame, labels: list[str], match: str, skip: int, times: int) -> DataFrame:
    """As `sample_trace` on a stream: a counter for each label is kept as state, and hits count in order of arrival.

    Within a batch hits are taken in order of event_id. A label whose hits are over keeps one number and nothing else.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        own = pd.concat([f[["event_id"]] for f in frames]).sort_values("event_id", ignore_index=True)
        state.update((seen + len(own),))
        own["event_type"], own["hit"] = key[0], range(seen + 1, seen + len(own) + 1)
        yield own[(own["hit"] > skip) & (own["hit"] <= skip + times)]

    rows = events.where(armed(labels) & F.col("props").contains(match)).select("event_id", "event_type")
    return rows.groupBy("event_type").applyInPandasWithState(count, "event_id long, event_type string, hit int", "seen long", "append", "NoTimeout")


def note_runs(frames: DataFrame, hop: float, least: float, gap: float) -> DataFrame:
    """(source, midi, start, end, frames): notes of a stream of frames (source, t, midi), as their pitch is followed live.

    A note goes on through frames of its own pitch and through silences of at most `gap` seconds; another pitch ends it,
    and a silence that is longer. Notes shorter than `least` seconds are dropped. The note that sounds last stays in the
    state until something ends it. Frames of a source come in order of t; a null pitch is silence.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        midi, start, end, n = state.get if state.exists else (-1, 0.0, 0.0, 0)
        out = []

        def close() -> None:
            if midi >= 0 and end - start >= least - 1e-9:
                out.append((key[0], midi, start, end, n))

        rows = pd.concat([b[["t", "midi"]] for b in batches]).sort_values("t")
        for t, pitch in zip(rows["t"].tolist(), rows["midi"].tolist()):
            if pitch is None or pitch != pitch:
                if midi >= 0 and t - end > gap + 1e-9:
                    close()
                    midi = -1
            elif int(pitch) == midi and t - end <= gap + 1e-9:
                end, n = t + hop, n + 1
            else:
                close()
                midi, start, end, n = int(pitch), t, t + hop, 1
        state.update((midi, start, end, n))
        yield pd.DataFrame(out, columns=["source", "midi", "start", "end", "frames"])

    return frames.groupBy("source").applyInPandasWithState(follow, "source string, midi int, start double, end double, frames int", "midi int, start double, end double, frames int", "append", "NoTimeout")
