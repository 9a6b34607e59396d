"""Pitch and level of audio frames, many at once in numpy. Frames have (doc_id, frame, t, rate, samples); gates are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as N
from .audit import long

# Bounds of the silence gate and what it is without a noise floor.
GATE_LEAST, GATE_MOST, GATE_DEFAULT = 0.003, 0.05, 0.01
#: Frames that are worked on at once.
SLICE = 256


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a few frames, so what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _samples(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, place at which each list starts, and the end); a null value is NaN, a null list is empty."""
    at = c.offsets.to_numpy()
    values = c.values.slice(at[0], at[-1] - at[0]) if len(at) else c.values
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False), at - at[:1]


def levels(c: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(peak, root mean square) of each list; a null value counts for no peak and leaves no level."""
    x, at = _samples(c)
    known = (at[1:] > at[:-1]).nonzero()[0]
    peak, rms, none = np.zeros(len(c)), np.zeros(len(c)), np.ones(len(c), bool)
    lost = none.copy()
    if len(known):
        start = at[:-1][known]
        null = c.values.slice(c.offsets[0].as_py(), len(x)).is_null().to_numpy(zero_copy_only=False)
        nulls = np.add.reduceat(null.astype(np.int64), start)
        peak[known] = np.maximum.reduceat(np.where(null, -np.inf, np.abs(x)), start)
        rms[known] = np.sqrt(np.add.reduceat(x * x, start) / (at[1:] - at[:-1])[known])
        none[known], lost[known] = nulls == (at[1:] - at[:-1])[known], nulls > 0
    return pa.array(peak, mask=none), pa.array(rms, mask=lost)


def signal_level(frames: DataFrame) -> DataFrame:
    """Peak and root mean square of every frame; an empty one has neither."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["frame"], *levels(b["samples"])], ["doc_id", "frame", "peak", "rms"])

    return frames.select("doc_id", "frame", "samples").mapInArrow(run, f"doc_id {kinds['doc_id']}, frame {kinds['frame']}, peak double, rms double")


def silence_gate(frames: DataFrame, share: float = 0.1) -> DataFrame:
    """(doc_id, floor, gate): three times the noise floor, which is a low percentile of the frames' levels, within bounds."""
    floor = signal_level(frames).groupBy("doc_id").agg(F.expr(f"percentile(rms, {share})").alias("floor"))
    raw = F.when(F.col("floor") > 0, 3 * F.col("floor")).otherwise(GATE_DEFAULT)
    return floor.select("doc_id", "floor", F.greatest(F.least(raw, F.lit(GATE_MOST)), F.lit(GATE_LEAST)).alias("gate"))


def tones_of(x: np.ndarray, rate: float, low: float, high: float, near: float, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hertz, clarity) of frames of one length, the rows of x, by the first high peak of the normalised square difference; NaN
    for one that has no tone."""
    hertz, clarity, size = np.full(len(x), np.nan), np.zeros(len(x)), x.shape[1]
    first, last = max(2, int(rate / high)), min(size - 1, int(rate / low))
    if size < 256 or last <= first:
        return hertz, clarity
    x = x - x.mean(1, keepdims=True)
    rows = np.flatnonzero(~(np.sqrt((x * x).mean(1)) < gate))
    x = x[rows]
    spectrum = np.fft.rfft(x, 2 * size)
    match = np.fft.irfft(spectrum * spectrum.conj())[:, : last + 1]
    energy = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, 1)], 1)
    lags = np.arange(last + 1)
    curve = 2 * match / np.maximum(energy[:, size - lags] + energy[:, -1:] - energy[:, lags], 1e-12)
    mid = curve[:, first + 1 : last]
    tops = (mid > curve[:, first : last - 1]) & (mid >= curve[:, first + 2 : last + 1])
    best = np.where(tops, mid, -np.inf).max(1, initial=-np.inf)
    found = np.flatnonzero(best > 0)
    top = first + 1 + (tops[found] & (mid[found] >= near * best[found, None])).argmax(1) if len(found) else np.zeros(0, int)
    left, centre, right = (curve[found, top + k] for k in (-1, 0, 1))
    bend = left - 2 * centre + right
    got = rate / (top + np.divide(0.5 * (left - right), bend, out=np.zeros(len(bend)), where=bend != 0))
    ok = (low <= got) & (got <= high)
    hertz[rows[found[ok]]], clarity[rows[found[ok]]] = got[ok], centre[ok]
    return hertz, clarity


def tone(x: np.ndarray, rate: float, low: float, high: float, near: float, gate: float) -> tuple[float | None, float]:
    """(hertz, clarity) of one frame; null if it has no tone."""
    hertz, clarity = tones_of(np.asarray(x, float)[None], rate, low, high, near, np.array([gate]))
    return (None if np.isnan(hertz[0]) else float(hertz[0])), float(clarity[0])


def frame_pitch(frames: DataFrame, gates: DataFrame | None = None, low: float = 65, high: float = 1400, near: float = 0.9) -> DataFrame:
    """(doc_id, frame, t, hz, clarity, midi) of every frame; hz and midi are null where it has no tone."""
    rows = frames.select("doc_id", F.col("frame").cast("long").alias("frame"), F.col("t").cast("double").alias("t"), F.col("rate").cast("double").alias("rate"), "samples")
    rows = rows.join(gates.select("doc_id", "gate"), "doc_id", "left") if gates is not None else rows.withColumn("gate", F.lit(GATE_DEFAULT))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            (x, at), hertz, clarity = _samples(b["samples"]), np.full(b.num_rows, np.nan), np.zeros(b.num_rows)
            rate, gate = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("rate", "gate"))
            alike, group = np.unique(np.stack([at[1:] - at[:-1], rate]), axis=1, return_inverse=True)
            for k, (size, r) in enumerate(alike.T):
                of = np.flatnonzero(group.ravel() == k)
                hertz[of], clarity[of] = tones_of(x[at[of][:, None] + np.arange(int(size))], r, low, high, near, gate[of])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["frame"], b["t"], pa.array(hertz, mask=np.isnan(hertz)), pa.array(clarity)], ["doc_id", "frame", "t", "hz", "clarity"])

    out = rows.na.fill(GATE_DEFAULT, ["gate"]).mapInArrow(run, f"doc_id {kind}, frame long, t double, hz double, clarity double")
    return out.withColumn("midi", F.bround(N.hz_to_midi("hz")).cast("int"))


def frame_notes(frames: DataFrame, most_gap: int = 2, least: int = 3) -> DataFrame:
    """(doc_id, midi, start, stop, frames, hz, clarity): notes of at least `least` frames from start to stop, in frame order.

    A note is a run of voiced frames of one pitch. An unvoiced gap of at most `most_gap` frames before the next run of the
    same pitch is absorbed, one gap a note: of several such runs the first takes the second, the third the fourth and so
    on. `frames` counts the voiced ones.
    """
    w = Window.partitionBy("doc_id").orderBy("frame")
    voiced = frames.where("midi is not null")
    breaks = (F.lag("midi").over(w) != F.col("midi")) | (F.lag("frame").over(w) != F.col("frame") - 1)
    runs = voiced.withColumn("new", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    one = runs.groupBy("doc_id", "run").agg(F.first("midi").alias("midi"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    order = Window.partitionBy("doc_id").orderBy("first")
    near = (F.lag("midi").over(order) == F.col("midi")) & (F.col("first") - F.lag("last").over(order) - 1 <= most_gap)
    chains = one.withColumn("far", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("chain", F.sum("far").over(order))
    place = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("first")) - 1
    notes = chains.withColumn("note", F.floor(place / 2)).select("doc_id", "run", "chain", "note")
    out = runs.join(notes, ["doc_id", "run"]).groupBy("doc_id", "midi", "chain", "note")
    rows = out.agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), long(F.count("*")).alias("frames"), F.expr("percentile(hz, 0.5)").alias("hz"), F.avg("clarity").alias("clarity"))
    return rows.where(F.col("stop") - F.col("start") + 1 >= least).drop("chain", "note")


def melody_records(notes: DataFrame, gates: DataFrame) -> DataFrame:
    """One row for each document: its gate and its notes in order of time; null notes where it has none."""
    listed = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "midi", "hz", "clarity"))).alias("notes"))
    return gates.select("doc_id", "gate").join(listed, "doc_id", "left")
