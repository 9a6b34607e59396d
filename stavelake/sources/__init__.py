"""Readers of score corpora and writers of reports. Files go through Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import io
import wave
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import EVENT, OF_NOTE, event_fields

CLEFS = pa.list_(pa.struct([("staff", pa.int32()), ("sign", pa.string()), ("line", pa.int32())]))
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
#: Events that go to Spark together; a document is not divided.
BATCH_ROWS = 4096
ARROW = pa.schema([(n, pa.list_(pa.string()) if n == "children" else KINDS.get(kind, CLEFS)) for n, kind in (c.split() for c in EVENT.replace("\n", " ").split(", "))])


def shred(doc_id: str, content: bytes, inside: bool = True) -> list[dict]:
    """Ordered event rows of one document; one row with `error` if it does not parse. Without `inside`, only attributes are looked into."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return [{"doc_id": doc_id, "error": str(e)}]
    names = {p.get("id"): p.findtext("part-name") or p.findtext("part-abbreviation") for p in root.iter("score-part")}
    out = []
    for i, part in enumerate(root.findall("part")):
        own = part.get("id")
        row = {"doc_id": doc_id, "part_idx": i, "part_id": own, "part_name": names.get(own) or f"Staff {i + 1}", "declared": own in names}
        for k, measure in enumerate(part.findall("measure")):
            row |= {"measure_ord": k, "measure_label": measure.get("number")}
            for seq, e in enumerate(measure):
                fields = event_fields(e) if inside or e.tag == "attributes" else {}
                out.append({**row, "seq": seq, "tag": e.tag, **fields})
    return out


def _shredded(rows: DataFrame, stem: bool, columns: str | None = None) -> DataFrame:
    """Raw events of (name, content) rows; `stem` takes the document's name from a path."""
    wanted = [c.split()[0] for c in columns.split(", ")] if columns else ARROW.names
    schema, inside = pa.schema([ARROW.field(c) for c in wanted]), not OF_NOTE.isdisjoint(wanted)
    kinds = dict(c.split() for c in EVENT.replace("\n", " ").split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for doc, content in zip(b.column("name").to_pylist(), b.column("content")):
                rows += shred(doc.rsplit("/", 1)[-1].rsplit(".", 1)[0] if stem else doc, content.as_py(), inside)
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def read_scores(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Raw events of all MusicXML files under a path, in document order within each measure.

    Files are read in steps, so one of any size will do; large ones are tasks of their own, small ones share tasks.
    columns: a schema string with the columns that are wanted; nothing else is made.
    """
    from . import files

    files.register(spark)
    reader = spark.read.format("scores")
    return (reader.schema(columns) if columns else reader).load(path)


def stream_scores(spark: SparkSession, path: str, columns: str | None = None, settle_seconds: float = 1) -> DataFrame:
    """`read_scores` as a stream of the files that come in."""
    from . import files

    files.register(spark)
    reader = spark.readStream.format("scores").option("settleSeconds", str(settle_seconds))
    return (reader.schema(columns) if columns else reader).load(path)


def read_stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """Raw events of files in a store that only Spark reads; each file is held whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _shredded(files.select(F.col("path").alias("name"), "content"), True)


def shred_texts(texts: DataFrame, columns: str | None = None) -> DataFrame:
    """Raw events of MusicXML texts in rows of (doc_id, text); `columns` as for `read_scores`, by names alone."""
    return _shredded(texts.select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content")), False, columns)


FACTS = "doc_id string, root string, parts int, notes int, part_list boolean, empty_parts array<string>, prefixes array<string>, error string"


def document_facts(texts: DataFrame) -> DataFrame:
    """One row for each text of (doc_id, text), with what the document says of itself; a null text is an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from .files import score_facts

    arrow = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"doc_id": doc} | score_facts((text or "").encode()) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FACTS)


def read_manifest(spark: SparkSession, path: str, status: str = "ok") -> DataFrame:
    return spark.read.json(path, multiLine=True).where(F.col("status") == status)


def read_journal(spark: SparkSession, path: str, schema: str = "stem string, system int, ok boolean, secs double") -> DataFrame:
    """Lines of a run journal; malformed ones are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("stem is not null")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Counts of detected staves and systems of each page, from records that name their page; one that does not parse has no row."""
    return spark.read.schema("page int, n_staves int, n_systems int").json(path, multiLine=True, mode="DROPMALFORMED").where("page is not null")


STAFF_BOX = "array<struct<y_top:double, y_bot:double, y_center:double, x0:int, x1:int, n_lines:int, spacing:double, spread:double, resid:double, width:int>>"
LAYOUT = f"n_staves int, n_systems int, grouping array<int>, staff_space double, staves {STAFF_BOX}, broken string"


def read_boxes(spark: SparkSession, path: str, nested: str = "homr") -> DataFrame:
    """(folder, page, n_staves, n_systems, grouping, staff_space, staves) of each page's layout record `<page>.boxes.json`.

    A record lies in a book's folder or in that folder's own folder `nested`; the first place that has one counts, even if
    that one does not parse. A page without a readable record has no row, which is no claim that it has no staves.
    """
    reader = spark.read.schema(LAYOUT).options(recursiveFileLookup="true", pathGlobFilter="*.boxes.json")
    rows = reader.json(path, multiLine=True, columnNameOfCorruptRecord="broken").select("*", F.col("_metadata.file_path").alias("file"))
    inner = f"/{nested}/[^/]*$"
    rows = rows.select(
        F.regexp_replace(F.regexp_replace("file", inner, "/"), "/[^/]*$", "").alias("folder"), F.regexp_extract("file", r"([^/]*)\.boxes\.json$", 1).alias("page"),
        "n_staves", "n_systems", "grouping", "staff_space", "staves", "broken", F.col("file").rlike(inner).alias("place"),
    )
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("folder", "page").orderBy("place"))).where("nth = 1")
    return first.where("broken is null").drop("broken", "place", "nth")


def layout_staves(layout: DataFrame) -> DataFrame:
    """One row for each detected staff, from top to bottom."""
    return layout.select("folder", "page", F.posexplode("staves").alias("staff", "box")).select("folder", "page", (F.col("staff") + 1).alias("staff"), "box.*")


def layout_counts(layout: DataFrame, what: str = "n_staves") -> DataFrame:
    """(page, n) for the coverage check; pages whose record names no count make no claim."""
    return layout.where(F.col(what).isNotNull()).select("page", F.col(what).alias("n"))


def read_symbol_logs(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of logs that have one on each line, read from the right: four last fields are fixed, the pitch before them may be absent."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 5)
    at = lambda k: F.element_at("f", -k)
    pitch = F.when(F.size("f") >= 6, at(5))
    return lines.select("file", F.element_at("f", 1).alias("symbol"), pitch.alias("pitch"), at(4).alias("lift"), at(3).alias("articulation"), at(2).alias("slur"), at(1).alias("position"))


def read_recogniser_logs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n, symbol, ...): symbols of whole recogniser logs, between their marks, in the order they were printed."""
    from . import files

    files.register(spark)
    return spark.read.format("symbol_logs").load(path)


def stream_recogniser_logs(spark: SparkSession, path: str, settle_seconds: float = 1) -> DataFrame:
    """`read_recogniser_logs` as a stream of the logs that come in."""
    from . import files

    files.register(spark)
    return spark.readStream.format("symbol_logs").option("settleSeconds", str(settle_seconds)).load(path)


def read_song_index(spark: SparkSession, path: str) -> DataFrame:
    """(title, place, page) of a JSON list of songs with their pages in order."""
    return spark.read.schema("title string, pages array<int>").json(path, multiLine=True).select("title", F.posexplode("pages").alias("place", "page"))


def read_verdicts(spark: SparkSession, path: str, inputs: DataFrame) -> DataFrame:
    """One verdict for each input; absent and unreadable ones, and several that differ, are errors."""
    found = spark.read.schema("name string, verdict string").json(path, mode="DROPMALFORMED").where("name is not null").groupBy("name").agg(F.when(F.countDistinct("verdict") == 1, F.min("verdict")).alias("verdict"))
    return inputs.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("verdict", F.lit("error")).alias("verdict"))


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").load(path).select("image.*")


def read_audio_frames(spark: SparkSession, path: str, window: int = 2048, hop: int = 512) -> DataFrame:
    """Frames of 16-bit WAV files, channels averaged, from -1 to 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, content in zip(f["path"], f["content"]):
                with wave.open(io.BytesIO(bytes(content))) as w:
                    rate, channels = w.getframerate(), w.getnchannels()
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, channels).mean(1) / 32768
                starts = range(0, max(0, len(x) - window) + 1, hop) if len(x) >= window else []
                yield pd.DataFrame([(doc, i, s / rate, rate, x[s : s + window].tolist()) for i, s in enumerate(starts)], columns=["doc_id", "frame", "t", "rate", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "doc_id string, frame int, t double, rate int, samples array<double>")


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """Pages of a spec such as `3-8,16,20-22`."""
    keep = F.lit(False)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        keep = keep | F.col("page").between(int(lo), int(hi or lo))
    return pages.where(keep)


def write_report(found: DataFrame, path: str) -> None:
    found.write.mode("errorifexists").partitionBy("check").json(path)


def song_index(songs: DataFrame) -> DataFrame:
    from ..functions import slug

    return songs.groupBy("title").agg(F.countDistinct("part").alias("parts"), F.countDistinct("measure").alias("measures"), F.count("*").alias("notes")).withColumn("slug", slug("title"))


def pending(work: DataFrame, journal: DataFrame, key: str = "stem", retry_failed: bool = True) -> DataFrame:
    """Work whose key the journal does not have as done; failed keys come again unless `retry_failed` is off, as in the stream."""
    done = journal.where("ok") if retry_failed else journal
    return work.join(done.select(key), key, "left_anti")


def join_gate(manifest: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Pages that may be joined; refuses if any would be dropped, unless a partial join is allowed."""
    lost = manifest.where("status <> 'ok'").agg(F.count("*").alias("pages"), F.coalesce(F.sum("notes"), F.lit(0)).alias("notes")).first()
    if lost["pages"] and not allow_partial:
        raise ValueError(f"{lost['pages']} pages and {lost['notes']} notes would be lost")
    return manifest.where("status = 'ok'")


def event_order(raw: DataFrame) -> DataFrame:
    """Number of each event in its part."""
    return raw.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "part_idx").orderBy("measure_ord", "seq")))
