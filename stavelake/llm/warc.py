"""WARC archives: write records, normalise whole-file gzip streams to one member per record, read by offset index."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop_folder, shared_dir, stored, table

LEVEL = 3
READ = 1 << 20
ARCHIVE_BYTES = 64 << 20  # payload bytes after which a task starts another archive
MOST_BROADCAST = 100_000
ENTRY = "path string, record long, offset long, size long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, as a task sees it."""
    scheme, _, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the digest and length of its payload and none of its bytes."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + "".join(c if c >= " " else "%%%02X" % ord(c) for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:])


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class Inflated:
    """Bytes of a gzip file, inflated once from front to end, READ at a time; members may follow each other."""

    def __init__(self, source) -> None:
        self.source, self.engine, self.held = source, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        raw = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        raw = raw or self.source.read(READ)
        if not raw:
            if not self.engine.eof:
                raise ValueError("the archive is cut off")
            return False
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        self.held += self.engine.decompress(raw, READ)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held:
                    raise ValueError("the archive is cut off")
                return None
        out = bytes(self.held[: found + len(mark)])
        del self.held[: found + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def marked_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of `least` bytes or more all but the last page point to it.

    Digests are grouped with partial sums before the shuffle, so a payload that a third of the pages share is one row
    for each task. Groups of two or more come back by a broadcast if there are at most MOST_BROADCAST of them, else by a
    shuffle join, where AQE splits a hot digest.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    again = stored(again, "repeats")
    joined = rows.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, "digest", "left")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Whole-file gzip archives, one or more for each task; a row (path, records) for each that was finished.

    Names are new for every attempt of a task and only rows that Spark keeps count, so a lost executor leaves at most
    files that nothing refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        sink = engine = None
        path, n, total = "", 0, 0

        def close() -> pa.RecordBatch:
            sink.write(engine.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for part in chunks(batch, "payload"):
                for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in part.columns]):
                    if sink is None:
                        path, n, total = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink, engine = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, wbits=31)
                    sink.write(engine.compress(record(page_id, url, payload, digest, refers_to)))
                    n, total = n + 1, total + len(payload)
                    if total >= ARCHIVE_BYTES:
                        yield close()
                        sink = None
        if sink is not None:
            yield close()

    return marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate each archive once, rewrite every record as a gzip member of its own, and write the offsets beside it.

    Gives the sidecar's rows: (path, record, offset, size). Works on archives of one member, of many, or of both.
    Rows that name archives are small while archives are not, so they are dealt in turn to as many tasks as there are archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                entries, offset = [], 0
                with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(path, compression=None) as out:
                    stream = Inflated(raw)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        body = stream.exactly(int(headers(head[:-4])["Content-Length"]) + 4)
                        engine = zlib.compressobj(LEVEL, wbits=31)
                        member = engine.compress(head + body) + engine.flush()
                        out.write(member)
                        entries.append((len(entries), offset, len(member)))
                        offset += len(member)
                with fs.open_output_stream(f"{path}.idx", compression=None) as side:
                    side.write("".join(f"{r} {o} {s}\n" for r, o, s in entries).encode())
                cols = [pa.array([e[i] for e in entries], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries), pa.string()), *cols], names=["path", "record", "offset", "size"])

    return archives.repartition(max(1, archives.count())).mapInArrow(run, ENTRY)


PAGE = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row for each entry of an offset index, from its own member alone; a response's payload must fit its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        path, file = None, None
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for name, offset, size in zip(*[c.to_pylist() for c in batch.slice(at, 256).select(["path", "offset", "size"]).columns]):
                    if name != path:
                        if file:
                            file.close()
                        path, file = name, fs.open_input_file(name)
                    file.seek(offset)
                    head, _, rest = zlib.decompress(file.read(size), 31).partition(b"\r\n\r\n")
                    h = headers(head)
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = rest[: int(h["Content-Length"])] if kind == "response" else None
                    if payload is not None and sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
                    rows.append((page_of(h["WARC-Record-ID"]), payload, int(h["X-Payload-Length"]), digest, kind, page_of(h.get("WARC-Refers-To"))))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in PAGE.split(", ")])
        if file:
            file.close()

    files = index.select("path").distinct().count()
    return index.repartition(max(1, files), "path").sortWithinPartitions("path", "offset").mapInArrow(run, PAGE)


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the shared folder, normalise them, and read the records back.

    A null html is an empty payload. Of equal payloads of `least` bytes or more the rows with the largest page_id are
    responses and the others revisits; where all ids are null, all are responses. A null id among others is a revisit.
    Repeated rows give a record each, all of one id being responses or all revisits. Long payloads are written and read
    whole. Other columns are dropped. Empty tables give no archives and no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = stored(write_archives(marked_pages(pages, least), f"{folder}/raw"), "archives")
    index = stored(normalise(archives, f"{folder}/members"), "offsets")
    drop_folder(pages.sparkSession, f"{folder}/raw")  # every record is in a member by now
    return read_records(index, folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as n, sha1(b) as h from p),
g as (select *, max(page_id) over (partition by h) as last from d)
select page_id, n as payload_bytes, h as payload_digest,
  case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> last then last end as refers_to
from g
"""
