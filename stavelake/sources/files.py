"""Python data sources over folders of files: score events and recogniser symbols, in batches and as streams.

Files are read once through for their faults and once more for their rows, in steps of a fixed size, so memory follows the
largest event and not the file. Any store that pyarrow's file systems reach will do.
"""

from __future__ import annotations

import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .rows import EVENT, event_fields

STEP = 1 << 20
BATCH_ROWS = 4096
#: Spaces inside a log's opening mark.
MOST_SPACE = 1 << 16


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def steps(stream: BinaryIO) -> Iterator[bytes]:
    while piece := stream.read(STEP):
        yield piece


# ---------------------------------------------------------------- scores


class PartNames:
    """Parser target that keeps the names of a score's parts and nothing else."""

    def __init__(self) -> None:
        self.names: dict[str | None, str | None] = {}
        self._depth, self._part, self._found, self._open = 0, None, {}, None

    def start(self, tag: str, attributes: dict) -> None:
        self._depth += 1
        self._open = None
        if tag == "score-part":
            self._part, self._found = (self._depth, attributes.get("id")), {}
        elif self._part and self._depth == self._part[0] + 1 and tag in ("part-name", "part-abbreviation") and tag not in self._found:
            self._open, self._found[tag] = tag, ""

    def data(self, text: str) -> None:
        if self._open:
            self._found[self._open] += text

    def end(self, tag: str) -> None:
        self._open = None
        if self._part and self._depth == self._part[0]:
            self.names[self._part[1]] = self._found.get("part-name") or self._found.get("part-abbreviation")
            self._part = None
        self._depth -= 1

    def close(self) -> dict:
        return self.names


class ScoreFacts:
    """Parser target that keeps what a document says of itself as a whole: its root, its parts, its part list, its notes."""

    def __init__(self) -> None:
        self.facts = {"root": None, "parts": 0, "notes": 0, "part_list": False, "empty_parts": []}
        self._depth, self._part, self._bars = 0, None, 0

    def start(self, tag: str, attributes: dict) -> None:
        self._depth += 1
        if self._depth == 1:
            self.facts["root"] = tag.rsplit("}", 1)[-1]
        self.facts["parts"] += tag == "part"
        self.facts["notes"] += tag == "note"
        if self._depth == 2:
            self.facts["part_list"] |= tag == "part-list"
            self._part, self._bars = (attributes.get("id") or "" if tag == "part" else None), 0
        elif self._depth == 3:
            self._bars += tag == "measure"

    def end(self, tag: str) -> None:
        if self._depth == 2 and self._part is not None and not self._bars:
            self.facts["empty_parts"].append(self._part)
        self._depth -= 1

    def close(self) -> dict:
        return self.facts


def score_facts(content: bytes) -> dict:
    """Facts of one document; only `error` and `prefixes` if it does not parse."""
    out = {"prefixes": [p for p in ("xsi", "xlink") if f"<{p}:".encode() in content]}
    parser = ET.XMLParser(target=ScoreFacts())
    try:
        parser.feed(content)
        return out | parser.close()
    except ET.ParseError as e:
        return out | {"error": str(e)}


class MeasureEvents:
    """Parser target that builds each child of a measure by itself and gives its row when it ends.

    wanted: the columns that are asked for; where they need no look inside an event, none is built.
    """

    OUTER = {"doc_id", "part_idx", "part_id", "part_name", "measure_ord", "measure_label", "seq", "tag", "error", "declared"}

    def __init__(self, doc_id: str, names: dict, wanted: set[str]) -> None:
        self.rows: list[dict] = []
        self._names, self._inside = names, bool(wanted - self.OUTER)
        self._row, self._depth, self._builder = {"doc_id": doc_id}, 0, None
        self._in_part = self._in_measure = False
        self._part = self._measure = self._seq = -1

    def start(self, tag: str, attributes: dict) -> None:
        self._depth += 1
        if self._depth == 2:
            self._in_part = tag == "part"
            if self._in_part:
                self._part, self._measure = self._part + 1, -1
                own = attributes.get("id")
                self._row |= {"part_idx": self._part, "part_id": own, "part_name": self._names.get(own) or f"Staff {self._part + 1}", "declared": own in self._names}
        elif self._depth == 3:
            self._in_measure = self._in_part and tag == "measure"
            if self._in_measure:
                self._measure, self._seq = self._measure + 1, -1
                self._row |= {"measure_ord": self._measure, "measure_label": attributes.get("number")}
        elif self._depth == 4 and self._in_measure:
            self._seq += 1
            self._builder = ET.TreeBuilder() if self._inside else None
            if not self._inside:
                self.rows.append(self._row | {"seq": self._seq, "tag": tag})
        if self._builder:
            self._builder.start(tag, attributes)

    def data(self, text: str) -> None:
        if self._builder:
            self._builder.data(text)

    def end(self, tag: str) -> None:
        if self._builder:
            self._builder.end(tag)
            if self._depth == 4:
                element, self._builder = self._builder.close(), None
                self.rows.append(self._row | {"seq": self._seq, "tag": tag} | event_fields(element))
        self._depth -= 1

    def close(self) -> None:
        return None


def score_events(open_file, doc_id: str, wanted: set[str]) -> Iterator[dict]:
    """Event rows of one score in document order; one row with `error` if it does not parse.

    `open_file` opens the file anew. The first pass finds faults and part names, as both may come at the very end.
    """
    names = ET.XMLParser(target=PartNames())
    try:
        with open_file() as stream:
            for piece in steps(stream):
                names.feed(piece)
        known = names.close()
    except ET.ParseError as e:
        yield {"doc_id": doc_id, "error": str(e)}
        return
    target = MeasureEvents(doc_id, known, wanted)
    parser = ET.XMLParser(target=target)
    with open_file() as stream:
        for piece in steps(stream):
            parser.feed(piece)
            rows, target.rows = target.rows, []
            yield from rows
    parser.close()
    yield from target.rows


# ---------------------------------------------------------------- symbol logs

SYMBOL = "doc_id string, n long, symbol string, pitch string, lift string, articulation string, slur string, position string"
MARK = re.compile(rb"Writing XML\s*\[\[")


def symbol_span(stream: BinaryIO) -> tuple[int, int] | None:
    """Byte range of a log's symbols: after the first opening mark, up to the last closing one behind it."""
    start = end = None
    tail, at = b"", 0  # tail: bytes before `at` that may belong to a mark not yet whole
    for piece in steps(stream):
        text, base = tail + piece, at - len(tail)
        at += len(piece)
        if start is None and (m := MARK.search(text)):
            start = base + m.end()
        if start is not None and (k := text.rfind(b"]]")) >= 0 and base + k >= start:
            end = base + k
        keep = text.rfind(b"Writing XML") if start is None else -1
        open_mark = keep >= 0 and not text[keep + 11 :].strip(b" \t\r\n\v\f[")  # spaces may go on in the next piece
        tail = text[keep:] if open_mark and len(text) - keep < MOST_SPACE else text[-11:]
    return None if start is None or end is None else (start, end)


def symbols(open_file, doc_id: str, wanted: set[str]) -> Iterator[dict]:
    """Symbols of one log, read from the right: four fixed fields, and before them the symbol and perhaps its pitch (else `_`).

    Pieces with fewer than five fields are left out. A log without the marks has no symbols. Bytes that are no UTF-8 show as
    replacement signs.
    """
    with open_file() as stream:
        span = symbol_span(stream)
    if span is None:
        return
    n = 0

    def row(piece: bytes) -> dict | None:
        f = piece.decode("utf-8", "replace").split()
        if len(f) < 5:
            return None
        head = f[:-4]
        return {"doc_id": doc_id, "symbol": head[0], "pitch": head[1] if len(head) > 1 else "_", "lift": f[-4], "articulation": f[-3], "slur": f[-2], "position": f[-1]}

    with open_file() as stream:
        stream.seek(span[0])
        left, rest = span[1] - span[0], b""
        while left > 0 and (piece := stream.read(min(STEP, left))):
            left -= len(piece)
            *whole, rest = (rest + piece).split(b",")
            for x in whole:
                if found := row(x):
                    yield found | {"n": n}
                    n += 1
        if found := row(rest):
            yield found | {"n": n}


# ---------------------------------------------------------------- the sources


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    paths: list[str]


def listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Files under a path, or the one file that it is; hidden ones and those in hidden folders are left out."""
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    top = store.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    hidden = lambda f: not top.is_file and any(x[:1] in "._" for x in f.path.removeprefix(root.rstrip("/")).strip("/").split("/"))
    return store, sorted((f for f in found if not hidden(f)), key=lambda f: f.path)


def dealt(files: list[fs.FileInfo], most: int) -> list[Files]:
    """Partitions of about `most` bytes; a larger file is one by itself. Largest first, so that it does not start last."""
    large = sorted((f for f in files if f.size >= most), key=lambda f: -f.size)
    out, size = [Files([f.path]) for f in large], most
    small = [f for f in files if f.size < most]
    for f in small:
        if size + f.size > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size
    return out


class _Reading:
    """What batch and stream readers share: options, and rows of a partition as record batches of the asked columns."""

    def __init__(self, options: dict, schema: StructType, rows) -> None:
        if "path" not in options:
            raise ValueError("give a path to load")
        self.path, self.rows = options["path"], rows
        self.split = int(options.get("splitBytes", 32 << 20))
        self.settle = float(options.get("settleSeconds", 1))
        self.columns = schema

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, arrow = listed_store(self.path), to_arrow_schema(self.columns)
        wanted, held = set(arrow.names), []
        for path in partition.paths:
            for row in self.rows(partial(store.open_input_file, path), stem(path), wanted):
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)


def listed_store(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()


class FolderReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(listed(self.path)[1], self.split)


class FolderStream(_Reading, DataSourceStreamReader):
    """New files in order of their time and path. An offset is the last file taken, so a batch that is run again has the same
    files. A file counts once it is `settleSeconds` old, so that one of the same time cannot come in before it later."""

    START = {"time": -1, "path": ""}

    def initialOffset(self) -> dict:
        return dict(self.START)

    def _files(self) -> list[tuple[int, str, fs.FileInfo]]:
        return sorted(((f.mtime_ns, f.path, f) for f in listed(self.path)[1]), key=lambda x: x[:2])

    def latestOffset(self) -> dict:
        last = [(t, p) for t, p, _ in self._files() if t <= time.time_ns() - int(self.settle * 1e9)]
        return {"time": last[-1][0], "path": last[-1][1]} if last else dict(self.START)

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return dealt([f for t, p, f in self._files() if low < (t, p) <= high], self.split)


class _Folder(DataSource):
    ROWS, COLUMNS = None, ""

    def schema(self) -> str:
        return self.COLUMNS

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options, schema, type(self).ROWS)

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.options, schema, type(self).ROWS)


class ScoreFiles(_Folder):
    """Format `scores`: raw events of MusicXML files. A schema with fewer columns reads only those."""

    ROWS, COLUMNS = staticmethod(score_events), EVENT

    @classmethod
    def name(cls) -> str:
        return "scores"


class SymbolLogs(_Folder):
    """Format `symbol_logs`: symbols of recogniser logs."""

    ROWS, COLUMNS = staticmethod(symbols), SYMBOL

    @classmethod
    def name(cls) -> str:
        return "symbol_logs"


def register(spark: SparkSession) -> None:
    """Make the formats `scores` and `symbol_logs` known to `spark.read` and `spark.readStream`."""
    for source in (ScoreFiles, SymbolLogs):
        spark.dataSource.register(source)
