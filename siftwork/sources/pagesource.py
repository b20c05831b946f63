"""Folders of pages as a data source: spark.read.format("pages") and spark.readStream.format("pages").

Files: .html and .htm (one page each), .json, .jsonl and .ndjson (a page on each line: page_id, url, html), and .warc (a page in each response of text/html), any of
them with .gz behind. Paths are local or of a store that pyarrow.fs reaches (file, hdfs, s3, gs); hidden files, and those of names with _ in front, are left out.

Partitions are planned by bytes: uncompressed JSON lines are parted into ranges of splitBytes, which begin behind the first line end in them, and small
files are put together up to as many. A file that is compressed, an HTML file and a WARC file, whose records can't be found from the middle, are read by one task as a stream.

Columns come from the schema that is asked for, any of those of PAGE: without html, elements, texts, title and truth a page isn't parsed, and an HTML file that isn't needed
isn't opened. Option references=kept leaves character references (&amp;) in texts and values as they stand in the page. Filters on file, page_id and url are applied before parsing. A line that isn't JSON, or a record that can't be read, gives a row of nulls but file and at (mode
permissive) or fails the read (mode failfast).

The stream reads files by time of change, then name; an offset is the last file read. Files must therefore be complete when they appear in the folder, and not older than those
that were read: those changed within settleMillis are left for the next batch, so that files which appear together may do so in any order.
"""

from __future__ import annotations

import gzip
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from siftwork.sources import files as truth_files, pages as walker

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def _structs(fields: dict[str, str]) -> ArrayType:
    return ArrayType(StructType([StructField(n, _TYPES[t]) for n, t in fields.items()]))


#: All columns. at: where in its file a page begins, in bytes of what is read, behind decompression.
PAGE = StructType(
    [StructField(n, _TYPES[t]) for n, t in {"file": "string", "at": "bigint", "page_id": "string", "url": "string", "html": "string", "bytes": "bigint", "title": "string"}.items()]
    + [StructField("elements", _structs(walker._FIELDS)), StructField("texts", _structs(walker._TEXT_FIELDS)), StructField("truncated", BooleanType())]
    + [StructField("pii", _structs(truth_files.PII)), StructField("regions", _structs(truth_files.REGION))]
)
KINDS = {".html": "html", ".htm": "html", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".warc": "warc"}
SPLIT, ROWS, BYTES = 64 << 20, 256, 8 << 20


def only(*names: str) -> StructType:
    """The schema of some columns."""
    return StructType([PAGE[n] for n in names])


def kind_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    stem = name[:-3] if name.endswith(".gz") else name
    return None if name[:1] in "._" else next((k for end, k in KINDS.items() if stem.endswith(end)), None)


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in nanoseconds) of the files below a folder, by name."""
    store, at = store_of(path)
    info = store.get_file_info(at)
    infos = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((i.path, i.size or 0, i.mtime_ns or 0) for i in infos if i.type == pafs.FileType.File and kind_of(i.path))


@dataclass
class Pieces(InputPartition):
    """(path, first byte, byte behind the last) of each range that a task reads."""

    ranges: list[tuple[str, int, int]]


def planned(found: list[tuple[str, int, int]], split: int) -> list[Pieces]:
    out, held, size = [], [], 0
    for path, n, _ in found:
        step = split if kind_of(path) == "json" and not path.lower().endswith(".gz") else max(n, 1)
        for at in range(0, max(n, 1), step):
            piece = (path, at, min(at + step, n))
            if held and size + piece[2] - at > split:
                out, held, size = [*out, Pieces(held)], [], 0
            held.append(piece)
            size += piece[2] - at
    return [*out, Pieces(held)] if held else out


def _lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range."""
    at = start
    if start:
        stream.seek(start - 1)
        at += len(stream.readline()) - 1
    while at < end:
        line = stream.readline()
        if not line:
            return
        yield at, line
        at += len(line)


def _records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields by lower-case name, block) of the records of a WARC stream. A record that can't be read ends it."""
    at = 0
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            at, line = at + len(line), stream.readline()
        if not line:
            return
        began, at = at, at + len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {began}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        at += len(line)
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"the record at byte {began} is cut short")
        at += n
        yield began, fields, block


def _page_of(fields: dict[str, str], block: bytes) -> tuple[str | None, str | None, str] | None:
    """(id, url, html) of a response that is a page."""
    if fields.get("warc-type") != "response":
        return None
    head, _, body = block.partition(b"\r\n\r\n") if b"\r\n\r\n" in block else block.partition(b"\n\n")
    mime = next((x.split(b":", 1)[1].strip().lower() for x in head.splitlines()[1:] if x.lower().startswith(b"content-type:")), b"text/html")
    if not mime.startswith((b"text/html", b"application/xhtml")):
        return None
    coding = mime.partition(b"charset=")[2].split(b";")[0].strip(b" \"'").decode("ascii", "replace")
    try:
        html = body.decode(coding or "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    return fields.get("warc-record-id", "").strip("<>") or None, fields.get("warc-target-uri"), html


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.arrow = to_arrow_schema(schema)
        self.names = schema.names
        known = {x.name: x.dataType for x in PAGE.fields}
        for field in schema.fields:
            if known.get(field.name) != field.dataType:
                raise ValueError(f"no column {field.name} {field.dataType.simpleString()}; there are {PAGE.simpleString()}")
        self.path = options.get("path")
        if not self.path:
            raise ValueError("no path")
        self.split = int(options.get("splitBytes", SPLIT))
        self.failfast = options.get("mode", "permissive").lower() == "failfast"
        self.hidden, self.prefix = options.get("hidden", "false").lower() == "true", options.get("truthPrefix", "data-truth")
        self.kept = options.get("references", "read").lower() == "kept"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", IsNotNull: "some"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("file",), ("page_id",), ("url",)):
                self.tests.append((f.attribute[0], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        found = [x for x in listed(self.path) if self._kept("file", x[0])]
        return planned(found, self.split) or [Pieces([])]

    def _kept(self, name: str, value: str | None) -> bool:
        for column, kind, want in self.tests:
            if column == name:
                fine = value is not None and {"=": lambda: value == want, "in": lambda: value in want, "starts": lambda: value.startswith(want), "ends": lambda: value.endswith(want), "contains": lambda: want in value, "some": lambda: True}[kind]()
                if not fine:
                    return False
        return True

    def _pages(self, path: str, start: int, end: int) -> Iterator[tuple[int, str | None, str | None, str | None]]:
        """(at, id, url, html) of a range."""
        store, _ = store_of(self.path)
        kind, zipped = kind_of(path), path.lower().endswith(".gz")
        if kind == "html":
            if not self._kept("page_id", path) or not self._kept("url", path):
                return
            html = None
            if set(self.names) - {"file", "at", "page_id", "url"}:
                with store.open_input_file(path) as f:
                    raw = f.read()
                html = (gzip.decompress(raw) if zipped else raw).decode("utf-8", "replace")
            yield 0, path, path, html
            return
        with store.open_input_file(path) as f:
            stream = gzip.GzipFile(fileobj=f) if zipped else io.BufferedReader(f, 1 << 20) if kind == "warc" else f
            if kind == "json" and not zipped:
                stream = io.BufferedReader(f, 1 << 20)
            if kind == "json":
                for at, line in _lines(stream, start, 1 << 62 if zipped else end):
                    if line.strip():
                        try:
                            row = json.loads(line)
                            yield at, *[None if row.get(k) is None else str(row[k]) for k in ("page_id", "url", "html")]
                        except (ValueError, AttributeError, RecursionError) as e:
                            if self.failfast:
                                raise ValueError(f"{path} at byte {at}: {e}") from e
                            yield at, None, None, None
            else:
                at = 0
                try:
                    for at, fields, block in _records(stream):
                        if page := _page_of(fields, block):
                            yield at, *page
                except (ValueError, KeyError, EOFError, OSError) as e:
                    if self.failfast:
                        raise ValueError(f"{path} behind byte {at}: {e}") from e
                    yield at, None, None, None

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        walks, titles, truths = {"elements", "texts", "truncated"} & {*self.names}, "title" in self.names, {"pii", "regions"} & {*self.names}
        for path, start, end in partition.ranges:
            for at, page_id, url, html in self._pages(path, start, end):
                if not (self._kept("page_id", page_id) and self._kept("url", url)):
                    continue
                row = {"file": path, "at": at, "page_id": page_id, "url": url, "html": html, "bytes": None if html is None else len(html.encode("utf-8", "surrogatepass"))}
                # the parser reads "&amp;" as "&", so that what it says is what stood there
                parsed = html.replace("&", "&amp;") if html and self.kept else html
                if walks or titles:
                    row |= _walked(parsed, self.hidden)
                if truths:
                    row |= _told(parsed, self.prefix)
                rows.append(row)
                size += len(html or "")
                if len(rows) == ROWS or size >= BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t.type) for n, t in zip(self.names, self.arrow, strict=True)], schema=self.arrow)


def _walked(html: str | None, hidden: bool) -> dict:
    if html is None:
        return dict.fromkeys(("elements", "texts", "truncated", "title"))
    w = walker._Walk(hidden)
    w.feed(html)
    w.close()
    elements, texts, cut = w.done()
    return {"elements": elements, "texts": texts, "truncated": cut, "title": w.title}


def _told(html: str | None, prefix: str) -> dict:
    pii, regions = truth_files.told_by(html or "", prefix)
    return {"pii": pii, "regions": regions}


class PageStreamReader(DataSourceStreamReader):
    """Offsets: {"ns", "path"} of the last file read."""

    def __init__(self, schema: StructType, options):
        self.reader = PageReader(schema, options)
        self.settle = int(options.get("settleMillis", 1000)) * 1_000_000

    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def _after(self, start: dict, end: dict | None = None) -> list[tuple[str, int, int]]:
        place = lambda o: (o["ns"], o["path"])
        found = sorted(((ns, path, n) for path, n, ns in listed(self.reader.path)))
        return [(path, n, ns) for ns, path, n in found if place(start) < (ns, path) and (end is None or (ns, path) <= place(end))]

    def latestOffset(self) -> dict:
        now = time.time_ns() - self.settle
        found = [x for x in self._after(self.initialOffset()) if x[2] <= now]
        return {"ns": found[-1][2], "path": found[-1][0]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return planned(self._after(start, end), self.reader.split)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch that is done."""


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType:
        return PAGE

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make "pages" known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)

