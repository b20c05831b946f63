"""Legacy archive converter: ARC records, read by version-specific header lines and declared lengths, become WARC records.

parse_arc() reads version 1 (URL, address, date, type, length) and version 2 (result code, checksum, location, offset and file
name besides) blocks. convert() gives each record a WARC identifier, timestamp, type and digests. Identifiers are version-8
UUIDs that hold the record's 64-bit key and 58 bits of a hash of its URI, date and payload, so that equal input gives equal
archives, and a revisit names its original without a join.

An archive that is written has one gzip member for each record, begins with a warcinfo record and is bounded in bytes: its rows, BUNDLE bytes of
records or one longer record, are PER_FILE at most. load_arcs() reads a folder of legacy archives, plain or gzipped.

A record whose declared length runs beyond the data is kept and marked as truncated; a header line that doesn't parse is
skipped. Null payloads count as empty. Rows with equal key and payload are written once each, with the same type. A null key
is written without the key header and never revisits; so is what a foreign archive has in its place that is no whole number. Heads may end their lines with a bare line feed and hold bytes
that aren't UTF-8. Very long payloads are held one at a time. Ties (equal payloads) go to the smallest key. Extra columns are ignored, an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, drop, new_path, spread

#: Payloads of fewer bytes are never revisits.
LEAST = 100
KEY = "X-Record-Key"
#: Fixed: the names of the fields of a record's line, by the version of its archive.
FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length")}
#: Bytes of records in a row of an archive, unless one record alone is longer, and rows of an archive: bounds what a reader holds.
BUNDLE, PER_FILE = 8 << 20, 16
#: Pages and bytes of them in a legacy archive that is made, unless one page alone is longer; records are handed on by as many bytes.
ARC_PAGES, ARC_BYTES = 200, 16 << 20
#: A record's own header for the bytes of its whole payload, which a revisit doesn't hold: the origin may not have told them.
LENGTH = "X-Payload-Length"


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    block: bytes
    truncated: bool


def arc_head(version: int, name: str) -> bytes:
    lines = f"{version} 0 siftwork\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'mime': 'Content-type', 'status': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'file': 'Filename', 'length': 'Archive-length'}[f] for f in FIELDS[version])}\n"
    middle = "" if version == 1 else "200 - - 0 - "
    return f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {middle}{len(lines)}\n{lines}".encode()


def arc_record(version: int, url: str, date: str, block: bytes) -> bytes:
    middle = "" if version == 1 else "200 - - 0 - "
    return b"\n" + f"{re.sub(r'[\x00-\x20]', '_', url) or '-'} 0.0.0.0 {date} text/html {middle}{len(block)}\n".encode() + block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block. URLs may hold spaces: fields are counted from the right."""
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc://")
        if first:  # the version stands at the start of the block's second line
            said = data[end + 1 : end + 2]
            version = int(said) if said in (b"1", b"2") else 1
        names = FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        at = end + 1
        if len(parts) < len(names) or not parts[-1].isdigit():
            continue
        n = int(parts[-1])
        if not first:
            yield ArcRecord(version, dict(zip(names, parts, strict=True)), data[at : at + n], at + n > len(data))
        at += n


def inflated(data: bytes) -> bytes:
    """An archive without its gzip members, if it has any; what follows a broken member is lost."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    z, out = Inflate(data), bytearray()
    try:
        while z.more():
            out += z.buffer
            z.buffer.clear()
    except zlib.error:
        pass
    return bytes(out + z.buffer)


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte: the length's highest one, or an empty member behind a record of 16 MB or more."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + member(b"")


_EMPTY = re.compile(rb"\r?\n\r?\n")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with its empty line, and payload; no head where the block isn't an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = _EMPTY.search(block)  # some servers end lines with a bare line feed
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def whole(value: str | None) -> int | None:
    """A whole number of 64 bits; what is none, as a header of a foreign archive may be, is null."""
    found = int(value) if value and re.fullmatch(r"-?[0-9]{1,19}", value) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def record_id(key: int | None, seed: str) -> str:
    """A version-8 UUID: 48 bits of the key, version, 12 bits of the key, variant, 4 bits of the key, 58 bits of the seed's hash."""
    k = (key or 0) & (1 << 64) - 1
    rest = int.from_bytes(hashlib.sha256(f"{key}|{seed}".encode()).digest()[:8], "big") >> 6
    x = (k >> 16) << 80 | 8 << 76 | (k >> 4 & 0xFFF) << 64 | 2 << 62 | (k & 15) << 58 | rest
    h = f"{x:032x}"
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def key_in(identifier: str) -> int:
    x = int(identifier.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    k = (x >> 80) << 16 | (x >> 64 & 0xFFF) << 4 | x >> 58 & 15
    return k - (1 << 64) if k >> 63 else k


def warc_date(date: str) -> str:
    """14 digits, or fewer, of an ARC date as an ISO timestamp."""
    d = (re.sub(r"\D", "", date) + "19960101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(key: int | None, url: str, date: str, truncated: bool, block: bytes, digest: str, first: tuple[int, str, str] | None) -> bytes:
    """One WARC record; first is the key, URL and date of the record that this one revisits."""
    head, body = split_http(block)
    at = warc_date(date)
    kind = "revisit" if first else "response" if head else "resource"
    shown = head if first else block
    of = [("WARC-Record-ID", f"<{record_id(key, f'{url}|{at}|{digest}')}>"), ("WARC-Date", at), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(shown).hexdigest()}")]
    of.append((LENGTH, str(len(body))))
    if truncated:
        of.append(("WARC-Truncated", "length"))
    if first:
        k, u, d = first
        of += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(k, f'{u}|{warc_date(d)}|{digest}')}>"), ("WARC-Refers-To-Target-URI", u), ("WARC-Refers-To-Date", warc_date(d))]
    of.append(("Content-Type", "application/http; msgtype=response" if head else "text/html"))
    return warc_record(kind, of, shown)


class Inflate:
    """Reads a gzip stream of any number of members bit by bit; what a member leaves of a piece is read again by the next, nothing else is copied."""

    PIECE = 4096

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.buffer = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while self.at < len(self.data):
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            piece = self.data[self.at : self.at + self.PIECE]
            got = self.z.decompress(piece)
            self.at += len(piece) - len(self.z.unused_data)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a gzipped archive, by declared lengths."""
    z = Inflate(data)
    while (head := z.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        of = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = z.take(int(of.get("content-length", 0)))
        z.take(4)
        yield of, block


def make_arcs(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(name, content binary): legacy archives of the pages, in turn of version 1 and 2; the input of the converter where no archives are at hand."""

    def run(batches):
        for n, part in enumerate(bounded(batches, "p", ARC_PAGES, ARC_BYTES), 1):
            version, name = 1 + n % 2, f"pages-{n}.arc"
            out = [arc_head(version, name)]
            for key, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                body = html or b""
                mark = "" if key is None else f"{KEY}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n"
                date = f"2001{1 + (key or 0) % 12:02}{1 + (key or 0) % 28:02}{(key or 0) % 24:02}0000"
                out.append(arc_record(version, url or "", date, head.encode() + body))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], names=["name", "content"])

    rows = spread(pages.select(F.col(key_col).cast("long").alias("k"), F.col(url_col).cast("string").alias("u"), F.encode(F.col(payload_col), "UTF-8").alias("p")))
    return rows.mapInArrow(run, "name string, content binary")


RECORD = "key long, url string, date string, truncated boolean, block binary, digest string, n_bytes long"


def load_arcs(spark, path: str) -> DataFrame:
    """(name, content): the archives in a folder, as read_arcs() takes them. Archives of 2 GB or more can't be read as one value."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_arcs(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of legacy archives: key (of the KEY header, else null), url, date, truncated, block, payload's digest and n_bytes."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("truncated", pa.bool_()), ("block", pa.binary()), ("digest", pa.string()), ("n_bytes", pa.int64())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for r in parse_arc(inflated(batch.column(0)[i].as_py() or b"")):
                    head, body = split_http(r.block)
                    rows.append((whole(field(head, KEY)), r.fields["url"], r.fields["date"], r.truncated, r.block, hashlib.sha256(body).hexdigest(), len(body)))
                    size += len(r.block)
                    if size >= ARC_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return arcs.select(content_col).mapInArrow(run, RECORD)


def originals(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, digest, first struct<key, url, date>) of the records that revisit another: of equal payloads of at least `least` bytes all but the one with the smallest key. Only narrow rows are shuffled; a payload that very many records share is pre-aggregated."""
    narrow = records.select("key", "url", "date", "digest", "n_bytes").where(F.col("n_bytes") >= least)
    first = narrow.where("key IS NOT NULL").groupBy("digest").agg(F.min(F.struct("key", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(first, "digest").where(F.col("key") > F.col("first.key")).select("key", "digest", "first").distinct()


def write_warcs(records: DataFrame, path: str, per_file: int = PER_FILE, bundle: int = BUNDLE) -> None:
    """WARC archives of the records in the folder path, written by Spark's own writer. Records are a table from here on, so that archives are parsed once."""
    records = cut(records, "warc-records", "zstd")
    again = originals(records).select(F.col("key").alias("k"), F.col("digest").alias("d"), "first")
    rows = records.join(again, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")), "left").select("key", "url", "date", "truncated", "block", "digest", "first.key", "first.url", "first.date")

    def run(batches):
        info = warc_record("warcinfo", [("WARC-Record-ID", f"<{record_id(0, 'warcinfo')}>"), ("WARC-Date", "2001-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: siftwork\r\nformat: WARC File Format 1.1\r\n")
        out, size, written = [], 0, 0

        def row():
            nonlocal out, size, written
            head, written = [member(info)] if written % per_file == 0 else [], written + 1
            # the writer ends each row with a zero byte, which is the last record's own
            made = pa.RecordBatch.from_arrays([pa.array([b"".join(head + out)[:-1]], pa.binary())], names=["rows"])
            out, size = [], 0
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for key, url, date, truncated, block, digest, k, u, d in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    made = convert(key, url, date, truncated, block, digest, None if k is None else (k, u, d))
                    if out and size + len(made) > bundle:
                        yield row()
                    out.append(member(made))
                    size += len(made)
        if out:
            yield row()

    names = ["key", "url", "date", "truncated", "block", "digest", "first_key", "first_url", "first_date"]
    made = rows.toDF(*names).mapInArrow(run, "rows binary").select(F.col("rows").cast("string").alias("value"))
    made.write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)
    drop(records)


def read_warcs(spark, path: str) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of the response, resource and revisit records of the archives in path. Digests of whole payloads are computed anew and compared to the declared ones."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for of, block in parse_warc(content):
                    kind = of.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, body = split_http(block)
                    key = field(head, KEY)
                    digest, n = of["warc-payload-digest"].partition(":")[2], len(body)
                    if kind == "revisit":
                        n = whole(of.get(LENGTH.lower()))
                    elif hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload of {of['warc-record-id']} doesn't match its digest")
                    rows.append((whole(key), n, digest, "revisit" if kind == "revisit" else "response", key_in(of["warc-refers-to"]) if kind == "revisit" else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages to legacy archives, these to WARC archives in the shared folder, and those read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warcs(read_arcs(make_arcs(pages, key_col, url_col, payload_col)), path)
    return read_warcs(spark, path).withColumnRenamed("key", key_col)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM f
"""
