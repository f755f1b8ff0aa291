"""Legacy web archives: ARC files are written and parsed, and converted to equivalent WARC records."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, gathered, small_batches

#: Fields of a record's header line, by the version in the file's first record (fixed by the format).
FIELDS = {
    1: ("url", "ip", "date", "content-type", "length"),
    2: ("url", "ip", "date", "content-type", "result-code", "checksum", "location", "offset", "filename", "length"),
}
#: An archive is closed when it has more bytes than this.
ARCHIVE_BYTES = 32 << 20
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
WARC_VERSION = b"WARC/1.1"
_IDS = uuid.UUID("6f1d2b0e-3c4a-5b6d-8e7f-90a1b2c3d4e5")


class BadArchive(ValueError):
    """The bytes are not what the header lines declare."""


@dataclass
class ArcRecord:
    offset: int
    header: dict[str, str]
    body: bytes


def arc_line(version: int, values: dict[str, str]) -> bytes:
    """A header line; white space in a value would shift fields, so it is percent-encoded, and an empty value is a dash."""
    clean = (re.sub(r"\s", lambda m: f"%{ord(m.group()):02X}", values.get(f, "")) or "-" for f in FIELDS[version])
    return (" ".join(clean) + "\n").encode("utf-8", "surrogatepass")


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The version block every ARC file begins with."""
    body = f"{version} 0 tracelore\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'content-type': 'Content-type', 'result-code': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[f] for f in FIELDS[version])}\n".encode()
    return arc_line(version, {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "content-type": "text/plain", "result-code": "200", "filename": name, "offset": "0", "length": str(len(body))}) + body + b"\n"


def read_arc(file: BinaryIO, opening: bool = False) -> Iterator[ArcRecord]:
    """Records of an ARC file (decompressed) with the offset of their header line; the version block is the first of them if `opening`.

    The version in the block says which fields a line has. A URL may hold spaces in old files: fields are counted from the end.
    The declared length, not a separator, ends a record. An empty file has no records.
    """
    first = file.readline()
    if not first:
        return
    if not first.startswith(b"filedesc://"):
        raise BadArchive("no filedesc:// line")
    said = first.decode("utf-8", "surrogateescape").split()
    if not said[-1].isdigit():
        raise BadArchive("the filedesc:// line declares no length")
    block = file.read(int(said[-1]))
    try:
        version = int(block.split(None, 1)[0])
        fields = FIELDS[version]
    except (ValueError, IndexError, KeyError) as e:
        raise BadArchive(f"unknown version in {block[:40]!r}") from e
    if opening:
        # a filedesc line has the date third in either version
        yield ArcRecord(0, {"url": said[0], "date": said[2] if len(said) > 2 else ""}, block)
    while True:
        offset = file.tell()
        line = file.readline()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise BadArchive(f"header line at {offset} has not the fields of version {version}")
        header = dict(zip(fields, values, strict=True))
        size = int(header["length"])
        body = file.read(size)
        if len(body) != size:
            raise BadArchive(f"record at {offset} declares {size} bytes, {len(body)} are left")
        yield ArcRecord(offset, header, body)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP status line and headers with their empty line, and the payload; a body without them is all payload."""
    if body.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            head, found, rest = body.partition(mark)
            if found:
                return head + found, rest
    return b"", body


def http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m.group(1).decode("utf-8", "replace") if m else None


def warc_date(date: str) -> str:
    """An ARC date (14 digits, or fewer in old files) as WARC's; one that is no date becomes the epoch."""
    try:
        return datetime.strptime((date + "19700101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(name: str, offset: int, header: dict[str, str]) -> str:
    """An identifier made from where the record stands and what it is, the same in every conversion."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{name}|{offset}|{header['url']}|{header['date']}')}>"


def kind_of(arc: ArcRecord) -> str:
    """The WARC type of an ARC record: response with an HTTP head, metadata by its scheme, and resource for what was stored as it is (dns among it)."""
    if split_http(arc.body)[0]:
        return "response"
    return "metadata" if arc.header["url"].partition(":")[0].lower() == "metadata" else "resource"


def warc_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of header fields and a block; its length and the block's digest are added."""
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([WARC_VERSION, *(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in fields), b"", block, b"", b""])


def warc_info(name: str, opening: ArcRecord) -> bytes:
    """The warcinfo record that an ARC file's version block becomes; what the block says is kept."""
    said = opening.body.decode("utf-8", "replace").split("\n", 1)[0]
    block = f"software: tracelore\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\narc-version-block: {said}\r\n".encode()
    return warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0, opening.header)), ("WARC-Date", warc_date(opening.header["date"])), ("WARC-Filename", name.removesuffix(".arc.gz") + ".warc.gz"), ("Content-Type", "application/warc-fields")], block)


def warc_record(name: str, arc: ArcRecord, refers_to: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record, of kind_of() it, or a revisit of refers_to (identifier, URL, date), which keeps the HTTP head only.

    A body without an HTTP head stays as it is, under the content type that the header line declares.
    """
    head, payload = split_http(arc.body)
    kind = "revisit" if refers_to else kind_of(arc)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(name, arc.offset, arc.header)),
        ("WARC-Date", warc_date(arc.header["date"])),
        ("WARC-Target-URI", arc.header["url"]),
        ("WARC-IP-Address", arc.header["ip"]),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response" if head else arc.header["content-type"]),
    ]
    if refers_to:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", refers_to[2])]
    return warc_bytes(fields, head if refers_to else arc.body)


def read_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file (decompressed)."""
    while True:
        line = file.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise BadArchive(f"{line[:40]!r} is no WARC version line")
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise BadArchive(f"record {fields.get('warc-record-id')} declares {size} bytes, {len(block)} are left")
        yield fields, block


def opened(path: str):
    """The file system and the path in it of a URI; any store that Arrow knows."""
    return pafs.FileSystem.from_uri(path)


@contextmanager
def reading(path: str):
    """A buffered stream of an archive's bytes, decompressed if the name says so."""
    store, at = opened(path)
    with store.open_input_file(at) as raw:
        with (gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw) as file:
            yield io.BufferedReader(file, 1 << 20)


def publish(path: str, data: bytes | memoryview) -> None:
    """Write a file under a name of its own, then rename it. A task that is run again makes the same bytes: where a store does not
    rename onto a file that exists, that one stays."""
    store, at = opened(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        store.move(own, at)
    except OSError:
        if store.get_file_info(at).type != pafs.FileType.File:
            raise
        store.delete_file(own)


ARCHIVES = "archive string, records long, bytes long"


def write_arcs(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", limit: int = ARCHIVE_BYTES, date: str = "20240101000000") -> DataFrame:
    """ARC files of the rows' payloads in UTF-8 (null: empty), gzip by record, about `limit` bytes each: archive, records, bytes.

    Keys are whole numbers; other columns are not read, so their names clash with nothing; repeated rows are records of their own; a payload longer than
    `limit` makes its archive longer; an empty table makes no file. Files alternate between the two versions of the format. The key is kept in the HTTP header X-Record-Key (no such header
    for a null key), a null URL becomes urn:key:<key>. Nothing is written before the result is evaluated, once.
    """
    small_batches(pages.sparkSession)
    store, at = opened(folder)
    store.create_dir(at, recursive=True)

    def run(batches):
        out, count, made = io.BytesIO(), 0, []
        unique, version = uuid.uuid4().hex[:12], 1

        def close():
            nonlocal out, count, version
            if count:
                name = f"{folder}/{unique}-{len(made):05d}.arc.gz"
                publish(name, out.getbuffer())
                made.append((name, count, out.tell()))
            out, count, version = io.BytesIO(), 0, 3 - version

        for batch in batches:
            for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not count:
                    out.write(gzip.compress(arc_opening(version, f"{unique}-{len(made):05d}.arc.gz", date), 1, mtime=0))
                body = (p or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{'' if k is None else f'X-Record-Key: {k}{chr(13)}{chr(10)}'}Content-Length: {len(body)}\r\n\r\n".encode()
                values = {"url": u if u is not None else f"urn:key:{k}", "ip": "0.0.0.0", "date": date, "content-type": "text/html", "result-code": "200", "offset": str(out.tell()), "filename": f"{unique}-{len(made):05d}.arc.gz", "length": str(len(head) + len(body))}
                out.write(gzip.compress(arc_line(version, values) + head + body + b"\n", 1, mtime=0))
                count += 1
                if out.tell() >= limit:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return pages.select(*(F.col(f"`{c}`").cast(k).alias(f"c{i}") for i, (c, k) in enumerate(((key, "long"), (url, "string"), (payload, "string"))))).mapInArrow(run, ARCHIVES)


INDEX = "archive string, offset long, key long, kind string, record_id string, url string, date string, payload_bytes long, payload_digest string"


def index_arcs(archives: DataFrame) -> DataFrame:
    """One row for each record of the ARC files, from parsing them whole."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with reading(path) as file:
                    for r in read_arc(file):
                        head, payload = split_http(r.body)
                        k = http_field(head, b"X-Record-Key")
                        rows.append((path, r.offset, None if k is None else int(k), kind_of(r), record_id(path.rpartition("/")[2], r.offset, r.header), r.header["url"], warc_date(r.header["date"]), len(payload), hashlib.sha256(payload).hexdigest()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in INDEX.split(", ")])

    return archives.select("archive").mapInArrow(run, INDEX)


def with_originals(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds original (key, record_id, url, date) to records that revisit another: one with an equal payload of at
    least `least` bytes and a smaller key, the smallest of all. Records with a null key revisit but are not revisited."""
    firsts = index.where((F.col("payload_bytes") >= least) & F.col("key").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("key", "archive", "offset", "record_id", "url", "date")).alias("original"), F.count(F.lit(1)).alias("n"))
    again = F.col("original").isNotNull() & (F.col("kind") == "response") & (F.col("payload_bytes") >= least) & ~((F.col("original.archive") == F.col("archive")) & (F.col("original.offset") == F.col("offset")))
    out = index.join(firsts.select("payload_digest", "original"), "payload_digest", "left")
    return out.withColumn("original", F.when(again, F.struct("original.key", "original.record_id", "original.url", "original.date")))


def tasks_for(archives: int, spark) -> int:
    """Partitions for so many archives: one each, up to 16 for each core; beyond, a task works through several."""
    return max(1, min(archives, 16 * spark.sparkContext.defaultParallelism))


def convert(index: DataFrame, folder: str) -> DataFrame:
    """A WARC file, gzip by record, for each ARC file of an index with originals: archive, records, bytes. It begins with a warcinfo record,
    which `records` does not count. An empty index gives no files."""
    store, at = opened(folder)
    store.create_dir(at, recursive=True)

    def run(table: pa.Table) -> pa.Table:
        path = table["archive"][0].as_py()
        known = dict(zip(table["offset"].to_pylist(), table["original"].to_pylist(), strict=True))
        name = path.rpartition("/")[2]
        own = f"{folder}/{name.removesuffix(".arc.gz")}.warc.gz"
        out, n = io.BytesIO(), 0
        with reading(path) as file:
            records = read_arc(file, opening=True)
            out.write(gzip.compress(warc_info(name, next(records)), 1, mtime=0))
            for r in records:
                o = known[r.offset]
                out.write(gzip.compress(warc_record(name, r, (o["record_id"], o["url"], o["date"]) if o else None), 1, mtime=0))
                n += 1
        publish(own, out.getbuffer())
        return pa.table([pa.array([own]), pa.array([n]), pa.array([out.tell()])], names=["archive", "records", "bytes"])

    # an index is small beside its archives: a number of partitions is set, or adaptive execution would give all archives to one task
    n = 2 * tasks_for(index.select("archive").distinct().count(), index.sparkSession)
    return index.select("archive", "offset", "original").repartition(n, "archive").groupBy("archive").applyInArrow(run, ARCHIVES)


READ = T.StructType([T.StructField(n, k) for n, k in (("key", T.LongType()), ("record_id", T.StringType()), ("record_type", T.StringType()), ("refers_to_id", T.StringType()), ("url", T.StringType()), ("date", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("archive", T.StringType()))])


def read_warcs(archives: DataFrame) -> DataFrame:
    """Records of WARC files but their warcinfo. Block digests are checked, and payload digests of all but revisits (BadArchive); a revisit has the size
    that its kept HTTP head declares. Records without the key's header have a null key."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with reading(path) as file:
                    for fields, block in read_warc(file):
                        kind = fields["warc-type"]
                        if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
                            raise BadArchive(f"{fields['warc-record-id']} in {path} has another digest")
                        if kind == "warcinfo":
                            continue
                        head, payload = split_http(block) if kind in ("response", "revisit") else (b"", block)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                            raise BadArchive(f"{fields['warc-record-id']} in {path} has another payload digest")
                        k = http_field(head, b"X-Record-Key")
                        size = int(http_field(head, b"Content-Length") or 0) if kind == "revisit" else len(payload)
                        rows.append((None if k is None else int(k), fields["warc-record-id"], kind, fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"], size, digest, path))
                kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in READ]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=READ.names)

    return archives.select("archive").mapInArrow(run, READ)


def spread(archives: DataFrame) -> DataFrame:
    """One archive a task, or several where there are very many; names only, bounded by the number of archives."""
    n = archives.count()
    return archives.repartition(tasks_for(n, archives.sparkSession)) if n > 1 else archives


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, limit: int = ARCHIVE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write ARC files of the rows, convert them to WARC files, and read those: (records, WARC files).

    records has the columns of READ and refers_to, the key of the response that a revisit names. An empty table gives no
    files and no records. Repeated rows are records of their own: of equal keys the first in the archives is the response.
    Files stay in `folder` (default: in the shared folder); the ARC files can be deleted afterwards.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    folder = folder or scratch.path
    arcs = scratch.save(write_arcs(pages, f"{folder}/arc", key=key, url=url, payload=payload, limit=limit), "arcs")
    index = scratch.save(with_originals(scratch.save(index_arcs(spread(arcs)), "index")), "originals", small=True)
    warcs = scratch.save(convert(index, f"{folder}/warc"), "warcs", small=True)
    records = scratch.save(read_warcs(spread(warcs)), "records")
    named = index.where("original is not null").select(F.col("record_id"), F.col("original.key").alias("refers_to"), F.col("original.record_id").alias("__id"))
    # what a record's own header says is resolved to a key; the index only lists the keys by identifier
    return gathered(records.join(named, "record_id", "left").withColumn("refers_to", F.when(F.col("refers_to_id") == F.col("__id"), F.col("refers_to"))).drop("__id")), warcs
