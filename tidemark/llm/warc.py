"""Conversion of legacy ARC archives to WARC, and reading of the WARC archives.

The converter reads folders of `.arc.gz` (as a stream) and `.arc` (each whole, 2 GB at most) and walks each archive by its declared
lengths: the version block names the header layout, each header line is parsed by the layout of its version, and the block
behind it is taken whole. For each record it synthesises what ARC lacks: a record id derived from archive, place, address and
date, an ISO date, the record type (`response` for HTTP, `resource` for dns and all else, `warcinfo` for the version
block), and SHA-1 digests of block and payload. A broken record becomes a row of the report and the walk goes on at the next
header.

Records are converted in one scan and written to the shared folder, each as a gzip member. Which ones repeat an earlier payload is
found from their digests alone; their revisit records are made of their HTTP heads, so no payload is shuffled for them, and
compressed records are joined by their own unique keys: a payload that a third of all pages share crowds no task.

Archives are written by Spark's text writer, a gzip member for each record and, as line separator, an empty member between them;
so they land in any store, a lost task leaves no half file, and a record can be read from its offset. They are read in a
stream that follows Content-Length, so memory holds one record at a time whatever the size of the archive, and payloads may
hold any bytes. Revisits name their response by the standard WARC-Refers-To headers, which reading resolves.

Defined cases: a null html is an empty payload; a null or empty url is written as about:blank; bytes that a URI can't hold are
percent-encoded. Of equal payloads the record of least page_id is the response (null ids last; then the earliest date); rows that
repeat that id are responses too. An empty table gives an archive without records. A header date of 8, 12 or 14 digits is
completed with zeros; of any other, the archive's own date is taken and the report says so. Other columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bytes_of, ship, slices, trim

# The two header layouts of the ARC format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Longer lines are no headers.
LONGEST_HEADER = 1 << 14
_START = rb"(.*?) ([0-9A-Fa-f.:]+|-) ([0-9]+|-) (.*)"
_HEADERS = {1: re.compile(_START + rb" ([0-9]+)"), 2: re.compile(_START + rb" (\S+)" * 5 + rb" ([0-9]+)")}
_DATES = {8: "%Y%m%d", 12: "%Y%m%d%H%M", 14: "%Y%m%d%H%M%S"}
_EPOCH = datetime.datetime(2001, 1, 1)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_BETWEEN = member(b"")


def uri(url: bytes) -> str:
    """A URL as ASCII: bytes that it can't hold are percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]|[<>\"]", lambda m: b"%%%02X" % m[0][0], url).decode() or "about:blank"


def iso(date: str) -> str | None:
    try:
        return datetime.datetime.strptime(date, _DATES[len(date)]).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (KeyError, ValueError):
        return None


# --- ARC ---------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 tidemark\n{' '.join(FIELDS[version])}\n".encode()
    fields = ["text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(block))]
    return f"filedesc://{name} 0.0.0.0 {date} {' '.join(fields)}\n".encode() + block + b"\n"


def arc_record(version: int, url: bytes, date: str, kind: str, content: bytes, offset: int, name: str) -> bytes:
    fields = [kind, *(["200", "-", "-", str(offset), name] if version == 2 else []), str(len(content))]
    return url + f" 0.0.0.0 {date} {' '.join(fields)}\n".encode() + content + b"\n"


class _Stream:
    """Lines and byte counts from chunks of any size."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at = iter(chunks), b"", 0

    def _more(self) -> bool:
        self.held, self.at = next(self.chunks, b""), 0
        return bool(self.held)

    def line(self) -> bytes:
        """Up to and with the next line feed, or what is left."""
        parts = []
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.held[self.at : end + 1])
                self.at = end + 1
                break
            parts.append(self.held[self.at :])
            if not self._more():
                break
        return b"".join(parts)

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            part = self.held[self.at : self.at + n]
            parts.append(part)
            self.at, n = self.at + len(part), n - len(part)
            if n and not self._more():
                break
        return b"".join(parts)


@dataclass(frozen=True)
class Arc:
    """A record of an archive: its header fields and block, or what is wrong there. ordinal: its place in the archive."""

    ordinal: int
    fields: dict[str, bytes] | None
    block: bytes = b""
    problem: str | None = None


def parse_arc(chunks: Iterable[bytes]) -> Iterator[Arc]:
    """The records of one archive, its version block first; broken ones carry a problem."""
    stream, version, skipping, ordinal = _Stream(chunks), None, False, 0
    while line := stream.line():
        head = line.rstrip(b"\r\n")
        if not head.strip():
            continue
        found = _header(head, version)
        if found is None:
            if not skipping:
                yield Arc(ordinal, None, problem=f"no header: {head[:80]!r}")
                ordinal += 1
            skipping = True
            continue
        layout, fields = found
        skipping, length = False, int(fields["Archive-length"])
        block = stream.take(length)
        if len(block) < length:
            yield Arc(ordinal, None, problem=f"a record declares {length} bytes, {len(block)} are there: {head[:80]!r}")
            return
        if fields["URL"].startswith(b"filedesc://"):
            number = re.match(rb"[0-9]{1,3}", block)
            version = int(number[0]) if number else 0
            if version not in FIELDS:
                yield Arc(ordinal, None, problem=f"unknown ARC version: {block[:20]!r}")
                ordinal, version = ordinal + 1, layout
        elif version is None:
            yield Arc(ordinal, None, problem="an archive begins with its version block")
            ordinal, version = ordinal + 1, layout
        yield Arc(ordinal, fields, block)
        ordinal += 1


def _header(line: bytes, version: int | None) -> tuple[int, dict[str, bytes]] | None:
    """Layout and fields of a header line; of either version where none is known yet."""
    if len(line) <= LONGEST_HEADER:
        for layout in (2, 1) if version is None or line.startswith(b"filedesc://") else (version,):
            m = _HEADERS[layout].fullmatch(line)
            if m and (len(m[3]) >= 8 or version is not None) and len(m[m.lastindex]) < 16:
                return layout, dict(zip(FIELDS[layout], m.groups()))
    return None


# --- WARC --------------------------------------------------------------------------------------------------


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, header bytes and payload of an HTTP response; heads may end in bare line feeds."""
    m = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block, b"") if m is None else (block[: m.end()], block[m.end() :])
    fields = (line.partition(b":") for line in re.split(rb"\r?\n", head)[1:] if line)
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in fields}, head, payload


@dataclass(frozen=True)
class Described:
    """What a WARC record says of an ARC record. head: the HTTP head, which is all that a revisit keeps."""

    kind: str
    record_id: str
    url: str
    date: str
    ip: str
    content_type: str
    digest: str
    size: int
    page: int | None
    head: bytes


def describe(record: Arc, archive: str, own_date: str) -> Described:
    """The WARC side of an ARC record. own_date: taken where the record's date can't be read."""
    url, date = uri(record.fields["URL"]), iso(record.fields["Archive-date"].decode()) or own_date
    kind, content_type = "resource", record.fields["Content-type"].decode("latin-1").strip()
    head, payload, page = b"", record.block, None
    if url.startswith("filedesc://"):
        kind, content_type = "warcinfo", "application/warc-fields"
    elif url.lower().startswith("dns:"):
        content_type = "text/dns"
    elif record.block.startswith(b"HTTP/"):
        fields, head, payload = http_parts(record.block)
        kind, content_type = "response", "application/http; msgtype=response"
        page = int(fields["x-page-id"]) if re.fullmatch("-?[0-9]{1,18}", fields.get("x-page-id", "")) else None
    if not re.fullmatch(r"[!-~]+/[ -~]+", content_type):
        content_type = "application/octet-stream"
    ip = record.fields["IP-address"].decode("latin-1")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive} {record.ordinal} {url} {date}")
    return Described(kind, f"<urn:uuid:{name}>", url, date, ip, content_type, digest(payload), len(payload), page, head)


def warc_record(d: Described, block: bytes, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """A WARC record with the blank lines that end it. refers_to: id, address and date of the response that a revisit stands for."""
    if refers_to:
        block = d.head
    elif d.kind == "warcinfo":
        block = f"software: tidemark\r\nformat: WARC File Format 1.1\r\ndescription: converted from {d.url}\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else d.kind}", f"WARC-Record-ID: {d.record_id}", f"WARC-Date: {d.date}"]
    if d.kind != "warcinfo":
        lines.append(f"WARC-Target-URI: {d.url}")
        if d.ip not in ("-", "0.0.0.0"):
            lines.append(f"WARC-IP-Address: {d.ip}")
        lines.append(f"WARC-Payload-Digest: sha1:{d.digest}")
    lines += [f"Content-Type: {d.content_type}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}", f"WARC-Refers-To-Date: {refers_to[2]}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block + END


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of archives that were split at blank lines."""
    head, held, size, need = None, [], 0, 0
    for piece in pieces:
        while piece is not None:
            if head is None:
                piece = piece.lstrip(b"\r\n")
                if piece:
                    if not piece.startswith(b"WARC/"):
                        raise ValueError(f"no WARC record begins with {piece[:40]!r}")
                    split = (line.partition(b":") for line in piece.split(b"\r\n")[1:])
                    head = {k.decode().strip().lower(): v.decode().strip() for k, _, v in split}
                    held, size, need = [], 0, int(head["content-length"])
                piece = None
            else:
                size += len(piece) + (len(END) if held else 0)
                held.append(piece)
                piece = None
                if size >= need:
                    whole = END.join(held)
                    yield head, whole[:need]
                    head, piece = None, whole[need:]
    if head is not None:
        if need:
            raise ValueError(f"a WARC record declares {need} bytes, {size} are there")
        yield head, b""


# --- tables ------------------------------------------------------------------------------------------------


def _write_members(members: DataFrame, path: str, stem: str, suffix: str) -> None:
    """One archive a partition, named stem-<number>suffix; archives without a member are left out."""
    out = members.select(F.col(members.columns[0]).cast("string"))
    out.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", _BETWEEN.decode("latin-1")).text(path)
    jvm = members.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(members.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        m = re.match(r"part-([0-9]+)-", f.getPath().getName())
        if m and f.getLen() == 0:
            fs.delete(f.getPath(), False)
        elif m:
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{stem}-{m[1]}{suffix}"))


def _arc_date(n: int) -> str:
    return (_EPOCH + datetime.timedelta(seconds=n % 10**8)).strftime("%Y%m%d%H%M%S")


def to_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes pages as ARC archives, a gzip member a record; every other archive is of version 2."""
    rows = pages.select(bytes_of(F.col(html_col)).alias("data"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").cast("binary").alias("url"))

    def run(batches):
        number = TaskContext.get().partitionId()
        version, name = 1 + number % 2, f"pages-{number:05d}.arc.gz"
        first = member(arc_version_block(version, name, _arc_date(0)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["member"])
        offset = len(first) + len(_BETWEEN)
        for batch in batches:
            for part in slices(batch, "data"):
                members = []
                for data, key, url in zip(*(part.column(i).to_pylist() for i in range(3))):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if key is None else key}\r\nContent-Length: {len(data)}\r\n\r\n"
                    url = re.sub(rb"[\x00-\x1f\x7f]", lambda m: b"%%%02X" % m[0][0], url or b"").strip() or b"about:blank"
                    members.append(member(arc_record(version, url, _arc_date(key or 0), "text/html", head.encode() + data, offset, name), 1))
                    offset += len(members[-1]) + len(_BETWEEN)
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])
        trim()

    ship(pages.sparkSession)
    _write_members(rows.mapInArrow(run, "member binary"), path, "pages", ".arc.gz")


_RECORD = "file long, ordinal long, kind string, record_id string, url string, date string, ip string, content_type string, digest string, size long, page long, head binary, problem string, member binary"


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a folder of archives, described and as gzip members of WARC; problems as rows without a kind."""

    def run(batches):
        flat = ((f, v) for batch in batches for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        out, held = [], 0
        for file, chunks in itertools.groupby(flat, key=lambda r: r[0]):
            own_date = "1996-01-01T00:00:00Z"
            for record in parse_arc(v for _, v in chunks):
                if record.fields is None:
                    out.append((file, record.ordinal, *[None] * 10, record.problem, None))
                    continue
                date = iso(record.fields["Archive-date"].decode())
                problem = None if date else f"no date: {record.fields['Archive-date'].decode()}"
                d = describe(record, str(file), own_date)
                if d.kind == "warcinfo":
                    own_date = d.date
                data = member(warc_record(d, record.block))
                out.append((file, record.ordinal, d.kind, d.record_id, d.url, d.date, d.ip, d.content_type, d.digest, d.size, d.page, d.head, problem, data))
                held += len(data)
                if held > 4 << 20 or len(out) >= 2000:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)
        trim()

    def _batch(rows):
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        names, kinds = zip(*(c.split() for c in _RECORD.split(", ")))
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], list(names))

    ship(spark)
    file = F.xxhash64("_metadata.file_path").alias("file")
    # lines of a compressed archive come in order in one task; a line's end is put back
    packed = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.arc.gz").option("recursiveFileLookup", True).text(path)
    packed = packed.select(file, F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("value"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc").option("recursiveFileLookup", True).load(path).select(file, F.col("content").alias("value"))
    return packed.mapInArrow(run, _RECORD).union(plain.mapInArrow(run, _RECORD))


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, least_bytes: int = 0, source: DataFrame | None = None, once_read: Callable[[], None] = lambda: None) -> DataFrame:
    """Converts a folder of ARC archives to WARC; returns the problems met: file, record, problem.

    Of HTTP records with equal payloads of at least least_bytes, one is the response and the others revisit it. once_read is called
    when the ARC archives are needed no more.
    """
    scratch = Scratch(spark, "warc", source)
    found = scratch.put(records(spark, arc_path), "records")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(arc_path).select(F.xxhash64("_metadata.file_path").alias("id"), F.col("path").alias("name"))
    problems = scratch.put(found.filter("problem is not null").join(names, F.col("file") == F.col("id"), "left").select(F.col("name").alias("file"), F.col("ordinal").alias("record"), "problem"), "problems")
    once_read()
    order = (F.col("page").isNull().alias("none"), "page", "date", "url", "file", "ordinal", "record_id")
    same = found.filter((F.col("kind") == "response") & (F.col("size") >= least_bytes))
    firsts = same.groupBy("digest", "size").agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("c")).filter("c > 1").select("digest", "size", "f")
    is_first = F.coalesce(F.col("page") == F.col("f.page"), (F.col("file") == F.col("f.file")) & (F.col("ordinal") == F.col("f.ordinal")))
    again = same.drop("member").join(firsts, ["digest", "size"]).filter(~is_first)
    again = scratch.put(again.withColumn("first_id", F.col("f.record_id")).withColumn("first_url", F.col("f.url")).withColumn("first_date", F.col("f.date")).drop("f"), "revisits")

    def revisit(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [member(warc_record(Described(**{n: r[n] for n in Described.__dataclass_fields__}), b"", (r["first_id"], r["first_url"], r["first_date"]))) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    whole = found.filter("member is not null").select("file", "ordinal", "member").join(again.select("file", "ordinal"), ["file", "ordinal"], "left_anti")
    _write_members(whole.select("member").union(again.mapInArrow(revisit, "member binary")), warc_path, "converted", ".warc.gz")
    scratch.keep("problems")
    return problems


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id.

    Digests of whole records are checked. Size and page of what a revisit stands for come from the response that it refers to.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "target_uri", "record_id", "response_id"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5]

    def run(batches):
        rows = []
        for head, block in parse_warc(v or b"" for batch in batches for v in batch.column(0).to_pylist()):
            kind = head["warc-type"]
            if kind == "warcinfo":
                continue
            fields, _, payload = http_parts(block) if head["content-type"].startswith("application/http") else ({}, b"", block)
            named = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if digest(block) != head["warc-block-digest"].removeprefix("sha1:") or kind != "revisit" and digest(payload) != named:
                raise ValueError(f"record {head['warc-record-id']} differs from its digest")
            page = int(fields["x-page-id"]) if fields.get("x-page-id") else None
            rows.append((page, None if kind == "revisit" else len(payload), named, kind, head["warc-target-uri"], head["warc-record-id"], head.get("warc-refers-to")))
            if len(rows) >= 5000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    ship(spark)
    pieces = spark.read.option("lineSep", END.decode()).option("recursiveFileLookup", True).text(path).select(F.col("value").cast("binary"))
    scratch = Scratch(spark, "warc-read", pieces)
    found = scratch.put(pieces.mapInArrow(run, ", ".join(f"{n} {'long' if i < 2 else 'string'}" for i, n in enumerate(names))), "rows")
    whole = found.filter("record_type <> 'revisit'").select(F.col("record_id").alias("response_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    out = found.filter("record_type = 'revisit'").join(whole, "response_id", "left").select(*names[:1], F.col("size").alias("payload_bytes"), *names[2:4], "refers_to", *names[4:6])
    return found.filter("record_type <> 'revisit'").select(*names[:4], F.lit(None).cast("long").alias("refers_to"), *names[4:6]).union(out)


def write(pages: DataFrame, path: str, **options) -> None:
    """Writes pages as ARC archives to the shared folder and converts these to WARC archives."""
    least = options.pop("least_bytes", 0)
    scratch = Scratch(pages.sparkSession, "arc")
    to_arc(pages, scratch.path("pages"), **options)
    problem = convert(pages.sparkSession, scratch.path("pages"), path, least_bytes=least, source=pages, once_read=lambda: scratch.drop("pages")).first()
    if problem:
        raise ValueError(f"{problem['file']}, record {problem['record']}: {problem['problem']}")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    scratch = Scratch(pages.sparkSession, "archives")
    write(pages, scratch.path("warc"), **options)
    out = read(pages.sparkSession, scratch.path("warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    scratch.drop("warc")
    return out
