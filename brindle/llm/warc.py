"""WARC archives as a Python data source, and pages written to them with payload deduplication."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import HOT_ROWS, MOST_HOT, new_folder, stored

#: Bytes of compressed records that one read partition covers, about.
SPLIT_BYTES = 16 << 20
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of the source and the record headers they come from; ``payload`` is the body after the
#: HTTP header, ``payload_ok`` whether it has the length and digest that the headers tell (null if it was not read).
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary, payload_ok boolean"
ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("payload_ok", pa.bool_())])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(headers: dict[str, str | None], payload: bytes | None, full: int, level: int = 1) -> bytes:
    """One record as a gzip member. The extra field ``sl`` holds the member's length, so a reader can step over it,
    and the deflate stream is flushed after the record header, so that alone can be inflated.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    head = "\r\n".join([*lines, "", ""]).encode()
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
    raw = head + block + b"\r\n\r\n"
    total = 10 + 2 + 8 + len(body) + 8
    extra = struct.pack("<H2sHI", 8, b"sl", 4, total)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_header(head: bytes) -> dict[str, str]:
    """Names in lower case and values of the lines after the first; a line that begins with white space goes on."""
    lines: list[str] = []
    for x in head.decode("utf-8", "replace").splitlines()[1:]:
        if x[:1] in (" ", "\t") and lines:
            lines[-1] += " " + x.strip()
        elif x:
            lines.append(x)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Stream:
    """Bytes of an archive from an offset on, read in steps; ``made`` counts those that were read or inflated."""

    STEP = 1 << 14

    def __init__(self, f, at: int):
        self.f, self.buffer, self.made = f, b"", 0
        f.seek(at)

    def more(self) -> bytes:
        data = self.f.read(self.STEP)
        self.made += len(data)
        return data

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are in the buffer, after reading as much as that takes."""
        parts, have = [], len(self.buffer)
        while have < n:
            data = self.more()
            if not data:
                break
            parts.append(data)
            have += len(data)
            if not self.buffer:
                self.buffer = parts.pop()
        self.buffer = b"".join([self.buffer, *parts])
        return have >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        data, self.buffer = self.buffer[:n], self.buffer[n:]
        return data

    def head(self, most: int = 1 << 20) -> bytes | None:
        """A header, up to and without its empty line; None if there is none in ``most`` bytes."""
        n = 1024
        while True:
            full = self.fill(n)
            found = [(self.buffer.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n")]
            found = [x for x in found if x[0] >= 0]
            if found:
                at, gap = min(found)
                data, self.buffer = self.buffer[:at], self.buffer[at + gap :]
                return data
            if not full or n >= most:
                return None
            n *= 2

    def skip(self, n: int) -> None:
        if n > len(self.buffer):
            self.f.seek(self.f.tell() + n - len(self.buffer))
            self.buffer = b""
        else:
            self.buffer = self.buffer[n:]

    def begin(self) -> int | None:
        """Offset of the next record (of its member, in a compressed file); None at the end of the file."""
        while self.fill(1) and self.buffer[:1] in b"\r\n":
            self.buffer = self.buffer[1:]
        return self.f.tell() - len(self.buffer) if self.buffer else None

    def jump(self) -> bool:
        """Step over the rest of a record's member, if its length is known without inflating it."""
        return False


class Inflated(Stream):
    """The same for a file of gzip members, one or more records in each."""

    def __init__(self, f, at: int):
        super().__init__(f, at)
        self.raw, self.z, self.start, self.size = b"", None, at, None

    def more(self) -> bytes:
        """Inflated bytes of the member; a new one is begun only where nothing of the last is left in the buffer."""
        while True:
            if self.z is None:
                if self.buffer:
                    return b""
                while len(self.raw) < 64 and (data := self.f.read(self.STEP)):
                    self.raw += data
                if not self.raw.startswith(b"\x1f\x8b"):
                    return b""
                self.start = self.f.tell() - len(self.raw)
                self.size = self.length(self.raw)
                self.z = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.f.read(self.STEP)
                if not self.raw:
                    return b""
            data = self.z.decompress(self.raw, self.STEP)
            self.made += len(data)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
            if data:
                return data

    @staticmethod
    def length(raw: bytes) -> int | None:
        """Length of a member from its extra field ``sl``."""
        if len(raw) >= 20 and raw[3] & 4 and raw[12:16] == b"sl\x04\x00":
            return struct.unpack("<I", raw[16:20])[0]
        return None

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if self.z is None:  # a record ends with its member
                return
            self.buffer = self.more()
        self.buffer = self.buffer[n:]

    def begin(self) -> int | None:
        while self.fill(1) and self.buffer[:1] in b"\r\n":
            self.buffer = self.buffer[1:]
        return self.start if self.buffer else None

    def jump(self) -> bool:
        if self.size is None:
            return False
        self.f.seek(self.start + self.size)
        self.raw, self.z, self.buffer, self.size = b"", None, b"", None
        return True


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    size: int
    marks: list[int]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.want: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and prefix tests of header columns are settled on the header; others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.want.append(("in", column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.want.append(("in", column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.want.append(("starts", column, (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Stretches of whole records of the files in the manifest; without one, each ``.warc`` or ``.warc.gz`` file
        below the path, whole, as nothing in a file tells surely where a record begins but what lies before it.
        """
        fs, top = filesystem(self.path)
        if fs.get_file_info(top).type == pafs.FileType.File:
            return [Span(top, 0, -1)]
        if fs.get_file_info(f"{top}/{MANIFEST}").type != pafs.FileType.File:
            found = fs.get_file_info(pafs.FileSelector(top, recursive=True))
            return [Span(p, 0, -1) for p in sorted(x.path for x in found if x.path.endswith((".warc", ".warc.gz")))] or [Span("", 0, 0)]
        with fs.open_input_stream(f"{top}/{MANIFEST}") as f:
            files = json.loads(f.read())
        spans = []
        for x in files:
            edges = [*x["marks"], x["size"]]
            spans += [Span(f"{top}/{x['path']}", a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return spans or [Span("", 0, 0)]

    def wanted(self, values: dict[str, str | None]) -> bool:
        for test, column, given in self.want:
            v = values[column]
            if v is None or (v not in given if test == "in" else not v.startswith(given)):
                return False
        return True

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        if partition.start == partition.stop:
            return
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.path) as f:
            for values in self.records(f, partition.start, partition.stop):
                rows.append(values)
                held += len(values["payload"] or b"")
                if held > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def records(self, f, start: int, stop: int) -> Iterator[dict]:
        """Records that begin in a stretch of a file (stop -1: to its end), those not wanted stepped over."""
        f.seek(start)
        gz = f.read(2) == b"\x1f\x8b"
        s = self.stream = (Inflated if gz else Stream)(f, start)
        while (at := s.begin()) is not None and (stop < 0 or at < stop):
            head = s.head()
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at offset {at}")
            fields = parse_header(head)
            if not fields.get("content-length", "").isdigit():
                raise ValueError(f"the record at offset {at} has no Content-Length")
            left = int(fields["content-length"])
            values = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
            if self.wanted(values):
                left -= self.body(s, values, left)
                yield values
            if left and not s.jump():
                s.skip(left)  # neither kept nor decoded; in a plain file not read

    def body(self, s: Stream, values: dict, size: int) -> int:
        """Payload, its length and whether it is sound; the bytes of the block that were taken."""
        used, http = 0, {}
        values |= {"payload": None, "payload_bytes": size, "payload_ok": None}
        if (values["content_type"] or "").lower().startswith("application/http"):
            s.fill(min(size, 1 << 14))
            block = s.buffer[:size]
            end = block.find(b"\r\n\r\n")
            while end < 0 and len(block) < min(size, 1 << 20) and s.fill(len(block) + 1):
                block = s.buffer[:size]
                end = block.find(b"\r\n\r\n")
            if end >= 0:
                used = end + 4
                http = parse_header(s.take(used)[:end])
                values["payload_bytes"] = size - used
        told = http.get("content-length", "")
        if values["record_type"] == "revisit":
            values["payload_bytes"] = int(told) if told.isdigit() else None
            return used
        if not self.payload:
            return used
        body = values["payload"] = s.take(size - used)
        digest = values["payload_digest"] or ""
        if digest.startswith("sha1:") and "transfer-encoding" not in http:
            values["payload_ok"] = len(body) == size - used and (not told.isdigit() or len(body) == int(told)) and digest[5:] == digest_of(body)
        return size


class WarcWriter(DataSourceArrowWriter):
    """A file a task, under a name of its own; the manifest names the files of the tasks that were committed."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, top = filesystem(self.path)
        name, out, size, marks = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, []
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        fs.create_dir(top, recursive=True)
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    if not marks or size - marks[-1] >= SPLIT_BYTES:
                        marks.append(size)
                    record = self.record(row)
                    out.write(record)
                    size += len(record)
        finally:
            if out is not None:
                out.close()
        return Written(name if marks else None, size, marks)

    def record(self, row: dict) -> bytes:
        payload, given = row["payload"] or b"", row.get("payload_digest")
        first = row["record_type"] == "response"
        if first or not given:
            given, size = "sha1:" + digest_of(payload), len(payload)
        else:
            size = row.get("payload_bytes") or 0
            if len(given) == 45:  # hexadecimal
                given = "sha1:" + base64.b32encode(bytes.fromhex(given[5:])).decode()
        headers = {
            "WARC-Type": row["record_type"],
            "WARC-Record-ID": row["record_id"],
            "WARC-Date": self.date,
            "WARC-Target-URI": row["target_uri"],
            "WARC-Payload-Digest": given,
            "WARC-Refers-To": row["refers_to"],
            "WARC-Profile": None if first else PROFILE,
            "Content-Type": "application/http; msgtype=response",
        }
        return encode_record(headers, payload if first else None, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.path)
        fs.create_dir(top, recursive=True)
        files = [{"path": m.path, "size": m.size, "marks": m.marks} for m in messages if m is not None and m.path]
        old = []
        if fs.get_file_info(f"{top}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{top}/{MANIFEST}") as f:
                old = json.loads(f.read())
        new = f"{top}/_manifest-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps(files if self.overwrite else old + files).encode())
        try:  # readers see the old manifest or the new one
            fs.move(new, f"{top}/{MANIFEST}")
        except OSError:  # file systems that do not replace
            fs.delete_file(f"{top}/{MANIFEST}")
            fs.move(new, f"{top}/{MANIFEST}")
        for x in old if self.overwrite else []:
            fs.delete_file(f"{top}/{x['path']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(f"{top}/{m.path}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(folder)``.

    Reads a file or all ``.warc`` and ``.warc.gz`` files below a folder, with records of any type; in a folder that it
    wrote, only what was committed. The payload of ``application/http`` records is the part after the HTTP header,
    that of others the whole block; revisits have none, and their payload_bytes is the Content-Length of the HTTP
    header (null without one). payload_ok tells whether the payload has the SHA-1 of its header, null where there is
    none or a transfer encoding stands between. Records that the filters refuse are stepped over: by a seek in plain
    files and where members tell their length, else by inflating without keeping.

    Spark keeps what it pushed down with a loaded frame, so load anew for each query that filters by header columns.

    Option ``payload`` "false" leaves the column null; ``date`` is the WARC-Date of written records. Writing takes
    record_type (response or revisit), record_id, target_uri, refers_to, payload and, for revisits, payload_digest
    (``sha1:`` with base32 or hexadecimal digits) and payload_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def to_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """record_type, record_id, target_uri, refers_to, payload, payload_digest, payload_bytes of each page.

    Of pages with equal payloads of at least ``least_bytes`` bytes exactly one is a response, that with the smallest
    id (null last; one of them if it repeats), the others revisit it; smaller payloads are all responses. The payloads
    move once, by digest. A digest of very many pages is hot: its payload is combined before it moves and its pages
    go without it, so no task gets all of them. Null html counts as empty; a revisit of a page without an id refers
    to nothing.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    sha = F.concat(F.lit("sha1:"), F.hex("digest"))

    def made(rows: DataFrame, again: Column, first: Column, payload: Column) -> DataFrame:
        return rows.select(
            F.when(again, "revisit").otherwise("response").alias("record_type"),
            urn(F.col("id")).alias("record_id"),
            F.col("url").alias("target_uri"),
            F.when(again, urn(first)).alias("refers_to"),
            F.when(~again, payload).alias("payload"),
            sha.alias("payload_digest"),
            F.col("size").alias("payload_bytes"),
        )

    same = own.where(F.col("size") >= least_bytes)
    counts = stored(same.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "warc-digests")
    limit = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(counts.where(F.col("n") > limit).select("digest"))  # MOST_HOT at most
    any_hot = not hot.isEmpty()
    cold = same.join(hot, "digest", "left_anti") if any_hot else same
    order = Window.partitionBy("digest").orderBy(F.col("id").isNull(), "id")
    ranked = cold.withColumns({"again": F.row_number().over(order) > 1, "first": F.first("id").over(order)})
    out = made(ranked, F.col("again"), F.col("first"), F.col("payload"))
    if any_hot:
        held = same.join(hot, "digest")
        rows = stored(held.select("id", "url", "digest", "size").withColumn("row", F.monotonically_increasing_id()), "warc-hot")
        best = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("best"))
        best = stored(best.join(held.groupBy("digest").agg(F.any_value("payload").alias("payload")), "digest"), "warc-hot-first")
        found = rows.join(F.broadcast(best.select("digest", "best")), "digest")
        firsts = found.where(F.col("row") == F.col("best.row")).join(best.select("digest", "payload"), "digest")
        rest = found.where(F.col("row") != F.col("best.row"))
        out = out.unionByName(made(firsts, F.lit(False), F.col("id"), F.col("payload"))).unionByName(made(rest, F.lit(True), F.col("best.id"), F.lit(None).cast("binary")))
    if least_bytes > 0:
        out = out.unionByName(made(own.where(F.col("size") < least_bytes), F.lit(False), F.col("id"), F.col("payload")))
    return out


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as WARC records to ``path`` (a new shared folder if none) and return the archive read back.

    An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or new_folder(spark, "warc")
    to_records(pages, least_bytes, id_col, url_col, html_col).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)


def digests(records: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read back.

    A response whose payload does not have the digest and length of its headers gets a null digest.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    return records.select(
        page(F.col("record_id")).try_cast(id_type).alias("page_id"),
        "payload_bytes",
        F.when(F.coalesce("payload_ok", F.lit(True)), F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).try_cast(id_type).alias("refers_to"),
    )
