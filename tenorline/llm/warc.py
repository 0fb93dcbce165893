"""WARC archives as a Spark data source, ``format("warc")``.

Reading: a partition per archive file. The WARC headers of each record are parsed first; predicates on ``warc_type`` and on
the other header columns are pushed down to that point, and the block of a record that fails them is neither inflated nor
decoded. With the option ``payload`` = ``false`` no block is. Every gzip member carries its lengths in the extra field ``sl``
that the WARC standard suggests, which lets the reader step over the block; members without it, or with several records, are inflated and thrown
away. Header names count in any case.

Writing: rows (record_id, warc_type, target_uri, date, payload, payload_digest, payload_length, refers_to), a file per task,
one gzip member per record; a file is closed and the next begun at ``FILE_BYTES``. Tasks write under names of their own, and
the commit moves the files of the tasks that count into place, so tasks that are run twice leave nothing.

Defined cases: a null payload is empty; null header values are not written and read as null; a record that is cut off at the
end of a file ends that file; a missing or malformed ``Content-Length`` counts as zero, and bytes that no record claims are
passed over up to the next line that begins with ``WARC/``; a malformed payload length reads as null; unknown headers are kept in ``headers``; columns of the input beyond those named are refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from tenorline.llm.runtime import broadcast_if_small, cut, scratch

FILE_BYTES = 128 << 20
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
LEAST_SHARED = 1000
WRITTEN = "record_id string, warc_type string, target_uri string, date string, payload binary, payload_digest string, payload_length long, refers_to string"
SCHEMA = f"{WRITTEN}, headers map<string,string>"

# Names of the WARC headers per column, and texts of the format.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
           "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
NAMES = {name.lower(): name for name in (*HEADERS.values(), "Content-Type", "Content-Length")}  # headers are named in any case
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def gzip_member(data: bytes) -> bytes:
    """One gzip member with the lengths of its packed and plain data in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, len(packed), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + tail


def record(values: dict) -> bytes:
    """The plain bytes of a WARC record."""
    body = values["payload"] or b""
    if values["warc_type"] == "response":
        block, kind = HTTP_HEAD + f"Content-Length: {len(body)}\r\n\r\n".encode() + body, "application/http; msgtype=response"
    elif values["warc_type"] == "revisit":
        block, kind = HTTP_HEAD + b"\r\n", "application/http; msgtype=response"
    else:
        block, kind = body, "application/octet-stream"
    lines = [VERSION] + [f"{name}: {_one_line(values[c])}" for c, name in HEADERS.items() if values[c] is not None]
    if values["warc_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.limit = options["path"], int(options.get("filebytes", FILE_BYTES))
        self.run, self.overwrite = uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = file_system(f"{self.path}/_work-{self.run}")
        files.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for values in batch.to_pylist():
                    if out is None or size >= self.limit:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    size += out.write(gzip_member(record(values)))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        files, base = file_system(self.path)
        work = f"{base}/_work-{self.run}"
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        names = [name for m in messages if m is not None for name in m.names]
        for k, name in enumerate(names):
            files.move(f"{work}/{name}", f"{base}/part-{k:06d}-{name}")
        if files.get_file_info(work).type != fs.FileType.NotFound:
            files.delete_dir(work)

    def abort(self, messages: list) -> None:
        files, work = file_system(f"{self.path}/_work-{self.run}")
        if files.get_file_info(work).type != fs.FileType.NotFound:
            files.delete_dir(work)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


def records(stream, wanted, payload: bool, packed: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, block) of the records whose headers are ``wanted``; the block is ``None`` without ``payload``."""
    source = _Packed(stream) if packed else _Plain(stream)
    while (head := source.head()) is not None:
        headers = parse_headers(head)
        take = wanted(headers)
        block = source.block(whole_number(headers.get("Content-Length")) or 0, take and payload)
        if take:
            yield headers, block


def whole_number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    named = ((name.strip(), value.strip()) for name, mark, value in (line.partition(":") for line in lines[1:]) if mark)
    return {NAMES.get(name.lower(), name): value for name, value in named}


class _Plain:
    """Records of a stream of plain bytes; ``plain`` holds what is read but not yet used."""

    def __init__(self, stream):
        self.stream, self.plain = stream, b""

    def more(self) -> bool:
        """Adds bytes to ``plain``; false at the end."""
        data = self.stream.read(1 << 16)
        self.plain += data
        return bool(data)

    def head(self) -> bytes | None:
        """The next header block. Bytes that no record claims are passed over up to a line that begins one."""
        while True:
            self.plain = self.plain.lstrip(b"\r\n")
            if len(self.plain) < 5 or not self.plain.startswith(b"WARC/"):
                at = self.plain.find(b"\nWARC/")
                if at >= 0:
                    self.plain = self.plain[at + 1:]
                    continue
                if len(self.plain) >= 5:
                    self.plain = self.plain[-5:] if b"\n" in self.plain[-5:] else b"x"
            elif (end := self.plain.find(b"\r\n\r\n")) >= 0:
                head, self.plain = self.plain[:end], self.plain[end + 4:]
                return head
            if not self.more():
                return None

    def block(self, size: int, keep: bool) -> bytes | None:
        if not keep:
            rest = size - len(self.plain)
            self.plain = self.plain[size:]
            if rest > 0:
                self.stream.seek(self.stream.tell() + rest)
            return None
        return self.taken(size, True)

    def taken(self, size: int, keep: bool) -> bytes | None:
        """The next ``size`` bytes, or what the file has of them."""
        parts = []
        while size > 0 and (self.plain or self.more()):
            part, self.plain = self.plain[:size], self.plain[size:]
            size -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts) if keep else None


class _Packed(_Plain):
    """Gzip members one after another are one stream of records. A member that tells its lengths and holds one record can be stepped over."""

    def __init__(self, stream):
        super().__init__(stream)
        self.held, self.at, self.inflater = b"", 0, None  # packed bytes not yet inflated, their place in the file
        self.lone = None  # the member that ``plain`` began with: its end in the file, and its plain bytes

    def _fill(self, size: int) -> bool:
        while len(self.held) < size:
            data = self.stream.read(max(1 << 16, size - len(self.held)))
            if not data:
                return False
            self.held += data
        return True

    def _member(self) -> bool:
        self.lone = None
        if not self._fill(18) or self.held[:2] != b"\x1f\x8b":
            return False
        if self.held[3] == 4 and self.held[12:14] == b"sl" and self._fill(24) and not self.plain:
            start = 12 + struct.unpack("<H", self.held[10:12])[0]
            packed, plain = struct.unpack("<II", self.held[16:24])
            self.lone = self.at + start + packed + 8, plain
        self.inflater = zlib.decompressobj(31)
        return True

    def more(self, most: int = 4096) -> bool:
        while True:
            if self.inflater is None or self.inflater.eof:
                if not self._member():
                    return False
            ended = not self.held and not self._fill(1)
            data = self.held[:1 << 16]
            out = self.inflater.decompress(data, most)
            left = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            self.held, self.at = left + self.held[len(data):], self.at + len(data) - len(left)
            self.plain += out
            if out or ended:
                return bool(out)

    def head(self) -> bytes | None:
        self.plain, self.lone = self.plain.lstrip(b"\r\n"), None
        head = super().head()
        self.head_bytes = len(head) + 4 if head is not None else 0
        return head

    def block(self, size: int, keep: bool) -> bytes | None:
        if not keep and self.lone is not None and self.lone[1] == self.head_bytes + size + 4:
            end, self.plain, self.inflater = self.lone[0], b"", None
            if end - self.at <= len(self.held):
                self.held = self.held[end - self.at:]
            else:
                self.stream.seek(end)
                self.held = b""
            self.at = end
            return None
        return self.taken(size, keep)

    def taken(self, size: int, keep: bool) -> bytes | None:
        parts = []
        while size > 0 and (self.plain or self.more(1 << 20)):
            part, self.plain = self.plain[:size], self.plain[size:]
            size -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts) if keep else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {EqualTo: "=", EqualNullSafe: "=", In: "in", StringStartsWith: "starts", IsNotNull: "set", IsNull: "unset"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in kinds and column in HEADERS and column != "payload_length":
                self.tests.append((kinds[type(f)], column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        files, base = file_system(self.path)
        found = [files.get_file_info(base)]
        if found[0].type == fs.FileType.Directory:
            found = files.get_file_info(fs.FileSelector(base))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def wanted(self, headers: dict) -> bool:
        for kind, column, value in self.tests:
            own = headers.get(HEADERS[column])
            if kind == "=" and own != value or kind == "in" and own not in value or kind == "starts" and not (own or "\0").startswith(value):
                return False
            if kind in ("set", "unset") and (own is None) == (kind == "set"):
                return False
        return True

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        kind = pa.schema([*((c, pa.string()) for c in ("record_id", "warc_type", "target_uri", "date")), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))])
        files, _ = file_system(self.path)
        rows, size = [], 0
        with files.open_input_file(partition.path) as stream:
            for headers, block in records(stream, self.wanted, self.payload, partition.path.endswith(".gz")):
                values = {c: headers.get(name) for c, name in HEADERS.items()}
                values["payload_length"] = whole_number(values["payload_length"])
                if block is not None and headers.get("Content-Type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                known = {*HEADERS.values(), "Content-Length"}
                rows.append({**values, "payload": block, "headers": [(k, v) for k, v in headers.items() if k not in known]})
                size += len(block or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class WarcSource(DataSource):
    """Options: ``path``; reading also ``payload``, writing also ``fileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({name.lower(): value for name, value in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({name.lower(): value for name, value in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """A WARC record per row of ``pages``; of equal payloads of ``least`` bytes and more only the one of the largest page_id is stored.

    The texts are not shuffled: payloads that occur twice are found by their digests, and only these, with the page that
    keeps them, are joined. Rows with a null page_id are responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    shared = cut(groups.select(F.col("payload_digest").alias("shared_digest"), "kept_id"), "shared-payloads")
    both = rows.join(broadcast_if_small(shared), F.col("payload_digest") == F.col("shared_digest"), "left")
    again = F.coalesce(F.col("page_id") != F.col("kept_id"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return both.select(F.coalesce(name(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"),
                       F.lit("2026-01-01T00:00:00Z").alias("date"), F.when(~again, F.col("payload")).alias("payload"), F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
                       "payload_length", F.when(again, name(F.col("kept_id"))).alias("refers_to"))


def write_warc(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to per row of ``pages``, from archives written and read back.

    Responses are measured on the payload that was read; revisits have no payload, so their headers tell.
    """
    path = scratch(pages.sparkSession, "warc")
    write_warc(page_records(pages), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    responses = read_warc(pages.sparkSession, path).where("warc_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(pages.sparkSession, path, payload=False).where("warc_type = 'revisit'").select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
