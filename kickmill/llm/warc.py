"""WARC archives as a PySpark Python data source (read and write), and pages archived with revisit records.

Files hold one gzip member per record.  Each member's header has the ``sl`` extra field (length of the
member, length of its data), so a reader inflates the first bytes, parses the record's headers and, where the
record or its payload isn't wanted, goes straight on to the next member.  Members without that field
and plain ``.warc`` files are read too.

Planning lists the files and packs them into partitions of about ``partitionBytes``; a file too long for
one partition is read from several starting members, which the writer notes in the manifest.  Filters on
``record_type`` and other header columns are pushed down and judged before a payload is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from kickmill.llm.tables import discard, folder, stored

# workers get these classes by value, so that planning needs no import path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
#: Header columns in the order of SCHEMA.
HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
#: How the names of manifests begin.
MANIFEST = "manifest-"
#: A member of the manifest's starting points each so many bytes.
MARK_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def file_system(path: str):
    """pyarrow's file system and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value without control characters, which become percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def member(record: bytes, level: int) -> bytes:
    """The record as a gzip member with its lengths in the extra field ``sl``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(kind: str, record_id: str, uri: str, payload_digest: str, payload_length: int, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit whose HTTP headers tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(uri)}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers and where the block begins; None if the end isn't in sight yet."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    heads: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        heads[name.strip()] = value.strip()
    return heads, end + 4


def block_length(heads: dict[str, str]) -> int:
    """Bytes of the record's block; header names have no case."""
    return next((int(v) for h, v in heads.items() if h.lower() == "content-length"), 0)


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """Payload of an HTTP block and the length its headers tell."""
    if not block.startswith(b"HTTP/"):
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    told = next((int(x.split(b":")[1]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    return body, told


def manifests(fs, root: str) -> list[str]:
    """Paths of the commits' manifests."""
    from pyarrow import fs as pafs

    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


class Committed(WriterCommitMessage):
    def __init__(self, name: str | None, size: int, marks: list[int]):
        self.name, self.size, self.marks = name, size, marks


class WarcWriter(DataSourceArrowWriter):
    """One file per task, under a name of its own; only files named in a manifest count.  Overwriting removes what was committed before.

    Input columns: record_id, target_uri, payload (binary), refers_to (null: a response).
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"].rstrip("/"), int(options.get("level", 1)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, out, size, marks = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "target_uri", "payload", "refers_to")]
            for i in range(batch.num_rows):
                record_id, uri, payload, refers_to = (c[i].as_py() for c in columns)
                payload = payload or b""
                kind = "response" if refers_to is None else "revisit"
                data = member(record_bytes(kind, record_id or "", uri or "", digest(payload), len(payload), payload, refers_to), self.level)
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                if size - marks[-1] >= MARK_BYTES:
                    marks.append(size)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Committed(name if out is not None else None, size, marks)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        old = manifests(fs, root) if self.overwrite else []
        listed = [{"name": m.name, "size": m.size, "marks": m.marks} for m in messages if m is not None and m.name]
        # each commit has a manifest of its own, under a name that appears with its content
        path = f"{root}/{MANIFEST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{path}.tmp", compression=None) as out:
            out.write(json.dumps(listed).encode())
        fs.move(f"{path}.tmp", path)
        for gone in old:
            names = [f["name"] for f in json.loads(fs.open_input_stream(gone, compression=None).read())]
            fs.delete_file(gone)
            for name in names:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


class Range(InputPartition):
    """(file, first byte, end) of whole members."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Equality, membership, prefix and null tests of header columns are judged here; others by Spark."""
        kinds = {EqualTo: "is", EqualNullSafe: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "some", IsNull: "none"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in kinds and column in HEADER_OF:
                self.tests.append((column, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.path.rstrip("/"))
        from pyarrow import fs as pafs

        pieces: list[tuple[str, int, int]] = []
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            pieces.append((root, 0, info.size))
        elif found := manifests(fs, root):
            for path in found:
                for f in json.loads(fs.open_input_stream(path, compression=None).read()):
                    pieces += [(f"{root}/{f['name']}", a, b) for a, b in zip(f["marks"], [*f["marks"][1:], f["size"]])]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            pieces = [(f.path, 0, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))]
        pieces.sort(key=lambda p: (p[1] - p[2], p[0], p[1]))
        planned: list[Range] = []
        own, size = [], 0
        for p in pieces:
            if own and size + p[2] - p[1] > self.partition_bytes:
                planned.append(Range(own))
                own, size = [], 0
            own.append(p)
            size += p[2] - p[1]
        return [*planned, Range(own)]

    def wanted(self, values: dict) -> bool:
        for column, kind, value in self.tests:
            own = values[column]
            if kind == "none":
                good = own is None
            elif kind == "some":
                good = own is not None
            elif own is None:
                good = kind == "is" and value is None
            else:
                good = {"is": lambda: own == value, "in": lambda: own in value, "starts": lambda: own.startswith(value), "ends": lambda: own.endswith(value), "has": lambda: value in own}[kind]()
            if not good:
                return False
        return True

    def row(self, heads: dict, block) -> tuple | None:
        """The row of a record; block() decodes its block and is called only for a wanted payload."""
        folded = {h.lower(): v for h, v in heads.items()}
        values = {c: folded.get(h.lower()) for c, h in HEADER_OF.items()}
        if values["payload_digest"]:
            values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
        if not self.wanted(values):
            return None
        payload, length = None, None
        kind = values["record_type"]
        if kind == "revisit" or self.with_payload:
            payload, told = payload_of(block())
            length = told if told is not None else len(payload)
            if kind == "revisit":
                payload = None
            elif self.verify and kind == "response" and values["payload_digest"] and digest(payload) != values["payload_digest"]:
                raise ValueError(f"payload of {values['record_id']} differs from its digest")
        return (*values.values(), length, list(heads.items()), payload)

    def members(self, source, end: int) -> Iterator[tuple]:
        """Rows of the gzip members up to ``end``."""
        while source.tell() < end:
            at = source.tell()
            head = source.read(24)
            size = struct.unpack_from("<I", head, 16)[0] if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" else None
            source.seek(at)
            if size:
                first = source.read(min(size, 4096))
                unzip = zlib.decompressobj(31)
                data = unzip.decompress(first, 8192)
                while (parsed := parse_head(data)) is None and not unzip.eof:
                    if not (more := unzip.unconsumed_tail or source.read(min(4096, at + size - source.tell()))):
                        break
                    data += unzip.decompress(more, 8192)

                def rest(data=data, unzip=unzip):
                    tail = unzip.unconsumed_tail + source.read(at + size - source.tell())  # noqa: B023
                    return data + unzip.decompress(tail) + unzip.flush()

            else:
                unzip, parts = zlib.decompressobj(31), []
                while not unzip.eof and (got := source.read(1 << 16)):
                    parts.append(unzip.decompress(got))
                data = b"".join(parts)
                size = source.tell() - len(unzip.unused_data) - at
                parsed, rest = parse_head(data), lambda data=data: data
            if parsed:
                heads, begin = parsed
                length = block_length(heads)
                if (row := self.row(heads, lambda: rest()[begin : begin + length])) is not None:  # noqa: B023
                    yield row
            source.seek(at + size)

    def plain(self, source, end: int) -> Iterator[tuple]:
        """Rows of an uncompressed file."""
        while source.tell() < end:
            at, data = source.tell(), b""
            while (parsed := parse_head(data.lstrip(b"\r\n"))) is None:
                if not (got := source.read(4096)):
                    return
                data += got
            begin = at + len(data) - len(data.lstrip(b"\r\n")) + parsed[1]
            length = block_length(parsed[0])

            def block(begin=begin, length=length):
                source.seek(begin)
                return source.read(length)

            if (row := self.row(parsed[0], block)) is not None:
                yield row
            source.seek(begin + length + 4)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        rows, size = [], 0
        for path, begin, end in partition.parts:
            with fs.open_input_file(path) as source:
                source.seek(begin)
                for row in (self.members if path.endswith(".gz") else self.plain)(source, end):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``.  Options: path, payload (false: payloads stay null), verify, partitionBytes, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Revisits that are sent to every task as (id, digest, first id), about 100 bytes each; more are joined by a shuffle.
MOST_SENT = 300_000


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, overwrite: bool = False) -> None:
    """Write a record per page: of equal payloads of at least ``least`` bytes the smallest id is the response, others revisit it.

    A null payload is empty, a null url too; very long ones of both are written whole.  A row with a null id is always a response and never referred to.  Repeated
    rows of the smallest id are all responses.  Other columns are ignored, whatever their names.  An empty table writes an empty archive.
    Records are added to what the folder has, or with ``overwrite`` replace it.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    digests = rows.filter(F.octet_length("payload") >= least).select("id", F.sha1("payload").alias("sha"))
    copied = digests.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    revisits = stored(digests.join(copied.select("sha", "first"), "sha").filter("id > first").select("id", "sha", "first").distinct(), "revisits")
    later = F.broadcast(revisits) if revisits.count() <= MOST_SENT else revisits
    marked = rows.withColumn("sha", F.sha1("payload")).join(later, ["id", "sha"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    records = marked.select(F.coalesce(urn("id"), F.lit("<urn:page:>")).alias("record_id"), "target_uri", "payload", F.when(F.col("first").isNotNull(), urn("first")).alias("refers_to"))
    records.write.format("warc").mode("overwrite" if overwrite else "append").save(path)
    discard(revisits)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages are archived and read back; payloads of responses are decoded and verified."""
    path = folder(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    read = spark.read.format("warc")
    responses = read.option("verify", "true").load(path).filter("record_type = 'response'").withColumn("bytes", F.octet_length("payload").cast("long"))
    revisits = read.option("verify", "false").load(path).filter("record_type = 'revisit'").withColumn("bytes", F.col("payload_length"))
    columns = [number(F.col("record_id")).alias("page_id"), F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to")]
    return responses.select(*columns).unionByName(revisits.select(*columns))
